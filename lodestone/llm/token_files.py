"""Token-id files: ids packed in the fewest bits that the vocabulary needs, in blocks that open at any place.

Documents are range-partitioned by id before they are encoded (so that the
sampling of ranges encodes nothing), sorted, and encoded in Arrow batches. Each
partition is a shard, a run of blocks:

    magic "LSTK", version u16, width u16, documents u32, ids u64,
    (documents + 1) offsets u64, then every id in `width` bits, lowest first

Blocks are written as binary values of a Parquet table by Spark's committed
writer, so a lost executor or a second attempt leaves no torn or double file on
any store. Ids at places a to b of a block begin at bit a * width: they are
unpacked by array operations without reading the rest.

Where a shard begins among all ids is a running sum over one row per shard.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import pretokens
from .shared import ship

MAGIC, VERSION, HEAD = b"LSTK", 1, struct.Struct("<4sHHIQ")
#: Ids of a block, about: a block ends with the document that reaches this.
BLOCK_IDS = 1 << 20


def bits_for(vocabulary: int) -> int:
    """The fewest bits that hold the ids 0 to vocabulary - 1."""
    return max(1, (vocabulary - 1).bit_length())


#: Ids that are packed or unpacked at once: a multiple of 8, so that each run begins at a whole byte.
_RUN = 1 << 16


def pack(ids: np.ndarray, width: int) -> bytes:
    """Every id in `width` bits, lowest first; needs 9 bytes a bit for a run of ids only."""
    if width == 16:
        return ids.astype("<u2").tobytes()
    place = np.arange(width, dtype=np.uint64)
    runs = (((ids[a : a + _RUN].astype(np.uint64)[:, None] >> place) & np.uint64(1)).astype(np.uint8) for a in range(0, len(ids), _RUN))
    return b"".join(np.packbits(r.ravel(), bitorder="little").tobytes() for r in runs)


def unpack(data: bytes, width: int, a: int, b: int) -> np.ndarray:
    """Ids at places a to b - 1, from the bytes that hold them."""
    raw = np.frombuffer(data, np.uint8)
    if width == 16:
        return raw[2 * a : 2 * b].view("<u2").astype(np.uint32)
    out, place = np.empty(b - a, np.uint32), np.arange(width, dtype=np.uint32)
    for x in range(a, b, _RUN):
        y = min(x + _RUN, b)
        first = x * width // 8
        skip = x * width - 8 * first
        bits = np.unpackbits(raw[first : (y * width + 7) // 8], bitorder="little")[skip : skip + (y - x) * width].reshape(-1, width)
        out[x - a : y - a] = (bits.astype(np.uint32) << place).sum(1, dtype=np.uint32)
    return out


def write_block(ids: np.ndarray, sizes: np.ndarray, width: int) -> bytes:
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype("<u8")
    return HEAD.pack(MAGIC, VERSION, width, len(sizes), len(ids)) + offsets.tobytes() + pack(ids, width)


class Block:
    """A block opened for reading: len() documents, block[i] the ids of one."""

    def __init__(self, data: bytes):
        magic, version, self.width, self.documents, self.ids = HEAD.unpack_from(data)
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a block of token ids")
        at = HEAD.size + 8 * (self.documents + 1)
        self.offsets = np.frombuffer(data, "<u8", self.documents + 1, HEAD.size).astype(np.int64)
        self.data = memoryview(data)[at:]

    def __len__(self) -> int:
        return self.documents

    def __getitem__(self, i: int) -> np.ndarray:
        return self.slice(int(self.offsets[i]), int(self.offsets[i + 1]))

    def slice(self, a: int, b: int) -> np.ndarray:
        return unpack(self.data, self.width, a, b) if b > a else np.zeros(0, np.uint32)


def write(docs: DataFrame, to: str, path: str, vocabulary: int, end_id: int = 0, doc_id: str = "doc_id", text: str = "text", block_ids: int = BLOCK_IDS) -> None:
    """Encode whole texts, end each with end_id, and write them at `to` in ascending id order.

    Null ids come first; rows with one id stand in the order of their texts'
    hashes; equal rows are written as often as they occur. Null texts are
    empty: the end id alone. An empty table makes an empty set of files.
    """
    spark = docs.sparkSession
    ship(spark)
    width = bits_for(vocabulary)
    kind = docs.schema[doc_id].dataType.simpleString()
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    own = docs.select(F.col(doc_id).alias("doc"), F.col(text).alias("text"), F.xxhash64(text).alias("tk"))
    dealt = own.repartitionByRange(parts, "doc", "tk").sortWithinPartitions("doc", "tk").select("doc", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard, block, base = pretokens.encoder(path, "ids"), TaskContext.get().partitionId(), 0, 0
        ids: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        names: list[pa.Array] = []

        def flush() -> pa.RecordBatch:
            nonlocal block, base
            every, size = np.concatenate(ids), np.concatenate(sizes)
            data = write_block(every, size, width)
            docs = pa.ListArray.from_arrays(pa.array([0, len(size)], pa.int32()), pa.concat_arrays(names))
            row = pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([block], pa.int32()), pa.array([base], pa.int64()), pa.array([len(every)], pa.int64()), docs, pa.array([data], pa.binary())], ["shard", "block", "base", "n_ids", "docs", "data"])
            block, base = block + 1, base + len(every)
            ids.clear(), sizes.clear(), names.clear()
            return row

        for b in batches:
            at = 0
            for got, offs in encoder.ids_of(b.column(1)):
                if len(got) and int(got.max()) >= vocabulary:
                    raise ValueError(f"id {got.max()} is beyond the vocabulary of {vocabulary}")
                n = len(offs) - 1
                size = offs[1:] - offs[:-1] + 1
                every = np.full(len(got) + n, end_id, np.uint32)
                inner = np.ones(len(every), bool)
                inner[np.cumsum(size) - 1] = False
                every[inner] = got
                ids.append(every), sizes.append(size), names.append(b.column(0).slice(at, n))
                at += n
                if sum(map(len, ids)) >= block_ids:
                    yield flush()
        if sizes:
            yield flush()

    dealt.mapInArrow(run, f"shard int, block int, base long, n_ids long, docs array<{kind}>, data binary").write.parquet(to)


def blocks(spark: SparkSession, at: str) -> DataFrame:
    """The blocks at `at`, each with `start`: ids of all blocks before it."""
    rows = spark.read.parquet(at)
    shards = rows.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    starts = shards.select("shard", F.coalesce(before, F.lit(0)).alias("first"))
    # One row for each partition that was written.
    return rows.join(F.broadcast(starts), "shard").withColumn("start", F.col("first") + F.col("base")).drop("first")


def read(spark: SparkSession, at: str) -> DataFrame:
    """(doc, start, n_tokens, ids_crc32) of every document in the files, read from its packed ids."""
    ship(spark)
    rows = blocks(spark, at)
    kind = rows.schema["docs"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                block, docs = Block(b.column(2)[i].as_py()), b.column(1).slice(i, 1).flatten()
                sums = []
                for j in range(0, len(block), 4096):  # runs of documents, so that little is unpacked at once
                    k = min(j + 4096, len(block))
                    first = int(block.offsets[j])
                    ids = block.slice(first, int(block.offsets[k])).astype("<u4")
                    sums.extend(zlib.crc32(ids[a - first : c - first].tobytes()) for a, c in zip(block.offsets[j:k].tolist(), block.offsets[j + 1 : k + 1].tolist(), strict=True))
                start = block.offsets[:-1] + b.column(0)[i].as_py()
                yield pa.RecordBatch.from_arrays([docs, pa.array(start), pa.array(np.diff(block.offsets)), pa.array(sums, pa.int64())], ["doc", "start", "n_tokens", "ids_crc32"])

    return rows.select("start", "docs", "data").mapInArrow(run, f"doc {kind}, start long, n_tokens long, ids_crc32 long")
