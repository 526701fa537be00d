"""Token counts by a map-side lookup in two tiers, without any shuffle of pre-tokens.

The first tier is a compact table of frequent pre-tokens (sorted 64-bit hashes,
bytes and token counts) that is broadcast; what it misses is encoded by the
library once per worker and kept in the worker's cache, the second tier.

The table's pre-tokens are the most frequent ones of all documents: each task
counts its own in a table of bounded size, from which the rarest go when it is
full, and sends its most frequent ones only. The table decides what is looked
up where; counts are those of the library for every text, whatever it holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pretokens
from . import textscan as T
from .shared import ship

#: Entries of the broadcast table at most; those that a task sends at most; those that it counts before the rarest go.
TABLE, SENT, COUNTED = 1 << 16, 1 << 13, 1 << 18


class _Counter:
    """Counts of pre-tokens in a table of bounded size."""

    def __init__(self, most: int):
        self.most, self.keys, self.counts, self.pieces = most, np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, object)

    def add(self, keys: np.ndarray, counts: np.ndarray, pieces: np.ndarray) -> None:
        both = np.concatenate([self.keys, keys])
        self.keys, first, place = np.unique(both, return_index=True, return_inverse=True)
        self.counts = np.bincount(place, np.concatenate([self.counts, counts]), minlength=len(self.keys)).astype(np.int64)
        self.pieces = np.concatenate([self.pieces, pieces])[first]
        if len(self.keys) > self.most:
            self.cut(self.most // 2)

    def cut(self, most: int) -> None:
        top = np.sort(np.argsort(-self.counts, kind="stable")[:most])
        self.keys, self.counts, self.pieces = self.keys[top], self.counts[top], self.pieces[top]


def frequent(docs: DataFrame, path: str, text: str = "text", table: int = TABLE) -> T.Table:
    """The most frequent pre-tokens of all documents and their token counts."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, counter = pretokens.encoder(path, "counted").kinds, _Counter(COUNTED)
        for b in batches:
            for _, _, buf, offs in T.chunks(b.column(0)):
                p = pretokens.cut_pieces(buf, offs, kinds)
                # Long pieces are rare; the table needs none.
                short = np.flatnonzero(p.end - p.begin <= T.LONG_SLICE)
                raw = buf.tobytes()
                pieces = np.empty(len(short), object)
                pieces[:] = [raw[x:y] for x, y in zip(p.begin[short].tolist(), p.end[short].tolist(), strict=True)]
                counter.add(p.keys[short], np.bincount(p.inverse, minlength=len(p.keys))[short], pieces)
        counter.cut(SENT)
        yield pa.RecordBatch.from_arrays([pa.array(list(counter.pieces), pa.binary()), pa.array(counter.counts)], ["piece", "n"])

    found = docs.select(text).mapInArrow(run, "piece binary, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    pieces = [bytes(r.piece) for r in found.orderBy(F.desc("n"), "piece").limit(table).collect()]
    own = pretokens.encoder(path, "counted")
    return T.Table.of(pieces, np.array([len(x) for x in own.encode([p.decode() for p in pieces])], np.int64))


def count_tokens(docs: DataFrame, path: str, text: str = "text", table: int = TABLE, to: str = "n_tokens") -> DataFrame:
    """docs with n_bytes (UTF-8) and n_tokens of each text, as the tokenizers library counts them without added special tokens.

    Null counts as empty: 0 bytes, 0 tokens. Special strings inside texts are
    one token each, the library's default. Rows stay rows. Input columns of
    the added names are replaced.
    """
    spark = docs.sparkSession
    ship(spark)
    docs = docs.drop("n_bytes", to)
    names = docs.columns
    sent = spark.sparkContext.broadcast(frequent(docs, path, text, table))
    token = f"{spark.sparkContext.applicationId}-{sent._jbroadcast.id()}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, place = pretokens.encoder(path, token, sent.value), names.index(text)
        for b in batches:
            n = encoder.counts(b.column(place))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(n, pa.int64())], [*names, to])

    counted = docs.mapInArrow(run, docs.withColumn(to, F.lit(0).cast("long")).schema)
    return counted.withColumn("n_bytes", F.octet_length(F.coalesce(text, F.lit(""))).cast("long"))
