"""SimHash near-dedup by meet-in-the-middle ball hashing.

Every distinct fingerprint emits all variants within half the radius of it. Two
fingerprints within the radius share a variant, so a shuffle on variants brings
them together. At radius 2 a variant is shared by at most 65 distinct
fingerprints (those within one bit of it), which bounds every group whatever
the data; copies are one fingerprint and meet only as such. Within a group all
are linked to the smallest, after the distance is verified, so that as few
links as possible keep everything connected.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textscan as T
from .components import SALTS, components, with_least
from .shared import cut, ship

SEED = 42
SHINGLE = 3
RADIUS = 2


def _bit_counts(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """How many of the hashes of each text, n one after the other, have each of the 64 bits."""
    out = np.zeros((len(n), 64), np.int64)
    full = np.flatnonzero(n)
    if not len(full):
        return out
    # Runs of at most 255 hashes: the counts of eight bits, each in a byte of its own, are one sum.
    runs = -(-n[full] // 255)
    of = np.cumsum(runs) - runs
    begin = (np.cumsum(n) - n)[full]
    first = np.repeat(begin, runs) + (np.arange(runs.sum()) - np.repeat(of, runs)) * 255
    for k in range(8):
        sums = np.add.reduceat((h >> np.uint64(k)) & np.uint64(0x0101010101010101), first)
        out[full, k::8] = np.add.reduceat(sums.view(np.uint8).reshape(-1, 8).astype(np.int64), of, axis=0)
    return out


def _fingerprints(texts: pa.Array, size: int, seed: int) -> np.ndarray:
    """Fingerprints of whole texts as uint64."""
    out = [np.zeros(0, np.uint64)]
    for _, _, buf, offs in T.chunks(texts):
        low = T.LOWER[buf]
        starts, ends, place = T.words(low, offs, T.PLAIN_WORDS)
        # All words of the chunk again, with one space after each: a shingle is a slice of these bytes.
        sizes = ends - starts
        begin = np.cumsum(sizes + 1) - sizes - 1
        flat = np.full(int(sizes.sum()) + len(sizes), 0x20, np.uint8)
        flat[T.gather_ragged(begin, sizes)] = low[T.gather_ragged(starts, sizes)]
        n = place[1:] - place[:-1]
        width = np.minimum(size, n)
        shingles = np.where(n > 0, n - width + 1, 0)
        first = T.gather_ragged(place[:-1], shingles)
        last = first + np.repeat(width, shingles) - 1
        h = T.xxh64(flat, begin[first], begin[last] + sizes[last], seed)
        ones = _bit_counts(h, shingles)
        out.append(np.packbits(2 * ones > shingles[:, None], axis=1, bitorder="little").view(np.uint64)[:, 0])
    return np.concatenate(out)


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE, seed: int = SEED, keys: tuple[str, ...] = ()) -> DataFrame:
    """(doc, keys.., fp long): each row's 64-bit SimHash over shingles of `size` words, lower-cased A-Z.

    A text with fewer words is one shingle of all of them; null, empty and
    blank texts have fingerprint 0. Rows stay rows: repeated ones are repeated.
    keys: further columns that go with the id.
    """
    ship(docs.sparkSession)
    own = docs.select(F.col(doc_id).alias("doc"), *keys, F.col(text).alias("__text"))
    names = ["doc", *keys, "fp"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(_fingerprints(b.columns[-1], size, seed).view(np.int64))], names)

    return own.mapInArrow(run, own.withColumn("fp", F.lit(0).cast("long")).drop("__text").schema)


def ball(radius: int) -> list[int]:
    """Masks of at most radius bits, as signed 64-bit integers."""
    masks = [sum(1 << b for b in bits) for k in range(radius + 1) for bits in combinations(range(64), k)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): links between distinct fingerprints (column fp) at most `radius` bits apart, enough to connect all that are."""
    half = radius // 2
    # Each fingerprint becomes some 65 rows: so few that adaptive execution would leave them to one task are dealt to all.
    parts = max(1, int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # By a hash of it: dealt by the column itself, the distinct rows' own exchange would be taken instead, and made smaller.
    distinct = fps.select("fp").distinct().repartition(parts, F.xxhash64("fp"))
    if radius % 2:
        raise ValueError("the radius must be even, so that half of it is whole")
    masks = F.array(*[F.lit(m) for m in ball(half)])
    sent = distinct.select("fp", F.explode(F.transform(masks, lambda m: F.col("fp").bitwiseXOR(m))).alias("variant"))
    groups = sent.groupBy("variant").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)
    pairs = groups.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a < b").distinct()
    return pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)


def _salted(fps: DataFrame, by: str) -> DataFrame:
    return fps.withColumn("__salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))


def _least(fps: DataFrame, value, by: str, radius: int) -> DataFrame:
    """(fp, root, least, salts): each fingerprint with its component, the least value of its rows, and the salts that they have.

    Rows of one fingerprint are dealt to salts by the hash of column `by`, so
    that no task gathers the rows of a hot one.
    """
    members = cut(components(links(fps, radius)))  # (node, root)
    parts = _salted(fps, by).groupBy("fp", "__salt").agg(F.min(value).alias("least"))
    least = parts.groupBy("fp").agg(F.min("least").alias("least"), F.collect_set("__salt").alias("salts"))
    return least.join(members.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE, radius: int = RADIUS, seed: int = SEED) -> DataFrame:
    """(doc, fp long, component): for each row the smallest id that links of fingerprints reach.

    Rows with the same fingerprint are linked, fingerprint 0 (no words) as any
    other. Null ids are reached but never the smallest; a component of null
    ids only has a null component. An empty table gives an empty result.
    """
    fps = cut(fingerprints(docs, doc_id, text, size, seed))
    named = _least(fps, F.col("doc"), "doc", radius)
    labels = with_least(named, "root", "least", "fp", "component").select("fp", "component", F.explode("salts").alias("__salt"))
    return _salted(fps, "doc").join(labels, ["fp", "__salt"]).select("doc", "fp", "component")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE, radius: int = RADIUS, seed: int = SEED) -> DataFrame:
    """One row of each component, with the columns of docs: the one with the smallest id, of one id the one with the smallest hash of its text.

    Ids may repeat: rows with one id and unlike texts are rows of their own.
    Null ids come last. Of rows alike in id and text the one with the smallest
    hash of all its columns stays. An empty table gives an empty result.
    """
    names = docs.columns
    own = docs.select(F.struct(*[F.col(c) for c in names]).alias("__row"), F.col(doc_id).alias("__id"), F.col(text).alias("__text"))
    # 128 bits tell rows apart by id and text.
    own = own.withColumns({"__rk": F.xxhash64("__id", F.lit(seed), "__text"), "__tk": F.xxhash64("__text")})
    fps = cut(fingerprints(own, "__id", "__text", size, seed, ("__rk", "__tk")))
    row = F.struct(F.col("doc").isNull().alias("late"), "doc", "__tk", "__rk")
    named = _least(fps, row, "__rk", radius)
    kept = _salted(named, "fp").groupBy("root", "__salt").agg(F.min("least").alias("least")).groupBy("root").agg(F.min("least").alias("least"))
    kept = kept.select("least.__rk", "least.__tk")
    stay = own.select("__rk", "__tk", "__row").join(kept, ["__rk", "__tk"], "left_semi")
    return stay.groupBy("__rk", "__tk").agg(F.min_by("__row", F.xxhash64("__row")).alias("__row")).select("__row.*")
