"""Blocked Bloom filters over 64-bit hashes, built on the executors and broadcast within a fixed bound.

A block is 512 bits: eight words of 64, of which a key sets one bit each, so a
probe touches one cache line. The filter never gets larger than `max_bytes`;
with more keys than fit it lets more pass, which the exact join behind it
removes. Parts of the filter are built in parallel, one for each range of
blocks, and only the finished parts reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import ship

WORDS = 8
BITS_PER_KEY = 16
MAX_BYTES = 64 << 20
_PART_BLOCKS = 1 << 14  # 1 MB

#: Fixed odd multipliers, one for each word of a block.
_SALTS = np.array([0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D, 0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31], np.uint64)


def _block(h: np.ndarray, blocks: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)).astype(np.int64)


def _masks(h: np.ndarray) -> np.ndarray:
    low = (h & np.uint64(0xFFFFFFFF))[:, None] * _SALTS
    return np.uint64(1) << ((low >> np.uint64(26)) & np.uint64(63))


def insert(bits: np.ndarray, h: np.ndarray, blocks: int, first: int = 0) -> None:
    at = (_block(h, blocks) - first)[:, None] * WORDS + np.arange(WORDS)
    np.bitwise_or.at(bits, at.ravel(), _masks(h).ravel())


def probe(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether each hash may be in the filter."""
    blocks = len(bits) // WORDS
    masks = _masks(h)
    return ((bits.reshape(-1, WORDS)[_block(h, blocks)] & masks) == masks).all(axis=1)


def build(keys: DataFrame, column: str, max_bytes: int = MAX_BYTES) -> np.ndarray:
    """The filter of a column of distinct 64-bit hashes (long); null is left out. At most max_bytes large."""
    spark = keys.sparkSession
    ship(spark)
    keys = keys.select(F.col(column).alias("h")).where("h is not null")
    n = keys.count()
    blocks = max(1, min(n * BITS_PER_KEY // (64 * WORDS) + 1, max_bytes // (8 * WORDS)))
    parts = -(-blocks // _PART_BLOCKS)

    def part_of(h: np.ndarray) -> np.ndarray:
        return _block(h, blocks) // _PART_BLOCKS

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(part_of(h).astype(np.int32)), b.column(0)], ["part", "h"])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, np.ndarray] = {}
        for b in batches:
            h, part = b.column("h").to_numpy(zero_copy_only=False).view(np.uint64), b.column("part").to_numpy()
            for p in np.unique(part).tolist():
                if p not in made:
                    made[p] = np.zeros(min(_PART_BLOCKS, blocks - p * _PART_BLOCKS) * WORDS, np.uint64)
                insert(made[p], h[part == p], blocks, p * _PART_BLOCKS)
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(list(made), pa.int32()), pa.array([m.tobytes() for m in made.values()], pa.binary())], ["part", "bits"])

    dealt = keys.mapInArrow(deal, "part int, h long").repartition(parts, "part")
    bits = np.zeros(blocks * WORDS, np.uint64)
    for r in dealt.mapInArrow(fill, "part int, bits binary").toLocalIterator():
        at = r.part * _PART_BLOCKS * WORDS
        got = np.frombuffer(bytes(r.bits), np.uint64)
        bits[at : at + len(got)] |= got
    return bits
