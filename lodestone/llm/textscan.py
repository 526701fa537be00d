"""Vectorised scanning of Arrow text columns: no Python object is made for a document or a word.

A chunk is a run of whole documents seen as one array of UTF-8 bytes with the
documents' offsets. Words are found as runs of bytes of a class. Slices of the
chunk are hashed, and compared byte by byte, eight bytes of all of them at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
_SEED, _SIZE = U64(0x9E3779B97F4A7C15), U64(0xD6E8FEB86659FD93)
#: The lowest 0 to 8 bytes of a number.
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)
#: Bytes of a slice that is hashed with all others.
LONG_SLICE = 256

#: Bytes of a chunk; a longer document is a chunk of its own.
CHUNK_BYTES = 1 << 19


def byte_class(pattern_bytes) -> np.ndarray:
    """True for the bytes of a word; bytes over 0x7F always belong to words."""
    table = np.zeros(256, bool)
    table[128:] = True
    table[list(pattern_bytes)] = True
    return table


#: Words as runs of anything but space and U+0009 to U+000D.
PLAIN_WORDS = byte_class(b for b in range(128) if b != 0x20 and not 9 <= b <= 13)
#: Words as runs of digits, a-z (after lower-casing) and everything over U+007F.
ALNUM_WORDS = byte_class([*range(0x30, 0x3A), *range(0x61, 0x7B)])
#: Maps A-Z to a-z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finisher that spreads every bit."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U64(33))
    x = x * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


def _eights(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number, the first one lowest; zeros follow the end."""
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    return np.ndarray((len(buf) + 1,), "<u8", padded, strides=(1,))


def hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each slice of bytes, the same wherever it stands.

    Every eight bytes are mixed in one after the other, so slices of one size
    and up to eight bytes have the same hash only if they are equal. Slices over
    LONG_SLICE bytes, which would take a round of their own for each eight, are
    hashed by XXH3.
    """
    size = end - start
    out = mix(size.astype(U64) * _SIZE + _SEED)
    eights = _eights(buf)
    at, where = np.arange(len(size)), start.astype(np.int64)
    if len(size) and int(size.max()) > LONG_SLICE:
        import xxhash

        long = np.flatnonzero(size > LONG_SLICE)
        raw = memoryview(np.ascontiguousarray(buf))
        out[long] = [xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip(start[long].tolist(), end[long].tolist(), strict=True)]
        at = np.flatnonzero(size <= LONG_SLICE)
        where = where[at]
    left = size[at]
    while True:
        more = left > 0
        if not more.all():
            at, where, left = at[more], where[more], left[more]
        if not len(at):
            return out
        out[at] = mix(out[at] ^ (eights[where] & _MASKS[np.minimum(left, 8)]))
        where, left = where + 8, left - 8


#: The multipliers of XXH64.
_XXH = [U64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)]


def _turn(x: np.ndarray, bits: int) -> np.ndarray:
    return x << U64(bits) | x >> U64(64 - bits)


def _lane(x: np.ndarray, value: np.ndarray) -> np.ndarray:
    return _turn(x + value * _XXH[1], 31) * _XXH[0]


def xxh64(buf: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """XXH64 of each slice of bytes, a round of all of them at once; those over LONG_SLICE bytes by the library."""
    p1, p2, p3, p4, p5 = _XXH
    first, size, eights = U64(seed), end - start, _eights(buf)
    with np.errstate(over="ignore"):
        out = np.full(len(size), first + p5, U64)
        at = start.astype(np.int64)
        wide = np.flatnonzero((size >= 32) & (size <= LONG_SLICE))
        if len(wide):
            lanes = [np.full(len(wide), x, U64) for x in (first + p1 + p2, first + p2, first, first - p1)]
            go = np.arange(len(wide))
            while len(go):
                place = at[wide[go]]
                for i, v in enumerate(lanes):
                    v[go] = _lane(v[go], eights[place + 8 * i])
                at[wide[go]] += 32
                go = go[end[wide[go]] - at[wide[go]] >= 32]
            mixed = _turn(lanes[0], 1) + _turn(lanes[1], 7) + _turn(lanes[2], 12) + _turn(lanes[3], 18)
            for v in lanes:
                mixed = (mixed ^ _lane(U64(0), v)) * p1 + p4
            out[wide] = mixed
        out += size.astype(U64)
        go = np.flatnonzero((size >= 8) & (size <= LONG_SLICE))
        while len(go := go[end[go] - at[go] >= 8]):
            out[go] = _turn(out[go] ^ _lane(U64(0), eights[at[go]]), 27) * p1 + p4
            at[go] += 8
        go = np.flatnonzero((end - at >= 4) & (size <= LONG_SLICE))
        out[go] = _turn(out[go] ^ (eights[at[go]] & _MASKS[4]) * p1, 23) * p2 + p3
        at[go] += 4
        go = np.flatnonzero((end > at) & (size <= LONG_SLICE))
        while len(go):
            out[go] = _turn(out[go] ^ (eights[at[go]] & _MASKS[1]) * p5, 11) * p1
            at[go] += 1
            go = go[end[go] > at[go]]
        out = (out ^ out >> U64(33)) * p2
        out = (out ^ out >> U64(29)) * p3
        out ^= out >> U64(32)
    long = np.flatnonzero(size > LONG_SLICE)
    if len(long):
        import xxhash

        raw = memoryview(np.ascontiguousarray(buf))
        out[long] = [xxhash.xxh64_intdigest(raw[a:b], seed) for a, b in zip(start[long].tolist(), end[long].tolist(), strict=True)]
    return out


def same_hashed(a: np.ndarray, a_start: np.ndarray, b: np.ndarray, b_start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """`same` for slices of which the hashes and sizes are known to be equal: up to eight bytes they are."""
    out = np.ones(len(size), bool)
    long = np.flatnonzero(size > 8)
    out[long] = same(a, a_start[long], b, b_start[long], size[long])
    return out


def same(a: np.ndarray, a_start: np.ndarray, b: np.ndarray, b_start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether slices of two arrays of bytes are equal, byte by byte."""
    out = np.ones(len(size), bool)
    long = np.flatnonzero(size > LONG_SLICE)
    for i in long.tolist():
        out[i] = np.array_equal(a[a_start[i] : a_start[i] + size[i]], b[b_start[i] : b_start[i] + size[i]])
    at = np.flatnonzero(size <= LONG_SLICE) if len(long) else np.arange(len(size))
    x, y = _eights(a), _eights(b)
    p, q, left = a_start[at].astype(np.int64), b_start[at].astype(np.int64), size[at]
    while True:
        more = left > 0
        if not more.all():
            at, p, q, left = at[more], p[more], q[more], left[more]
        if not len(at):
            return out
        out[at] &= ((x[p] ^ y[q]) & _MASKS[np.minimum(left, 8)]) == 0
        p, q, left = p + 8, q + 8, left - 8


@dataclass
class Table:
    """Slices of bytes by their sorted hashes: where the bytes of each begin, how many they are, and its value."""

    keys: np.ndarray
    begin: np.ndarray
    size: np.ndarray
    values: np.ndarray
    text: np.ndarray

    @classmethod
    def of(cls, pieces: list[bytes], values: np.ndarray) -> "Table":
        """Of pieces with one hash the first is kept."""
        text = np.frombuffer(b"".join(pieces), np.uint8)
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        begin = np.cumsum(size) - size
        keys, first = np.unique(hashes(text, begin, begin + size), return_index=True)
        return cls(keys, begin[first], size[first], np.asarray(values, np.int64)[first], text)

    def find(self, keys: np.ndarray, buf: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For slices of buf: place in the table, whether the hash is there, and whether the bytes are too."""
        if not len(self.keys):
            none = np.zeros(len(keys), bool)
            return np.zeros(len(keys), np.int64), none, none
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        there = self.keys[at] == keys
        equal = there & (self.size[at] == end - begin)
        some = np.flatnonzero(equal)
        equal[some] = same_hashed(buf, begin[some], self.text, self.begin[at[some]], self.size[at[some]])
        return at, there, equal

    def joined(self, other: "Table") -> "Table":
        """Both; no hash is in both."""
        keys = np.concatenate([self.keys, other.keys])
        order = np.argsort(keys, kind="stable")
        own = (np.concatenate(x)[order] for x in ((self.begin, other.begin + len(self.text)), (self.size, other.size), (self.values, other.values)))
        return Table(keys[order], *own, np.concatenate([self.text, other.text]))


NO_TABLE = Table(np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3)), np.zeros(0, np.uint8))


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets of the documents in them); null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + limit, "right")) - 1)
        yield a, b, raw[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
        a = b


def words(buf: np.ndarray, offs: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for each document the place of its first word (and the total)."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    inside = table[buf]
    first = np.zeros(n + 1, bool)
    first[offs] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | first[1:n]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | first[1:n]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offs)


def lines(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same for lines split at \\n; an empty document has one empty line."""
    breaks = np.flatnonzero(buf == 10)
    owner = np.searchsorted(offs, breaks, "right") - 1
    counts = np.bincount(owner, minlength=len(offs) - 1) + 1
    place = np.concatenate([[0], np.cumsum(counts)])
    starts, ends = np.empty(place[-1], np.int64), np.empty(place[-1], np.int64)
    starts[place[:-1]] = offs[:-1]
    ends[place[1:] - 1] = offs[1:]
    inner = np.ones(place[-1], bool)
    inner[place[:-1]] = False
    starts[inner] = breaks + 1
    inner = np.ones(place[-1], bool)
    inner[place[1:] - 1] = False
    ends[inner] = breaks
    return starts, ends, place


def per_doc(values: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Sums of values by document."""
    sums = np.concatenate([[0], np.cumsum(values)])
    return sums[place[1:]] - sums[place[:-1]]


def chars(buf: np.ndarray) -> np.ndarray:
    """1 for the first byte of each code point."""
    return (buf & 0xC0) != 0x80


def gather_ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indexes start, start+1, .. of every slice, one slice after the other."""
    total = int(sizes.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(total)
