"""Byte-level BPE by pre-tokens: a vectorised splitter and tables of encoded pre-tokens.

A byte-level BPE tokenizer cuts a text into pre-tokens by a fixed pattern and
encodes each alone, so a text's ids are those of its pre-tokens. The splitter
finds the same cuts with array operations on code points. Each distinct
pre-token is encoded by the tokenizers library once per worker and kept in a
table under its 64-bit hash, with its bytes: first a fixed table that all
workers get, then the worker's own cache.

A hash only finds the place: what is found there is compared byte by byte.
Texts with a pre-token that differs from the one at its place, or that hold one
of the tokenizer's special strings, are given to the library whole.
"""

from __future__ import annotations

import os
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from . import textscan as T

#: The endings that the pattern cuts off after an apostrophe.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
#: Entries of a worker's cache; when it is full it begins anew.
CACHE_ENTRIES = 600_000
#: Pre-tokens that the library gets as one sequence.
SEQUENCE = 2000

SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3


class Kinds:
    """The class of each code point, white space, letter, number or other, as the library's own splitter has it.

    Libraries differ in the version of Unicode, so each code point is asked
    for once, when a text first holds it.
    """

    def __init__(self, splitter):
        self.pieces = lambda text: len(splitter.pre_tokenize_str(text))
        self.table, self.known = np.full(0x110000, OTHER, np.uint8), np.zeros(0x110000, bool)

    def __call__(self, points: np.ndarray) -> np.ndarray:
        new = points[~self.known[points]]
        for c in np.unique(new).tolist():
            x = chr(c)
            kind = LETTER if self.pieces(f"a{x}b") == 1 else NUMBER if self.pieces(f"1{x}2") == 1 else OTHER if self.pieces(f"!{x}!") == 1 else SPACE
            self.table[c], self.known[c] = kind, True
        return self.table[points]


def split(points: np.ndarray, offs: np.ndarray, kinds: Kinds) -> np.ndarray:
    """Starts of the pre-tokens in an array of code points; offs: starts of the documents, and the end."""
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    kind = kinds(points)
    first = np.zeros(n + 1, bool)
    first[offs] = True
    first, last = first[:n], first[1:]  # of a document
    start = first.copy()
    start[1:] |= kind[1:] != kind[:-1]
    space = kind == SPACE
    # The last of some white space before something else: a pre-token alone, or the lead of what follows if it is U+0020.
    lead = space & ~last
    lead[:-1] &= ~space[1:]
    lead[-1] = False
    start |= lead
    joined = np.zeros(n, bool)
    joined[1:] = (lead & (points == 0x20))[:-1]
    start &= ~joined
    # An apostrophe that begins a pre-token takes one of the endings, and what follows begins anew.
    mark = np.flatnonzero(start & (points == 0x27) & ~last)
    if len(mark):
        pad = np.concatenate([points, np.zeros(3, points.dtype)])
        room = offs[np.searchsorted(offs, mark, "right")] - mark
        for ending in ENDINGS:
            fits = room > len(ending)
            for k, c in enumerate(ending, 1):
                fits &= pad[mark + k] == ord(c)
            at = mark[fits]
            start[at + 1] = False
            after = at + 1 + len(ending)
            inner = after[after < n]
            # Letters go on: a new pre-token; any other class begins anew by itself.
            start[inner] |= ~joined[inner] & ~first[inner] & (kind[inner] == LETTER) | first[inner]
    return np.flatnonzero(start)


@dataclass
class Pieces:
    """The distinct hashes of a chunk's pre-tokens: an example of each, the pre-tokens by document, and which differ from their example."""

    keys: np.ndarray
    inverse: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    place: np.ndarray
    unlike: np.ndarray

    def documents(self, wrong: np.ndarray) -> np.ndarray:
        """Documents with a pre-token that is not the one found under its hash."""
        return T.per_doc(self.unlike | wrong[self.inverse], self.place) > 0


def cut_pieces(buf: np.ndarray, offs: np.ndarray, kinds: Kinds) -> Pieces:
    whole = buf.tobytes().decode("utf-8")
    points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
    lead = np.flatnonzero(T.chars(buf))  # where each code point begins
    starts = split(points, np.searchsorted(lead, offs), kinds)
    at = lead[starts] if len(starts) else np.zeros(0, np.int64)
    ends = np.append(at[1:], len(buf)) if len(at) else at
    keys, example, inverse = np.unique(T.hashes(buf, at, ends), return_index=True, return_inverse=True)
    size, of = ends - at, example[inverse]
    unlike = size != size[of]
    equal = np.flatnonzero(~unlike)
    unlike[equal] = ~T.same_hashed(buf, at[equal], buf, at[of[equal]], size[equal])
    return Pieces(keys, inverse, at[example], ends[example], np.searchsorted(at, offs), unlike)


class Encoder:
    """Counts or ids of whole texts, as the tokenizers library gives them."""

    def __init__(self, path: str, fixed: T.Table = T.NO_TABLE, entries: int = CACHE_ENTRIES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.library, self.entries = Tokenizer.from_file(path), entries
        self.cutter = self.plain = self.library.pre_tokenizer
        self.kinds = Kinds(self.cutter)
        if isinstance(self.cutter, ByteLevel) and not self.cutter.add_prefix_space:
            self.plain = ByteLevel(add_prefix_space=False, use_regex=False)  # for what is cut already
        added = {i: t.content.encode() for i, t in self.library.get_added_tokens_decoder().items()}
        self.special = list(added.values())
        # A byte-level token has a character for each of its bytes.
        held = {i: len(t) for t, i in self.library.get_vocab().items()} | {i: len(t) for i, t in added.items()}
        self.held = np.zeros(max(held, default=0) + 1, np.int64)
        self.held[list(held)] = list(held.values())
        self.fixed = fixed
        self.clear()

    def clear(self) -> None:
        """The cache: two tables of entries' numbers, of which the second one is small and takes new ones; each entry's count, where its ids begin, and all ids."""
        self.tables = [T.NO_TABLE, T.NO_TABLE]
        self.sizes, self.first, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch(texts, add_special_tokens=False)]

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pre-tokens, one after the other, and how many each has.

        They are given to the library as the words of a few long sequences,
        and not cut again. A piece's ids are those that stand for its bytes; if
        the bytes of the ids don't end with each piece, every piece is encoded alone.
        """
        words = [p.decode() for p in pieces]
        self.library.pre_tokenizer = self.plain
        try:
            runs = self.library.encode_batch_fast([words[i : i + SEQUENCE] for i in range(0, len(words), SEQUENCE)], is_pretokenized=True, add_special_tokens=False)
        finally:
            self.library.pre_tokenizer = self.cutter
        ids = np.concatenate([np.zeros(0, np.uint32), *(np.array(r.ids, np.uint32) for r in runs)])
        ends, wanted = np.cumsum(self.held[ids]), np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
        last = np.searchsorted(ends, wanted)
        if len(ends) and ends[-1] == wanted[-1] and (ends[last] == wanted).all():
            return ids, np.diff(last, prepend=-1)
        alone = self.encode(words)
        return np.array([i for x in alone for i in x], np.uint32), np.fromiter(map(len, alone), np.int64, len(alone))

    def learn(self, pieces: list[bytes]) -> None:
        """Encode pre-tokens whose hashes are new, and add them to the cache."""
        ids, sizes = self.encode_pieces(pieces)
        entries = np.arange(len(self.sizes), len(self.sizes) + len(sizes))
        self.first = np.concatenate([self.first, len(self.ids) + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.ids = np.concatenate([self.ids, ids])
        large, small = self.tables[0], self.tables[1].joined(T.Table.of(pieces, entries))
        if len(small.keys) > max(1 << 14, len(large.keys) // 8):
            large, small = large.joined(small), T.NO_TABLE
        self.tables = [large, small]

    def _cached(self, keys: np.ndarray, buf: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The entry of each key in the cache, after learning what is missing, and whether the bytes there are its own."""

        def found() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            entry, right, there = np.zeros(len(keys), np.int64), np.zeros(len(keys), bool), np.zeros(len(keys), bool)
            for table in self.tables:
                rest = np.flatnonzero(~there)
                at, known, equal = table.find(keys[rest], buf, begin[rest], end[rest])
                rest, at, equal = rest[known], at[known], equal[known]
                if len(rest):
                    entry[rest], right[rest], there[rest] = table.values[at], equal, True
            return entry, right, there

        entry, right, there = found()
        if not there.all():
            new = np.flatnonzero(~there)
            if len(self.sizes) + len(new) > self.entries:
                self.clear()
                new = np.arange(len(keys))
            text = buf.tobytes()
            self.learn([text[a:b] for a, b in zip(begin[new].tolist(), end[new].tolist(), strict=True)])
            entry, right, there = found()
        return entry, right

    def _special(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Documents that hold a special string."""
        out, text = np.zeros(len(offs) - 1, bool), buf.tobytes()
        for s in self.special:
            at = text.find(s)
            while at >= 0:
                out[np.searchsorted(offs, at, "right") - 1] = True
                at = text.find(s, at + 1)
        return out

    def _whole(self, buf: np.ndarray, offs: np.ndarray, pieces: Pieces, wrong: np.ndarray) -> dict[int, list[int]]:
        """The ids of documents that the library must encode whole."""
        which = np.flatnonzero(self._special(buf, offs) | pieces.documents(wrong))
        return {d: self.encode([buf[offs[d] : offs[d + 1]].tobytes().decode()])[0] for d in which.tolist()}

    def counts(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text."""
        out = [np.zeros(0, np.int64)]
        for _, _, buf, offs in T.chunks(texts):
            p = cut_pieces(buf, offs, self.kinds)
            at, _, equal = self.fixed.find(p.keys, buf, p.begin, p.end)
            sizes, wrong = np.zeros(len(p.keys), np.int64), np.zeros(len(p.keys), bool)
            if equal.any():
                sizes[equal] = self.fixed.values[at[equal]]
            miss = np.flatnonzero(~equal)
            if len(miss):
                own, right = self._cached(p.keys[miss], buf, p.begin[miss], p.end[miss])
                sizes[miss], wrong[miss] = self.sizes[own], ~right
            got = T.per_doc(sizes[p.inverse], p.place)
            for d, ids in self._whole(buf, offs, p, wrong).items():
                got[d] = len(ids)
            out.append(got)
        return np.concatenate(out)

    def ids_of(self, texts: pa.Array):
        """(ids as uint32, offsets) of runs of texts, in their order."""
        for _, _, buf, offs in T.chunks(texts):
            p = cut_pieces(buf, offs, self.kinds)
            own, right = self._cached(p.keys, buf, p.begin, p.end) if len(p.keys) else (p.inverse, np.zeros(0, bool))
            at = own[p.inverse]
            size = self.sizes[at]
            ids = self.ids[T.gather_ragged(self.first[at], size)]
            got = np.concatenate([[0], np.cumsum(T.per_doc(size, p.place))])
            whole = self._whole(buf, offs, p, ~right)
            if whole:
                rows = [ids[a:b] for a, b in zip(got[:-1], got[1:], strict=True)]
                for d, x in whole.items():
                    rows[d] = np.array(x, np.uint32)
                ids, got = np.concatenate(rows), np.concatenate([[0], np.cumsum([len(r) for r in rows])])
            yield ids, got


_encoders: dict[tuple, Encoder] = {}


def encoder(path: str, token: object = None, fixed: T.Table = T.NO_TABLE) -> Encoder:
    """The process's encoder of this file, with its cache; token names the fixed table."""
    if (path, token) not in _encoders:
        _encoders.clear()
        _encoders[path, token] = Encoder(path, fixed)
    return _encoders[path, token]
