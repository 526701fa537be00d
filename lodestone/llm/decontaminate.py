"""Benchmark decontamination with one Aho-Corasick automaton over the normalised test items.

The automaton's alphabet is the benchmark's words: its vocabulary is numbered,
and each window of words is a sequence of numbers. A document's words are
found and hashed in one vectorised scan, their numbers looked up by hash and
compared byte by byte, and the automaton reads the numbers once. Words that no item has get number 0,
which no window holds; only documents with a long enough run of known words
are given to the automaton at all, as no other can hold a window. Each word
keeps its place in the bytes, so hits are mapped back to the original text.

The items are read to the driver: a benchmark is small. `max_words` bounds what
one automaton may hold; a larger benchmark is dealt with in several automata,
one pass each over the numbers.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textscan as T
from .shared import ship

WINDOW = 13
#: Words of all windows that one automaton holds at most (some 100 MB).
MAX_WORDS = 2_000_000
#: Bytes of benchmark text that the driver reads at most.
MAX_BYTES = 256 << 20

KIND = "struct<n_words:bigint,items:array<string>,hits:array<struct<word:int,end_word:int,start:int,end:int>>>"


def _word_hashes(texts: pa.Array):
    for _, _, buf, offs in T.chunks(texts):
        low = T.LOWER[buf]
        starts, ends, place = T.words(low, offs, T.ALNUM_WORDS)
        yield buf, low, offs, starts, ends, place, T.hashes(low, starts, ends)


def windows(items: list[tuple[str, str | None]], window: int = WINDOW) -> tuple[T.Table, dict[tuple[int, ...], list[str]]]:
    """The vocabulary, and each window (places in it, from 1) with the ids of its items."""
    texts = pa.array([t or "" for _, t in items], pa.string())
    rows: list[list[bytes]] = []
    for _, low, _, starts, ends, place, _ in _word_hashes(texts):
        raw = low.tobytes()
        own = [raw[x:y] for x, y in zip(starts.tolist(), ends.tolist(), strict=True)]
        rows.extend(own[x:y] for x, y in zip(place[:-1].tolist(), place[1:].tolist(), strict=True))
    every = sorted({w for r in rows for w in r})
    vocabulary = T.Table.of(every, np.arange(len(every)))
    if len(vocabulary.keys) < len(every):
        raise ValueError("two words of the benchmark have the same hash")
    number = np.empty(len(every), np.int64)
    number[vocabulary.values] = np.arange(1, len(every) + 1)
    numbers = dict(zip(every, number.tolist(), strict=True))
    found: dict[tuple[int, ...], set[str]] = defaultdict(set)
    for (item, _), r in zip(items, rows, strict=True):
        ids = tuple(numbers[w] for w in r)
        for i in range(max(0, len(ids) - window) + 1 if ids else 0):
            found[ids[i : i + window]].add(item)
    return vocabulary, {k: sorted(v) for k, v in found.items()}


def _automata(found: dict[tuple[int, ...], list[str]], max_words: int):
    import ahocorasick

    made, held = [], max_words
    for key, ids in found.items():
        if held + len(key) > max_words:
            made.append(ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE))
            held = 0
        made[-1].add_word(key, (len(key), ids))
        held += len(key)
    for m in made:
        m.make_automaton()
    return made


_built: dict[int, list] = {}


def _scan(batch: pa.RecordBatch, vocabulary: T.Table, automata: list, shortest: int) -> pa.RecordBatch:
    n_words, items, hits = [], [], []
    for buf, low, offs, starts, ends, place, h in _word_hashes(batch.column(0)):
        count = place[1:] - place[:-1]
        at, _, equal = vocabulary.find(h, low, starts, ends)
        ids = np.where(equal, at + 1, 0)
        # Runs of known words inside one document that are long enough to hold a window.
        known = np.concatenate([[False], ids > 0, [False]])
        cuts = np.zeros(len(ids) + 1, bool)
        cuts[place] = True
        begin = np.flatnonzero(known[1:-1] & (~known[:-2] | cuts[:-1]))
        stop = np.flatnonzero(known[1:-1] & (~known[2:] | cuts[1:])) + 1
        long_enough = stop - begin >= shortest
        begin, stop = begin[long_enough], stop[long_enough]
        owner = np.searchsorted(place, begin, "right") - 1
        got: dict[int, tuple[set[str], list[tuple[int, int]]]] = {}
        for d, a, b in zip(owner.tolist(), begin.tolist(), stop.tolist(), strict=True):
            seq = tuple(ids[a:b].tolist())
            for automaton in automata:
                for last, (size, named) in automaton.iter(seq):
                    own = got.setdefault(d, (set(), []))
                    own[0].update(named)
                    own[1].append((a + last - size + 1, a + last + 1))
        n_words.extend(count.tolist())
        lead = np.concatenate([[0], np.cumsum(T.chars(buf))]) if got else None
        for d in range(len(count)):
            if d not in got:
                items.append([])
                hits.append([])
                continue
            items.append(sorted(got[d][0]))
            spans: list[list[int]] = []
            for a, b in sorted(got[d][1]):
                if spans and a <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], b)
                else:
                    spans.append([a, b])
            first, zero = place[d], lead[offs[d]]
            hits.append([{"word": int(a - first), "end_word": int(b - first), "start": int(lead[starts[a]] - zero), "end": int(lead[ends[b - 1]] - zero)} for a, b in spans])
    span = pa.struct([("word", pa.int32()), ("end_word", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])
    return pa.RecordBatch.from_arrays([pa.array(n_words, pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(hits, pa.list_(span))], ["n_words", "items", "hits"])


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text: str = "text", item_id: str = "item_id", item_text: str = "text", max_words: int = MAX_WORDS) -> DataFrame:
    """docs with one column `scan`: n_words, items (sorted ids whose windows occur), hits (spans of hit words).

    A span has its first word and the word after its last, and the characters
    they take in the original text. Overlapping windows make one span. Words
    are runs of digits, letters a-z after lower-casing and all code points
    over U+007F. An item with fewer than `window` words, but not none, is one
    window. Null texts have no words; items with a null id are left out;
    repeated items count once. Empty tables are allowed on both sides.
    """
    spark = docs.sparkSession
    ship(spark)
    b = benchmark.where(F.col(item_id).isNotNull()).select(F.col(item_id).cast("string").alias("i"), F.coalesce(F.col(item_text), F.lit("")).alias("t")).distinct()
    size = b.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    if size > MAX_BYTES:
        raise ValueError(f"the benchmark has {size} bytes of text; scan it in parts of {MAX_BYTES} at most")
    vocabulary, found = windows([(r.i, r.t) for r in b.collect()], window)
    shortest = min(map(len, found), default=1)
    sent = spark.sparkContext.broadcast((vocabulary, found))
    key = sent._jbroadcast.id()
    docs = docs.drop("scan")
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, found = sent.value
        if key not in _built:
            _built.clear()
            _built[key] = _automata(found, max_words)
        place = names.index(text)
        for batch in batches:
            done = _scan(batch.select([place]), vocabulary, _built[key], shortest)
            scan = pa.StructArray.from_arrays(done.columns, fields=list(done.schema))
            yield pa.RecordBatch.from_arrays([*batch.columns, scan], [*names, "scan"])

    return docs.mapInArrow(run, docs.withColumn("scan", F.lit(None).cast(KIND)).schema)


def verdicts(scanned: DataFrame, share: int = 20) -> DataFrame:
    """scanned with n_words, n_hit, n_items and contaminated: at least 1 / share of the words are hit."""
    hit = F.aggregate("scan.hits", F.lit(0).cast("long"), lambda s, x: s + x["end_word"] - x["word"])
    out = scanned.withColumns({"n_words": F.col("scan.n_words"), "n_hit": hit, "n_items": F.size("scan.items").cast("long")})
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (F.lit(share) * F.col("n_hit") >= F.col("n_words")))
