"""Substring dedup: passages of 50 words or more that repeat, exactly or nearly, in other documents.

A text's tokens are its 5-word shingles. For each hash function the compact
windows of a text are the nodes of the Cartesian tree over its shingles'
hashes that span at least `width` shingles: (left, minimum, right). A run-length
encoding of the sliding minimum gives just those nodes, cut to what lies within
`width` - 1 of the minimum: every run of `width` shingles has its min-hash in
one of them. Two runs of similarity s have the same min-hash under a function
with probability s, and then lie in windows of one key, which is the function
and the min-hash: at 0.8 one of three functions finds them with probability 0.992.

1. Each window emits (key, content hash, document, place), without its marks.
   Keys are hashes, so these small rows are partitioned by even ranges of keys;
   keys that a third of all documents may hold, which a sample of documents shows,
   are spread over all partitions instead. Sorted rows stream by: equal windows
   are links to the first one, and of the others one row each is left.
2. Only windows of a key with different ones of other documents need their
   16-bit marks: they are listed by document and cut from the document's marks
   by a join. No list of keys is sent to the executors.
3. A key's different windows meet in one task, if they are GROUP at most, and
   interval joins find those alike (see `alike`): first a few rounds, which link
   almost all; then, with the classes of documents known, the rest, for keys whose
   windows are not of one class.
   A key of more windows is dealt anew by the rarest marks: alike windows share
   one of their prefix's marks, so each (key, mark) is a key of its own. What is
   still larger is dealt into buckets, and each pair of buckets is one key.
4. Links between documents give classes by connected components; spans of a
   document are joined where they touch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import alike
from . import textscan as T
from .components import components, with_least
from .shared import cut, release, ship

SHINGLE = 5
MIN_WORDS = 50
SIMILARITY = 0.8
HASHES = 3
#: Different windows of one key that one task compares at most.
GROUP = 20_000
#: One document of so many is asked for hot keys: those of at least HOT of a partition's rows.
SAMPLED, HOT = 64, 0.5
#: Windows that are compared in one go, about.
BATCH = 20_000
#: Rounds of the first comparison.
ROUNDS = 2

_SEEDS = np.array([0x9AE16A3B2F90404F, 0xC949C7DEFEADBEEF, 0x8C2F5E1D3B4A6977, 0xD1B54A32D192ED03], np.uint64)


def _windows(h: np.ndarray, place: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(left, minimum, right) of the compact windows of at least `width` shingles; place: first shingle of each document.

    Windows reach width - 1 to either side of the minimum at most. Equal
    hashes: the left one counts as smaller.
    """
    n = len(h)
    empty = np.zeros(0, np.int64)
    if n < width:
        return empty, empty, empty
    # Minimum of each run of `width` with its place, by doubling: 40 bits of the hash, and the place, in one number.
    if n <= 1 << 24:
        low, size = (h >> np.uint64(24) << np.uint64(24)) | np.arange(n, dtype=np.uint64), 1
        while size < width:
            step = min(size, width - size)
            low = np.minimum(low[: len(low) - step], low[step:])
            size += step
        least = (low & np.uint64((1 << 24) - 1)).astype(np.int64)
    else:  # a very long text
        low, least, size = h >> np.uint64(24), np.arange(n), 1
        while size < width:
            step = min(size, width - size)
            later = low[step:] < low[: len(low) - step]
            low, least = np.where(later, low[step:], low[: len(low) - step]), np.where(later, least[step:], least[: len(least) - step])
            size += step
    # Runs within one document only.
    ends = np.repeat(place[1:], place[1:] - place[:-1])
    inside = np.arange(len(least)) + width <= ends[: len(least)]
    at = np.where(inside, least, -1)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    last = np.append(first[1:], len(at)) - 1
    keep = at[first] >= 0
    first, last = first[keep], last[keep]
    return first, at[first], last + width - 1


def _shingles(texts: pa.Array):
    """For runs of texts: first row, hashes of all shingles, and the first shingle of each document."""
    for row, _, buf, offs in T.chunks(texts):
        low = T.LOWER[buf]
        starts, ends, place = T.words(low, offs, T.PLAIN_WORDS)
        words = T.hashes(low, starts, ends)
        n = place[1:] - place[:-1]
        m = np.maximum(n - SHINGLE + 1, 0)
        if len(words) < SHINGLE:
            yield row, np.zeros(0, np.uint64), np.zeros(len(n) + 1, np.int64)
            continue
        h = T.mix(words[: len(words) - SHINGLE + 1])
        for k in range(1, SHINGLE):
            h = T.mix(h + words[k : len(words) - SHINGLE + 1 + k])
        at = T.gather_ragged(place[:-1], m)
        yield row, h[at], np.concatenate([[0], np.cumsum(m)])


def _places(h: np.ndarray, place: np.ndarray, width: int, hashes: int):
    """For each hash function: (key, content hash, minimum, left, right) of every window."""
    marks = _marks(h).view(np.uint8)
    for m in range(hashes):
        left, at, right = _windows(T.mix(h ^ _SEEDS[m]), place, width)
        if len(at):
            yield T.mix(h[at] + np.uint64(m)), _content(marks, 2 * left, 2 * (right + 1), at - left), at, left, right


def _marks(h: np.ndarray) -> np.ndarray:
    """16 bits of each shingle's hash; 0 stands for none."""
    return np.maximum((h >> np.uint64(48)).astype("<u2"), 1)


def _batch(schema: str, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], [x.split()[0] for x in schema.split(", ")])


#: place: the minimum's shingle, and how many shingles the window has before and after it, in 7 bits each.
_PLACE = "key long, sig long, doc long, place long"


def _emit(docs: DataFrame, width: int, hashes: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            for row, h, place in _shingles(b.column(1)):
                for key, sig, at, left, right in _places(h, place, width, hashes):
                    doc = np.searchsorted(place, at, "right") - 1
                    yield _batch(_PLACE, key.view(np.int64), sig.view(np.int64), ids[row + doc], (at - place[doc]) << 14 | (at - left) << 7 | right - at)

    return docs.mapInArrow(run, _PLACE)


def _parts(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place of the minimum, first shingle, and shingles of a window."""
    at, back, ahead = place >> 14, place >> 7 & 127, place & 127
    return at, at - back, back + ahead + 1


def _hot(docs: DataFrame, width: int, hashes: int, parts: int) -> list[int]:
    """Keys that have HOT of an even partition's rows or more, as far as a sample of documents shows: some parts / HOT at most."""
    sample = _emit(docs.where(F.pmod(F.xxhash64("doc"), F.lit(SAMPLED)) == 0), width, hashes).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    # A key of a few rows in the sample may be there by chance.
    sample = cut(sample.withColumn("of", F.lit(0)))
    every = sample.agg(F.sum("n")).first()[0] or 0
    least = max(16, HOT * every / parts)
    return [r.key for r in sample.where(F.col("n") >= least).select("key").collect()]


#: kind 0: a link; kind 1: a different window of a key, of `n`; kind 2: the first of equal windows of a hot key's part.
_STREAMED = "kind int, doc long, other long, a int, b int, size int, key long, sig long, place long, n int"


def _stream(batches: Iterator[pa.RecordBatch], hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key and sig: links among equal windows, and a row of each of a key's different ones.

    Keys of one document, or of one content, are left out, but for hot keys,
    which have rows in other partitions.
    """
    names = [x.split()[0] for x in _PLACE.split(", ")]
    held: dict[str, np.ndarray] | None = None  # the different windows of the last key

    def heads(r: dict[str, np.ndarray], which: np.ndarray) -> Iterator[pa.RecordBatch]:
        """which: the different windows, in order of their keys, of whole keys."""
        if not len(which):
            return
        own = {k: v[which] for k, v in r.items()}
        new = np.ones(len(which), bool)
        new[1:] = own["key"][1:] != own["key"][:-1]
        starts, of = np.flatnonzero(new), np.cumsum(new) - 1
        n = np.bincount(of)
        several = (np.minimum.reduceat(own["doc"], starts) < np.maximum.reduceat(own["doc"], starts))[of]
        is_hot = np.isin(own["key"], hot)
        out = np.flatnonzero(is_hot | several)
        k, no = len(out), pa.nulls(len(out), pa.int32())
        if k:
            yield _batch(_STREAMED, np.where(is_hot[out], 2, 1).astype(np.int32), own["doc"][out], pa.nulls(k, pa.int64()), no, no, no, own["key"][out], own["sig"][out], own["place"][out], n[of][out].astype(np.int32))

    for batch in batches:
        if not batch.num_rows:
            continue
        r = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in names}
        if held is not None:
            r = {n: np.concatenate([held[n], r[n]]) for n in names}
        n = len(r["key"])
        head = np.ones(n, bool)
        head[1:] = (r["key"][1:] != r["key"][:-1]) | (r["sig"][1:] != r["sig"][:-1])
        of_run = np.maximum.accumulate(np.where(head, np.arange(n), 0))
        copies = np.flatnonzero(~head)
        copies = copies[r["doc"][copies] != r["doc"][of_run[copies]]]
        if len(copies):
            x, k = of_run[copies], len(copies)
            (_, a, size), (_, b, _) = _parts(r["place"][x]), _parts(r["place"][copies])
            no = pa.nulls(k, pa.int64())
            yield _batch(_STREAMED, np.zeros(k, np.int32), r["doc"][x], r["doc"][copies], a.astype(np.int32), b.astype(np.int32), size.astype(np.int32), no, no, no, pa.nulls(k, pa.int32()))
        last = r["key"] == r["key"][-1]
        yield from heads(r, np.flatnonzero(head & ~last))
        left = np.flatnonzero(head & last)
        held = {k: v[left] for k, v in r.items()}
    if held is not None:
        yield from heads(held, np.arange(len(held["key"])))


def _marked(docs: DataFrame, different: DataFrame, width: int) -> DataFrame:
    """The windows of `different` (key, sig, doc, place) with their marks, cut from the marks of their documents."""

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, h, place in _shingles(b.column(1)):
                size = place[1:] - place[:-1]
                long = np.flatnonzero(size >= width)
                if len(long):
                    own = _marks(h)[T.gather_ragged(place[:-1][long], size[long])]
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row + long)), _binary(own, size[long])], ["doc", "own"])

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(2)
            flat, count = lists.flatten(), lists.value_lengths().to_numpy(zero_copy_only=False)
            if not len(flat):
                continue
            key, sig, place = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(3))
            start, length, every = _slices(b.column(1))
            row = np.repeat(np.arange(b.num_rows), count)
            at, first, size = _parts(place)
            # Of several rows with one id the right one has this content.
            inside = np.flatnonzero((first + size) <= length[row] // 2)
            row, key, sig, at, first, size = (v[inside] for v in (row, key, sig, at, first, size))
            begin = start[row] + 2 * first
            right = _content(every, begin, begin + 2 * size, at - first) == sig.view(np.uint64)
            row, key, sig, at, first, size, begin = (v[right] for v in (row, key, sig, at, first, size, begin))
            doc = b.column(0).to_numpy(zero_copy_only=False)[row]
            packed = _binary(every[T.gather_ragged(begin, 2 * size)].view("<u2"), size)
            yield _batch(_ROW, key, sig, doc, doc, at.astype(np.int32), first.astype(np.int32), packed)

    lists = different.groupBy("doc").agg(F.collect_list(F.struct("key", "sig", "place")).alias("wanted"))
    return docs.mapInArrow(marks, "doc long, own binary").join(lists, "doc").select("doc", "own", "wanted").mapInArrow(windows, _ROW)


def _content(marks: np.ndarray, start: np.ndarray, end: np.ndarray, back: np.ndarray) -> np.ndarray:
    """The content hash of windows in an array of marks' bytes."""
    return T.mix(T.hashes(marks, start, end) + back.astype(np.uint64))


def _slices(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each binary value begins and its length, and the bytes of all."""
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return offs[:-1], offs[1:] - offs[:-1], np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)


def _binary(marks: np.ndarray, size: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(2 * size)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(marks, "<u2"))])


_ROW = "key long, sig long, doc long, label long, at int, first int, marks binary"


def _matrix(b: pa.RecordBatch, width: int) -> np.ndarray:
    start, length, every = _slices(b.column("marks"))
    at, first = (b.column(n).to_numpy(zero_copy_only=False) for n in ("at", "first"))
    return alike.matrix(at, first, length // 2, start // 2, every[: len(every) // 2 * 2].view("<u2"), width)


#: A link of two windows, and the row of a window that may have more.
_FOUND = "kind int, doc long, other long, a int, b int, size int, size_other int, key long, sig long, sig_other long, label long, at int, first int, marks binary"


def _compare(rows: pa.RecordBatch, width: int, similarity: float, rounds: int | None) -> Iterator[pa.RecordBatch]:
    r = {n: rows.column(n).to_numpy(zero_copy_only=False) for n in ("key", "sig", "doc", "label", "at", "first")}
    new = np.ones(len(r["key"]), bool)
    new[1:] = r["key"][1:] != r["key"][:-1]
    found, open_rows = alike.links(np.cumsum(new) - 1, r["label"], _matrix(rows, width), width, similarity, rounds)
    if n := len(found):
        x, y, a, b, size, size_other = found.T
        # Column width - 1 is the minimum.
        a, b = r["at"][x] + a - width + 1, r["at"][y] + b - width + 1
        no = [pa.nulls(n, k) for k in (pa.int64(), pa.int32(), pa.int32(), pa.binary())]
        yield _batch(_FOUND, np.zeros(n, np.int32), r["doc"][x], r["doc"][y], *(np.asarray(v).astype(np.int32) for v in (a, b, size, size_other)), r["key"][x], r["sig"][x], r["sig"][y], *no)
    if n := len(open_rows):
        own = rows.take(pa.array(open_rows))
        no = [pa.nulls(n, k) for k in (pa.int64(), *[pa.int32()] * 4)]
        yield _batch(_FOUND, np.ones(n, np.int32), own.column("doc"), *no, own.column("key"), own.column("sig"), pa.nulls(n, pa.int64()), own.column("label"), own.column("at"), own.column("first"), own.column("marks"))


def _compared(rows: DataFrame, width: int, similarity: float, rounds: int | None) -> DataFrame:
    """rows dealt by key, and the keys of each partition compared, some BATCH rows at once.

    Rows that a join has dealt by `key` already would not be dealt again, and the
    join's small partitions are put together to a few: almost all the work, which
    is large for few bytes, then is one task's. So they are dealt by a hash of it.
    """
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    names = [x.split()[0] for x in _ROW.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def whole() -> pa.RecordBatch:
            return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            if sum(x.num_rows for x in held) >= BATCH:
                every = whole()
                key = every.column("key").to_numpy(zero_copy_only=False)
                n = int(np.searchsorted(key, key[-1]))  # the last key may go on
                if n:
                    yield from _compare(every.slice(0, n), width, similarity, rounds)
                held[:] = [every.slice(n)]
        if held:
            yield from _compare(whole(), width, similarity, rounds)

    return rows.select(names).repartition(parts, F.xxhash64("key", F.lit("compared"))).sortWithinPartitions("key", "sig", "doc", "at").mapInArrow(run, _FOUND)


_TOKENS = "key long, sig long, token int"
_DEALT = _ROW + ", pattern long, prefix array<int>"


def _refined(rows: DataFrame, width: int, similarity: float, most: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows of keys with too many windows, dealt anew by rare marks: (rows, links, members).

    Of equal patterns (see `alike`) one row goes on. links: those of patterns
    that are alike in themselves; members: (key, sig, doc, at, rep): windows of
    other patterns, for which the row with the sig `rep` stands.
    """
    need, names = alike.need_of(width, similarity), [x.split()[0] for x in _ROW.split(", ")]

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                row, _, token = alike.marks_of(_matrix(b, width))
                yield _batch(_TOKENS, b.column("key").take(pa.array(row)), b.column("sig").take(pa.array(row)), token.astype(np.int32))

    every = rows.mapInArrow(tokens, _TOKENS)
    held = every.groupBy("key", "token").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    # At most 2 * width - 1 tokens of each row.
    known = every.join(held, ["key", "token"]).groupBy("key", "sig").agg(F.collect_list(F.struct("n", "token")).alias("tokens")).where(F.size("tokens") >= need)

    def blank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            marks, lists = _matrix(b, width), b.column("tokens")
            row, column, token = alike.marks_of(marks)
            flat = lists.flatten()
            n, shared = flat.field(0).to_numpy(zero_copy_only=False), flat.field(1).to_numpy(zero_copy_only=False)
            owner = np.repeat(np.arange(b.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
            stays = np.isin((row << 23) + token, (owner << 23) + shared)
            kept = np.zeros_like(marks)
            kept[row[stays], column[stays]] = marks[row[stays], column[stays]]
            order = np.lexsort((shared, n, owner))
            count = np.bincount(owner, minlength=b.num_rows)
            place = np.arange(len(owner)) - (np.cumsum(count) - count)[owner]
            first = place < (count - need + 1)[owner]
            prefix = shared[order][first].astype(np.int32)
            offsets = np.concatenate([[0], np.cumsum(np.maximum(count - need + 1, 0))]).astype(np.int32)
            pattern = alike.pattern_hashes(b.column("key").to_numpy(zero_copy_only=False), kept)
            yield _batch(_DEALT, *(b.column(c) for c in names), pattern.view(np.int64), pa.ListArray.from_arrays(pa.array(offsets), pa.array(prefix)))

    own = cut(rows.join(known, ["key", "sig"]).select(*names, "tokens").mapInArrow(blank, _DEALT))
    least = own.groupBy("key", "pattern").agg(F.min(F.struct("sig", "doc", "at", "first", "marks")).alias("rep"))
    others = own.join(least, ["key", "pattern"]).where(F.col("sig") != F.col("rep.sig"))

    def same(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            rep = b.column("rep")
            lead = pa.RecordBatch.from_arrays([rep.field(i) for i in (2, 3, 4)], ["at", "first", "marks"])
            ok, low, high = alike.aligned(_matrix(b, width), _matrix(lead, width), width, similarity)
            at, lead_at = (c.to_numpy(zero_copy_only=False) for c in (b.column("at"), rep.field(2)))
            size = (high - low).astype(np.int32)
            yield _batch(_SAME, rep.field(1), b.column("doc"), (lead_at + low - width + 1).astype(np.int32), (at + low - width + 1).astype(np.int32), size, size, b.column("key"), b.column("sig"), rep.field(0), at, lead_at, ok)

    checked = cut(others.mapInArrow(same, _SAME))
    reps = own.join(least.select("key", "pattern", F.col("rep.sig").alias("rep")), ["key", "pattern"]).where("sig = rep")
    sub = cut(reps.select(*names, F.explode("prefix").alias("token")).select(F.xxhash64("key", "token").alias("key"), *names[1:]))
    size = sub.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumn("buckets", F.when(F.col("n") > most, F.ceil(2 * F.col("n") / most)).otherwise(1).cast("int"))
    dealt = sub.join(size, "key").withColumn("mine", F.pmod(F.xxhash64("sig"), F.col("buckets")).cast("int"))
    every = F.sequence(F.lit(0), F.col("buckets") - 1)
    dealt = dealt.withColumn("with", F.explode(F.when(F.col("buckets") == 1, every).otherwise(F.filter(every, lambda b: b != F.col("mine")))))
    dealt = dealt.select(F.xxhash64("key", F.least("mine", "with"), F.greatest("mine", "with")).alias("key"), *names[1:])
    alike_links = checked.where(F.col("ok") & (F.col("doc") != F.col("other"))).select(*_LINK)
    return dealt, alike_links, checked.where(~F.col("ok")).select("sig", F.col("other").alias("doc"), "at", "rep", "rep_at")


_SAME = "doc long, other long, a int, b int, size int, size_other int, key long, sig long, rep long, at int, rep_at int, ok boolean"
_LINK = ("doc", "other", "a", "b", "size", "size_other")


def _with_members(found: DataFrame, members: DataFrame) -> DataFrame:
    """found, and its links again for the windows that a linked one stands for: what one of them is linked to, all are."""
    m = members.select(F.col("rep").alias("__rep"), F.col("doc").alias("__doc"), (F.col("at") - F.col("rep_at")).alias("__by"))
    one = found.join(m, F.col("sig") == F.col("__rep")).select(F.col("__doc").alias("doc"), "other", (F.col("a") + F.col("__by")).alias("a"), "b", "size", "size_other")
    two = found.join(m, F.col("sig_other") == F.col("__rep")).select("doc", F.col("__doc").alias("other"), "a", (F.col("b") + F.col("__by")).alias("b"), "size", "size_other")
    return found.select(*_LINK).unionAll(one).unionAll(two).where("doc <> other")


def _edges(links: DataFrame) -> DataFrame:
    return links.select(F.col("doc").alias("a"), F.col("other").alias("b")).distinct()


def linked(docs: DataFrame, min_words: int = MIN_WORDS, similarity: float = SIMILARITY, hashes: int = HASHES, group: int = GROUP, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """Verified links and the classes that they make of docs (doc long, text).

    (doc, other, a, b, size, size_other): `size` words from word a of doc and
    `size_other` from word b of other are alike; (node, root): every document
    with a link, and the smallest one that it reaches.
    """
    spark = docs.sparkSession
    ship(spark)
    width = min_words - SHINGLE + 1
    if not SHINGLE <= width <= 128:
        raise ValueError("a passage must have 9 to 132 words at least")
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    hot = _hot(docs, width, hashes, parts)
    known = np.array(hot, np.int64)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _stream(batches, known)

    even = F.shiftright(F.shiftrightunsigned("key", 32) * F.lit(parts), 32).cast("int")
    to = F.when(F.col("key").isin(hot), F.pmod(F.xxhash64("key", "doc"), F.lit(parts)).cast("int")).otherwise(even) if hot else even
    streamed = cut(_emit(docs, width, hashes).repartitionById(parts, to).sortWithinPartitions("key", "sig", "doc", "place").mapInArrow(stream, _STREAMED))
    release(spark)
    equal = streamed.where("kind = 0").select(*_LINK[:5], F.col("size").alias("size_other"))
    different = streamed.where("kind = 1").select("key", "sig", "doc", "place", "n")
    found = [equal]
    if hot:
        # Equal windows of several partitions: a row of each, so a content has no more than there are partitions.
        heads = cut(streamed.where("kind = 2").groupBy("key", "sig").agg(F.sort_array(F.collect_list(F.struct("doc", "place"))).alias("w")))
        far = heads.select(F.col("w")[0].alias("l"), F.explode(F.slice("w", 2, F.size("w"))).alias("o")).where("l.doc <> o.doc")
        first, size = (F.expr(f"cast({e} as int)") for e in ("(l.place >> 14) - (l.place >> 7 & 127)", "(l.place >> 7 & 127) + (l.place & 127) + 1"))
        found.append(far.select(F.col("l.doc").alias("doc"), F.col("o.doc").alias("other"), first.alias("a"), F.expr("cast((o.place >> 14) - (o.place >> 7 & 127) as int)").alias("b"), size.alias("size"), size.alias("size_other")))
        keys = heads.groupBy("key").agg(F.count(F.lit(1)).cast("int").alias("n"), F.min(F.col("w")[0]["doc"]).alias("low"), F.max(F.col("w")[0]["doc"]).alias("high")).where("low < high").select("key", "n")
        # At most as many rows as there are hot keys.
        different = different.unionAll(heads.select("key", "sig", F.col("w")[0]["doc"].alias("doc"), F.col("w")[0]["place"].alias("place")).join(F.broadcast(keys), "key"))
    rows, members = _marked(docs, different, width), None
    large = different.where(F.col("n") > group).select("key").distinct()
    if not large.isEmpty():
        large, marked = cut(large), cut(rows)
        rows, more, members = _refined(marked.join(large, "key"), width, similarity, group)
        found.append(more)
        rows = marked.join(large, "key", "left_anti").select(rows.columns).unionAll(rows)
    first = cut(_compared(rows, width, similarity, rounds))
    release(spark)

    def of(compared: DataFrame) -> DataFrame:
        own = compared.where("kind = 0")
        return _with_members(own, members) if members is not None else own.select(*_LINK)

    found = cut(_union([*found, of(first)]))
    classes = cut(components(_edges(found)))
    # The keys whose windows are not of one class of documents by now.
    rest = first.where("kind = 1").select("key", "sig", "doc", "at", "first", "marks").join(classes, F.col("doc") == F.col("node"), "left").withColumn("label", F.coalesce("root", "doc"))
    rest = cut(rest.select(*[x.split()[0] for x in _ROW.split(", ")]))
    mixed = rest.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("key")
    late = cut(of(_compared(rest.join(mixed, "key"), width, similarity, None)))
    release(spark)
    if not late.isEmpty():
        found, classes = found.unionAll(late), _joined_classes(classes, late)
    return found.select(*_LINK[:4], *[(F.col(c) + SHINGLE - 1).alias(c) for c in _LINK[4:]]), classes


def _joined_classes(classes: DataFrame, late: DataFrame) -> DataFrame:
    """classes after further links: the components of their roots."""

    def root(column: str) -> DataFrame:
        return classes.select(F.col("node").alias(column), F.col("root").alias(f"{column}_root"))

    ends = _edges(late).join(root("a"), "a", "left").join(root("b"), "b", "left")
    ends = ends.select("a", "b", F.coalesce("a_root", "a").alias("x"), F.coalesce("b_root", "b").alias("y"))
    above = components(cut(ends).select(F.col("x").alias("a"), F.col("y").alias("b"))).withColumnRenamed("root", "top")
    moved = classes.join(above.withColumnRenamed("node", "root"), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    new = above.join(classes, "node", "left_anti").select("node", F.col("top").alias("root"))
    return cut(moved.unionAll(new))


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionAll(t)
    return out


def _joined_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted spans of each document, joined where they touch, and the words in them."""
    for b in batches:
        lists = b.column(1)
        flat, count = lists.flatten(), lists.value_lengths().to_numpy(zero_copy_only=False)
        start, end = (flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(2))
        owner = np.repeat(np.arange(b.num_rows), count)
        # Documents one after the other on one line, too far apart to touch.
        step = int(end.max()) + 2 if len(end) else 1
        reach = np.maximum.accumulate(end + owner * step)
        new = np.ones(len(start), bool)
        new[1:] = (start + owner * step)[1:] > reach[:-1]
        at = np.flatnonzero(new)
        last = np.append(at[1:], len(start)) - 1 if len(at) else at
        end = reach[last] - owner[at] * step if len(at) else end
        words = np.bincount(owner[at], end - start[at], minlength=b.num_rows).astype(np.int64)
        offsets = np.concatenate([[0], np.cumsum(np.bincount(owner[at], minlength=b.num_rows))]).astype(np.int32)
        spans = pa.StructArray.from_arrays([pa.array(start[at].astype(np.int32)), pa.array(end.astype(np.int32))], ["start", "end"])
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words), pa.ListArray.from_arrays(pa.array(offsets), spans), b.column(2)], ["doc", "n_repeated", "passages", "n_links"])


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS, similarity: float = SIMILARITY, hashes: int = HASHES, doc_id: str = "doc_id", text: str = "text", group: int = GROUP) -> DataFrame:
    """(doc_id, class_id, n_links, n_repeated, passages): each document that shares a passage with another.

    class_id: the smallest id that links reach; n_links: verified links at this
    document; passages: (start, end) in words, end not included, joined where
    they touch; n_repeated: words in them. A link joins a window to one like it,
    not to all of them.

    Rows with a null id or null text have no part; rows with one id are one
    document's parts and aren't compared with each other. Texts under
    min_words have no windows. An empty table gives an empty result. Ids that
    are not integers are known by their 64-bit hash until the end.
    """
    number = F.col(doc_id).cast("long") if docs.schema[doc_id].dataType.typeName() in ("byte", "short", "integer", "long") else F.xxhash64(F.col(doc_id))
    own = docs.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).alias("id"), number.alias("doc"), F.col(text).alias("text"))
    found, classes = linked(own.select("doc", "text"), min_words, similarity, hashes, group)
    one = found.select("doc", F.struct(F.col("a").alias("start"), (F.col("a") + F.col("size")).alias("end")).alias("p"))
    two = found.select(F.col("other").alias("doc"), F.struct(F.col("b").alias("start"), (F.col("b") + F.col("size_other")).alias("end")).alias("p"))
    # Equal spans first become one, so that a document at which many links end is small.
    spans = one.unionAll(two).groupBy("doc", "p").agg(F.count(F.lit(1)).alias("n")).groupBy("doc").agg(F.sort_array(F.collect_list("p")).alias("p"), F.sum("n").alias("n_links"))
    spans = spans.mapInArrow(_joined_spans, "doc long, n_repeated long, passages array<struct<start:int,end:int>>, n_links long")
    named = spans.join(classes, spans["doc"] == classes["node"])
    if str(own.schema["id"].dataType) == str(own.schema["doc"].dataType):
        return named.select(F.col("doc").alias("doc_id"), F.col("root").alias("class_id"), "n_links", "n_repeated", "passages")
    ids = own.select("id", "doc").distinct()
    rows = named.join(ids, "doc")
    return with_least(rows, "root", "id", "id", "class_id").select(F.col("id").alias("doc_id"), "class_id", "n_links", "n_repeated", "passages")
