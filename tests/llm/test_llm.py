"""The operators for large corpora against brute force on small fixtures: gaps, ties, repeats, empty tables, clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from lodestone.llm import alike, components, decontaminate, license_scan, line_dedup, mixing, passage_dedup, pretokens, quality, queries, simhash, token_counts, token_files, url_filter
from lodestone.llm import textscan as T

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SPACES = " \t\n\x0b\x0c\r"


def docs_of(spark, texts, source="s"):
    return spark.createDataFrame([(i, t, "en", source, 0) for i, t in enumerate(texts)], DOCS)


def odd_texts():
    r = random.Random(5)
    words = ["alpha", "Beta", "gamma", "dEl", "état", "漢字", "x", "don't", "we'll", "12", "#tag", "a&b"]
    texts = [None, "", " ", "\n\n", "one", "a\nb\na", "\t\x0b mixed \x0c\r\nlines", "é" * 70, "🙂 emoji 🙂", "same same same same same same"]
    texts += ["\n".join(" ".join(r.choices(words, k=r.randint(1, 12))) for _ in range(r.randint(1, 12))) for _ in range(40)]
    texts += [texts[12], texts[12], texts[13] + " end", " ".join(r.choices(words, k=30_000))]
    return texts


# --- shared scanning ----------------------------------------------------------


def test_words_and_lines_are_those_of_python():
    texts = odd_texts()
    at = 0
    for a, b, buf, offs in T.chunks(pa.array(texts), 500):
        assert a == at
        at = b
        ws, we, wp = T.words(buf, offs, T.PLAIN_WORDS)
        ls, le, lp = T.lines(buf, offs)
        for d in range(b - a):
            t = texts[a + d] or ""
            got = [bytes(buf[s:e]).decode() for s, e in zip(ws[wp[d] : wp[d + 1]], we[wp[d] : wp[d + 1]], strict=True)]
            assert got == re.findall(r"[^\x20\x09-\x0D]+", t)
            assert [bytes(buf[s:e]).decode() for s, e in zip(ls[lp[d] : lp[d + 1]], le[lp[d] : lp[d + 1]], strict=True)] == t.split("\n")
    assert at == len(texts)


def test_slices_hash_by_content():
    buf = np.frombuffer(b"abc xyz abc ab", np.uint8)
    h = T.hashes(buf, np.array([0, 8, 4, 12]), np.array([3, 11, 7, 14]))
    assert h[0] == h[1] and len(set(h.tolist())) == 3


def thue_morse(n, swap=False):
    """A text of two letters that a polynomial modulo 2^64 can't tell from its complement."""
    return "".join("ab"[(bin(i).count("1") + swap) % 2] for i in range(n))


def test_hashes_tell_unlike_slices_apart_and_same_compares_bytes():
    sizes = (1, 7, 8, 9, 64, 256, 257, 512, 1024, 2048, 4096)
    texts = [thue_morse(n, swap) for n in sizes for swap in (False, True)]
    buf = np.frombuffer("".join(texts).encode(), np.uint8)
    end = np.cumsum([len(t) for t in texts])
    start = end - [len(t) for t in texts]
    assert len(set(T.hashes(buf, start, end).tolist())) == len(texts)
    size = end - start
    assert T.same(buf, start, buf, start, size).all() and not T.same(buf, start[::2], buf, start[1::2], size[::2]).any()
    table = T.Table.of([t.encode() for t in texts[::2]], np.arange(len(sizes)))
    at, there, equal = table.find(T.hashes(buf, start, end), buf, start, end)
    assert equal[::2].all() and not equal[1::2].any() and table.values[at[::2]].tolist() == list(range(len(sizes)))


def test_xxh64_of_all_slices_is_the_library_s():
    r = np.random.default_rng(4)
    buf = r.integers(0, 256, 5000).astype(np.uint8)
    size = np.concatenate([np.arange(0, 130), [255, 256, 257, 1000], r.integers(0, 80, 300)])
    start = r.integers(0, 4000, len(size))
    for seed in (0, 42, (1 << 64) - 1):
        got = T.xxh64(buf, start, start + size, seed)
        assert got.tolist() == [xxhash.xxh64_intdigest(buf[a : a + n].tobytes(), seed) for a, n in zip(start, size, strict=True)]
    assert len(T.xxh64(buf, start[:0], start[:0])) == 0


def test_what_a_hash_finds_is_compared(monkeypatch):
    """With a hash of 3 bits for all over eight bytes, and of no size for the others, many words collide, and nothing changes."""
    own, texts = library(), [t or "" for t in token_texts()]
    texts += [f"{w} alphabetical{i} {w} omnipresence{i}" for i, w in enumerate(["incomprehensible", "a b", "institutionalised"] * 20)]

    def poor(buf, start, end, real=T.hashes):
        size = end - start
        first = T._eights(buf)[start] & T._MASKS[np.minimum(size, 8)]
        return np.where(size > 8, real(buf, start, end) & np.uint64(7), T.mix(first))

    monkeypatch.setattr(T, "hashes", poor)
    enc = pretokens.Encoder(queries.tokenizer_path(), T.Table.of([b" the", b"a", b" alpha"], np.array([1, 1, 1])))
    want = [own.encode(t, add_special_tokens=False).ids for t in texts]
    assert enc.counts(pa.array(texts)).tolist() == [len(w) for w in want]
    assert [ids[a:b].tolist() for ids, offs in enc.ids_of(pa.array(texts)) for a, b in zip(offs[:-1], offs[1:], strict=True)] == want


@pytest.mark.parametrize("n", [512, 1024, 2048, 4096])
def test_complements_of_thue_morse_words_are_told_apart(spark, n):
    a, b = thue_morse(n), thue_morse(n, True)
    texts = [f"{a}\n{b}\n{a}\n{b} x", a, b]
    own = library()
    want = [own.encode(t, add_special_tokens=False).ids for t in texts]
    enc = pretokens.Encoder(queries.tokenizer_path())
    assert enc.counts(pa.array(texts)).tolist() == [len(w) for w in want]
    assert [ids[x:y].tolist() for ids, offs in enc.ids_of(pa.array(texts)) for x, y in zip(offs[:-1], offs[1:], strict=True)] == want
    got = quality.measure(pa.array([f"{a}\n{b}", f"{a} x y {b} x y", f"{a}\n{a}"]), None)
    assert got["n_dup_lines"].tolist() == [0, 0, 1] and got["n_repeat_words"].tolist() == [0, 0, 0]
    scanned = decontaminate.verdicts(decontaminate.scan(docs_of(spark, [a, b]), spark.createDataFrame([("i", a)], "item_id string, text string")))
    assert sorted((r.doc_id, r.n_hit) for r in scanned.select("doc_id", "n_hit").collect()) == [(0, 1), (1, 0)]


# --- 1 ------------------------------------------------------------------------


def brute_lines(texts, least):
    def key(line):
        return line.strip(SPACES).translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))

    n = Counter(k for t in texts for k in {key(x) for x in (t or "").split("\n")} if k)
    out = []
    for t in texts:
        rows = (t or "").split("\n")
        kept = [x for x in rows if n[key(x)] < least]
        out.append((len(rows), len(rows) - len(kept), "\n".join(kept)))
    return out


@pytest.mark.parametrize("least", [2, 3])
def test_line_dedup_is_brute_force(spark, least):
    texts = odd_texts() + ["Same Line \nother %d" % i for i in range(5)] + ["x\n" * 200 + "same line"]
    df = docs_of(spark, texts).withColumn("doc", F.lit(1)).withColumn("keep", F.lit("k"))
    got = line_dedup.apply_bitmaps(df, line_dedup.keep_bitmaps(df, least)).orderBy("doc_id").collect()
    assert [(r.n_lines, r.n_dropped, r.kept_text) for r in got] == brute_lines(texts, least)


def test_line_dedup_keeps_first_and_takes_null_ids(spark):
    df = spark.createDataFrame([(None, "a\nb"), (2, "B \nc"), (1, " b\nd\nb")], "doc_id long, text string")
    got = line_dedup.apply_bitmaps(df, line_dedup.keep_bitmaps(df, 2, "first"))
    assert {(r.doc_id, r.kept_text) for r in got.collect()} == {(None, "a\nb"), (2, "c"), (1, "d")}
    assert line_dedup.keep_bitmaps(df.where("false"), 1).count() == 0


def test_line_dedup_of_repeated_rows_and_empty_tables(spark):
    # Every row is a document, rows with one id too; rows with equal id and text share one bitmap.
    rows = [(1, "a\nb"), (1, "a\nb"), (1, "A \nc"), (2, None), (3, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = line_dedup.apply_bitmaps(df, line_dedup.keep_bitmaps(df, 3)).collect()
    assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in got) == Counter([(1, 2, 1, "b"), (1, 2, 1, "b"), (1, 2, 1, "c"), (2, 1, 0, ""), (3, 1, 0, "")])
    empty = df.where("false")
    assert line_dedup.apply_bitmaps(empty, line_dedup.keep_bitmaps(empty, 2)).count() == 0
    assert line_dedup.apply_bitmaps(empty, line_dedup.keep_bitmaps(df, 2)).count() == 0


# --- 2 ------------------------------------------------------------------------


def prose(r, n, words=4000):
    return " ".join(f"w{r.randrange(words)}" for _ in range(n))


def test_compact_windows_are_the_cartesian_trees_nodes():
    h = np.random.default_rng(3).integers(0, 1 << 60, 300).astype(np.uint64)
    place = np.array([0, 120, 120, 300])
    got = set(zip(*map(np.ndarray.tolist, passage_dedup._windows(h, place, 20)), strict=True))
    want = set()
    for a, b in ((0, 120), (120, 300)):
        for c in range(a, b):
            left, right = c, c
            while left > max(a, c - 19) and h[left - 1] > h[c]:
                left -= 1
            while right < min(b - 1, c + 19) and h[right + 1] > h[c]:
                right += 1
            if right - left + 1 >= 20:
                want.add((left, c, right))
    assert got == want


def test_repeated_passages_are_found_and_others_left(spark):
    r = random.Random(11)
    shared, near = prose(r, 60), prose(r, 120).split()
    changed = list(near)
    changed[60] = "other"
    texts = [prose(r, 80) + " " + shared + " " + prose(r, 90), shared.upper() + " " + prose(r, 50), prose(r, 300), " ".join(near), prose(r, 40) + " " + " ".join(changed)]
    texts += [prose(r, 100) + " " + " ".join(shared.split()[:30]) + " " + prose(r, 100), None, "", "short"]
    got = {x.doc_id: x for x in passage_dedup.repeated_passages(docs_of(spark, texts)).collect()}
    assert set(got) == {0, 1, 3, 4} and got[1].class_id == 0 and got[4].class_id == 3
    (span,) = got[0].passages
    assert span.start <= 82 and span.end >= 138
    assert passage_dedup.repeated_passages(docs_of(spark, [])).count() == 0


def keys_of(words):
    _, h, place = next(passage_dedup._shingles(pa.array([" ".join(words)])))
    return set(np.concatenate([found[0] for found in passage_dedup._places(h, place, 46, passage_dedup.HASHES)] or [np.zeros(0, np.uint64)]).tolist())


def test_passages_with_edits_share_a_key():
    # Unrelated texts around them; by brute force all have similarity 0.8 or more.
    r = random.Random(14)
    for size, places in ((52, (26,)), (60, (30,)), (80, (40,)), (100, (33, 66))):
        shared = 0
        for _ in range(200):
            one = prose(r, size, 1 << 30).split()
            two = [f"x{i}" if i in places else w for i, w in enumerate(one)]
            a, b = ({tuple(x[i : i + 5]) for i in range(size - 4)} for x in (one, two))
            assert len(a & b) >= 0.8 * len(a | b)
            x, y = (prose(r, 60, 1 << 30).split() + w + prose(r, 60, 1 << 30).split() for w in (one, two))
            shared += bool(keys_of(x) & keys_of(y))
        assert shared >= 0.9 * 200


def test_families_of_edited_copies_are_one_class(spark):
    # One original and 30 variants with one word replaced each: the first window of a key is itself an edited one.
    r = random.Random(15)
    joined, of = 0, 0
    texts, originals = [], []
    for _ in range(6):
        one = prose(r, 60, 1 << 30).split()
        originals.append(len(texts))
        for k in range(31):
            two = list(one)
            if k:
                two[r.randrange(60)] = "other"
            texts.append(" ".join([prose(r, 60, 1 << 30), *two, prose(r, 60, 1 << 30)]))
    got = {x.doc_id: x.class_id for x in passage_dedup.repeated_passages(docs_of(spark, texts).repartition(6)).collect()}
    for o in originals:
        joined += sum(got.get(o + k, -1) == got.get(o, -2) for k in range(1, 31))
        of += 30
    assert joined >= 0.97 * of, joined / of


def links_of(*windows, rounds=None):
    """Links of windows of one key, each (marks, place of the minimum), as (row, other, first, first in the other, size, size in the other) with places in the windows."""
    marks = [np.asarray(m[: a + 46], "<u2") for m, a in windows]
    size = np.array([len(m) for m in marks])
    at = np.array([a for _, a in windows])
    rows = alike.matrix(at, np.zeros(len(at), int), size, np.cumsum(size) - size, np.concatenate(marks), 46)
    found, _ = alike.links(np.zeros(len(at), int), np.arange(len(at)), rows, 46, 0.8, rounds)
    return {(x, y, a + at[x] - 45, b + at[y] - 45, n, m) for x, y, a, b, n, m in found.tolist()}


def test_no_pair_of_different_windows_goes_unverified():
    # The first window is like none; the second and the third share no long run around the minimum.
    r = np.random.default_rng(5)
    one = r.integers(1, 1 << 16, 91)
    two = one.copy()
    two[50:55] = r.integers(1, 1 << 16, 5)
    two[20:25] = r.integers(1, 1 << 16, 5)
    odd = r.integers(1, 1 << 16, 91)
    odd[40:52] = one[40:52]
    assert {x[:2] for x in links_of((odd, 45), (one, 45), (two, 45))} == {(1, 2)}


def test_the_best_common_interval_is_verified():
    r = np.random.default_rng(6)

    def other(n):
        return r.integers(1, 1 << 16, n).tolist()

    one = other(91)
    # 46 equal shingles, eight others, one equal one: not alike as a whole.
    assert links_of((one, 20), (one[:46] + other(8) + one[54:55] + other(36), 20)) == {(0, 1, 0, 0, 46, 46)}
    # One word deleted: four shingles in place of five, what follows is shifted; unrelated text on both sides.
    two = other(20) + one[20:40] + other(4) + one[45:70] + other(20)
    assert links_of((one, 25), (two, 25)) == {(0, 1, 20, 20, 50, 49)}
    # 41 equal shingles of 46 are alike (41 of 51), 40 are not (40 of 52): 50 words of which the last ones were replaced.
    assert links_of((one, 40), (other(20) + one[20:61] + other(30), 40)) == {(0, 1, 20, 20, 41, 41)}
    assert not links_of((one, 40), (other(20) + one[20:60] + other(31), 40))


def brute_alike(x, y, width=46, similarity=0.8):
    """Whether some columns a to b, `width` or more, are alike place by place."""
    sums = np.concatenate([[0], np.cumsum((x == y) & (x > 0))])
    a, b = np.meshgrid(np.arange(len(sums)), np.arange(len(sums)), indexing="ij")
    same, size = sums[b] - sums[a], b - a
    return bool(((size >= width) & (same >= similarity * (2 * size - same) - 1e-9)).any())


def edited_rows(r, n, edits, base=None):
    rows = []
    base = r.integers(1, 1 << 16, 91) if base is None else base
    for _ in range(n):
        row = base.copy()
        for _ in range(r.integers(0, edits + 1)):
            at = r.integers(0, 91)
            row[at : at + 5] = r.integers(1, 1 << 16, len(row[at : at + 5]))
        row[45] = base[45]
        rows.append(row)
    return rows


@pytest.mark.parametrize("edits", [2, 4, 7, 10])
def test_classes_of_alike_windows_are_those_of_all_pairs(edits):
    # Two texts that share a line, copies with many edits of both, and texts that share the line only.
    r = np.random.default_rng(edits)
    one, two = r.integers(1, 1 << 16, 91), r.integers(1, 1 << 16, 91)
    two[30:60] = one[30:60]
    rows = edited_rows(r, 25, edits, one) + edited_rows(r, 25, edits, two)
    for _ in range(20):
        row = r.integers(1, 1 << 16, 91)
        row[30:60] = one[30:60]
        rows.append(row)
    rows = np.array(rows, np.uint16)[r.permutation(len(rows))]
    want = brute_components(len(rows), lambda i, j: brute_alike(rows[i], rows[j]))
    group, label = np.zeros(len(rows), int), np.arange(len(rows))
    found, _ = alike.links(group, label, rows, 46, 0.8)
    pairs = {(min(x, y), max(x, y)) for x, y in found[:, :2].tolist()}
    assert brute_components(len(rows), lambda i, j: (min(i, j), max(i, j)) in pairs) == want
    # The same in two steps, with the classes that the first one found.
    first, open_rows = alike.links(group, label, rows, 46, 0.8, 1)
    pairs = {(min(x, y), max(x, y)) for x, y in first[:, :2].tolist()}
    label = np.array(brute_components(len(rows), lambda i, j: (min(i, j), max(i, j)) in pairs))
    rest, _ = alike.links(np.zeros(len(open_rows), int), label[open_rows], rows[open_rows], 46, 0.8)
    pairs |= {(min(x, y), max(x, y)) for x, y in open_rows[rest[:, :2]].tolist()}
    assert brute_components(len(rows), lambda i, j: (min(i, j), max(i, j)) in pairs) == want


def test_copies_with_many_edits_do_not_meet_each_other(monkeypatch):
    # 1,500 copies with up to 12 edits each: all pairs would be a million comparisons.
    r, compared = np.random.default_rng(8), []
    real = alike.aligned
    monkeypatch.setattr(alike, "aligned", lambda x, y, *rest: compared.append(len(x)) or real(x, y, *rest))
    rows = np.array(edited_rows(r, 1500, 12), np.uint16)
    alike.links(np.zeros(1500, int), np.arange(1500), rows, 46, 0.8)
    assert sum(compared) < 60_000


RECALL = ((50, 1), (55, 1), (60, 1), (80, 1), (80, 2), (120, 2), (200, 4), (300, 6))


def test_recall_of_passages_with_edits_by_length(spark):
    """Pairs of similarity 0.8 or more with edits at random places, unrelated words on both sides: 100 for each length and number of edits."""
    r = random.Random(1)
    texts = []
    for size, edits in RECALL:
        pairs = 0
        while pairs < 100:
            one = prose(r, size, 1 << 30).split()
            two = list(one)
            for at in r.sample(range(size), edits):
                two[at] = f"x{r.random()}"
            a, b = ({tuple(x[i : i + 5]) for i in range(size - 4)} for x in (one, two))
            if len(a & b) >= 0.8 * len(a | b):
                texts += [" ".join([prose(r, 60, 1 << 30), *w, prose(r, 60, 1 << 30)]) for w in (one, two)]
                pairs += 1
    got = {x.doc_id: x.class_id for x in passage_dedup.repeated_passages(docs_of(spark, texts)).collect()}
    assert all(v // 2 == k // 2 for k, v in got.items())
    found = Counter(k // 200 for k in got)
    assert all(found[i] >= 0.95 * 200 for i in range(len(RECALL))), found


def test_passages_of_odd_tables(spark, monkeypatch):
    """Null and text ids, repeated rows, a clashing column, a very long text, and groups that are dealt anew by their rare marks."""
    r = random.Random(21)
    shared, line = prose(r, 70, 1 << 30), prose(r, 30, 1 << 30)
    long = prose(r, 20_000, 1 << 30)
    texts = [f"{prose(r, 40)} {line} {prose(r, 40)}" for _ in range(40)]
    texts += [f"{prose(r, 40)} {shared} {prose(r, 30)}" for _ in range(30)] + [f"{long} {shared}", long + " and more"]
    for i in range(30):
        words = shared.split()
        words[i * 2 + 3] = "other"
        texts.append(f"{prose(r, 40)} {' '.join(words)} {prose(r, 40)}")
    rows = docs_of(spark, texts).withColumn("key", F.lit("mine"))
    rows = rows.unionAll(rows.where("doc_id in (41, 71)")).unionAll(rows.where("doc_id = 42").withColumn("doc_id", F.lit(None).cast("long")))
    want = {i: 40 for i in range(40, 102)}
    for group in (passage_dedup.GROUP, 7):
        got = passage_dedup.repeated_passages(rows.repartition(5), group=group).collect()
        assert {x.doc_id: x.class_id for x in got} == want, group
    monkeypatch.setattr(passage_dedup, "SAMPLED", 1)
    monkeypatch.setattr(passage_dedup, "HOT", 0)
    assert passage_dedup._hot(rows.select(F.col("doc_id").alias("doc"), "text").where("doc is not null"), 46, 3, 4)
    got = passage_dedup.repeated_passages(rows.repartition(5), group=7).collect()
    assert {x.doc_id: x.class_id for x in got} == want
    named = rows.withColumn("doc_id", F.format_string("d%04d", "doc_id"))
    got = passage_dedup.repeated_passages(named.where("doc_id <> 'dnull'")).collect()
    assert {x.doc_id: x.class_id for x in got} == {f"d{i:04d}": "d0040" for i in want}


def test_passages_with_a_deleted_or_inserted_word_are_linked(spark):
    r = random.Random(16)
    for size, change, least in ((60, -1, 0.8), (80, -1, 0.9), (80, 1, 0.9)):
        texts = []
        for _ in range(60):
            one = prose(r, size, 1 << 30).split()
            at = size // 2
            two = one[:at] + (one[at + 1 :] if change < 0 else ["other", *one[at:]])
            texts += [" ".join([prose(r, 60, 1 << 30), *w, prose(r, 60, 1 << 30)]) for w in (one, two)]
        got = {x.doc_id: x.class_id for x in passage_dedup.repeated_passages(docs_of(spark, texts)).collect()}
        assert all(v // 2 == k // 2 for k, v in got.items())
        assert len(got) >= least * 120


def test_many_copies_of_one_passage(spark):
    r = random.Random(12)
    shared = prose(r, 55)
    texts = [prose(r, 60) + " " + shared + " " + prose(r, 60) for _ in range(60)] + [prose(r, 150) for _ in range(40)]
    got = passage_dedup.repeated_passages(docs_of(spark, texts).repartition(6)).collect()
    assert {x.doc_id for x in got} == set(range(60)) and {x.class_id for x in got} == {0}


def test_a_hot_key_amid_different_texts_meets_over_partitions(spark):
    # All hold 30 words, which make one key; only the last ones of 60 words and more repeat.
    r = random.Random(13)
    shared = prose(r, 30)
    texts = [prose(r, 60) + " " + shared + " " + prose(r, 60) for _ in range(80)]
    around = [(prose(r, 30), prose(r, 30)) for _ in range(12)]
    texts += [prose(r, 40) + f" {a} {shared} {b} " + prose(r, 40) for _ in range(2) for a, b in around]
    got = {x.doc_id: x.class_id for x in passage_dedup.repeated_passages(docs_of(spark, texts).repartition(6)).collect()}
    assert got == {**{80 + i: 80 + i for i in range(12)}, **{92 + i: 80 + i for i in range(12)}}


# --- 3 ------------------------------------------------------------------------


def brute_contamination(texts, items, window=13):
    def words(t):
        t = (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)

    out = []
    for t in texts:
        w, hit, ids = words(t), set(), set()
        for i, x in items:
            v = words(x)
            size = min(window, len(v))
            keys = {tuple(v[k : k + size]) for k in range(len(v) - size + 1)} if v else set()
            for k in range(len(w) - size + 1 if v else 0):
                if tuple(w[k : k + size]) in keys:
                    hit |= set(range(k, k + size))
                    ids.add(str(i))
        out.append((len(w), len(hit), sorted(ids)))
    return out


def test_decontamination_is_brute_force(spark):
    r = random.Random(4)
    items = [(i, prose(r, n, 60)) for i, n in enumerate((30, 13, 14, 5, 1))] + [(7, None), (8, "..."), (10, prose(r, 20, 60))]
    texts = odd_texts() + [prose(r, 50, 60) for _ in range(20)] + [f"Start, {items[0][1].upper()}! end", items[1][1] + " " + items[2][1], "état " + items[3][1].replace(" ", "-")]
    df = docs_of(spark, texts).withColumn("scan", F.lit(0)).withColumn("items", F.lit(0))
    b = spark.createDataFrame([*items, items[0]], "item_id long, text string")
    want = brute_contamination(texts, items)
    for most in (decontaminate.MAX_WORDS, 40):
        got = decontaminate.verdicts(decontaminate.scan(df, b, max_words=most)).orderBy("doc_id").collect()
        assert [(x.n_words, x.n_hit, list(x.scan["items"])) for x in got] == want
    for x in got:
        for h in x.scan.hits:  # offsets are those of the original text
            assert len(re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", x.text[h.start : h.end])) == h.end_word - h.word
    assert decontaminate.verdicts(decontaminate.scan(df, b.where("false"))).where("contaminated").count() == 0


# --- 4 ------------------------------------------------------------------------


def test_url_rules_list_and_gaps(spark):
    urls = [None, "", "no scheme/x", "http://A.net/x", "https://www.example.net/en/1?q", "http://example.com/de/2", "http://x.org/fr/", "http://evil.test/a/", "http://m.evil.test/a.html#f", "http://good.test/a", "http://evil.test", "http://notnet/"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)] * 2, "page_id long, url string").withColumn("host", F.lit("mine"))
    listed = spark.createDataFrame([("evil.test/a",), (None,), ("evil.test/a",)], "url string")
    for most in (64, 1 << 20):  # in the small filter nearly all pass; the exact join removes them
        rows = url_filter.judge(pages, listed, queries.URL_RULES, max_bytes=most).collect()
        assert len(rows) == 2 * len(urls)
        got = {r.page_id: r for r in rows}
        assert [got[i].verdict for i in range(len(urls))] == ["allow", "allow", "allow", "block", "allow", "block", "allow", "block", "block", "allow", "allow", "allow"]
        assert got[4].rule == "example.net/en/" and got[3].rule == "net/" and got[0].host == "" and got[3].host == "a.net" and got[8].path == "/a.html"
    assert url_filter.judge(pages, listed.where("false"), ()).where("verdict = 'block'").count() == 0
    assert url_filter.judge(pages.where("false"), listed, queries.URL_RULES).count() == 0


def test_a_listed_host_has_all_its_pages(spark):
    hosts = ["evil.test", "www.evil.test", "m.EVIL.test", "not-evil.test", "evil.test.org", "sub.evil.test"]
    pages = spark.createDataFrame([(i, f"http://{h}{p}") for i, h in enumerate(hosts) for p in ("", "/", "/de/99999.html", "/a/b?q#f")], "page_id long, url string")
    listed = spark.createDataFrame([("evil.test/",)], "url string")
    for most in (64, 1 << 20):
        got = url_filter.judge(pages, listed, (), max_bytes=most).groupBy("page_id").agg(F.collect_set("verdict").alias("v")).collect()
        assert {r.page_id: r.v for r in got} == {i: ["block" if i < 3 else "allow"] for i in range(len(hosts))}


# --- 5 ------------------------------------------------------------------------


def brute_quality(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(grams)
    hit = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(3)}
    seen, dup = set(), 0
    for x in t.split("\n"):
        dup += bool(re.search(r"[^\x20\x09-\x0D]", x)) and x in seen
        seen.add(x)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(hit), len(w) < 50 or 100 * len(hit) > 50 * len(w)


def test_quality_counts_are_brute_force(spark):
    texts = odd_texts()
    got = quality.score(docs_of(spark, texts).withColumn("quality", F.lit(1)), None).orderBy("doc_id").collect()
    q = [r.quality for r in got]
    assert [(r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in q] == [brute_quality(t) for t in texts]
    assert all(r.kept == (not r.base_failed) for r in q)


def test_quality_model_on_rows_held_out(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    train, test = labels.where("doc_id % 3 <> 0"), labels.where("doc_id % 3 = 0").select("doc_id", F.col("quality").alias("y"))
    scored = quality.score(docs, quality.train(docs, train)).join(test, "doc_id").select("y", "quality.p_quality").collect()
    good, bad = [r.p_quality for r in scored if r.y], [r.p_quality for r in scored if not r.y]
    auc = np.mean([(a > b) + (a == b) / 2 for a in good for b in bad])
    assert auc > 0.9 and np.mean([p >= quality.THRESHOLD for p in good]) > 0.95
    assert quality.train(docs, labels.where("false")) is None


def spoilt(r, n, share):
    """Labelled texts: good ones, and bad ones in which the share of the words is of a small vocabulary of their own."""
    junk = [f"buy{i}" for i in range(40)]
    rows = []
    for i in range(n):
        words = prose(r, 120, 1500).split()
        bad = r.random() < 0.5
        if bad:
            for at in r.sample(range(120), int(share * 120)):
                words[at] = r.choice(junk)
        rows.append((i, " ".join(words), int(not bad)))
    return rows


def test_bad_documents_are_rejected_and_probabilities_are_calibrated(spark):
    r = random.Random(17)
    rows = spoilt(r, 1600, 0.35)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i % 2], "doc_id long, quality int")
    got = {x.doc_id: x.quality for x in quality.score(docs, quality.train(docs, labels)).collect()}
    held = [(y, got[i]) for i, _, y in rows if not i % 2]
    assert np.mean([q.kept for y, q in held if y]) > 0.97 and np.mean([not q.kept for y, q in held if not y]) > 0.9
    # Calibrated: of the held-out rows with about one probability that share is good, here by a third of them each.
    p, y = np.array([q.p_quality for _, q in held]), np.array([y for y, _ in held])
    assert abs(p.mean() - y.mean()) < 0.05 and np.mean((p - y) ** 2) < 0.08
    # Half of the labels turned at random: probabilities must come near one half, whatever the scores are.
    noise = spark.createDataFrame([(i, r.randrange(2)) for i, _, _ in rows if i % 2], "doc_id long, quality int")
    q = [x.quality.p_quality for x in quality.score(docs, quality.train(docs, noise)).collect()]
    assert 0.25 < np.quantile(q, 0.1) and np.quantile(q, 0.9) < 0.75


def test_quality_of_odd_tables(spark):
    """Repeated and contradicting labels, null and unknown ids, a threshold that is just met, an empty table."""
    r = random.Random(18)
    rows = spoilt(r, 200, 0.5)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(None, "x " * 60), (rows[0][0], rows[0][1])], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] * 2 + [(rows[0][0], 1 - rows[0][2]), (None, 1), (10_000, 0), (5, None), (6, 7)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    scored = quality.score(docs, model).collect()
    assert len(scored) == 202 and not next(x for x in scored if x.doc_id is None).quality.kept
    p = sorted(x.quality.p_quality for x in scored if not x.quality.base_failed)
    least = p[len(p) // 2]
    assert {x.quality.kept for x in quality.score(docs, model, threshold=least).collect() if x.quality.p_quality == least} == {True}
    empty = docs.where("false")
    assert quality.train(empty, labels) is None and quality.score(empty, model).count() == 0
    # At most `sample` labelled rows, whatever their order: those with the smallest hash.
    few = [quality.train(docs, x, sample=120).weights for x in (labels, labels.orderBy(F.desc("doc_id")))]
    assert np.array_equal(*few)


# --- 6 and 7 ------------------------------------------------------------------


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer_path())


def token_texts():
    r = random.Random(9)
    alphabet = ["a", "Z", " ", "  ", "\n", "\t", "'", "'s", "'re", "'ll", "''", "1", "²", "é", "漢", "!", " ", "　", "🙂", "'T", " ", "ǅ", "<|endoftext|>", "<|endof"]
    return odd_texts() + ["".join(r.choices(alphabet, k=r.randint(1, 40))) for _ in range(600)]


def test_pretokens_are_those_of_the_library():
    own = library()
    enc = pretokens.Encoder(queries.tokenizer_path(), entries=3000)
    texts = token_texts()
    want = [own.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert enc.counts(pa.array(texts)).tolist() == [len(w) for w in want]
    got = [ids[a:b].tolist() for ids, offs in enc.ids_of(pa.array(texts)) for a, b in zip(offs[:-1], offs[1:], strict=True)]
    assert got == want


def test_new_pretokens_go_to_the_library_in_long_sequences():
    own, enc = library(), pretokens.Encoder(queries.tokenizer_path())
    r = random.Random(4)
    pieces = list(dict.fromkeys([*(" " + "".join(r.choices("abcdeé鯨😀", k=r.randint(1, 9))) for _ in range(3000)), "  ", "'s", "\n\n", " 12", "!?"]))
    want = [e.ids for e in own.encode_batch(pieces, add_special_tokens=False)]
    asked = []

    class Asked:
        """The library, with a note of how many encodings it makes."""

        def __init__(self):
            self.pre_tokenizer = None

        def encode_batch_fast(self, texts, **more):
            asked.append(len(texts))
            return own.encode_batch_fast(texts, **more)

        def encode_batch(self, texts, **more):
            asked.append(len(texts))
            return own.encode_batch(texts, **more)

    enc.library = Asked()
    enc.learn([p.encode() for p in pieces])
    assert sum(asked) == -(-len(pieces) // pretokens.SEQUENCE)
    assert enc.library.pre_tokenizer is enc.cutter
    assert [enc.ids[a : a + n].tolist() for a, n in zip(enc.first, enc.sizes, strict=True)] == want
    # Where the bytes of the ids don't fit the pieces, each is encoded alone.
    enc.clear()
    enc.held[want[0][0]] += 1
    enc.learn([p.encode() for p in pieces])
    assert asked[-1] == len(pieces)
    assert [enc.ids[a : a + n].tolist() for a, n in zip(enc.first, enc.sizes, strict=True)] == want


def test_all_kinds_of_code_points_are_split_as_by_the_library():
    own, enc, r = library(), pretokens.Encoder(queries.tokenizer_path()), random.Random(1)
    points = [*range(1, 0x600), *(c for c in r.sample(range(0x600, 0x110000), 4000) if not 0xD800 <= c < 0xE000)]
    texts = [f"a{chr(c)}b 1{chr(c)}2 {chr(c)}{chr(c)}'s {chr(c)}" for c in points]
    want = [len(e.ids) for e in own.encode_batch(texts, add_special_tokens=False)]
    assert enc.counts(pa.array(texts)).tolist() == want


def test_token_counts_and_files(spark):
    texts = token_texts()[:120]
    df = docs_of(spark, texts).withColumn("n_bytes", F.lit("mine"))
    own = library()
    want = [own.encode(t or "", add_special_tokens=False).ids for t in texts]
    for table in (1, 5000):
        got = token_counts.count_tokens(df, queries.tokenizer_path(), table=table).orderBy("doc_id").collect()
        assert [(r.n_tokens, r.n_bytes) for r in got] == [(len(w), len((t or "").encode())) for w, t in zip(want, texts, strict=True)]
    rows = queries.token_rows(spark, df.unionAll(df.where("doc_id = 20")).unionAll(df.where("doc_id = 3").withColumn("doc_id", F.lit(None).cast("long")))).orderBy("start").collect()
    assert [r.doc_id for r in rows] == [None, *sorted([*range(120), 20])]
    start = 0
    for r in rows:
        ids = want[3 if r.doc_id is None else r.doc_id] + [0]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert queries.token_rows(spark, df.where("false")).count() == 0
    assert token_counts.count_tokens(df.where("false"), queries.tokenizer_path()).count() == 0


def test_frequent_pretokens_come_from_all_documents(spark):
    # The most frequent pre-token stands only in the last rows of a large table, in one of its parts.
    texts = [f"word{i} and more" for i in range(3000)] + ["zebra " * 4000]
    table = token_counts.frequent(docs_of(spark, texts).repartition(8), queries.tokenizer_path(), table=4)
    pieces = {bytes(table.text[a : a + n]) for a, n in zip(table.begin.tolist(), table.size.tolist(), strict=True)}
    assert b" zebra" in pieces and len(pieces) == 4
    counter = token_counts._Counter(10)
    for i in range(50):
        counter.add(np.array([1, 100 + i], np.uint64), np.array([5, 1]), np.array([b"often", b"seldom"], object))
    assert len(counter.keys) <= 10 and counter.counts[counter.keys == 1][0] == 250


@pytest.mark.parametrize("width", [1, 7, 15, 16, 17, 20])
def test_packing_is_a_round_trip_and_opens_anywhere(width):
    ids = np.random.default_rng(width).integers(0, 1 << width, 1000).astype(np.uint32)
    assert token_files.bits_for(1 << width) == width
    block = token_files.Block(token_files.write_block(ids, np.array([10, 0, 990]), width))
    assert (block[0] == ids[:10]).all() and len(block[1]) == 0 and (block[2] == ids[10:]).all() and (block.slice(333, 777) == ids[333:777]).all()
    assert len(token_files.pack(ids, width)) == -(-1000 * width // 8)


# --- 8 ------------------------------------------------------------------------


def brute_fingerprint(t):
    t = (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(n, linked):
    parent = list(range(n))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return [find(i) for i in range(n)]


def test_simhash_is_brute_force(spark):
    r = random.Random(8)
    base = prose(r, 400)
    texts = odd_texts()[:-1] + [base + f" tail{i}" for i in range(30)] + [prose(r, 5, 3) for _ in range(40)]
    fps = [brute_fingerprint(t) for t in texts]
    got = simhash.near_duplicates(docs_of(spark, texts)).orderBy("doc").collect()
    assert [x.fp % (1 << 64) for x in got] == fps
    assert [x.component for x in got] == brute_components(len(fps), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 2)


def test_simhash_of_odd_tables(spark):
    r = random.Random(9)
    long = prose(r, 60_000)
    rows = [(3, long), (None, long + " x"), (2, long), (2, "other words here entirely"), (2, long), (9, None), (8, " \n"), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("mine")).withColumn("doc", F.lit(1))
    got = Counter((x.doc, x.component) for x in simhash.near_duplicates(docs).collect())
    assert got == Counter([(3, 2), (None, 2), (2, 2), (2, 2), (2, 2), (9, 8), (8, 8), (None, 8)])
    assert simhash.near_duplicates(docs.where("false")).count() == 0


def test_links_connect_what_is_within_the_radius(spark):
    r = random.Random(6)
    fps = [r.getrandbits(64) for _ in range(20)]
    fps += [f ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for f in fps for _ in range(4)]
    fps = sorted({f - (1 << 64) if f >> 63 else f for f in fps})
    edges = simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"))
    roots = {x.node: x.root for x in components.components(edges).collect()}
    want = brute_components(len(fps), lambda i, j: ((fps[i] ^ fps[j]) % (1 << 64)).bit_count() <= 2)
    assert [roots.get(f, f) for f in fps] == [fps[i] for i in want]


def test_least_value_reaches_all_rows_of_hot_keys(spark):
    rows = [(1, i, i) for i in range(5, 3000)] + [(2, None, 1), (2, 7, 2), (3, None, 1), (4, 9, None), (4, 9, None), (None, 1, 1)]
    got = components.with_least(spark.createDataFrame(rows, "k long, v long, b long"), "k", "v", "b", "m").collect()
    least = {1: 5, 2: 7, 3: None, 4: 9}
    assert Counter((x.k, x.v, x.b, x.m) for x in got) == Counter((k, v, b, least[k]) for k, v, b in rows if k)


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 140)] + [(200, 200), (None, 3), (300, 301), (301, 300), (300, 301)]
    got = {x.node: x.root for x in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{k: 100 for k in range(100, 140)}, 200: 200, 300: 300, 301: 300}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- 9 ------------------------------------------------------------------------


def brute_licenses(t, least=0.8):
    def shingles(x):
        x = (x or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", x)
        return [tuple(w[i : i + 5]) for i in range(len(w) - 4)]

    own, out = shingles(t), set()
    for i, (_, x) in enumerate(license_scan.TEMPLATES):
        s = set(shingles(x))
        w = 32 if len(s) <= license_scan.SHORT else 128
        if any(len(s & set(own[a : a + w])) >= least * len(s) for a in range(0, max(1, len(own)), w // 2)):
            out.add(i)
    return out


def test_license_scan_is_brute_force(spark):
    r = random.Random(2)
    texts = [prose(r, r.randint(0, 300)) + "\n" + x + "\n" + prose(r, r.randint(0, 200)) for _, x in license_scan.TEMPLATES]
    texts += [x.upper() for _, x in license_scan.TEMPLATES] + [prose(r, 500), None, "", "Licensed under", texts[5].replace("free of charge", "at no cost")]
    got = defaultdict(set)
    for x in license_scan.scan(docs_of(spark, texts).withColumn("words", F.lit(1))).collect():
        got[x.doc].add(x.template)
        assert x.containment >= 0.8
    assert [got[i] for i in range(len(texts))] == [brute_licenses(t) for t in texts]
    with pytest.raises(Exception, match="5 to 68"):
        license_scan.templates(spark, [("x", "too short")]).collect()


def test_short_notices_are_found_at_every_place(spark):
    texts = ["All rights reserved.", "x\nALL RIGHTS\nreserved, all rights reserved", "all rights are reserved", "rights reserved", None, "", "b All rights reserved by a b c d", "a b c d All rights"]
    got = {(x.doc, x.license, x.template): (x.containment, x.n_windows, x.first_word) for x in license_scan.scan(docs_of(spark, texts), notices=license_scan.NOTICES).collect()}
    n = len(license_scan.TEMPLATES)
    assert got == {(d, "all-rights-reserved", n): v for d, v in ((0, (1.0, 1, 0)), (1, (1.0, 2, 1)), (6, (1.0, 1, 1)))}
    mixed = license_scan.scan(docs_of(spark, texts), notices=[("a", "A"), ("b", "b"), ("cd", "c-D")]).collect()
    assert {(x.doc, x.license, x.n_windows, x.first_word) for x in mixed} == {(6, "a", 1, 5), (6, "b", 2, 0), (6, "cd", 1, 7), (7, "a", 1, 0), (7, "b", 1, 1), (7, "cd", 1, 2)}


def test_long_texts_are_cut_evenly_and_found_whole(spark):
    for n in (5, 68, 69, 70, 136, 137, 700):
        pieces = [p.split() for p in license_scan.cut_text(" ".join(f"w{i}" for i in range(n)))]
        assert [w for p in pieces for w in p] == [f"w{i}" for i in range(n)] and all(5 <= len(p) <= 68 for p in pieces)
    with pytest.raises(ValueError, match="five|5"):
        license_scan.cut_text("too short")
    r = random.Random(6)
    texts = []
    for _, t in license_scan.TEXTS:
        words = t.split()
        edited = [w if i % 60 != 30 else "other" for i, w in enumerate(words)]
        texts += [f"{prose(r, 50)}\n{t}\n{prose(r, 80)}", " ".join(edited), " ".join(words[: len(words) // 2])]
    texts += [prose(r, 40_000) + " " + license_scan.TEXTS[0][1] + " " + prose(r, 10), None, ""]
    docs = docs_of(spark, texts)
    found = license_scan.scan(docs.unionAll(docs), notices=license_scan.NOTICES, whole=license_scan.TEXTS)
    first = len(license_scan.TEMPLATES) + len(license_scan.NOTICES)
    rows = found.where(F.col("template") >= first).collect()
    got = {(x.doc, x.license, x.template - first) for x in rows}
    assert len(rows) == len(got) and got == {(3 * i + k, name, i) for i, (name, _) in enumerate(license_scan.TEXTS) for k in (0, 1)} | {(3 * len(license_scan.TEXTS), "mit", 0)}
    plain = {(x.doc, x.license, x.template): x.containment for x in license_scan.scan(docs, notices=license_scan.NOTICES).collect()}
    assert plain == {(x.doc, x.license, x.template): x.containment for x in found.where(F.col("template") < first).collect()}
    assert license_scan.scan(docs.where("false"), whole=license_scan.TEXTS).count() == 0


@pytest.mark.parametrize("least", [0.5, 0.8, 1.0])
def test_no_text_without_an_anchor_holds_a_template(least):
    every = [t for _, t in (*license_scan.TEMPLATES, *license_scan.NOTICES)]
    held = set(license_scan.anchors(every, least))
    for t in every:
        words = license_scan._split_words(t)
        size = min(5, len(words))
        shingles = {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}
        assert sum(not held & set(x) for x in shingles) < least * len(shingles)


def test_every_license_line_of_the_tables_is_found(spark):
    lines = {"All rights reserved.": "all-rights-reserved", "Licensed under CC BY-NC 4.0.": "cc-by-nc-4.0", "Licensed under the Apache License, Version 2.0.": "apache-2.0", "Released under the MIT License.": "mit", "This work is licensed under the GNU General Public License, version 3.": "gpl-3.0"}
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    want = {(r.doc_id, name) for r in docs for x, name in lines.items() if x in (r.text or "").split("\n")}
    got = {(x.doc_id, x.license) for x in queries.op9_license_scan(spark, "/root/testdata/sf0.01").collect()}
    assert len({n for _, n in want}) == 5 and want <= got


# --- 10 -----------------------------------------------------------------------


def test_targets_are_capped_and_reshared():
    s = [mixing.Source(n, 1, size, w) for n, size, w in (("a", 10, 5), ("b", 500, 2), ("c", 490, 1), ("d", 0, 5))]
    mixing.set_targets(s)
    assert s[0].target == 30 and s[3].target == 0 and sum(x.target for x in s) == pytest.approx(1000)
    assert s[1].target == pytest.approx(970 * 2 / 3) and s[2].target == pytest.approx(970 / 3)


def test_quotas_are_split_exactly():
    quotas = [1000, 3, 0, 250]
    out = mixing.split_quotas(quotas, 7)
    assert [sum(x) for x in zip(*out, strict=True)] == quotas and max(map(sum, out)) - min(map(sum, out)) <= 3
    assert out == mixing.split_quotas(quotas, 7)


@pytest.mark.parametrize("good,bad,want", [(600, 400, 300), (10**10, 3 * 10**10, 10**9), (5, 4 * 10**9, 2 * 10**9), (2 * 10**9, 0, 10**9), (10**9, 10**9, 2 * 10**9)])
def test_draws_of_any_size_are_hypergeometric(monkeypatch, good, bad, want):
    monkeypatch.setattr(mixing, "LIBRARY_RANGE", 0)
    random = np.random.Generator(np.random.PCG64(1))
    got = np.array([mixing._hypergeometric(random, good, bad, want) for _ in range(400)])
    total = good + bad
    mean, deviation = want * good / total, (want * good / total * bad / total * (total - want) / (total - 1)) ** 0.5
    assert got.min() >= max(0, want - bad) and got.max() <= min(good, want)
    assert abs(got.mean() - mean) <= 5 * deviation / 20 + 1e-9 and abs(got.std() - deviation) <= 0.2 * deviation + 1e-9


def test_quotas_of_any_size_and_number_are_split():
    quotas = [3 * 10**9, 10**10, 7, 0]
    out = mixing.split_quotas(quotas, 9)
    assert [sum(x) for x in zip(*out, strict=True)] == quotas and max(map(sum, out)) - min(map(sum, out)) <= 4


def test_the_mix_is_the_one_drawn_by_brute_force(spark):
    """Every block whole in each pass and in the rest's permuted order, then documents of the last block: the same draws, row by row."""
    docs = mixed_docs(spark)
    mix = mixing.Mix(docs)
    placed = mix._placed(mix.sized, mix.sized["source"], F.col("doc"), F.col("tk"))
    placed = placed.withColumns({"by_block": mixing._order(F.col("no"), F.col("block")), "by_doc": mixing._order(F.lit(1), F.col("doc"), F.col("tk")), "by_size": mixing._order(F.lit(2), F.col("doc"), F.col("tk"))})
    want = Counter()
    rows = placed.collect()
    for no in {r.no for r in rows}:
        own = [r for r in rows if r.no == no]
        blocks = defaultdict(list)
        for r in own:
            blocks[r.by_block, r.block].append(r)
        room = own[0].rest
        for _, block in sorted(blocks.items()):
            size = sum(r["size"] for r in block)
            times = own[0].passes + (size <= room)
            for r in block:
                want[r.doc, r.tk] += times
            if 0 < room < size:
                left = room
                late = []
                alive = True
                for r in sorted((r for r in block if r["size"]), key=lambda r: (r.by_doc, r.doc)):
                    if alive and r["size"] <= left:
                        left -= r["size"]
                        want[r.doc, r.tk] += 1
                    else:
                        alive = False
                        late.append(r)
                for r in sorted(late, key=lambda r: (r["size"], r.by_size, r.doc)):
                    if r["size"] > left:
                        break
                    left -= r["size"]
                    want[r.doc, r.tk] += 1
            room -= size
    got = Counter((r.doc_id, r.tk) for r in mix.rows(5).select("doc_id", F.xxhash64("text").alias("tk")).collect())
    assert got == Counter({k: n for k, n in want.items() if n})


def mixed_docs(spark):
    r = random.Random(3)
    rows = [(i, prose(r, r.choice((0, 1, 5, 20, 60))), "en", r.choice(["a", "a", "a", "b", "c", None, "é"]), 0) for i in range(1500)]
    return spark.createDataFrame([*rows, rows[0], rows[0], (None, None, "en", "a", 0)], DOCS).withColumn("size", F.lit("mine"))


def test_mix_meets_targets_and_repeats(spark):
    mix = mixing.Mix(mixed_docs(spark))
    rows = mix.documents().collect()
    assert len(rows) == 1503 and sorted(map(str, rows)) == sorted(map(str, mixing.Mix(mixed_docs(spark)).documents().collect()))
    assert all(0 <= x.taken <= 3 * x["size"] and (x["size"] == 0 or x.taken % x["size"] == 0) for x in rows)
    taken, target = defaultdict(int), {}
    for x in rows:
        taken[x.source_size, x.target] += x.taken
        target[x.source_size, x.target] = x.target
    assert all(abs(taken[k] - target[k]) <= 60 for k in taken)
    copies = Counter((x.doc_id, x.text) for x in mix.rows(5).select("doc_id", "text").collect())
    words = sum(len((t or "").split()) * n for (_, t), n in copies.items())
    assert words == sum(x.taken for x in rows)
    assert mix.rows(5).columns == mixed_docs(spark).columns
    assert mixing.Mix(mixed_docs(spark).where("false")).documents().count() == 0


def test_op10_counts_what_the_mixed_shards_hold(spark, monkeypatch):
    mix = mixing.Mix(mixed_docs(spark))
    assert sorted(map(str, mix.counted(5).collect())) == sorted(map(str, mix.documents().collect()))
    assert mixing.Mix(mixed_docs(spark).where("false")).counted(5).count() == 0
    asked, rows = [], mixing.Mix.rows
    monkeypatch.setattr(mixing.Mix, "rows", lambda self, shards: asked.append(shards) or rows(self, shards))
    assert queries.op10_mixing(spark, SMALL).count() == spark.read.parquet(f"{SMALL}/documents.parquet").count() and asked


# --- keeping one of each group ------------------------------------------------


def test_one_row_of_each_component_stays(spark):
    r = random.Random(4)
    one, two, three = (prose(r, 200, 1 << 30) for _ in range(3))
    rows = [(5, one), (5, two), (7, one), (None, one), (None, three), (None, three), (2, two), (9, None), (8, ""), (5, one), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", f"s{n}", n) for n, (i, t) in enumerate(rows)], DOCS).withColumn("fp", F.lit("mine"))
    got = simhash.keep_one(docs)
    assert got.columns == docs.columns
    found = sorted(((x.doc_id, x.text) for x in got.collect()), key=str)
    assert found == sorted([(5, one), (2, two), (None, three), (8, "")], key=str)
    assert sorted(map(str, got.collect())) == sorted(map(str, simhash.keep_one(docs.repartition(7)).collect()))
    assert simhash.keep_one(docs.where("false")).count() == 0


def test_a_cluster_needs_a_shared_folder():
    from lodestone.llm import shared

    class Unset:
        def get(self, key, default=None):
            return None

    class Context:
        master, getConf, getCheckpointDir = "spark://host:7077", lambda self: Unset(), lambda self: None

    class Session:
        conf, sparkContext = Unset(), Context()

    with pytest.raises(ValueError, match="checkpoint"):
        shared.shared_dir(Session())


# --- queries and pipeline -----------------------------------------------------


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows_as_sql(spark, duck, name):
    df = queries.queries()[name](spark, SMALL)
    got = duck.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in got.description]
    assert sorted(map(str, (tuple(r) for r in df.select(columns).collect()))) == sorted(map(str, got.fetchall()))


def test_stages_take_odd_tables(spark, tmp_path):
    """Null and repeated ids, null texts, no labels, no benchmark, and nothing at all."""
    import corpus_pipeline as P

    r = random.Random(20)
    good = [prose(r, 90, 1 << 30) for _ in range(4)]
    rows = [(1, good[0]), (1, good[1]), (None, good[2]), (None, good[2]), (None, None), (4, ""), (5, "too short"), (6, good[0]), (7, good[3]), (7, good[3])]
    docs = spark.createDataFrame([(i, t, "en", None if n % 2 else "s", 0) for n, (i, t) in enumerate(rows)], DOCS)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out, counts = docs, []
    for name, stage in P.STAGES:
        last = out
        out = stage(spark, out, str(tmp_path))
        counts.append(out.count())
        assert name == "token_files" or out.columns == docs.columns
        assert stage(spark, docs.where("false"), str(tmp_path)).count() == 0
    assert counts[:3] == [7, 4, 4] and counts[3] == counts[4] == last.count()
    kept = P.near_dedup(spark, P.quality_rules(spark, docs, str(tmp_path)), str(tmp_path))
    assert sorted(((x.doc_id, x.text) for x in kept.collect()), key=str) == sorted([(1, good[0]), (1, good[1]), (None, good[2]), (7, good[3])], key=str)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert P.run(spark, str(tmp_path)).count() == counts[-1]


def test_pipeline_is_its_stages_by_brute_force(spark):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = {n: f for n, f in P.STAGES}
    kept = rows["quality_rules"](spark, docs, SMALL)
    assert kept.columns == docs.columns and all(not brute_quality(r.text)[5] for r in kept.collect())
    texts = [(r.doc_id, r.text) for r in kept.orderBy("doc_id").collect()]
    fps = [brute_fingerprint(t) for _, t in texts]
    roots = brute_components(len(fps), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 2)
    deduped = rows["near_dedup"](spark, kept, SMALL)
    assert sorted(r.doc_id for r in deduped.collect()) == sorted({texts[i][0] for i in roots})
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    own = deduped.orderBy("doc_id").collect()
    want = [r.doc_id for r, (n, hit, _) in zip(own, brute_contamination([r.text for r in own], items), strict=True) if not (hit and 20 * hit >= n)]
    clean = rows["decontamination"](spark, deduped, SMALL)
    assert sorted(r.doc_id for r in clean.collect()) == want
    mixed = rows["mixture"](spark, clean, SMALL)
    copies = Counter(r.doc_id for r in mixed.collect())
    assert mixed.columns == docs.columns and set(copies) <= set(want) and max(copies.values()) <= 3
    final = rows["token_files"](spark, mixed, SMALL).collect()
    assert Counter(r.doc_id for r in final) == copies
    assert hashlib.sha256(str(sorted(map(str, P.run(spark, SMALL).collect()))).encode()).hexdigest() == hashlib.sha256(str(sorted(map(str, final))).encode()).hexdigest()


def test_late_comparison_is_dealt_to_all_partitions(spark):
    """Rows that a join has dealt by key are dealt again: else adaptive execution puts the join's small partitions together to one task."""
    rows = spark.range(400).select(F.col("id").alias("key"), *[F.lit("" if t == "binary" else 0).cast(t).alias(n) for n, t in (x.split() for x in passage_dedup._ROW.split(", ")[1:])])
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        joined = rows.join(spark.range(400).select(F.col("id").alias("key")), "key")
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        assert passage_dedup._compared(joined, 46, 0.8, None).rdd.getNumPartitions() == parts > 1
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_may_shift_keeps_all_pairs_that_shifted_links():
    rng, width, left, right = np.random.default_rng(5), 20, [], []
    for _ in range(600):
        x = rng.integers(1, 60_000, 2 * width - 1).astype(np.uint16)
        y, n = x.copy(), int(rng.integers(0, 4))
        for _ in range(n):
            at = int(rng.integers(0, len(y)))
            y = np.insert(y, at, 7)[: len(y)] if rng.random() < 0.5 else np.append(np.delete(y, at), 9).astype(np.uint16)
        if rng.random() < 0.6:  # unlike beyond some place
            y[int(rng.integers(10, len(y))) :] = 3
        if rng.random() < 0.2:  # two parts in another order
            y = np.roll(y, 5)
        if rng.random() < 0.3:  # marks that occur again
            x[::5] = 11
        left.append(x)
        right.append(y)
    left, right = np.array(left), np.array(right)
    may = alike.may_shift(left, right, width, 0.8)
    links = np.array([alike.shifted(x, y, width, 0.8) is not None for x, y in zip(left, right, strict=True)])
    assert 50 < links.sum() < 550 and not (links & ~may).any() and (may & ~links).sum() < 0.2 * (~links).sum()


def test_large_keys_are_compared_in_little_memory(monkeypatch):
    import tracemalloc

    rng = np.random.default_rng(3)
    x = rng.integers(1, 65536, (1 << 14, 91)).astype(np.uint16)
    y = np.where(rng.random(x.shape) < rng.random((len(x), 1)) * 0.1, rng.integers(1, 65536, x.shape), x).astype(np.uint16)
    tracemalloc.start()
    got = alike.aligned(x, y, 46, 0.8)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 25e6
    few = [alike.aligned(x[i : i + 1], y[i : i + 1], 46, 0.8) for i in range(0, len(x), 997)]
    assert [tuple(int(v[i]) for v in got) for i in range(0, len(x), 997)] == [tuple(int(v[0]) for v in f) for f in few]
    # Pairs that are forgotten are compared again, with the same links.
    group, rows = np.zeros(40, np.int64), y[:1].repeat(40, 0)
    rows[rng.random(rows.shape) < 0.1] = 7
    want = alike.links(group, np.arange(40), rows, 46, 0.8)[0]
    monkeypatch.setattr(alike, "KNOWN", 10)
    assert np.array_equal(alike.links(group, np.arange(40), rows, 46, 0.8)[0], want) and len(want)
