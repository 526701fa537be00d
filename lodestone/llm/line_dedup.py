"""Line dedup, with DataFrame operations only.

Occurrences of line keys, one for each document and key, are range-partitioned
by (hash, document, position): the document and the position are part of the
range, so a line that a third of all documents hold is spread over many
partitions. Within a partition they stand sorted, and one partial aggregate
streams over them and keeps for each key the number of documents and the first
occurrence. Only these small partial rows are then shuffled by key.

The result is not text but, for each document that loses a line, a compressed
keep bitmap: 64-bit words of kept lines, of which those with all lines kept are
left out. `apply_bitmaps` brings bitmaps and texts together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import ascii_lower, cut, strip_spaces, text_key

_NEWLINE = "\n"


def _split(c: Column) -> Column:
    return F.split(F.coalesce(c, F.lit("")), _NEWLINE, -1)


def _keys(c: Column) -> Column:
    """128-bit hash of each line's key, as (h, g); null for an empty key."""
    def one(line: Column) -> Column:
        key = strip_spaces(line)
        return F.when(F.length(key) >= 1, F.struct(F.xxhash64(key).alias("h"), F.xxhash64(F.lit(1), key).alias("g")))

    return F.transform(_split(ascii_lower(c)), one)


def occurrences(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, tk, h, g, pos): every line with a key; pos counts from 0 within its document."""
    rows = docs.select(F.col(doc_id).alias("doc"), text_key(F.col(text)).alias("tk"), F.posexplode_outer(_keys(F.col(text))).alias("pos", "key"))
    return rows.where("key is not null").select("doc", "tk", "key.h", "key.g", "pos")


def key_stats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(h, g, n_docs, doc, tk, pos): each key with its number of documents and its first occurrence."""
    placed = F.transform(_keys(F.col(text)), lambda k, i: F.struct(k["h"].alias("h"), k["g"].alias("g"), i.alias("pos")))
    # Outer generators: for the inner ones a filter on the arrays' size is pushed down and computes them twice.
    own = docs.select(F.col(doc_id).alias("doc"), text_key(F.col(text)).alias("tk"), F.sort_array(F.filter(placed, lambda k: k["h"].isNotNull())).alias("keys"))

    def new(k: Column, i: Column) -> Column:
        before = F.get("keys", i - 1)
        return (i == 0) | (before["h"] != k["h"]) | (before["g"] != k["g"])

    once = own.select("doc", "tk", F.filter("keys", new).alias("keys")).select("doc", "tk", F.inline_outer("keys")).where("pos is not null")
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = once.repartitionByRange(parts, "h", "g", "doc", "tk", "pos").sortWithinPartitions("h", "g", "doc", "tk", "pos")
    return ranged.groupBy("h", "g").agg(F.count(F.lit(1)).alias("n_docs"), F.min(F.struct("doc", "tk", "pos")).alias("first")).select("h", "g", "n_docs", "first.*")


def keep_bitmaps(docs: DataFrame, min_docs: int = 2, mode: str = "all", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, tk, n_dropped, keep): one row for each document that loses lines.

    mode "all": every line whose key at least min_docs documents hold goes, in
    every document. mode "first": of such keys the first occurrence, by
    document id and position, stays.
    keep: array of (word, bits), sorted by word; bit b of word w tells whether
    line 64 * w + b stays; words that keep all lines are left out.

    Every row counts as a document, rows with the same id too; rows with equal
    id and text share one bitmap. Null text is one empty line; lines with an
    empty key never go. An empty table gives an empty result. Columns besides
    the two named are ignored, whatever their names.
    """
    if mode not in ("all", "first"):
        raise ValueError(f"mode is all or first, not {mode!r}")
    # Cut off, the few keys and the lines meet in a plain join, whose hot keys are split, or which broadcasts if the keys measure small.
    doomed = cut(key_stats(docs, doc_id, text).where(F.col("n_docs") >= min_docs))
    occ = occurrences(docs, doc_id, text)
    if mode == "all":
        gone = occ.join(doomed.select("h", "g"), ["h", "g"])
    else:
        first = doomed.select("h", "g", F.struct("doc", "tk", "pos").alias("first"))
        gone = occ.join(first, ["h", "g"]).where(~F.struct("doc", "tk", "pos").eqNullSafe(F.col("first")))
    bit = F.expr("shiftleft(1L, pos % 64)")
    by_word = gone.groupBy("doc", "tk", F.expr("pos div 64").cast("int").alias("word")).agg(F.bit_or(bit).alias("bits"))
    return by_word.groupBy("doc", "tk").agg(
        F.sum(F.bit_count("bits")).cast("long").alias("n_dropped"),
        F.array_sort(F.collect_list(F.struct("word", F.bitwise_not("bits").alias("bits")))).alias("keep"),
    )


def dropped_positions(keep: Column) -> Column:
    """Positions of the lines that a keep bitmap drops, in order."""
    def of(w: Column) -> Column:
        bits = F.sequence(F.lit(0), F.lit(63))
        return F.transform(F.filter(bits, lambda b: F.getbit(w["bits"], b) == 0), lambda b: w["word"] * 64 + b)

    return F.flatten(F.transform(keep, of))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, doc_id: str = "doc_id", text: str = "text", to: str = "kept_text") -> DataFrame:
    """docs with n_lines, n_dropped and the kept lines joined by \\n. A document without a bitmap keeps all."""
    b = bitmaps.select(F.col("doc").alias("__doc"), F.col("tk").alias("__tk"), F.col("n_dropped").alias("__n"), F.col("keep").alias("__keep"))
    own = docs.withColumn("__key", text_key(F.col(text)))
    rows = own.join(b, own[doc_id].eqNullSafe(b["__doc"]) & (own["__key"] == b["__tk"]), "left")
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = rows.withColumn("__lines", _split(F.col(text)))
    n = F.size("__lines")
    stay = F.array_except(F.sequence(F.lit(0), n - 1), dropped_positions(F.col("__keep")))
    kept = F.when(F.col("__keep").isNull(), whole).otherwise(F.array_join(F.transform(stay, lambda i: F.get("__lines", i)), _NEWLINE))
    rows = rows.withColumns({"n_lines": n.cast("long"), "n_dropped": F.coalesce("__n", F.lit(0)).cast("long"), to: kept})
    return rows.drop("__doc", "__tk", "__n", "__keep", "__key", "__lines")
