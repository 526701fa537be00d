"""Live updates: payloads to rows, guarded upserts with field-level diffs, staleness, state and history."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAYLOAD = "mal_id bigint, score double, members bigint, scored_by bigint, favorites bigint, episodes bigint, type string, genres array<struct<name:string>>, themes array<struct<name:string>>, demographics array<struct<name:string>>"
FIELDS = ("genre", "type", "episodes", "rating", "members")


def _names(c: str) -> Column:
    return F.array_distinct(F.filter(F.transform(F.coalesce(F.col(c), F.array().cast("array<struct<name:string>>")), lambda g: F.trim(g["name"])), lambda n: n.isNotNull() & (n != "")))


def _positive(c: str) -> Column:
    return F.when(F.col(c) > 0, F.col(c))


def normalise(payloads: DataFrame, json: str = "json") -> DataFrame:
    """Rows of JSON texts: names of the three lists in order, each list without repeats; numbers only if positive. Malformed: all null."""
    p = payloads.withColumn("__p", F.from_json(json, PAYLOAD, {"mode": "PERMISSIVE"})).select("__p.*")
    genre = F.concat(_names("genres"), _names("themes"), _names("demographics"))
    return p.select(
        F.col("mal_id").alias("item_id"), F.nullif(F.array_join(genre, ", "), F.lit("")).alias("genre"), F.trim("type").alias("type"),
        _positive("episodes").cast("string").alias("episodes"), _positive("score").alias("rating"), F.when(F.col("members") >= 0, F.col("members")).alias("members"),
        _positive("scored_by").alias("scored_by"), _positive("favorites").alias("favorites"),
    )


def valid(field: str, c: Column, types: Sequence[str]) -> Column:
    """Whether a new value may replace an old one."""
    ok = {
        "episodes": F.expr("try_cast(new_episodes as bigint)") > 0,
        "members": c >= 0,
        "rating": (c > 0) & (c <= 10),
        "type": c.isin(*types),
        "genre": F.trim(c) != "",
    }[field]
    return F.coalesce(ok, F.lit(False))


def _matched(titles: DataFrame, updates: DataFrame, types: Sequence[str], how: str) -> DataFrame:
    new = updates.select(F.col("item_id").alias("new_id"), *[F.col(f).alias(f"new_{f}") for f in FIELDS if f in updates.columns], *[F.lit(None).cast(titles.schema[f].dataType).alias(f"new_{f}") for f in FIELDS if f not in updates.columns])
    j = titles.join(new, titles["item_id"] == new["new_id"], how)
    return j.withColumns({f"ok_{f}": valid(f, F.col(f"new_{f}"), types) & ~F.col(f"new_{f}").eqNullSafe(F.col(f)) for f in FIELDS})


def upsert(titles: DataFrame, updates: DataFrame, types: Sequence[str], allow_new: bool = False, default_name: str | None = None) -> DataFrame:
    """titles with valid changed fields taken from updates (one row per item_id); name never changes.

    Unknown ids are left out, or with allow_new and a name added. Applying the
    same updates again changes nothing.
    """
    j = _matched(titles, updates, types, "left")
    out = j.select("item_id", "name", *[F.when(F.col(f"ok_{f}"), F.col(f"new_{f}").cast(titles.schema[f].dataType)).otherwise(F.col(f)).alias(f) for f in FIELDS])
    if not allow_new:
        return out
    name = F.coalesce(F.col("name"), F.lit(default_name)) if "name" in updates.columns else F.lit(default_name)
    added = updates.join(titles.select("item_id"), "item_id", "left_anti").withColumn("__name", name).where("__name is not null")
    return out.unionByName(added.select("item_id", F.col("__name").cast("string").alias("name"), *[F.col(f).cast(titles.schema[f].dataType).alias(f) for f in FIELDS]))


def changes(titles: DataFrame, updates: DataFrame, types: Sequence[str]) -> DataFrame:
    """(item_id, field, old_value, new_value): what an upsert changes, one row per field."""
    j = _matched(titles, updates, types, "inner")
    each = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("old_value"), F.col(f"new_{f}").cast("string").alias("new_value"), F.col(f"ok_{f}").alias("ok")) for f in FIELDS])
    return j.select("item_id", F.inline(each)).where("ok").drop("ok")


def sync_counts(diff: DataFrame) -> DataFrame:
    """(field, n): how often each field changed."""
    return diff.groupBy("field").agg(F.count(F.lit(1)).alias("n"))


def fetch_all(ids: Sequence[int], fetch: Callable[[int], str]) -> tuple[list[tuple[int, str]], dict[int, str]]:
    """The payload texts of ids, and for those that failed the error's text: one failure does not end the others."""
    got, failed = [], {}
    for i in ids:
        try:
            got.append((i, fetch(i)))
        except Exception as e:  # whatever a source raises is that id's failure
            failed[i] = f"{type(e).__name__}: {e}"[:200]
    return got, failed


def sync(titles: DataFrame, payloads: DataFrame, types: Sequence[str], allow_new: bool = False) -> tuple[DataFrame, dict]:
    """titles after an upsert of JSON payloads (json), and the report: fetched, failed, changed rows, changes by field.

    A payload that isn't JSON, or has no id, is counted as failed and left out;
    of several of one id the last text in order counts.
    """
    rows = normalise(payloads)
    counts = rows.agg(F.count(F.lit(1)).alias("n"), F.count("item_id").alias("ok")).first()
    good = rows.where("item_id is not null").groupBy("item_id").agg(F.max(F.struct(*[F.col(c) for c in rows.columns if c != "item_id"])).alias("r")).select("item_id", "r.*")
    diff = changes(titles, good, types)
    fields = {r.field: r.n for r in sync_counts(diff).collect()}
    changed = diff.select("item_id").distinct().count()
    return upsert(titles, good, types, allow_new), {"fetched": counts.ok, "failed": counts.n - counts.ok, "changed": changed, "fields": fields}


def latest(state: DataFrame, new: DataFrame, key: str = "item_id", at: str = "fetched_at") -> DataFrame:
    """(key, at): the last writer wins, by partial aggregation."""
    return state.select(key, at).unionByName(new.select(key, at)).groupBy(key).agg(F.max(at).alias(at))


def stale(titles: DataFrame, state: DataFrame, cutoff: str | Column, key: str = "item_id", at: str = "fetched_at") -> DataFrame:
    """Titles without a fetch since the cutoff, given as a timestamp so that reruns agree."""
    limit = F.lit(cutoff).cast("timestamp_ntz") if isinstance(cutoff, str) else cutoff
    fresh = state.where(F.col(at) >= limit).select(key)
    return titles.join(fresh, key, "left_anti")


def select_ids(titles: DataFrame, state: DataFrame, ids: Sequence[int] | None = None, top: int | None = None, cutoff: str | None = None, limit: int | None = None) -> DataFrame:
    """(item_id): the given ids, or the top ones by members, or the stale ones, or all; then at most `limit`, in id order."""
    if ids is not None:
        out = titles.where(F.col("item_id").isin(*ids)).select("item_id")
    elif top is not None:
        out = titles.orderBy(F.desc("members"), "item_id").limit(top).select("item_id")
    elif cutoff is not None:
        out = stale(titles, state, cutoff).select("item_id")
    else:
        out = titles.select("item_id")
    return out.orderBy("item_id").limit(limit) if limit is not None else out


def iso(c: str | Column) -> Column:
    return F.date_format(F.col(c) if isinstance(c, str) else c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
