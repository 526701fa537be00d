"""Row mutation on immutable tables, paging and search, checks of keys, summaries as (metric, value)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAGE_MOST = 50


class Conflict(ValueError):
    """A key that must be unique is there already."""


def insert(df: DataFrame, rows: DataFrame, key: str, required: Sequence[str] = (), unique: Sequence[str] = (), defaults: Mapping[str, object] | None = None) -> DataFrame:
    """df and the new rows, which get ids after the largest. Missing required values or repeated unique ones are errors."""
    for c in required:
        if c not in rows.columns or not rows.where(F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")).isEmpty():
            raise ValueError(f"{c} is required")
    for c, v in (defaults or {}).items():
        rows = rows.withColumn(c, F.coalesce(F.col(c), F.lit(v)) if c in rows.columns else F.lit(v))
    for c in unique:
        if not rows.join(df, c, "left_semi").isEmpty() or not rows.groupBy(c).count().where("count > 1").isEmpty():
            raise Conflict(f"{c} must be unique")
    first = df.agg(F.coalesce(F.max(key), F.lit(0)).alias("__first"))
    numbered = rows.drop(key).withColumn("__rn", F.row_number().over(Window.orderBy(*rows.drop(key).columns)))  # a request's rows: few
    new = numbered.join(F.broadcast(first)).withColumn(key, (F.col("__first") + F.col("__rn")).cast(df.schema[key].dataType)).drop("__first", "__rn")
    return df.unionByName(new, allowMissingColumns=True).select(df.columns)


def update(df: DataFrame, key: str, value, changes: Mapping[str, object], allowed: Sequence[str]) -> DataFrame:
    """df with the allowed, non-null changes made in the row of that key."""
    on = F.col(key) == value
    return df.withColumns({c: F.when(on, F.lit(v)).otherwise(F.col(c)).cast(df.schema[c].dataType) for c, v in changes.items() if c in allowed and v is not None and c in df.columns})


def delete(df: DataFrame, key: str, value) -> DataFrame:
    return df.where(~F.col(key).eqNullSafe(F.lit(value)))


def page(df: DataFrame, order: Sequence[str | Column], number: int, size: int) -> DataFrame:
    """One page in a total order; sizes are clamped to 1..50, pages to 1 and up."""
    size = min(max(size, 1), PAGE_MOST)
    return df.orderBy(*order).offset((max(number, 1) - 1) * size).limit(size)


def search(df: DataFrame, text: str, columns: Sequence[str], **equal) -> DataFrame:
    """Rows with the text in any of the columns, whatever its case, and the given values; % and _ in it are plain."""
    pattern = "%" + text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") + "%"
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.col(c).ilike(pattern)
    for c, v in equal.items():
        hit = hit & (F.col(c) == v)
    return df.where(hit)


def orphans(df: DataFrame, column: str, other: DataFrame, key: str) -> DataFrame:
    """Rows whose reference isn't there; null refers to nothing."""
    keys = other.select(F.col(key).alias("__k"))
    return df.where(F.col(column).isNotNull()).join(keys, df[column] == keys["__k"], "left_anti")


def duplicates(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def flatten(payload, prefix: str = "") -> list[tuple[str, str]]:
    """(path, value) of a nested result: dotted names, places in brackets, decimals with six places, None as ""."""
    if isinstance(payload, Mapping):
        return [x for k, v in payload.items() for x in flatten(v, f"{prefix}.{k}" if prefix else str(k))]
    if isinstance(payload, list | tuple):
        return [x for i, v in enumerate(payload) for x in flatten(v, f"{prefix}[{i}]")]
    if payload is None:
        return [(prefix, "")]
    if isinstance(payload, bool):
        return [(prefix, str(payload))]
    return [(prefix, f"{payload:.6f}".rstrip("0").rstrip(".") if isinstance(payload, float) else str(payload))]


def summary(spark, payload) -> DataFrame:
    return spark.createDataFrame(flatten(payload), "metric string, value string")


def merge_summary(old: DataFrame, new: DataFrame) -> DataFrame:
    """Metrics of both; new ones replace old ones of the same name."""
    return old.join(new.select("metric"), "metric", "left_anti").unionByName(new)


def melt(df: DataFrame, ids: Sequence[str], values: Sequence[str]) -> DataFrame:
    return df.unpivot(list(ids), list(values), "variable", "value")
