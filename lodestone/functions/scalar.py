"""Scalar expressions: lists in strings, guards, binning, scaling, labels. All are built-in functions, inside code generation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

UNKNOWN = "Unknown"

#: Edges and names of the tiers [a, b) and of the bands (a, b].
TIERS = ((6.1, "Low"), (6.8, "Medium"), (7.3, "High"), (11.0, "Top"))
MEMBER_BANDS = ((100, "tiny"), (1_000, "small"), (10_000, "medium"), (100_000, "large"), (1_000_000_000, "huge"))
EPISODE_BANDS = ((1, "single"), (12, "short"), (26, "mid"), (52, "long"), (1_000_000, "series"))


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tags(c: str | Column) -> Column:
    """Parts of a comma list, trimmed, without empty ones and "Unknown"."""
    return F.filter(F.transform(F.split(F.coalesce(col(c), F.lit("")), ","), lambda t: F.trim(t)), lambda t: (t != "") & (t != UNKNOWN))


def first_or_unknown(array: str | Column) -> Column:
    return F.coalesce(F.try_element_at(col(array), F.lit(1)), F.lit(UNKNOWN))


def has_text(c: str | Column, what: str) -> Column:
    """1 if the text holds `what` anywhere, upper and lower case apart; else 0."""
    return F.coalesce(F.contains(col(c), F.lit(what)), F.lit(False)).cast("int")


def has_tag(array: str | Column, what: str) -> Column:
    """1 if `what` is one of the tags as a whole."""
    return F.array_contains(col(array), what).cast("int")


def or_unknown(c: str | Column) -> Column:
    return F.trim(F.coalesce(col(c), F.lit(UNKNOWN)))


def in_list(c: str | Column, allowed: Sequence[str]) -> Column:
    return F.when(col(c).isin(*allowed), col(c)).otherwise(F.lit(UNKNOWN))


def number(c: str) -> Column:
    """Lenient cast: null for what is no number."""
    return F.expr(f"try_cast({c} as double)")


def divide(x: str | Column, y: str | Column, least: float = 1.0) -> Column:
    return col(x) / F.greatest(col(y), F.lit(least))


def clip(c: str | Column, low, high) -> Column:
    return F.least(F.greatest(col(c), F.lit(low)), F.lit(high))


def log1p(c: str | Column) -> Column:
    return F.log1p(F.greatest(col(c), F.lit(0)))


def finite(c: str | Column) -> Column:
    """0 for null, NaN and the infinities."""
    x = col(c)
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), F.lit(0.0)).otherwise(x)


def right_closed(c: str | Column, bands: Sequence[tuple[float, str]], above: float = -1) -> Column:
    """The band (a, b] of a value; null outside."""
    x, out = col(c), F.lit(None).cast("string")
    for edge, name in reversed(bands):
        out = F.when(x <= edge, F.lit(name)).otherwise(out)
    return F.when(x > above, out)


def left_closed(c: str | Column, bands: Sequence[tuple[float, str]], least: float = 0) -> Column:
    """The band [a, b) of a value; null outside."""
    x, out = col(c), F.lit(None).cast("string")
    for edge, name in reversed(bands):
        out = F.when(x < edge, F.lit(name)).otherwise(out)
    return F.when(x >= least, out)


def tier(c: str | Column) -> Column:
    return left_closed(c, TIERS)


def min_max(c: str | Column, low: Column, high: Column) -> Column:
    """Scaled to 0..1; 0 for a constant column."""
    return F.when(high > low, (col(c) - low) / (high - low)).otherwise(F.lit(0.0))


def z_score(c: str | Column, mean: Column, std: Column) -> Column:
    """With the population's deviation; 0 for a constant column."""
    return F.when(std > 0, (col(c) - mean) / std).otherwise(F.lit(0.0))


def bin_of(c: str | Column, edges: Column) -> Column:
    """The number of the bin of sorted edges that holds the value, from 0, the outer ones open."""
    below = F.size(F.filter(edges, lambda e: e <= col(c)))
    return F.least(F.greatest(below - 1, F.lit(0)), F.greatest(F.size(edges) - 2, F.lit(0)))


def show_number(c: str | Column) -> Column:
    """Whole numbers as such, others with three significant digits."""
    x = col(c)
    return F.when(x == F.floor(x), F.format_string("%d", x.cast("long"))).otherwise(F.format_string("%.3g", x))


def user_label(user: str, n: str, mean: str, segment: str) -> Column:
    return F.format_string("%d - %d items rated - mean %s - segment %d", col(user).cast("long"), col(n).cast("long"), F.format_number(col(mean), 2), col(segment).cast("long"))


def pretty(items: str | Column) -> Column:
    """Items of a rule side as text: sorted, without the tag prefix, underscores as spaces."""
    return F.array_join(F.array_sort(F.transform(col(items), lambda i: F.replace(F.regexp_replace(i, "^g_", ""), F.lit("_"), F.lit(" ")))), ", ")


def coerce(c: str) -> Column:
    """What a text value is when read back: (kind, number, flag); blank and null-like texts are 'null'."""
    low = F.lower(F.trim(F.col(c)))
    whole, real = F.expr(f"try_cast({c} as bigint)"), F.expr(f"try_cast({c} as double)")
    kind = F.when(F.col(c).isNull() | low.isin("", "nan", "none", "null"), "null").when(low.isin("true", "false"), "bool")
    kind = kind.when(F.col(c).rlike(r"^[+-]?[0-9]+$") & whole.isNotNull(), "int").when(real.isNotNull(), "float").otherwise("text")
    return F.struct(kind.alias("kind"), F.when(kind.isin("int", "float"), real).alias("number"), F.when(kind == "bool", low == "true").alias("flag"))


def seeded(key: str | Column, seed: int = 42) -> Column:
    """A pseudo-random text by which rows are sampled, split and permuted: the same on every engine."""
    return F.md5(F.concat(F.lit(f"{seed}:"), col(key).cast("string")))
