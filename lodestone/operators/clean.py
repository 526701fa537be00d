"""Profiling, cleaning, imputation, outliers, scaling, discretisation of a catalogue.

Group statistics are joined back as small aggregates instead of windows: the
aggregate is partial before its shuffle, so a type or genre that holds most
rows is no hot partition, and the rows themselves do not move.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import scalar as S
from lodestone.sources.files import scratch_table

TYPES = ("ECONOMY", "STANDARD", "PROMO", "SMALL", "MEDIUM", "LARGE")


def normalise_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip().lower() for c in df.columns])


def first_by_key(df: DataFrame, key: str, order: Sequence[str | Column]) -> DataFrame:
    """One row per key: the first in the given order, which must be total."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows, and how many of them repeat another."""
    n = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("n"))
    return n.agg(F.sum("n").cast("long").alias("n_rows"), F.sum(F.col("n") - 1).cast("long").alias("n_duplicates"))


def null_profile(df: DataFrame) -> DataFrame:
    """(column_name, n_null, pct_null) in one pass."""
    row = df.agg(F.count(F.lit(1)).alias("__n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    long = row.unpivot("__n", df.columns, "column_name", "n_null")
    return long.select("column_name", "n_null", F.round(100 * F.col("n_null") / F.greatest("__n", F.lit(1)), 4).alias("pct_null"))


def fill_all(df: DataFrame, group: str, how: Mapping[str, str]) -> DataFrame:
    """Nulls of several columns filled with the group's median or mean, then with that of the whole column.

    After a fill by means the overall mean is taken over the filled column.
    One rollup has the groups' statistics and the overall ones, so the rows are
    read once for all statistics and once to be filled.
    """
    stats = [({"median": F.median, "mean": F.avg}[h])(c).alias(f"{c}__by") for c, h in how.items()]
    sums = [x for c, h in how.items() if h == "mean" for x in (F.sum(c).alias(f"{c}__sum"), F.count(c).alias(f"{c}__n"))]
    table = df.rollup(group).agg(F.grouping_id().alias("__gid"), F.count(F.lit(1)).alias("__rows"), *stats, *sums)
    by = table.where("__gid = 0").select(F.col(group).alias("__group"), *[f"{c}__by" for c in how])

    def overall(c: str, h: str) -> Column:
        if h == "median":
            return F.max(F.when(F.col("__gid") == 1, F.col(f"{c}__by")))
        own = (F.col("__gid") == 0) & (F.col(f"{c}__n") > 0)
        filled = F.col(f"{c}__sum") + (F.col("__rows") - F.col(f"{c}__n")) * F.col(f"{c}__by")
        return F.sum(F.when(own, filled)) / F.nullif(F.sum(F.when(own, F.col("__rows"))), F.lit(0))

    over = table.agg(*[overall(c, h).alias(f"{c}__all") for c, h in how.items()])
    joined = df.join(by, df[group].eqNullSafe(by["__group"]), "left").drop("__group").join(F.broadcast(over))
    filled = joined.withColumns({c: F.coalesce(c, f"{c}__by", f"{c}__all") for c in how})
    return filled.drop(*[f"{c}__{k}" for c in how for k in ("by", "all")])


def fill_by_group(df: DataFrame, column: str, group: str, how: str = "median") -> DataFrame:
    """fill_all for one column."""
    return fill_all(df, group, {column: how})


def clean(titles: DataFrame, types: Sequence[str] | None = None) -> DataFrame:
    """The clean catalogue: no gaps, tags, flags, logarithms and ratios. One row per item_id, the first by name."""
    df = first_by_key(normalise_names(titles), "item_id", ["name", "members"])
    df = df.withColumns({"genre": S.or_unknown("genre"), "type": S.or_unknown("type"), "episodes": S.number("episodes")})
    if types:
        df = df.withColumn("type", S.in_list("type", types))
    df = fill_all(df, "type", {"episodes": "median", "rating": "mean"}).withColumn("rating", F.round("rating", 2))
    df = df.withColumn("tags", S.tags("genre"))
    size = F.size("tags")
    return df.withColumns({
        "genre_count": size,
        "primary_genre": S.first_or_unknown("tags"),
        "is_multi_genre": (size > 1).cast("int"),
        "members_log": S.log1p("members"),
        "episodes_log": S.log1p("episodes"),
        "members_per_episode": S.divide("members", "episodes"),
        "engagement_index": F.col("rating") * S.log1p("members"),
        "members_band": S.right_closed("members", S.MEMBER_BANDS),
        "episodes_band": S.right_closed("episodes", S.EPISODE_BANDS),
        "score_tier": S.tier("rating"),
    })


def fences(df: DataFrame, columns: Sequence[str], factor: float = 1.5) -> DataFrame:
    """One row: for each column c the fences c__low and c__high by the quartiles, exact and interpolated."""
    q = df.agg(*[F.percentile(c, F.array(F.lit(0.25), F.lit(0.75))).alias(c) for c in columns])
    low = [(F.get(c, F.lit(0)) - factor * (F.get(c, F.lit(1)) - F.get(c, F.lit(0)))).alias(f"{c}__low") for c in columns]
    high = [(F.get(c, F.lit(1)) + factor * (F.get(c, F.lit(1)) - F.get(c, F.lit(0)))).alias(f"{c}__high") for c in columns]
    return q.select(*low, *high)


def outlier_report(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, q1, q3, low, high, n_outliers, pct_outliers, skewness) of each column; bias-corrected skewness."""
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], list(columns), "column_name", "x").where("x is not null")
    q = long.groupBy("column_name").agg(F.percentile("x", F.array(F.lit(0.25), F.lit(0.75))).alias("q"), F.count("x").alias("n"), F.skewness("x").alias("g"))
    q = q.select("column_name", F.get("q", F.lit(0)).alias("q1"), F.get("q", F.lit(1)).alias("q3"), "n", "g")
    q = q.withColumns({"low": F.col("q1") - 1.5 * (F.col("q3") - F.col("q1")), "high": F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))})
    out = long.join(F.broadcast(q.select("column_name", "low", "high")), "column_name")
    counted = out.groupBy("column_name").agg(F.count_if((F.col("x") < F.col("low")) | (F.col("x") > F.col("high"))).alias("n_outliers"))
    skew = F.when(F.col("n") > 2, F.col("g") * F.sqrt(F.col("n") * (F.col("n") - 1)) / (F.col("n") - 2))
    return q.join(counted, "column_name").select(
        "column_name", *[F.round(c, 6).alias(c) for c in ("q1", "q3", "low", "high")], "n_outliers",
        F.round(100 * F.col("n_outliers") / F.col("n"), 4).alias("pct_outliers"), F.round(skew, 6).alias("skewness"),
    )


def flag_outliers(df: DataFrame, columns: Sequence[str], small: str | None = "members", least: int = 50) -> DataFrame:
    """is_outlier: 1 beyond a fence of any column, or where `small` is under `least`."""
    beyond = F.lit(False)
    for c in columns:
        beyond = beyond | F.coalesce((F.col(c) < F.col(f"{c}__low")) | (F.col(c) > F.col(f"{c}__high")), F.lit(False))
    if small:
        beyond = beyond | F.coalesce(F.col(small) < least, F.lit(False))
    cut = fences(df, columns)
    return df.join(F.broadcast(cut)).withColumn("is_outlier", beyond.cast("int")).drop(*cut.columns)


def scale(df: DataFrame, columns: Sequence[str], digits: int = 6) -> DataFrame:
    """c_minmax and c_zscore (population deviation) of each column, from one aggregate of all."""
    stats = df.agg(*[f(c).alias(f"{c}__{n}") for c in columns for n, f in (("min", F.min), ("max", F.max), ("mean", F.avg), ("std", F.stddev_pop))])
    joined = df.join(F.broadcast(stats))
    added = {}
    for c in columns:
        added[f"{c}_minmax"] = F.round(S.min_max(c, F.col(f"{c}__min"), F.col(f"{c}__max")), digits)
        added[f"{c}_zscore"] = F.round(S.z_score(c, F.col(f"{c}__mean"), F.col(f"{c}__std")), digits)
    return joined.withColumns(added).drop(*stats.columns)


def quantile_edges(df: DataFrame, columns: Sequence[str], bins: int = 10) -> DataFrame:
    """(column_name, edges): distinct quantiles rounded to 6 places; few distinct values: the midpoints between them."""
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], list(columns), "column_name", "x").where("x is not null")
    at = F.array(*[F.lit(i / bins) for i in range(bins + 1)])
    # The few values themselves are wanted only where there are at most `bins`: counts of values first, then the smallest ones.
    values = long.groupBy("column_name", "x").agg(F.count(F.lit(1)).alias("c"))
    few = values.groupBy("column_name").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= bins).select(F.col("column_name").alias("k"))
    lists = values.join(F.broadcast(few), values["column_name"] == few["k"]).groupBy("column_name").agg(F.array_sort(F.collect_list("x")).alias("v"))
    middle = F.transform(F.sequence(F.lit(1), F.size("v") - 1), lambda i: F.round((F.get("v", i - 1) + F.get("v", i)) / 2, 6))
    inner = F.when(F.size("v") > 1, middle).otherwise(F.array().cast("array<double>"))
    lists = lists.select("column_name", F.concat(F.array(F.get("v", F.lit(0))), inner, F.array(F.get("v", F.size("v") - 1))).alias("few"))
    edges = long.groupBy("column_name").agg(F.percentile("x", at).alias("q"))
    edges = edges.withColumn("q", F.array_distinct(F.transform("q", lambda e: F.round(e, 6))))
    return edges.join(lists, "column_name", "left").select("column_name", F.coalesce("few", "q").alias("edges"))


def ordinal_codes(df: DataFrame, column: str) -> DataFrame:
    """(value, code): the distinct values in order, numbered from 0.

    Values are dealt by range; each range is numbered by itself, from the sum of
    the counts of those before it on. So no task sorts all values.
    """
    values = df.where(F.col(column).isNotNull()).select(F.col(column).cast("string").alias("value")).distinct()
    dealt = scratch_table(values.repartitionByRange("value").withColumn("range", F.spark_partition_id()))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, 0)  # one row for each range
    firsts = dealt.groupBy("range").agg(F.count(F.lit(1)).alias("n")).select("range", (F.sum("n").over(before) - F.col("n")).alias("first"))
    place = F.row_number().over(Window.partitionBy("range").orderBy("value")) - 1
    return dealt.withColumn("place", place).join(F.broadcast(firsts), "range").select("value", (F.col("first") + F.col("place")).cast("int").alias("code"))


def encode(df: DataFrame, column: str, codes: DataFrame, to: str, unseen: int = -1) -> DataFrame:
    """df with the code of each value; `unseen` for values without one."""
    k = codes.select(F.col("value").alias("__v"), F.col("code").alias("__c"))
    return df.join(k, df[column].cast("string") == k["__v"], "left").withColumn(to, F.coalesce("__c", F.lit(unseen))).drop("__v", "__c")


def one_hot(df: DataFrame, column: str, values: Sequence[str], prefix: str) -> DataFrame:
    return df.withColumns({f"{prefix}{v}": F.coalesce(F.col(column) == v, F.lit(False)).cast("int") for v in values})


def drop_rare(df: DataFrame, label: str, least: int = 25) -> DataFrame:
    """Rows whose label at least `least` rows have."""
    common = df.groupBy(label).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= least).select(F.col(label).alias("__l"))
    return df.join(common, df[label] == common["__l"], "left_semi")


def _rank_in_class(df: DataFrame, key: str, stratify: str, seed: int) -> DataFrame:
    """df with __rank (from 0, by the seeded hash) and __n of each row's class.

    The hash's first digits cut a class into ranges; a running sum over the few
    ranges' counts gives each range's first rank. So no task sorts a whole class.
    """
    h = S.seeded(key, seed)
    own = df.withColumns({"__h": h, "__range": F.substring(h, 1, 3)})
    counts = own.groupBy(stratify, "__range").agg(F.count(F.lit(1)).alias("__c"))
    over = Window.partitionBy(stratify).orderBy("__range")
    firsts = counts.select(
        F.col(stratify).alias("__k"), F.col("__range").alias("__r"),
        (F.sum("__c").over(over.rowsBetween(Window.unboundedPreceding, 0)) - F.col("__c")).alias("__first"), F.sum("__c").over(Window.partitionBy(stratify)).alias("__n"),
    )
    inner = F.row_number().over(Window.partitionBy(stratify, "__range").orderBy("__h", key)) - 1
    joined = own.withColumn("__inner", inner).join(firsts, own[stratify].eqNullSafe(firsts["__k"]) & (own["__range"] == firsts["__r"]))
    return joined.withColumn("__rank", F.col("__first") + F.col("__inner"))


def split(df: DataFrame, key: str, test: float = 0.2, validation: float = 0.25, stratify: str | None = None, seed: int = 42) -> DataFrame:
    """df with `split`: test, validation (of the rest) or train, by the rank of a seeded hash, within each class if named.

    Without a class the hash itself is cut at its quantile, so that nothing is
    ranked.
    """
    names = df.columns
    if stratify:
        df = _rank_in_class(df, key, stratify, seed)
        place = F.col("__rank") / F.col("__n")
    else:
        place = F.conv(F.substring(S.seeded(key, seed), 1, 8), 16, 10).cast("double") / float(1 << 32)
    part = F.when(place < test, "test").when(place < test + (1 - test) * validation, "validation").otherwise("train")
    return df.withColumn("split", part).select(*[c for c in names if c != "split"], "split")


def folds(df: DataFrame, key: str, k: int = 5, stratify: str | None = None, seed: int = 42) -> DataFrame:
    """df with `fold` 0 to k - 1: stratified by rank in the class, else by the hash."""
    names = [c for c in df.columns if c != "fold"]
    if stratify:
        return _rank_in_class(df, key, stratify, seed).withColumn("fold", (F.col("__rank") % k).cast("int")).select(*names, "fold")
    return df.withColumn("fold", (F.conv(F.substring(S.seeded(key, seed), 1, 8), 16, 10).cast("long") % k).cast("int"))


def sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows without replacement: those with the smallest seeded hashes (a distributed top-k, no global sort)."""
    return df.orderBy(S.seeded(key, seed), key).limit(n)
