"""Aggregates of ratings: items, users, segments, favourites, baskets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LIKED, DISLIKED = 8, 4


def scored(ratings: DataFrame) -> DataFrame:
    """Without the sentinel -1 of what was seen but not rated."""
    return ratings.where("rating > 0")


def _spread() -> list:
    return [
        F.count(F.lit(1)).alias("n_ratings"), F.round(F.avg("rating"), 4).alias("mean_rating"),
        F.round(F.coalesce(F.stddev_samp("rating"), F.lit(0.0)), 4).alias("std_rating"), F.max("rating").alias("max_rating"), F.min("rating").alias("min_rating"),
    ]


def item_stats(ratings: DataFrame) -> DataFrame:
    """Per item: count, mean, sample deviation (0 for one rating), extremes."""
    return scored(ratings).groupBy("item_id").agg(*_spread())


def user_profile(ratings: DataFrame) -> DataFrame:
    """Per user also likes, dislikes, their share, range, and critic score (mean plus deviation)."""
    g = scored(ratings).groupBy("user_id").agg(*_spread(), F.count_if(F.col("rating") >= LIKED).alias("n_liked"), F.count_if(F.col("rating") <= DISLIKED).alias("n_disliked"))
    return g.withColumns({
        "range_rating": F.col("max_rating") - F.col("min_rating"),
        "like_ratio": F.round(F.col("n_liked") / F.col("n_ratings"), 4),
        "critic_score": F.round(F.col("mean_rating") + F.col("std_rating"), 4),
    })


def counters(ratings: DataFrame) -> DataFrame:
    return ratings.agg(
        F.count_if(F.col("rating") > 0).alias("n_scored"), F.count_if(F.col("rating") == -1).alias("n_unrated"),
        F.countDistinct(F.when(F.col("rating") > 0, F.col("item_id"))).alias("n_items"), F.countDistinct(F.when(F.col("rating") > 0, F.col("user_id"))).alias("n_users"),
    )


def favourites(ratings: DataFrame, titles: DataFrame, n: int = 12, liked: int = LIKED) -> DataFrame:
    """The n best liked items of each user: (user_id, rank, item_id, item, rating). Repeated ratings of an item count once, the best."""
    own = ratings.where(F.col("rating") >= liked).groupBy("user_id", "item_id").agg(F.max("rating").alias("rating"))
    w = Window.partitionBy("user_id").orderBy(F.desc("rating"), "item_id")
    top = own.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
    names = titles.select("item_id", F.col("name").alias("item"))
    return top.join(names, "item_id").select("user_id", "rank", "item_id", "item", "rating")


def user_baskets(favourites: DataFrame, least: int = 3) -> DataFrame:
    """(user_id, items): sorted distinct items of users that have `least` of them. Favourites bound a basket's size."""
    return favourites.groupBy("user_id").agg(F.array_sort(F.collect_set("item")).alias("items")).where(F.size("items") >= least)


def basket_stats(baskets: DataFrame, items: str = "items") -> DataFrame:
    return baskets.agg(F.count(F.lit(1)).alias("n_baskets"), F.round(F.avg(F.size(items)), 6).alias("mean_size"), F.max(F.size(items)).alias("max_size"))


def affinity(ratings: DataFrame, segments: DataFrame, titles: DataFrame, by: str = "primary_genre") -> DataFrame:
    """(segment, <by>, n, affinity): the true mean rating by segment and genre or type; unmatched rows drop out."""
    joined = scored(ratings).join(segments.select("user_id", "segment"), "user_id").join(titles.select("item_id", by), "item_id")
    return joined.groupBy("segment", by).agg(F.count(F.lit(1)).alias("n"), F.avg("rating").alias("affinity"))


def global_affinity(affinity: DataFrame, by: str = "primary_genre") -> DataFrame:
    """The unweighted mean of the segments' means."""
    return affinity.groupBy(by).agg(F.avg("affinity").alias("overall"))


def segment_profile(affinity: DataFrame, by: str = "primary_genre") -> DataFrame:
    """Segment means beside the overall ones, and their difference."""
    joined = affinity.join(global_affinity(affinity, by), by)
    return joined.select("segment", by, F.round("affinity", 6).alias("affinity"), F.round("overall", 6).alias("overall"), F.round(F.col("affinity") - F.col("overall"), 6).alias("delta"))


def value_counts(df: DataFrame, column: str, domain: DataFrame) -> DataFrame:
    """(value, ord, n) for every value of a domain table (value, ord), 0 for those that don't occur."""
    n = df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return domain.join(n, "value", "left").select("value", "ord", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def histogram(df: DataFrame, column: str, bins: int, low: float, high: float) -> DataFrame:
    """(bin, n): bins of equal width from 1, as width_bucket has them; 0 and bins + 1 are what lies outside."""
    return df.where(F.col(column).isNotNull()).groupBy(F.width_bucket(F.col(column).cast("double"), F.lit(low), F.lit(high), F.lit(bins)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def five_numbers(df: DataFrame, column: str, by: str) -> DataFrame:
    q = F.percentile(column, F.array(*map(F.lit, (0.0, 0.25, 0.5, 0.75, 1.0))))
    names = ("minimum", "q1", "median", "q3", "maximum")
    return df.groupBy(by).agg(q.alias("q")).select(by, *[F.round(F.get("q", F.lit(i)), 6).alias(n) for i, n in enumerate(names)])


def class_moments(df: DataFrame, label: str, column: str) -> DataFrame:
    """Mean and sample deviation per class of the column's z-score (population deviation over all)."""
    stats = df.agg(F.avg(column).alias("__m"), F.stddev_pop(column).alias("__s"))
    z = F.when(F.col("__s") > 0, (F.col(column) - F.col("__m")) / F.col("__s")).otherwise(0.0)
    return df.join(F.broadcast(stats)).groupBy(label).agg(F.round(F.avg(z), 6).alias("z_mean"), F.round(F.coalesce(F.stddev_samp(z), F.lit(0.0)), 6).alias("z_std"))


def crosstab(df: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    """Counts by row and column value, 0 where none; the columns are those of `values`, in that order."""
    return df.groupBy(row).agg(*[F.count_if(F.col(column) == v).alias(v) for v in values])


def cube(df: DataFrame, a: str, b: str, measure: str) -> DataFrame:
    """An extension: all groupings of two columns, with counts and means."""
    return df.cube(a, b).agg(F.grouping_id().cast("int").alias("level"), F.count(F.lit(1)).alias("n"), F.round(F.avg(measure), 6).alias("mean"))
