"""A hybrid recommender: segment affinities, popularity, rule boosts, one projection for the score.

Small tables (affinities, type means, boosts) are joined as they are; Spark
broadcasts them if they measure small. The top rows come from a distributed
top-k.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import scalar as S

NEUTRAL = 7.0
MIN_MEMBERS = 1000
CHOSEN_BOOST, WATCHED_BOOST, BOOST_CAP = 0.8, 0.7, 10.0
#: Titles that are named in one request, at most.
MOST_NAMED = 1000


def rule_boosts(rules: DataFrame, watched: Sequence[str]) -> DataFrame:
    """(item, boost): the sum of lifts of rules whose antecedent text holds a watched title, by consequent item."""
    if len(watched) > MOST_NAMED:
        raise ValueError(f"{len(watched)} titles; {MOST_NAMED} at most")
    text = F.array_join("antecedent", ", ")
    fires = F.lit(False)
    for w in watched:
        fires = fires | F.contains(text, F.lit(w))
    return rules.where(fires).select(F.explode("consequent").alias("item"), "lift").groupBy("item").agg(F.sum("lift").alias("boost"))


def tags_of(titles: DataFrame, watched: Sequence[str]) -> DataFrame:
    """(genre): all tags of the named titles."""
    return titles.where(F.col("name").isin(*watched)).select(F.explode("tags").alias("genre")).distinct()


def boosted(affinity: DataFrame, genres: DataFrame, by: float) -> DataFrame:
    """(genre, affinity) with chosen genres raised, at most to 10; chosen ones without affinity start at 7."""
    g = genres.withColumn("__chosen", F.lit(True))
    joined = affinity.join(g, "genre", "full_outer")
    base = F.coalesce("affinity", F.lit(NEUTRAL))
    return joined.select("genre", F.when(F.col("__chosen"), F.least(base + by, F.lit(BOOST_CAP))).otherwise(base).alias("affinity"))


def score(candidates: DataFrame, affinity: DataFrame, type_affinity: DataFrame, type_means: DataFrame, boosts: DataFrame | None = None, exclude: Sequence[str] = ()) -> DataFrame:
    """candidates (item_id, name, primary_genre, type, rating, members) with affinity, prior and match score.

    z-scores and the median of members are taken over the candidates before the
    excluded names go. Missing affinities count as 7, a missing type mean as
    the title's own rating.
    """
    stats = candidates.agg(F.avg("rating").alias("__m"), F.stddev_pop("rating").alias("__s"), F.median("members").alias("__p"))
    a = affinity.select(F.col("genre").alias("__g"), F.col("affinity").alias("aff"))
    t = type_affinity.select(F.col("type").alias("__t"), F.col("affinity").alias("taff"))
    m = type_means.select(F.col("type").alias("__u"), F.col("mean").alias("tmean"))
    d = candidates.join(a, candidates["primary_genre"] == a["__g"], "left").join(t, candidates["type"] == t["__t"], "left").join(m, candidates["type"] == m["__u"], "left")
    if boosts is not None:
        b = boosts.select(F.col("item").alias("__i"), "boost")
        d = d.join(b, d["name"] == b["__i"], "left")
    else:
        d = d.withColumn("boost", F.lit(None).cast("double"))
    d = d.join(F.broadcast(stats))
    if exclude:
        d = d.where(~F.col("name").isin(*exclude))
    aff, taff = F.coalesce("aff", F.lit(NEUTRAL)), F.coalesce("taff", F.lit(NEUTRAL))
    z = S.z_score("rating", F.col("__m"), F.col("__s"))
    pop = (F.log1p("members") - F.log1p("__p")) / 5
    total = 0.30 * (aff - 7) + 0.18 * (taff - 7) + 0.20 * z + 0.18 * (F.col("rating") - F.coalesce("tmean", "rating")) + 0.14 * S.clip(pop, -1.0, 1.5)
    total = total + F.when(F.col("boost").isNotNull(), 0.05 * S.clip(F.col("boost") - 1.2, 0.0, 2.0)).otherwise(0.0)
    why = F.format_string("genre affinity %.2f, prior %.2f", aff, z)
    return d.select("item_id", "name", "primary_genre", "type", "rating", "members", F.round(total, 6).alias("match_score"), F.round(z, 6).alias("prior_z"), why.alias("why"))


def top(scored: DataFrame, n: int = 10) -> DataFrame:
    """The n best with their rank; ties by item_id. The window runs over n rows."""
    best = scored.orderBy(F.desc("match_score"), "item_id").limit(n)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("match_score"), "item_id")))


class Recommender:
    """Tables of a trained recommender, and the three ways to ask it."""

    def __init__(self, titles: DataFrame, genre_affinity: DataFrame, type_affinity: DataFrame, rules: DataFrame | None = None, min_members: int = MIN_MEMBERS):
        self.every, self.titles = titles, titles.where(F.col("members") >= min_members)
        self.genre, self.types, self.rules = genre_affinity, type_affinity, rules
        self.means = titles.groupBy("type").agg(F.avg("rating").alias("mean"))

    def _genre(self, segment: int | None) -> DataFrame:
        if segment is None:
            return self.genre.groupBy(F.col("primary_genre").alias("genre")).agg(F.avg("affinity").alias("affinity"))
        return self.genre.where(F.col("segment") == segment).select(F.col("primary_genre").alias("genre"), "affinity")

    def _types(self, segment: int | None) -> DataFrame:
        if segment is None:
            return self.types.groupBy("type").agg(F.avg("affinity").alias("affinity"))
        return self.types.where(F.col("segment") == segment).select("type", "affinity")

    def by_segment(self, segment: int, n: int = 10, exclude: Sequence[str] = ()) -> DataFrame:
        return top(score(self.titles, self._genre(segment), self._types(segment), self.means, None, exclude), n)

    def by_preferences(self, genres: Sequence[str], kind: str = "Any", n: int = 10) -> DataFrame:
        """Titles that have a chosen tag, of the type if named; the filters fall away, the genres last, if nothing is left."""
        spark = self.titles.sparkSession
        tagged = self.titles.where(F.arrays_overlap("tags", F.array(*map(F.lit, genres)))) if genres else self.titles
        typed = tagged.where(F.col("type") == kind) if kind != "Any" else tagged
        found = next((d for d in (typed, tagged) if not d.isEmpty()), self.titles)
        chosen = spark.createDataFrame([(g,) for g in genres], "genre string")
        return top(score(found, boosted(self._genre(None), chosen, CHOSEN_BOOST), self._types(None), self.means), n)

    def by_watched(self, watched: Sequence[str], n: int = 10) -> DataFrame:
        boosts = rule_boosts(self.rules, watched) if self.rules is not None else None
        return top(score(self.titles, boosted(self._genre(None), tags_of(self.every, watched), WATCHED_BOOST), self._types(None), self.means, boosts, watched), n)


def regular_users(profiles: DataFrame, n: int = 300) -> DataFrame:
    """The users with most ratings, with a label; needs user_id, n_ratings, mean_rating, segment."""
    best = profiles.orderBy(F.desc("n_ratings"), "user_id").limit(n)
    return best.select("user_id", "n_ratings", S.user_label("user_id", "n_ratings", "mean_rating", "segment").alias("label"))
