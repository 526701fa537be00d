"""Views of the star-schema tables in the shape that the mining operators take.

Each view is a lazy plan over the stored tables: filters and column selections
of whatever is built on it reach the Parquet scans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue items: (item_id, name, genre, type, episodes, rating, members), raw: with gaps and text numbers."""
    part = table(spark, sf_dir, "part")
    counts = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("k")).agg(F.count(F.lit(1)).alias("cnt"))
    extra = F.greatest(F.coalesce("cnt", F.lit(0)) - 13, F.lit(0)).cast("long")
    words = F.split("p_name", " ")
    return part.join(counts, part["p_partkey"] == counts["k"], "left").select(
        F.col("p_partkey").alias("item_id"),
        F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string")).alias("name"),
        F.concat_ws(", ", F.get(words, F.lit(0)), F.get(words, F.lit(1)), "p_brand").alias("genre"),
        F.col("p_type").alias("type"),
        F.when(F.col("p_partkey") % 37 == 0, "Unknown").otherwise(F.col("p_size").cast("string")).alias("episodes"),
        F.when(F.col("p_partkey") % 53 != 0, (F.col("p_retailprice") - 900) / 10).alias("rating"),
        (extra * extra * extra).alias("members"),
    )


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, item_id, rating): -1 for seen but not rated, else 1 to 10."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_returnflag")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    rating = F.when(F.col("l_returnflag") == "R", -1).otherwise(1 + F.floor((F.col("l_quantity") - 1) / 5)).cast("int")
    return line.join(orders, line["l_orderkey"] == orders["o_orderkey"]).select(F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("item_id"), rating.alias("rating"))


def order_lines(spark: SparkSession, sf_dir: str, item: str = "p_type") -> DataFrame:
    """(basket, item): an order and a column of each of its parts."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    part = table(spark, sf_dir, "part").select("p_partkey", item)
    return line.join(part, line["l_partkey"] == part["p_partkey"]).select(F.col("l_orderkey").alias("basket"), F.col(item).alias("item"))


def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as update payloads: (event_id, ts, item_id, kind, value, props)."""
    return table(spark, sf_dir, "events").select("event_id", "ts", F.col("user_id").alias("item_id"), F.col("event_type").alias("kind"), "value", "props")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, label, x: array<double>): the embeddings."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", F.transform("embedding", lambda v: v.cast("double")).alias("x"))


def outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents with simple attributes: (id, actual, lang, source, n_chars)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return docs.join(labels, "doc_id").select(F.col("doc_id").alias("id"), F.col("quality").alias("actual"), "lang", "source", "n_chars")
