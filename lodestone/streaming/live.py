"""Streams: running profiles, windowed counts of events with late data, upserts by micro-batch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators import feed
from lodestone.sources.files import Versioned


def profiles(ratings: DataFrame) -> DataFrame:
    """Running counts and means by user, for update or complete mode."""
    return ratings.where("rating > 0").groupBy("user_id").agg(F.count(F.lit(1)).alias("n_ratings"), F.avg("rating").alias("mean_rating"))


def event_windows(events: DataFrame, every: str = "1 hour", late: str = "10 minutes", ts: str = "ts") -> DataFrame:
    """(start, kind, n, total): tumbling windows by event type; rows later than `late` drop out. State is bounded by the watermark."""
    own = events.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", late)
    g = own.groupBy(F.window("__ts", every), F.col("event_type").alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("window.start").alias("start"), "kind", "n", "total")


def upsert_batches(table: Versioned, history: str, types: Sequence[str]):
    """A function for foreachBatch: the last payload of each item updates the table, and all are kept in the history.

    The history's files of a batch lie under the batch's number and replace
    those of an earlier attempt, and the same payloads change the table only once:
    a batch that is given again changes nothing.
    """

    def run(batch: DataFrame, number: int) -> None:
        rows = batch.persist()
        last = rows.groupBy("item_id").agg(F.max_by(F.struct(*[c for c in rows.columns if c not in ("item_id",)]), "fetched_at").alias("r")).select("item_id", "r.*")
        table.replace(feed.upsert(table.read(), last, types))
        rows.write.mode("overwrite").parquet(f"{history.rstrip('/')}/batch={number}")
        rows.unpersist()

    return run
