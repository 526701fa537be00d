"""Things that all operators of this subpackage use: shipping the code, shared folders, row identity."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.session import ship  # noqa: F401

#: White space of the contracts: space and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"
#: A word of the contracts: anything but that white space.
WORD_RE = r"[^\x20\x09-\x0D]+"

def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a local one where that is unset and the master is local (tests)."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not at and not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not at:
        at = "file://" + tempfile.mkdtemp(prefix="lodestone-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(at)
    return at


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of plans that were cut and are no longer referred to, instead of at some later collection."""
    gc.collect()
    spark._jvm.System.gc()


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only; all other characters stay."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def strip_spaces(c: Column) -> Column:
    """Strip the contracts' white space at both ends."""
    return F.trim(c, F.lit(SPACES))


def text_key(c: Column) -> Column:
    """With the id it tells rows apart even where ids repeat or are null."""
    return F.xxhash64(c)
