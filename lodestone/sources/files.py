"""Files: readers with explicit schemas, versioned replacement, append-only history, JSON payloads, stored models."""

from __future__ import annotations

import json
import tempfile
import time
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share: spark.checkpoint.dir, or a local one where that is unset and the master is local."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    at = at or "file://" + tempfile.mkdtemp(prefix="lodestone-")
    return f"{at.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def scratch_table(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again: its plan ends there, and lost executors lose nothing."""
    at = scratch(df.sparkSession, "table")
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def read_csv(spark: SparkSession, path: str, schema: str, columns: list[str] | None = None) -> DataFrame:
    """A CSV file with a header; a column that can't be read as its type is null. columns prunes the scan."""
    df = spark.read.csv(path, schema=schema, header=True, mode="PERMISSIVE")
    return df.select(columns) if columns else df


def write_csv(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").csv(path, header=True)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; a malformed one gives a row of nulls with the text in _corrupt_record, to be fetched again."""
    return spark.read.json(path, schema=f"{schema}, _corrupt_record string", mode="PERMISSIVE")


def try_read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A Parquet table, or an empty one of that schema if there is none."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def _fs(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


class Versioned:
    """A table kept as versions v0, v1, ..; a reader sees the last finished one, and one before it stays as a backup.

    Spark's committer finishes a version with its _SUCCESS file, so a version
    that broke off is never read. A new version may be computed from the last.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def versions(self) -> list[int]:
        fs, root = _fs(self.spark, self.path)
        if not fs.exists(root):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(root)]
        done = [int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit() and fs.exists(_fs(self.spark, f"{self.path}/{n}/_SUCCESS")[1])]
        return sorted(done)

    def read(self) -> DataFrame | None:
        v = self.versions()
        return self.spark.read.parquet(f"{self.path}/v{v[-1]}") if v else None

    def replace(self, df: DataFrame) -> int:
        v = self.versions()
        new = v[-1] + 1 if v else 0
        df.write.mode("overwrite").parquet(f"{self.path}/v{new}")
        fs, _ = _fs(self.spark, self.path)
        for old in v[:-1]:
            fs.delete(_fs(self.spark, f"{self.path}/v{old}")[1], True)
        return new


def append_history(df: DataFrame, path: str) -> None:
    """Append-only history, partitioned by the day of fetched_at."""
    df.withColumn("day", F.to_date("fetched_at")).write.mode("append").partitionBy("day").parquet(path)


def save_model(model, path: str) -> None:
    model.write().overwrite().save(path)


class JsonCache:
    """Payloads by id, one file for each: what is there and parses is not fetched again; a corrupt one is.

    fetch: a function from an id to its JSON text. For the few ids of one run;
    tables of payloads are read by `read_json`.
    """

    def __init__(self, spark: SparkSession, path: str, fetch):
        self.spark, self.path, self.fetch, self.hits = spark, path.rstrip("/"), fetch, 0

    def get(self, key, use_cache: bool = True) -> dict:
        fs, at = _fs(self.spark, f"{self.path}/{key}.json")
        if use_cache and fs.exists(at):
            try:
                found = json.loads("\n".join(r.value for r in self.spark.read.text(str(at.toString())).collect()))
                self.hits += 1
                return found
            except ValueError:
                pass  # corrupt: fetched again
        text = self.fetch(key)
        got = json.loads(text)
        out = fs.create(at, True)
        out.write(bytearray(text.encode()))
        out.close()
        return got


class Memo:
    """Cached reads by path and the time of the last change, with the least recent dropped and unpersisted."""

    def __init__(self, spark: SparkSession, most: int = 4):
        self.spark, self.most, self.held = spark, most, {}

    def read(self, path: str) -> DataFrame:
        fs, p = _fs(self.spark, path)
        key = (path, fs.getFileStatus(p).getModificationTime())
        if key not in self.held:
            while len(self.held) >= self.most:
                oldest = min(self.held, key=lambda k: self.held[k][1])
                self.held.pop(oldest)[0].unpersist()
            self.held[key] = (self.spark.read.parquet(path).cache(), time.time())
        return self.held[key][0]
