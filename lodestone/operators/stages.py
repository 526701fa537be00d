"""Running the stages of mining, keeping the metrics of those that are not run, and retraining after an update.

A stage is a function from a session to a nested result of numbers and texts.
Its metrics are kept as (metric, value) rows under `stage<number>.`; running some
stages again replaces their metrics and leaves the others. A retraining runs the
stages one by one: one that fails leaves its error's text and does not stop the
next. Each run appends a row to the log.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping, Sequence
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import tables
from lodestone.sources.files import Versioned

Stage = Callable[[SparkSession], Mapping]

LOG = "run_at string, mode string, selected long, fetched long, changed long, failed long, skipped boolean, stages string, stages_ok string, duration_s double"


class Runner:
    """Stages by number, with their summary as a versioned table."""

    def __init__(self, spark: SparkSession, summary: Versioned, stages: Mapping[int, Stage]):
        self.spark, self.summary, self.stages = spark, summary, dict(stages)

    def read(self) -> DataFrame:
        found = self.summary.read()
        return found if found is not None else self.spark.createDataFrame([], "metric string, value string")

    def _keep(self, results: Mapping[int, Mapping]) -> None:
        """Metrics of the given stages replace all that their stages had."""
        old = self.read()
        for n in results:
            old = old.where(~F.col("metric").startswith(f"stage{n}."))
        new = tables.summary(self.spark, {f"stage{n}": r for n, r in results.items()})
        self.summary.replace(tables.merge_summary(old, new))

    def run(self, only: Sequence[int] | None = None) -> dict[int, str]:
        """What became of each stage: "ok" and its seconds, or its error."""
        unknown = sorted(set(only or ()) - set(self.stages))
        if unknown:
            raise ValueError(f"no stages {unknown}; there are {sorted(self.stages)}")
        info, results = {}, {}
        for n in sorted(self.stages) if only is None else only:
            began = time.time()
            try:
                results[n] = self.stages[n](self.spark)
                info[n] = f"ok ({time.time() - began:.0f}s)"
            except Exception as e:  # a stage's failure is its own: the others go on
                info[n] = f"FAILED: {type(e).__name__}: {e}"[:200]
        if results:
            self._keep(results)
        return info


def retrain(runner: Runner, log: str, sync: Callable[[], Mapping] | None = None, rebuild: Callable[[], object] | None = None, only: Sequence[int] | None = None, min_changed: int = 1, force: bool = False, mode: str = "sync") -> dict:
    """Sync, and unless fewer than min_changed rows changed (and not force) rebuild and run the stages; the run's row of the log.

    sync: gives selected, fetched, changed and failed; None: no sync, always
    retrain. rebuild: computes the tables that the stages read.
    """
    began = time.time()
    report = dict(sync()) if sync else {}
    changed = report.get("changed", 0)
    skipped = bool(sync) and not force and changed < min_changed
    info: dict[int, str] = {}
    if not skipped:
        if rebuild:
            rebuild()
        info = runner.run(only)
    row = {
        "run_at": datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ"), "mode": mode if sync else "retrain-only (no sync)", "selected": report.get("selected", 0), "fetched": report.get("fetched", 0),
        "changed": changed, "failed": report.get("failed", 0), "skipped": skipped, "stages": " ".join(map(str, info)),
        "stages_ok": " ".join(str(n) for n, x in info.items() if x.startswith("ok")), "duration_s": round(time.time() - began, 1),
    }
    runner.spark.createDataFrame([tuple(row[c.split()[0]] for c in LOG.split(", "))], LOG).write.mode("append").parquet(log)
    return row | {"info": info}
