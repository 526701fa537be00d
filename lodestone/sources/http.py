"""Payloads over HTTP, politely: a least interval between calls, retries that wait longer each time, one row for each id whatever becomes of it."""

from __future__ import annotations

import time
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.error import HTTPError, URLError
from urllib.request import Request, urlopen

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class HttpSource:
    """GET base/id: the text of the answer.

    404 is a KeyError. 429, 5xx and broken connections are tried again, up to
    `retries` times, after `wait` seconds, twice that, and so on; any other
    answer is an error at once.
    """

    base: str
    interval: float = 1.0
    retries: int = 4
    wait: float = 2.0
    timeout: float = 20.0
    agent: str = "lodestone"

    def __post_init__(self):
        self.calls, self._last = 0, float("-inf")

    def _pause(self) -> None:
        left = self._last + self.interval - time.monotonic()
        if left > 0:
            time.sleep(left)
        self._last = time.monotonic()

    def get(self, key) -> str:
        why = ""
        for attempt in range(self.retries + 1):
            if attempt:
                time.sleep(self.wait * attempt)
            self._pause()
            self.calls += 1
            try:
                with urlopen(Request(f"{self.base.rstrip('/')}/{key}", headers={"User-Agent": self.agent}), timeout=self.timeout) as answer:
                    return answer.read().decode("utf-8")
            except HTTPError as e:
                if e.code == 404:
                    raise KeyError(key) from e
                if e.code != 429 and e.code < 500:
                    raise
                why = f"HTTP {e.code}"
            except (URLError, TimeoutError, ConnectionError) as e:
                why = str(e)
        raise RuntimeError(f"{key}: no answer after {self.retries + 1} calls, the last one: {why}")

    def table(self, ids: DataFrame, column: str, tasks: int = 1) -> DataFrame:
        """(column, json, error) of each distinct id; the interval holds for each of the `tasks` that fetch."""
        import pyarrow as pa

        settings = (self.base, self.interval, self.retries, self.wait, self.timeout, self.agent)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = HttpSource(*settings)
            for b in batches:
                texts, errors = [], []
                for key in b.column(0).to_pylist():
                    try:
                        texts.append(own.get(key))
                        errors.append(None)
                    except Exception as e:  # one id's failure is its own
                        texts.append(None)
                        errors.append(f"{type(e).__name__}: {e}"[:200])
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array(errors, pa.string())], [column, "json", "error"])

        keys = ids.where(F.col(column).isNotNull()).select(column).distinct().repartition(tasks)
        return keys.mapInArrow(run, f"{column} {ids.schema[column].dataType.simpleString()}, json string, error string")
