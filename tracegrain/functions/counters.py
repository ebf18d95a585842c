"""What reads have cost, by name: calls, microseconds and rows.

A driver's counters are a few numbers; snapshots of many drivers are rows of a
table, which operators.tables.method_metrics adds up.
"""

from __future__ import annotations

import time
from collections import defaultdict
from collections.abc import Iterator
from contextlib import contextmanager
from threading import Lock

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "method string, calls long, elapsed_us long, rows long"


class Counters:
    def __init__(self) -> None:
        self._totals: dict[str, list[int]] = defaultdict(lambda: [0, 0, 0])
        self._lock = Lock()

    def record(self, method: str, elapsed_us: int, rows: int = 0) -> None:
        with self._lock:
            for n, more in enumerate((1, elapsed_us, rows)):
                self._totals[method][n] += more

    @contextmanager
    def timed(self, method: str) -> Iterator[list[int]]:
        """Count what runs inside, also if it fails; it may append numbers of rows to the list it is given."""
        rows: list[int] = []
        began = time.perf_counter()
        try:
            yield rows
        finally:
            self.record(method, int((time.perf_counter() - began) * 1e6), sum(rows))

    def snapshot(self) -> dict[str, tuple[int, int, int]]:
        """calls, microseconds and rows by method, of one moment."""
        with self._lock:
            return {method: tuple(totals) for method, totals in sorted(self._totals.items())}

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(method, *totals) for method, totals in self.snapshot().items()], SCHEMA)
