"""The ledger of import runs: rows are only ever added, and the last one of a run counts."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import clock
from ..plans.schemas import RUNS

COUNTERS = ("fetched", "inserted", "updated", "skipped", "invalid", "errors")
#: Details of invalid records that a run keeps.
MOST_DETAILS = 100


class RunFailed(RuntimeError):
    """A run that broke off; ``counters`` are those of the ledger's last row."""

    def __init__(self, message: str, counters: dict[str, int]):
        super().__init__(message)
        self.counters = counters


@dataclass
class Outcome:
    """What a run came to; ``details`` is JSON text of invalid records or null, ``result`` whatever the job returns."""

    counters: dict[str, int]
    details: str | None = None
    result: object = None
    extra: dict[str, int] = field(default_factory=dict)


class RunLedger:
    """Runs as Parquet files in one folder: one row when a run begins, one when it ends, whatever happens between."""

    def __init__(self, spark: SparkSession, path: str, now: Callable[[], datetime] = lambda: datetime.now(timezone.utc)):
        self.spark, self.path, self.now = spark, path, now

    def _rows(self) -> DataFrame:
        target = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        exists = target.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(target)
        return self.spark.read.schema(RUNS).parquet(self.path) if exists else self.spark.createDataFrame([], RUNS)

    def read(self) -> DataFrame:
        """One row for each run, as it stands: a run that neither finished nor failed is still running."""
        rows = self._rows()
        last = F.max_by(F.struct(*rows.columns), F.coalesce("finished_at", F.lit("")))
        return rows.groupBy(F.col("id").alias("_id")).agg(last.alias("r")).select("r.*")

    def _append(self, **values) -> None:
        row = {n: values.get(n) for n in self.spark.createDataFrame([], RUNS).columns}
        self.spark.createDataFrame([tuple(row.values())], RUNS).coalesce(1).write.mode("append").parquet(self.path)

    def record(self, source_id: int, work: Callable[[], Outcome]) -> Outcome:
        """Runs ``work`` as a run of the source; an error is written down with its message and passed on."""
        run_id = self._rows().agg(F.coalesce(F.max("id"), F.lit(0))).first()[0] + 1
        stamp = lambda: clock.inactive_cutoff(self.now(), 0)
        started = {"id": run_id, "source_id": source_id, "started_at": stamp()}
        self._append(**started, status="running", **dict.fromkeys(COUNTERS, 0))
        try:
            found = work()
        except Exception as e:
            counters = dict.fromkeys(COUNTERS, 0) | getattr(e, "counters", {})
            counters["errors"] += 1
            self._append(**started, finished_at=stamp(), status="failed", error_message=str(e), **counters)
            raise
        status = "completed_with_errors" if found.counters["errors"] else "completed"
        self._append(**started, finished_at=stamp(), status=status, invalid_details=found.details, **found.counters)
        return found
