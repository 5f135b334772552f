"""Run, source and fetch logs as append-only tables."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.functions.text import scrub_url
from quillmill.operators.merge import overwrite

RUN = "run_id string, command string, started_at string, finished_at string, status string, seq long"
RUN_SOURCE = "run_id string, source string, requests long, records long, errors long, seq long"
FETCH = "run_id string, source string, url string, status int, elapsed double, error string, at string"


def now() -> str:
    return datetime.now(UTC).isoformat(timespec="seconds")


class RunLog:
    """Events are appended as they come; the state of a run is its latest event."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _append(self, table: str, rows: list[tuple], schema: str) -> None:
        self.spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{self.path}/{table}")

    def start(self, run_id: str, command: str) -> None:
        self._append("run", [(run_id, command, now(), None, "running", 0)], RUN)

    def finish(self, run_id: str, command: str, status: str) -> None:
        self._append("run", [(run_id, command, None, now(), status, 1)], RUN)

    def source(self, run_id: str, source: str, requests: int, records: int, errors: int, seq: int) -> None:
        self._append("run_source", [(run_id, source, requests, records, errors, seq)], RUN_SOURCE)

    def fetches(self, notes: list[dict], run_id: str) -> None:
        """Request notes of a transport; secrets in URLs are left out before anything is stored."""
        rows = [(run_id, n["source"], n["url"], n["status"], n["elapsed"], n.get("error"), now()) for n in notes]
        self.fetch_rows(self.spark.createDataFrame(rows, FETCH))

    def fetch_rows(self, rows: DataFrame) -> None:
        """The same for notes that are a table."""
        rows.withColumn("url", scrub_url(F.col("url"))).write.mode("append").parquet(f"{self.path}/fetch_log")

    def fetched(self) -> DataFrame:
        return self.spark.read.schema(FETCH).parquet(f"{self.path}/fetch_log")

    def runs(self) -> DataFrame:
        events = self.spark.read.schema(RUN).parquet(f"{self.path}/run")
        return events.groupBy("run_id").agg(F.max("command").alias("command"), F.max("started_at").alias("started_at"), F.max("finished_at").alias("finished_at"), F.max_by("status", "seq").alias("status"))

    def sources(self) -> DataFrame:
        events = self.spark.read.schema(RUN_SOURCE).parquet(f"{self.path}/run_source")
        return overwrite(events.drop("seq").limit(0), events, ["run_id", "source"])


#: Why a run stops early; of several the first counts: a spent budget, then failures, then limits.
REASONS = ("budget", "transport", "max")


def outcome(budget_stopped: bool, failed: bool, reached_limit: bool) -> tuple[str, str | None]:
    """(status, reason)."""
    for stopped, reason in zip((budget_stopped, failed, reached_limit), REASONS, strict=True):
        if stopped:
            return "partial", reason
    return "ok", None
