"""Incremental collection: resumable, bounded runs with keyed state, and its completeness."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.errors import StreamingQueryException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamReader, StreamingQuery

from quillmill.sources import files, runlog
from quillmill.streaming.seen import GROWING, settings


def collect_stream(stream: DataFrame, out: str, checkpoint: str, key: str = "id", late: tuple[str, str] | None = None) -> StreamingQuery:
    """Appends rows of unseen keys and stops when all input is read; started again, it goes on where it stopped.

    The keys seen are state in the checkpoint; with ``late`` (time column, delay)
    a watermark lets go of old ones, else they stay for ever.
    """
    seen = stream.withWatermark(*late).dropDuplicatesWithinWatermark([key]) if late else stream.dropDuplicates([key])
    return seen.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def collect_lines(stream: DataFrame, out: str, checkpoint: str, key: str = "id", raw: str = "raw", place: tuple[str, ...] = (), tag: str = "lines", once: bool = True) -> StreamingQuery:
    """Appends the column ``raw`` of rows of unseen keys as lines, in files named after their batch.

    A batch that is taken again replaces its own files, so each line is there once.
    How many lines there are is counted by the job that writes them, and noted beside them.
    Rows ordered by ``place`` are of a bounded number of pages, hence few, and go into one file.
    """

    def write(batch: DataFrame, number: int) -> None:
        rows = batch.repartition(1).sortWithinPartitions(*place) if place else batch
        counted = Observation()
        files.write_lines(rows.select(raw).observe(counted, F.count(F.lit(1)).alias("n")), out, f"{tag}-{number:08d}")
        note_count(spark, out, tag, number, counted.get["n"])

    spark = stream.sparkSession
    made = stream.dropDuplicates([key]).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    with settings(spark, GROWING):
        return (made.trigger(availableNow=True) if once else made).start()


def note_count(spark: SparkSession, out: str, tag: str, number: int, n: int) -> None:
    """Adds a batch's lines to those of its tag; a batch that is taken again counts once."""
    path = f"{out}/_count-{tag}.json"
    known = json.loads(files.read_text(spark, path)) if files.exists(spark, path) else {"batch": -1, "before": 0, "total": 0}
    before = known["before"] if number == known["batch"] else known["total"]
    files.write_text(spark, path, json.dumps({"batch": number, "before": before, "total": before + n}))


def stored_keys(spark: SparkSession, out: str, tag: str, key: str) -> int:
    """Distinct keys among the lines in ``out``: from the note, if all are of one tag, whose keys differ; else by reading them."""
    lines = [n for n in files.names(spark, out) if n.endswith(".jsonl")]
    if not lines:
        return 0
    note = f"{out}/_count-{tag}.json"
    if all(n.startswith(f"{tag}-") for n in lines) and files.exists(spark, note):
        return json.loads(files.read_text(spark, note))["total"]
    return files.json_lines(spark, out, key).count()


@dataclass
class Crawl:
    """How far a crawl has come: the committed offset, the pages of this run, and the kind of error that ended it."""

    offset: dict
    pages: int
    error: str | None = None


def committed(spark: SparkSession, checkpoint: str) -> dict:
    """The offset behind the last finished batch of a stream with one source; {} if there is none."""
    done = [int(n) for n in files.names(spark, f"{checkpoint}/commits") if n.isdigit()]
    return json.loads(files.read_text(spark, f"{checkpoint}/offsets/{max(done)}").splitlines()[-1]) if done else {}


def collect_pages(spark: SparkSession, stream: DataStreamReader, out: str, checkpoint: str, key: str = "id", most: int | None = None, tag: str = "pages") -> Crawl:
    """Collects a source whose batches are pages, as raw lines, until it has no more or for ``most`` pages.

    A later run goes on behind the last committed page. A batch is one page at
    first, later as many as the run has committed, up to ``paged.BATCH_ROWS``
    rows; pages asked for ahead of their batch count with it. So a process that dies loses
    at most half of what its run has paid for, and no more than two batches of those rows. A request that fails ends the run once what came
    before it is committed, and its kind is told; other errors are raised.
    """
    before, error = committed(spark, checkpoint).get("pages", 0), None
    pages = stream.option("maxPages", most or 0).load()
    place = tuple(c for c in ("month_bucket", "place") if c in pages.columns)
    run = collect_lines(pages, out, checkpoint, key, place=place, tag=tag, once=False)
    try:
        run.processAllAvailable()
    except StreamingQueryException as failed:
        kind = re.search(r"quillmill\.sources\.transport\.(\w+)", str(failed))
        if not kind:
            raise
        error = kind[1]
    finally:
        run.stop()
    offset = committed(spark, checkpoint)
    return Crawl(offset, offset.get("pages", 0) - before, error)


def read_files(spark: SparkSession, path: str, schema: str, files_per_batch: int = 1) -> DataFrame:
    """A stream over a growing folder of Parquet files; ``files_per_batch`` bounds what one batch takes."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def unseen(works: DataFrame, seen: DataFrame, key: str = "id") -> DataFrame:
    return works.join(seen.select(key), key, "left_anti")


def stop_reason(budget: Column, transport: Column, most: Column) -> Column:
    """The rule of ``runlog.outcome`` as a column."""
    first, second, third = (F.when(held, F.lit(reason)) for held, reason in zip((budget, transport, most), runlog.REASONS, strict=True))
    return F.coalesce(first, second, third)


def census(months: DataFrame) -> DataFrame:
    """Sums over months of (expected, collected, duplicates, complete), and whether they make a census."""
    known = F.bool_and(F.col("complete") & F.col("expected").isNotNull())
    sums = months.agg(F.sum("expected").alias("expected"), F.sum("collected").alias("collected"), F.sum("duplicates").alias("duplicates"), known.alias("known"))
    return sums.select("expected", "collected", "duplicates", F.coalesce(F.col("known") & (F.col("expected") == F.col("collected")), F.lit(False)).alias("is_census"))


def cursor_census(limit: int | None, exhausted: bool, stopped: bool) -> bool:
    return not limit and exhausted and not stopped


def next_position(state: dict | None, months: list[str]) -> tuple[str | None, int]:
    """(month, start) to go on from; nothing left is (None, 0). An unknown month starts anew; a longer window goes on behind the last complete month."""
    state = state or {}
    if state.get("complete"):
        done = state.get("complete_through_month")
        left = [m for m in months if done is None or m > done]
        return (left[0], 0) if left else (None, 0)
    if state.get("month_cursor") in months:
        return state["month_cursor"], int(state.get("retstart") or 0)
    return (months[0], 0) if months else (None, 0)
