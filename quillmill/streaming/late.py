"""Windows over a stream that lose no event: late rows are kept aside, and the last windows can be had.

Spark's own windows drop rows behind the watermark and keep the newest windows
to themselves. Here each batch is split by the watermark that the batches
before it have set: rows behind it go to the side table ``late``, the others
join the windows that are still open. Windows that the new watermark has passed
are appended to ``closed``; the rest is the next batch's open table. A note of
the batch, written last, makes all of it count, so a batch that is taken again
after a failure replaces what it had written. State is a table of open windows,
not rows: bounded by groups and delay.

A tumbling window is open until the watermark reaches its end; a row is late if
its window is closed. A session ends ``width`` after its last row; a row is late
if it lies behind the watermark, since it might belong to a closed session.
Rows without a time are late. Rows are first added up in stretches of ``width``
or less, which never cut a window, so a group with very many rows is small
before it meets its windows.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from quillmill.sources import files

OPEN = "start long, latest long, n long, total double"


def micros(interval: str) -> int:
    return int(pd.Timedelta(interval).total_seconds() * 1_000_000)


@dataclass
class Windows:
    """Counts and sums of ``value`` by ``group`` and window; times are microseconds."""

    width: str
    group: str
    time: str = "ts"
    value: str = "value"
    delay: str = "1 hour"
    sessions: bool = False

    def end(self) -> Column:
        return F.col("latest" if self.sessions else "start") + micros(self.width)

    def merged(self, pieces: DataFrame) -> DataFrame:
        """Pieces of windows put together."""
        added = [F.sum("n").alias("n"), F.sum("total").alias("total")]
        if not self.sessions:
            return pieces.groupBy(self.group, "start").agg(F.max("latest").alias("latest"), *added)
        order = Window.partitionBy(self.group).orderBy("start", "latest")
        before = F.max("latest").over(order.rowsBetween(Window.unboundedPreceding, -1))
        fresh = pieces.withColumn("__new", (before.isNull() | (F.col("start") - before >= micros(self.width))).cast("int"))
        numbered = fresh.withColumn("__session", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        return numbered.groupBy(self.group, "__session").agg(F.min("start").alias("start"), F.max("latest").alias("latest"), *added).drop("__session")

    def pieces(self, rows: DataFrame) -> DataFrame:
        """Rows added up by group and stretch of time; of a session the stretch begins with its first row."""
        width = micros(self.width)
        stretch = F.floor(F.col("__at") / width) * width
        start = F.min("__at") if self.sessions else F.min(F.col("__stretch"))
        summed = rows.withColumn("__stretch", stretch).groupBy(self.group, "__stretch").agg(start.alias("start"), F.max("__at").alias("latest"), F.count(F.lit(1)).alias("n"), F.sum(self.value).alias("total"))
        return summed.drop("__stretch")

    def late(self, mark: int) -> Column:
        """Whether a row is behind the watermark."""
        width = micros(self.width)
        last = F.col("__at") if self.sessions else F.floor(F.col("__at") / width) * width + width - 1
        return F.coalesce(last < mark, F.lit(True))


def _note(spark: SparkSession, out: str, before: int | None = None) -> dict:
    """What the last batch, or the last one before a batch, has noted."""
    done = [int(n.removesuffix(".json")) for n in files.names(spark, f"{out}/notes") if n.removesuffix(".json").isdigit()]
    done = [n for n in done if before is None or n < before]
    return json.loads(files.read_text(spark, f"{out}/notes/{max(done)}.json")) if done else {"batch": -1, "watermark": None}


def _kind(spark: SparkSession, stream: DataFrame, windows: Windows) -> str:
    return f"{windows.group} {stream.schema[windows.group].dataType.simpleString()}, {OPEN}"


def collect_windows(stream: DataFrame, out: str, checkpoint: str, windows: Windows) -> StreamingQuery:
    """Reads all input there is; tables under ``out``: closed, late, open. Started again, it goes on."""
    spark = stream.sparkSession
    kind = _kind(spark, stream, windows)
    late_schema = stream.schema

    def take(batch: DataFrame, number: int) -> None:
        note = _note(spark, out, number)
        mark = note["watermark"]
        rows = batch.withColumn("__at", F.unix_micros(F.col(windows.time).cast("timestamp"))).persist()
        try:
            newest = rows.agg(F.max("__at").alias("m")).first()["m"]
            behind = windows.late(mark) if mark is not None else F.col("__at").isNull()
            rows.where(behind).select(*late_schema.fieldNames()).write.mode("overwrite").parquet(f"{out}/late/batch={number}")
            known = spark.read.schema(kind).parquet(f"{out}/open/{note['batch']}") if note["batch"] >= 0 else spark.createDataFrame([], kind)
            all_open = windows.merged(known.unionByName(windows.pieces(rows.where(~behind)))).persist()
            passed = max(x for x in (mark, None if newest is None else newest - micros(windows.delay)) if x is not None) if (mark, newest) != (None, None) else None
            done = windows.end() <= F.lit(passed) if passed is not None else F.lit(False)
            all_open.where(done).write.mode("overwrite").parquet(f"{out}/closed/batch={number}")
            all_open.where(~done).write.mode("overwrite").parquet(f"{out}/open/{number}")
            all_open.unpersist()
        finally:
            rows.unpersist()
        files.write_text(spark, f"{out}/notes/{number}.json", json.dumps({"batch": number, "watermark": passed}))
        for old in files.names(spark, f"{out}/open"):
            if old.isdigit() and int(old) < note["batch"]:  # the one before stays, should this batch be taken again
                system, at = files.file_system(spark, f"{out}/open/{old}")
                system.delete(at, True)

    return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windows_of(spark: SparkSession, out: str, stream: DataFrame, windows: Windows, flush: bool = True) -> DataFrame:
    """(start, end, group, n, total) of closed windows and, with ``flush``, of those still open."""
    kind, last = _kind(spark, stream, windows), _note(spark, out)["batch"]
    parts = [f"{out}/closed/batch={n}" for n in range(last + 1) if files.exists(spark, f"{out}/closed/batch={n}")]
    found = spark.read.schema(kind).parquet(*parts, *([f"{out}/open/{last}"] if flush else [])) if last >= 0 and (parts or flush) else spark.createDataFrame([], kind)
    return found.select(F.timestamp_micros("start").alias("start"), F.timestamp_micros(windows.end()).alias("end"), windows.group, "n", "total")


def late_of(spark: SparkSession, out: str, stream: DataFrame) -> DataFrame:
    """The late rows as they came, with the batch that brought them."""
    last = _note(spark, out)["batch"]
    kind = T.StructType([*stream.schema.fields, T.StructField("batch", T.IntegerType())])
    return spark.read.schema(kind).option("basePath", f"{out}/late").parquet(*[f"{out}/late/batch={n}" for n in range(last + 1)]) if last >= 0 else spark.createDataFrame([], kind)
