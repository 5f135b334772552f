"""Incremental collection and event-time windows, each run to the end of its input."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.plans.catalog import query
from quillmill.plans.relations import table
from quillmill.session import shared_dir
from quillmill.streaming import ingest, late, seen, windows

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def work_dir(spark: SparkSession) -> str:
    """A new folder that driver and executors share."""
    return f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = spark.readStream.schema(EVENTS).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


@query("select distinct user_id as id from events")
def stm_dedup_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of unseen keys only; the keys seen are state."""
    at = work_dir(spark)
    ingest.collect_stream(events(spark, sf_dir).select(F.col("user_id").alias("id")), f"{at}/out", f"{at}/state").awaitTermination()
    return spark.read.schema("id long").parquet(f"{at}/out")


@query("select distinct user_id as id from events")
def stm_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stopped and started again from its checkpoint, a collection adds nothing twice."""
    at = work_dir(spark)
    for _ in range(2):
        ingest.collect_stream(events(spark, sf_dir).select(F.col("user_id").alias("id")), f"{at}/out", f"{at}/state").awaitTermination()
    return spark.read.schema("id long").parquet(f"{at}/out")


@query("select o_orderkey as id from orders where o_orderkey not in (select l_orderkey from lineitem where l_linenumber > 2)")
def join_seen_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    works = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    seen = table(spark, sf_dir, "lineitem").where("l_linenumber > 2").select(F.col("l_orderkey").alias("id")).distinct()
    return ingest.unseen(works, seen)


MONTHS = "select strftime(o_orderdate, '%Y-%m') as month, count(*) as expected, count(*) filter (o_orderkey % 1000 <> 1) as collected, count(*) filter (o_orderkey % 1000 = 1) as duplicates from orders group by 1"


def month_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey") % 1000
    rows = table(spark, sf_dir, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month"))
    return rows.agg(F.count(F.lit(1)).alias("expected"), F.count_if(key != 1).alias("collected"), F.count_if(key == 1).alias("duplicates"), F.lit(True).alias("complete"))


@query(f"select cast(sum(expected) as bigint) as expected, cast(sum(collected) as bigint) as collected, cast(sum(duplicates) as bigint) as duplicates, sum(expected) = sum(collected) as is_census from ({MONTHS})")
def agg_month_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.census(month_meta(spark, sf_dir))


@query(f"select bool_and(expected = collected) as is_census from ({MONTHS})")
def stm_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.census(month_meta(spark, sf_dir)).select("is_census")


@query("select event_id, case when user_id % 2 = 0 then 'budget' when user_id % 3 = 0 then 'transport' when user_id % 5 = 0 then 'max' end as reason from events")
def stm_stop_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("user_id")
    return table(spark, sf_dir, "events").select("event_id", ingest.stop_reason(u % 2 == 0, u % 3 == 0, u % 5 == 0).alias("reason"))


TUMBLING = "select event_type, time_bucket(interval 1 day, ts) as start, count(*) as n, round(sum(value), 4) as total from events group by 1, 2"


@query(TUMBLING)
def ext_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: daily counts by event time."""
    rows = windows.tumbling(table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), "1 day")
    return rows.select("event_type", F.col("start").cast("timestamp_ntz").alias("start"), "n", F.round("total", 4).alias("total"))


@query("with s as (select event_type, unnest([time_bucket(interval 6 hour, ts), time_bucket(interval 6 hour, ts) - interval 6 hour]) as start, value from events) select event_type, start, count(*) as n, round(sum(value), 4) as total from s group by 1, 2")
def ext_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: twelve-hour windows, every six hours."""
    rows = windows.sliding(table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), "12 hours", "6 hours")
    return rows.select("event_type", F.col("start").cast("timestamp_ntz").alias("start"), "n", F.round("total", 4).alias("total"))


@query(
    """with g as (select user_id, ts, value, case when ts - lag(ts) over w < interval 2 hour then 0 else 1 end as fresh from events window w as (partition by user_id order by ts)),
s as (select *, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as k from g)
select user_id, min(ts) as start, count(*) as n, round(sum(value), 4) as total from s group by user_id, k"""
)
def ext_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: sessions that end after two quiet hours."""
    rows = windows.sessions(table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), "2 hours")
    return rows.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n", F.round("total", 4).alias("total"))


def kept_windows(spark: SparkSession, stream: DataFrame, of: late.Windows) -> tuple[DataFrame, DataFrame]:
    """All windows of a stream, and its late rows."""
    at = work_dir(spark)
    late.collect_windows(stream, f"{at}/out", f"{at}/state", of).awaitTermination()
    return late.windows_of(spark, f"{at}/out", stream, of), late.late_of(spark, f"{at}/out", stream)


@query(TUMBLING)
def ext_stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: the same windows from a stream; those that the watermark hasn't passed are flushed at the end."""
    rows, _ = kept_windows(spark, events(spark, sf_dir), late.Windows("1 day", "event_type"))
    return rows.select("event_type", F.col("start").cast("timestamp_ntz").alias("start"), "n", F.round("total", 4).alias("total"))


#: A chunk of six days is a file; every tenth event comes a file late.
CHUNK = "cast(floor(epoch_us(ts - (select min(ts) from events)) / (6 * 86400e6)) as int) + case when event_id % 10 = 0 then 1 else 0 end"


def arriving(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream of files, a batch each, in which some come late."""
    rows = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    first = rows.agg(F.min("ts").alias("first"))
    chunk = F.floor((F.unix_micros("ts") - F.unix_micros("first")) / (6 * 86_400_000_000)).cast("int") + F.when(F.col("event_id") % 10 == 0, 1).otherwise(0)
    dealt = rows.crossJoin(F.broadcast(first)).withColumn("chunk", chunk).drop("first")
    at = work_dir(spark)
    for n in sorted(r["chunk"] for r in dealt.select("chunk").distinct().collect()):  # one after another: files are taken in order of their time
        dealt.where(F.col("chunk") == n).drop("chunk").coalesce(1).write.parquet(f"{at}/{n:04d}")
    return spark.readStream.schema(EVENTS.replace("timestamp_ntz", "timestamp")).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(at)


ARRIVED = f"""
dealt as (select *, {CHUNK} as chunk from events),
marks as (select c.chunk, (select max(ts) from dealt d where d.chunk < c.chunk) - interval 1 hour as mark from (select distinct chunk from dealt) c)"""


@query(
    f"""with {ARRIVED},
timed as (select d.*, coalesce(d.ts < m.mark, false) as is_late from dealt d join marks m using (chunk)),
g as (select user_id, ts, value, case when ts - lag(ts) over w < interval 2 hour then 0 else 1 end as fresh from timed where not is_late window w as (partition by user_id order by ts)),
s as (select *, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as k from g)
select 'session' as kind, user_id, min(ts) as start, count(*) as n, round(sum(value), 4) as total from s group by user_id, k
union all select 'late', user_id, ts, 1, round(value, 4) from timed where is_late"""
)
def ext_late_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: sessions of what comes in time, and what comes late: every event is in one of them."""
    rows, behind = kept_windows(spark, arriving(spark, sf_dir), late.Windows("2 hours", "user_id", sessions=True))
    mine = rows.select(F.lit("session").alias("kind"), "user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n", F.round("total", 4).alias("total"))
    return mine.unionByName(behind.select(F.lit("late").alias("kind"), "user_id", F.col("ts").cast("timestamp_ntz").alias("start"), F.lit(1).cast("long").alias("n"), F.round("value", 4).alias("total")))


@query(
    f"""with {ARRIVED},
timed as (select d.*, coalesce(time_bucket(interval 1 day, ts) + interval 1 day <= m.mark, false) as is_late from dealt d join marks m using (chunk))
select event_type, time_bucket(interval 1 day, ts) as start, count(*) filter (not is_late) as n, count(*) filter (is_late) as n_late from timed group by 1, 2"""
)
def ext_late_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: days with what came in time and what came after they were closed."""
    rows, behind = kept_windows(spark, arriving(spark, sf_dir), late.Windows("1 day", "event_type"))
    counted = behind.groupBy("event_type", F.date_trunc("day", "ts").alias("start")).agg(F.count(F.lit(1)).alias("n_late"))
    both = rows.select("event_type", "start", "n").join(counted, ["event_type", "start"], "full_outer")
    return both.select("event_type", F.col("start").cast("timestamp_ntz").alias("start"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("n_late", F.lit(0)).alias("n_late"))


@query("select concat(event_type, '/', strftime(ts, '%Y-%m-%d')) as id, arg_min(event_id, ts) as event_id from events group by 1")
def stm_dedup_expiring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first event of each type and day, with state that lets go of days gone by; the checkpoint is lost halfway and made again from what is stored."""
    rows = table(spark, sf_dir, "events").select(F.concat("event_type", F.lit("/"), F.date_format("ts", "yyyy-MM-dd")).alias("id"), F.col("ts").cast("timestamp").alias("ts"), "event_id")
    at, bounds = work_dir(spark), rows.select(F.unix_micros(F.min("ts")).alias("a"), F.unix_micros(F.max("ts")).alias("z")).first()
    if bounds["a"] is None:
        return rows.select("id", "event_id")
    step = (bounds["z"] - bounds["a"]) // 6 + 1
    for n in range(6):
        inside = F.floor((F.unix_micros("ts") - bounds["a"]) / step) == n
        rows.where(inside).coalesce(1).write.parquet(f"{at}/in/{n}")
        if n in (2, 5):
            stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{at}/in")
            seen.collect_first(stream, f"{at}/out", f"{at}/state-{n}", "id", "ts", "2 hours").awaitTermination()
    return seen.collected(spark, f"{at}/out", rows.schema).select("id", "event_id")
