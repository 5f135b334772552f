"""Joins on time, and sketches that merge over time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.functions.dates import month_add
from quillmill.operators import asof, intervals, sketches
from quillmill.plans.catalog import query
from quillmill.plans.relations import WORKS, table, works
from quillmill.streaming import windows


@query(
    """with v as (select user_id, ts as view_ts, max(event_id) as view_id from events where event_type = 'view' group by 1, 2)
select p.event_id, p.user_id, v.view_id, v.view_ts from (select * from events where event_type = 'purchase') p asof left join v on p.user_id = v.user_id and p.ts >= v.view_ts"""
)
def join_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each purchase with the user's latest view before it; users of more than 500 events are cut by time."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    views = events.where("event_type = 'view'").select("user_id", "ts", F.struct("ts", "event_id").alias("view"))
    found = asof.as_of(events.where("event_type = 'purchase'"), views, ["user_id"], "ts", values=["view"], most=500)
    return found.select("event_id", "user_id", F.col("view.event_id").alias("view_id"), F.col("view.ts").alias("view_ts"))


@query(
    """with v as (select user_id, ts as view_ts, max(event_id) as view_id from events where event_type = 'view' group by 1, 2)
select p.event_id, case when p.ts - v.view_ts <= interval 6 hour then v.view_id end as view_id from (select * from events where event_type = 'purchase') p asof left join v on p.user_id = v.user_id and p.ts > v.view_ts"""
)
def join_as_of_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest view strictly before each purchase, if it is at most six hours old."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    views = events.where("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("view_id"))
    return asof.as_of(events.where("event_type = 'purchase'"), views, ["user_id"], "ts", strict=True, within=F.expr("interval 6 hours")).select("event_id", "view_id")


@query(
    """with g as (select user_id, ts, case when ts - lag(ts) over w < interval 2 hour then 0 else 1 end as fresh from events window w as (partition by user_id order by ts)),
k as (select *, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as k from g),
s as (select user_id as owner, min(ts) as start, max(ts) + interval 2 hour as "end" from k group by user_id, k)
select owner, start, count(*) as n, count(distinct e.user_id) as users, round(sum(e.value), 4) as total from s join events e on e.ts >= s.start and e.ts < s."end" and e.user_id <> owner group by 1, 2"""
)
def join_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What other users do during each user's sessions."""
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    own = {f"own_{n}": F.sum(c) for n, c in intervals.amounts("value").items()}
    sessions = windows.sessions(events.where("user_id is not null"), "2 hours", also=own)
    spans = sessions.select(F.col("user_id").alias("owner"), "start", *own, F.unix_micros("start").alias("from_us"), F.unix_micros("end").alias("to_us"))
    points = events.select("user_id", "value", F.unix_micros("ts").alias("at_us"))
    # an owner's events inside a session are the session's own
    found = intervals.sums_in(points, spans, "at_us", "from_us", "to_us", "user_id", "value")
    others = {n: F.col(n) - F.col(f"own_{n}") for n in intervals.AMOUNTS}
    counted = found.where("n > own_n").select("owner", "start", others["n"].alias("n"), (F.col("keys") - 1).alias("users"), F.round(intervals.amount(others), 4).alias("total"))
    return counted.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query(
    f"""with {WORKS}, m as (select distinct month_bucket as last from works),
spans as (select strftime(strptime(last || '-01', '%Y-%m-%d') - interval 11 month, '%Y-%m') as first, last from m)
select first, last, (select count(*) from works where month_bucket between first and last) as n, true as distinct_within, true as median_within, true as upper_within from spans"""
)
def agg_sketch_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every twelve months: whether the merged sketches' distinct customers, median and ninth decile are within their bounds of the exact ones."""
    customers = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("customer"))
    records = works(spark, sf_dir).join(customers, "id").select("month_bucket", "customer", "citation_count")
    months = sketches.by_month(records, "customer", "citation_count")
    spans = months.select(month_add(F.col("month_bucket"), -11).alias("first"), F.col("month_bucket").alias("last"))
    guessed = sketches.merged(months, spans)
    # the exact figures: a record counts in the twelve spans that hold its month
    each = records.withColumn("last", F.explode(F.transform(F.sequence(F.lit(0), F.lit(11)), lambda k: month_add(F.col("month_bucket"), k))))
    compared = each.join(F.broadcast(guessed.select("last", "p50", "p90")), "last")
    below = lambda c, or_at: F.count_if(F.col("citation_count") <= F.col(c) if or_at else F.col("citation_count") < F.col(c))
    exact = compared.groupBy("last").agg(F.count_distinct("customer").alias("d"), F.count(F.lit(1)).alias("m"), below("p50", False).alias("b50"), below("p50", True).alias("u50"), below("p90", False).alias("b90"), below("p90", True).alias("u90"))
    near = F.abs(F.col("n_distinct") / F.col("d") - 1) <= sketches.DISTINCT_BOUND
    fits = lambda q: sketches.rank_error(F.col(f"b{q}"), F.col(f"u{q}"), F.col("m"), q / 100) <= sketches.RANK_BOUND
    return guessed.join(exact, "last").where("n = m").select("first", "last", "n", near.alias("distinct_within"), fits(50).alias("median_within"), fits(90).alias("upper_within"))
