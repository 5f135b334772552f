"""Upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.operators import merge
from quillmill.plans.catalog import query
from quillmill.plans.relations import table
from quillmill.plans.stream_queries import work_dir
from quillmill.sources import runlog
from quillmill.sources.versioned import VersionedTable


def versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Parts below a size as the old table; new rows for some of them and for others, in input order by seq."""
    p = table(spark, sf_dir, "part")
    old = p.where("p_size <= 30").select(F.col("p_partkey").cast("string").alias("k"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.array("p_type").alias("tags"))
    fresh = p.where("p_size >= 20")
    new = fresh.select(F.col("p_partkey").cast("string").alias("k"), F.when(F.col("p_size") % 2 == 0, F.lit("")).otherwise(F.lit("new")).alias("name"), F.lit("B").alias("brand"), F.array(F.lit("t"), F.col("p_type")).alias("tags"), F.lit(1).cast("long").alias("seq"))
    later = fresh.where("p_size >= 40").select(F.col("p_partkey").cast("string").alias("k"), F.lit(None).cast("string").alias("name"), F.lit("C").alias("brand"), F.array(F.lit("u")).alias("tags"), F.lit(2).cast("long").alias("seq"))
    return old, new.unionByName(later)


def shown(df: DataFrame) -> DataFrame:
    return df.withColumn("tags", F.array_join("tags", "|"))


@query("select cast(p_partkey as varchar) as k, case when p_size < 20 then p_name when p_size >= 40 then null when p_size % 2 = 0 then '' else 'new' end as name, case when p_size < 20 then p_brand when p_size >= 40 then 'C' else 'B' end as brand, case when p_size < 20 then p_type when p_size >= 40 then 'u' else 't|' || p_type end as tags from part")
def mrg_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = versions(spark, sf_dir)
    return shown(merge.merge(old, new, ["k"], policy="overwrite"))


@query("select cast(p_partkey as varchar) as k, case when p_size < 20 then p_name when p_size % 2 = 1 then 'new' when p_size <= 30 then p_name end as name, case when p_size < 20 then p_brand when p_size >= 40 then 'C' else 'B' end as brand, case when p_size < 20 then p_type when p_size <= 30 then p_type || '|t' when p_size >= 40 then 't|' || p_type || '|u' else 't|' || p_type end as tags from part")
def mrg_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = versions(spark, sf_dir)
    return shown(merge.merge(old, new, ["k"]))


@query("select cast(p_partkey as varchar) as k, case when p_size < 20 then p_name when p_size % 2 = 1 then 'new' when p_size <= 30 then p_name end as name, case when p_size < 20 then p_brand else 'B' end as brand from part")
def mrg_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = versions(spark, sf_dir)
    return merge.merge_papers(old.select("k", "name", "brand"), new.where("seq = 1").select("k", "name", "brand"), verification=["brand"], key="k")


@query(
    """select cast(p_partkey as varchar) as k, case when p_size < 20 then p_name when p_size % 2 = 1 then 'new' when p_size <= 30 then p_name end as name,
  case when p_size < 20 then p_brand when p_size >= 40 then 'C' else 'B' end as brand, case when p_size >= 40 then p_partkey % 7 end as rating, 4 as version from part"""
)
def mrg_versioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored table after three upserts, of which the last brings a column, and a reader's version."""
    old, new = versions(spark, sf_dir)
    stored = VersionedTable(spark, f"{work_dir(spark)}/parts", ["k"], buckets=8)
    add = lambda a, b: merge.merge(a, b, ["k"])
    stored.upsert(old.drop("tags").withColumn("seq", F.lit(0).cast("long")), add, ("seq",))
    stored.upsert(new.where("seq = 1").drop("tags"), add, ("seq",))
    before = stored.read()
    stored.upsert(new.where("seq = 2").drop("tags"), add, ("seq",))
    rated = before.where("brand = 'B'").select("k").join(new.where("seq = 2").select("k"), "k").withColumns({"rating": F.pmod(F.col("k").cast("bigint"), F.lit(7)), "seq": F.lit(3).cast("long")})
    stored.upsert(rated, add, ("seq",))
    return stored.read().withColumn("version", F.lit(stored.versions()[-1]))


CACHE = "select event_type as source, cast(user_id as varchar) as key, max_by(cast(event_id as varchar), event_id) as response from events where user_id % 5 <> 0 group by 1, 2"


def cached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers in two batches: the second replaces what it shares with the first."""
    e = table(spark, sf_dir, "events")
    key = F.when(F.col("user_id") % 5 != 0, F.col("user_id").cast("string")).otherwise("")
    rows = e.select(F.col("event_type").alias("source"), key.alias("key"), F.col("event_id").cast("string").alias("response"), F.col("event_id").alias("seq"))
    middle = e.agg(F.floor(F.max("event_id") / 2).alias("m"))
    split = rows.crossJoin(F.broadcast(middle))
    empty = rows.drop("seq").limit(0)
    first = merge.cache_put(empty, split.where("seq <= m").drop("m"))
    return merge.cache_put(first, split.where("seq > m").drop("m"))


@query(CACHE)
def mrg_cache_put(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cached(spark, sf_dir)


@query("select event_type as run_id, cast(user_id as varchar) as source, max_by(value, event_id) as records from events group by 1, 2")
def mrg_run_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("run_id"), F.col("user_id").cast("string").alias("source"), F.col("value").alias("records"), F.col("event_id").alias("seq"))
    return merge.overwrite(e.drop("seq").limit(0), e, ["run_id", "source"])


@query("select distinct o_custkey as key from orders where o_custkey not in (select c_custkey from customer where c_acctbal > 0)")
def join_cache_miss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that no stored answer has."""
    wanted = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key")).distinct()
    stored = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("key"))
    return merge.cache_misses(wanted, stored, ["key"])


@query("select coalesce(nullif(p_type, 'PROMO'), '') as doi, max(p_partkey) as seq_kept from part group by 1")
def mrg_null_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null key parts meet, as ''."""
    rows = table(spark, sf_dir, "part").select(F.nullif(F.col("p_type"), F.lit("PROMO")).alias("doi"), F.col("p_partkey").alias("seq_kept"), F.col("p_partkey").alias("seq"))
    return merge.overwrite(rows.drop("seq").limit(0), rows, ["doi"])


@query("select cast(event_id as varchar) as run_id, event_type as source, 'https://h/p?q=' || user_id as url, 200 as status from events")
def snk_fetchlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the fetch log stores of each request: URLs less their secrets."""
    log = runlog.RunLog(spark, work_dir(spark))
    url = F.concat(F.lit("https://h/p?q="), F.col("user_id"), F.lit("&token="), F.col("event_id"))
    notes = table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("run_id"), F.col("event_type").alias("source"), url.alias("url"), F.lit(200).alias("status"), F.lit(0.0).alias("elapsed"), F.lit(None).cast("string").alias("error"), F.lit("now").alias("at"))
    log.fetch_rows(notes)
    return log.fetched().select("run_id", "source", "url", "status")
