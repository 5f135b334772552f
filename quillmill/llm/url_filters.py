"""URL filter lists, in DataFrame functions alone.

A URL is expanded into every host suffix joined with every path prefix that a
rule could name; the expressions' SHA-256 digests meet the rules on their first
four bytes, the full digests then confirm, and the longest rule wins.

Rules up to ``BROADCAST_RULES`` are broadcast, after a count. A longer list is
shuffled instead: each rule is dealt out over ``SALTS`` copies, so that an
expression which a third of all URLs share still spreads over many tasks.

Defined cases: a null URL, or one without ``://``, has an empty host and path
and fits no rule; equal rules count once (block before allow, if they differ);
rules with a null host or path are ignored; repeated rows are judged one by
one. The result has the kept columns, then host, path, rule and verdict.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_RULES = 200_000
SALTS = 16
PREFIX_DIGITS = 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def host_suffixes(host: Column) -> Column:
    labels = F.split(host, r"\.")
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")))


def path_prefixes(path: Column, lengths: list[int]) -> Column:
    """Prefixes that end in a slash, the empty one, and those of the given lengths."""
    parts = F.split(path, "/")
    slashed = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.when(i == 0, "").otherwise(F.concat(F.array_join(F.slice(parts, 1, i), "/"), F.lit("/"))))
    if not lengths:
        return slashed
    others = F.filter(F.transform(F.array(*[F.lit(n) for n in lengths]), lambda n: F.when(F.char_length(path) >= n, F.substring(path, F.lit(1), n))), lambda p: p.isNotNull())
    return F.array_distinct(F.concat(slashed, others))


def filter_urls(pages: DataFrame, rules: DataFrame, keep: tuple[str, ...], url: str = "url", default: str = "allow", broadcast_rules: int = BROADCAST_RULES) -> DataFrame:
    """``rules`` has host, path and verdict. Kept columns whose names clash with the result's are left out."""
    listed = rules.select(F.translate("host", UPPER, LOWER).alias("h"), F.col("path").alias("p"), F.col("verdict").alias("v")).where("h is not null and p is not null")
    listed = listed.groupBy(F.concat("h", "p").alias("rule"), "h", "p").agg(F.max("v").alias("v"))
    digest = F.sha2(F.concat_ws("\n", "h", "p"), 256)
    listed = listed.select("rule", "v", F.substring(digest, 1, PREFIX_DIGITS).alias("short"), digest.alias("full"), F.when(~F.col("p").endswith("/") & (F.col("p") != ""), F.char_length("p")).alias("odd"))
    few = listed.limit(broadcast_rules + 1).count() <= broadcast_rules
    odd = sorted(r[0] for r in listed.select("odd").where("odd is not null").distinct().collect())  # at most one number for each length of a path

    names = [k for k in keep if k not in ("host", "path", "rule", "verdict")]
    tagged = pages.select(F.struct(*names).alias("own"), F.monotonically_increasing_id().alias("row"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    pairs = F.flatten(F.transform(host_suffixes(F.col("host")), lambda h: F.transform(path_prefixes(F.col("path"), odd), lambda p: F.sha2(F.concat(h, F.lit("\n"), p), 256))))
    each = tagged.select("own", "row", "host", "path", F.explode_outer(pairs).alias("digest"))
    each = each.withColumn("short", F.substring("digest", 1, PREFIX_DIGITS))
    rule = listed.select("rule", "v", "short", "full")
    if few:
        met = each.join(F.broadcast(rule), "short", "left")
    else:
        salted = rule.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = each.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")).join(salted, ["short", "salt"], "left")
    best = F.when(F.col("full") == F.col("digest"), F.struct(F.char_length("rule").alias("n"), "rule", "v"))
    won = met.groupBy("row").agg(F.first("own").alias("own"), F.first("host").alias("host"), F.first("path").alias("path"), F.max(best).alias("best"))
    return won.select("own.*", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.v", F.lit(default)).alias("verdict"))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(
        [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")],
        "host string, path string, verdict string",
    )
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules, ("page_id",))


ORACLE = r"""
with parsed as (
  select page_id,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) as path
  from pages
), rules(h, p, v) as (
  values ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), met as (
  select page_id, host, path, h || p as rule, v
  from parsed left join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, p)
), ranked as (
  select *, row_number() over (partition by page_id order by length(rule) desc nulls last) as k from met
)
select page_id, host, path, rule, coalesce(v, 'allow') as verdict from ranked where k = 1
"""
