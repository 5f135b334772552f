"""Stand-ins on the driver's tables for bibliographic relations, in Spark and in SQL.

Orders are works, the parts of their lines their keywords, line items a second
provider, parts ingredients, documents papers, events a log.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.functions.text import norm_term_plain
from quillmill.operators.lexicon import alias_table, record_terms, stopword_table
from quillmill.operators.trend import cohort_weights, monthly_denominator, term_monthly
from quillmill.session import partitions

QUERY_ID = "orders"
PROVISIONAL = ["2001-08"]
ADJECTIVES = ("blue", "cold", "hot", "large", "new", "old", "red", "small")
NOUNS = ("widget", "gear", "gizmo")
LEXICON = {n.upper(): {"canonical_en": n, "aliases": [f"{a} {n}" for a in ADJECTIVES], "category": "shape"} for n in NOUNS}
STOPWORDS = ["Old-Ring", "new rod", "hot widget"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def works(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return orders.select(
        F.col("o_orderkey").alias("id"),
        F.date_format("o_orderdate", "yyyy-MM").alias("month_bucket"),
        F.to_date("o_orderdate").alias("publication_date"),
        F.floor(F.col("o_totalprice") / 1000).cast("bigint").alias("citation_count"),
        F.lit(QUERY_ID).alias("query_id"),
    )


def order_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, keyword, topic, branded) of every line."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), "l_partkey")
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("keyword"), F.col("p_type").alias("topic"), F.concat_ws(" ", "p_brand", "p_name").alias("branded"))
    return lines.join(parts, "l_partkey").drop("l_partkey")


def dimensions(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    return alias_table(spark, LEXICON), stopword_table(spark, STOPWORDS)


def line_parts(spark: SparkSession, sf_dir: str) -> int:
    """Partitions for rows of lines; a count that needs no column."""
    return partitions(spark, table(spark, sf_dir, "lineitem").count())


def resolved_terms(spark: SparkSession, sf_dir: str, field: str) -> DataFrame:
    """Resolved terms of works, one row a work and key."""
    once = order_parts(spark, sf_dir).select("id", F.array(field).alias("terms"))
    return record_terms(once, "terms", *dimensions(spark), keep=["id"], normalise=norm_term_plain, parts=line_parts(spark, sf_dir))


def work_terms(spark: SparkSession, sf_dir: str, field: str) -> DataFrame:
    """Resolved terms of works, one row a work and key, with month, citations and cohort share."""
    return resolved_terms(spark, sf_dir, field).join(cohort_weights(works(spark, sf_dir)).drop("query_id"), "id")


def works_monthly(spark: SparkSession, sf_dir: str, field: str) -> DataFrame:
    return term_monthly(work_terms(spark, sf_dir, field), denominator(spark, sf_dir), parts=line_parts(spark, sf_dir))


def denominator(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monthly_denominator(works(spark, sf_dir), provisional=PROVISIONAL)


WORKS = """
works as (
  select o_orderkey as id, strftime(o_orderdate, '%Y-%m') as month_bucket, cast(o_orderdate as date) as publication_date,
         cast(floor(o_totalprice / 1000) as bigint) as citation_count, 'orders' as query_id
  from orders)"""

WEIGHTED = (
    WORKS
    + """,
weighted as (
  select *, (rank() over (partition by month_bucket order by citation_count) - 1
             + count(*) over (partition by month_bucket, citation_count) / 2.0)
            / count(*) over (partition by month_bucket) as citation_percentile_in_cohort,
         count(*) over (partition by month_bucket) as cohort_size
  from works)"""
)

DENOMINATOR = (
    WORKS
    + """,
denominator as (
  select month_bucket, query_id, count(*) as paper_count, count(*) < 50 as is_low_sample, month_bucket in ('2001-08') as is_provisional
  from works group by 1, 2)"""
)


def surface(column: str) -> str:
    return f"trim(regexp_replace(trim(lower(coalesce({column}, ''))), '[-_/\\s]+', ' ', 'g'))"


def resolved(column: str) -> str:
    """Terms of works, resolved: forms of three nouns have keys, stopwords without a key go."""
    return f"""
parts as (select distinct l_orderkey as id, p_name as keyword, p_type as topic, p_brand || ' ' || p_name as branded from lineitem join part on l_partkey = p_partkey),
surfaces as (select distinct id, {surface(column)} as surface from parts),
hit as (
  select id, surface, case when regexp_matches(surface, '^((blue|cold|hot|large|new|old|red|small) )?(widget|gear|gizmo)$') then regexp_extract(surface, '(widget|gear|gizmo)$', 1) end as noun
  from surfaces where surface <> ''),
terms as (
  select distinct id, coalesce(upper(noun), surface) as keyword_key, coalesce(noun, surface) as canonical_en,
         case when noun is null then '' else 'shape' end as category, noun is not null as is_in_lexicon
  from hit where noun is not null or surface not in ('old ring', 'new rod', 'hot widget'))"""


def term_monthly_sql(column: str) -> str:
    return (
        WEIGHTED
        + ","
        + DENOMINATOR[len(WORKS) + 1 :]
        + ","
        + resolved(column)
        + """,
monthly as (
  select w.month_bucket, d.query_id, keyword_key, any_value(canonical_en) as canonical_en, any_value(category) as category, any_value(is_in_lexicon) as is_in_lexicon,
         count(*) as paper_count, any_value(d.paper_count) as total_papers, round(count(*) / any_value(d.paper_count), 6) as prevalence,
         cast(sum(citation_count) as bigint) as citation_sum, round(median(citation_count), 2) as citation_median,
         round(avg(citation_percentile_in_cohort), 6) as weighted_prevalence,
         any_value(d.is_low_sample) as is_low_sample, any_value(d.is_provisional) as is_provisional
  from terms join weighted w using (id) join denominator d on d.month_bucket = w.month_bucket
  group by w.month_bucket, d.query_id, keyword_key)"""
    )


PROVIDERS = """
a as (select strftime(o_orderdate, '%Y-%m') as month_bucket, cast(o_orderkey as varchar) as doi from orders),
b as (select distinct strftime(l_shipdate, '%Y-%m') as month_bucket, case when l_returnflag = 'R' then null else cast(l_orderkey as varchar) end as doi, l_orderkey, l_linenumber from lineitem)"""


def providers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    a = orders.select(F.date_format("o_orderdate", "yyyy-MM").alias("month_bucket"), F.col("o_orderkey").cast("string").alias("doi"))
    doi = F.when(F.col("l_returnflag") != "R", F.col("l_orderkey").cast("string"))
    b = lines.select(F.date_format("l_shipdate", "yyyy-MM").alias("month_bucket"), doi.alias("doi"), "l_orderkey", "l_linenumber").distinct()
    return a, b


def ingredients(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    grouped = part.groupBy("p_name").agg(F.array_sort(F.collect_set("p_brand")).alias("synonyms"), F.array_sort(F.collect_set("p_type")).alias("sources"), F.min("p_partkey").alias("least"))
    return grouped.select(F.col("p_name").alias("name_key"), F.initcap("p_name").alias("inci_name"), F.col("least").cast("string").alias("cas"), "synonyms", "sources")
