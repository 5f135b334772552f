"""Trend analytics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.functions import dates
from quillmill.functions.text import norm_mesh, norm_term_plain, suggested_key
from quillmill.operators import lexicon, suggest, trailing, trend
from quillmill.plans.catalog import query
from quillmill.plans.relations import DENOMINATOR, PROVIDERS, PROVISIONAL, WEIGHTED, WORKS, denominator, dimensions, ingredients, order_parts, providers, resolved, resolved_terms, surface, table, term_monthly_sql, work_terms, works, works_monthly

MONTHLY = "month_bucket, query_id, keyword_key, canonical_en, category, is_in_lexicon, paper_count, total_papers, prevalence, citation_sum, citation_median, weighted_prevalence, is_low_sample, is_provisional"


@query(f"with {DENOMINATOR} select * from denominator")
def agg_monthly_denominator(spark: SparkSession, sf_dir: str) -> DataFrame:
    return denominator(spark, sf_dir)


@query(f"with {term_monthly_sql('keyword')} select {MONTHLY} from monthly")
def agg_term_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return works_monthly(spark, sf_dir, "keyword")


@query(f"with {term_monthly_sql('topic')} select {MONTHLY} from monthly")
def agg_topic_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return works_monthly(spark, sf_dir, "topic")


#: Means of figures with six digits are rounded half up in whole millionths, so that no half is lost to a binary fraction.
METRICS = (
    term_monthly_sql("branded")
    + """,
numbered as (select *, cast(substr(month_bucket, 1, 4) as int) * 12 + cast(substr(month_bucket, 6, 2) as int) as m from denominator),
flagged as (
  select month_bucket, (select max(m) from numbered) - m < 12 and not is_provisional as recent,
         (select max(m) from numbered) - m between 12 and 35 as prior
  from numbered),
sizes as (select count(*) as months_observed, count(*) filter (recent) as n_recent, count(*) filter (prior) as n_prior from flagged),
per as (
  select keyword_key, query_id, any_value(canonical_en) as canonical_en, any_value(category) as category, any_value(is_in_lexicon) as is_in_lexicon,
         min(month_bucket) as first_seen_month, cast(sum(paper_count) as bigint) as total_papers, count(distinct month_bucket) as months_present,
         cast(round(coalesce(sum(prevalence) filter (recent), 0) * 1000000) as hugeint) as sum_recent, cast(round(coalesce(sum(prevalence) filter (prior), 0) * 1000000) as hugeint) as sum_prior,
         coalesce(sum(paper_count) filter (recent), 0) as papers_recent, coalesce(sum(paper_count) filter (prior), 0) as papers_prior,
         cast(round(sum(weighted_prevalence) filter (recent) * 1000000) as hugeint) as weights, count(weighted_prevalence) filter (recent) as n_weights
  from monthly join flagged using (month_bucket) group by 1, 2),
grown as (
  select *, (sum_recent / nullif(n_recent, 0)) / nullif(sum_prior / nullif(n_prior, 0), 0) as growth,
         papers_prior = 0 and papers_recent >= 5 as is_new_entrant, months_present / months_observed as presence
  from per, sizes),
metrics as (
  select keyword_key, canonical_en, category, is_in_lexicon, query_id, first_seen_month, total_papers, months_present, months_observed,
         (2 * sum_recent + n_recent) // nullif(2 * n_recent, 0) / 1e6 as prevalence_recent, (2 * sum_prior + n_prior) // nullif(2 * n_prior, 0) / 1e6 as prevalence_prior,
         (2 * sum_recent * n_prior * 10000 + sum_prior * n_recent) // nullif(2 * sum_prior * n_recent, 0) / 1e4 as growth_ratio,
         is_new_entrant, (2 * weights + n_weights) // nullif(2 * n_weights, 0) / 1e6 as weighted_prevalence_recent,
         case when total_papers < 10 then 'unrated'
              when is_new_entrant then case when presence >= 0.25 then 'emerging' else 'sporadic' end
              when growth is null then 'unrated'
              when growth >= 1.5 then case when presence < 0.25 then 'sporadic' else 'emerging' end
              when growth <= 0.67 then 'declining'
              when presence >= 0.5 then 'steady' else 'sporadic' end as trend_class
  from grown)"""
)


@query(f"with {METRICS} select * from metrics")
def agg_trend_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trend.trend_metrics(works_monthly(spark, sf_dir, "branded"), denominator(spark, sf_dir))


@query(
    f"""with {term_monthly_sql("branded")},
months as (select query_id, cast(substr(month_bucket, 1, 4) as int) * 12 + cast(substr(month_bucket, 6, 2) as int) - 1 as m, paper_count from denominator),
bounds as (select min(m) as first, max(m) as last from months),
counted as (select keyword_key, query_id, cast(substr(month_bucket, 1, 4) as int) * 12 + cast(substr(month_bucket, 6, 2) as int) - 1 as m, paper_count, prevalence from monthly),
spine as (select keyword_key, query_id, unnest(range(min(m), (select last + 1 from bounds))) as m from counted group by 1, 2),
dense as (select keyword_key, query_id, m, coalesce(paper_count, 0) as paper_count, coalesce(prevalence, 0) as prevalence from spine left join counted using (keyword_key, query_id, m)),
summed as (
  select *, sum(paper_count) over recent as papers_trailing, count(*) filter (paper_count > 0) over recent as months_present,
         cast(round(sum(prevalence) over recent * 1000000) as hugeint) as sum_recent, cast(round(coalesce(sum(prevalence) over before, 0) * 1000000) as hugeint) as sum_prior
  from dense window recent as (partition by keyword_key, query_id order by m range between 11 preceding and current row),
                    before as (partition by keyword_key, query_id order by m range between 35 preceding and 12 preceding)),
seen as (
  select c.m, (select sum(paper_count) from months where m between c.m - 11 and c.m) as papers_window, (select count(*) from months where m between c.m - 11 and c.m) as n_recent,
         (select count(*) from months where m between c.m - 35 and c.m - 12) as n_prior
  from (select unnest(range(first, last + 1)) as m from bounds) c)
select keyword_key, query_id, printf('%04d-%02d', m // 12, m % 12 + 1) as month_bucket, paper_count, cast(papers_trailing as bigint) as papers_trailing, cast(papers_window as bigint) as papers_window, months_present,
       (2 * sum_recent + n_recent) // nullif(2 * n_recent, 0) / 1e6 as prevalence_trailing, (2 * sum_prior + n_prior) // nullif(2 * n_prior, 0) / 1e6 as prevalence_before,
       (2 * sum_recent * n_prior * 10000 + sum_prior * n_recent) // nullif(2 * sum_prior * n_recent, 0) / 1e4 as growth_ratio
from summed join seen using (m)"""
)
def win_trailing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve-month prevalence and growth of every term at every month, gaps included."""
    return trailing.trailing(works_monthly(spark, sf_dir, "branded"), denominator(spark, sf_dir)).drop("canonical_en", "category", "is_in_lexicon")


@query(f"with {METRICS} select trend_class, count(*) as n from metrics group by 1")
def agg_class_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trend.class_histogram(agg_trend_metrics(spark, sf_dir))


@query(
    """select l_quantity as total, l_linenumber as months_present, l_discount * 20 as growth, l_tax < 0.01 as is_new,
  case when l_quantity < 10 then 'unrated'
       when l_tax < 0.01 then case when l_linenumber / 7.0 >= 0.25 then 'emerging' else 'sporadic' end
       when l_discount * 20 is null then 'unrated'
       when l_discount * 20 >= 1.5 then case when l_linenumber / 7.0 < 0.25 then 'sporadic' else 'emerging' end
       when l_discount * 20 <= 0.67 then 'declining'
       when l_linenumber / 7.0 >= 0.5 then 'steady' else 'sporadic' end as trend_class
from lineitem"""
)
def agg_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rules of the classification, on numbers that reach each."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("total"), F.col("l_linenumber").alias("months_present"), (F.col("l_discount") * 20).alias("growth"), (F.col("l_tax") < 0.01).alias("is_new"))
    return rows.withColumn("trend_class", trend.classify(F.col("total"), F.col("months_present"), F.lit(7.0), F.col("growth"), F.col("is_new")))


MESH = """
papers as (select l_orderkey as pmid, strftime(min(l_shipdate), '%Y-%m') as month_bucket from lineitem group by 1),
headings as (select distinct l_orderkey as pmid, lower(trim(p_type)) as mesh_term from lineitem join part on l_partkey = p_partkey),
totals as (select month_bucket, count(*) as total_papers from papers group by 1)"""


def mesh_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    months = lines.groupBy(F.col("l_orderkey").alias("pmid")).agg(F.date_format(F.min("l_shipdate"), "yyyy-MM").alias("month_bucket"))
    terms = order_parts(spark, sf_dir).groupBy(F.col("id").alias("pmid")).agg(F.collect_list("topic").alias("mesh_terms"))
    return months.join(terms, "pmid", "left")


@query(
    f"""with {MESH}
select month_bucket, 'lines' as query_id, mesh_term, count(*) as paper_count, any_value(total_papers) as total_papers,
       round(count(*) / any_value(total_papers), 6) as prevalence, any_value(total_papers) < 50 as is_low_sample, month_bucket in ('2001-08') as is_provisional
from papers join headings using (pmid) join totals using (month_bucket) group by month_bucket, mesh_term"""
)
def agg_mesh_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trend.mesh_monthly(mesh_papers(spark, sf_dir), provisional=PROVISIONAL, query_id="lines")


OVERLAP = f"""{PROVIDERS},
sides as (select month_bucket, doi, bool_or(s = 1) as in_a, bool_or(s = 2) as in_b from (select month_bucket, doi, 1 as s from a union all select month_bucket, doi, 2 from b) where doi <> '' group by 1, 2),
rows_a as (select month_bucket, count(*) as n from a group by 1),
rows_b as (select month_bucket, count(*) as n, count(*) filter (coalesce(doi, '') = '') as missing from b group by 1),
dois as (select month_bucket, count(*) filter (in_a and in_b) as "both", count(*) filter (not in_b) as only_a, count(*) filter (not in_a) as only_b from sides group by 1),
overlap as (
  select month_bucket, coalesce(rows_a.n, 0) as openalex_papers, coalesce(rows_b.n, 0) as pubmed_papers, coalesce("both", 0) as "both",
         coalesce(only_a, 0) as openalex_only, coalesce(only_b, 0) as pubmed_only, coalesce(missing, 0) as doi_missing
  from rows_a full join rows_b using (month_bucket) left join dois using (month_bucket))"""


@query(f"with {OVERLAP} select * from overlap")
def agg_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trend.overlap(*providers(spark, sf_dir))


OVERLAP_COLUMNS = ("openalex_papers", "pubmed_papers", "both", "openalex_only", "pubmed_only", "doi_missing")


@query(f"with {OVERLAP} select {', '.join(f'cast(sum("{c}") as bigint) as "{c}"' for c in OVERLAP_COLUMNS)} from overlap")
def agg_overlap_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trend.overlap_totals(agg_overlap(spark, sf_dir))


@query(f"with {PROVIDERS} select coalesce(x.month_bucket, y.month_bucket) as month_bucket, coalesce(x.doi, y.doi) as doi, x.doi is not null as in_a, y.doi is not null as in_b from (select distinct * from a) x full join (select distinct month_bucket, doi from b where doi is not null) y on x.month_bucket = y.month_bucket and x.doi = y.doi")
def join_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    sides = trend.overlap_sides(*providers(spark, sf_dir))
    return sides.select("month_bucket", "doi", F.col("side").bitwiseAND(1).cast("boolean").alias("in_a"), F.col("side").bitwiseAND(2).cast("boolean").alias("in_b"))


@query(
    """with o as (select o_orderkey as id, [o_orderpriority, o_orderstatus] as topics from orders), banned as (select lower(trim(r_name)) as t from region union select '1-urgent' union select 'p')
select id, array_to_string(topics, '|') as topics from o where not exists (select 1 from banned where list_contains(list_transform(topics, lambda x: lower(trim(x))), t))"""
)
def flt_exclude_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Works without those of unwanted topics."""
    works_ = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.array("o_orderpriority", "o_orderstatus").alias("topics"))
    banned = table(spark, sf_dir, "region").select("r_name").unionByName(spark.createDataFrame([(" 1-URGENT",), ("p",), (None,)], "r_name string"))
    return trend.without_topics(works_, banned).select("id", F.array_join("topics", "|").alias("topics"))


def open_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of works with a title and an input position."""
    titles = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.concat_ws(" ", F.lit(" Order"), F.col("o_orderkey").cast("string"), "o_orderpriority").alias("title"))
    return work_terms(spark, sf_dir, "keyword").join(titles, "id").withColumn("ord", F.col("id"))


UNMATCHED = f"""{WORKS}, {resolved("keyword")},
open as (
  select keyword_key, month_bucket, id, left(trim(' Order ' || id || ' ' || o_orderpriority), 140) as title,
         row_number() over (partition by keyword_key order by id) as k
  from terms join works using (id) join orders on id = o_orderkey where not is_in_lexicon),
unmatched as (
  select cast(row_number() over (order by count(*) desc, keyword_key) as int) as rank, keyword_key as term, count(*) as paper_count, min(month_bucket) as first_seen_month,
         max(month_bucket) as last_seen_month, count(distinct month_bucket) as months_present,
         coalesce(max(title) filter (k = 1), '') as example_title_1, coalesce(max(title) filter (k = 2), '') as example_title_2, coalesce(max(title) filter (k = 3), '') as example_title_3,
         '' as verdict
  from open group by keyword_key)"""


@query(f"with {UNMATCHED} select * from unmatched")
def agg_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trend.unmatched(open_terms(spark, sf_dir))


@query(f"with {UNMATCHED} select rank, term, paper_count from unmatched")
def win_unmatched_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trend.unmatched(open_terms(spark, sf_dir)).select("rank", "term", "paper_count")


@query(f"with {UNMATCHED} select rank, term, paper_count from unmatched where rank <= 10")
def topk_cli(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trend.unmatched(open_terms(spark, sf_dir), top=10).select("rank", "term", "paper_count")


@query(f"with {UNMATCHED} select term, first_seen_month from unmatched")
def win_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trend.unmatched(open_terms(spark, sf_dir)).select("term", "first_seen_month")


@query(f"with {UNMATCHED} select term, last_seen_month from unmatched")
def win_last_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trend.unmatched(open_terms(spark, sf_dir)).select("term", "last_seen_month")


SUGGEST = f"""{UNMATCHED},
ingredient as (select p_name as name_key, min(p_partkey) as cas, list_sort(list(distinct p_type)) as sources from part group by 1)"""


@query(
    f"""with {SUGGEST}
select term, paper_count, name_key as matched_name_key, 'name_key' as matched_via, array_to_string(list_transform(string_split(name_key, ' '), lambda x: upper(x[1]) || x[2:]), ' ') as inci_name,
       cast(cas as varchar) as cas, array_to_string(sources, ', ') as sources,
       upper(replace(name_key, ' ', '_')) || case when name_key in ('red ring') then ' (기존 키 있음)' else '' end as suggested_key, '' as verdict
from unmatched join ingredient on term = name_key"""
)
def join_suggest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = trend.unmatched(open_terms(spark, sf_dir)).select("term", "paper_count")
    return suggest.suggestions(found, ingredients(spark, sf_dir), ["RED_RING"], norm_term_plain)


@query("select cast(year(o_orderdate) as int) as year, count(*) as n from orders group by 1")
def agg_year_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trend.year_histogram(table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("year")))


@query(
    f"""with {resolved("keyword")}
select 'keywords' as field, (select count(distinct keyword) from parts) as before, (select count(distinct keyword_key) from terms) as after,
       (select count(distinct keyword) from parts) - (select count(distinct keyword_key) from terms) as reduction,
       (select count(distinct keyword_key) from terms where is_in_lexicon) as lexicon_keys"""
)
def agg_normalize_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = order_parts(spark, sf_dir).select(F.array("keyword").alias("keywords"))
    return lexicon.normalize_summary(records, "keywords", *dimensions(spark), normalise=norm_term_plain)


@query("select p_name as term, count(*) as n from (select distinct l_orderkey, p_name from lineitem join part on l_partkey = p_partkey) group by 1 order by n desc, term limit 20")
def agg_top_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon.top_terms(order_parts(spark, sf_dir).select("id", F.col("keyword").alias("term")).distinct(), "term", 20)


@query(f"with {WORKS}, {resolved('keyword')} select canonical_en, count(*) as n from terms group by 1 order by n desc, canonical_en limit 20")
def agg_top_terms_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon.top_terms(work_terms(spark, sf_dir, "keyword"), "canonical_en", 20)


@query(
    """with r as (select *, case when o_orderpriority like '1%' then null else o_orderdate end as d from orders)
select count(*) as total, count(d) as precision_day, cast(0 as bigint) as precision_month, count(*) filter (d is null) as precision_year_only, cast(0 as bigint) as precision_unknown,
       count(distinct strftime(d, '%Y-%m')) as months, count(*) filter (o_orderstatus <> 'F') as with_doi, count(*) filter (d is null) as excluded,
       count(distinct o_orderpriority) as distinct_keywords, count(distinct o_orderstatus) as distinct_topics, cast(0 as bigint) as distinct_concepts
from r"""
)
def agg_records_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    dated = ~F.col("o_orderpriority").like("1%")
    rows = table(spark, sf_dir, "orders").select(
        F.when(dated, F.date_format("o_orderdate", "yyyy-MM")).alias("month_bucket"),
        F.when(dated, "day").otherwise("year_only").alias("date_precision"),
        F.when(F.col("o_orderstatus") != "F", F.col("o_orderkey").cast("string")).alias("doi"),
        F.array("o_orderpriority").alias("keywords"),
        F.array("o_orderstatus").alias("topics"),
        F.array().cast("array<string>").alias("concepts"),
    )
    return trend.records_summary(rows)


@query(f"with {WEIGHTED} select id, month_bucket, citation_count, round(citation_percentile_in_cohort, 9) as percentile, cohort_size from weighted")
def win_cohort_midrank(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = trend.cohort_weights(works(spark, sf_dir))
    return rows.select("id", "month_bucket", "citation_count", F.round("citation_percentile_in_cohort", 9).alias("percentile"), "cohort_size")


@query(
    f"""with {WORKS}, m as (select id, case when id % 10 = 0 then null else month_bucket end as month_bucket, citation_count from works)
select id, case when month_bucket is not null then round((rank() over (partition by month_bucket order by citation_count) - 1 + count(*) over (partition by month_bucket, citation_count) / 2.0) / count(*) over (partition by month_bucket), 9) end as percentile,
       count(*) over (partition by month_bucket) as cohort_size from m"""
)
def win_assign_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Works without a month are a cohort of their own, without a percentile."""
    rows = works(spark, sf_dir).withColumn("month_bucket", F.when(F.col("id") % 10 != 0, F.col("month_bucket")))
    return trend.cohort_weights(rows).select("id", F.round("citation_percentile_in_cohort", 9).alias("percentile"), "cohort_size")


@query(f"with {WORKS} select id, round(citation_count / greatest(date_diff('day', publication_date, date '2001-09-01') / 365.25, 0.5), 6) as citation_per_year from works")
def win_citation_per_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = dates.citation_per_year(F.col("citation_count"), F.col("publication_date").cast("string"), F.lit("2001-09-01"))
    return works(spark, sf_dir).select("id", F.round(value, 6).alias("citation_per_year"))


@query(f"with {WORKS} select id, month_bucket, count(*) over (partition by month_bucket) as total_papers from works")
def win_denominator(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = denominator(spark, sf_dir).select("month_bucket", F.col("paper_count").alias("total_papers"))
    return works(spark, sf_dir).select("id", "month_bucket").join(totals, "month_bucket").select("id", "month_bucket", "total_papers")


@query(f"with {WORKS} select distinct month_bucket, strftime(strptime(month_bucket || '-01', '%Y-%m-%d') - interval 11 month, '%Y-%m') as back, strftime(strptime(month_bucket || '-01', '%Y-%m-%d') + interval 5 month, '%Y-%m') as ahead from works")
def win_month_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("month_bucket")
    return works(spark, sf_dir).select(m, dates.month_add(m, -11).alias("back"), dates.month_add(m, 5).alias("ahead")).distinct()


@query(
    """with s as (select cast(min(o_orderdate) as date) as a, cast(max(o_orderdate) as date) as z from orders),
m as (select unnest(generate_series(date_trunc('month', a), date_trunc('month', z), interval 1 month)) as d, a, z from s)
select strftime(d, '%Y-%m') as month, greatest(cast(d as date), a) as first_day, least(last_day(d), z) as last_day from m"""
)
def win_month_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    span = table(spark, sf_dir, "orders").agg(F.to_date(F.min("o_orderdate")).alias("a"), F.to_date(F.max("o_orderdate")).alias("z"))
    return span.select(F.inline(dates.month_series(F.col("a"), F.col("z"))))


@query(f"with {WORKS} select distinct month_bucket, month_bucket >= '2001-06' as is_provisional from works")
def win_provisional(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = trend.provisional_from(F.lit("2001-08-02"), 3)
    return works(spark, sf_dir).select("month_bucket", (F.col("month_bucket") >= first).alias("is_provisional")).distinct()


@query(f"select distinct p_name as term, {surface('p_name')} as surface from part")
def norm_term(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillmill.functions.text import norm_term as full

    return lexicon.surfaces(table(spark, sf_dir, "part").select(F.col("p_name").alias("term")).distinct(), "term", full)


@query(f"with {WORKS}, {resolved('keyword')} select distinct keyword_key, canonical_en, category, is_in_lexicon from terms")
def norm_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return work_terms(spark, sf_dir, "keyword").select("keyword_key", "canonical_en", "category", "is_in_lexicon").distinct()


@query(f"with {WORKS}, {resolved('keyword')} select id, keyword_key from terms")
def norm_dedup_in_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    return work_terms(spark, sf_dir, "keyword").select("id", "keyword_key")


@query(f"with {WORKS}, k as (with {resolved('keyword')[1:]} select id, 'keywords' as field, keyword_key from terms), t as (with {resolved('topic')[1:]} select id, 'topics' as field, keyword_key from terms) select * from k union all select * from t")
def norm_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each list of a record is resolved for itself."""
    each = [resolved_terms(spark, sf_dir, c).select("id", F.lit(f).alias("field"), "keyword_key") for c, f in (("keyword", "keywords"), ("topic", "topics"))]
    return each[0].unionByName(each[1])


@query("select distinct l_orderkey as pmid, lower(trim(p_type)) as mesh_term from lineitem join part on l_partkey = p_partkey", name="norm_mesh")
def norm_mesh_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_parts(spark, sf_dir).select(F.col("id").alias("pmid"), norm_mesh(F.col("topic")).alias("mesh_term")).distinct()


@query("select distinct p_name as name_key, upper(replace(trim(p_name), ' ', '_')) as suggested_key from part", name="norm_suggested_key")
def norm_suggested(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_name").alias("name_key"), suggested_key(F.col("p_name")).alias("suggested_key")).distinct()


@query("select distinct p_name as term, case when regexp_matches(p_name, ' (widget|gear|gizmo)$') then upper(string_split(p_name, ' ')[2]) end as keyword_key from part")
def join_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    aliases, _ = dimensions(spark)
    terms = table(spark, sf_dir, "part").select(F.col("p_name").alias("term")).distinct().withColumn("surface", norm_term_plain(F.col("term")))
    return terms.join(aliases, "surface", "left").select("term", "keyword_key")


STOPPED = "select distinct p_name as term from part where p_name not in ('old ring', 'new rod')"


@query("select p_partkey, p_name as term, p_name in ('old ring', 'new rod', 'hot widget') as is_stopword, regexp_matches(p_name, '^((blue|cold|hot|large|new|old|red|small) )?(widget|gear|gizmo)$') as is_in_lexicon from part")
def join_stopwords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both small tables joined to every part; one form is in both."""
    aliases, stops = dimensions(spark)
    parts = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("term"), norm_term_plain(F.col("p_name")).alias("surface"))
    known = parts.join(aliases.select("surface", F.lit(True).alias("a")), "surface", "left").join(stops.select("surface", F.lit(True).alias("s")), "surface", "left")
    return known.select("p_partkey", "term", F.coalesce("s", F.lit(False)).alias("is_stopword"), F.coalesce("a", F.lit(False)).alias("is_in_lexicon"))


@query(STOPPED)
def flt_stopword(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stopword that the lexicon also has stays."""
    terms = table(spark, sf_dir, "part").select(F.col("p_name").alias("term")).distinct()
    return lexicon.resolve(lexicon.surfaces(terms, "term", norm_term_plain), *dimensions(spark)).select("term")


@query(f"with {term_monthly_sql('keyword')} select month_bucket, keyword_key, paper_count, total_papers from monthly")
def join_denominator(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg_term_monthly(spark, sf_dir).select("month_bucket", "keyword_key", "paper_count", "total_papers")


@query(f"with {WORKS}, m as (select case when id % 7 = 0 then null else month_bucket end as month_bucket from works) select month_bucket, count(*) as paper_count from m where month_bucket is not null group by 1")
def flt_month_not_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = works(spark, sf_dir).withColumn("month_bucket", F.when(F.col("id") % 7 != 0, F.col("month_bucket")))
    return trend.monthly_denominator(rows).select("month_bucket", "paper_count")


@query(
    """with m as (select strftime(o_orderdate, '%Y-%m') as month, count(*) as expected, count(*) filter (o_orderkey % 1000 <> 1) as collected from orders group by 1)
select month, expected = collected as passes, case when expected <> collected then 'collection of ' || collected || ' of ' || expected || ' works is not a census' end as warning from m"""
)
def flt_census_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each month's collection before the guard: complete ones pass, partial ones are refused, or only warned of when samples are allowed."""
    key, rows = F.col("o_orderkey") % 1000, []
    months = table(spark, sf_dir, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("expected"), F.count_if(key != 1).alias("collected"))
    for r in months.collect():  # a row a month
        meta = {"is_census": r["expected"] == r["collected"], "collected": r["collected"], "expected_from_api": r["expected"]}
        try:
            passes = trend.census_guard(meta) is None
        except trend.CensusError:
            passes = False
        rows.append((r["month"], passes, trend.census_guard(meta, allow_sample=True)))
    return spark.createDataFrame(rows, "month string, passes boolean, warning string")


@query(f"with {term_monthly_sql('keyword')} select month_bucket, paper_count, keyword_key from monthly order by month_bucket, paper_count desc, keyword_key")
def sort_term_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg_term_monthly(spark, sf_dir).select("month_bucket", "paper_count", "keyword_key").orderBy("month_bucket", F.desc("paper_count"), "keyword_key")


@query(f"with {METRICS} select total_papers, keyword_key from metrics order by total_papers desc, keyword_key")
def sort_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg_trend_metrics(spark, sf_dir).select("total_papers", "keyword_key").orderBy(F.desc("total_papers"), "keyword_key")


@query(f"with {MESH} select month_bucket, count(*) as paper_count, mesh_term from papers join headings using (pmid) group by 1, 3 order by 1, 2 desc, 3")
def sort_mesh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg_mesh_monthly(spark, sf_dir).select("month_bucket", "paper_count", "mesh_term").orderBy("month_bucket", F.desc("paper_count"), "mesh_term")


@query(f"with {SUGGEST} select paper_count, term from unmatched join ingredient on term = name_key order by paper_count desc, term")
def sort_suggest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_suggest(spark, sf_dir).select("paper_count", "term").orderBy(F.desc("paper_count"), "term")


@query(f"with {PROVIDERS} select month_bucket, doi from a intersect select month_bucket, doi from b")
def set_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = providers(spark, sf_dir)
    return a.intersect(b.select("month_bucket", "doi"))


@query(f"with {PROVIDERS} select month_bucket, doi from a except select month_bucket, doi from b")
def set_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = providers(spark, sf_dir)
    return a.subtract(b.select("month_bucket", "doi"))


@query(f"with {PROVIDERS} select month_bucket from a union select month_bucket from b")
def set_union_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = providers(spark, sf_dir)
    return a.select("month_bucket").union(b.select("month_bucket")).distinct()


@query("select month, n, total from (select strftime(o_orderdate, '%Y-%m') as month, o_orderpriority as key, count(*) as n from orders group by grouping sets ((1, 2), (1), ())) x, (select count(*) as total from orders) where key is null and month is not null")
def ext_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: months and their grand total from one pass over grouping sets."""
    orders = table(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("month"), F.col("o_orderpriority").alias("key"))
    grouped = orders.groupingSets([("month", "key"), ("month",), ()], "month", "key").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("g"))
    total = grouped.where("g = 3").select(F.col("n").alias("total"))
    return grouped.where("g = 1").select("month", "n").crossJoin(F.broadcast(total))
