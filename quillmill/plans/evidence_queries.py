"""Evidence: lookups, scores and searches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.functions import text
from quillmill.operators import evidence
from quillmill.plans.catalog import query
from quillmill.plans.relations import table


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as papers: some lack a DOI, an abstract or a journal."""
    d, key = table(spark, sf_dir, "documents"), F.col("doc_id")
    return d.select(
        key.cast("string").alias("key"),
        F.when(key % 4 != 0, F.concat(F.lit("d"), key)).alias("doi"),
        F.concat(F.lit("Title "), key).alias("title"),
        F.when(key % 3 == 0, F.col("lang")).otherwise("").alias("abstract"),
        F.when(key % 2 == 0, F.col("source")).alias("journal"),
        F.lit(None).cast("string").alias("tldr"),
        F.array().cast("array<string>").alias("keywords"),
        F.when(key % 5 != 0, F.lit(0)).cast("bigint").alias("citation_count"),
        (key % 11 == 0).alias("is_retracted"),
        (2000 + key % 20).cast("int").alias("year"),
    )


def responses(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """What other sources know, by lookup key: labels and documents stand in for them."""
    labels, docs = table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents")
    key = F.col("doc_id")
    doi = F.concat(F.lit("d"), key).alias("lookup")
    s2 = labels.select(doi, F.struct(F.lit("short").alias("tldr"), F.lit("").alias("abstract"), F.lit("S2J").alias("journal"), F.lit(9).cast("bigint").alias("citation_count")).alias("response"))
    epmc = docs.where(key % 6 < 2).select(F.when(key % 4 != 0, F.concat(F.lit("d"), key)).otherwise(F.concat(F.lit("title "), key)).alias("lookup"), F.struct(F.lit("E abstract").alias("abstract"), F.lit("EJ").alias("journal"), F.array(F.lit("ek")).alias("keywords")).alias("response"))
    pm = docs.where(key % 7 == 0).select(doi, F.struct(F.lit("P abstract").alias("abstract"), F.lit("PJ").alias("journal"), F.lit(None).cast("array<string>").alias("mesh_terms")).alias("response"))
    item = F.struct(F.when(key % 7 == 0, "retracted").otherwise("notice").alias("role"))
    cr = docs.where(key % 2 == 1).select(doi, F.struct(F.concat(F.lit("Title "), key, F.when(key % 3 == 0, F.lit(" entirely other words")).otherwise("")).alias("title"), F.lit("CJ").alias("journal"), F.when(key % 9 == 0, F.array(item)).otherwise(F.array().cast("array<struct<role:string>>")).alias("retractions")).alias("response"))
    return {"semantic_scholar": s2, "europepmc": epmc, "pubmed": pm, "crossref": cr}


def enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.enrich(papers(spark, sf_dir), responses(spark, sf_dir))


ENRICHED = """
papers as (
  select doc_id, case when doc_id % 4 <> 0 then 'd' || doc_id end as doi, 'Title ' || doc_id as title, case when doc_id % 3 = 0 then lang end as abstract,
         case when doc_id % 2 = 0 then source end as journal, case when doc_id % 5 <> 0 then 0 end as citation_count, doc_id % 11 = 0 as is_retracted, 2000 + doc_id % 20 as year
  from documents),
hits as (
  select p.*, doi is not null and l.doc_id is not null as s2, doc_id % 6 < 2 as epmc, doi is not null and doc_id % 7 = 0 as pm, doi is not null and doc_id % 2 = 1 as cr
  from papers p left join (select distinct doc_id from labels) l using (doc_id)),
enriched as (
  select doc_id, doi, title, case when s2 then 'short' end as tldr,
         coalesce(abstract, case when epmc then 'E abstract' end, case when pm then 'P abstract' end, '') as abstract,
         coalesce(journal, case when s2 then 'S2J' end, case when epmc then 'EJ' end, case when pm then 'PJ' end, case when cr then 'CJ' end) as journal,
         case when epmc then 'ek' else '' end as keywords, cast(coalesce(citation_count, case when s2 then 9 end) as bigint) as citation_count,
         'openalex' || case when s2 then '|semantic_scholar' else '' end || case when epmc then '|europepmc' else '' end || case when pm then '|pubmed' else '' end as found_in,
         (case when s2 then 1 else 0 end) + (case when epmc then 1 else 0 end) + (case when pm then 1 else 0 end) as extra, is_retracted, year, pm, cr
  from hits)"""


@query(f"with {ENRICHED} select cast(doc_id as varchar) as key, tldr, abstract, journal, keywords, citation_count from enriched")
def evd_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enriched(spark, sf_dir).select("key", "tldr", "abstract", "journal", F.array_join("keywords", "|").alias("keywords"), "citation_count")


@query(f"with {ENRICHED} select cast(doc_id as varchar) as key, journal, citation_count from enriched")
def join_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enriched(spark, sf_dir).select("key", "journal", "citation_count")


@query(f"with {ENRICHED} select cast(doc_id as varchar) as key, doc_id % 6 < 2 as hit from enriched where doi is null")
def join_title_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enriched(spark, sf_dir).where("doi is null").select("key", F.col("evidence_europepmc").isNotNull().alias("hit"))


@query(f"with {ENRICHED} select cast(doc_id as varchar) as key, case when pm then 0 end as n_mesh from enriched")
def evd_mesh_always(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.when(F.col("mesh_terms").isNotNull(), F.size("mesh_terms"))
    return enriched(spark, sf_dir).select("key", n.alias("n_mesh"))


@query(f"with {ENRICHED} select cast(doc_id as varchar) as key, found_in from enriched")
def evd_found_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enriched(spark, sf_dir).select("key", F.array_join("found_in_sources", "|").alias("found_in"))


SCORED = (
    ENRICHED
    + """,
scored as (
  select *, cr and doc_id % 3 <> 0 as title_match, is_retracted or (cr and doc_id % 63 = 0) as gone from enriched),
final as (
  select *, case when gone then 0 else least(5 + (case when cr then 30 else 0 end) + (case when title_match then 25 else 0 end) + least(15 * extra, 30) + (case when abstract <> '' then 10 else 0 end), 100) end as score
  from scored)"""
)


def verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored papers; titles are compared by equality here, which SQL knows too."""
    rows = enriched(spark, sf_dir)
    same = (text.norm_title(F.col("title")) == text.norm_title(F.col("evidence_crossref")["title"])).cast("double")
    return evidence.verify(rows, same)


@query(f"with {SCORED} select cast(doc_id as varchar) as key, cr as crossref_verified, title_match, doi is not null as has_doi, gone as is_retracted, score as confidence_score from final")
def evd_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verified(spark, sf_dir).select("key", "crossref_verified", "title_match", "has_doi", "is_retracted", "confidence_score")


@query("select doc_id, doc_id % 11 = 0 or doc_id % 5 = 1 or doc_id % 5 = 3 as is_retracted from documents")
def evd_retracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By the flag, by an item's role, and by an item without one; a notice alone doesn't count."""
    key = F.col("doc_id")
    item = F.struct(F.when(key % 5 == 1, "retracted").when(key % 5 == 2, "notice").alias("role"))
    items = F.when(F.col("doc_id") % 5 == 0, F.array().cast("array<struct<role:string>>")).when(key % 5 == 4, F.lit(None)).otherwise(F.array(item))
    return table(spark, sf_dir, "documents").select("doc_id", evidence.retracted(key % 11 == 0, items).alias("is_retracted"))


def title_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each order two titles of up to some 600 characters: its parts with brand, type and supplier, and the same without every other type, in another order."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("n"), "l_partkey", "l_suppkey")
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_brand", "p_type")
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name")
    each = lines.join(parts, "l_partkey", "left").join(suppliers, "l_suppkey", "left")
    whole = F.concat_ws(" ", "p_name", "p_brand", "p_type", "s_name")
    less = F.concat_ws(" ", "p_name", F.when(F.col("n") % 2 == 0, F.col("p_type")), "p_brand", "s_name")
    listed = each.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("n", whole.alias("a"), less.alias("b")))).alias("lines"))
    return listed.select("id", F.array_join("lines.a", "; ").alias("title"), F.array_join(F.reverse("lines.b"), "; ").alias("other"))


@query()
def evd_title_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles short and long: from 200 characters on, frequent ones no longer count."""
    return title_pairs(spark, sf_dir).select("id", evidence.title_similarity(F.col("title"), F.col("other")).alias("similarity"))


@query(f"with {SCORED} select cast(doc_id as varchar) as key, score as confidence_score, cast(year as int) as year from final where not gone and score >= 30 and (contains(lower(title), '1') or contains(lower(abstract), '1') or contains(keywords, '1')) order by score desc, year desc, key limit 40")
def flt_like_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.search(verified(spark, sf_dir), "1", least=30, limit=40).select("key", "confidence_score", "year")


@query(f"with {SCORED} select cast(doc_id as varchar) as key, score as confidence_score from final order by score desc, year desc, key")
def sort_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.search(verified(spark, sf_dir), "", with_retracted=True).select("key", "confidence_score")


@query(f"with {SCORED} select count(*) filter (score >= 70) as n_confident, count(*) filter (abstract <> '') as n_with_abstract from final")
def agg_collect_headline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.headline(verified(spark, sf_dir))


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(F.concat(F.lit("NCT"), "p_partkey").alias("nct_id"), F.col("p_name").alias("title"), F.array("p_type").alias("conditions"), F.array("p_brand").alias("interventions"), F.when(F.col("p_size") > 5, F.concat(F.lit("2020-"), F.col("p_size"))).alias("first_posted"))


TRIALS = "select 'NCT' || p_partkey as nct_id, case when p_size > 5 then '2020-' || p_size end as first_posted from part where contains(lower(p_name), 'promo') or contains(lower(p_type), 'promo') or contains(lower(p_brand), 'promo')"


@query(TRIALS)
def flt_like_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.search_trials(trials(spark, sf_dir), "PROMO").select("nct_id", "first_posted")


@query(TRIALS + " order by first_posted desc nulls last, nct_id limit 30")
def sort_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.search_trials(trials(spark, sf_dir), "promo", limit=30).select("nct_id", "first_posted")


@query("select o_orderkey, c_name as pdf_url from orders left join (select * from customer where c_mktsegment = 'BUILDING') on o_custkey = c_custkey")
def join_oa_pdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("doi"), F.when(F.col("c_mktsegment") == "BUILDING", F.col("c_name")).alias("pdf_url"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("doi"))
    return evidence.oa_pdf_urls(rows, at).select("o_orderkey", "pdf_url")


@query(f"with {SCORED} select cast(f.doc_id as varchar) as key, score as confidence_score, case when doi is not null and d.lang = 'en' then 'pdf' || f.doc_id end as pdf_url from final f join documents d on f.doc_id = d.doc_id")
def evd_oa_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open-access places are looked up after scoring, and change no score; some papers are known, but have no file."""
    at = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), "doc_id").alias("doi"), F.when(F.col("lang") == "en", F.concat(F.lit("pdf"), "doc_id")).alias("pdf_url"))
    return evidence.oa_pdf_urls(verified(spark, sf_dir), at).select("key", "confidence_score", "pdf_url")


@query("select event_id, event_type in ('view', 'click') as stored from events")
def evd_cache_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("event_type") == "view", "ok").when(F.col("event_type") == "click", "not_found").otherwise(F.col("event_type"))
    return table(spark, sf_dir, "events").select("event_id", evidence.cacheable(status).alias("stored"))


@query("select event_type as source, count(*) as requests, cast(sum(user_id) as bigint) as records, count(*) filter (value > 50) as errors from events group by 1")
def agg_source_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "events").select(F.col("event_type").alias("source"), F.col("user_id").alias("n_records"), F.when(F.col("value") > 50, "slow").alias("error"))
    return evidence.source_metrics(log)


@query("select page_id, case when regexp_matches(url, '^https?://[^/]*example[.]org/') then 'org' end as source from pages")
def join_source_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", F.concat(F.regexp_extract("url", r"^(https?://)", 1), F.regexp_extract("url", r"(example\.\w+/)", 1)).alias("url"))
    hosts = spark.createDataFrame([("example.org", "org")], "host string, source string")
    return evidence.source_of_host(pages, hosts).select("page_id", "source")
