"""Sources, projections, predicates and scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.functions import dates, pubmed, records, text
from quillmill.operators import evidence, merge
from quillmill.plans.catalog import query
from quillmill.plans.relations import ADJECTIVES, NOUNS, dimensions, table
from quillmill.plans.stream_queries import work_dir
from quillmill.sources import files


def raw_works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as raw JSON works; some fields are of the wrong kind, as in dirty input."""
    o = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    raw = F.concat(
        F.lit('{"id": "W'), key, F.lit('", "doi": "https://doi.org/10.1/A'), key, F.lit('", "title": "Order '), key,
        F.lit('", "publication_date": "'), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit('", "publication_year": '), F.year("o_orderdate"),
        F.lit(', "primary_location": {"source": {"display_name": "'), F.col("o_orderstatus"), F.lit('"}}, "keywords": '),
        F.when(key % 5 == 0, F.lit('"none"')).otherwise(F.concat(F.lit('[{"display_name": "'), F.col("o_orderpriority"), F.lit('"}, 7, {"display_name": ""}]'))),
        F.lit(', "authorships": [{"author": {"display_name": "C'), F.col("o_custkey"), F.lit('"}}], "topics": [], "cited_by_count": '),
        F.when(key % 3 == 0, F.lit("null")).otherwise(F.floor(F.col("o_totalprice") / 1000).cast("string")), F.lit("}"),
    )
    return o.select(key.alias("o_orderkey"), F.when(key % 50 == 0, F.lit("not json")).otherwise(raw).alias("value"))


RAW_COLUMNS = """'W' || o_orderkey as openalex_id, '10.1/a' || o_orderkey as doi, 'Order ' || o_orderkey as title,
strftime(o_orderdate, '%Y-%m-%d') as publication_date, strftime(o_orderdate, '%Y-%m') as month_bucket, 'day' as date_precision, cast(year(o_orderdate) as int) as year,
o_orderstatus as journal, case when o_orderkey % 5 = 0 then [] else [o_orderpriority] end as keywords, [] as topics, [] as concepts,
case when o_orderkey % 3 = 0 then 0 else cast(floor(o_totalprice / 1000) as bigint) end as citation_count, '2001-08-01' as collected_at, 'q' as query_id, 'openalex' as provider"""


def lists_as_text(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.array_join(n, "|") for n in names})


@query(f"select * replace (array_to_string(keywords, '|') as keywords, '' as topics, '' as concepts) from (select {RAW_COLUMNS} from orders where o_orderkey % 50 <> 0)")
def proj_trend_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = raw_works(spark, sf_dir).select(records.raw_json(F.col("value")).alias("v")).where("v is not null")
    return lists_as_text(v.select(*records.trend_record(F.col("v"), "q", "2001-08-01")), "keywords", "topics", "concepts")


@query("select 'W' || o_orderkey as id, o_orderpriority as keyword from orders where o_orderkey % 50 <> 0 and o_orderkey % 5 <> 0")
def proj_display_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = raw_works(spark, sf_dir).select(records.raw_json(F.col("value")).alias("v"))
    return v.select(records.at(F.col("v"), "$.id").alias("id"), F.explode(records.display_names(F.col("v"), "keywords")).alias("keyword"))


@query("select 'W' || o_orderkey as id, 'C' || o_custkey as author from orders where o_orderkey % 50 <> 0")
def proj_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = raw_works(spark, sf_dir).select(records.raw_json(F.col("value")).alias("v"))
    return v.select(records.at(F.col("v"), "$.id").alias("id"), F.explode(records.authors(F.col("v"))).alias("author"))


@query("select '10.1/a' || o_orderkey as doi, 'W' || o_orderkey as openalex_id, 'https://doi.org/10.1/a' || o_orderkey as url, cast(year(o_orderdate) as int) as year, case when o_orderkey % 3 = 0 then null else cast(floor(o_totalprice / 1000) as bigint) end as citation_count, false as is_retracted from orders where o_orderkey % 50 <> 0")
def proj_paper_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = raw_works(spark, sf_dir).select(records.raw_json(F.col("value")).alias("v")).where("v is not null")
    return v.select(*records.paper_record(F.col("v"))).select("doi", "openalex_id", "url", "year", "citation_count", "is_retracted")


DUPLICATES = "select l_orderkey, l_linenumber, min(l_partkey * 1000000 + l_suppkey) as kept from lineitem group by 1, 2"


@query(DUPLICATES)
def dedup_first_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first row of each key, in an explicit order."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") * 1000000 + F.col("l_suppkey")).alias("kept"))
    return merge.first_by_key(lines, ["l_orderkey", "l_linenumber"], [F.col("kept")])


@query("select 'W' || o_orderkey as id, count(*) as n from orders where o_orderkey % 50 <> 0 group by 1")
def src_jsonl_openalex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw line files that hold each work twice: unreadable lines go, and the first of an id stays."""
    at = f"{work_dir(spark)}/works"
    for name in ("a", "b"):
        files.write_lines(raw_works(spark, sf_dir).select("value"), at, name)
    return files.json_lines(spark, at, "id").groupBy("id").agg(F.count(F.lit(1)).alias("n"))


@query("select distinct cast(l_orderkey as varchar) as pmid, true as has_month from lineitem")
def src_jsonl_pubmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line files of records that come several times."""
    at = f"{work_dir(spark)}/records"
    record = F.struct(F.col("l_orderkey").cast("string").alias("pmid"), F.date_format("l_shipdate", "yyyy-MM").alias("month_bucket"))
    files.write_lines(table(spark, sf_dir, "lineitem").select(F.to_json(record).alias("value")), at, "a")
    return files.json_lines(spark, at, "pmid").select(F.col("id").alias("pmid"), records.at(F.col("v"), "$.month_bucket").isNotNull().alias("has_month"))


ALIASES = " union all ".join(f"select '{s}' as surface, '{n.upper()}' as keyword_key, '{n}' as canonical_en, 'shape' as category" for n in NOUNS for s in (n, *[f"{a} {n}" for a in ADJECTIVES]))


@query(f"select a.surface, keyword_key, canonical_en, category, (select count(*) from part where p_name = a.surface) as n_parts from ({ALIASES}) a")
def src_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each form of the lexicon, with the parts that it names."""
    named = table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    forms = dimensions(spark)[0]
    return forms.join(named, F.col("surface") == F.col("name"), "left").select("surface", "keyword_key", "canonical_en", "category", F.coalesce("n", F.lit(0)).alias("n_parts"))


@query("select s.surface, (select count(*) from part where p_name = s.surface) as n_parts from (select unnest(['old ring', 'new rod', 'hot widget']) as surface) s")
def src_stopwords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stopword, with the parts that bear it."""
    named = table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return dimensions(spark)[1].join(named, F.col("surface") == F.col("name"), "left").select("surface", F.coalesce("n", F.lit(0)).alias("n_parts"))


@query("select * from part")
def src_sqlite_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part")


@query("select o_orderkey, strftime(o_orderdate, '%Y-%m') as month_bucket, case o_orderkey % 4 when 0 then 'day' when 1 then 'month' when 2 then 'year_only' else 'unknown' end as date_precision from orders where o_orderkey % 4 < 2 union all select o_orderkey, null, case o_orderkey % 4 when 2 then 'year_only' else 'unknown' end from orders where o_orderkey % 4 >= 2")
def proj_parse_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("o_orderkey") % 4
    shown = F.when(kind == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(kind == 1, F.concat(F.date_format("o_orderdate", "yyyy-MM"), F.lit("-77"))).when(kind == 2, F.date_format("o_orderdate", "yyyy")).otherwise("n/a")
    d = dates.parse_date(shown)
    return table(spark, sf_dir, "orders").select("o_orderkey", d["month_bucket"].alias("month_bucket"), d["date_precision"].alias("date_precision"))


@query("select o_orderkey, nullif('10.1/x' || o_orderkey, '10.1/x0') as doi from orders")
def proj_bare_doi(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("o_orderkey") % 4
    prefix = F.when(kind == 0, " https://doi.org/").when(kind == 1, "http://doi.org/").when(kind == 2, "DOI:").otherwise("\t")
    shown = F.when(F.col("o_orderkey") == 0, F.lit("  ")).otherwise(F.concat(prefix, F.lit("10.1/X"), F.col("o_orderkey")))
    return table(spark, sf_dir, "orders").select("o_orderkey", text.bare_doi(shown).alias("doi"))


@query("select p_partkey, lower(trim(coalesce(nullif(case when p_size % 2 = 0 then p_name end, ''), p_brand, ''))) as record_key from part")
def proj_record_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", text.record_key(F.when(F.col("p_size") % 2 == 0, F.col("p_name")), F.col("p_brand")).alias("record_key"))


def restored(docs: DataFrame) -> DataFrame:
    """Each text becomes its index where it lies, so nothing is shuffled."""
    index = docs.select("doc_id", F.col("text").cast("string")).mapInArrow(records.inverted, "doc_id long, entries array<struct<word: string, positions: array<int>>>")
    return index.select("doc_id", records.words_in_order(F.col("entries")).alias("abstract"))


@query("select doc_id, nullif(array_to_string(list_filter(string_split_regex(text, '[ \\n]+'), lambda w: w <> ''), ' '), '') as abstract from documents")
def proj_restore_abstract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts written as inverted indexes, then restored; one without words has an empty index and no abstract."""
    return restored(table(spark, sf_dir, "documents"))


@query("select event_id, cast(json_extract_string(props, '$.k') as bigint) as k from events")
def proj_json_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", records.at(records.raw_json(F.col("props")), "$.k", "bigint").alias("k"))


@query("select 'NCT' || s_suppkey as nct_id, s_name as title, 'PHASE' || s_nationkey as phase, cast(s_nationkey as int) as enrollment, 'a|b' as conditions, s_name as interventions, 'https://clinicaltrials.gov/study/NCT' || s_suppkey as url from supplier")
def proj_trial_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit('{"protocolSection": {"identificationModule": {"nctId": "NCT'), F.col("s_suppkey"), F.lit('", "briefTitle": "'), F.col("s_name"), F.lit('"}, "designModule": {"phases": ["PHASE'), F.col("s_nationkey"), F.lit('", "X"], "enrollmentInfo": {"count": '), F.col("s_nationkey"), F.lit('}}, "conditionsModule": {"conditions": ["a", "", 3, "b"]}, "armsInterventionsModule": {"interventions": [{"name": "'), F.col("s_name"), F.lit('"}, {"type": "DRUG"}]}}}'))
    v = table(spark, sf_dir, "supplier").select(records.raw_json(raw).alias("v"))
    made = v.select(*records.trial_record(F.col("v"), "q", "now"))
    conditions = F.array_join(F.filter("conditions", lambda c: ~c.rlike("^[0-9]+$")), "|")
    return made.select("nct_id", "title", "phase", "enrollment", conditions.alias("conditions"), F.array_join("interventions", "|").alias("interventions"), "url")


@query("select '10.1/' || s_suppkey as doi, s_nationkey % 2 = 0 as is_oa, case when s_nationkey % 3 = 0 then 'closed' else 'gold' end as oa_status, case when s_nationkey % 2 = 0 then s_name end as pdf_url from supplier")
def proj_unpaywall(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    status = F.when(F.col("s_nationkey") % 3 == 0, "").otherwise('"oa_status": "gold", ')
    raw = F.concat(F.lit('{"doi": "10.1/'), F.col("s_suppkey"), F.lit('", '), status, F.lit('"is_oa": '), (F.col("s_nationkey") % 2 == 0).cast("string"), F.lit(', "best_oa_location": {"url_for_pdf": "'), F.col("s_name"), F.lit('"}}'))
    return s.select(records.raw_json(raw).alias("v")).select(*records.oa_location(F.col("v"), "now")).select("doi", "is_oa", "oa_status", "pdf_url")


@query("select o_orderkey, 'Order ' || o_orderkey as title, cast(year(o_orderdate) as int) as year, strftime(o_orderdate, '%Y-%m') as updated from orders")
def proj_crossref_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.concat(F.lit('"Order '), F.col("o_orderkey"), F.lit('"'))
    listed = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("["), title, F.lit("]"))).otherwise(title)
    raw = F.concat(F.lit('{"title": '), listed, F.lit(', "issued": {"date-parts": [['), F.year("o_orderdate"), F.lit(']]}, "updated": {"date-parts": [['), F.year("o_orderdate"), F.lit(", "), F.month("o_orderdate"), F.lit("]]}}"))
    v = table(spark, sf_dir, "orders").select("o_orderkey", records.raw_json(raw).alias("v"))
    return v.select("o_orderkey", records.first_text(F.col("v"), "$.title").alias("title"), records.issued_year(F.col("v")).alias("year"), records.update_date(F.col("v")).alias("updated"))


RETRACTED = """select 'd' || o_orderkey as own, 'retracted' as role, 'r' || o_orderkey as retraction_doi from orders where o_orderkey % 3 = 0
union all select 'd' || o_orderkey, 'notice', 'n' || o_orderkey from orders where o_orderkey % 2 = 0"""


def retracted_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    by = F.when(key % 3 == 0, F.concat(F.lit('{"id": "r'), key, F.lit('"}, {"id": "D'), key, F.lit('"}'))).otherwise(F.lit(""))
    of = F.concat(F.lit('{"type": "correction", "DOI": "c"}'), F.when(key % 2 == 0, F.concat(F.lit(', {"type": "partial-retraction", "DOI": "n'), key, F.lit('"}'))).otherwise(F.lit("")))
    raw = F.concat(F.lit('{"relation": {"is-retracted-by": ['), by, F.lit(']}, "update-to": ['), of, F.lit("]}"))
    own = F.concat(F.lit("d"), key)
    return table(spark, sf_dir, "orders").select(own.alias("doi"), records.retractions(records.raw_json(raw), own).alias("retractions"))


@query(RETRACTED)
def proj_retractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retracted_papers(spark, sf_dir).select(F.col("doi").alias("own"), F.inline("retractions")).select("own", "role", "retraction_doi")


@query(f"select case when role = 'notice' then retraction_doi else own end as doi, case when role = 'notice' then own else retraction_doi end as retraction_doi, 'crossref' as source from ({RETRACTED})")
def evd_retraction_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.retraction_rows(retracted_papers(spark, sf_dir)).select("doi", "retraction_doi", "source")


@query("select cast(doc_id as varchar) as key, 'ok' as status, 'T' || doc_id as title, lang || ' ' || source as abstract, lang || '|' || source as mesh_terms from documents where doc_id % 10 <> 0 union all select cast(doc_id as varchar), 'error', null, null, null from documents where doc_id % 10 = 0")
def proj_pubmed_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles from XML; every tenth document is broken."""
    xml = F.concat(
        F.lit("<PubmedArticleSet><PubmedArticle><MedlineCitation><PMID>1</PMID><Article><ArticleTitle>T<i>"), F.col("doc_id"), F.lit("</i></ArticleTitle><Abstract><AbstractText Label='A'>"), F.col("lang"), F.lit("</AbstractText><AbstractText> "), F.col("source"),
        F.lit("</AbstractText></Abstract></Article><MeshHeadingList><MeshHeading><DescriptorName>"), F.col("lang"), F.lit("</DescriptorName></MeshHeading><MeshHeading><DescriptorName>"), F.col("source"), F.lit("</DescriptorName></MeshHeading></MeshHeadingList></MedlineCitation></PubmedArticle>"),
        F.when(F.col("doc_id") % 10 == 0, F.lit("<")).otherwise(F.lit("</PubmedArticleSet>")),
    )
    docs = table(spark, sf_dir, "documents").select("doc_id", xml.alias("xml"))
    return pubmed.parse_articles(docs, "doc_id", "xml").select("key", "status", "title", "abstract", F.array_join("mesh_terms", "|").alias("mesh_terms"))


@query()
def proj_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", records.page_text(F.col("html")).alias("text"))


@query("select p_partkey, case when p_size % 2 = 0 then p_size || '00-12-3' end as cas from part")
def proj_cas(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.when(F.col("p_size") % 2 == 0, F.concat(F.col("p_size").cast("string"), F.lit("00-12-3"))).otherwise("12-345")
    return table(spark, sf_dir, "part").select("p_partkey", text.cas_number(F.array("p_name", number, F.lit("50-00-0x"))).alias("cas"))


@query("select p_partkey, p_name as title, '' as authors, p_size > 25 as is_retracted from part")
def proj_public_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    papers = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("title"), F.lit(None).cast("array<string>").alias("authors"), F.struct((F.col("p_size") > 25).alias("is_retracted")).alias("verification"))
    return lists_as_text(papers.select(*records.public_record(["p_partkey", "title", "authors", "is_retracted"])), "authors")


@query("select doc_id, trim(regexp_replace(regexp_replace(lower(text), '[^\\p{L}\\p{N}\\p{M}_\\s]', ' ', 'g'), '\\s+', ' ', 'g')) as title from documents")
def norm_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.norm_title(F.col("text")).alias("title"))


@query()
def norm_name_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.name_key(F.col("text")).alias("name_key"))


@query("select p_partkey, case when p_size % 3 = 0 then null else p_name end as name, case when p_size % 2 = 0 then p_brand end as brands from part")
def norm_empty_to_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("p_size") % 3 == 0, F.lit(" \t")).otherwise(F.col("p_name"))
    brands = F.when(F.col("p_size") % 2 == 0, F.array("p_brand")).otherwise(F.array().cast("array<string>"))
    return table(spark, sf_dir, "part").select("p_partkey", text.empty_to_null(name).alias("name"), F.array_join(text.empty_list_to_null(brands), "|").alias("brands"))


@query("select page_id, regexp_replace(url, '[?#].*$', '') || '?page=2&ref=x' as url from pages where url is not null")
def norm_scrub_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    dirty = F.concat(F.regexp_replace("url", r"[?#].*$", ""), F.lit("?page=2&API_KEY=s3&ref=x&token=t"))
    return table(spark, sf_dir, "pages").where("url is not null").select("page_id", text.scrub_url(dirty).alias("url"))


@query("select p_partkey from part where lower(p_name) like '%gear%'")
def flt_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where(F.lower("p_name").contains("gear")).select("p_partkey")


@query("select p_partkey from part where p_size % 4 <> 0")
def flt_has_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = text.record_key(F.when(F.col("p_size") % 2 == 0, F.lit("")), F.when(F.col("p_size") % 4 != 0, F.col("p_name")))
    key = F.when(F.col("p_size") % 2 == 1, F.col("p_name")).otherwise(key)
    return table(spark, sf_dir, "part").where(key != "").select("p_partkey")


@query("select o_orderkey from orders where o_custkey in (select c_custkey from customer where c_mktsegment = 'BUILDING')")
def flt_in_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, sf_dir, "orders").join(wanted, "o_custkey", "left_semi").select("o_orderkey")


@query("select * from part where p_partkey = 7")
def flt_point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where(F.col("p_partkey") == 7)


@query("select p_name, array_to_string(list_sort(list(distinct p_brand)), '|') as brands from part group by 1")
def set_array_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy("p_name").agg(F.array_join(F.array_sort(F.array_distinct(F.collect_list("p_brand"))), "|").alias("brands"))


@query("select p_partkey, case when p_brand = 'b' then p_brand else 'x|' || p_brand || '|y' end as merged from part")
def set_array_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.array_union(F.array(F.lit("x"), F.col("p_brand")), F.array(F.lit("y"), F.lit("x"))), "|").alias("merged"))


@query("select o_orderkey // 200 as chunk, count(*) as n from orders group by 1")
def set_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of up to 200 ids for a bulk lookup: by id range, so each is made where its rows are."""
    return table(spark, sf_dir, "orders").groupBy(F.floor(F.col("o_orderkey") / 200).alias("chunk")).agg(F.count(F.lit(1)).alias("n"))


@query("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 25")
def limit_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.limited(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey"), 25)


@query("select o_orderkey from orders")
def limit_none(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A limit of 0 is no limit."""
    return evidence.limited(table(spark, sf_dir, "orders").select("o_orderkey"), 0)
