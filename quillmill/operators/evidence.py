"""Papers enriched by lookups in other sources, and the score of how well each is corroborated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.functions.text import empty_to_null, title_similarity

#: Fixed values of the score.
BASE, CROSSREF, TITLE, EXTRA, EXTRA_CAP, ABSTRACT, MOST = 5, 30, 25, 15, 30, 10, 100
TITLE_MATCH = 0.85
PRIMARY = "openalex"
#: What each source may fill, in the order in which sources are asked.
FILLS = {
    "semantic_scholar": ("tldr", "abstract", "journal", "citation_count"),
    "europepmc": ("abstract", "journal", "keywords"),
    "pubmed": ("abstract", "journal"),
    "crossref": ("journal",),
}
TITLE_KEY_CHARS = 200


def lookup_key(source: str) -> Column:
    """What a paper is looked up by: its DOI; one source also takes the start of the title."""
    doi = F.coalesce("doi", F.lit(""))
    if source != "europepmc":
        return doi
    return F.when(doi != "", doi).otherwise(F.lower(F.trim(F.substring(F.coalesce("title", F.lit("")), 1, TITLE_KEY_CHARS))))


def fill(target: Column, *values: Column) -> Column:
    """The first value that isn't empty, the target's own first."""
    return F.coalesce(empty_to_null(target), *[empty_to_null(v) for v in values], target)


def fill_list(target: Column, *values: Column) -> Column:
    some = lambda c: F.when(F.size(c) > 0, c)
    return F.coalesce(some(target), *[some(v) for v in values], target)


def enrich(papers: DataFrame, responses: dict[str, DataFrame]) -> DataFrame:
    """Left joins with a table of responses per source, each of (lookup, response struct), unique by lookup.

    Adds evidence_<source>, found_in_sources and filled columns; subject headings
    come with every PubMed hit, even an empty list.
    """
    joined = papers
    apart = F.concat(F.lit("\0"), F.xxhash64(*papers.columns))  # no source has such a key; papers without one are spread by it
    for source in FILLS:
        if source in responses:
            table = responses[source].where("lookup <> ''").select(F.col("lookup").alias("__l"), F.col("response").alias(f"evidence_{source}"))
            own = lookup_key(source)
            joined = joined.join(table, F.when(F.coalesce(own, F.lit("")) == "", apart).otherwise(own) == F.col("__l"), "left").drop("__l")
    asked = [s for s in FILLS if s in responses]
    hit = {s: F.col(f"evidence_{s}") for s in asked}
    named = {f: [hit[s][f] for s in asked if f in FILLS[s]] for f in ("tldr", "abstract", "journal", "keywords", "citation_count")}
    made = {f: fill(F.col(f), *named[f]) for f in ("tldr", "abstract", "journal") if named[f]}
    if named["keywords"]:
        made["keywords"] = fill_list(F.col("keywords"), *named["keywords"])
    if named["citation_count"]:
        made["citation_count"] = F.coalesce("citation_count", *named["citation_count"])
    if "pubmed" in hit:
        made["mesh_terms"] = F.when(hit["pubmed"].isNotNull(), F.coalesce(hit["pubmed"]["mesh_terms"], F.array().cast("array<string>")))
    made["found_in_sources"] = found_in([(s, hit[s].isNotNull()) for s in asked if s != "crossref"])
    return joined.withColumns(made)


def found_in(hits: list[tuple[str, Column]]) -> Column:
    """The primary source and those that hit, in order."""
    return F.filter(F.array(F.lit(PRIMARY), *[F.when(c, s) for s, c in hits]), lambda s: s.isNotNull())


def retracted(own: Column, items: Column) -> Column:
    """Flagged by the primary source, or by an item whose role isn't that of a notice (no role counts as retracted)."""
    return F.coalesce(own, F.lit(False)) | F.coalesce(F.exists(items, lambda x: F.coalesce(x["role"], F.lit("retracted")) == "retracted"), F.lit(False))


def score(crossref: Column, title_match: Column, extra_sources: Column, abstract: Column, is_retracted: Column) -> Column:
    points = F.lit(BASE) + F.when(crossref, CROSSREF).otherwise(0) + F.when(title_match, TITLE).otherwise(0) + F.least(extra_sources * EXTRA, F.lit(EXTRA_CAP)) + F.when(F.coalesce(abstract, F.lit("")) != "", ABSTRACT).otherwise(0)
    return F.when(is_retracted, 0).otherwise(F.least(points, F.lit(MOST))).cast("int")


def verify(enriched: DataFrame, similarity: Column | None = None) -> DataFrame:
    """Adds crossref_verified, title_match, has_doi, is_retracted and confidence_score."""
    c = F.col("evidence_crossref")
    verified = c.isNotNull()
    alike = similarity if similarity is not None else title_similarity(F.col("title"), c["title"])
    gone = retracted(F.col("is_retracted"), c["retractions"])
    match = F.coalesce(verified & (F.when(verified, alike).otherwise(0.0) >= TITLE_MATCH), F.lit(False))
    extra = F.size(F.filter("found_in_sources", lambda s: s != PRIMARY))
    step = enriched.withColumns({"crossref_verified": verified, "title_match": match, "__gone": gone, "has_doi": F.coalesce("doi", F.lit("")) != ""})
    made = step.withColumn("confidence_score", score(F.col("crossref_verified"), F.col("title_match"), extra, F.col("abstract"), F.col("__gone")))
    return made.withColumn("is_retracted", F.col("__gone")).drop("__gone")


def retraction_rows(papers: DataFrame, source: str = "crossref") -> DataFrame:
    """(doi, retraction_doi, ...) of every item; a notice's own DOI takes the retraction's place."""
    each = papers.select(F.col("doi").alias("own"), F.explode("retractions").alias("r"))
    notice = F.coalesce(F.col("r.role"), F.lit("retracted")) == "notice"
    other = F.coalesce("r.retraction_doi", F.lit(""))
    return each.select(
        F.when(notice, other).otherwise(F.col("own")).alias("doi"),
        F.when(notice, F.col("own")).otherwise(other).alias("retraction_doi"),
        F.coalesce("r.update_type", F.lit("")).alias("update_type"),
        F.col("r.update_date").alias("update_date"),
        F.lit(source).alias("source"),
    )


def search(papers: DataFrame, keyword: str, least: int = 0, with_retracted: bool = False, limit: int | None = None, wildcards: bool = False) -> DataFrame:
    """Papers whose title, abstract or a keyword holds the text, best score first; limit 0 or None is none.

    The text is taken literally unless ``wildcards``; an empty one finds every
    paper that has one of the fields.
    """
    word = keyword.lower()
    holds = (lambda c: F.lower(c).like(f"%{word}%")) if wildcards else (lambda c: F.lower(c).contains(word))
    found = F.coalesce(holds(F.col("title")), F.lit(False)) | F.coalesce(holds(F.col("abstract")), F.lit(False)) | F.coalesce(F.exists("keywords", holds), F.lit(False))
    kept = papers.where(found & (F.col("confidence_score") >= least))
    if not with_retracted:
        kept = kept.where(~F.coalesce("is_retracted", F.lit(False)))
    return limited(kept.orderBy(F.desc("confidence_score"), F.desc_nulls_last("year"), "key"), limit)


def search_trials(trials: DataFrame, keyword: str, limit: int | None = None) -> DataFrame:
    word = keyword.lower()
    inside = lambda c: F.coalesce(F.exists(c, lambda x: F.lower(x).contains(word)), F.lit(False))
    found = F.coalesce(F.lower("title").contains(word), F.lit(False)) | inside("conditions") | inside("interventions")
    return limited(trials.where(found).orderBy(F.desc_nulls_last("first_posted"), "nct_id"), limit)


def limited(rows: DataFrame, limit: int | None) -> DataFrame:
    return rows.limit(limit) if limit else rows


def oa_pdf_urls(papers: DataFrame, locations: DataFrame) -> DataFrame:
    """Papers with the PDF that an open-access location offers, if any."""
    pdf = locations.where("pdf_url is not null").select("doi", "pdf_url").dropDuplicates(["doi"])
    return papers.join(pdf, "doi", "left")


def source_metrics(log: DataFrame) -> DataFrame:
    """Requests, records and errors of each source; ``log`` has source, n_records and an error."""
    return log.groupBy("source").agg(F.count(F.lit(1)).alias("requests"), F.sum("n_records").alias("records"), F.count_if(F.col("error").isNotNull()).alias("errors"))


def headline(papers: DataFrame, least: int = 70) -> DataFrame:
    return papers.agg(F.count_if(F.col("confidence_score") >= least).alias("n_confident"), F.count_if(F.coalesce("abstract", F.lit("")) != "").alias("n_with_abstract"))


def cacheable(status: Column) -> Column:
    """Only answers are kept: a find, or that there is none."""
    return status.isin("ok", "not_found")


def source_of_host(log: DataFrame, hosts: DataFrame) -> DataFrame:
    """Log rows with the source that their URL's host belongs to; ``hosts`` has (host, source)."""
    host = F.lower(F.regexp_extract("url", r"^[a-zA-Z][\w+.-]*://([^/?#:]*)", 1))
    return log.withColumn("host", host).join(hosts, "host", "left")
