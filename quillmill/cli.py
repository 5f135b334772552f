"""Commands: ``python -m quillmill.cli GROUP COMMAND``. Tables lie in a folder of Parquet tables (--store), raw collections and reports in others.

Exit code 0 if all went well, else 1.
"""

from __future__ import annotations

import argparse
import json
import sys
import uuid
import zlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from functools import partial
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.functions import records
from quillmill.functions.text import cas_number, exact_round, name_key, record_key
from quillmill.operators import evidence, lexicon, merge, suggest, trailing, trend, vocabulary
from quillmill.session import ship
from quillmill.sources import download, files, paged, rest, runlog, schema
from quillmill.sources.versioned import VersionedTable
from quillmill.streaming import ingest

MONTHLY = ["month_bucket", "query_id", "keyword_key", "canonical_en", "category", "is_in_lexicon", "paper_count", "total_papers", "prevalence", "citation_sum", "citation_median", "weighted_prevalence", "is_low_sample", "is_provisional"]
METRICS = ["keyword_key", "canonical_en", "category", "is_in_lexicon", "query_id", "first_seen_month", "total_papers", "months_present", "months_observed", "prevalence_recent", "prevalence_prior", "growth_ratio", "is_new_entrant", "weighted_prevalence_recent", "trend_class"]
DENOMINATOR = ["month_bucket", "query_id", "paper_count", "is_low_sample", "is_provisional"]
UNMATCHED = ["rank", "term", "paper_count", "first_seen_month", "last_seen_month", "months_present", "example_title_1", "example_title_2", "example_title_3", "verdict"]
SUGGESTED = ["term", "paper_count", "matched_name_key", "matched_via", "inci_name", "cas", "sources", "suggested_key", "verdict"]
MESH = ["month_bucket", "query_id", "mesh_term", "paper_count", "total_papers", "prevalence", "is_low_sample", "is_provisional"]
TRAILING = ["month_bucket", "query_id", "keyword_key", "canonical_en", "category", "is_in_lexicon", "paper_count", "papers_trailing", "papers_window", "months_present", "prevalence_trailing", "prevalence_before", "growth_ratio"]
OVERLAP = ["month_bucket", "openalex_papers", "pubmed_papers", "both", "openalex_only", "pubmed_only", "doi_missing"]


def exactly(c, digits: int):
    return exact_round(c, F.lit(digits))


def report(args, name: str, rows: DataFrame, fields: list[str]) -> None:
    data, n = files.export_csv(rows, fields)
    out = Path(args.out) / args.profile
    out.mkdir(parents=True, exist_ok=True)
    (out / name).write_bytes(data)
    print(f"{out / name}: {n} rows")


def dimensions(spark: SparkSession, args) -> tuple[DataFrame, DataFrame, dict]:
    words = json.loads(Path(args.lexicon).read_text(encoding="utf-8")) if args.lexicon else vocabulary.lexicon()
    stops = json.loads(Path(args.stopwords).read_text(encoding="utf-8")).get("field_labels", []) if args.stopwords else vocabulary.stopwords()
    return lexicon.alias_table(spark, words), lexicon.stopword_table(spark, stops), words


def collection(spark: SparkSession, args) -> tuple[DataFrame, dict]:
    path = files.raw_dir(spark, args.data, "openalex", args.profile)
    return files.trend_records(spark, args.data, args.profile).withColumnRenamed("openalex_id", "id"), files.meta(spark, path)


def provisional_months(meta: dict, n: int) -> list[str]:
    from datetime import UTC, datetime

    day = (meta.get("collected_at") or datetime.now(UTC).isoformat())[:7]
    at = int(day[:4]) * 12 + int(day[5:7]) - 1
    return [f"{k // 12:04d}-{k % 12 + 1:02d}" for k in range(at - n + 1, at + 1)]


def resolved(spark: SparkSession, args, rows: DataFrame, field: str, extra: list[str]) -> DataFrame:
    aliases, stops, _ = dimensions(spark, args)
    return lexicon.record_terms(rows, field, aliases, stops, keep=["id", "month_bucket", *extra])


def trend_records(spark, args) -> None:
    print(json.dumps(trend.records_summary(collection(spark, args)[0]).first().asDict()))


def trend_normalize(spark, args) -> None:
    aliases, stops, _ = dimensions(spark, args)
    rows, _ = collection(spark, args)
    for field in ("keywords", "topics", "concepts"):
        print(json.dumps(lexicon.normalize_summary(rows, field, aliases, stops).first().asDict()))
    for r in lexicon.top_terms(resolved(spark, args, rows, "keywords", []), "canonical_en", args.top).collect():
        print(r["canonical_en"], r["n"])


def trend_aggregate(spark, args) -> None:
    if args.provider == "pubmed":
        path = files.raw_dir(spark, args.data, "pubmed", args.profile)
        meta = files.meta(spark, path)
        trend.census_guard(meta, args.allow_sample)
        rows = files.pubmed_records(spark, args.data, args.profile)
        made = trend.mesh_monthly(rows, args.threshold, provisional_months(meta, args.provisional), exactly, args.profile)
        report(args, "mesh_monthly.csv", made.orderBy("month_bucket", F.desc("paper_count"), "mesh_term"), MESH)
        return
    rows, meta = collection(spark, args)
    trend.census_guard(meta, args.allow_sample)
    if args.exclude_topics:
        names = json.loads(Path(args.exclude_topics).read_text(encoding="utf-8"))
        rows = trend.without_topics(rows, spark.createDataFrame([(n,) for n in names], "topic string"))
    months = trend.monthly_denominator(rows, args.threshold, provisional_months(meta, args.provisional))
    weighted = trend.cohort_weights(rows).select("id", "month_bucket", "citation_count", "citation_percentile_in_cohort", "keywords", "topics")
    each = lambda f: trend.term_monthly(resolved(spark, args, weighted, f, ["citation_count", "citation_percentile_in_cohort"]), months, exactly)
    keywords = each("keywords").cache()
    order = ("month_bucket", F.desc("paper_count"), "keyword_key")
    report(args, "monthly_denominator.csv", months.orderBy("month_bucket"), DENOMINATOR)
    report(args, "keyword_monthly.csv", keywords.orderBy(*order), MONTHLY)
    report(args, "topic_monthly.csv", each("topics").orderBy(*order), MONTHLY)
    metrics = trend.trend_metrics(keywords, months, exactly).cache()
    report(args, "trend_metrics.csv", metrics.orderBy(F.desc("total_papers"), "keyword_key"), METRICS)
    for r in trend.class_histogram(metrics).orderBy("trend_class").collect():
        print(r["trend_class"], r["n"])


def trend_trailing(spark, args) -> None:
    """The figures of ``trend aggregate`` at every month, over the twelve months that end there."""
    rows, meta = collection(spark, args)
    trend.census_guard(meta, args.allow_sample)
    months = trend.monthly_denominator(rows)
    weighted = trend.cohort_weights(rows).select("id", "month_bucket", "citation_count", "citation_percentile_in_cohort", args.field)
    monthly = trend.term_monthly(resolved(spark, args, weighted, args.field, ["citation_count", "citation_percentile_in_cohort"]), months, exactly)
    found = trailing.trailing(monthly, months, rounder=exactly)
    report(args, "trailing.csv", found.orderBy("month_bucket", F.desc("papers_trailing"), "keyword_key"), TRAILING)


def open_rows(spark, args) -> DataFrame:
    rows, _ = collection(spark, args)
    return trend.unmatched(resolved(spark, args, rows, args.field, ["title", "ord"]), top=args.top)


def trend_unmatched(spark, args) -> None:
    found = open_rows(spark, args).orderBy("rank").cache()
    report(args, f"unmatched_{args.profile}_{args.field}.csv", found, UNMATCHED)
    for r in found.limit(args.show).collect():
        print(r["rank"], r["term"], r["paper_count"])


def trend_suggest(spark, args) -> None:
    ingredients = stored(spark, args, "ingredient")
    if ingredients is None:
        print("no ingredients yet: run ingredient resolve or import-cosing first")
        return
    known = list(dimensions(spark, args)[2])
    found = suggest.suggestions(open_rows(spark, args), ingredients, known)
    report(args, "lexicon_suggestions.csv", found.orderBy(F.desc("paper_count"), "term"), SUGGESTED)


def trend_overlap(spark, args) -> None:
    b = files.pubmed_records(spark, args.data, args.profile)
    found = trend.overlap(collection(spark, args)[0], b).orderBy("month_bucket").cache()
    report(args, "provider_overlap.csv", found, OVERLAP)
    print(json.dumps(trend.overlap_totals(found).first().asDict()))


@dataclass
class Tally:
    """What a command asked of a source and got; ``reason`` tells why it stopped early."""

    requests: int = 0
    records: int = 0
    errors: int = 0
    status: str = "ok"
    reason: str | None = None
    notes: list[dict] = field(default_factory=list)
    #: Stores requests that workers made, from a column of notes.
    fetched: Callable[[DataFrame], None] | None = None

    def stop(self, error: str | None, reached_limit: bool = False) -> None:
        """``error`` is the kind of a request's error."""
        spent = error == "BudgetExhausted"
        self.errors += bool(error)
        self.status, self.reason = runlog.outcome(spent, bool(error) and not spent, reached_limit)


@contextmanager
def logged(spark, args, source: str) -> Iterator[Tally]:
    """Notes the run, its source and its requests in the log tables, however the command ends."""
    log, name, run, tally = runlog.RunLog(spark, f"{args.store}/log"), f"{args.group} {args.command}", uuid.uuid4().hex, Tally(status="failed")
    log.start(run, name)
    tally.fetched = lambda rows: log.fetch_rows(rows.select(F.lit(run).alias("run_id"), F.inline("notes")).withColumns({"error": F.lit(None).cast("string"), "at": F.lit(runlog.now())}))
    try:
        yield tally
        tally.status = "ok" if tally.status == "failed" else tally.status
    finally:
        log.source(run, source, tally.requests, tally.records, tally.errors, 0)
        if tally.notes:
            log.fetches(tally.notes, run)
        log.finish(run, name, tally.status)


#: Of each provider: its paged source, key, and where its pages come from.
PROVIDERS = {
    "openalex": ("works_pages", "id", "quillmill.sources.rest:openalex_pages"),
    "pubmed": ("monthly_records", "pmid", "quillmill.sources.rest:pubmed_pages"),
}


def expected(args, first: str, last: str) -> int | None:
    """How many records a query has, in one request."""
    t = rest.made(args.transport)
    if args.provider == "openalex":
        return rest.works_page(t, args.query, first, last, "*")["total"]
    return rest.pmids(t, args.query, 0, 0, first.replace("-", "/"), last.replace("-", "/"))[1]


def month_table(spark, path: str, months: dict) -> DataFrame:
    """(month, expected, collected, duplicates, complete) of months of a crawl; ``collected`` counts what is stored."""
    kinds = "month string, expected long, received long, complete boolean"
    asked = spark.createDataFrame([(m, v["expected"], v["received"], v["complete"]) for m, v in months.items()], kinds)
    held = files.json_lines(spark, path, "pmid").groupBy(records.at(F.col("v"), "$.month_bucket").alias("month")).agg(F.count(F.lit(1)).alias("n"))
    collected = F.coalesce("n", F.lit(0))
    return asked.join(held, "month", "left").select("month", "expected", collected.alias("collected"), F.greatest(F.col("received") - collected, F.lit(0)).alias("duplicates"), "complete")


def trend_collect(spark, args) -> int:
    """Raw lines and their meta, where the reports read them; goes on behind the last page of an earlier run.

    A search of works has a state for each query and window; monthly records
    have one for each query, so that a longer window adds months. Ends with 1 if
    requests failed or the budget is spent; what was received by then is kept.
    """
    first, last = args.window.split("..")
    if args.dry_run:
        n = expected(args, first, last)
        print(json.dumps({"dry_run": True, "count": n, "estimated_requests": None if n is None else n // (rest.SEARCH_PAGE if args.provider == "openalex" else rest.ID_PAGE) + 1}))
        return 0
    paged.register_all(spark)
    kind, key, pages = PROVIDERS[args.provider]
    out = f"{args.data}/raw/{args.provider}/{args.profile}"
    tag = f"{zlib.crc32(repr((args.query, args.window if args.provider == 'openalex' else '')).encode()):08x}"
    stream = spark.readStream.format(kind).options(pages=pages, query=args.query, transport=args.transport, **{"from": first, "to": last})
    with logged(spark, args, args.provider) as tally:
        before = ingest.stored_keys(spark, out, tag, key)
        crawl = ingest.collect_pages(spark, stream, out, f"{args.data}/state/{args.provider}/{args.profile}/{tag}", key, args.max_pages, tag)
        at, collected = crawl.offset, ingest.stored_keys(spark, out, tag, key)
        if args.provider == "openalex":
            finished, extra = at.get("cursor") == "", {"expected_from_api": at.get("total"), "duplicates_skipped": max(0, at.get("received", 0) - collected)}
        else:
            wanted = paged.months(first, last)
            asked = {m: v for m, v in at.get("months", {}).items() if m in wanted}
            finished, even = len(asked) == len(wanted) and all(v["complete"] for v in asked.values()), False
            extra = {"months": asked, "expected_from_api": None, "duplicates_skipped": 0}
            if asked:
                sums = ingest.census(month_table(spark, out, asked)).first()
                extra |= {"expected_from_api": sums["expected"], "duplicates_skipped": sums["duplicates"]}
                even = sums["is_census"]
        tally.requests, tally.records = crawl.pages, collected - before
        tally.stop(crawl.error, not finished)
        meta = {
            "query_id": args.profile,
            "provider": args.provider,
            "query": args.query,
            "window": args.window,
            "collected": collected,
            "new_this_run": collected - before,
            "pages": at.get("pages", 0),
            "pages_this_run": crawl.pages,
            "stopped_early": bool(tally.reason),
            "stopped_reason": tally.reason,
            "remaining_estimate": max(0, (extra["expected_from_api"] or 0) - collected),
            "is_census": ingest.cursor_census(None, finished, bool(tally.reason)) and (args.provider == "openalex" or even),
            "collected_at": runlog.now(),
        }
        files.write_text(spark, f"{out}/_meta.json", json.dumps(meta | extra, ensure_ascii=False, indent=1))
        print(collected)
    if crawl.error:
        print(crawl.error, file=sys.stderr)
    return 1 if crawl.error else 0


#: What the rows of stored tables are hashed by, where ``merge.TABLES`` doesn't say.
KEYS = {"papers": ["key"]}


def table_of(spark, args, name: str) -> VersionedTable:
    return VersionedTable(spark, f"{args.store}/{name}", KEYS[name] if name in KEYS else list(merge.TABLES[name][0]))


def stored(spark, args, name: str) -> DataFrame | None:
    return table_of(spark, args, name).read()


def save(spark, args, name: str, new: DataFrame) -> None:
    table_of(spark, args, name).upsert(new, partial(merge.merge_table, name), ("seq",))


def answered(spark, args, keys: DataFrame, source: str, tally: Tally) -> DataFrame:
    """(source, key, status, response) of the keys that the source knows. Only what the cache table lacks is asked for; finds and absences go into it, failures don't. Each source has its own table, so that none is replaced while plans still read it."""
    table = VersionedTable(spark, f"{args.store}/lookup_cache/{source}", ["source", "key"])
    wanted = keys.select(F.lit(source).alias("source"), "key").where("coalesce(key, '') <> ''").distinct()
    cache = table.read()
    asked = wanted if cache is None else merge.cache_misses(wanted, cache)
    answers = rest.lookup_table(asked, source, args.transport, notes=True).cache()
    fresh = answers.drop("notes")
    tally.fetched(answers)
    cost = fresh.agg(F.count(F.lit(1)).alias("n"), F.count_if(~evidence.cacheable(F.col("status"))).alias("failed")).first()
    tally.requests, tally.errors = tally.requests + cost["n"], tally.errors + cost["failed"]
    if fresh.where("status = 'budget'").take(1):
        tally.status, tally.reason = runlog.outcome(True, False, False)
    table.upsert(fresh.where(evidence.cacheable(F.col("status"))).withColumn("seq", F.lit(0)), merge.cache_put, ("seq",))
    answers.unpersist()
    return table.read().join(wanted, ["source", "key"], "left_semi").where("response is not null")


def ingredient_fetch_cosing(spark, args) -> None:
    print(json.dumps(download.fetch_file(args.url, str(Path(args.dir) / "cosing.csv")), ensure_ascii=False))


def ingredient_resolve(spark, args) -> int:
    key = spark.createDataFrame([(args.name.strip(),)], "key string")
    row = rest.lookup_table(key, "pubchem", args.transport).first()
    print(json.dumps({"name": args.name, "status": row["status"] if row else "not_found"}))
    if not row or row["response"] is None:
        return 0
    v = records.raw_json(F.lit(row["response"]))
    names = records.texts(v, "$.synonyms")
    made = spark.range(1).select(name_key(F.lit(args.name)).alias("name_key"), F.lit(None).cast("string").alias("inci_name"), records.at(v, "$.cid", "int").alias("cid"), cas_number(names).alias("cas"), F.slice(names, 1, rest.SYNONYMS).alias("synonyms"), F.array(F.lit("pubchem")).alias("sources"), F.lit("").alias("fetched_at"), F.lit(0).cast("long").alias("seq"))
    save(spark, args, "ingredient", made)
    return 0


def ingredient_show(spark, args) -> int:
    table = stored(spark, args, "ingredient")
    row = table.where(F.col("name_key") == name_key(F.lit(args.name))).first() if table is not None else None
    print(json.dumps(row.asDict(), ensure_ascii=False) if row else "not found")
    return 0 if row else 1


def ingredient_import_cosing(spark, args) -> None:
    found = files.side_file(spark, str(Path(args.csv).parent / "_meta.json")).get("fetched_at") or runlog.now()
    rows = files.ingredients_csv(spark, args.csv, found).withColumn("seq", F.monotonically_increasing_id())
    save(spark, args, "ingredient", rows)
    read = spark.read.option("header", True).option("multiLine", True).csv(args.csv).count()
    saved = rows.count()
    print(json.dumps({"read": read, "saved": saved, "skipped": read - saved}))


def evidence_collect(spark, args) -> None:
    paged.register_all(spark)
    first, last = f"{args.first}-01-01", f"{args.last}-12-31"
    works = spark.read.format("works_pages").options(pages="quillmill.sources.rest:openalex_pages", query=args.query, transport=args.transport, maxPages=str(-(-args.limit // rest.SEARCH_PAGE)), **{"from": first, "to": last}).load()
    papers = works.limit(args.limit).select(records.raw_json(F.col("raw")).alias("v")).select(*records.paper_record(F.col("v")))
    papers = papers.withColumn("key", record_key(F.col("doi"), F.col("openalex_id"))).where("key <> ''").cache()
    kinds = {"semantic_scholar": "tldr string, abstract string, journal string, citation_count bigint", "europepmc": "abstract string, journal string, keywords array<string>", "pubmed": "abstract string, journal string, mesh_terms array<string>"}
    with logged(spark, args, "evidence") as tally:
        known = {source: answered(spark, args, papers.select(evidence.lookup_key(source).alias("key")), source, tally) for source in (*kinds, "crossref")}
        answers = {s: known[s].select(F.col("key").alias("lookup"), F.from_json("response", kind).alias("response")) for s, kind in kinds.items()}
        v = records.raw_json(F.col("response"))
        answers["crossref"] = known["crossref"].select(F.col("key").alias("lookup"), F.struct(records.first_text(v, "$.title").alias("title"), records.first_text(v, "$['container-title']").alias("journal"), records.retractions(v, F.col("key")).alias("retractions")).alias("response"))
        scored = evidence.verify(evidence.enrich(papers, answers)).cache()
        kept = scored.drop(*[f"evidence_{s}" for s in evidence.FILLS]).withColumn("collected_at", F.lit(runlog.now()))
        columns = ["crossref_verified", "title_match", "found_in_sources", "is_retracted", "has_doi", "confidence_score"]
        whole, _ = schema.migrate(kept, 0, schema.PAPER_STEPS)
        table_of(spark, args, "papers").upsert(whole, partial(merge.merge_papers, verification=columns))
        notices = evidence.retraction_rows(scored.select("doi", F.col("evidence_crossref.retractions").alias("retractions")))
        save(spark, args, "retraction", notices.withColumn("seq", F.monotonically_increasing_id()))
        # after scoring: where a paper can be read changes no score
        places = answered(spark, args, papers.select("doi").withColumnRenamed("doi", "key"), "unpaywall", tally)
        found = places.select(F.col("key"), records.raw_json(F.col("response")).alias("v")).select("key", *records.oa_location(F.col("v"), runlog.now()))
        save(spark, args, "oa_location", found.withColumn("doi", F.when(F.col("doi") != "", F.col("doi")).otherwise(F.col("key"))).drop("key").withColumn("seq", F.monotonically_increasing_id()))
        tally.records = kept.count()
        print(json.dumps(evidence.headline(kept).first().asDict()))


def evidence_trend(spark, args) -> None:
    for year, n in rest.works_by_year(rest.made(args.transport), args.query, args.first, args.last):
        print(year, n)


def evidence_cite(spark, args) -> None:
    papers = stored(spark, args, "papers")
    if papers is None:
        print("no papers yet")
        return
    found = evidence.search(papers, args.keyword, args.min_confidence, args.include_retracted, args.limit)
    locations = stored(spark, args, "oa_location")
    if locations is not None:
        found = evidence.oa_pdf_urls(found, locations)
    for r in found.collect():
        print(json.dumps(r.asDict(), ensure_ascii=False, default=str))


def trials_collect(spark, args) -> int:
    """What was received before a request fails, or the budget is spent, is saved; the command then ends with 1."""
    t, token, rows, failed = rest.made(args.transport), "*", [], None
    with logged(spark, args, "clinicaltrials") as tally:
        t.observer = tally.notes.append
        while token and len(rows) < args.limit:
            try:
                page = rest.trials_page(t, args.query, token)
            except rest.TransportError as error:
                failed = error
                break
            rows += [(json.dumps(s, ensure_ascii=False),) for s in page["results"]][: args.limit - len(rows)]
            token = page["next_cursor"]
        if rows or not failed:
            made = spark.createDataFrame(rows, "raw string").select(records.raw_json(F.col("raw")).alias("v")).select(*records.trial_record(F.col("v"), args.query, runlog.now())).where("nct_id <> ''")
            save(spark, args, "trial", made.withColumn("seq", F.monotonically_increasing_id()))
        tally.requests, tally.records = len(tally.notes), len(rows)
        tally.stop(type(failed).__name__ if failed else None)
        print(len(rows))
    if failed:
        print(failed, file=sys.stderr)
    return 1 if failed else 0


def trials_list(spark, args) -> None:
    table = stored(spark, args, "trial")
    for r in evidence.search_trials(table, args.keyword, args.limit).collect() if table is not None else ():
        print(json.dumps(r.asDict(), ensure_ascii=False))


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="quillmill")
    groups = top.add_subparsers(dest="group", required=True)
    made: dict[str, argparse._SubParsersAction] = {}

    def command(group: str, name: str, run, *options: tuple) -> None:
        if group not in made:
            made[group] = groups.add_parser(group).add_subparsers(dest="command", required=True)
        p = made[group].add_parser(name)
        p.set_defaults(run=run)
        p.add_argument("--store", default="store")
        p.add_argument("--transport", default="quillmill.sources.rest:online")
        for flag, kind in options:
            p.add_argument(flag, **kind)

    number = lambda d=None: {"type": int, "default": d}
    need, text = {"required": True}, lambda d=None: {"default": d}
    profile = [("--profile", need), ("--data", text("data")), ("--out", text("out/trend")), ("--lexicon", text()), ("--stopwords", text())]
    span = [("--query", need), ("--from", {"dest": "first", "type": int, "required": True}), ("--to", {"dest": "last", "type": int, "required": True})]
    flag = {"action": "store_true"}
    command("evidence", "collect", evidence_collect, *span, ("--limit", number(100)))
    command("evidence", "trend", evidence_trend, *span)
    command("evidence", "cite", evidence_cite, ("--keyword", need), ("--min-confidence", number(0)), ("--limit", number(20)), ("--include-retracted", flag))
    command("trend", "collect", trend_collect, *profile[:2], ("--query", need), ("--window", need), ("--provider", {"default": "openalex", "choices": sorted(PROVIDERS)}), ("--max-pages", number()), ("--dry-run", flag))
    command("trend", "records", trend_records, *profile)
    command("trend", "normalize", trend_normalize, *profile, ("--top", number(20)))
    command("trend", "aggregate", trend_aggregate, *profile, ("--provider", text("openalex")), ("--threshold", number(trend.LOW_SAMPLE)), ("--provisional", number(1)), ("--allow-sample", flag), ("--exclude-topics", text()))
    command("trend", "trailing", trend_trailing, *profile, ("--field", text("keywords")), ("--allow-sample", flag))
    for name, run in (("unmatched", trend_unmatched), ("suggest", trend_suggest)):
        command("trend", name, run, *profile, ("--field", text("keywords")), ("--top", number()), ("--show", number(20)))
    command("trend", "overlap", trend_overlap, *profile)
    command("trials", "collect", trials_collect, ("--query", need), ("--limit", number(100)))
    command("trials", "list", trials_list, ("--keyword", need), ("--limit", number(20)))
    command("ingredient", "fetch-cosing", ingredient_fetch_cosing, ("--url", need), ("--dir", text("data/cosing")))
    command("ingredient", "resolve", ingredient_resolve, ("--name", need))
    command("ingredient", "show", ingredient_show, ("--name", need))
    command("ingredient", "import-cosing", ingredient_import_cosing, ("--csv", need))
    return top


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("quillmill").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    ship(spark)
    try:
        return args.run(spark, args) or 0
    except (trend.CensusError, FileNotFoundError, rest.TransportError, ValueError) as error:
        print(error, file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
