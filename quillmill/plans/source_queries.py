"""Readers, lookups, ingest control, sinks and resumption."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator
from functools import partial

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamReader

from quillmill.functions import records
from quillmill.functions.text import cas_number
from quillmill.operators import trend
from quillmill.operators.merge import cache_misses, cache_put, merge_table
from quillmill.plans import replay
from quillmill.plans.catalog import query
from quillmill.plans.relations import table
from quillmill.plans.stream_queries import work_dir
from quillmill.sources import files, paged, rest, runlog, transport
from quillmill.sources.versioned import VersionedTable
from quillmill.streaming import ingest

REPLAY = "quillmill.plans.replay:transport"
TABLES = "quillmill.plans.replay:tables"
IDS = "select 'W' || o_orderkey as id from orders"
#: Pages of orders, as ``replay.write_pages`` deals them.
PAGED = "n as (select greatest(6, (count(*) + 4999) // 5000) as pages from orders)"


def order_pages(spark: SparkSession, sf_dir: str) -> dict[str, str]:
    """Options of a reader of orders as works, from a service that pages through them."""
    lines = order_lines(spark, sf_dir)
    return work_pages(replay.write_pages(lines.drop("month"), F.col("o_orderkey"), f"{work_dir(spark)}/works"))


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(line, month, o_orderkey) of orders as works."""
    orders = table(spark, sf_dir, "orders")
    line = F.to_json(F.struct(F.concat(F.lit("W"), "o_orderkey").alias("id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("publication_date"), F.col("o_orderpriority").alias("title")))
    return orders.select(line.alias("line"), F.date_format("o_orderdate", "yyyy-MM").alias("month"), "o_orderkey")


def work_pages(folder: str) -> dict[str, str]:
    return {"pages": "quillmill.sources.rest:openalex_pages", "transport": f"{TABLES}?{folder}", "query": "q", "from": "1990-01-01", "to": "2010-12-31"}


@query(IDS)
def src_openalex_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A crawl for each month, side by side."""
    paged.register_all(spark)
    lines = order_lines(spark, sf_dir)
    folder = replay.write_month_pages(lines, F.col("o_orderkey"), f"{work_dir(spark)}/works")
    return spark.read.format("works_pages").options(**work_pages(folder), split="month").load().select("id")


@query("select 'W' || o_orderkey as id, cast(year(o_orderdate) as int) as year from orders where year(o_orderdate) between 1996 and 1998 and year(o_orderdate) <> 1997")
def src_openalex_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filter on years that becomes the dates the service is asked for; what it can't say Spark filters."""
    return paged.works_where(spark, order_pages(spark, sf_dir), "year >= 1996 and year < 1999 and year <> 1997").select("id", "year")


@query("select cast(year(o_orderdate) as int) as year, count(*) as n from orders where year(o_orderdate) between 1996 and 1999 group by 1")
def src_openalex_group_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Works a year, in one request."""
    years = rest.works_by_year(rest.made(order_pages(spark, sf_dir)["transport"]), "q", 1996, 1999)
    return spark.createDataFrame(years, "year int, n long")


def works_stream(spark: SparkSession, options: dict[str, str]) -> DataStreamReader:
    paged.register_all(spark)
    return spark.readStream.format("works_pages").options(**options)


def line_ids(spark: SparkSession, path: str, key: str = "id") -> DataFrame:
    return files.json_lines(spark, path, key).select(F.col("id").alias(key))


@query(IDS)
def src_openalex_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw lines, page by page, read back as the reports read them."""
    at, options = work_dir(spark), order_pages(spark, sf_dir)
    ingest.collect_pages(spark, works_stream(spark, options), f"{at}/out", f"{at}/state")
    return line_ids(spark, f"{at}/out")


@query(IDS)
def stm_cursor_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stopped after a page, then continued behind it."""
    at, options = work_dir(spark), order_pages(spark, sf_dir)
    ingest.collect_pages(spark, works_stream(spark, options), f"{at}/out", f"{at}/state", most=1)
    ingest.collect_pages(spark, works_stream(spark, options), f"{at}/out", f"{at}/state")
    return line_ids(spark, f"{at}/out")


@query(f"with {PAGED} select 'W' || o_orderkey as id from orders, n where o_orderkey % pages < 2")
def stm_bounded_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two pages, whatever there is."""
    at, options = work_dir(spark), order_pages(spark, sf_dir)
    ingest.collect_pages(spark, works_stream(spark, options), f"{at}/out", f"{at}/state", most=2)
    return line_ids(spark, f"{at}/out")


WINDOW = ("1998-01", "1998-03")
MONTH_IDS = f"select strftime(o_orderdate, '%Y-%m') || '-' || o_orderkey as pmid, strftime(o_orderdate, '%Y-%m') as month_bucket from orders where strftime(o_orderdate, '%Y-%m') between '{WINDOW[0]}' and '{WINDOW[1]}'"


def order_months(spark: SparkSession, sf_dir: str) -> str:
    """A folder of orders by month, as a service of articles reads it."""
    month = F.date_format("o_orderdate", "yyyy-MM")
    line = F.to_json(F.struct(F.concat(month, F.lit("-"), "o_orderkey").alias("pmid")))
    return replay.write_months(table(spark, sf_dir, "orders").select(month.alias("month"), line.alias("line")), f"{work_dir(spark)}/months")


def months_stream(spark: SparkSession, transport: str, first: str, last: str) -> DataStreamReader:
    paged.register_all(spark)
    return spark.readStream.format("monthly_records").options(pages="quillmill.sources.rest:pubmed_pages", transport=transport, query="q", **{"from": first, "to": last})


def month_lines(spark: SparkSession, path: str) -> DataFrame:
    return files.json_lines(spark, path, "pmid").select(F.col("id").alias("pmid"), records.at(F.col("v"), "$.month_bucket").alias("month_bucket"))


@query(MONTH_IDS)
def src_pubmed_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Month by month, ids first and then their articles in batches; stopped after a page, then taken up with a longer window."""
    at, given = work_dir(spark), f"{TABLES}?{order_months(spark, sf_dir)}"
    for last, most in (("1998-02", 1), ("1998-02", None), (WINDOW[1], None)):
        ingest.collect_pages(spark, months_stream(spark, given, WINDOW[0], last), f"{at}/out", f"{at}/state", "pmid", most)
    return month_lines(spark, f"{at}/out")


@query(f"select pmid, 'P ' || pmid as title, month_bucket from ({MONTH_IDS})")
def src_pubmed_esearch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same months as a batch, a partition each: ids by date, then their articles."""
    paged.register_all(spark)
    options = {"pages": "quillmill.sources.rest:pubmed_pages", "transport": f"{TABLES}?{order_months(spark, sf_dir)}", "query": "q", "from": WINDOW[0], "to": WINDOW[1]}
    rows = spark.read.format("monthly_records").options(**options).load()
    return rows.select("pmid", records.at(records.raw_json(F.col("raw")), "$.title").alias("title"), "month_bucket")


@query("select strftime(o_orderdate, '%Y-%m') as month, count(*) as received, count(*) as expected, true as complete from orders where strftime(o_orderdate, '%Y-%m') between '1998-01' and '1998-03' group by 1")
def stm_month_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the committed offset knows of each month after three runs: within a month, at the window's end, and beyond it with a longer one."""
    at, given = work_dir(spark), f"{TABLES}?{order_months(spark, sf_dir)}"
    for last, most in (("1998-02", 1), ("1998-02", None), (WINDOW[1], None)):
        crawl = ingest.collect_pages(spark, months_stream(spark, given, WINDOW[0], last), f"{at}/out", f"{at}/state", "pmid", most)
    if not crawl.offset.get("complete") or crawl.offset["complete_through_month"] != WINDOW[1]:
        raise AssertionError(crawl)
    known = [(m, v["received"], v["expected"], v["complete"]) for m, v in crawl.offset["months"].items()]
    return spark.createDataFrame(known, "month string, received long, expected long, complete boolean")


@query(MONTH_IDS)
def stm_no_advance_on_failure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page whose articles fail moves nothing: the next run asks for it again, and its rows are there once."""
    at, folder = work_dir(spark), order_months(spark, sf_dir)
    first = ingest.collect_pages(spark, months_stream(spark, f"quillmill.plans.replay:failing?{folder}!1998-02", *WINDOW), f"{at}/out", f"{at}/state", "pmid")
    if (first.error, first.offset["month_cursor"]) != ("PermanentError", "1998-02"):
        raise AssertionError(first)
    ingest.collect_pages(spark, months_stream(spark, f"{TABLES}?{folder}", *WINDOW), f"{at}/out", f"{at}/state", "pmid")
    return month_lines(spark, f"{at}/out")


def lookup(spark: SparkSession, sf_dir: str, source: str, path: str) -> DataFrame:
    """Outcomes of one lookup a document."""
    keys = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), "doc_id").alias("key"))
    found = rest.lookup_table(keys, source, REPLAY, tasks=2)
    return found.select("key", "status", records.at(records.raw_json(F.col("response")), path).alias("title"))


def lookup_sql(prefix: str, absent: str = "not_found") -> str:
    return f"select 'd' || doc_id as key, case when doc_id % 2 = 0 then 'ok' else '{absent}' end as status, case when doc_id % 2 = 0 then '{prefix}d' || doc_id end as title from documents"


@query(lookup_sql("C "))
def src_crossref(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup(spark, sf_dir, "crossref", "$.title[0]")


@query(lookup_sql("T "))
def src_s2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup(spark, sf_dir, "semantic_scholar", "$.title")


@query(lookup_sql("E ", "ok"))
def src_europepmc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup(spark, sf_dir, "europepmc", "$.title")


@query(lookup_sql("P ", "ok"))
def src_pubmed_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup(spark, sf_dir, "pubmed", "$.title")


@query(lookup_sql(""))
def src_unpaywall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup(spark, sf_dir, "unpaywall", "$.doi")


@query("select 'd' || doc_id as key, case when doc_id % 2 = 0 then doc_id end as cid, case when doc_id % 2 = 0 then '1314-13-2' end as cas from documents")
def src_pubchem(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), "doc_id").alias("key"))
    v = records.raw_json(F.col("response"))
    return rest.lookup_table(keys, "pubchem", REPLAY, tasks=2).select("key", records.at(v, "$.cid", "bigint").alias("cid"), cas_number(records.texts(v, "$.synonyms")).alias("cas"))


TRIALS = "select 'N' || c_custkey as nct_id, c_name as title from customer"


def trial_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Studies made of customers, page by page by token, as raw lines."""
    paged.register_all(spark)
    about = F.struct(F.concat(F.lit("N"), "c_custkey").alias("nctId"), F.col("c_name").alias("briefTitle"))
    line = F.to_json(F.struct(F.struct(about.alias("identificationModule")).alias("protocolSection")))
    folder = replay.write_pages(table(spark, sf_dir, "customer").select(line.alias("line"), "c_custkey"), F.col("c_custkey"), f"{work_dir(spark)}/trials")
    return spark.read.format("works_pages").options(pages="quillmill.sources.rest:trial_pages", transport=f"{TABLES}?{folder}", query="q").load()


@query(TRIALS)
def src_clinicaltrials(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = trial_pages(spark, sf_dir).select(records.raw_json(F.col("raw")).alias("v"))
    return raw.select(*records.trial_record(F.col("v"), "q", "now")).select("nct_id", "title")


@query(TRIALS)
def ing_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored as the command stores them; a second run replaces."""
    made = trial_pages(spark, sf_dir).select(records.raw_json(F.col("raw")).alias("v"), "place").select(*records.trial_record(F.col("v"), "q", "now"), F.col("place").alias("seq"))
    store = VersionedTable(spark, f"{work_dir(spark)}/trial", ["nct_id"])
    for _ in range(2):
        store.upsert(made, partial(merge_table, "trial"), ("seq",))
    return store.read().select("nct_id", "title")


@query("select 'd' || p_partkey as name, case when p_partkey % 2 = 0 then 'ok' else 'not_found' end as status, cast(case when p_partkey % 2 = 0 then p_partkey end as int) as cid from part")
def ing_ingredient(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = table(spark, sf_dir, "part").select(F.concat(F.lit("d"), "p_partkey").alias("key"))
    found = rest.lookup_table(keys, "pubchem", REPLAY, tasks=2)
    return found.select(F.col("key").alias("name"), "status", records.at(records.raw_json(F.col("response")), "$.cid", "int").alias("cid"))


def written(spark: SparkSession, at: str, lines: list[str]) -> str:
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(at)
    return at


@query("select 'r' || r_regionkey as query_id, case when r_regionkey % 3 = 2 then 'none' when r_regionkey % 3 = 1 then 'new' else 'old' end as place from region")
def src_path_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collections in the new place, in the older one alone, and in neither."""
    at, found = work_dir(spark), []
    for r in table(spark, sf_dir, "region").collect():
        name, turn = f"r{r['r_regionkey']}", r["r_regionkey"] % 3
        if turn < 2:
            written(spark, f"{at}/raw/{'openalex/' if turn else ''}{name}", ["{}"])
        try:
            found.append((name, "new" if files.raw_dir(spark, at, "openalex", name).endswith(f"/openalex/{name}") else "old"))
        except FileNotFoundError:
            found.append((name, "none"))
    return spark.createDataFrame(found, "query_id string, place string")


@query("select r_name as name, case when r_regionkey % 3 = 0 then r_regionkey end as collected from region")
def src_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Side files: sound, broken and missing ones."""
    at, found = work_dir(spark), []
    for r in table(spark, sf_dir, "region").collect():
        turn = r["r_regionkey"] % 3
        if turn < 2:
            files.write_text(spark, f"{at}/{r['r_name']}/_meta.json", "{" if turn else f'{{"collected": {r["r_regionkey"]}}}')
        found.append((r["r_name"], files.meta(spark, f"{at}/{r['r_name']}").get("collected")))
    return spark.createDataFrame(found, "name string, collected int")


COSING = "select lower(p_name) as name_key, p_name as inci_name, case when p_size % 2 = 0 then p_partkey || '-00-1' end as cas, case when p_size % 3 = 0 then p_brand else '' end as synonyms from part where p_size % 5 <> 0"


def cosing(spark: SparkSession, sf_dir: str) -> DataFrame:
    at, size = work_dir(spark), F.col("p_size")
    rows = table(spark, sf_dir, "part").select(
        F.when(size % 2 == 0, F.concat("p_partkey", F.lit("-00-1"))).otherwise(" ").alias("CAS No"),
        F.when(size % 5 != 0, F.col("p_name")).otherwise("").alias("INCI name"),
        F.when(size % 3 == 0, F.col("p_brand")).otherwise("").alias("INN name"),
    )
    rows.write.option("header", True).csv(f"{at}/csv")
    return files.ingredients_csv(spark, f"{at}/csv", "now")


@query(COSING)
def src_csv_cosing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cosing(spark, sf_dir).select("name_key", "inci_name", "cas", F.array_join("synonyms", "|").alias("synonyms"))


@query("select count(*) as saved from part where p_size % 5 <> 0")
def ing_cosing_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cosing(spark, sf_dir).agg(F.count(F.lit(1)).alias("saved"))


EXPORTED = "select cast(cast(year(o_orderdate) as int) as varchar) as year, cast(count(*) as varchar) as n from orders group by year(o_orderdate)"


def exported(spark: SparkSession, sf_dir: str) -> bytes:
    years = trend.year_histogram(table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("year")))
    return files.export_csv(years.orderBy("year"), ["year", "n"])[0]


@query(EXPORTED)
def snk_trend_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exchange form, read by another reader."""
    rows = csv.DictReader(io.StringIO(exported(spark, sf_dir).decode("utf-8-sig")))
    return spark.createDataFrame([(r["year"], r["n"]) for r in rows], "year string, n string")


@query(EXPORTED)
def src_csv_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exchange form, read back."""
    at = work_dir(spark)
    written(spark, f"{at}/csv", exported(spark, sf_dir).decode("utf-8").split("\r\n")[:-1])
    return files.unmatched_csv(spark, f"{at}/csv")


@query("select r_regionkey, r_name from region")
def snk_json_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON array, read back as one."""
    at = f"{work_dir(spark)}.json"
    files.write_json_array(table(spark, sf_dir, "region"), at)
    return spark.read.schema("r_regionkey int, r_name string").json(at, multiLine=True, mode="FAILFAST")


@query("select p_partkey, p_name from part")
def snk_records_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = f"{work_dir(spark)}/json"
    files.write_json_table(table(spark, sf_dir, "part").select("p_partkey", "p_name"), at)
    return spark.read.schema("p_partkey long, p_name string").json(at)


@query("select event_id, props from events")
def snk_raw_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw lines appended by a stream, exactly once."""
    at = work_dir(spark)
    stream = spark.readStream.schema("event_id long, props string").option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    ingest.collect_lines(stream.withColumn("raw", F.to_json(F.struct("event_id", "props"))), f"{at}/out", f"{at}/state", key="event_id").awaitTermination()
    return spark.read.schema("event_id long, props string").json(f"{at}/out", pathGlobFilter="*.jsonl")


@query("select r_name as run_id, 'collect' as command, case when r_regionkey % 2 = 0 then 'ok' else 'partial' end as status, cast((select count(*) from nation where n_regionkey = r_regionkey) as bigint) as records from region")
def snk_runlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run for each region, noted from its start to its end; the latest state counts."""
    log, counts = runlog.RunLog(spark, work_dir(spark)), table(spark, sf_dir, "nation").groupBy("n_regionkey").count()
    for r in table(spark, sf_dir, "region").join(counts, F.col("r_regionkey") == F.col("n_regionkey")).collect():
        log.start(r["r_name"], "collect")
        log.source(r["r_name"], "s", 1, 1, 0, 0)
        log.source(r["r_name"], "s", 2, r["count"], 1, 1)
        log.finish(r["r_name"], "collect", runlog.outcome(r["r_regionkey"] % 2 == 1, False, False)[0])
    return log.runs().join(log.sources(), "run_id").select("run_id", "command", "status", "records")


class Scripted:
    """Answers from a list."""

    def __init__(self, statuses: list[int]):
        self.statuses = list(statuses)

    def get(self, url: str, headers: dict) -> replay.Answer:
        status = self.statuses.pop(0)
        return replay.Answer("ok", status, {"Retry-After": "7"} if status == 429 else {"x-ratelimit-remaining": "42"})


SCRIPTS = {"good": [200], "again": [500, 503, 200], "asked to wait": [429, 200], "absent": [404], "unpaid": [402], "conflict": [409], "wrong": [400], "odd": [501], "always busy": [429] * 5, "always down": [502] * 5}
KINDS = "event_id long, name string, outcome string, waits array<double>, attempts int, left int"


def outcome_of(name: str) -> tuple:
    """What a request meets whose service answers by a script."""
    slept, notes = [], []
    t = transport.Transport(Scripted(SCRIPTS[name]), {"s": transport.Policy("s", "h")}, sleep=slept.append, clock=lambda: 0.0, budget=transport.Budget(warn=lambda m: None), observer=notes.append)
    try:
        outcome = t.get("s", "/")
    except transport.TransportError as error:
        outcome = type(error).__name__
    return name, outcome, [float(x) for x in slept], len(notes), t.budget.remaining("h")


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event a request, made by the tasks; the scripts take turns."""
    names = list(SCRIPTS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(i, *outcome_of(names[i % len(names)])) for i in batch["event_id"].tolist()]
            yield pd.DataFrame(rows, columns=["event_id", "name", "outcome", "waits", "attempts", "left"]).astype({"left": "Int32"})

    return table(spark, sf_dir, "events").select("event_id").mapInPandas(run, KINDS)


def by_turn(columns: str, *values: str) -> str:
    """SQL that gives each event its script's row."""
    rows = ", ".join(f"({i}, '{name}', {value})" for i, (name, value) in enumerate(zip(SCRIPTS, values, strict=True)))
    return f"select event_id, {columns} from events join (values {rows}) t(turn, name, given) on event_id % {len(SCRIPTS)} = turn"


OUTCOMES = ["'ok'", "'ok'", "'ok'", "'NotFound'", "'BudgetExhausted'", "'BudgetExhausted'", "'PermanentError'", "'TransientError'", "'RateLimited'", "'TransientError'"]


@query(by_turn("name, given as outcome", *OUTCOMES))
def ing_request(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests(spark, sf_dir).select("event_id", "name", "outcome")


@query(f"select outcome, count(*) as n from ({by_turn('given as outcome', *OUTCOMES)}) where outcome <> 'ok' group by 1")
def ing_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests(spark, sf_dir).where("outcome <> 'ok'").groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@query(f"select * from ({by_turn('name, given as waits', *[repr(w) for w in ('', '1.5|3.0', '7.0', '', '', '', '', '', '7.0|7.0|7.0|7.0', '1.5|3.0|6.0|12.0')])}) where waits <> ''")
def ing_retry_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is waited before a request is made again: the service's wish, else ever longer."""
    waited = requests(spark, sf_dir).where("size(waits) > 0")
    return waited.select("event_id", "name", F.array_join(F.transform("waits", lambda w: w.cast("string")), "|").alias("waits"))


@query(by_turn("name, cast(given as int) as attempts", *"1321111155"))
def ing_observer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One note an attempt."""
    return requests(spark, sf_dir).select("event_id", "name", "attempts")


@query(by_turn("name, cast(given as int) as remaining", *["42"] * 8, "null", "42"))
def ing_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests(spark, sf_dir).select("event_id", "name", F.col("left").alias("remaining"))


class Host:
    """A host that always answers, its clock, and a transport that keeps its pace."""

    def __init__(self):
        self.now, self.asked = 0.0, 0
        self.transport = transport.Transport(self, {"s": transport.Policy("s", "h", 4.0)}, sleep=self.sleep, clock=lambda: self.now, budget=transport.Budget(warn=lambda m: None))

    def get(self, url: str, headers: dict) -> replay.Answer:
        return replay.Answer("ok")

    def sleep(self, seconds: float) -> None:
        self.now += seconds

    def ask(self) -> tuple[int, float]:
        """The number of a request, and how long it waited."""
        before, self.asked = self.now, self.asked + 1
        self.transport.get("s", "/")
        return self.asked, self.now - before


def throttled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Requests of rows (user_id, day) that lie side by side; a host goes on across batches."""
    held, host = None, None
    for batch in batches:
        rows = []
        for user, day in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if host is None or (user, day) != held:
                held, host = (user, day), Host()
            request, wait = host.ask()
            rows.append((user, request, day, wait))
        columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), pa.int32(), pa.date32(), pa.float64()))]
        yield pa.RecordBatch.from_arrays(columns, names=["user_id", "request", "day", "wait"])


@query("select user_id, cast(row_number() over (partition by user_id, date_trunc('day', ts) order by event_id) as int) as request, cast(date_trunc('day', ts) as date) as day, case when request = 1 then 0.0 else 4.0 end as wait from events")
def ing_throttle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A host is asked again only after its interval; here each user's day is a host of its own, and a task asks its hosts one after another."""
    days = table(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("day"))
    return days.repartition("user_id", "day").sortWithinPartitions("user_id", "day").mapInArrow(throttled, "user_id long, request int, day date, wait double")


@query("select 'd' || doc_id as key, case when doc_id % 2 = 0 then 'ok' else 'not_found' end as status from documents")
def ing_cache_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only keys without a stored answer are asked for; then all have one."""
    keys = table(spark, sf_dir, "documents").select(F.lit("crossref").alias("source"), F.concat(F.lit("d"), "doc_id").alias("key"), "doc_id")
    answers = lambda k: rest.lookup_table(k, "crossref", REPLAY, tasks=2).withColumn("seq", F.lit(0))
    cache = answers(keys.where("doc_id % 3 = 0")).drop("seq")
    asked = cache_misses(keys.drop("doc_id"), cache)
    return cache_put(cache, answers(asked)).select("key", "status")


@query("select count(*) as expected from orders")
def ing_dry_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the number of works is asked for; nothing is stored."""
    t = rest.made(order_pages(spark, sf_dir)["transport"])
    return spark.createDataFrame([(rest.works_page(t, "q", "1990-01-01", "2010-12-31", "*")["total"],)], "expected long")


@query("select strftime(o_orderdate, '%Y-%m') as month_bucket, count(*) as paper_count, strftime(o_orderdate, '%Y-%m') in ('2001-07', '2001-08') as is_provisional from orders group by 1, 3")
def stm_provisional(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Late data is marked, not held back: the newest months are provisional."""
    rows = table(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("month_bucket"), F.lit("q").alias("query_id"))
    return trend.monthly_denominator(rows, provisional=["2001-07", "2001-08"]).select("month_bucket", "paper_count", "is_provisional")


@query("select p_partkey, p_name || '|' || upper(p_name) as zipped from part")
def join_unmatched_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record and its normalised form are one row, so nothing is joined."""
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.transform(F.arrays_zip(F.array("p_name").alias("a"), F.array(F.upper("p_name")).alias("b")), lambda z: F.concat_ws("|", z["a"], z["b"])), "").alias("zipped"))
