"""Requests, paged sources, incremental collection."""

from __future__ import annotations

import hashlib
import json
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from quillmill.sources import download, files, paged, runlog, transport
from quillmill.streaming import ingest


class Answer:
    def __init__(self, status, headers=None, text="ok"):
        self.status_code, self.headers, self.text = status, headers or {}, text


class Session:
    def __init__(self, *answers):
        self.answers, self.asked = list(answers), []

    def get(self, url, headers):
        self.asked.append((url, headers))
        answer = self.answers.pop(0)
        if isinstance(answer, Exception):
            raise answer
        return answer


def made(*answers, **policy):
    slept, now = [], [0.0]

    def sleep(s):
        slept.append(s)
        now[0] += s

    t = transport.Transport(Session(*answers), {"s": transport.Policy("s", "h", **policy)}, sleep=sleep, clock=lambda: now[0])
    return t, slept


def test_retries_then_answers():
    t, slept = made(Answer(500), OSError(), Answer(429, {"Retry-After": "7"}), Answer(200))
    assert t.get("s", "/p", {"a": 1}) == "ok"
    assert slept == [1.5, 3.0, 7.0] and t.session.asked[0][0] == "https://h/p?a=1"


@pytest.mark.parametrize(
    ("answers", "error"),
    [
        ([Answer(404)], transport.NotFound),
        ([Answer(402)], transport.BudgetExhausted),
        ([Answer(409)], transport.BudgetExhausted),
        ([Answer(400)], transport.PermanentError),
        ([Answer(501)], transport.TransientError),
        ([Answer(429)] * 5, transport.RateLimited),
        ([Answer(503)] * 5, transport.TransientError),
        ([OSError()] * 5, transport.TransientError),
    ],
)
def test_errors(answers, error):
    t, _ = made(*answers)
    with pytest.raises(error):
        t.get("s", "/")
    assert not t.session.answers


def test_pace_keys_budget_and_observer(monkeypatch):
    t, slept = made(Answer(200, {"X-RateLimit-Remaining": "5"}), Answer(200, {"x-ratelimit-remaining": "4"}), interval=4.0, interval_with_key=1.0, key_variable="QM_KEY", key_parameter="api_key", key_header="x-key")
    said, notes = [], []
    t.budget.warn = said.append
    t.observer = lambda n: notes.append(n) or 1 / 0
    t.get("s", "/")
    assert t.session.asked[0] == ("https://h/", {})
    monkeypatch.setenv("QM_KEY", "k")
    t.get("s", "/")
    assert t.session.asked[1] == ("https://h/?api_key=k", {"x-key": "k"})
    assert slept == [1.0] and len(said) == 1 and t.budget.remaining("h") == 4 and [n["status"] for n in notes] == [200, 200]


def test_waits():
    assert [transport.backoff(n) for n in (0, 1, 9)] == [1.5, 3.0, 60.0]
    now = lambda: datetime(2026, 1, 1, tzinfo=UTC)
    assert transport.retry_after("2.5") == 2.5 and transport.retry_after("Thu, 01 Jan 2026 00:00:09 GMT", now) == 9.0
    assert transport.retry_after("soon") is None and transport.retry_after(None) is None


@pytest.fixture
def pages(tmp_path):
    folder = tmp_path / "pages"
    folder.mkdir()
    save = lambda c, **p: (folder / f"{c}.json").write_text(json.dumps(p))
    save("_", results=[{"id": "A"}, {"id": ""}], next_cursor="two")
    save("two", results=[{"id": "B"}, {"id": "A"}], next_cursor="three")
    save("three", results=[{"id": "C"}], next_cursor=None)
    save("2024-01", results=[{"pmid": "1"}], next_cursor="2024-01-b")
    save("2024-01-b", results=[{"pmid": "2"}], next_cursor=None)
    save("2024-03", results=[{"pmid": "3"}], next_cursor=None)
    return str(folder)


def test_batch_sources(spark, pages):
    paged.register_all(spark)
    rows = spark.read.format("works_pages").option("folder", pages).load()
    assert sorted(r["id"] for r in rows.collect()) == ["A", "A", "B", "C"]
    assert spark.read.format("works_pages").option("folder", pages).option("maxPages", 1).load().count() == 1
    months = spark.read.format("monthly_records").options(folder=pages, **{"from": "2024-01", "to": "2024-03"}).load()
    assert sorted((r["pmid"], r["month_bucket"]) for r in months.collect()) == [("1", "2024-01"), ("2", "2024-01"), ("3", "2024-03")]
    assert months.rdd.getNumPartitions() == 3


def test_registry():
    with pytest.raises(ValueError):
        paged.register(paged.WorksPages)
    with pytest.raises(TypeError):
        paged.register(dict)


def test_stream_offsets(pages):
    reader = paged.WorksReader({"folder": pages})
    at, seen = reader.initialOffset(), []
    for _ in range(5):
        rows, at = reader.read(at)
        seen += [r[0] for r in rows]
    assert seen == ["A", "B", "A", "C"] and at == {"cursor": "", "pages": 3, "received": 4, "total": None}
    again = [r[0] for r in reader.readBetweenOffsets({"cursor": "two", "pages": 1}, {"cursor": "", "pages": 3})]
    assert again == ["B", "A", "C"]


def test_one_source_serves_all_pages_and_stays_behind(pages):
    reader = paged.WorksReader({"folder": pages})
    _, at = reader.read(reader.initialOffset())
    source = reader.source
    reader.read(at)
    assert source is not None and reader.source is source
    assert reader.__getstate__()["source"] is None and reader.__getstate__()["options"] == {"folder": pages}


def test_stream_bounds_a_run(pages):
    reader = paged.WorksReader({"folder": pages, "maxPages": "1"})
    _, at = reader.read(reader.initialOffset())
    assert at["cursor"] == "two" and reader.read(at)[1] is at


def month_pages(options):
    """Two months of two and no pages, and a third that appears with a longer window."""
    held = {"2024-01": (["1", "2"], "2024-01@2"), "2024-01@2": (["2", ""], None), "2024-03": (["3"], None)}

    def fetch(cursor):
        ids, then = held.get(cursor, ([], None))
        return {"results": [{"pmid": i, "month_bucket": cursor[:7]} for i in ids], "next_cursor": then, "total": {"2024-01": 2, "2024-03": 1}.get(cursor[:7], 0)}

    return fetch


def test_month_offsets():
    options = {"pages": "test_ingest:month_pages", "from": "2024-01", "to": "2024-02"}
    reader = paged.MonthStream(options)
    at, offsets, seen = reader.initialOffset(), [], []
    for _ in range(4):
        rows, at = reader.read(at)
        offsets.append(at)
        seen += [(r[0], r[3]) for r in rows]
    assert seen == [("1", 0), ("2", 1), ("2", 2)]
    assert (offsets[0]["month_cursor"], offsets[0]["retstart"]) == ("2024-01", 2) and offsets[2] is offsets[3]
    assert at["complete_through_month"] == "2024-02" and at["months"]["2024-01"] == {"expected": 2, "received": 3, "complete": True}
    longer = paged.MonthStream(options | {"to": "2024-03"})
    rows, end = longer.read(at)
    assert [r[0] for r in rows] == ["3"] and end["complete_through_month"] == "2024-03"
    assert [r[0] for r in longer.readBetweenOffsets(offsets[0], end)] == ["2", "3"]


def lines(path):
    return {f.name: f.read_text().splitlines() for f in sorted(path.glob("*.jsonl"))}


def test_pages_become_lines(spark, pages, tmp_path):
    paged.register_all(spark)
    out, state = tmp_path / "out", str(tmp_path / "state")
    (out).mkdir()
    (out / "kept.jsonl").write_text('{"id": "Z"}')
    stream = lambda: spark.readStream.format("works_pages").option("folder", pages)
    first = ingest.collect_pages(spark, stream(), str(out), state, most=2)
    assert (first.pages, first.error, first.offset["cursor"]) == (2, None, "three")
    second = ingest.collect_pages(spark, stream(), str(out), state)
    assert (second.pages, second.offset["cursor"]) == (1, "")
    third = ingest.collect_pages(spark, stream(), str(out), state)
    assert (third.pages, third.offset) == (0, second.offset)
    found = lines(out)
    assert [[json.loads(r)["id"] for r in found[n]] for n in sorted(found)] == [["Z"], ["A"], ["B"], ["C"]]


def many_pages(options):
    """Forty pages of two; the one named by ``refused`` fails."""
    from quillmill.sources.transport import PermanentError

    def fetch(cursor):
        n = 0 if cursor == "*" else int(cursor)
        if str(n) == options.get("refused"):
            raise PermanentError("refused")
        return {"results": [{"id": f"{n}a"}, {"id": f"{n}b"}], "next_cursor": str(n + 1) if n < 39 else None}

    return fetch


def test_long_collections_need_few_batches(spark, tmp_path):
    paged.register_all(spark)
    out, state = tmp_path / "out", str(tmp_path / "state")
    stream = lambda **o: spark.readStream.format("works_pages").options(pages="test_ingest:many_pages", **o)
    failed = ingest.collect_pages(spark, stream(refused="13"), str(out), state)
    assert (failed.pages, failed.error) == (13, "PermanentError")  # what came before it in its batch is there
    whole = ingest.collect_pages(spark, stream(), str(out), state)
    assert (whole.pages, whole.error, whole.offset["cursor"]) == (27, None, "")
    found = [json.loads(x)["id"] for v in lines(out).values() for x in v]
    assert found == [f"{n}{x}" for n in range(40) for x in "ab"]
    assert len(files.names(spark, f"{state}/commits")) < 25
    reader = paged.WorksReader({"pages": "test_ingest:many_pages"})
    at, taken = reader.initialOffset(), []
    while at["cursor"]:
        before, (_, at) = at["pages"], reader.read(at)
        taken.append(at["pages"] - before)
    assert taken == [1, 1, 2, 4, 8, 16, 8]


def taken(reader, most=99):
    """Pages of each batch, how many were asked for when it was there, and all rows; what is asked for ahead is waited for."""
    asked, rows, sizes = [], [], []
    fetch = reader.fetch
    reader.fetch = lambda cursor: asked.append(cursor) or fetch(cursor)
    at = reader.initialOffset()
    while at["cursor"] and len(sizes) < most:
        before, (found, at) = at["pages"], reader.read(at)
        if at["pages"] == before:
            break
        if reader.asking:
            reader.asking.join()
        sizes.append((at["pages"] - before, len(asked)))
        rows += found
    return sizes, rows, asked


@pytest.mark.parametrize("bound", [{"BATCH_ROWS": 8}, {"BATCH_CHARS": 4 * 2 * len('{"id": "10a"}') - 7}])
def test_pages_are_asked_for_while_a_batch_is_written(monkeypatch, bound):
    """Each page once and in order, and never more of them uncommitted than committed."""
    for k, v in bound.items():
        monkeypatch.setattr(paged, k, v)
    sizes, rows, asked = taken(paged.WorksReader({"pages": "test_ingest:many_pages"}))
    assert [r[0] for r in rows] == [f"{n}{x}" for n in range(40) for x in "ab"] and len(asked) == len(set(asked)) == 40
    done, ahead = 0, []
    for size, n in sizes:
        assert n - done <= max(1, done)
        done += size
        ahead.append(n - done)
    assert max(s for s, _ in sizes) in (4, 5) and max(ahead) in (4, 5) and done == 40
    sizes, rows, asked = taken(paged.WorksReader({"pages": "test_ingest:many_pages", "maxPages": "18"}))
    assert sum(s for s, _ in sizes) == len(asked) == 18 and len(rows) == 36


def test_a_page_that_fails_ahead_ends_the_batch_before_it(monkeypatch):
    monkeypatch.setattr(paged, "BATCH_ROWS", 8)
    reader = paged.WorksReader({"pages": "test_ingest:many_pages", "refused": "14"})
    sizes, rows, asked = taken(reader, 5)
    assert [s for s, _ in sizes] == [1, 1, 2, 4, 4] and asked[-1] == "14"  # asked for ahead
    found, at = reader.read({"cursor": "12", "pages": 12, "received": 24, "total": None})
    assert [r[0] for r in [*rows, *found]] == [f"{n}{x}" for n in range(14) for x in "ab"] and at["cursor"] == "14"
    with pytest.raises(transport.PermanentError):
        reader.read(at)
    assert asked.count("14") == 1
    assert reader.__getstate__()["asking"] is None


def test_streams_hand_over_few_arrow_batches(pages):
    from pyspark.sql.types import StructType

    source = paged.WorksPages({"pages": "test_ingest:many_pages"})
    reader = source.simpleStreamReader(StructType.fromDDL(source.schema()))
    at, sizes, rows = reader.initialOffset(), [], []
    while at["cursor"]:
        found, at = reader.read(at)
        found = list(found)
        sizes.append(len(found))
        rows += [r for b in found for r in b.to_pylist()]
    assert sizes == [1] * 7 and len(rows) == 80
    assert rows[3] == {"id": "1b", "raw": '{"id": "1b"}', "place": paged.PAGE_ROWS + 1, "year": None}
    odd = reader.handed_over([(7, "{}", 0, 2001), (True, "{}", 1, None)])[0].to_pydict()
    assert odd == {"id": ["7", "true"], "raw": ["{}", "{}"], "place": [0, 1], "year": [2001, None]}  # as Spark makes strings of them


def test_seen_keys_lie_on_disk(spark, tmp_path, monkeypatch):
    """A new collection keeps its keys in a store of bounded memory; one that was begun with another store goes on with it."""
    from quillmill.streaming.seen import PROVIDER, PROVIDER_SETTING

    paged.register_all(spark)
    stream = lambda: spark.readStream.format("works_pages").options(pages="test_ingest:many_pages")
    store = lambda state: json.loads((tmp_path / state / "offsets" / "0").read_text().splitlines()[1])["conf"][PROVIDER_SETTING]
    before = spark.conf.get(PROVIDER_SETTING)
    ingest.collect_pages(spark, stream(), str(tmp_path / "new"), str(tmp_path / "state"), most=2)
    assert store("state") == PROVIDER and spark.conf.get(PROVIDER_SETTING) == before
    with monkeypatch.context() as m:
        m.setattr(ingest, "GROWING", {})
        ingest.collect_pages(spark, stream(), str(tmp_path / "old"), str(tmp_path / "begun"), most=2)
    assert store("begun") == before != PROVIDER
    for out, state in (("new", "state"), ("old", "begun")):
        assert ingest.collect_pages(spark, stream(), str(tmp_path / out), str(tmp_path / state)).pages == 38
        assert [json.loads(x)["id"] for v in lines(tmp_path / out).values() for x in v] == [f"{n}{x}" for n in range(40) for x in "ab"]


def test_pages_are_written_by_few_tasks(spark, tmp_path, monkeypatch):
    from quillmill import session
    from quillmill.plans import replay

    monkeypatch.setattr(replay, "PAGE_ROWS", 10)
    rows = spark.range(1000).selectExpr("id", "to_json(struct(concat('W', id) as id)) as line")
    top = tmp_path / "works"
    replay.write_pages(rows, F.col("id"), str(top))
    parts = list(top.glob("page=*/part-*.txt"))
    assert len(parts) == 100 and len({f.name for f in parts}) <= session.partitions(spark, 1000)
    assert all([json.loads(x)["id"] for x in f.read_text().splitlines()] == [f"W{n}" for n in range(int(f.parent.name[5:]), 1000, 100)] for f in parts)


def test_months_are_served_in_chunks(spark, tmp_path, monkeypatch):
    from quillmill.plans import replay

    monkeypatch.setattr(replay, "PAGE_ROWS", 7)
    rows = spark.range(50).selectExpr("if(id < 40, '2024-01', '2024-02') as month", """to_json(struct(format_string('p%02d', id) as pmid)) as line""")
    service = replay.Tables(replay.write_months(rows, str(tmp_path / "months")))
    asked = lambda m, start, most: json.loads(service.get(f"https://h/esearch.fcgi?mindate={m}/01&retstart={start}&retmax={most}", {}).text)["esearchresult"]
    assert asked("2024/01", 5, 20) == {"idlist": [f"p{i:02d}" for i in range(5, 25)], "count": "40"}
    assert asked("2024/01", 35, 20)["idlist"] == [f"p{i}" for i in range(35, 40)] and asked("2024/02", 0, 3)["idlist"] == ["p40", "p41", "p42"]
    assert asked("2024/03", 0, 3) == {"idlist": [], "count": "0"}
    assert len(service.read[1]) <= 7  # no more than a chunk is held


def test_lines_replace_their_own_name(spark, tmp_path):
    rows = lambda *v: spark.createDataFrame([(x,) for x in v], "raw string")
    out = tmp_path / "out"
    for name, given in (("a", rows("1", "2").repartition(2)), ("b", rows("3")), ("a", rows("4").coalesce(1)), ("c", rows("5").limit(0))):
        files.write_lines(given, str(out), name)
    assert sorted(x for v in lines(out).values() for x in v) == ["3", "4"] and not [n for n in files.names(spark, str(out)) if n.startswith("_")]


def test_json_array(spark, tmp_path):
    at = tmp_path / "t.json"
    assert files.write_json_array(spark.createDataFrame([(1, "é"), (2, None)], "a int, b string").orderBy("a"), str(at)) == 2
    assert json.loads(at.read_text(encoding="utf-8")) == [{"a": 1, "b": "é"}, {"a": 2, "b": None}]
    assert files.write_json_array(spark.createDataFrame([], "a int"), str(at)) == 0 and json.loads(at.read_text()) == []


def test_download_keeps_the_former_note(tmp_path):
    given, to = tmp_path / "given.csv", tmp_path / "to" / "cosing.csv"
    given.write_bytes("\ufeffINCI name,CAS No\r\nAQUA,1\r\n".encode())
    first = download.fetch_file(given.as_uri(), str(to))
    assert first["header_row"] == "INCI name,CAS No" and first["size_bytes"] == given.stat().st_size == to.stat().st_size
    assert first["sha256"] == hashlib.sha256(given.read_bytes()).hexdigest()
    with pytest.raises(OSError):
        download.fetch_file((tmp_path / "none.csv").as_uri(), str(to))
    given.write_text("other")
    download.fetch_file(given.as_uri(), str(to))
    assert json.loads(to.with_name("_meta.prev.json").read_text()) == first and to.read_text() == "other"


def test_collection_goes_on_where_it_stopped(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    for ids in (["a", "b", "a"], ["b", "c"]):
        spark.createDataFrame([(i,) for i in ids], "id string").coalesce(1).write.mode("append").parquet(source)
        ingest.collect_stream(ingest.read_files(spark, source, "id string"), out, state).awaitTermination()
    assert sorted(r["id"] for r in spark.read.parquet(out).collect()) == ["a", "b", "c"]


def test_census(spark):
    kinds = "expected int, collected int, duplicates int, complete boolean"
    judge = lambda *rows: ingest.census(spark.createDataFrame(rows, kinds)).first()["is_census"]
    assert judge((3, 3, 0, True), (2, 2, 1, True))
    assert not judge((3, 2, 0, True)) and not judge((3, 3, 0, False)) and not judge((None, 3, 0, True), (3, 0, 0, True))
    assert ingest.cursor_census(None, True, False) and not ingest.cursor_census(5, True, False) and not ingest.cursor_census(None, True, True)


def test_next_position():
    months = ["2024-01", "2024-02", "2024-03"]
    assert ingest.next_position(None, months) == ("2024-01", 0)
    assert ingest.next_position({"month_cursor": "2024-02", "retstart": 500}, months) == ("2024-02", 500)
    assert ingest.next_position({"month_cursor": "1999-01", "retstart": 5}, months) == ("2024-01", 0)
    assert ingest.next_position({"complete": True, "complete_through_month": "2024-02"}, months) == ("2024-03", 0)
    assert ingest.next_position({"complete": True, "complete_through_month": "2024-03"}, months) == (None, 0)


def test_stop_reasons(spark):
    assert runlog.outcome(True, True, True) == ("partial", "budget")
    assert runlog.outcome(False, True, True) == ("partial", "transport")
    assert runlog.outcome(False, False, False) == ("ok", None)
    row = spark.range(1).select(ingest.stop_reason(F.lit(False), F.lit(False), F.lit(True)).alias("r")).first()
    assert row["r"] == "max"


def test_run_log(spark, tmp_path):
    log = runlog.RunLog(spark, str(tmp_path))
    log.start("r1", "collect")
    log.source("r1", "s", 1, 1, 0, 0)
    log.source("r1", "s", 2, 5, 1, 1)
    log.fetches([{"source": "s", "url": "https://h/?q=1&token=x", "status": 200, "elapsed": 0.1}], "r1")
    log.finish("r1", "collect", "ok")
    run = log.runs().first()
    assert (run["status"], run["command"]) == ("ok", "collect") and run["started_at"] and run["finished_at"]
    assert [r["records"] for r in log.sources().collect()] == [5]
    assert spark.read.parquet(f"{tmp_path}/fetch_log").first()["url"] == "https://h/?q=1"


def test_counts_come_from_the_job_that_writes(spark, pages, tmp_path, monkeypatch):
    paged.register_all(spark)
    out = str(tmp_path / "out")
    stream = lambda: spark.readStream.format("works_pages").option("folder", pages)
    ingest.collect_pages(spark, stream(), out, str(tmp_path / "state"), most=1, tag="t")
    ingest.collect_pages(spark, stream(), out, str(tmp_path / "state"), tag="t")
    exact = files.json_lines(spark, out, "id").count()
    with monkeypatch.context() as m:
        m.setattr(files, "json_lines", None)  # nothing is read again
        assert ingest.stored_keys(spark, out, "t", "id") == exact > 0
    ingest.note_count(spark, out, "x", 0, 5)
    ingest.note_count(spark, out, "x", 1, 2)
    ingest.note_count(spark, out, "x", 1, 3)
    assert json.loads(files.read_text(spark, f"{out}/_count-x.json"))["total"] == 8
    ingest.collect_pages(spark, stream(), out, str(tmp_path / "other"), tag="u")
    assert ingest.stored_keys(spark, out, "t", "id") == exact  # two tags: the lines are read
    assert ingest.stored_keys(spark, str(tmp_path / "nothing"), "t", "id") == 0


def test_years_become_dates(spark, tmp_path):
    """A filter on years reaches the service; what it can't say stays with Spark."""
    from quillmill.plans import replay

    rows = spark.range(60).selectExpr("id", "to_json(struct(concat('W', id) as id, concat(2000 + id % 6, '-03-01') as publication_date)) as line")
    folder = replay.write_pages(rows.select("line", "id"), F.col("id"), str(tmp_path / "works"))
    paged.register_all(spark)
    options = {"pages": "quillmill.sources.rest:openalex_pages", "transport": f"quillmill.plans.replay:tables?{folder}", "query": "q", "from": "1990-01-01", "to": "2020-12-31"}
    where = lambda c: paged.works_where(spark, options, c)
    some = where("year >= 2001 and year < 2004 and id <> 'W1'")
    assert sorted({r["year"] for r in some.collect()}) == [2001, 2002, 2003] and some.count() == 29
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "(year" not in next(x for x in plan.split("\n") if "Filter" in x)  # Spark needn't look at years any more
    counts = {"year = 2002": 10, "year in (2001, 2004)": 20, "year > 2010": 0, "year > 2004 and year < 2003": 0, "id = 'W7'": 1}
    assert {c: where(c).count() for c in counts} == counts
    plain = spark.read.format("works_pages").options(**options).load()
    assert plain.where("year = 2002").count() == 10 and plain.count() == 60

    reader = paged.WorksReader(options | {"pushYears": "true"})
    from pyspark.sql.datasource import EqualTo, GreaterThan, LessThanOrEqual

    other = EqualTo(("id",), "W1")
    assert list(reader.pushFilters([GreaterThan(("year",), 2001), LessThanOrEqual(("year",), 2003), other])) == [other]
    assert (reader.options["from"], reader.options["to"]) == ("2002-01-01", "2003-12-31")


def test_months_are_crawled_side_by_side(spark, tmp_path):
    """Each work once, whether the service's pages are by month or not; the dates asked for bound the first and last month."""
    from quillmill.plans import replay

    rows = spark.range(3000).selectExpr("id", "date_format(date_add(date'2001-01-15', cast(id % 400 as int)), 'yyyy-MM-dd') as publication_date")
    lines = rows.selectExpr("to_json(struct(concat('W', id) as id, publication_date)) as line", "substr(publication_date, 1, 7) as month", "id", "publication_date").cache()
    folders = replay.write_month_pages(lines.select("line", "month", "id"), F.col("id"), str(tmp_path / "months")), replay.write_pages(lines.select("line", "id"), F.col("id"), str(tmp_path / "pages"))
    want = sorted(f"W{r['id']}" for r in lines.where("publication_date between '2001-01-20' and '2002-02-10'").collect())
    paged.register_all(spark)
    for folder in folders:
        options = {"pages": "quillmill.sources.rest:openalex_pages", "transport": f"quillmill.plans.replay:tables?{folder}", "query": "q", "from": "2001-01-20", "to": "2002-02-10", "split": "month"}
        found = spark.read.format("works_pages").options(**options).load()
        assert found.rdd.getNumPartitions() == 14
        got = found.collect()
        assert sorted(r["id"] for r in got) == want and len({r["place"] for r in got}) == len(want)
        assert spark.read.format("works_pages").options(**options, maxPages="1").load().rdd.getNumPartitions() == 1
    assert paged.works_where(spark, options, "year = 2002").rdd.getNumPartitions() == 2


def test_fixed_values():
    """What the classification and the services fix."""
    from quillmill.operators import trend
    from quillmill.sources import rest

    assert (trend.LOW_SAMPLE, trend.NEW_ENTRANT_PAPERS, trend.RECENT_MONTHS, trend.PRIOR_MONTHS) == (50, 5, 12, 24)
    assert [transport.backoff(i) for i in range(8)] == [min(1.5 * 2**i, 60) for i in range(8)]
    assert {p.key: p.key_parameter or p.key_header for p in rest.POLICIES.values() if p.key_variable} == {"crossref": "mailto", "openalex": "api_key", "pubmed": "api_key", "semantic_scholar": "x-api-key", "unpaywall": "email"}
    assert sorted(paged.SOURCES) == ["monthly_records", "works_pages"]


def test_a_spent_budget_is_noticed_before_asking():
    t, _ = made(Answer(200, {"x-ratelimit-remaining": "1"}), Answer(200, {"x-ratelimit-remaining": "0"}), Answer(200))
    assert t.get("s", "/") == t.get("s", "/") == "ok"
    with pytest.raises(transport.BudgetExhausted):
        t.get("s", "/")
    assert len(t.session.asked) == 2


def test_a_host_keeps_its_pace_across_batches():
    """Many hosts share a task; each starts anew, and one that lies in two batches goes on."""
    from datetime import date

    import pyarrow as pa

    from quillmill.plans.source_queries import throttled

    day = date(2024, 1, 1)
    batch = lambda *users: pa.RecordBatch.from_arrays([pa.array(users, pa.int64()), pa.array([day] * len(users))], names=["user_id", "day"])
    found = [tuple(r.values()) for b in throttled(iter([batch(1, 1, 2), batch(2, 3), batch(None, None)])) for r in b.to_pylist()]
    assert found == [(u, n, day, w) for u, n, w in ((1, 1, 0.0), (1, 2, 4.0), (2, 1, 0.0), (2, 2, 4.0), (3, 1, 0.0), (None, 1, 0.0), (None, 2, 4.0))]
