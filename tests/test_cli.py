"""Commands from raw files to reports, without a network."""

from __future__ import annotations

import csv
import io
import json
from dataclasses import dataclass
from urllib.parse import parse_qs, urlsplit

import pytest

from quillmill import cli
from quillmill.sources import rest
from quillmill.sources.transport import Transport
from quillmill.sources.versioned import VersionedTable

WORKS = [
    {"id": "W1", "doi": "https://doi.org/10.1/A", "title": "Zinc oxide", "publication_date": "2024-01-05", "keywords": [{"display_name": "ZnO"}, {"display_name": "zinc oxide"}], "topics": [{"display_name": "Chemistry"}], "cited_by_count": 4},
    {"id": "W2", "doi": None, "title": "Other", "publication_date": "2024-01-09", "keywords": [{"display_name": "novel blend"}], "cited_by_count": 0},
    {"id": "W3", "doi": "10.1/c", "title": "Third", "publication_date": "2024-02", "keywords": [], "cited_by_count": 7},
    {"id": "W4", "title": "Undated", "publication_date": "2024", "keywords": [{"display_name": "novel blend"}]},
]


def held_table(spark, path):
    return VersionedTable(spark, str(path), []).read()


@dataclass
class Answer:
    text: str
    status_code: int = 200
    headers: dict = None

    def __post_init__(self):
        self.headers = self.headers or {}


class Saved:
    """Answers by path, as the services give them."""

    def get(self, url, headers):
        at = urlsplit(url)
        q = {k: v[0] for k, v in parse_qs(at.query).items()}
        if at.path == "/works" and "group_by" in q:
            return Answer(json.dumps({"group_by": [{"key": "2025", "count": 2}, {"key": "unknown"}, {"key": "2024", "count": 5}]}))
        if at.path == "/works":
            rest_ = q["cursor"] == "two"
            return Answer(json.dumps({"results": WORKS[2:] if rest_ else WORKS[:2], "meta": {"count": 4, "next_cursor": None if rest_ else "two"}}))
        if at.path == "/works/10.1/a":
            return Answer(json.dumps({"message": {"title": ["Zinc Oxide!"], "container-title": ["CJ"]}}))
        if at.path.endswith("esearch.fcgi"):
            return Answer(json.dumps({"esearchresult": {"idlist": ["1"] if q.get("mindate", "2024/01").startswith("2024/01") else [], "count": "1"}}))
        if at.path.endswith("efetch.fcgi"):
            return Answer("<PubmedArticleSet><PubmedArticle><MedlineCitation><PMID>1</PMID></MedlineCitation></PubmedArticle></PubmedArticleSet>")
        if "/cids/" in at.path:
            return Answer(json.dumps({"IdentifierList": {"CID": [14806]}})) if "novel" in at.path.lower() else Answer("{}", 404)
        if "/synonyms/" in at.path:
            return Answer(json.dumps({"InformationList": {"Information": [{"Synonym": ["Novel-Blend", "1314-13-2"]}]}}))
        if at.path == "/api/v2/studies":
            return Answer(json.dumps({"studies": [{"protocolSection": {"identificationModule": {"nctId": "N1", "briefTitle": "Zinc trial"}}}]}))
        return Answer("{}", 404)


class Broken(Saved):
    """Refuses the second page of works, and articles asked for a second month."""

    def get(self, url, headers):
        return Answer("{}", self.status) if "cursor=two" in url or "2024%2F02" in url else super().get(url, headers)


def broken() -> Transport:
    Broken.status = 400
    return Transport(Broken(), rest.POLICIES, sleep=lambda s: None)


def spent() -> Transport:
    Broken.status = 402
    return Transport(Broken(), rest.POLICIES, sleep=lambda s: None)


class Months(Saved):
    """One article a month."""

    def get(self, url, headers):
        q = {k: v[0] for k, v in parse_qs(urlsplit(url).query).items()}
        if "mindate" in q:
            return Answer(json.dumps({"esearchresult": {"idlist": [q["mindate"][5:7]], "count": "1"}}))
        if "efetch" in url:
            heading = "<MeshHeadingList><MeshHeading><DescriptorName>Skin</DescriptorName></MeshHeading></MeshHeadingList>"
            return Answer(f"<PubmedArticleSet><PubmedArticle><MedlineCitation><PMID>{q['id']}</PMID>{heading}</MedlineCitation></PubmedArticle></PubmedArticleSet>")
        return super().get(url, headers)


class MonthsBroken(Months):
    def get(self, url, headers):
        return Answer("{}", 402) if "2024%2F02" in url or "2024/02" in url else super().get(url, headers)


def monthly() -> Transport:
    return Transport(Months(), rest.POLICIES, sleep=lambda s: None)


def monthly_spent() -> Transport:
    return Transport(MonthsBroken(), rest.POLICIES, sleep=lambda s: None)


def offline() -> Transport:
    return Transport(Saved(), rest.POLICIES, sleep=lambda s: None)


@pytest.fixture
def at(tmp_path, spark):
    raw = tmp_path / "data" / "raw" / "openalex" / "p"
    raw.mkdir(parents=True)
    (raw / "a.jsonl").write_text("\n".join(map(json.dumps, WORKS)))
    (raw / "_meta.json").write_text(json.dumps({"is_census": True, "collected_at": "2024-02-20"}))
    other = tmp_path / "data" / "raw" / "pubmed" / "p"
    other.mkdir(parents=True)
    (other / "a.jsonl").write_text(json.dumps({"pmid": "1", "doi": "10.1/a", "mesh_terms": ["Skin"], "month_bucket": "2024-01"}))
    (other / "_meta.json").write_text(json.dumps({"is_census": False}))
    (tmp_path / "lexicon.json").write_text(json.dumps({"ZINC_OXIDE": {"canonical_en": "zinc oxide", "aliases": ["zno"], "category": "uv_filter"}}))
    (tmp_path / "stop.json").write_text(json.dumps({"field_labels": ["Chemistry"]}))

    def run(*args, code=0):
        group, command, *others = args
        more = ["--store", str(tmp_path / "store")] + ([] if "--transport" in others else ["--transport", "test_cli:offline"])
        if "--profile" in others:
            more += ["--data", str(tmp_path / "data")]
            if command != "collect":
                more += ["--out", str(tmp_path / "out"), "--lexicon", str(tmp_path / "lexicon.json"), "--stopwords", str(tmp_path / "stop.json")]
        assert cli.main([group, command, *others, *more]) == code

    run.path = tmp_path
    return run


def rows(at, name):
    return list(csv.DictReader(io.StringIO((at.path / "out" / "p" / name).read_bytes().decode("utf-8-sig"))))


def test_trend_reports(at, capsys):
    at("trend", "records", "--profile", "p")
    assert json.loads(capsys.readouterr().out.splitlines()[-1])["precision_year_only"] == 1
    at("trend", "aggregate", "--profile", "p", "--threshold", "2")
    assert [(r["month_bucket"], r["paper_count"], r["is_low_sample"], r["is_provisional"]) for r in rows(at, "monthly_denominator.csv")] == [("2024-01", "2", "False", "False"), ("2024-02", "1", "True", "True")]
    zinc = rows(at, "keyword_monthly.csv")[0]
    assert (zinc["keyword_key"], zinc["paper_count"], zinc["prevalence"], zinc["citation_median"], zinc["weighted_prevalence"]) == ("ZINC_OXIDE", "1", "0.5", "4.0", "0.75")
    assert rows(at, "topic_monthly.csv") == [] and len(rows(at, "trend_metrics.csv")) == 2
    at("trend", "normalize", "--profile", "p")
    at("trend", "unmatched", "--profile", "p")
    assert [(r["term"], r["paper_count"], r["example_title_2"]) for r in rows(at, "unmatched_p_keywords.csv")] == [("novel blend", "2", "Undated")]
    at("trend", "overlap", "--profile", "p")
    assert rows(at, "provider_overlap.csv")[0]["both"] == "1"
    at("trend", "aggregate", "--profile", "p", "--provider", "pubmed", code=1)
    at("trend", "aggregate", "--profile", "p", "--provider", "pubmed", "--allow-sample")
    assert rows(at, "mesh_monthly.csv")[0]["mesh_term"] == "skin"
    at("trend", "records", "--profile", "nothing", code=1)


def test_ingredients_and_suggestions(at, capsys):
    at("trend", "suggest", "--profile", "p")
    at("ingredient", "resolve", "--name", "Novel blend X")
    at("ingredient", "resolve", "--name", "unheard of")
    at("ingredient", "show", "--name", "novel  BLEND x")
    assert json.loads(capsys.readouterr().out.splitlines()[-1])["cas"] == "1314-13-2"
    at("ingredient", "show", "--name", "unheard of", code=1)
    (at.path / "c.csv").write_text("INCI name,CAS No\nNOVEL BLEND X,\nAQUA,7732-18-5\n ,\n")
    at("ingredient", "import-cosing", "--csv", str(at.path / "c.csv"))
    assert json.loads(capsys.readouterr().out.splitlines()[-1]) == {"read": 3, "saved": 2, "skipped": 1}
    at("trend", "suggest", "--profile", "p")
    assert [(r["matched_via"], r["suggested_key"], r["sources"]) for r in rows(at, "lexicon_suggestions.csv")] == [("synonym:Novel-Blend", "NOVEL_BLEND_X", "pubchem, cosing")]


def test_network_commands(at, capsys, monkeypatch):
    at("evidence", "trend", "--query", "q", "--from", "2024", "--to", "2025")
    assert capsys.readouterr().out.split() == ["2024", "5", "2025", "2"]
    at("evidence", "collect", "--query", "q", "--from", "2024", "--to", "2025", "--limit", "4")
    capsys.readouterr()
    at("evidence", "cite", "--keyword", "zinc")
    found = json.loads(capsys.readouterr().out.splitlines()[-1])
    assert (found["key"], found["crossref_verified"], found["title_match"], found["confidence_score"], found["journal"]) == ("10.1/a", True, True, 75, "CJ")
    at("trials", "collect", "--query", "zinc")
    at("trials", "list", "--keyword", "ZINC")
    assert json.loads(capsys.readouterr().out.splitlines()[-1])["nct_id"] == "N1"
    from quillmill import cli

    def spent(t, query, token):
        if token != "*":
            raise cli.rest.TransportError("budget is spent")
        return {"results": [{"protocolSection": {"identificationModule": {"nctId": "N7", "briefTitle": "Copper"}}}], "next_cursor": "next"}

    monkeypatch.setattr(cli.rest, "trials_page", spent)
    at("trials", "collect", "--query", "copper", code=1)
    at("trials", "list", "--keyword", "copper")
    assert json.loads(capsys.readouterr().out.splitlines()[-1])["nct_id"] == "N7"
    for provider, n in (("openalex", "4"), ("pubmed", "1"), ("openalex", "4")):
        window = "2024-01..2024-02" if provider == "pubmed" else "2024-01-01..2024-12-31"
        at("trend", "collect", "--profile", "p", "--query", "q", "--window", window, "--provider", provider)
        assert capsys.readouterr().out.split()[-1] == n


def note(at, provider):
    return json.loads((at.path / "data" / "raw" / provider / "new" / "_meta.json").read_text())


def test_works_from_collection_to_report(at, capsys, spark):
    collect = ("trend", "collect", "--profile", "new", "--query", "q", "--window", "2024-01-01..2024-12-31")
    at(*collect, "--dry-run")
    assert json.loads(capsys.readouterr().out) == {"dry_run": True, "count": 4, "estimated_requests": 1}
    assert not (at.path / "data" / "raw" / "openalex" / "new").exists()
    for service, reason in (("broken", "transport"), ("spent", "budget")):
        at(*collect, "--transport", f"test_cli:{service}", code=1)
        meta = note(at, "openalex")
        assert (meta["collected"], meta["is_census"], meta["stopped_reason"], meta["remaining_estimate"]) == (2, False, reason, 2)
    at("trend", "aggregate", "--profile", "new", code=1)
    at(*collect)
    meta = note(at, "openalex")
    assert (meta["collected"], meta["new_this_run"], meta["pages_this_run"], meta["is_census"], meta["stopped_reason"], meta["expected_from_api"]) == (4, 2, 1, True, None, 4)
    at("trend", "aggregate", "--profile", "new", "--threshold", "2")
    made = list(csv.DictReader(io.StringIO((at.path / "out" / "new" / "monthly_denominator.csv").read_bytes().decode("utf-8-sig"))))
    assert [(r["month_bucket"], r["paper_count"]) for r in made] == [("2024-01", "2"), ("2024-02", "1")]
    at(*collect)
    assert note(at, "openalex")["new_this_run"] == 0 and note(at, "openalex")["is_census"]
    runs = spark.read.parquet(str(at.path / "store" / "log" / "run")).where("seq = 1").orderBy("finished_at").collect()
    assert sorted(r["status"] for r in runs) == ["ok", "ok", "partial", "partial"]


def test_months_from_collection_to_report(at, capsys):
    collect = lambda last, service, **k: at("trend", "collect", "--profile", "new", "--query", "q", "--provider", "pubmed", "--window", f"2024-01..{last}", "--transport", f"test_cli:{service}", **k)
    collect("2024-03", "monthly_spent", code=1)
    meta = note(at, "pubmed")
    assert (meta["collected"], meta["is_census"], meta["stopped_reason"], list(meta["months"])) == (1, False, "budget", ["2024-01"])
    collect("2024-02", "monthly")
    meta = note(at, "pubmed")
    assert (meta["collected"], meta["is_census"], meta["pages_this_run"]) == (2, True, 1)
    collect("2024-03", "monthly")
    meta = note(at, "pubmed")
    assert (meta["collected"], meta["is_census"], meta["pages_this_run"], meta["expected_from_api"]) == (3, True, 1, 3)
    at("trend", "aggregate", "--profile", "new", "--provider", "pubmed")
    made = list(csv.DictReader(io.StringIO((at.path / "out" / "new" / "mesh_monthly.csv").read_bytes().decode("utf-8-sig"))))
    assert [(r["month_bucket"], r["mesh_term"], r["paper_count"]) for r in made] == [(f"2024-0{i}", "skin", "1") for i in (1, 2, 3)]


def read_report(at, name):
    return list(csv.DictReader(io.StringIO((at.path / "out" / "p" / name).read_bytes().decode("utf-8-sig"))))


def test_excluded_topics_and_trailing_windows(at):
    names = at.path / "names.json"
    names.write_text(json.dumps([" CHEMISTRY"]))
    at("trend", "aggregate", "--profile", "p", "--exclude-topics", str(names))
    assert {r["month_bucket"]: r["paper_count"] for r in read_report(at, "monthly_denominator.csv")} == {"2024-01": "1", "2024-02": "1"}
    at("trend", "trailing", "--profile", "p")
    rows = {(r["month_bucket"], r["keyword_key"]): r for r in read_report(at, "trailing.csv")}
    assert rows["2024-02", "ZINC_OXIDE"]["paper_count"] == "0" and rows["2024-02", "ZINC_OXIDE"]["papers_trailing"] == "1"
    assert rows["2024-01", "ZINC_OXIDE"]["prevalence_trailing"] == "0.5" and rows["2024-02", "ZINC_OXIDE"]["prevalence_trailing"] == "0.25"


def test_an_older_paper_table_grows(at, spark):
    """A plain folder without headings, with a column that is gone."""
    path = at.path / "store" / "papers"
    spark.createDataFrame([("doi:10.1/a", "An old title", "note")], "key string, title string, remark string").write.parquet(str(path))
    at("evidence", "collect", "--query", "q", "--from", "2024", "--to", "2025", "--limit", "4")
    table = held_table(spark, path)
    assert {"mesh_terms", "confidence_score", "remark"} <= set(table.columns)
    assert table.where("remark = 'note'").count() == 1 and table.where("confidence_score is not null").count() == 2


def test_lookups_are_stored(at, capsys, spark):
    collect = ("evidence", "collect", "--query", "q", "--from", "2024", "--to", "2025", "--limit", "4")
    at(*collect)
    held = {(r["source"], r["key"]): r["status"] for r in (row for source in (at.path / "store" / "lookup_cache").iterdir() for row in held_table(spark, source).collect())}
    assert held["crossref", "10.1/a"] == "ok" and held["unpaywall", "10.1/a"] == "not_found"
    log = spark.read.parquet(str(at.path / "store" / "log" / "fetch_log"))
    noted = {(r["source"], r["status"]) for r in log.collect()}
    assert {("crossref", 200), ("unpaywall", 404)} <= noted and log.where("url like '%10.1/a%'").count() >= 2
    asked = lambda: sorted(r["requests"] for r in spark.read.parquet(str(at.path / "store" / "log" / "run_source")).collect())
    at(*collect)
    assert asked()[0] == 0 and asked()[1] > 0
    assert held_table(spark, at.path / "store" / "papers").where("collected_at > ''").count() == 2
    for table in ("retraction", "oa_location"):
        held_table(spark, at.path / "store" / table).count()
    given = at.path / "g.csv"
    given.write_text("INCI name,CAS No\nAQUA,7732-18-5\n")
    at("ingredient", "fetch-cosing", "--url", given.as_uri(), "--dir", str(at.path / "cosing"))
    at("ingredient", "import-cosing", "--csv", str(at.path / "cosing" / "cosing.csv"))
    assert held_table(spark, at.path / "store" / "ingredient").first()["fetched_at"] > "2"
