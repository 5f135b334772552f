"""Raw records, markup, files and exports."""

from __future__ import annotations

import json
import re

import pytest
from pyspark.sql import functions as F

from quillmill.functions import pubmed, records, text
from quillmill.sources import files


def one(spark, column, value=None):
    return spark.createDataFrame([(value,)], "v string").select(column.alias("c")).first()["c"]


@pytest.mark.parametrize(("doi", "want"), [("https://doi.org/10.1/AB", "10.1/ab"), (" doi:10.1/x ", "10.1/x"), ("http://doi.org/doi:10.1", "doi:10.1"), ("", None), (None, None)])
def test_bare_doi(spark, doi, want):
    assert one(spark, text.bare_doi(F.col("v")), doi) == want


def test_strip_knows_unicode_blanks(spark):
    assert one(spark, text.strip(F.col("v")), " \t a b 　") == "a b"


def test_scrub_url(spark):
    assert one(spark, text.scrub_url(F.col("v")), "https://h/p?a=1&API_KEY=x&b=&token=y#f") == "https://h/p?a=1&b=#f"
    assert one(spark, text.scrub_url(F.col("v")), "https://h/p?key=x") == "https://h/p"


def test_name_key_folds_case(spark):
    assert one(spark, text.name_key(F.col("v")), "  Straße  X ") == "strasse x"


def test_title_similarity(spark):
    df = spark.createDataFrame([("Zinc: Oxide!", "zinc oxide"), ("", "a"), (None, "a")], "a string, b string")
    assert [r["s"] for r in df.select(text.title_similarity(F.col("a"), F.col("b")).alias("s")).collect()] == [1.0, 0.0, 0.0]


def test_dirty_lists_keep_the_row(spark):
    raw = json.dumps({"id": "W", "keywords": [{"display_name": "a"}, 3, {"display_name": ""}, {}], "topics": "none", "publication_date": "2024-05-06", "cited_by_count": None})
    row = spark.createDataFrame([(raw,)], "v string").select(records.raw_json(F.col("v")).alias("v")).select(*records.trend_record(F.col("v"), "q", "d")).first()
    assert (row["keywords"], row["topics"], row["concepts"], row["citation_count"], row["month_bucket"]) == (["a"], [], [], 0, "2024-05")


def test_restore_abstract(spark):
    index = json.dumps({"b": [1, 3], "a": [0], "c": [2, "x"], "d": "no"})
    assert one(spark, records.restore_abstract(F.col("v")), index) == "a b c b"
    assert one(spark, records.restore_abstract(F.col("v")), "{}") is None


def test_trial(spark):
    study = {"protocolSection": {"identificationModule": {"nctId": "N1"}, "outcomesModule": {"b": 1, "a": [2]}}, "hasResults": True}
    row = spark.createDataFrame([(json.dumps(study),)], "v string").select(records.raw_json(F.col("v")).alias("v")).select(*records.trial_record(F.col("v"), "q", "now")).first()
    assert (row["nct_id"], row["phase"], row["conditions"], row["results_posted"], json.loads(row["outcomes_json"])) == ("N1", None, [], True, {"a": [2], "b": 1})


def test_update_date(spark):
    for parts, want in (([2024, 3, 5], "2024-03-05"), ([2024, 3], "2024-03"), ([2024], "2024"), ([], None)):
        assert one(spark, records.update_date(records.raw_json(F.col("v"))), json.dumps({"updated": {"date-parts": [parts]}})) == want


XML = "<PubmedArticleSet>{}</PubmedArticleSet>"
ARTICLE = "<PubmedArticle><MedlineCitation><PMID>{}</PMID><Article><ArticleTitle>Effects of <i>Retinol</i> on\n skin.</ArticleTitle><Abstract><AbstractText>One</AbstractText><AbstractText/><AbstractText>two</AbstractText></Abstract></Article></MedlineCitation><PubmedData><ArticleIdList><ArticleId IdType='doi'>10.1/x</ArticleId></ArticleIdList></PubmedData></PubmedArticle>"


def test_pubmed_xml(spark):
    docs = [("a", XML.format(ARTICLE.format(1) + ARTICLE.format(2))), ("b", XML.format("")), ("c", "<oops"), ("d", XML.format("<PubmedArticle/>")), ("e", None)]
    rows = pubmed.parse_articles(spark.createDataFrame(docs, "k string, x string"), "k", "x").collect()
    assert sorted((r["key"], r["status"], r["pmid"]) for r in rows if r["status"] == "ok") == [("a", "ok", "1"), ("a", "ok", "2")]
    assert {r["key"]: r["status"] for r in rows if r["key"] != "a"} == {"b": "empty", "c": "error", "d": "empty", "e": "error"}
    assert (rows[0]["title"], rows[0]["abstract"], rows[0]["doi"], rows[0]["mesh_terms"]) == ("Effects of Retinol on skin.", "One two", "10.1/x", [])


def test_raw_lines_first_of_an_id_stays(spark, tmp_path):
    raw = tmp_path / "raw" / "openalex" / "q"
    raw.mkdir(parents=True)
    lines = lambda *works: "\n".join(w if isinstance(w, str) else json.dumps(w) for w in works)
    (raw / "2026-01-01.jsonl").write_text(lines({"id": "A", "title": "first"}, "", "broken{", {"title": "no id"}, {"id": "B", "title": "b"}))
    (raw / "2026-01-02.jsonl").write_text(lines({"id": "A", "title": "second"}, {"id": "C", "title": "c"}))
    (raw / "_meta.json").write_text(json.dumps({"collected_at": "2026-01-02", "is_census": True}))
    got = {r["openalex_id"]: (r["title"], r["collected_at"]) for r in files.trend_records(spark, str(tmp_path), "q").collect()}
    assert got == {"A": ("first", "2026-01-02"), "B": ("b", "2026-01-02"), "C": ("c", "2026-01-02")}
    assert files.meta(spark, str(raw))["is_census"] and files.meta(spark, str(tmp_path)) == {}
    with pytest.raises(FileNotFoundError):
        files.raw_dir(spark, str(tmp_path), "pubmed", "q")


def test_older_folder_is_found(spark, tmp_path):
    (tmp_path / "raw" / "q").mkdir(parents=True)
    assert files.raw_dir(spark, str(tmp_path), "openalex", "q").endswith("/raw/q")


def test_ingredient_csv(spark, tmp_path):
    path = tmp_path / "c.csv"
    path.write_text('CAS No,INCI name,Chem/IUPAC Name / Description,INN name,Other\n1314-13-2,ZINC OXIDE,"zinc, oxide",,x\n,  ,skipped,,x\n,AQUA,,water,x\n', encoding="utf-8-sig")
    got = {r["name_key"]: r for r in files.ingredients_csv(spark, str(path), "t").collect()}
    assert set(got) == {"zinc oxide", "aqua"}
    assert (got["zinc oxide"]["cas"], got["zinc oxide"]["synonyms"], got["aqua"]["cas"], got["aqua"]["synonyms"]) == ("1314-13-2", ["zinc, oxide"], None, ["water"])


def test_export_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("a", True, None, 1e-05), ('q"x', False, 2, 0.5)], "s string, b boolean, n int, d double")
    data, n = files.export_csv(rows.orderBy("s"), ["s", "b", "n", "d"])
    assert n == 2 and data == b'\xef\xbb\xbfs,b,n,d\r\na,True,,1e-05\r\n"q""x",False,2,0.5\r\n'
    (tmp_path / "r.csv").write_bytes(data)
    back = files.unmatched_csv(spark, str(tmp_path / "r.csv")).collect()
    assert [(r["s"], r["n"]) for r in back] == [("a", ""), ('q"x', "2")]
    with pytest.raises(ValueError):
        files.export_csv(rows, ["s"], limit=1)


def test_restore_whole_abstracts(spark, small, tmp_path):
    """Long, empty and null texts as well as those of the table."""
    from quillmill.plans.record_queries import proj_restore_abstract

    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    odd = [(-1, None), (-2, ""), (-3, " \n "), (-4, 'say "x" \\ y ' * 9_000)]
    docs.union(spark.createDataFrame(odd, "doc_id long, text string")).write.parquet(f"{tmp_path}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()} | dict(odd)
    assert sum(len(t or "") >= 3000 for t in texts.values()) > 10
    got = {r["doc_id"]: r["abstract"] for r in proj_restore_abstract(spark, str(tmp_path)).collect()}
    assert got == {k: " ".join(w for w in re.split("[ \n]+", t or "") if w) or None for k, t in texts.items()}


def plain_title(v):
    return " ".join(re.sub(r"[^\w\s]", " ", (v or "").lower()).split())


def test_title_similarity_of_all_titles(spark, small):
    """Every row by hand; long titles are among them."""
    from difflib import SequenceMatcher

    from quillmill.plans.evidence_queries import evd_title_similarity, title_pairs

    pairs = {r["id"]: (r["title"], r["other"]) for r in title_pairs(spark, small).collect()}
    assert max(len(a) for a, _ in pairs.values()) > 250 > 200 > min(len(a) for a, _ in pairs.values())
    got = {r["id"]: r["similarity"] for r in evd_title_similarity(spark, small).collect()}
    assert set(got) == set(pairs)
    for i, (a, b) in pairs.items():
        assert got[i] == pytest.approx(SequenceMatcher(None, plain_title(a), plain_title(b)).ratio()), i

def test_matching_chars_are_those_of_difflib():
    """Ties, short and long texts, frequent characters, repeats; and in less than two thirds of the time."""
    import random
    import time
    from difflib import SequenceMatcher

    dice, pairs = random.Random(1), []
    for n in range(1500):
        letters = ("ab", "abcdefgh xyz\u00e9\u6f22\U0001f600", "abcdefghijklmnopqrstuvwxyz0123456789    ")[n % 3]
        some = lambda most: "".join(dice.choices(letters, k=dice.randint(1, most)))  # noqa: B023, E731
        a, b = some(300 if n % 10 == 0 else 40), some(320 if n % 10 == 0 else 40)
        if n % 4 == 0:
            b = b[: len(b) // 2] + a[len(a) // 3 :] + b[len(b) // 2 :]
        pairs.append((a, b * 8 if n % 7 == 0 else b))
    assert sum(len(b) >= text.LONG_TEXT for _, b in pairs) > 100
    for a, b in pairs:
        assert text.similarity(a, b) == SequenceMatcher(None, a, b).ratio(), (a, b)

    words = "old small gear plate widget brand economy promo supplier 000000600 000000913".split()
    titles = [(" ".join(w := dice.choices(words, k=24)), " ".join(w[12:] + w[:11])) for _ in range(200)]
    titles = [(a, b[:190]) for a, b in titles]

    def spent(f):
        start = time.process_time()
        for a, b in titles:
            f(a, b)
        return time.process_time() - start

    assert min(spent(text.similarity) for _ in range(3)) < min(spent(lambda a, b: SequenceMatcher(None, a, b).ratio()) for _ in range(3)) / 1.5


def test_norm_title_is_that_of_python(spark):
    for v in ("  A\u00a0B -- c_d ", "\u2003x\u2003", "\u6f22-\u5b57!", "...", "\u0130 e\u0301"):
        assert one(spark, text.norm_title(F.col("v")), v) == one(spark, text.collapse(F.regexp_replace(F.lower("v"), r"(?U)[^\w\s]", " ")), v)


def test_whole_texts_are_normalised(spark, small):
    from quillmill.plans.record_queries import norm_name_key, norm_title

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    assert sum(len(t or "") > 60 for t in texts.values()) > 100
    assert {r["doc_id"]: r["title"] for r in norm_title(spark, small).collect()} == {k: plain_title(t) for k, t in texts.items()}
    assert {r["doc_id"]: r["name_key"] for r in norm_name_key(spark, small).collect()} == {k: " ".join((t or "").split()).casefold() for k, t in texts.items()}


def test_indexes_are_made_where_texts_lie(spark):
    """No word is shuffled, and rows that share an id stay rows of their own."""
    from quillmill.plans.record_queries import restored

    rows = [(1, "b a  b\n\nc"), (1, "x"), (2, None), (3, " \n "), (None, "é\t1 é")]
    made = restored(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, made.collect()), key=repr) == sorted([(1, "b a b c"), (1, "x"), (2, None), (3, None), (None, "é\t1 é")], key=repr)
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()


def test_lines_are_dealt_by_their_bytes(spark, tmp_path, monkeypatch):
    """Tasks that make lines distinct grow in number with the files; the first line of a key stays."""
    for name in ("a", "b"):
        (tmp_path / f"{name}.jsonl").write_text("".join(f'{{"id": "k{i}", "v": "{name}"}}\n' for i in range(500)), encoding="utf-8")
    monkeypatch.setattr(files, "TASK_BYTES", 1000)
    size = sum(p.stat().st_size for p in tmp_path.iterdir())
    rows = files.json_lines(spark, str(tmp_path), "id")
    assert rows.rdd.getNumPartitions() == -(-size // 1000) > 20
    assert {r["v"] for r in rows.select(records.at(F.col("v"), "$.v").alias("v")).collect()} == {"a"} and rows.count() == 500
