"""Worked values of the trend analytics."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quillmill.functions import dates, text
from quillmill.operators import lexicon, suggest, trend, vocabulary


def records(spark, months):
    rows = [(f"{m}-{i}", m, "q", c) for m, cs in months.items() for i, c in enumerate(cs)]
    return spark.createDataFrame(rows, "id string, month_bucket string, query_id string, citation_count long")


@pytest.mark.parametrize(
    ("citations", "want"),
    [([5], [0.5]), ([0, 10, 100], [1 / 6, 1 / 2, 5 / 6]), ([7, 7, 7, 7], [0.5] * 4), ([0, 0, 0, 50], [3 / 8] * 3 + [7 / 8]), ([0, 0, 3, 9], [0.25, 0.25, 0.625, 0.875])],
)
def test_midrank(spark, citations, want):
    got = trend.cohort_weights(records(spark, {"2024-01": citations})).orderBy("citation_count").collect()
    assert [r["citation_percentile_in_cohort"] for r in got] == pytest.approx(want)
    assert {r["cohort_size"] for r in got} == {len(citations)}


def test_midrank_is_per_month_and_null_month_has_no_share(spark):
    rows = records(spark, {"2024-01": [100, 0], "2026-08": [3]}).unionByName(records(spark, {"x": [1, 2]}).withColumn("month_bucket", F.lit(None).cast("string")))
    got = {(r["month_bucket"], r["citation_count"]): (r["citation_percentile_in_cohort"], r["cohort_size"]) for r in trend.cohort_weights(rows).collect()}
    assert got == {("2024-01", 100): (0.75, 2), ("2024-01", 0): (0.25, 2), ("2026-08", 3): (0.5, 1), (None, 1): (None, 2), (None, 2): (None, 2)}


@pytest.mark.parametrize(
    ("total", "present", "observed", "growth", "new", "want"),
    [
        (9, 4, 36, 3.0, False, "unrated"),
        (200, 30, 36, 2.0, False, "emerging"),
        (200, 5, 36, 2.0, False, "sporadic"),
        (200, 30, 36, 1.0, False, "steady"),
        (200, 30, 36, 0.4, False, "declining"),
        (200, 10, 36, 1.0, False, "sporadic"),
        (40, 10, 36, None, True, "emerging"),
        (40, 2, 36, None, True, "sporadic"),
        (200, 30, 36, None, False, "unrated"),
    ],
)
def test_classify(spark, total, present, observed, growth, new, want):
    row = spark.range(1).select(trend.classify(F.lit(total), F.lit(present), F.lit(observed), F.lit(growth).cast("double"), F.lit(new)).alias("c"))
    assert row.first()["c"] == want


CURATED = {
    "ZINC_OXIDE": {"canonical_en": "zinc oxide", "aliases": ["zno", "zinc-oxide", "nano-zno"], "category": "uv_filter"},
    "TITANIUM_DIOXIDE": {"canonical_en": "titanium dioxide", "aliases": ["tio2", "titania"], "category": "uv_filter"},
    "NIACINAMIDE": {"canonical_en": "niacinamide", "aliases": ["niacinamides"], "category": "ingredient"},
    "DERMATOLOGY": {"canonical_en": "dermatology", "aliases": [], "category": "field"},
    "_note": {"canonical_en": "a comment"},
}


def resolved(spark, terms, stop=("Chemistry", "dermatology")):
    rows = spark.createDataFrame([(i, [t]) for i, t in enumerate(terms)], "id int, keywords array<string>")
    got = lexicon.record_terms(rows, "keywords", lexicon.alias_table(spark, CURATED), lexicon.stopword_table(spark, list(stop)), keep=["id"])
    return {terms[r["id"]]: (r["keyword_key"], r["is_in_lexicon"]) for r in got.collect()}


def test_resolve(spark):
    got = resolved(spark, ["ZnO", "nano_ZnO", "TiO₂", "Chemistry", "nicotinamide", "  ", "Dermatology", "Zinc/Oxide"])
    assert got == {
        "ZnO": ("ZINC_OXIDE", True),
        "nano_ZnO": ("ZINC_OXIDE", True),
        "TiO₂": ("TITANIUM_DIOXIDE", True),
        "nicotinamide": ("nicotinamide", False),
        "Dermatology": ("DERMATOLOGY", True),  # the lexicon wins over a stopword
        "Zinc/Oxide": ("ZINC_OXIDE", True),
    }


def test_forms_of_a_key_count_once(spark):
    rows = spark.createDataFrame([(1, ["ZnO", "zinc oxide", "nano-ZnO"])], "id int, keywords array<string>")
    got = lexicon.record_terms(rows, "keywords", lexicon.alias_table(spark, CURATED), lexicon.stopword_table(spark, []), keep=["id"])
    assert got.count() == 1


def test_clashing_forms_are_an_error():
    with pytest.raises(lexicon.LexiconError, match="shared"):
        lexicon.alias_rows({"A": {"aliases": ["Shared"]}, "B": {"aliases": ["shared"]}}, lexicon.plain_norm_term)


def test_norm_term_agrees_with_plain_python(spark):
    terms = ["", None, " TiO₂ ", "a--b__c//d", "Ａｂ c", "ﬁ　x"]
    rows = spark.createDataFrame([(t,) for t in terms], "t string").select("t", text.norm_term(F.col("t")).alias("n")).collect()
    assert [r["n"] for r in rows] == [lexicon.plain_norm_term(t) for t in terms]


@pytest.mark.parametrize(
    ("term", "key"),
    [("TiO₂", "TITANIUM_DIOXIDE"), ("Cu/Zn-SOD", "SUPEROXIDE_DISMUTASE"), ("nicotinamide", "NICOTINAMIDE"), ("Niacinamide", "NIACINAMIDE"), ("UV-B", "UVB"), ("Reef-Safe", "CORAL_TOXICITY"), ("Chemistry", None), ("snail mucin", "snail mucin")],
)
def test_default_vocabulary(spark, term, key):
    rows = spark.createDataFrame([(1, [term])], "id int, keywords array<string>")
    got = lexicon.record_terms(rows, "keywords", lexicon.alias_table(spark, vocabulary.lexicon()), lexicon.stopword_table(spark, vocabulary.stopwords()), keep=["id"]).collect()
    assert [r["keyword_key"] for r in got] == ([key] if key else [])
    assert len(vocabulary.lexicon()) == 32 and len(vocabulary.stopwords()) == 52


def months(first, n):
    y, m = map(int, first.split("-"))
    return [f"{(y * 12 + m - 1 + i) // 12:04d}-{(y * 12 + m - 1 + i) % 12 + 1:02d}" for i in range(n)]


def test_metrics_reach_every_class(spark):
    """36 months of 100 works; each term has its own number of works per month."""
    all_months = months("2023-09", 36)
    prior, recent = all_months[:24], all_months[24:]
    plan = {
        "rising": {**dict.fromkeys(prior, 5), **dict.fromkeys(recent, 10)},
        "falling": {**dict.fromkeys(prior, 10), **dict.fromkeys(recent, 3)},
        "level": dict.fromkeys(all_months, 5),
        "rare": dict.fromkeys(prior[::6] + recent[::6], 4),
        "new": dict.fromkeys(recent, 2),
        "tiny": {all_months[0]: 2},
    }
    denominator = spark.createDataFrame([(m, "q", 100, False, m == all_months[-1]) for m in all_months], "month_bucket string, query_id string, paper_count long, is_low_sample boolean, is_provisional boolean")
    rows = [(m, "q", k, k, "", False, n, 100, n / 100, 0.5) for k, per in plan.items() for m, n in per.items()]
    monthly = spark.createDataFrame(rows, "month_bucket string, query_id string, keyword_key string, canonical_en string, category string, is_in_lexicon boolean, paper_count long, total_papers long, prevalence double, weighted_prevalence double")
    got = {r["keyword_key"]: r for r in trend.trend_metrics(monthly, denominator).collect()}
    assert {k: r["trend_class"] for k, r in got.items()} == {"rising": "emerging", "falling": "declining", "level": "steady", "rare": "sporadic", "new": "emerging", "tiny": "unrated"}
    assert got["new"]["is_new_entrant"] and got["new"]["growth_ratio"] is None
    assert got["rising"]["growth_ratio"] == 2.0 and got["rising"]["prevalence_recent"] == 0.1
    assert got["level"]["months_observed"] == 36 and got["tiny"]["prevalence_recent"] == 0.0


def test_metrics_of_provisional_months_only_have_no_growth(spark):
    denominator = spark.createDataFrame([("2024-01", "q", 5, True, True)], "month_bucket string, query_id string, paper_count long, is_low_sample boolean, is_provisional boolean")
    monthly = spark.createDataFrame([("2024-01", "q", "k", "k", "", False, 5, 5, 1.0, 0.5)], "month_bucket string, query_id string, keyword_key string, canonical_en string, category string, is_in_lexicon boolean, paper_count long, total_papers long, prevalence double, weighted_prevalence double")
    row = trend.trend_metrics(monthly, denominator).first()
    assert (row["prevalence_recent"], row["growth_ratio"], row["trend_class"]) == (None, None, "unrated")


def test_overlap(spark):
    a = spark.createDataFrame([("2024-01", "10.1/a"), ("2024-01", "10.1/b"), ("2024-01", None), ("2024-03", "x")], "month_bucket string, doi string")
    b = spark.createDataFrame([("2024-01", "10.1/a"), ("2024-01", "10.1/c"), ("2024-01", ""), ("2024-02", "x")], "month_bucket string, doi string")
    got = {r["month_bucket"]: tuple(r)[1:] for r in trend.overlap(a, b).collect()}
    assert got == {"2024-01": (3, 3, 1, 1, 1, 1), "2024-02": (0, 1, 0, 0, 1, 0), "2024-03": (1, 0, 0, 1, 0, 0)}


def test_mesh(spark):
    rows = [("1", "2024-01", ["Sunscreening Agents", "sunscreening agents "]), ("2", "2024-01", ["Sunscreening Agents"]), ("3", "2024-01", []), ("4", "2024-02", None), ("5", "2024-02", ["Skin"])]
    got = {(r["month_bucket"], r["mesh_term"]): r for r in trend.mesh_monthly(spark.createDataFrame(rows, "pmid string, month_bucket string, mesh_terms array<string>"), threshold=3, provisional=["2024-02"]).collect()}
    first = got["2024-01", "sunscreening agents"]
    assert (first["paper_count"], first["total_papers"], first["prevalence"], first["is_low_sample"], first["is_provisional"]) == (2, 3, 0.666667, False, False)
    assert got["2024-02", "skin"]["is_low_sample"] and got["2024-02", "skin"]["is_provisional"]


def test_unmatched_keeps_input_order_and_works_without_a_month(spark):
    rows = [(3, "b", None, "third", False), (1, "b", "2024-02", " first ", False), (2, "b", "2024-01", "", False), (4, "a", "2024-01", "x" * 200, False), (5, "LEX", "2024-01", "t", True)]
    terms = spark.createDataFrame(rows, "ord int, keyword_key string, month_bucket string, title string, is_in_lexicon boolean")
    got = [tuple(r) for r in trend.unmatched(terms).orderBy("rank").collect()]
    assert got[0] == (1, "b", 3, "2024-01", "2024-02", 2, "first", "third", "", "")
    assert got[1][:3] == (2, "a", 1) and len(got[1][6]) == 140
    assert trend.unmatched(terms, top=1).count() == 1


def test_suggestions_first_candidate_wins(spark):
    ingredients = spark.createDataFrame(
        [("zinc oxide", "Zinc Oxide", "1314-13-2", ["ZnO", "shared name"], ["pubchem", "cosing"]), ("aaa", "Shared-Name", None, [], ["cosing"])],
        "name_key string, inci_name string, cas string, synonyms array<string>, sources array<string>",
    )
    unmatched = spark.createDataFrame([("zno", "7"), ("shared name", "x"), ("zinc-oxide", "9"), ("none", "1")], "term string, paper_count string")
    got = {r["term"]: r for r in suggest.suggestions(unmatched, ingredients, ["ZINC_OXIDE"]).collect()}
    assert set(got) == {"zno", "shared name", "zinc-oxide"}
    assert (got["zno"]["matched_via"], got["zno"]["paper_count"], got["zno"]["sources"]) == ("synonym:ZnO", 7, "pubchem, cosing")
    assert got["zno"]["suggested_key"].startswith("ZINC_OXIDE (")
    assert (got["shared name"]["matched_via"], got["shared name"]["suggested_key"], got["shared name"]["paper_count"]) == ("inci_name", "AAA", 0)
    assert got["zinc-oxide"]["matched_via"] == "name_key"


def test_census_guard():
    assert trend.census_guard({"is_census": True}) is None
    with pytest.raises(trend.CensusError):
        trend.census_guard({})
    assert "not a census" in trend.census_guard({"collected": 3}, allow_sample=True)


@pytest.mark.parametrize(
    ("value", "fallback", "want"),
    [
        ("2024-03-15", None, ("2024-03", "day", 2024)),
        ("2024-3-5", None, ("2024-03", "day", 2024)),
        ("2024-02-30", None, ("2024-02", "month", 2024)),
        ("2024-03", None, ("2024-03", "month", 2024)),
        ("2024", None, (None, "year_only", 2024)),
        (None, 2023, (None, "year_only", 2023)),
        ("garbage", None, (None, "unknown", None)),
        (None, None, (None, "unknown", None)),
    ],
)
def test_parse_date(spark, value, fallback, want):
    row = spark.range(1).select(dates.parse_date(F.lit(value).cast("string"), F.lit(fallback).cast("int")).alias("d")).first()["d"]
    assert tuple(row) == want


def test_rounding(spark):
    values = [(1 / 128, 6, 0.007812), (0.125, 2, 0.12), (2.675, 2, 2.67), (1.0000005, 6, round(1.0000005, 6)), (None, 2, None)]
    rows = spark.createDataFrame([(v, d) for v, d, _ in values], "v double, d int").select(text.exact_round("v", "d").alias("r")).collect()
    assert [r["r"] for r in rows] == [w for *_, w in values]
    assert spark.range(1).select(trend.rounded(F.lit(0.0021674999999999998), 6).alias("r")).first()["r"] == 0.002168


def test_citations_per_year(spark):
    row = spark.range(1).select(dates.citation_per_year(F.lit(10), F.lit("2026-08-19"), F.lit("2026-08-20")).alias("c"), dates.citation_per_year(F.lit(10), F.lit("2026"), F.lit("2026-08-20")).alias("n")).first()
    assert (row["c"], row["n"]) == (20.0, None)


def test_tasks_hold_no_more_as_lines_grow(spark, small, monkeypatch):
    """Records are dealt by number, so adaptive execution joins no tasks; frequent terms gather nowhere."""
    from quillmill import session
    from quillmill.plans.relations import resolved_terms, works_monthly

    monkeypatch.setattr(session, "TASK_ROWS", 300)
    tasks = -(-spark.read.parquet(f"{small}/lineitem.parquet").count() // 300)
    found = resolved_terms(spark, small, "topic")
    held = [r["count"] for r in found.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert tasks >= 20 and len(held) == tasks and max(held) <= 600
    assert works_monthly(spark, small, "topic").rdd.getNumPartitions() == tasks
