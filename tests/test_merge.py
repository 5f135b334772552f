"""Upserts, schema steps and evidence scores."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quillmill.operators import evidence, merge
from quillmill.sources import schema

INGREDIENT = "name_key string, cas string, synonyms array<string>"


def test_merge_keeps_scalars_and_joins_lists_in_order(spark):
    old = spark.createDataFrame([("zinc", "1", ["a", "b"]), ("kept", "9", None)], INGREDIENT)
    new = spark.createDataFrame([("zinc", " ", ["c", "a"], 1), ("zinc", "2", ["d"], 2), ("zinc", None, [], 3), (None, "7", ["x"], 4)], INGREDIENT + ", seq long")
    got = {r["name_key"]: tuple(r)[1:] for r in merge.merge_table("ingredient", old, new).collect()}
    assert got == {"zinc": ("2", ["a", "b", "c", "d"]), "kept": ("9", []), "": ("7", ["x"])}


def test_overwrite_replaces_all_columns(spark):
    old = spark.createDataFrame([("d", "", "old"), ("e", "x", "old")], "doi string, retraction_doi string, note string")
    new = spark.createDataFrame([("d", None, None, 2), ("d", "", "early", 1)], "doi string, retraction_doi string, note string, seq long")
    got = {(r["doi"], r["retraction_doi"]): r["note"] for r in merge.merge_table("retraction", old, new).collect()}
    assert got == {("d", ""): None, ("e", "x"): "old"}


def test_unknown_table_and_policy():
    with pytest.raises(KeyError):
        merge.merge_table("nothing", None, None)
    with pytest.raises(ValueError, match="policy"):
        merge.merge(None, None, ["k"], policy="append")


def test_papers_merge(spark):
    kinds = "key string, title string, keywords array<string>, score int"
    old = spark.createDataFrame([("a", "old", ["k"], 90), ("b", "b", None, 5)], kinds)
    new = spark.createDataFrame([("a", "", [], None), ("c", "c", ["z"], 10)], kinds)
    got = {r["key"]: tuple(r)[1:] for r in merge.merge_papers(old, new, ["score"]).collect()}
    assert got == {"a": ("old", ["k"], None), "b": ("b", None, 5), "c": ("c", ["z"], 10)}


def test_papers_merge_with_other_columns(spark):
    """An older table lacks what new rows have, and has what they lack."""
    old = spark.createDataFrame([("a", "old", "kept")], "key string, title string, tldr string")
    new = spark.createDataFrame([("a", None, ["zinc"], 5)], "key string, title string, mesh_terms array<string>, score int")
    assert [tuple(r) for r in merge.merge_papers(old, new, ["score"]).collect()] == [("a", "old", "kept", ["zinc"], 5)]


def test_a_stored_null_is_no_miss(spark):
    cache = merge.cache_put(spark.createDataFrame([], "source string, key string, response string"), spark.createDataFrame([("s", "a", None, 1), ("s", "", "x", 2)], "source string, key string, response string, seq long"))
    assert [tuple(r) for r in cache.collect()] == [("s", "a", None)]
    wanted = spark.createDataFrame([("s", "a"), ("s", "b")], "source string, key string")
    assert [r["key"] for r in merge.cache_misses(wanted, cache).collect()] == ["b"]


def test_migrations(spark):
    base, version = schema.migrate(spark.createDataFrame([("k",)], "key string"), 0, schema.PAPER_STEPS[:2])
    assert version == 2 and "evidence" not in base.columns
    full, version = schema.migrate(base, version, schema.PAPER_STEPS)
    assert version == len(schema.PAPER_STEPS) and full.schema["mesh_terms"].dataType.typeName() == "array"
    assert schema.migrate(full, version, schema.PAPER_STEPS)[0].columns == full.columns
    with pytest.raises(ValueError):
        schema.migrate(full, 99, schema.PAPER_STEPS)


@pytest.mark.parametrize(
    ("crossref", "match", "extra", "abstract", "gone", "want"),
    [
        (True, True, 1, "x", False, 85),
        (False, False, 0, "x", False, 15),
        (False, False, 0, None, False, 5),
        (True, True, 3, "x", False, 100),
        (True, True, 0, "", False, 60),
        (True, True, 2, "x", True, 0),
        (False, False, 1, "x", False, 30),
        (True, False, 0, "x", False, 45),
        (True, True, 2, "x", False, 100),
    ],
)
def test_score(spark, crossref, match, extra, abstract, gone, want):
    c = evidence.score(F.lit(crossref), F.lit(match), F.lit(extra), F.lit(abstract).cast("string"), F.lit(gone))
    assert spark.range(1).select(c.alias("s")).first()["s"] == want


def test_search_takes_text_literally(spark):
    rows = [("a", "50% zinc", None, [], 80, False, 2020), ("b", "zinc", "É", ["x_y"], 70, False, None), ("c", "zinc", None, None, 90, True, 2021)]
    papers = spark.createDataFrame(rows, "key string, title string, abstract string, keywords array<string>, confidence_score int, is_retracted boolean, year int")
    keys = lambda *a, **k: [r["key"] for r in evidence.search(papers, *a, **k).collect()]
    assert keys("0% Z") == ["a"] and keys("é") == ["b"] and keys("X_") == ["b"] and keys("_") == ["b"]
    assert keys("zinc") == ["a", "b"] and keys("zinc", with_retracted=True) == ["c", "a", "b"]
    assert keys("zinc", least=75) == ["a"] and keys("zinc", limit=1) == ["a"] and keys("zinc", limit=0) == ["a", "b"]
    assert keys("z%c", wildcards=True) == ["a", "b"]
