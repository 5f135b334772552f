"""Versioned tables: what an upsert touches, what readers see, and what writers do to each other."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quillmill.operators import merge
from quillmill.sources import files, schema
from quillmill.sources.versioned import Conflict, Manifest, VersionedTable

KIND = "k string, v int, seq long"


def replaced(old, new):
    return merge.overwrite(old, new, ["k"])


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_an_upsert_touches_only_its_buckets(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"), ["k"], buckets=8)
    assert table.read() is None and not table.exists()
    first = spark.range(200).selectExpr("concat('k', id) as k", "cast(id as int) as v", "id as seq")
    assert table.upsert(first, replaced, ("seq",)) == 1
    before = table.manifest()
    assert len(before.parts) == 8 and table.read().columns == ["k", "v"]
    seen = table.read()  # a reader that opened version 1
    change = spark.createDataFrame([("k5", -5, 1), ("k5", -6, 2)], KIND)
    asked = []

    def watched(old, new):
        asked.extend(old.inputFiles())
        return replaced(old, new)

    assert table.upsert(change, watched, ("seq",)) == 2
    after = table.manifest()
    changed = [b for b in after.parts if after.parts[b] != before.parts[b]]
    assert len(changed) == 1 and asked and all(before.parts[changed[0]] in f for f in asked)
    assert dict(rows(table.read()))["k5"] == -6 and table.read().count() == 200
    assert dict(rows(seen))["k5"] == 5 and dict(rows(table.read(1)))["k5"] == 5
    assert table.upsert(change.limit(0), replaced, ("seq",)) == 3 and table.read().count() == 200
    with pytest.raises(ValueError, match="no version"):
        table.read(9)
    with pytest.raises(ValueError, match="keyed by"):
        VersionedTable(spark, table.path, ["v"]).upsert(change, replaced, ("seq",))


def test_a_failed_write_changes_nothing(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"), ["k"], buckets=4)
    table.upsert(spark.createDataFrame([("a", 1, 1)], KIND), replaced, ("seq",))

    def broken(old, new):
        return replaced(old, new).withColumn("v", F.raise_error(F.lit("no")).cast("int"))

    with pytest.raises(Exception, match="no"):
        table.upsert(spark.createDataFrame([("a", 2, 1)], KIND), broken, ("seq",))
    assert rows(table.read()) == [("a", 1)] and table.versions() == [1]


def test_two_writers(spark, tmp_path):
    """The second of two writers starts over on what the first has written."""
    table = VersionedTable(spark, str(tmp_path / "t"), ["k"], buckets=2)
    table.upsert(spark.createDataFrame([("a", 1, 1)], KIND), replaced, ("seq",))
    tries = []

    def late(old, new):
        tries.append(1)
        if len(tries) == 1:
            table.upsert(spark.createDataFrame([("a", 2, 1), ("b", 3, 1)], KIND), replaced, ("seq",))
        return old.unionByName(new.drop("seq")).groupBy("k").agg(F.sum("v").cast("int").alias("v"))

    assert table.upsert(spark.createDataFrame([("a", 10, 1)], KIND), late, ("seq",)) == 3
    assert len(tries) == 2 and rows(table.read()) == [("a", 12), ("b", 3)]
    taken = table.manifest()
    with pytest.raises(Conflict):
        table.publish(Manifest(3, ["k"], 2, taken.schema, {}))
    assert rows(table.read()) == [("a", 12), ("b", 3)]


def test_columns_come_and_go(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "papers"), ["key"], buckets=4)
    keep = lambda old, new: merge.merge_papers(old, new, ["score"])
    base, _ = schema.migrate(spark.createDataFrame([("a", "A"), ("b", "B")], "key string, title string"), 0, schema.PAPER_STEPS[:1])
    table.upsert(base, keep)
    table.upsert(spark.createDataFrame([("a", ["zinc"], 7)], "key string, mesh_terms array<string>, score int"), keep)
    got = {r["key"]: r for r in table.read().collect()}
    assert (got["a"]["title"], got["a"]["mesh_terms"], got["a"]["score"]) == ("A", ["zinc"], 7)
    assert (got["b"]["title"], got["b"]["mesh_terms"], got["b"]["score"]) == ("B", None, None)
    with pytest.raises(ValueError, match="score was int"):
        table.upsert(spark.createDataFrame([("a", "x")], "key string, score string"), keep)


def test_a_plain_folder_becomes_a_table(spark, tmp_path):
    path = str(tmp_path / "old")
    spark.createDataFrame([("a", 1), (None, 2)], "k string, v int").write.parquet(path)
    table = VersionedTable(spark, path, ["k"], buckets=4)
    assert table.read().count() == 2
    table.upsert(spark.createDataFrame([("c", 3, 1)], KIND), replaced, ("seq",))
    assert rows(table.read()) == [("", 2), ("a", 1), ("c", 3)]


def test_vacuum(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"), ["k"], buckets=2)
    for v in range(4):
        table.upsert(spark.createDataFrame([("a", v, 1)], KIND), replaced, ("seq",))
    assert table.vacuum(keep=1) >= 3 and table.versions() == [4]
    assert rows(table.read()) == [("a", 3)] and len(files.names(spark, f"{table.path}/_data")) == 1
