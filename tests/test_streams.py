"""State that lets go, and windows that lose nothing."""

from __future__ import annotations

import json
import time

import pytest
from pyspark.sql import functions as F

from quillmill.streaming import late, seen

KIND = "id string, ts timestamp, v int"


def arrive(spark, folder, name, rows):
    """Rows of (id, minutes, v) as the next file of a stream."""
    spark.createDataFrame(rows, "id string, m double, v int").selectExpr("id", "timestamp_seconds(86400000 + m * 60) as ts", "v").coalesce(1).write.parquet(f"{folder}/{name}")
    time.sleep(0.05)


def stream_of(spark, folder):
    return spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(folder)


def progress(run):
    run.awaitTermination()
    return [p if isinstance(p, dict) else json.loads(p.json) for p in run.recentProgress]


def test_old_keys_leave_the_state(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    for day in range(5):
        arrive(spark, folder, f"{day}", [(f"{day}-{k % 10}", day * 1440.0 + k, k) for k in range(40)])
    done = progress(seen.collect_first(stream_of(spark, folder), out, str(tmp_path / "a"), "id", "ts", "2 hours"))
    kept = [p["stateOperators"][0]["numRowsTotal"] for p in done if p["stateOperators"]]
    # a key has a value and a timer with two entries; 50 keys would be more than twice as much
    assert max(kept) <= 2 * 10 * 3 and kept[-1] <= 10 * 3
    rows = {r["id"]: r["v"] for r in seen.collected(spark, out, stream_of(spark, folder).schema).collect()}
    assert rows == {f"{d}-{k}": k for d in range(5) for k in range(10)}

    # late copies of keys that have left are refused, and so are copies in time
    arrive(spark, folder, "5", [("0-3", 3.0, 99), ("4-3", 4 * 1440.0 + 50, 99), ("new", 4 * 1440.0 + 51, 1), (None, 4 * 1440.0, 7)])
    seen.collect_first(stream_of(spark, folder), out, str(tmp_path / "a"), "id", "ts", "2 hours").awaitTermination()
    again = seen.collected(spark, out, stream_of(spark, folder).schema)
    assert again.count() == 51 and again.where("v = 99 or id is null").count() == 0

    # a lost checkpoint: what is stored is the state, nothing is there twice
    arrive(spark, folder, "6", [("last", 5 * 1440.0, 2), ("new", 4 * 1440.0 + 51, 5)])
    seen.collect_first(stream_of(spark, folder), out, str(tmp_path / "b"), "id", "ts", "2 hours").awaitTermination()
    final = seen.collected(spark, out, stream_of(spark, folder).schema)
    assert final.count() == final.select("id").distinct().count() == 52
    assert final.where("id = 'new'").first()["v"] == 1


@pytest.mark.parametrize("sessions", [False, True])
def test_windows_and_late_rows_make_all_events(spark, tmp_path, sessions):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    arrive(spark, folder, "0", [("a", 0.0, 1), ("a", 20.0, 2), ("b", 50.0, 3), ("a", 300.0, 4)])
    arrive(spark, folder, "1", [("a", 10.0, 5), ("a", 230.0, 6), ("b", 290.0, 7), ("b", 301.0, 8)])
    stream = stream_of(spark, folder).withColumn("value", F.col("v").cast("double"))
    of = late.Windows("60 minutes", "id", sessions=sessions)
    late.collect_windows(stream, out, str(tmp_path / "state"), of).awaitTermination()
    whole, behind = late.windows_of(spark, out, stream, of), late.late_of(spark, out, stream)
    assert sorted(r["v"] for r in behind.collect()) == [5, 6]  # the mark is at 240: behind it, and in a window that ends there
    assert whole.agg(F.sum("n")).first()[0] + behind.count() == 8
    minutes = lambda r: (r["id"], int(r["start"].timestamp() // 60) - 1_440_000, r["n"], r["total"])
    got = sorted(minutes(r) for r in whole.collect())
    if sessions:
        assert got == [("a", 0, 2, 3.0), ("a", 300, 1, 4.0), ("b", 50, 1, 3.0), ("b", 290, 2, 15.0)]
    else:
        assert got == [("a", 0, 2, 3.0), ("a", 300, 1, 4.0), ("b", 0, 1, 3.0), ("b", 240, 1, 7.0), ("b", 300, 1, 8.0)]
    assert late.windows_of(spark, out, stream, of, flush=False).count() < len(got)

    # a further run takes the open windows up again; one that is taken twice replaces its tables
    arrive(spark, folder, "2", [("b", 340.0, 9), ("a", 900.0, 1)])
    late.collect_windows(stream, out, str(tmp_path / "state"), of).awaitTermination()
    late.collect_windows(stream, out, str(tmp_path / "state"), of).awaitTermination()
    more = sorted(minutes(r) for r in late.windows_of(spark, out, stream, of).collect())
    assert sum(r[2] for r in more) + late.late_of(spark, out, stream).count() == 10
    assert (("b", 290, 3, 24.0) if sessions else ("b", 300, 2, 17.0)) in more
    spark.createDataFrame([("c", 1)], "id string, v int").selectExpr("id", "cast(null as timestamp) as ts", "v").write.parquet(f"{folder}/3")
    late.collect_windows(stream, out, str(tmp_path / "state"), of).awaitTermination()
    assert late.late_of(spark, out, stream).where("id = 'c'").count() == 1
