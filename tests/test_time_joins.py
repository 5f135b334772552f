"""As-of and interval joins, trailing windows and mergeable sketches against plain Python."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from quillmill.operators import asof, intervals, sketches, trailing

LEFT, RIGHT = "id int, k string, t long", "k string, t long, v int"


def latest(left, right, strict=False, within=None):
    found = []
    for i, k, t in left:
        fits = [(rt, v) for rk, rt, v in right if None not in (k, t, rt) and rk == k and (rt < t or (rt == t and not strict))]
        best = max(fits, key=lambda x: (x[0], x[1] is not None, x[1] or 0), default=None)
        found.append((i, best[1] if best and (within is None or t - best[0] <= within) else None))
    return sorted(found)


@pytest.mark.parametrize("most", [10**6, 20, 3])
@pytest.mark.parametrize("strict", [False, True])
def test_as_of(spark, most, strict):
    lot = random.Random(most)
    keys = ["hot"] * 8 + ["a", "b", None]
    left = [(i, lot.choice(keys), lot.choice([None, *range(60)])) for i in range(400)]
    right = [(lot.choice(keys), lot.choice([None, *range(60)]), lot.choice([None, 1, 2, 3])) for i in range(150)]
    a, b = spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT).withColumnRenamed("t", "rt")
    got = asof.as_of(a, b, ["k"], "t", "rt", strict=strict, most=most, slices=7)
    assert got.columns == ["id", "k", "t", "v"]
    assert sorted((r["id"], r["v"]) for r in got.collect()) == latest(left, right, strict)
    near = asof.as_of(a, b, ["k"], "t", "rt", strict=strict, within=F.lit(4), most=most, slices=7)
    assert sorted((r["id"], r["v"]) for r in near.collect()) == latest(left, right, strict, 4)
    assert asof.as_of(a.limit(0), b, ["k"], "t", "rt").count() == 0
    assert {r["v"] for r in asof.as_of(a, b.limit(0), ["k"], "t", "rt").collect()} == {None}
    with pytest.raises(ValueError, match="both sides"):
        asof.as_of(a.withColumn("v", F.lit(1)), b, ["k"], "t", "rt")


def test_a_hot_key_is_cut_by_time(spark):
    a = spark.range(5000).selectExpr("id", "'hot' as k", "id as t")
    b = spark.range(500).selectExpr("'hot' as k", "10 * id as rt", "id as v")
    got = asof.as_of(a, b, ["k"], "t", "rt", most=1000, slices=16)
    assert got.where("v <> floor(t / 10)").count() == 0 and got.count() == 5000
    assert "__slice" in got._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("most", [10**6, 5])
@pytest.mark.parametrize("closed", [False, True])
def test_points_in_intervals(spark, most, closed):
    lot = random.Random(most)
    points = [(i, lot.choice(["x", "y"]), lot.choice([None, 50, 50, 50, *range(0, 4000, 7)])) for i in range(300)]
    spans = []
    for j in range(80):
        s = lot.choice([None, *range(-100, 4000)])
        spans.append((j, lot.choice(["x", "y"]), s, None if s is None else s + lot.choice([-3, 0, 1, 7, 8, 64, 65, 1000, 5000])))
    p, q = spark.createDataFrame(points, "i int, g string, at long"), spark.createDataFrame(spans, "j int, h string, a long, b long")
    inside = lambda t, a, b: None not in (t, a, b) and a <= t and (t <= b if closed else t < b)
    want = sorted((i, j) for i, _, t in points for j, _, a, b in spans if inside(t, a, b))
    assert sorted((r["i"], r["j"]) for r in intervals.points_in(p, q, "at", "a", "b", closed=closed, most=most).collect()) == want
    both = sorted((i, j) for i, g, t in points for j, h, a, b in spans if inside(t, a, b) and g == h and i != j)
    got = intervals.points_in(p, q, "at", "a", "b", by=[("g", "h")], condition=F.col("i") != F.col("j"), closed=closed, width=8.0, most=most)
    assert sorted((r["i"], r["j"]) for r in got.collect()) == both
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert intervals.points_in(p, q.limit(0), "at", "a", "b").count() == 0


@pytest.mark.parametrize("most", [10**6, 40])
def test_sums_in_intervals_form_no_pairs(spark, most):
    lot = random.Random(most)
    odd = [None, float("nan"), float("inf"), float("-inf")]
    points = [(lot.choice(["x", "y", "z", None]), lot.choice([None, 50, 50, *range(0, 4000, 7)]), lot.choice([*range(60), *odd[: 1 + i // 200]]) if i > 150 else float(i)) for i in range(500)]
    points = [(g, t, None if v is None else float(v)) for g, t, v in points]
    spans = []
    for j in range(80):
        s = lot.choice([None, *range(-100, 4000)])
        spans.append((j, s, None if s is None else s + lot.choice([-3, 0, 1, 8, 64, 300, 1000, 5000])))
    p, q = spark.createDataFrame(points, "g string, at long, v double"), spark.createDataFrame(spans, "j int, a long, b long")
    want = {}
    for j, a, b in spans:
        inside = [(g, v) for g, t, v in points if None not in (g, t, a) and a <= t < b]
        if inside:
            values = [v for _, v in inside if v is not None]
            want[j] = (len(inside), len({g for g, _ in inside}), str(round(sum(values), 6)) if values else "None")
    found = intervals.sums_in(p, q, "at", "a", "b", "g", "v", most=most)
    amount = intervals.amount({n: F.col(n) for n in intervals.AMOUNTS})
    got = {r["j"]: (r["n"], r["keys"], str(r["t"] if r["t"] is None else round(r["t"], 6))) for r in found.select("j", "n", "keys", amount.alias("t")).collect()}
    assert got == want
    assert intervals.sums_in(p.limit(0), q, "at", "a", "b", "g", "v").count() == 0
    assert intervals.sums_in(p, q.limit(0), "at", "a", "b", "g", "v").count() == 0


def test_the_interval_query_joins_no_events_to_sessions(spark, small):
    """Its pairs would grow with the square of the events."""
    from quillmill.plans.join_queries import join_interval

    plan = join_interval(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "tally_slice" in plan and "__bin" not in plan


def test_trailing_by_hand(spark):
    """A term with a gap of eleven months, in a collection that lacks a month."""
    months = [f"20{y:02d}-{m:02d}" for y in range(20, 24) for m in range(1, 13) if (y, m) != (21, 5)]
    denominator = spark.createDataFrame([(m, "q", 100, False, False) for m in months], "month_bucket string, query_id string, paper_count long, is_low_sample boolean, is_provisional boolean")
    rows = [("2020-03", 5), ("2021-03", 10), ("2023-12", 1)]
    monthly = spark.createDataFrame([(m, "q", "t", "t", "", False, n, n / 100) for m, n in rows], "month_bucket string, query_id string, keyword_key string, canonical_en string, category string, is_in_lexicon boolean, paper_count long, prevalence double")
    got = {r["month_bucket"]: r for r in trailing.trailing(monthly, denominator, recent=12, prior=12).collect()}
    assert len(got) == 46 and min(got) == "2020-03" and "2021-05" in got
    assert (got["2021-02"]["papers_trailing"], got["2021-02"]["prevalence_trailing"]) == (5, round(0.05 / 12, 6))
    assert (got["2021-03"]["papers_trailing"], got["2021-03"]["growth_ratio"]) == (10, round((0.1 / 12) / (0.05 / 3), 4))
    assert got["2021-05"]["paper_count"] == 0 and got["2021-06"]["papers_window"] == 1100
    assert got["2021-06"]["prevalence_trailing"] == round(0.1 / 11, 6)
    assert got["2022-12"]["prevalence_trailing"] == 0 and got["2023-12"]["growth_ratio"] is None
    plan = trailing.trailing(monthly, denominator)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan


def test_sketches_merge_as_if_read_at_once(spark):
    records = spark.range(20_000).selectExpr("if(id % 50 = 0, null, date_format(add_months(date'2020-01-01', cast(id % 12 as int)), 'yyyy-MM')) as month_bucket", "concat('w', id % 3000) as word", "id % 997 as n")
    months = sketches.by_month(records, "word", "n")
    assert months.count() == 12
    spans = spark.createDataFrame([("2020-01", "2020-12"), ("2020-03", "2020-05"), ("2021-01", "2021-02")], "first string, last string")
    got = {r["first"]: r for r in sketches.merged(months, spans).collect()}
    assert set(got) == {"2020-01", "2020-03"}  # a span without months has no row
    whole = records.where("month_bucket is not null")
    exact = whole.selectExpr("count(*) n", "count(distinct word) d", "percentile_disc(0.5) within group (order by n) m").first()
    assert got["2020-01"]["n"] == exact["n"] and abs(got["2020-01"]["n_distinct"] / exact["d"] - 1) <= sketches.DISTINCT_BOUND
    assert abs(got["2020-01"]["p50"] - exact["m"]) <= 997 * sketches.RANK_BOUND
