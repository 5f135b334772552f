"""Operator 12 against integers of any size and plain numpy."""

from __future__ import annotations

from fractions import Fraction
from math import floor, isfinite

import duckdb
import numpy as np
import pytest

from quillmill.llm import whitening as w

VECTORS = "vec_id long, embedding array<double>, component string, __vector string"


def plainly(rows):
    """From (id, vector): n, sums, deviations, eigenvalues, axes and trace, of vectors of the usual length."""
    fine = [(i, [floor(256 * c) for c in v]) for i, v in rows if v and all(c is not None and isfinite(c) for c in v)]
    lists = sorted({tuple(x) for _, x in fine})
    n, dim = len(lists), len(lists[0])
    sums = [sum(x[k] for x in lists) for k in range(dim)]
    mean = [Fraction(s, n) for s in sums]
    centred = np.array([[float(x[k] - mean[k]) for k in range(dim)] for x in lists])
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    deviation = [(i, sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True))) for i, x in fine]
    projected = np.array([[float(a - m) for a, m in zip(x, mean, strict=True)] for _, x in fine]) @ axes[:, ::-1]
    return n, deviation, values[::-1], projected, values.sum()


def agree(found, rows):
    n, deviation, values, projected, trace = plainly(rows)
    some = min(4, int((values > values[0] * 1e-9).sum()))
    assert len(found) == some * len(deviation)
    for k in range(some):
        of = sorted((r for r in found if r["component"] == k + 1), key=lambda r: r["vec_id"])
        order = sorted(range(len(deviation)), key=lambda i: deviation[i][0])
        assert [(r["vec_id"], int(r["deviation"])) for r in of] == [deviation[i] for i in order]
        want = projected[order, k] / np.sqrt(values[k])
        got = np.array([r["whitened"] for r in of])
        assert min(np.abs(got - want).max(), np.abs(got + want).max()) < 1e-6
        assert {r["n"] for r in of} == {n} and abs(of[0]["explained"] / (values[k] / trace) - 1) < 1e-9
        assert of[0]["identity_error"] < 1e-8


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_by_hand(spark, small, sf):
    folder = small.replace("sf0.001", sf)
    agree(w.op12_whitening(spark, folder).collect(), duckdb.sql(f"select vec_id, embedding from '{folder}/embeddings.parquet'").fetchall())


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    lot = np.random.default_rng(3)
    plain = [(i, lot.normal(size=3).tolist(), "mine", "mine") for i in range(40)]
    copies = [(100 + i, [0.5, -0.25, 1.0], "mine", "mine") for i in range(500)]
    odd = [(200, None, "", ""), (201, [], "", ""), (202, [1.0, None, 2.0], "", ""), (203, [nan, 1.0, 1.0], "", ""), (204, [inf, 1.0, 1.0], "", ""), (205, [1.0, 2.0], "", "")]
    table = spark.createDataFrame(plain + copies + odd, VECTORS).repartition(5)
    agree(w.whitened(table, w.fit(table)).collect(), [(i, v) for i, v, *_ in plain + copies])
    kept = w.whitened(table, w.fit(table), keep=("vec_id", "component", "__vector"))
    assert kept.columns == ["vec_id", "__vector", *w.RESULT.fieldNames()] and kept.first()["__vector"] == "mine"
    nulls = spark.createDataFrame([(None, [1.0]), (None, [2.0]), (None, [2.0])], VECTORS.split(", comp")[0])
    assert [r["vec_id"] for r in w.whitened(nulls, w.fit(nulls)).collect()] == [None] * 3


def test_nothing_to_learn(spark):
    one = spark.createDataFrame([(1, [1.0, 2.0])] * 3, VECTORS.split(", comp")[0])
    for table in (one, one.limit(0)):
        assert w.fit(table) is None and w.whitened(table, None).count() == 0


def test_sums_are_exact_at_any_size(spark):
    lot = np.random.default_rng(4)
    rows = np.concatenate([lot.integers(-(2**63), 2**63 - 1, (3000, 3)), np.array([[-(2**63), 2**63 - 1, -1]])])
    found = w.Scatter(3)
    found.add(rows)
    exact = rows.astype(object)
    assert (found.products == exact.T @ exact).all() and (found.sums == exact.sum(axis=0)).all() and found.n == 3001
    huge = [(i, [float(x) for x in r]) for i, r in enumerate(lot.normal(size=(50, 3)) * 1e13)]
    table = spark.createDataFrame(huge, VECTORS.split(", comp")[0])
    agree(w.whitened(table, w.fit(table)).collect(), huge)
    beyond = spark.createDataFrame([(i, [1e4 * x for x in v]) for i, v in huge], VECTORS.split(", comp")[0])
    assert {r["deviation"] for r in w.whitened(beyond, w.fit(beyond)).collect()} == {None}
    far = w.integers(np.array([[1e300, -1e300, 0.0]]))
    assert far.tolist() == [[2**63 - 1, -(2**63), 0]]


def test_packing_round_trip():
    lot = np.random.default_rng(6)
    rows = np.concatenate([lot.integers(-(2**b), 2**b, (20, 5)) for b in (3, 7, 15, 16, 31, 62)])
    assert (w.unpacked(w.packed(rows), 5) == rows).all()
    assert len(set(w.packed(rows))) == len({tuple(r) for r in rows.tolist()})
