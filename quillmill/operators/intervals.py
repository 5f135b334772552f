"""Interval join: points with the intervals that hold them, as an equi-join.

Time is cut into bins on several levels, each twice as wide as the one below.
An interval goes to the level whose bins are at least as long as itself, so it
touches two of them at most, however long it is; a point goes to its bin on
every level that has intervals. Equal bins meet in a join, and the bounds
decide. Bins that very many points share are salted: the points are dealt over
the salts, the few intervals of the bin are copied to each.

Where only sums and distinct keys are wanted, ``sums_in`` gives them without
forming the pairs, whose number grows with the square of the events.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmill.session import stored

#: Points of a bin that one salt takes.
MOST = 200_000


def level_of(length: Column, width: float) -> Column:
    """0 for intervals up to ``width``, and one more for each doubling; of a power of two exactly its exponent."""
    return F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(length / F.lit(width), F.lit(1.0))) - F.lit(1e-9))).cast("int")


def bin_of(at: Column, level: Column, width: float) -> Column:
    return F.floor(at / (F.lit(width) * F.pow(F.lit(2.0), level))).cast("long")


def points_in(points: DataFrame, intervals: DataFrame, at: str, start: str, end: str, by: list[tuple[str, str]] = (), closed: bool = False, width: float | None = None, condition: Column | None = None, most: int = MOST) -> DataFrame:
    """Every pair of a point and an interval with ``start <= at < end`` (``<=`` if ``closed``), with all columns of both.

    ``at``, ``start`` and ``end`` are numbers; columns of the two sides must
    differ. ``by`` names pairs of columns that must be equal, ``condition``
    whatever else must hold. ``width`` is that of the finest bins, the median
    length of the intervals if it isn't given. Nulls meet nothing, nor do
    intervals that end before they start.
    """
    clash = set(points.columns) & set(intervals.columns)
    if clash:
        raise ValueError(f"both sides have {', '.join(sorted(clash))}")
    length = F.col(end) - F.col(start)
    spans = intervals.where((length >= 0) if closed else (length > 0))
    if width is None:
        width = float(spans.agg(F.percentile_approx(length, 0.5)).first()[0] or 0) or 1.0
    level = level_of(length, width)
    levels = [r[0] for r in spans.select(level.alias("l")).distinct().collect()]  # as many as doublings
    first, last = bin_of(F.col(start), F.col("__level"), width), bin_of(F.col(end), F.col("__level"), width)
    placed = spans.withColumn("__level", level).withColumn("__bin", F.explode(F.sequence(first, last)))
    asked = points.where(F.col(at).isNotNull()).withColumn("__level", F.explode(F.array(*[F.lit(x) for x in levels]).cast("array<int>"))).withColumn("__bin", bin_of(F.col(at), F.col("__level"), width))
    keys = ["__level", "__bin"]
    full = asked.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > most).select(*keys, F.ceil(F.col("__n") / most).cast("int").alias("__salts"))
    if full.isEmpty():
        salted, copied = asked.withColumn("__salt", F.lit(0)), placed.withColumn("__salt", F.lit(0))
    else:
        one = F.coalesce("__salts", F.lit(1))
        salted = asked.join(full, keys, "left").withColumn("__salt", F.pmod(F.xxhash64(*points.columns), one).cast("int")).drop("__salts")
        copied = placed.join(full, keys, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), one - 1))).drop("__salts")
    right = copied.withColumnsRenamed({"__level": "__l", "__bin": "__b", "__salt": "__s"})
    holds = (F.col("__level") == F.col("__l")) & (F.col("__bin") == F.col("__b")) & (F.col("__salt") == F.col("__s"))
    for a, b in by:
        holds &= F.col(a) == F.col(b)
    inside = (F.col(start) <= F.col(at)) & (F.col(at) <= F.col(end) if closed else F.col(at) < F.col(end))
    holds &= inside if condition is None else inside & condition
    return salted.join(right, holds).select(*points.columns, *intervals.columns)

#: Points of a slice of time that one task tallies.
SLICE = 400_000
#: Names of the parts of a sum.
AMOUNTS = ("n", "n_values", "n_nan", "n_up", "n_down", "finite")


def amounts(value: str) -> dict[str, Column]:
    """Parts of a sum that may be added and taken away in any order: what is finite, and how often there is anything, or what is not."""
    c = F.col(value).cast("double")
    inf = F.lit(float("inf"))
    return {
        "n": F.lit(1).cast("long"),
        "n_values": F.when(c.isNotNull(), 1).otherwise(0).cast("long"),
        "n_nan": F.when(F.isnan(c), 1).otherwise(0).cast("long"),
        "n_up": F.when(c == inf, 1).otherwise(0).cast("long"),
        "n_down": F.when(c == -inf, 1).otherwise(0).cast("long"),
        "finite": F.when(c.isNull() | F.isnan(c) | (F.abs(c) == inf), 0.0).otherwise(c),
    }


def amount(c: dict[str, Column]) -> Column:
    """The sum that such parts stand for; null where there is no value."""
    up, down = c["n_up"] > 0, c["n_down"] > 0
    odd = F.when((c["n_nan"] > 0) | (up & down), float("nan")).when(up, float("inf")).when(down, float("-inf"))
    return F.when(c["n_values"] > 0, F.coalesce(odd, c["finite"]))


def fewer_behind(order: np.ndarray, first: np.ndarray, below: np.ndarray) -> np.ndarray:
    """For each question how many of ``order[first:]``, a permutation, are less than ``below``: a wavelet matrix, bit by bit."""
    found, low, high = np.zeros(len(first), np.int64), first, np.full(len(first), len(order))
    for bit in range(len(order).bit_length() - 1, -1, -1):
        ones = (order >> bit) & 1 == 1
        zeros = np.concatenate([[0], np.cumsum(~ones)])
        up = (below >> bit) & 1 == 1
        low0, high0 = zeros[low], zeros[high]
        found += np.where(up, high0 - low0, 0)
        low, high = np.where(up, zeros[-1] + low - low0, low0), np.where(up, zeros[-1] + high - high0, high0)
        order = np.concatenate([order[~ones], order[ones]])
    return found


def tally_slice(rows: pd.DataFrame) -> pd.DataFrame:
    """Of one slice's points and the intervals that touch it: each interval's number here, its sums over the points inside, and how many of these are followed by one of the same key inside."""
    points, asked = rows[rows["__asked"] < 0].sort_values("__at", kind="stable"), rows[rows["__asked"] >= 0]
    at, start, end = points["__at"].to_numpy(np.int64), asked["__at"].to_numpy(np.int64), asked["__end"].to_numpy(np.int64)
    first, last = np.searchsorted(at, start), np.searchsorted(at, end)
    following = points["__end"].to_numpy(np.int64)
    order = np.empty(len(at), np.int64)
    order[np.argsort(following, kind="stable")] = np.arange(len(at))
    out = {"__asked": asked["__asked"].to_numpy(np.int64)}
    for name in AMOUNTS:
        sums = np.concatenate([[0], np.cumsum(points[name].to_numpy(np.longdouble if name == "finite" else np.int64))])
        out[name] = (sums[last] - sums[first]).astype(np.float64 if name == "finite" else np.int64)
    out["again"] = fewer_behind(order, first, np.searchsorted(np.sort(following), end))
    return pd.DataFrame(out)


def sums_in(points: DataFrame, intervals: DataFrame, at: str, start: str, end: str, key: str, value: str, most: int = SLICE) -> DataFrame:
    """The intervals with what lies in each, at ``start <= at < end``: the parts of ``amounts`` summed, and ``keys``, the number of distinct ones; intervals without points go.

    No pair of a point and an interval is formed. Time is cut into slices of
    about ``most`` points; a slice gets its points and the intervals that touch
    it, and running sums give every count. A key is counted by its last point
    inside: points less those whose follower of the same key is inside as well.
    ``at``, ``start`` and ``end`` are whole numbers below 2^63 - 1; nulls, of keys too, meet nothing, nor do
    intervals that end before they start. Points of one moment are never cut.
    """
    never = (1 << 63) - 1
    known = points.where(F.col(at).isNotNull() & F.col(key).isNotNull()).select(F.col(at).alias("__at"), F.col(key).alias("__key"), *[c.alias(n) for n, c in amounts(value).items()])
    linked = known.withColumn("__end", F.coalesce(F.lead("__at").over(Window.partitionBy("__key").orderBy("__at")), F.lit(never))).drop("__key")
    slices = -(-known.count() // most)
    cuts = []
    if slices > 1:
        cuts = sorted(set(known.agg(F.percentile_approx("__at", [k / slices for k in range(1, slices)], 100 * slices)).first()[0]))
    bounds = F.array(*[F.lit(x) for x in cuts]).cast("array<long>")
    slice_of = lambda c: F.size(F.filter(bounds, lambda b: b <= c))
    spans = stored(intervals.where(F.col(start) < F.col(end)).withColumn("__asked", F.monotonically_increasing_id()), "intervals")
    empty = [F.lit(0).cast(linked.schema[n].dataType).alias(n) for n in AMOUNTS]
    touched = F.explode(F.sequence(slice_of(F.col(start)), slice_of(F.col(end) - 1))).alias("__slice")
    questions = spans.select(F.col(start).alias("__at"), *empty, F.col(end).alias("__end"), F.col("__asked"), touched)
    both = linked.withColumns({"__asked": F.lit(-1).cast("long"), "__slice": slice_of(F.col("__at"))}).unionByName(questions)
    kinds = "__asked long, n long, n_values long, n_nan long, n_up long, n_down long, finite double, again long"
    parts = both.groupBy("__slice").applyInPandas(tally_slice, kinds)
    whole = parts.groupBy("__asked").agg(*[F.sum(c).alias(c) for c in (*AMOUNTS, "again")]).where("n > 0")
    return spans.join(whole.withColumn("keys", F.col("n") - F.col("again")).drop("again"), "__asked").drop("__asked")
