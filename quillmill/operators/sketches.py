"""Approximate aggregates by month that merge for any span of months.

A month keeps a count, a HyperLogLog sketch of its distinct values and a KLL
sketch of a number's distribution. Sketches of months merge to that of a span
without the records being read again: a report over any window reads a few
kilobytes a month. All of it runs in Spark's own aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Of the HyperLogLog sketch: 2**LG_K registers, hence a relative standard error of about 1.04 / 2**(LG_K / 2).
LG_K = 12
#: Of the KLL sketch: with so many items a level, ranks are off by at most about 1.3 % with a probability of 99 %.
KLL_K = 200
#: Bounds that hold for practically all spans: three standard errors of a count, and twice the rank error.
DISTINCT_BOUND = 3 * 1.04 / 2 ** (LG_K / 2)
RANK_BOUND = 0.027


def by_month(records: DataFrame, distinct: str, number: str, month: str = "month_bucket") -> DataFrame:
    """(month, n, distinct_sketch, number_sketch); rows without a month are left out, null values are not counted in the sketches."""
    dated = records.where(F.col(month).isNotNull())
    return dated.groupBy(month).agg(F.count(F.lit(1)).alias("n"), F.hll_sketch_agg(F.col(distinct), F.lit(LG_K)).alias("distinct_sketch"), F.kll_sketch_agg_bigint(F.col(number).cast("bigint"), F.lit(KLL_K)).alias("number_sketch"))


def merged(months: DataFrame, spans: DataFrame, month: str = "month_bucket", quantiles: tuple[float, ...] = (0.5, 0.9)) -> DataFrame:
    """For each (first, last) of ``spans``: n, estimated distinct values and quantiles. Both tables are months long."""
    inside = (F.col(month) >= F.col("first")) & (F.col(month) <= F.col("last"))
    parts = spans.join(F.broadcast(months), inside).groupBy("first", "last")
    whole = parts.agg(F.sum("n").alias("n"), F.hll_union_agg("distinct_sketch").alias("d"), F.kll_merge_agg_bigint("number_sketch").alias("q"))
    named = lambda q: f"p{round(q * 100):02d}"
    return whole.select("first", "last", "n", F.hll_sketch_estimate("d").alias("n_distinct"), *[F.kll_sketch_get_quantile_bigint("q", F.lit(q)).alias(named(q)) for q in quantiles])


def rank_error(below: Column, upto: Column, n: Column, q: float) -> Column:
    """How far ``q`` is from the ranks that a value really covers: ``below`` rows are less, ``upto`` are at most as large."""
    return F.greatest(F.lit(0.0), below / n - F.lit(q), F.lit(q) - upto / n)
