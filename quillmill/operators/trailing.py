"""Trailing prevalence and growth of every term at every month.

A term has a row for each calendar month from its first one to the last of the
collection, so its gaps count as months without papers. Windows are RANGE
frames over the month's number: they reach back by calendar months, not rows.
Months that the collection never observed count in no divisor, as in
``trend.trend_metrics``, whose figures the last month's row repeats.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmill.functions.dates import month_index, month_name
from quillmill.operators.trend import PRIOR_MONTHS, RECENT_MONTHS, TERM, Rounder


def nearly(c: Column, digits: int) -> Column:
    """Half up in decimal. Quotients of sums of six digits carry no more than a binary fraction's error, so the first step is a fine one; a coarse one makes halves of what is just below."""
    return F.round(F.round(c, digits + 8), digits)


def spine(monthly: DataFrame, last: Column, keys: list[str], values: list[str], at: str = "at") -> DataFrame:
    """Rows of ``keys`` and a month number, with a row of zeros for each month that lies between two of a key's, or between its last and ``last``.

    One shuffle by ``keys``: each row makes the months up to the next one. What is made stays where it is, so windows over the same keys shuffle nothing.
    """
    following = F.coalesce(F.lead(at).over(Window.partitionBy(*keys).orderBy(at)), last + 1)
    stretched = monthly.withColumn("__to", following).select(*keys, F.col(at).alias("__from"), *values, F.explode(F.sequence(F.col(at), F.greatest(F.col("__to") - 1, F.col(at)))).alias("__at"))
    zero = [F.when(F.col("__at") == F.col("__from"), F.col(v)).otherwise(F.lit(0).cast(monthly.schema[v].dataType)).alias(v) for v in values]
    return stretched.select(*keys, F.col("__at").alias(at), *zero)


def observed(denominator: DataFrame, recent: int, prior: int) -> DataFrame:
    """For each calendar month of the collection: its own papers and, of the window that ends there and the one before, the papers and the months that were observed. A row a month: few enough for one task."""
    months = denominator.groupBy("query_id", month_index(F.col("month_bucket")).alias("at")).agg(F.sum("paper_count").alias("papers"), F.lit(1).alias("seen"))
    last = months.groupBy("query_id").agg(F.max("at").alias("last"))
    every = spine(months.join(last, "query_id"), F.col("last"), ["query_id", "last"], ["papers", "seen"])
    over = lambda a, b: Window.partitionBy("query_id").orderBy("at").rangeBetween(a, b)
    now, then = over(1 - recent, 0), over(1 - recent - prior, -recent)
    return every.select("query_id", "at", F.sum("papers").over(now).alias("papers_window"), F.sum("seen").over(now).alias("n_recent"), F.coalesce(F.sum("seen").over(then), F.lit(0)).alias("n_prior"))


def trailing(monthly: DataFrame, denominator: DataFrame, recent: int = RECENT_MONTHS, prior: int = PRIOR_MONTHS, rounder: Rounder = nearly) -> DataFrame:
    """From ``term_monthly`` rows: per term and month the papers of the last ``recent`` months, their mean prevalence, that of the ``prior`` months before, and growth.

    Growth is null where the months before were not observed or lack the term.
    A term without papers in either window has zeros, not a missing row.
    """
    keys = [*TERM, "query_id"]
    months = observed(denominator, recent, prior)
    last = denominator.groupBy("query_id").agg(F.max(month_index(F.col("month_bucket"))).alias("__last"))
    rows = monthly.select(*keys, month_index(F.col("month_bucket")).alias("at"), "paper_count", "prevalence").join(F.broadcast(last), "query_id")
    dense = spine(rows, F.col("__last"), keys, ["paper_count", "prevalence"])
    over = lambda a, b: Window.partitionBy(*keys).orderBy("at").rangeBetween(a, b)
    now, then = over(1 - recent, 0), over(1 - recent - prior, -recent)
    exact = lambda c, w: F.round(F.coalesce(F.sum(c).over(w), F.lit(0.0)), 9)  # noqa: E731  sums of six digits, whatever their order
    summed = dense.select(
        *keys,
        "at",
        "paper_count",
        F.sum("paper_count").over(now).alias("papers_trailing"),
        F.count_if(F.col("paper_count") > 0).over(now).alias("months_present"),
        exact("prevalence", now).alias("sum_recent"),
        exact("prevalence", then).alias("sum_prior"),
    ).join(months, ["query_id", "at"])
    mean = lambda s, n: F.try_divide(F.col(s), F.col(n))
    return summed.select(
        "keyword_key",
        "canonical_en",
        "category",
        "is_in_lexicon",
        "query_id",
        month_name(F.col("at")).alias("month_bucket"),
        "paper_count",
        "papers_trailing",
        "papers_window",
        "months_present",
        rounder(mean("sum_recent", "n_recent"), 6).alias("prevalence_trailing"),
        rounder(mean("sum_prior", "n_prior"), 6).alias("prevalence_before"),
        rounder(F.try_divide(mean("sum_recent", "n_recent"), mean("sum_prior", "n_prior")), 4).alias("growth_ratio"),
    )
