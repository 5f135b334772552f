"""Publication dates of varying precision, and months as ``YYYY-MM`` text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_date(value: Column, fallback_year: Column | None = None) -> Column:
    """struct(month_bucket, date_precision, year): day, else month, else year, else the fallback year, else unknown."""
    day = F.try_to_timestamp(F.substring(value, 1, 10), F.lit("y-M-d"))
    month = F.try_to_timestamp(F.regexp_extract(value, r"^(\d{4}-\d{1,2})", 1), F.lit("y-M"))
    year = F.regexp_extract(value, r"^([0-9]{4})", 1)
    fallback = F.lit(None).cast("int") if fallback_year is None else F.nullif(fallback_year.cast("int"), F.lit(0))

    def made(bucket: Column | None, precision: str, year_: Column) -> Column:
        return F.struct((F.lit(None).cast("string") if bucket is None else bucket).alias("month_bucket"), F.lit(precision).alias("date_precision"), year_.cast("int").alias("year"))

    return (
        F.when(day.isNotNull(), made(F.date_format(day, "yyyy-MM"), "day", F.year(day)))
        .when(month.isNotNull(), made(F.date_format(month, "yyyy-MM"), "month", F.year(month)))
        .when(year != "", made(None, "year_only", year))
        .when(fallback.isNotNull(), made(None, "year_only", fallback))
        .otherwise(made(None, "unknown", F.lit(None)))
    )


def month_add(month: Column, n: Column | int) -> Column:
    return F.date_format(F.add_months(F.to_date(month, "yyyy-MM"), n if isinstance(n, Column) else F.lit(n)), "yyyy-MM")


def month_index(month: Column) -> Column:
    """Months since year 0: differences count calendar months."""
    return F.substring(month, 1, 4).cast("int") * 12 + F.substring(month, 6, 2).cast("int") - 1


def month_name(index: Column) -> Column:
    """The month of a ``month_index``."""
    return F.format_string("%04d-%02d", F.floor(index / 12).cast("int"), (F.pmod(index, F.lit(12)) + 1).cast("int"))


def month_series(first: Column, last: Column) -> Column:
    """Array of struct(month, first_day, last_day) from date to date, clipped at both ends."""
    starts = F.sequence(F.trunc(first, "MM"), F.trunc(last, "MM"), F.expr("interval 1 month"))
    return F.transform(starts, lambda d: F.struct(F.date_format(d, "yyyy-MM").alias("month"), F.greatest(d, first).alias("first_day"), F.least(F.last_day(d), last).alias("last_day")))


def citation_per_year(citations: Column, published: Column, collected: Column) -> Column:
    """Citations by age in years, of at least half a year; null if either date can't be read."""
    days = F.datediff(F.to_date(F.try_to_timestamp(collected, F.lit("y-M-d"))), F.to_date(F.try_to_timestamp(published, F.lit("y-M-d"))))
    return F.when(days.isNotNull(), citations / F.greatest(days / F.lit(365.25), F.lit(0.5)))
