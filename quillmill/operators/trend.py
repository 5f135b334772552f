"""Monthly prevalence, cohort-relative weight, growth and trend class of terms.

Input records have ``id``, ``month_bucket``, ``query_id`` and
``citation_count``. A record without a month is left out of everything
monthly. ``rounder`` rounds the published figures: ``F.round``, or
``functions.text.exact_round`` where the binary value decides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmill.functions.dates import month_add, month_index
from quillmill.session import partitions, stored

#: Fixed values of the classification.
LOW_SAMPLE, LEAST_TOTAL, NEW_ENTRANT_PAPERS = 50, 10, 5
RECENT_MONTHS, PRIOR_MONTHS = 12, 24
RISING, FALLING = 1.5, 0.67
SPREAD, STEADY = 0.25, 0.5
#: A key and what depends on it: grouped by together, for hash aggregation has no buffer for any string.
TERM = ("keyword_key", "canonical_en", "category", "is_in_lexicon")

Rounder = Callable[[Column, int], Column]


def rounded(c: Column, digits: int) -> Column:
    """Half up in decimal; the first step takes away what the order of a sum has left behind."""
    return F.round(F.round(c, digits + 5), digits)


class CensusError(ValueError):
    """Ratios of a partial collection were asked for."""


def census_guard(meta: dict, allow_sample: bool = False) -> str | None:
    """Raises unless the collection is complete; with ``allow_sample`` gives a warning instead."""
    if meta.get("is_census"):
        return None
    note = f"collection of {meta.get('collected', 'unknown')} of {meta.get('expected_from_api', 'unknown')} works is not a census"
    if not allow_sample:
        raise CensusError(note)
    return note


def provisional_from(collected_at: Column, months: int) -> Column:
    """The first provisional month: the newest ``months`` months, counted back from the collection date, are provisional."""
    return month_add(F.date_format(F.coalesce(F.try_to_timestamp(F.substring(collected_at, 1, 10), F.lit("y-M-d")), F.current_timestamp()), "yyyy-MM"), 1 - months)


def is_provisional(month: Column, provisional: list[str]) -> Column:
    return month.isin(provisional) if provisional else F.lit(False)


def cohort_weights(records: DataFrame, month: str = "month_bucket", citations: str = "citation_count") -> DataFrame:
    """Adds citation_percentile_in_cohort, the midrank share within the month, and cohort_size.

    Citation counts repeat a lot, so ranks come from the distinct counts of each
    month: records are only counted, and joined back, never ordered in one task.
    """
    sizes = records.groupBy(month, citations).agg(F.count(F.lit(1)).alias("__n"))
    upto = F.sum("__n").over(Window.partitionBy(month).orderBy(citations))
    whole = F.sum("__n").over(Window.partitionBy(month))
    share = F.when(F.col(month).isNotNull(), (upto - F.col("__n") / 2) / whole)
    ranked = sizes.select(month, citations, share.alias("citation_percentile_in_cohort"), whole.alias("cohort_size"))
    tagged = ranked.withColumnsRenamed({month: "__m", citations: "__c"})
    return records.join(tagged, F.col(month).eqNullSafe(F.col("__m")) & F.col(citations).eqNullSafe(F.col("__c")), "left").drop("__m", "__c")


def monthly_denominator(records: DataFrame, threshold: int = LOW_SAMPLE, provisional: list[str] = ()) -> DataFrame:
    counted = records.where("month_bucket is not null").groupBy("month_bucket", "query_id").agg(F.count(F.lit(1)).alias("paper_count"))
    return counted.select("month_bucket", "query_id", "paper_count", (F.col("paper_count") < threshold).alias("is_low_sample"), is_provisional(F.col("month_bucket"), list(provisional)).alias("is_provisional"))


def term_monthly(terms: DataFrame, denominator: DataFrame, rounder: Rounder = rounded, parts: int | None = None) -> DataFrame:
    """Per term and month: counts, share of all papers of the month, citations and mean cohort share.

    ``terms`` has one row a record and key, with the record's month_bucket,
    citation_count and citation_percentile_in_cohort. One shuffle into
    ``parts`` serves all that is grouped here.
    """
    dealt = terms.where("month_bucket is not null").repartition(parts or partitions(terms.sparkSession), "month_bucket", "keyword_key")
    # equal counts of one term and month are one row, so that the median below holds few values, however many papers a term has
    counted = dealt.groupBy("month_bucket", *TERM, "citation_count").agg(F.count(F.lit(1)).alias("n"), F.sum("citation_percentile_in_cohort").alias("shares"))
    grouped = counted.groupBy("month_bucket", *TERM).agg(
        F.sum("n").alias("paper_count"),
        F.sum(F.col("citation_count") * F.col("n")).alias("citation_sum"),
        F.percentile("citation_count", 0.5, F.col("n")).alias("median"),
        (F.sum("shares") / F.sum(F.when(F.col("shares").isNotNull(), F.col("n")))).alias("weight"),
    )
    months = denominator.select("month_bucket", "query_id", F.col("paper_count").alias("total_papers"), "is_low_sample", "is_provisional")
    return grouped.join(months, "month_bucket").select(
        "month_bucket",
        "query_id",
        "keyword_key",
        "canonical_en",
        "category",
        "is_in_lexicon",
        "paper_count",
        "total_papers",
        rounder(F.col("paper_count") / F.col("total_papers"), 6).alias("prevalence"),
        "citation_sum",
        rounder(F.col("median"), 2).alias("citation_median"),
        rounder(F.col("weight"), 6).alias("weighted_prevalence"),
        "is_low_sample",
        "is_provisional",
    )


def classify(total: Column, months_present: Column, months_observed: Column, growth: Column, is_new: Column) -> Column:
    """First rule that holds names the class."""
    presence = months_present / months_observed
    return (
        F.when(total < LEAST_TOTAL, "unrated")
        .when(is_new, F.when(presence >= SPREAD, "emerging").otherwise("sporadic"))
        .when(growth.isNull(), "unrated")
        .when(growth >= RISING, F.when(presence < SPREAD, "sporadic").otherwise("emerging"))
        .when(growth <= FALLING, "declining")
        .when(presence >= STEADY, "steady")
        .otherwise("sporadic")
    )


def trend_metrics(monthly: DataFrame, denominator: DataFrame, rounder: Rounder = rounded) -> DataFrame:
    """One row a term over all months: presence, recent and prior prevalence, growth and class.

    The recent window is the last twelve calendar months less provisional ones,
    the prior window the 24 before. Means divide by the months that the
    collection observed in a window, so a month without the term counts as 0.
    """
    at = month_index(F.col("month_bucket"))
    last = denominator.agg(F.max(at).alias("last"))
    months = denominator.crossJoin(F.broadcast(last)).select("month_bucket", "is_provisional", (F.col("last") - at).alias("age"))
    recent = (F.col("age") < RECENT_MONTHS) & ~F.col("is_provisional")
    prior = (F.col("age") >= RECENT_MONTHS) & (F.col("age") < RECENT_MONTHS + PRIOR_MONTHS)
    flagged = months.select("month_bucket", recent.alias("recent"), prior.alias("prior"))
    sizes = flagged.agg(F.count(F.lit(1)).alias("months_observed"), F.count_if("recent").alias("n_recent"), F.count_if("prior").alias("n_prior"))

    inside = lambda flag, c: F.sum(F.when(F.col(flag), F.col(c)))
    exact = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 9)  # noqa: E731  sums of six digits, whatever their order
    per = (
        monthly.select("month_bucket", "query_id", "keyword_key", "canonical_en", "category", "is_in_lexicon", "paper_count", "prevalence", "weighted_prevalence")
        .join(flagged, "month_bucket")
        .groupBy(*TERM, "query_id")
        .agg(
            F.min("month_bucket").alias("first_seen_month"),
            F.sum("paper_count").alias("total_papers"),
            F.count(F.lit(1)).alias("months_present"),  # a term has one row a month
            exact(inside("recent", "prevalence")).alias("sum_recent"),
            exact(inside("prior", "prevalence")).alias("sum_prior"),
            F.coalesce(inside("recent", "paper_count"), F.lit(0)).alias("papers_recent"),
            F.coalesce(inside("prior", "paper_count"), F.lit(0)).alias("papers_prior"),
            F.round(F.avg(F.when(F.col("recent"), F.col("weighted_prevalence"))), 9).alias("weight"),
        )
        .crossJoin(F.broadcast(sizes))
    )
    mean = lambda s, n: F.try_divide(F.col(s), F.col(n))
    growth = F.try_divide(mean("sum_recent", "n_recent"), mean("sum_prior", "n_prior"))
    new = (F.col("papers_prior") == 0) & (F.col("papers_recent") >= NEW_ENTRANT_PAPERS)
    wide = per.withColumns({"growth": growth, "is_new_entrant": new})
    return wide.select(
        "keyword_key",
        "canonical_en",
        "category",
        "is_in_lexicon",
        "query_id",
        "first_seen_month",
        "total_papers",
        "months_present",
        "months_observed",
        rounder(mean("sum_recent", "n_recent"), 6).alias("prevalence_recent"),
        rounder(mean("sum_prior", "n_prior"), 6).alias("prevalence_prior"),
        rounder(F.col("growth"), 4).alias("growth_ratio"),
        "is_new_entrant",
        rounder(F.col("weight"), 6).alias("weighted_prevalence_recent"),
        classify(F.col("total_papers"), F.col("months_present"), F.col("months_observed"), F.col("growth"), F.col("is_new_entrant")).alias("trend_class"),
    )


def mesh_monthly(papers: DataFrame, threshold: int = LOW_SAMPLE, provisional: list[str] = (), rounder: Rounder = rounded, query_id: str = "") -> DataFrame:
    """Subject headings per month; each counts once a paper, and papers without any stay in the totals."""
    dated = papers.where("month_bucket is not null")
    totals = dated.groupBy("month_bucket").agg(F.count(F.lit(1)).alias("total_papers"))
    each = dated.select("pmid", "month_bucket", F.explode("mesh_terms").alias("t")).select("pmid", "month_bucket", F.lower(F.trim("t")).alias("mesh_term")).where("mesh_term <> ''").distinct()
    counted = each.groupBy("month_bucket", "mesh_term").agg(F.count(F.lit(1)).alias("paper_count"))
    return counted.join(totals, "month_bucket").select(
        "month_bucket",
        F.lit(query_id).alias("query_id"),
        "mesh_term",
        "paper_count",
        "total_papers",
        rounder(F.col("paper_count") / F.col("total_papers"), 6).alias("prevalence"),
        (F.col("total_papers") < threshold).alias("is_low_sample"),
        is_provisional(F.col("month_bucket"), list(provisional)).alias("is_provisional"),
    )


def overlap_sides(a: DataFrame, b: DataFrame) -> DataFrame:
    """(month_bucket, doi, side) of every DOI of a month: side is 1 or 2 where only that provider has it, 3 where both have."""
    tagged = a.select("month_bucket", "doi", F.lit(1).alias("side")).union(b.select("month_bucket", "doi", F.lit(2).alias("side"))).where("doi <> ''")
    return tagged.groupBy("month_bucket", "doi").agg(F.bit_or("side").alias("side"))


def overlap(a: DataFrame, b: DataFrame, names: tuple[str, str] = ("openalex", "pubmed"), normalise: Callable[[Column], Column] | None = None) -> DataFrame:
    """Per month: rows of either provider, DOIs of both and of one alone, and rows of the second that lack a DOI.

    Inputs have month_bucket and doi. DOIs are compared within a month, as they
    are unless ``normalise`` is given.
    """
    clean = lambda d: d.withColumn("doi", normalise(F.col("doi"))) if normalise else d
    a, b = (clean(x.select("month_bucket", "doi").where("month_bucket is not null")) for x in (a, b))
    n1, n2 = names
    rows_a = a.groupBy("month_bucket").agg(F.count(F.lit(1)).alias(f"{n1}_papers"))
    rows_b = b.groupBy("month_bucket").agg(F.count(F.lit(1)).alias(f"{n2}_papers"), F.count_if(F.coalesce("doi", F.lit("")) == "").alias("doi_missing"))
    sides = overlap_sides(a, b)
    dois = sides.groupBy("month_bucket").agg(F.count_if(F.col("side") == 3).alias("both"), F.count_if(F.col("side") == 1).alias(f"{n1}_only"), F.count_if(F.col("side") == 2).alias(f"{n2}_only"))
    joined = rows_a.join(rows_b, "month_bucket", "full_outer").join(dois, "month_bucket", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return joined.select("month_bucket", *[zero(c) for c in (f"{n1}_papers", f"{n2}_papers", "both", f"{n1}_only", f"{n2}_only", "doi_missing")])


def overlap_totals(months: DataFrame) -> DataFrame:
    return months.agg(*[F.sum(c).alias(c) for c in months.columns if c != "month_bucket"])


EXAMPLES, TITLE_CHARS = 3, 140


def unmatched(terms: DataFrame, order: str = "ord", top: int | None = None) -> DataFrame:
    """Terms that the lexicon lacks, by number of papers, with the first titles in input order.

    ``terms`` is resolved, with month_bucket, title and an input position, and
    is read once: each month of a term gives its count and its first titles,
    and a term adds up its months. A term that very many papers have is dealt
    by month, and no more than three titles a month are held.
    """
    open_ = terms.where(~F.col("is_in_lexicon")).select("keyword_key", "month_bucket", F.col(order).alias("__o"), F.substring(F.regexp_replace(F.coalesce("title", F.lit("")), r"(?U)^\s+|\s+$", ""), 1, TITLE_CHARS).alias("title"))
    place = F.row_number().over(Window.partitionBy("keyword_key", "month_bucket").orderBy(F.col("title") == "", "__o"))
    first = F.collect_list(F.when((F.col("k") <= EXAMPLES) & (F.col("title") != ""), F.struct("__o", "title")))
    monthly = open_.withColumn("k", place).groupBy("keyword_key", "month_bucket").agg(F.count(F.lit(1)).alias("n"), first.alias("titles"))
    counted = monthly.groupBy("keyword_key").agg(
        F.sum("n").alias("paper_count"),
        F.min("month_bucket").alias("first"),
        F.max("month_bucket").alias("last"),
        F.count("month_bucket").alias("months_present"),
        F.slice(F.array_sort(F.flatten(F.collect_list("titles"))), 1, EXAMPLES).alias("titles"),
    )
    ranked = stored(counted.orderBy(F.desc("paper_count"), "keyword_key").limit(top) if top else counted, "unmatched")
    blank = lambda c, name: F.coalesce(c, F.lit("")).alias(name)
    return numbered(ranked, "paper_count", "keyword_key").select(
        "rank",
        F.col("keyword_key").alias("term"),
        "paper_count",
        blank("first", "first_seen_month"),
        blank("last", "last_seen_month"),
        "months_present",
        *[blank(F.get(F.col("titles"), F.lit(i))["title"], f"example_title_{i + 1}") for i in range(EXAMPLES)],
        F.lit("").alias("verdict"),
    )


def without_topics(records: DataFrame, excluded: DataFrame, topics: str = "topics") -> DataFrame:
    """Records less those that carry an excluded topic, compared without case and outer blanks; ``excluded`` has one column. A small set of exact names: an anti join, not a filter by pattern."""
    name = lambda c: F.lower(F.trim(c))
    banned = excluded.select(name(F.col(excluded.columns[0])).alias("__topic")).where("__topic <> ''").distinct()
    carried = records.withColumn("__id", F.monotonically_increasing_id()) if "id" not in records.columns else records.withColumn("__id", F.col("id"))
    hit = carried.select("__id", F.explode(topics).alias("__t")).select("__id", name(F.col("__t")).alias("__topic")).join(banned, "__topic", "left_semi").select("__id").distinct()
    return carried.join(hit, "__id", "left_anti").drop("__id")


PREFIX = 3


def numbered(rows: DataFrame, count: str, key: str, name: str = "rank") -> DataFrame:
    """Positions from 1 by descending ``count``, then ascending ``key``, without one task that holds all rows.

    Rows are counted by ``count`` and the start of their key, which order them
    as the whole key does; a running sum of those few counts gives where each
    group starts, and rows are numbered within theirs. Only rows with the same
    count and the same first letters share a task.
    """
    grouped = rows.withColumn("__p", F.substring(key, 1, PREFIX))
    sizes = grouped.groupBy(count, "__p").agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.orderBy(F.desc(count), F.col("__p")).rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select(F.col(count).alias("__c"), F.col("__p").alias("__q"), F.coalesce(before, F.lit(0)).alias("__s"))
    within = F.row_number().over(Window.partitionBy(count, "__p").orderBy(key))
    placed = grouped.withColumn("__k", within).join(starts, (F.col(count) == F.col("__c")) & F.col("__p").eqNullSafe(F.col("__q")))
    return placed.withColumn(name, (F.col("__k") + F.col("__s")).cast("int")).drop("__k", "__s", "__c", "__p", "__q")


def year_histogram(records: DataFrame, year: str = "year") -> DataFrame:
    return records.where(F.col(year).isNotNull()).groupBy(year).agg(F.count(F.lit(1)).alias("n"))


def class_histogram(metrics: DataFrame) -> DataFrame:
    return metrics.groupBy("trend_class").agg(F.count(F.lit(1)).alias("n"))


def records_summary(records: DataFrame) -> DataFrame:
    """One row: totals, records by date precision, distinct terms of each field, records with a DOI and without a month."""
    fields = ("keywords", "topics", "concepts")
    counts = records.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col("date_precision") == p).alias(f"precision_{p}") for p in ("day", "month", "year_only", "unknown")],
        F.count_distinct("month_bucket").alias("months"),
        F.count_if(F.coalesce("doi", F.lit("")) != "").alias("with_doi"),
        F.count_if(F.col("month_bucket").isNull()).alias("excluded"),
    )
    for f in fields:
        counts = counts.crossJoin(records.select(F.explode(f).alias("t")).agg(F.count_distinct("t").alias(f"distinct_{f}")))
    return counts
