"""The curated vocabulary as a small dimension table, and terms resolved against it."""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.functions.text import norm_term
from quillmill.session import partitions, stored

SHOWN = 5


class LexiconError(ValueError):
    """A surface form stands for two keys."""


def alias_rows(lexicon: dict[str, dict], normalise) -> list[tuple[str, str, str, str]]:
    """(surface, key, canonical, category) of every form of every key; keys that start with an underscore are comments."""
    owners = defaultdict(dict)
    for key, entry in lexicon.items():
        if key.startswith("_"):
            continue
        name, category = entry.get("canonical_en") or key, entry.get("category") or ""
        for form in (name, key.replace("_", " "), *entry.get("aliases", ())):
            if surface := normalise(form):
                owners[surface][key] = (surface, key, name, category)
    clashes = [f"{s}: {', '.join(sorted(o))}" for s, o in sorted(owners.items()) if len(o) > 1]
    if clashes:
        raise LexiconError(f"{len(clashes)} forms of several keys, such as " + "; ".join(clashes[:SHOWN]))
    return [row for o in owners.values() for row in o.values()]


def plain_norm_term(text: str | None) -> str:
    """``norm_term`` on the driver, for the few rows of a lexicon."""
    import re
    import unicodedata

    folded = unicodedata.normalize("NFKC", str(text).lower()).strip() if text else ""
    return re.sub(r"[-_/\s]+", " ", folded).strip()


def alias_table(spark: SparkSession, lexicon: dict[str, dict]) -> DataFrame:
    return spark.createDataFrame(alias_rows(lexicon, plain_norm_term), "surface string, keyword_key string, canonical_en string, category string")


def stopword_table(spark: SparkSession, labels: list[str]) -> DataFrame:
    return spark.createDataFrame([(s,) for s in sorted({plain_norm_term(x) for x in labels} - {""})], "surface string")


def surfaces(terms: DataFrame, column: str, normalise=norm_term) -> DataFrame:
    """Adds ``surface``: each distinct term is normalised once and joined back; a table of terms alone becomes their distinct ones."""
    once = terms.select(column).distinct().withColumn("surface", normalise(F.col(column)))
    return once if terms.columns == [column] else terms.join(once, column)


def resolve(terms: DataFrame, aliases: DataFrame, stopwords: DataFrame) -> DataFrame:
    """Rows with ``surface`` get keyword_key, canonical_en, category and is_in_lexicon.

    A stopword goes, unless the lexicon has it; any other unknown surface is its
    own key. Both dimensions are curated by hand, far below the broadcast limit;
    Spark checks their size and falls back to a shuffle beyond it.
    """
    hit = terms.where(F.col("surface") != "").join(aliases, "surface", "left")
    known = F.col("keyword_key").isNotNull()
    stops = stopwords.select("surface").distinct().withColumn("stop", F.lit(True))
    left = hit.join(stops, "surface", "left").where(known | F.col("stop").isNull()).drop("stop")
    or_surface = lambda c: F.when(known, F.coalesce(c, "keyword_key")).otherwise(F.col("surface")).alias(c)
    others = [F.col(f"`{c}`") for c in terms.columns if c != "surface"]
    return left.select(*others, "surface", or_surface("keyword_key"), or_surface("canonical_en"), F.coalesce("category", F.lit("")).alias("category"), known.alias("is_in_lexicon"))


def record_terms(records: DataFrame, field: str | Column, aliases: DataFrame, stopwords: DataFrame, keep: list[str], normalise=norm_term, parts: int | None = None) -> DataFrame:
    """One row a record and key: the terms of one list column, resolved; forms that share a key count once a record.

    Each distinct term is normalised and resolved once, stored, and joined back:
    Spark knows the stored size, so the rows of few, frequent terms aren't sorted
    by term in as few tasks. The kept columns must be functions of the first. All
    columns are grouped by, as hash aggregation has no buffer for a first string.
    Records are dealt into ``parts`` before, so that a task holds no more as the
    input grows.
    """
    parts = parts or partitions(records.sparkSession)
    each = records.select(*keep, F.explode(field).alias("term"))
    once = stored(resolve(surfaces(each.select("term"), "term", normalise), aliases, stopwords).drop("surface"), "terms")
    return each.join(once, "term").drop("term").repartition(parts, keep[0]).distinct()


def normalize_summary(records: DataFrame, field: str, aliases: DataFrame, stopwords: DataFrame, normalise=norm_term) -> DataFrame:
    """Distinct terms before and keys after, their difference, and lexicon keys hit."""
    each = surfaces(records.select(F.explode(field).alias("term")), "term", normalise)
    before = each.agg(F.count_distinct("term").alias("before"))
    after = resolve(each, aliases, stopwords).agg(F.count_distinct("keyword_key").alias("after"), F.count_distinct(F.when(F.col("is_in_lexicon"), F.col("keyword_key"))).alias("lexicon_keys"))
    return before.crossJoin(after).select(F.lit(field).alias("field"), "before", "after", (F.col("before") - F.col("after")).alias("reduction"), "lexicon_keys")


def top_terms(terms: DataFrame, column: str, n: int) -> DataFrame:
    """The most frequent values; equal counts in ascending order of the value."""
    return terms.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column).limit(n)
