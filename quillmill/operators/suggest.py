"""Lexicon suggestions: unmatched terms that an ingredient table knows by exact name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.functions.text import norm_term, suggested_key

KNOWN = " (기존 키 있음)"


def candidates(ingredients: DataFrame, normalise=norm_term) -> DataFrame:
    """surface -> the first ingredient that claims it: by name_key, and in each name_key, inci_name, synonyms in order."""
    entry = lambda form, via: F.struct(form.alias("form"), via.alias("matched_via"))
    synonyms = F.transform(F.coalesce("synonyms", F.array().cast("array<string>")), lambda s: entry(s, F.concat(F.lit("synonym:"), s)))
    forms = F.concat(F.array(entry(F.col("name_key"), F.lit("name_key")), entry(F.col("inci_name"), F.lit("inci_name"))), synonyms)
    each = ingredients.select("name_key", "inci_name", "cas", "sources", F.posexplode(forms).alias("place", "f")).where("coalesce(f.form, '') <> ''")
    once = each.select(F.col("f.form").alias("form")).distinct().withColumn("surface", normalise(F.col("form")))
    placed = each.join(once, F.col("f.form") == F.col("form")).where("surface <> ''")
    best = placed.groupBy("surface").agg(F.min_by(F.struct("name_key", "inci_name", "cas", "sources", "f.matched_via"), F.struct("name_key", "place")).alias("hit"))
    return best.select("surface", "hit.*")


def suggestions(unmatched: DataFrame, ingredients: DataFrame, lexicon_keys: list[str], normalise=norm_term) -> DataFrame:
    terms = unmatched.select("term", F.coalesce(F.try_to_number(F.col("paper_count").cast("string"), F.lit("999999999999")).cast("long"), F.lit(0)).alias("paper_count"))
    hit = terms.withColumn("surface", normalise(F.col("term"))).join(candidates(ingredients, normalise), "surface")
    key = suggested_key(F.col("name_key"))
    return hit.select(
        "term",
        "paper_count",
        F.coalesce("name_key", F.lit("")).alias("matched_name_key"),
        "matched_via",
        F.coalesce("inci_name", F.lit("")).alias("inci_name"),
        F.coalesce("cas", F.lit("")).alias("cas"),
        F.coalesce(F.array_join("sources", ", "), F.lit("")).alias("sources"),
        (F.when(key.isin(lexicon_keys), F.concat(key, F.lit(KNOWN))).otherwise(key) if lexicon_keys else key).alias("suggested_key"),
        F.lit("").alias("verdict"),
    )


