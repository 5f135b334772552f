"""Upserts as joins of old and new tables: (old, new) to merged.

Null key parts count as ``''``, since nulls never meet. ``sources.versioned``
stores what comes out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

POLICIES = ("overwrite", "merge")
#: Natural keys and policies of the stored record types.
TABLES = {
    "oa_location": (("doi",), "overwrite"),
    "retraction": (("doi", "retraction_doi"), "overwrite"),
    "trial": (("nct_id",), "overwrite"),
    "ingredient": (("name_key",), "merge"),
}


def aligned(old: DataFrame, new: DataFrame, skip: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Both sides with the columns of ``old`` and then those that only ``new`` has; what a side lacks is null. A column that changed its type is refused. ``skip`` columns are of ``new`` alone."""
    kinds = {f.name: f.dataType for f in old.schema.fields}
    for f in new.schema.fields:
        if f.name in kinds and kinds[f.name] != f.dataType:
            raise ValueError(f"column {f.name} was {kinds[f.name].simpleString()} and is now {f.dataType.simpleString()}")
    kinds |= {f.name: f.dataType for f in new.schema.fields if f.name not in skip}
    fill = lambda df, also=(): df.select(*[F.col(f"`{c}`") if c in df.columns else F.lit(None).cast(k).alias(c) for c, k in kinds.items()], *also)
    return fill(old), fill(new, [c for c in skip if c in new.columns])


def keyed(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.withColumns({k: F.coalesce(k, F.lit("")) for k in keys})


def blank_to_null(rows: DataFrame, skip: list[str]) -> DataFrame:
    """Empty strings and lists as nulls, in all but the key columns."""
    made = {}
    for f in rows.schema.fields:
        kind = f.dataType.typeName()
        if f.name not in skip and kind in ("string", "array"):
            made[f.name] = F.when(F.trim(f.name) != "", F.col(f.name)) if kind == "string" else F.when(F.size(f.name) > 0, F.col(f.name))
    return rows.withColumns(made) if made else rows


def last_by_key(rows: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """The latest row of each key."""
    others = [c for c in rows.columns if c not in keys and c != seq]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), seq).alias("__r"))
    return best.select(*[F.col(f"__r.{c}").alias(c) if c in others else F.col(c) for c in rows.columns if c != seq])


def first_by_key(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order; ranks are cut before the shuffle."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("__k", place).where("__k = 1").drop("__k")


def overwrite(old: DataFrame, new: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """New rows replace old ones of the same key; of several new ones the last by ``seq`` counts."""
    plain = [c for c in new.columns if c != seq]
    both = keyed(old, keys).select(*plain).withColumn(seq, F.lit(None).cast(new.schema[seq].dataType)).unionByName(keyed(new, keys))
    ordered = both.withColumn("__s", F.struct(F.col(seq).isNotNull(), F.col(seq))).drop(seq)
    return last_by_key(ordered, keys, "__s")


def folded(new: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """Several new rows of a key as one: the last scalar that isn't null, lists joined in input order."""
    made = []
    for f in new.schema.fields:
        if f.name in keys or f.name == seq:
            continue
        if f.dataType.typeName() == "array":
            held = F.array_sort(F.collect_list(F.when(F.col(f.name).isNotNull(), F.struct(F.col(seq).alias("s"), F.col(f.name).alias("v")))))
            made.append(F.array_distinct(F.flatten(F.transform(held, lambda x: x["v"]))).alias(f.name))
        else:
            made.append(F.max_by(F.col(f.name), F.when(F.col(f.name).isNotNull(), F.col(seq))).alias(f.name))
    return keyed(new, keys).groupBy(*keys).agg(*made)


def merge(old: DataFrame, new: DataFrame, keys: list[str], seq: str = "seq", policy: str = "merge") -> DataFrame:
    """Scalars keep the old value where the new one is null; lists are joined, the old order first."""
    if policy not in POLICIES:
        raise ValueError(f"unknown policy {policy!r}; known: {', '.join(POLICIES)}")
    if policy == "overwrite":
        return overwrite(old, new, keys, seq)
    once = folded(blank_to_null(keyed(new, keys), [*keys, seq]), keys, seq)
    o, n = keyed(old, keys).alias("o"), once.alias("n")
    made = []
    for f in old.schema.fields:
        a, b = F.col(f"o.{f.name}"), F.col(f"n.{f.name}")
        if f.name in keys:
            made.append(F.col(f.name))
        elif f.dataType.typeName() == "array":
            empty = F.array().cast(f.dataType)
            made.append(F.array_union(F.coalesce(a, empty), F.coalesce(b, empty)).alias(f.name))
        else:
            made.append(F.coalesce(b, a).alias(f.name))
    return o.join(n, keys, "full_outer").select(*made)


def merge_table(name: str, old: DataFrame, new: DataFrame, seq: str = "seq") -> DataFrame:
    keys, policy = TABLES[name]
    return merge(old, new, list(keys), seq, policy)


def merge_papers(old: DataFrame, new: DataFrame, verification: list[str], key: str = "key") -> DataFrame:
    """Content columns keep what they had unless the new value isn't empty; verification columns are replaced whole. Columns that one side lacks are null there."""
    old, new = aligned(old, new)
    fresh = blank_to_null(new, [key, *verification])
    o, n = old.alias("o"), fresh.withColumn("__new", F.lit(True)).alias("n")
    made = [F.col(key)]
    for c in old.columns:
        if c == key:
            continue
        a, b = F.col(f"o.{c}"), F.col(f"n.{c}")
        made.append((F.when(F.col("__new"), b).otherwise(a) if c in verification else F.coalesce(b, a)).alias(c))
    return o.join(n, key, "full_outer").select(*made)


def cache_put(cache: DataFrame, answers: DataFrame, keys: list[str] = ("source", "key"), seq: str = "seq") -> DataFrame:
    """Lookup answers replace older ones; an empty key is never stored."""
    return overwrite(cache, answers.where(F.coalesce("key", F.lit("")) != ""), list(keys), seq)


def cache_misses(wanted: DataFrame, cache: DataFrame, keys: list[str] = ("source", "key")) -> DataFrame:
    """What has to be fetched. A stored null is an answer, not a miss."""
    return wanted.join(cache.select(*keys), list(keys), "left_anti")
