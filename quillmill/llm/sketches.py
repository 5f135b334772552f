"""Bottom-k document fingerprints, in DataFrame functions alone.

A fingerprint is the ascending array of the ``k`` smallest distinct hashes of a
text's word shingles. Two of them merge into the fingerprint of both parts, and
estimate resemblance, containment and the number of distinct shingles; below
``k`` shingles all of these are exact.

Defined cases: a null text counts as empty and has an empty fingerprint; two
empty ones resemble each other fully, an empty and a full one not at all; a
text of fewer words than a shingle has one shingle, the whole. Rows are never
merged, and columns other than those named are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

K = 128
SHINGLE = 5
GROUP_BITS = 8


def fingerprint(text: Column, k: int = K, shingle: int = SHINGLE) -> Column:
    """Array of the ``k`` smallest shingle hashes."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[ \\t-\\r]+"), lambda w: w != "")
    return bottom(_shingles(F.transform(words, lambda w: F.xxhash64(w)), shingle), k)


def _shingles(hashed: Column, shingle: int) -> Column:
    """Hashes of runs of ``shingle`` word hashes; ``hashed`` is bound once, by a transform over a single element."""

    def runs(h: Column) -> Column:
        last = F.greatest(F.size(h) - shingle, F.lit(0))
        some = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(shingle)]))
        return F.when(F.size(h) == 0, F.array().cast("array<bigint>")).otherwise(some)

    return F.element_at(F.transform(F.array(hashed), runs), 1)


def bottom(hashes: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def merged(a: Column, b: Column, k: int = K) -> Column:
    """Fingerprint of both parts together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Share of distinct shingles of either text that both have."""
    union = merged(a, b, k)
    both = F.size(F.array_intersect(F.array_intersect(union, a), b))
    return F.when(F.size(union) == 0, 1.0).otherwise(both / F.size(union))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles: exact below ``k``."""
    spread = (F.element_at(a, -1).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / spread)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Share of the first text's distinct shingles that the second has."""
    all_ = distinct_shingles(merged(a, b, k), k)
    own = distinct_shingles(a, k)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), resemblance(a, b, k) * all_ / own))


def merged_by(parts: DataFrame, keys: list[str], column: str, k: int = K) -> DataFrame:
    """One fingerprint a group: the k smallest hashes of all its parts, cut to k before and after the shuffle."""
    each = parts.select(*keys, F.explode(column).alias("__h"))
    each = each.distinct()
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("__h"))
    best = each.withColumn("__r", rank).where(F.col("__r") <= k)
    return best.groupBy(*keys).agg(F.sort_array(F.collect_list("__h")).alias(column))


def as_text(a: Column) -> Column:
    """16 hexadecimal digits a hash."""
    return F.lower(F.array_join(F.transform(a, lambda h: F.lpad(F.hex(h), 16, "0")), ""))


def successors(values: DataFrame, bits: int = 64) -> DataFrame:
    """Each distinct ``id`` with ``next_id``, the next smaller one; the smallest is followed by the largest.

    Ids are ordered in groups that share all but 16 bits, and the groups in
    turn, so no task ever holds more than 65,536 of them.
    """
    if bits <= 16:
        order = Window.orderBy(F.desc("id"))
        first = F.max("id").over(Window.partitionBy(F.lit(0)))
        return values.select("id", F.coalesce(F.lead("id").over(order), first).alias("next_id"))
    grouped = values.withColumn("g", F.shiftright("id", 16))
    within = grouped.withColumn("next_id", F.lead("id").over(Window.partitionBy("g").orderBy(F.desc("id"))))
    heads = grouped.groupBy("g").agg(F.max("id").alias("head"))
    after = successors(heads.select(F.col("g").alias("id")), bits - 16).withColumnsRenamed({"id": "g", "next_id": "next_g"})
    following = after.join(heads.select(F.col("g").alias("next_g"), "head"), "next_g").select("g", "head")
    return within.join(following, "g").select("id", F.coalesce("next_id", "head").alias("next_id"))


def with_next(docs: DataFrame, k: int = K) -> DataFrame:
    """doc_id, text, fp, and next_text, next_fp of the next document in descending id order (after the last, the first).

    Texts are shuffled once, into groups of up to 256 neighbouring ids; only
    the first and last document of a group meet those of another one. Equal
    ids are ordered by text; null ids come last.
    """
    lowest = -(1 << 61)
    group = F.coalesce(F.shiftright(F.col("doc_id"), GROUP_BITS), F.lit(lowest))
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    dealt = base.withColumn("g", group).repartition("g")
    order = Window.partitionBy("g").orderBy(F.desc_nulls_last("doc_id"), "text")

    inner = dealt.withColumn("fp", fingerprint(F.col("text"), k))
    inner = inner.withColumn("after", F.lead(F.struct("text", "fp")).over(order)).where("after is not null")
    inner = inner.select("doc_id", "text", "fp", F.col("after.text").alias("next_text"), F.col("after.fp").alias("next_fp"))

    placed = dealt.withColumn("rank", F.row_number().over(order)).withColumn("after", F.lead("g").over(order))
    heads = placed.where("rank = 1").select(F.col("g").alias("next_g"), F.col("text").alias("next_text"))
    tails = placed.where("after is null").select("doc_id", "text", "g")
    turn = successors(docs.select(group.alias("id")).distinct()).withColumnsRenamed({"id": "g", "next_id": "next_g"})
    edge = tails.join(turn, "g").join(heads, "next_g")
    edge = edge.select("doc_id", "text", fingerprint(F.col("text"), k).alias("fp"), "next_text", fingerprint(F.col("next_text"), k).alias("next_fp"))
    return inner.unionByName(edge)


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = with_next(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), (n - half)), F.substring(F.col("next_text"), F.lit(1), half))
    made = pairs.select("doc_id", "fp", "next_fp", n.cast("long").alias("n_chars"), edited.alias("edited"))
    made = made.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fp", "next_fp", fingerprint(F.col("edited")).alias("edited_fp"))
    return made.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_text(F.col("fp")).alias("fingerprint"),
        as_text(F.col("edited_fp")).alias("edited_fingerprint"),
        resemblance(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        resemblance(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )
