"""SimHash near-duplicate detection over word shingles.

Fingerprints come from one pass over the texts. Links are sought among distinct
fingerprints only, so exact copies cost nothing: fingerprints are cut into
blocks, any two within the distance agree on some choice of blocks (pigeonhole),
a join on the chosen blocks proposes pairs, and the Hamming distance verifies
them. In a bucket of very many fingerprints no pairs are formed: two values
differ in at most two bits exactly if both lie within one bit of a common
midpoint, so each value is sent to its own 65 midpoints and linked to the
smallest value there. A midpoint has at most 65 neighbours, hence groups stay
small, and the links connect the same fingerprints as all pairs would.

Defined cases: null and empty texts have fingerprint zero and are linked like
any other; repeated rows are copies of each other; documents with a null key
take part, and a group of only such has a null component; an empty table gives
no rows. Other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmill.llm.common import annotate, ensure_checkpoint_dir, stored

DISTANCE = 2
BLOCKS = 5
PAIRED = 48
STEP = 1 << 16


def simhash(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """64-bit fingerprint, as a signed number: a bit is 1 if it is set in over half of the shingles' hashes."""
    from xxhash import xxh64_intdigest

    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    if len(words) <= shingle:
        hashes = np.array([xxh64_intdigest(b" ".join(words), seed)], np.uint64)
    else:
        joined = b" ".join(words)
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = [0, *ends[: len(words) - shingle].tolist()]
        stops = (ends[shingle - 1 :] - 1).tolist()
        hashes = np.fromiter((xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts, stops, strict=True)), np.uint64, len(starts))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), STEP):
        ones += np.unpackbits(hashes[at : at + STEP].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Kept columns with ``fp``."""
    out = T.StructType().add("fp", "long")
    return annotate(docs, text, keep, out, lambda texts: [[simhash(t) for t in texts]])


def block_masks(distance: int = DISTANCE, blocks: int = BLOCKS) -> list[int]:
    """For each choice of ``blocks - distance`` blocks, the bits that it covers, as signed 64-bit numbers."""
    edges = [round(i * 64 / blocks) for i in range(blocks + 1)]
    single = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]
    masks = [sum(c) for c in combinations(single, blocks - distance)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def links(values: DataFrame) -> DataFrame:
    """From distinct ``fp`` to edges (a, b) that connect whatever is within two bits of each other."""
    keys = F.array(*[F.struct(F.lit(i).alias("choice"), F.col("fp").bitwiseAND(F.lit(m)).alias("bits")) for i, m in enumerate(block_masks())])
    keyed = values.select("fp", F.explode(keys).alias("k")).select("fp", "k.choice", "k.bits")
    sizes = keyed.groupBy("choice", "bits").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = stored(keyed.join(sizes, ["choice", "bits"]), "buckets")

    few = shared.where(F.col("n") <= PAIRED)
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE
    pairs = few.withColumnRenamed("fp", "a").join(few.select("choice", "bits", F.col("fp").alias("b")), ["choice", "bits"]).where((F.col("a") < F.col("b")) & near).select("a", "b")

    many = shared.where(F.col("n") > PAIRED).select("fp").distinct()
    flips = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit((1 << i) - (1 << 64 if i == 63 else 0))) for i in range(64)])
    stars = many.select("fp", F.explode(flips).alias("mid")).groupBy("mid").agg(F.collect_set("fp").alias("all")).where(F.size("all") > 1)
    spokes = stars.select(F.array_min("all").alias("a"), F.explode("all").alias("b")).where((F.col("a") < F.col("b")) & near)
    return pairs.union(spokes).distinct()


def roots(edges: DataFrame) -> DataFrame:
    """Connected components by alternating large and small stars: (node, root), for nodes that have edges.

    Every round but the last brings nodes nearer to their smallest one, so the
    rounds, about as many as the logarithm of the longest chain, come to an end.
    """
    spark = edges.sparkSession
    ensure_checkpoint_dir(spark)
    tally = lambda e: tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    edges = edges.select("a", "b").checkpoint()
    before = tally(edges)
    while before[0]:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        down = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(down, "b").where("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b")).union(down.select(F.col("m").alias("a"), "b"))
        edges = small.distinct().checkpoint()
        after = tally(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))


def components(rows: DataFrame, key: Column | str) -> DataFrame:
    """Adds ``component``, the smallest key reachable over links, to rows that have ``fp``. ``rows`` is read several times."""
    key = F.col(key) if isinstance(key, str) else key
    values = stored(rows.groupBy("fp").agg(F.min(key).alias("least")), "values")
    found = roots(links(values.select("fp")))
    rooted = values.join(found, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component")), "root").select("fp", "component")
    return rows.join(named, "fp", "left")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: its id, ``fp`` and ``component``."""
    rows = stored(fingerprints(docs, text, (doc_id,)), "fingerprints")
    return components(rows, doc_id)


def distinct_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` less near-duplicates: of each group the row of the smallest id stays, once.

    Rows are known by their id and a hash of their text, which don't depend on
    how ``docs`` is cut into partitions; of rows that share both, any one stays.
    """
    row = "__row"
    while row in docs.columns:
        row += "_"
    named = docs.withColumn(row, F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    rows = stored(fingerprints(named, text, (doc_id, row)), "fingerprints")
    key = F.struct(F.col(doc_id), F.col(row))
    first = components(rows, key).where(key == F.col("component")).groupBy(F.col(doc_id).alias("__i"), F.col(row).alias("__h"))
    kept = stored(first.agg(F.count(F.lit(1)).alias("__n")), "kept")
    among = lambda ids: named.join(ids, named[doc_id].eqNullSafe(ids["__i"]) & (named[row] == ids["__h"]), "left_semi")
    once = among(kept.where("__n = 1")).drop(row)
    if not kept.where("__n > 1").take(1):
        return once
    return once.unionByName(among(kept.where("__n > 1")).dropDuplicates([doc_id, row]).drop(row))


def op8_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))
