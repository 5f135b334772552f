"""Language identification by the nearest centroid.

A text is its vector of hashed byte-trigram weights over its letters (whatever
lies between letters counts as one blank): damped counts times inverse document
frequency, scaled to length one. Each language has several centroids, found by
spherical k-means among the sampled texts that lie nearest to the mean of their
own language; the nearest by cosine names the language. A text too far from all
of them is rejected: one whose cosine is below what nearly all sampled texts of
that language and length reach, or no higher than the same weights would reach
in slots drawn at random.

Document frequencies cover all training texts. Centroids and limits are fitted
on a bounded sample of labelled rows (``SAMPLE``, shared evenly by the
languages; rows are drawn one by one, so copies of a text count by their share
of the language, and no language's draw depends on another's).

Defined cases: a null text and one without a letter are ``und``, with score 0
and rejected; repeated rows are judged alike; if nothing can be learned all
texts are ``und``; of equally near centroids the first by language name wins;
of more than ``SAMPLE`` languages the most frequent are learned. Other columns
pass through when they are kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmill.llm.common import annotate, fold, kept, steps

BITS = 13
SIZE = 1 << BITS
SAMPLE = 4000
CLUSTERS = 3
UNKNOWN = "und"
LETTER = re.compile(r"[^\W\d_]")
#: Texts are rejected below this share of the cosine, scaled by length, that all but RARE of their language's sample reach.
FAR = 0.8
RARE = 0.005
#: Trigrams at which the cosine of a text is 1 / sqrt(2) of what a very long one reaches; texts that settle half a limit.
SHORT = 100
FEW = 10
#: And below this many standard deviations above the mean cosine of random slots.
CHANCE = 3.0
#: Texts whose vectors are held at once.
ROWS = 64
STEP_BYTES = 4_000_000
#: ASCII bytes other than small letters read as blanks.
SPACED = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def readable(text: str | None) -> bool:
    """Whether there is a letter; the pattern also takes numbers such as ²."""
    found = LETTER.search(text) if text else None
    return found is not None and (found[0].isalpha() or any(map(str.isalpha, text)))


def counts(texts: list[str | None]) -> np.ndarray:
    """A row of hashed trigram counts per text."""
    out = np.zeros((len(texts), SIZE), np.float32)
    held, size, first = [], 0, 0
    for i, text in enumerate(texts):
        raw = f" {text.lower()} ".encode(errors="replace") if text else b""
        held.append(raw)
        size += len(raw)
        if size > STEP_BYTES or i == len(texts) - 1:
            _count(held, out, first)
            held, size, first = [], 0, i + 1
    return out


def _count(raws: list[bytes], out: np.ndarray, first: int) -> None:
    joined = np.frombuffer(b"".join(raws).translate(SPACED), np.uint8)
    owner = np.repeat(np.arange(len(raws)), [len(r) for r in raws])
    if len(joined) < 3:
        return
    said = np.ones(len(joined), bool)
    said[1:] = (joined[1:] != 32) | (joined[:-1] != 32) | (owner[1:] != owner[:-1])
    joined, owner = joined[said].astype(np.uint32), owner[said]
    code = (joined[:-2] << np.uint32(16)) | (joined[1:-1] << np.uint32(8)) | joined[2:]
    slot = (code * np.uint32(2654435761)) >> np.uint32(32 - BITS)
    same = owner[:-2] == owner[2:]
    where = owner[:-2][same] * SIZE + slot[same]
    out[first : first + len(raws)] = np.bincount(where, minlength=len(raws) * SIZE).reshape(len(raws), SIZE)


def reach(trigrams: np.ndarray) -> np.ndarray:
    """How much of a long text's cosine one of so many trigrams has."""
    return np.sqrt(trigrams / (trigrams + SHORT))


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.sqrt((rows * rows).sum(axis=1, keepdims=True)), 1e-12)


@dataclass
class Centroids:
    idf: np.ndarray
    vectors: np.ndarray
    labels: list[str]
    #: Per centroid, the smallest cosine of a very long text that isn't rejected.
    far: np.ndarray

    def weigh(self, tally: np.ndarray) -> np.ndarray:
        return unit(np.log1p(tally) * self.idf)

    def predict(self, texts: list[str | None]) -> list[list]:
        """Language, score and whether the text is rejected."""
        legible = list(map(readable, texts))
        if not self.labels or not texts:
            return [[UNKNOWN] * len(texts), [0.0] * len(texts), [True] * len(texts)]
        damped = counts(texts)
        long = reach(damped.sum(axis=1))
        np.log1p(damped, out=damped)
        near = unit(damped * self.idf) @ self.vectors.T
        best = near.argmax(axis=1)
        least = np.maximum(self.far[best] * long, self.chance(damped, best)).tolist()
        cosine = np.clip(near.max(axis=1), 0, 1).astype(float).tolist()
        langs = [self.labels[k] if ok else UNKNOWN for k, ok in zip(best, legible, strict=True)]
        scores = [c if ok else 0.0 for c, ok in zip(cosine, legible, strict=True)]
        return [langs, scores, [not ok or c < f for c, f, ok in zip(cosine, least, legible, strict=True)]]

    def chance(self, damped: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """The cosine to its centroid that a row's damped counts hardly exceed in slots drawn at random."""
        spread = damped.sum(axis=1) / np.maximum(np.sqrt(np.einsum("ij,ij->i", damped, damped)), 1e-12)
        each = self.idf * self.vectors
        scale = np.sqrt((self.idf * self.idf).mean())
        return (spread * each.mean(axis=1)[owner] + CHANCE * each.std(axis=1)[owner]) / scale


def document_frequencies(docs: DataFrame, text: str) -> tuple[int, np.ndarray]:
    """Number of texts, and of those with each hashed trigram, over all rows."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, df = 0, np.zeros(SIZE, np.int64)
        for part in steps(batches, ROWS):
            df += (counts(part.column(0).to_pylist()) > 0).sum(axis=0)
            total += part.num_rows
        slots = np.append(np.flatnonzero(df), SIZE)
        yield pa.RecordBatch.from_arrays([pa.array(slots.astype(np.int32)), pa.array(np.append(df[df > 0], total))], names=["slot", "n"])

    rows = docs.select(F.col(text).cast("string").alias("t")).mapInArrow(tally, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(SIZE + 1, np.int64)
    for r in rows:
        df[r["slot"]] = r["n"]
    return int(df[SIZE]), df[:SIZE]


def clusters(rows: np.ndarray, k: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """Spherical k-means from randomly drawn rows."""
    rng = np.random.default_rng(seed)
    centres = rows[rng.choice(len(rows), min(k, len(rows)), replace=False)]
    for _ in range(rounds):
        owner = (rows @ centres.T).argmax(axis=1)
        centres = np.vstack([unit(rows[owner == c].mean(axis=0, keepdims=True)) if (owner == c).any() else centres[c : c + 1] for c in range(len(centres))])
    return centres


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", sample: int = SAMPLE, k: int = CLUSTERS) -> Centroids:
    """From labelled rows; those without a label or a letter teach nothing."""
    source = docs.select(F.col(text).cast("string").alias("t"), F.col(lang).cast("string").alias("l")).where("t is not null and l is not null")
    total, df = document_frequencies(source, "t")
    idf = (np.log((1 + total) / (1 + df)) + 0.05).astype(np.float32)
    empty = Centroids(idf, np.zeros((0, SIZE), np.float32), [], np.zeros(0))
    sizes = {r["l"]: r["count"] for r in source.groupBy("l").count().orderBy(F.desc("count"), "l").limit(sample).collect()}
    if not sizes:
        return empty
    share = max(1, sample // len(sizes))
    odds = docs.sparkSession.createDataFrame([(name, min(1.0, share / n)) for name, n in sizes.items()], "l string, odds double")
    drawn = source.join(F.broadcast(odds), "l").where(F.rand(3) < F.col("odds"))
    tallied = T.StructType().add("slots", T.BinaryType()).add("tally", T.BinaryType())

    def sparse(texts: list[str | None]) -> list[list]:
        rows = counts(texts)
        found = [np.flatnonzero(r) for r in rows]
        return [[f.astype("<u2").tobytes() for f in found], [r[f].astype("<f4").tobytes() for r, f in zip(rows, found, strict=True)]]

    tallies: dict[str, list[tuple[bytes, bytes]]] = {}
    for r in annotate(drawn, "t", ("l",), tallied, sparse, ROWS).collect():
        if r["slots"]:
            tallies.setdefault(r["l"], []).append((bytes(r["slots"]), bytes(r["tally"])))
    names = sorted(tallies)
    if not names:
        return empty
    vectors, trigrams, distinct = [], [], []
    for name in names:
        mine = sorted(tallies.pop(name))
        rows = np.zeros((len(mine), SIZE), np.float32)
        for row, (slots, tally) in zip(rows, mine, strict=True):
            row[np.frombuffer(slots, "<u2")] = np.frombuffer(tally, "<f4")
        trigrams.append(rows.sum(axis=1))
        vectors.append(empty.weigh(rows))
        distinct.append(len(set(mine)))
    centroids = [clusters(rows[own], k) for rows, own in zip(vectors, typical(vectors), strict=True)]
    usual = [np.quantile((r @ c.T).max(axis=1) / reach(n), RARE) * m / (m + FEW) for r, c, n, m in zip(vectors, centroids, trigrams, distinct, strict=True)]
    owner = np.repeat(np.arange(len(names)), [len(c) for c in centroids])
    return Centroids(idf, np.vstack(centroids).astype(np.float32), [names[i] for i in owner], FAR * np.array(usual)[owner])


def typical(vectors: list[np.ndarray], rounds: int = 5) -> list[np.ndarray]:
    """Per language, which rows lie nearest to the mean of such rows of their own language; all, where none would be left."""
    own = [np.ones(len(rows), bool) for rows in vectors]
    for _ in range(rounds):
        means = np.vstack([unit(rows[mine].mean(axis=0, keepdims=True)) for rows, mine in zip(vectors, own, strict=True)])
        near = [(rows @ means.T).argmax(axis=1) == i for i, rows in enumerate(vectors)]
        own = [mine if mine.any() else np.ones(len(mine), bool) for mine in near]
    return own


def identify(docs: DataFrame, model: Centroids, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Kept columns with lang_pred, score and rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    out = T.StructType().add("lang_pred", "string").add("score", "double").add("rejected", "boolean")
    return annotate(docs, text, keep, out, lambda texts: shared.value.predict(texts), ROWS)


def identified(docs: DataFrame, model: Centroids, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that aren't rejected, with their own columns."""
    return kept(docs, text, lambda d, t, tags: identify(d, model, t, tags), ~F.col("rejected"))


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.where((fold(F.col("doc_id"), 5) != 0) & F.col("lang").isNotNull())


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = identify(docs, fit(training_rows(docs)))
    return found.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score", "rejected")
