"""Toxicity by multiple-instance learning.

A document is a bag of distinct sentences, and only documents are labelled. A
sentence's probability is logistic in its words and word beginnings; a
document's is the noisy-or of its sentences and of a leak that all documents
share: the chance of a label that no sentence explains, learned as well, so
that it isn't laid upon the sentences, of which long clean texts have many. The
weights are trained through the same noisy-or from document labels, which
leaves the blame with the sentences that carry it, so they locate them.

The classifier is fitted on a bounded sample of labelled texts (``SAMPLE`` of
each label, drawn by id, and row by row where ids repeat), weighted back to
the share of their label; words of fewer than ``LEAST_TEXTS`` sampled texts
have no weight.

Defined cases: a null or empty text has no sentence and the leak's score;
repeated rows are scored alike, and a sentence that a text repeats counts once;
labels other than 0 and 1 and null labels teach nothing; a document with
several labels counts once for each; without both labels all scores are 0;
sentences of a text are counted however many they are. Other columns pass
through when they are kept.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmill.llm.common import annotate, fold, kept
from quillmill.llm.vocab import Memo

BITS = 18
SIZE = 1 << BITS
SAMPLE = 2000
THRESHOLD = 0.3
STEMS = (4, 5)
ROUNDS = 120
LEAST_TEXTS = 3
#: How many texts a clean one counts for in training: a marker that one sentence has by chance stays below the threshold, two sentences with one pass it.
CLEAN_WEIGHT = 1.25
#: Pull of the weights towards zero, in texts: what this many texts say doesn't move a weight.
LASSO = 0.5
#: Belief before training: this share of texts, each of so many sentences without weights, would be clean.
PLAIN = (0.02, 5000)
#: Logits of a sentence without weights and of the leak before training, and after it where nothing can be learned.
START = (-9.0, -9.0)
NEVER = (-50.0, -50.0)
STOP = re.compile(r"[.!?\n]+")
SENTENCE = re.compile(r"[^.!?\n]+")
#: Word weights that a task keeps at hand.
WORDS = 150_000
EDGE = "\t\r\x0b\x0c ,;:\"'()[]{}<>*#&$%|-_"


def features(word: str) -> list[int]:
    """Slots of a word and of its first letters."""
    word = word.strip(EDGE)
    if not word:
        return []
    stems = [f"{n}:{word[:n]}" for n in STEMS if len(word) > n]
    return [crc32(x.encode()) & (SIZE - 1) for x in [word, *stems]]


def sentences(text: str | None) -> list[set[str]]:
    """Distinct words of each distinct sentence, lower-cased."""
    return [set(s.split()) for s in dict.fromkeys(STOP.split(text.lower())) if s and not s.isspace()] if text else []


@dataclass
class Scorer:
    weights: np.ndarray
    bias: float
    leak: float

    def __post_init__(self):
        self.words = Memo(self._word, WORDS)

    def __getstate__(self):
        return {"weights": self.weights, "bias": self.bias, "leak": self.leak}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.__post_init__()

    def _word(self, word: str) -> tuple[int, ...]:
        return tuple(f for f in features(word) if self.weights[f])

    def logit(self, words: set[str]) -> float:
        """Of a sentence; a feature that several of its words share counts once, as in training."""
        return self.bias + sum(float(self.weights[f]) for f in sorted(set().union(*map(self.words.__getitem__, words))))

    def forget(self) -> None:
        self.words.forget()

    def logits(self, text: str | None) -> np.ndarray:
        return np.array([self.logit(s) for s in sentences(text)], float)

    def score(self, text: str | None) -> float:
        return float(-np.expm1(-np.logaddexp(0, self.logits(text)).sum() - np.logaddexp(0, self.leak)))

    def offending(self, text: str | None, least: float = THRESHOLD) -> list[dict]:
        """Spans, in code points, of the sentences that reach ``least``, with their probabilities."""
        found = []
        for m in SENTENCE.finditer(text or ""):
            if not m[0].isspace():
                z = self.logit(set(m[0].lower().split()))
                if (p := float(1 / (1 + np.exp(-z)))) >= least:
                    found.append({"start": m.start(), "end": m.end(), "score": p})
        return found


class Adam:
    """Steps upwards along a gradient."""

    def __init__(self, shape: tuple[int, ...] = ()):
        self.first, self.second, self.rounds = np.zeros(shape), np.zeros(shape), 0

    def step(self, gradient: np.ndarray, rate: float) -> np.ndarray:
        self.rounds += 1
        self.first += 0.1 * (gradient - self.first)
        self.second += 0.01 * (gradient * gradient - self.second)
        return rate * (self.first / (1 - 0.9**self.rounds)) / (np.sqrt(self.second / (1 - 0.99**self.rounds)) + 1e-8)


def train(slots: np.ndarray, lengths: np.ndarray, counts: np.ndarray, labels: np.ndarray, weights: np.ndarray, rounds: int = ROUNDS, lasso: float = LASSO, least: int = LEAST_TEXTS) -> Scorer:
    """Full-batch Adam on the log-likelihood of document labels under the noisy-or, less the weights' sizes times ``lasso`` texts, beside the belief ``PLAIN``.

    ``slots`` are the features of all sentences, ``lengths`` how many each
    sentence has, ``counts`` how many sentences each document has. A weight
    that would change its sign stops at zero, and leaves it only if its pull
    exceeds the lasso's.
    """
    sentence = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
    doc = np.repeat(np.arange(len(counts)), counts)
    seen = np.zeros(SIZE, np.int32)
    for part in np.split(slots, np.cumsum(np.bincount(doc, lengths, len(counts)).astype(np.int64))[:-1]):
        seen[np.unique(part)] += 1
    some = (seen >= least)[slots]
    slots, sentence = slots[some].astype(np.int64), sentence[some].astype(np.int64)
    del some
    share, pull_back = weights / weights.sum(), lasso / weights.sum()
    w, (bias, leak) = np.zeros(SIZE), START
    by_weight, by_bias, by_leak = Adam((SIZE,)), Adam(), Adam()
    for t in range(1, rounds + 1):
        z = np.bincount(sentence, w[slots], len(lengths)) + bias
        clean = np.bincount(doc, np.logaddexp(0, z), len(counts)) + np.logaddexp(0, leak)  # -log of the probability that nothing offends
        pull = np.where(labels == 1, 1 / np.expm1(np.maximum(clean, 1e-9)), -1.0) * share
        g = pull[doc] / (1 + np.exp(-z))
        gw = np.bincount(slots, g[sentence], SIZE)
        gw = np.where(w != 0, gw - pull_back * np.sign(w), np.sign(gw) * np.maximum(np.abs(gw) - pull_back, 0))
        rate = 0.15 * (1 - 0.8 * t / rounds)
        moved = w + by_weight.step(gw, rate)
        crossed = moved * w < 0
        moved[crossed] = by_weight.first[crossed] = 0
        w = moved
        bias += by_bias.step(g.sum() - PLAIN[0] * PLAIN[1] / (1 + np.exp(-bias)), rate)
        leak += by_leak.step(pull.sum() / (1 + np.exp(-leak)), rate)
    return Scorer(w.astype(np.float32), float(bias), float(leak))


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> Scorer:
    """From documents whose ids have a label; at most about ``sample`` texts of either label reach the driver, as feature slots."""
    marks = labels.select(F.col(doc_id).alias("d"), F.col(label).cast("integer").alias("y")).where("y in (0, 1)").distinct()
    sizes = {r["y"]: r["count"] for r in marks.groupBy("y").count().collect()}
    if len(sizes) < 2:
        return Scorer(np.zeros(SIZE, np.float32), *NEVER)
    lot = F.pmod(F.xxhash64("d", F.lit(11)), F.lit(1_000_000))
    share = {y: min(1.0, sample / n) for y, n in sizes.items()}
    drawn = marks.where(F.when(F.col("y") == 1, lot < int(1e6 * share[1]) + 1).otherwise(lot < int(1e6 * share[0]) + 1))
    rows = docs.select(F.col(doc_id).alias("d"), F.col(text).cast("string").alias("t")).join(F.broadcast(drawn), "d")
    for r in rows.groupBy("y").count().collect():
        if r["count"] > 1.5 * sample:  # ids that repeat
            odds = sample / r["count"]
            rows = rows.where((F.col("y") != r["y"]) | (F.rand(11) < odds))
            share[r["y"]] *= odds
    out = T.StructType().add("slots", T.BinaryType()).add("lengths", T.BinaryType())

    def bags(texts: list[str | None]) -> list[list]:
        found = [[np.array(sorted({f for w in s for f in features(w)}), "<u4") for s in sentences(t)] for t in texts]
        return [[np.concatenate(b).astype("<u4").tobytes() if b else b"" for b in found], [np.array([len(s) for s in b], "<u4").tobytes() for b in found]]

    made = sorted(annotate(rows, "t", ("y",), out, bags).collect(), key=lambda r: (r["y"], bytes(r["slots"]), bytes(r["lengths"])))
    y = [r["y"] for r in made]
    if len(set(y)) < 2:
        return Scorer(np.zeros(SIZE, np.float32), *NEVER)
    slots, lengths = (np.concatenate([np.frombuffer(r[c], "<u4") for r in made]) for c in ("slots", "lengths"))
    counts = np.array([len(r["lengths"]) // 4 for r in made])
    del made
    y = np.array(y)
    back = np.where(y == 1, 1 / share[1], CLEAN_WEIGHT / share[0])
    if not len(lengths):
        return Scorer(np.zeros(SIZE, np.float32), *NEVER)
    return train(slots, lengths.astype(np.int64), counts, y, back)


def toxicity(docs: DataFrame, scorer: Scorer, text: str = "text", keep: tuple[str, ...] = ("doc_id",), locate: bool = True) -> DataFrame:
    """Kept columns with score, predicted and, of documents that are predicted toxic, the offending sentences."""
    shared = docs.sparkSession.sparkContext.broadcast(scorer)
    span = T.StructType().add("start", "integer").add("end", "integer").add("score", "double")
    out = T.StructType().add("score", "double").add("predicted", "integer").add("offending", T.ArrayType(span))

    def worker(texts: list[str | None]) -> list[list]:
        s = shared.value
        scores = [s.score(t) for t in texts]
        return [scores, [int(x >= THRESHOLD) for x in scores], [s.offending(t) if locate and x >= THRESHOLD else [] for t, x in zip(texts, scores, strict=True)]]

    return annotate(docs, text, keep, out, worker, done=lambda: shared.value.forget())


def civil(docs: DataFrame, scorer: Scorer, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that aren't predicted toxic, with their own columns."""
    return kept(docs, text, lambda d, t, tags: toxicity(d, scorer, t, tags, locate=False), F.col("predicted") == 0)


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.where(fold(F.col("doc_id"), 4) != 2)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scorer = fit(training_rows(docs), training_rows(labels))
    found = toxicity(docs, scorer)
    return found.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", "predicted", F.size("offending").alias("n_offending"))
