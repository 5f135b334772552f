"""A log-bilinear language model, trained by noise-contrastive estimation.

The vocabulary (``lbl.LEAVES``) is the most frequent words and, for all rarer
ones, groups by their last two bytes. The vectors of the last three words go
through a matrix for each position and predict the next; batched matrix products
with class and word vectors give the scores, which are normalised exactly, class
by class (see ``lbl``). Inside a group a word has its add-one share.

Training starts on the driver, with a sample of about ``WARM`` tokens, and goes
on in every task, which visits every position of each of its training texts once.
What the tasks learned is averaged, each word over its own occurrences; partial
means are of bounded size, so neither a task nor the driver holds more as the
corpus grows.

Word counts are exact for the whole corpus. The frequent words go out in a
broadcast dictionary of bounded size; occurrences of rarer ones meet their
counts in a join, so nothing that grows with the vocabulary is held by one task.

Defined cases: a null or empty text is its end token alone; null ids count as
the empty text when folds are dealt; repeated rows are scored one by one; an
empty table gives no rows; with no training rows all words are unknown. Other
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.llm.common import STEP_ROWS, fold, steps, stored
from quillmill.llm.lbl import LEAVES, Net, Total, learned

END = " "  # no word holds a blank
DICTIONARY = 200_000
GROUPS = 512
HEADS = LEAVES - 1 - GROUPS
#: Tokens of the first sample; the share of its texts that tell when to stop, and passes over it at most.
WARM = 400_000
ASIDE = 0.1
ROUNDS = 60
#: Partial means of each class of the vocabulary.
PARTS = 4
#: Counts that a task holds before they go out, those of one word in several steps apart.
FLUSH = 1_000_000
#: Bytes of rows that are cut into words at once.
READ_BYTES = 8 << 20


def words(text: str | None) -> list[bytes]:
    return text.encode().lower().split() if text else []


def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Steps of bounded bytes; a row that is larger is a step. Each costs a look at the whole dictionary, so they are no smaller."""
    for batch in batches:
        waiting = [batch]
        while waiting:
            part = waiting.pop()
            if part.nbytes > READ_BYTES and part.num_rows > 1:
                half = part.num_rows // 2
                waiting += [part.slice(half), part.slice(0, half)]
            elif part.num_rows:
                yield part


def cut(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """``words`` of all texts in a row, and how many each has."""
    found = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.string()), "")))
    flat, sizes = found.flatten(), pc.list_value_length(found).to_numpy().astype(np.int64)
    full = pc.binary_length(flat).to_numpy() > 0  # white space at either end of a text leaves an empty one
    if full.all():
        return flat, sizes
    before = np.concatenate([[0], np.cumsum(full)])
    return flat.filter(pa.array(full)), np.diff(before[np.concatenate([[0], np.cumsum(sizes)])])


def group(word: bytes) -> int:
    return 1 + HEADS + crc32(word[-2:]) % GROUPS


def group_of(word: Column) -> Column:
    raw = word.cast("binary")
    return (F.crc32(F.substring(raw, -2, 2)) % GROUPS + (1 + HEADS)).cast("int")


def word_counts(docs: DataFrame) -> DataFrame:
    """(token, c) over whole texts, the end token among them; counted per task before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        ends = 0

        def added() -> list[pa.RecordBatch]:
            tally = pa.concat_tables(held).group_by("token", use_threads=False).aggregate([("c", "sum")])
            return tally.select(["token", "c_sum"]).rename_columns(["token", "c"]).combine_chunks().to_batches()

        for part in read(batches):
            ends += part.num_rows
            found = pc.value_counts(cut(part.column(0))[0])
            held.append(pa.table({"token": found.field("values"), "c": found.field("counts")}))
            if sum(t.num_rows for t in held) > FLUSH:
                yield from added()
                held.clear()
        if ends:
            held.append(pa.table({"token": pa.array([END]), "c": pa.array([ends], pa.int64())}))
            yield from added()

    return docs.select("text").mapInArrow(count, "token string, c long").groupBy("token").agg(F.sum("c").alias("c"))


@dataclass
class Model:
    """What scoring needs; its size is bounded by DICTIONARY and LEAVES."""

    total: int
    types: int
    frequent: list[bytes]
    counts: np.ndarray
    ids: np.ndarray
    group_mass: np.ndarray  # log10, by leaf
    least: int
    net: Net
    _ready: dict = field(default_factory=dict)

    def __getstate__(self):
        return {**self.__dict__, "_ready": {}}

    def lookup(self) -> pa.Array:
        if "lookup" not in self._ready:
            self._ready["lookup"] = pa.array(self.frequent, pa.binary()).cast(pa.string())
        return self._ready["lookup"]

    def number(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array]:
        """Places in the dictionary (-1: rarer) and leaves of all tokens with their ends, where texts end, where the rarer words are, and those."""
        flat, sizes = cut(texts)
        stops = np.cumsum(sizes + 1)
        inner = np.ones(len(flat) + len(sizes), bool)
        inner[stops - 1] = False
        place = np.zeros(len(inner), np.int32)  # an end is the first of the dictionary
        place[inner] = found = pc.fill_null(pc.index_in(flat, self.lookup()), -1).to_numpy()
        rare = flat.filter(pa.array(found < 0))
        ids, at = self.ids[place], np.flatnonzero(place < 0)
        kinds = rare.dictionary_encode()
        if len(rare):
            ids[at] = np.array([group(w) for w in kinds.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False)], np.uint16)[kinds.indices.to_numpy()]
        return place, ids, stops, at, rare


def vocabulary(counts: DataFrame, dictionary: int = DICTIONARY) -> Model:
    """The frequent words of stored counts, found by a count threshold, and the mass of each class."""
    level = F.floor(F.log2("c") * 16).cast("int")
    levels = {r["l"]: r for r in counts.groupBy(level.alias("l")).agg(F.count(F.lit(1)).alias("n"), F.sum("c").alias("t"), F.min("c").alias("least")).collect()}
    least, taken = 1 << 62, 0
    for k in sorted(levels, reverse=True):
        taken += levels[k]["n"]
        if taken > dictionary:
            break
        least = levels[k]["least"]
    frequent = sorted(((r["c"], r["token"]) for r in counts.where(F.col("c") >= least).collect()), key=lambda x: (-x[0], x[1]))
    frequent = [x for x in frequent if x[1] != END]
    ends = counts.where(F.col("token") == END).first()
    frequent = [(ends["c"] if ends else 0, END), *frequent]
    names, tally = [w.encode() for _, w in frequent], np.array([c for c, _ in frequent], np.int64)
    ids = np.array([i if i <= HEADS else group(w) for i, w in enumerate(names)], np.uint16)
    mass = np.zeros((LEAVES, 2))
    for r in counts.where(F.col("token") != END).groupBy(group_of(F.col("token")).alias("k")).agg(F.sum("c").alias("t"), F.count(F.lit(1)).alias("n")).collect():
        mass[r["k"]] = r["t"], r["n"]
    for w, c in zip(names[1 : HEADS + 1], tally[1 : HEADS + 1].tolist(), strict=True):
        mass[group(w)] -= c, 1
    heads = tally[: HEADS + 1]
    leaves = np.concatenate([heads, np.zeros(HEADS + 1 - len(heads)), mass[HEADS + 1 :, 0] + 1])  # something unseen may belong to any group
    shares = np.log10(np.maximum(mass.sum(axis=1) + 1, 1))
    return Model(sum(r["t"] for r in levels.values()), sum(r["n"] for r in levels.values()), names, tally, ids, shares, least, Net.new(leaves))


def pieces(docs: DataFrame, shared) -> DataFrame:
    """(ids, lengths): the leaves of texts, a few hundred texts a row."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in steps(batches):
            if part.num_rows:
                _, ids, stops, _, _ = shared.value.number(part.column(0))
                row = [ids.astype("<u2").tobytes()], [np.diff(stops, prepend=0).astype("<u4").tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in row], names=["ids", "lengths"])

    return docs.select("text").mapInArrow(number, "ids binary, lengths binary")


def warmed(docs: DataFrame, model: Model, shared, sample: int = WARM) -> Net:
    """A net trained on a sample of texts, on the driver, for as long as texts set aside become likelier."""
    net, rng = model.net.copy(), np.random.default_rng(3)
    some = docs.where(F.rand(5) < sample / max(model.total, 1)) if model.total > sample else docs
    rows = sorted((bytes(r["ids"]), bytes(r["lengths"])) for r in pieces(some, shared).collect())
    ids, lengths = (np.frombuffer(b"".join(r[k] for r in rows), kind) for k, kind in ((0, "<u2"), (1, "<u4")))
    if not len(lengths):
        return net
    first = int(len(lengths) * ASIDE)
    starts = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
    cut = starts[first]
    judge = lambda: net.log10(ids[:cut], starts[:first]).mean() if first else 0.0
    best, kept = judge(), net.copy()
    for _ in range(ROUNDS if first else 3):
        net.train(ids[cut:], starts[first:-1] - cut, rng)
        now = judge()
        if now < best:
            break
        best, kept = now, net.copy()
    return kept


MEANS = ["class", "part", "met", "tally", "change"]
KINDS = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]


def mean_rows(found: list[tuple], part: int) -> pa.RecordBatch:
    columns = zip(*[(k, part, *rest) for k, *rest in found], strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, KINDS, strict=True)], names=MEANS)


def lessons(docs: DataFrame, shared) -> DataFrame:
    """What the tasks learn in a pass over all positions of all texts, averaged in a few parts for each class of the vocabulary."""

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        start, rng, tally = shared.value.net, np.random.default_rng(task), np.zeros(LEAVES, np.int64)
        net = start.copy()
        for part in read(batches):
            _, ids, stops, _, _ = shared.value.number(part.column(0))
            starts = np.concatenate([[0], stops])
            for at in range(0, part.num_rows, STEP_ROWS):
                of = starts[at : at + STEP_ROWS + 1]
                some = ids[of[0] : of[-1]]
                visited = net.train(some, of[:-1] - of[0], rng)
                tally += np.bincount(some[visited], minlength=LEAVES)
        if tally.any():
            yield mean_rows(learned(start, net, tally), task % PARTS)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, Total] = {}
        for batch in batches:
            for k, part, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                totals.setdefault(part, Total()).add(k, *rest)
        for part, total in totals.items():
            yield mean_rows(total.means(), part)

    schema = "class int, part int, met binary, tally binary, change binary"
    return docs.select("text").mapInArrow(learn, schema).repartition("class", "part").mapInArrow(merge, schema)


def taught(docs: DataFrame, model: Model, shared) -> Net:
    """The model's net after a pass over all texts, task by task, and the mean of what the tasks learned."""
    total = Total()
    for r in sorted(lessons(docs, shared).collect(), key=lambda r: (r["class"], r["part"])):
        total.add(r["class"], bytes(r["met"]), bytes(r["tally"]), bytes(r["change"]))
    return total.applied(model.net)


def fit(docs: DataFrame, dictionary: int = DICTIONARY) -> tuple[Model, DataFrame]:
    """The model of all rows of ``docs`` (column text), and the stored word counts."""
    spark = docs.sparkSession
    counts = stored(word_counts(docs), "word-counts")
    model = vocabulary(counts, dictionary)
    share = lambda: spark.sparkContext.broadcast(replace(model))
    model.net = warmed(docs, model, share())
    model.net = taught(docs, model, share())
    return model, counts


def score(docs: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score and score of each row of ``docs`` (columns doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = ["token", "doc_id", "text_hash", "docs", "n_tokens", "n_known", "base", "score"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        logs = np.append(np.log10(model.counts + 1.0), 0.0)  # the last: a rarer word, whose count is still to come
        known = np.append(model.counts > 0, False).astype(np.int32)
        all_mass = math.log10(model.total + model.types + 1)
        for part in read(batches):
            place, ids, stops, at, rare = model.number(part.column(2))
            starts = np.concatenate([[0], stops[:-1]])
            inside = np.where(ids > HEADS, logs[place] - model.group_mass[ids], 0.0)
            sums = lambda x: np.add.reduceat(x, starts)
            lengths = stops - starts
            base = sums(logs[place]) - lengths * all_mass
            total = sums(model.net.log10(ids, starts) + inside)
            docs_, hashes = part.column(0).cast(pa.int64()), part.column(1)
            owner = pa.array(np.searchsorted(stops, at, "right"))
            n, m = part.num_rows, len(rare)
            own = pa.array([f" {d} {h}" for d, h in zip(docs_.to_pylist(), hashes.to_pylist(), strict=True)], pa.string())
            columns = [
                pa.concat_arrays([own, rare]),
                pa.concat_arrays([docs_, docs_.take(owner)]),
                pa.concat_arrays([hashes, hashes.take(owner)]),
                np.repeat(np.array([1, 0], np.int32), [n, m]),
                np.concatenate([lengths, np.zeros(m)]).astype(np.int32),
                np.concatenate([sums(known[place]), np.zeros(m, np.int32)]).astype(np.int32),
                np.concatenate([base, np.zeros(m)]),
                np.concatenate([total, np.zeros(m)]),
            ]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    source = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    rows = source.mapInArrow(run, "token string, doc_id long, text_hash long, docs int, n_tokens int, n_known int, base double, score double")
    rarer = counts.where((F.col("c") < model.least) & (F.col("token") != END))
    met = rows.join(rarer, "token", "left")
    late = F.when(F.col("c").isNotNull(), F.log10(F.col("c") + 1)).otherwise(0.0)
    whole = met.groupBy("doc_id", "text_hash").agg(
        F.sum("docs").alias("docs"),
        F.sum("n_tokens").alias("n_tokens"),
        F.sum(F.col("n_known") + F.when(F.col("c") > 0, 1).otherwise(0)).alias("n_known"),
        F.sum(F.col("base") + late).alias("base"),
        F.sum(F.col("score") + late).alias("score"),
    )
    each = whole.withColumn("copy", F.explode(F.array_repeat(F.lit(0), F.col("docs").cast("int"))))
    share = lambda c: F.col(c) / F.col("docs")
    return each.select("doc_id", share("n_tokens").cast("long").alias("n_tokens"), share("n_known").cast("long").alias("n_known"), share("base").alias("base_score"), share("score").alias("score"))


def op1_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model, counts = fit(docs.where(fold(F.col("doc_id"), 7) != 2))
    found = score(docs, model, counts)
    return found.select("doc_id", (fold(F.col("doc_id"), 7) == 2).alias("held_out"), "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score")
