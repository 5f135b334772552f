"""Benchmark decontamination by exact word windows.

Test items become windows of consecutive normalised words, kept as a broadcast
set of 64-bit window hashes: sorted arrays, some 25 bytes for each word of the
items, beside their dictionary of words. Each training text is scanned once
with rolling hashes, and every hash that is in the set is verified word by
word. Items go out in blocks of bounded size, so a large benchmark takes more
scans, each by a worker that holds one block.

Defined cases: null and empty texts have no words and are clean; items without
words are ignored; equal item ids count once, and a null id is never listed,
though its windows hit; repeated rows are judged alike; an empty benchmark
leaves everything clean. Texts may be of any length: a step of the scan holds
the word numbers of its texts. A single item larger than a block is a block of
its own.
"""

from __future__ import annotations

import re
from collections import defaultdict
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmill.llm.common import annotate, kept

WINDOW = 13
BLOCK_CHARS = 16_000_000
#: Bytes that end a word once A-Z are lower-cased.
BREAKS = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
BASE = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[bytes]:
    return text.encode().lower().translate(BREAKS).split() if text else []


@dataclass
class Table:
    """Windows of one length, by hash: where each begins in the items' words, and the item it is of."""

    hashes: np.ndarray
    starts: np.ndarray
    owners: np.ndarray

    def __post_init__(self):
        order = np.argsort(self.hashes, kind="stable")
        self.hashes, self.starts, self.owners = self.hashes[order], self.starts[order], self.owners[order]
        #: A mark for each value of the leading bits that some hash has: most windows of a text end here.
        self.bits = np.uint64(min(24, max(16, int(len(self.hashes)).bit_length() + 4)))
        self.marks = np.zeros(1 << int(self.bits), bool)
        self.marks[self.lead(self.hashes)] = True

    def lead(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> (np.uint64(64) - self.bits)).astype(np.int64)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Positions whose hash is here, and the rows of the table that have it, from and to."""
        at = np.flatnonzero(self.marks[self.lead(hashes)])
        low = np.searchsorted(self.hashes, hashes[at])
        here = self.hashes[np.minimum(low, len(self.hashes) - 1)] == hashes[at]
        at, low = at[here], low[here]
        return at, low, np.searchsorted(self.hashes, hashes[at], "right")


class Windows:
    """Hash set of the windows of one block of items."""

    def __init__(self, items: list[tuple[str | None, str | None]], width: int = WINDOW):
        self.ids: dict[bytes, int] = {}
        self.width = width
        self.names = [item for item, _ in items]
        numbered = [np.fromiter((self.ids.setdefault(w, len(self.ids) + 1) for w in words(text)), np.uint32) for _, text in items]
        self.words = np.concatenate(numbered) if numbered else np.zeros(0, np.uint32)
        lengths = np.array([len(n) for n in numbered], np.int64)
        first = np.cumsum(lengths) - lengths
        found: dict[int, list[tuple[np.ndarray, int]]] = defaultdict(list)
        for i, n in enumerate(lengths.tolist()):
            if n:
                found[min(n, width)].append((first[i] + np.arange(max(1, n - width + 1)), i))
        self.tables: dict[int, Table] = {}
        for length, parts in found.items():
            starts = np.concatenate([p for p, _ in parts])
            owners = np.repeat(np.array([i for _, i in parts], np.int32), [len(p) for p, _ in parts])
            self.tables[length] = Table(rolling(self.words.astype(np.uint64), length)[starts], starts, owners)

    def scan(self, texts: list[str | None]) -> list[list]:
        """Per text: its number of words, positions of hit words, and items with occurring windows."""
        split = [words(t) for t in texts]
        counts = [len(w) for w in split]
        at = np.cumsum([0, *counts])
        seq = np.fromiter((i for w in split for i in map(self.ids.get, w, repeat(0))), np.uint64, int(at[-1]))
        hits: list[set] = [set() for _ in texts]
        items: list[set] = [set() for _ in texts]
        for length, table in self.tables.items():
            for k, low, high in zip(*(x.tolist() for x in table.find(rolling(seq, length))), strict=True):
                doc = int(np.searchsorted(at, k, "right")) - 1
                if k + length > at[doc + 1]:
                    continue
                same = [j for j in range(low, high) if (self.words[table.starts[j] : table.starts[j] + length] == seq[k : k + length]).all()]
                if same:
                    hits[doc].update(range(k - int(at[doc]), k - int(at[doc]) + length))
                    items[doc].update(self.names[i] for i in table.owners[same].tolist())
        return [counts, [sorted(h) for h in hits], [sorted(str(i) for i in x if i is not None) for x in items]]


def rolling(seq: np.ndarray, length: int) -> np.ndarray:
    """Polynomial hashes of all runs of ``length`` numbers, modulo 2^64."""
    if len(seq) < length:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(seq) - length + 1, np.uint64)
    for j in range(length):
        out *= BASE
        out += seq[j : j + len(out)]
    return out


def item_blocks(benchmark: DataFrame, item_id: str, text: str, block_chars: int):
    """The items, in lists of about ``block_chars`` characters; one list at a time is on the driver."""
    items = benchmark.select(F.col(item_id).cast("string").alias("item"), F.col(text).cast("string").alias("text")).where("text is not null")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-total // block_chars)
    for k in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k) if blocks > 1 else items
        yield [tuple(r) for r in part.collect()]


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), item_id: str = "item_id", item_text: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Kept columns with n_words, hits (positions of hit words), items (ids as sorted strings) and contaminated."""
    spark = docs.sparkSession
    made = ("n_words", "hits", "items", "contaminated")
    keep = tuple(k for k in keep if k not in made)
    lists = []
    for block in item_blocks(benchmark, item_id, item_text, block_chars) if benchmark is not None else ():
        shared = spark.sparkContext.broadcast(Windows(block))
        k = len(lists)
        out = T.StructType().add(f"__n{k}", T.LongType()).add(f"__h{k}", T.ArrayType(T.IntegerType())).add(f"__i{k}", T.ArrayType(T.StringType()))
        carried = [*keep, *[n for names in lists for n in names], *([] if text in keep else [text])]
        docs = annotate(docs, text, carried, out, lambda texts, shared=shared: shared.value.scan(texts), rows=512)
        lists.append(out.fieldNames())
    if not lists:
        found = annotate(docs, text, keep, T.StructType().add("n_words", "long"), lambda texts: [[len(words(t)) for t in texts]])
        empty = F.array().cast("array<int>"), F.array().cast("array<string>")
    else:
        found = docs.withColumnRenamed(lists[0][0], "n_words")
        join = lambda i: F.array_sort(F.array_distinct(F.concat(*[F.col(n[i]) for n in lists])))
        empty = join(1), join(2)
    hit = F.size("hits")
    return found.select(*keep, "n_words", empty[0].alias("hits"), empty[1].alias("items")).withColumn("contaminated", (hit > 0) & (20 * hit >= F.col("n_words")))


def without_spans(text: str | None, hits: list[int]) -> str | None:
    """The text less its hit words and what stands between neighbouring ones."""
    if not text or not hits:
        return text
    spans = [m.span() for m in WORD.finditer(text)]
    out, at = [], 0
    marked = set(hits)
    for k in hits:
        if k - 1 not in marked:
            out.append(text[at : spans[k][0]])
        at = spans[k][1]
    return "".join([*out, text[at:]])


def cleaned(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` with their own columns, their texts less the passages that the benchmark has; texts without any are as they were."""
    names = docs.columns
    tags = tuple(f"__c{i}" for i in range(len(names)))
    mine = tags[names.index(text)]
    found = contamination(docs.toDF(*tags), benchmark, mine, tags)
    less = F.pandas_udf(lambda t, h: pd.Series([without_spans(x, [] if y is None else list(y)) for x, y in zip(t, h, strict=True)]), T.StringType())
    return found.withColumn(mine, F.when(F.size("hits") > 0, less(F.col(mine).cast("string"), F.col("hits"))).otherwise(F.col(mine).cast("string"))).select(*tags).toDF(*names)


def decontaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that aren't contaminated, with their own columns."""
    return kept(docs, text, lambda d, t, tags: contamination(d, benchmark, t, tags), ~F.col("contaminated"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    listed = F.sha2(F.array_join("items", ","), 256)
    return found.select("doc_id", "n_words", F.size("hits").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"), listed.alias("items_sha256"), "contaminated")
