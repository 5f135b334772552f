"""Packing into fixed-length training sequences by multiway differencing.

Each task packs the documents that it reads, in bounded buckets: documents
longer than a sequence first fill whole sequences, and the remaining pieces of
a bucket are dealt over windows by Karmarkar-Karp differencing, which keeps
merging the two partial partitions of the largest imbalance with their bins in
opposite order. If a window comes out above capacity, one more window is taken.
Nothing is shuffled, and no bucket holds more than ``BUCKET_WINDOWS`` windows.

Defined cases: a null or empty text is its end id alone; repeated and null ids
are packed like any other row; an empty table gives no pieces; other columns
are ignored. A document's pieces share no id and cover it.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.llm.common import steps
from quillmill.llm.vocab import encoder, vocabulary

BUCKET_WINDOWS = 512


def differencing(sizes: list[int], bins: int) -> list[list[int]]:
    """Karmarkar-Karp: positions of ``sizes`` dealt into ``bins`` near-equal groups.

    A partial partition is its occupied bins in descending order of load; bins
    that it does not list are empty. Its imbalance is its largest load less its
    smallest.
    """
    heap = []
    for i, size in enumerate(sizes):
        loads, groups = [size], [[i]]
        heap.append((-(size if bins > 1 else 0), i, loads, groups))
    heapq.heapify(heap)
    ticket = len(sizes)
    while len(heap) > 1:
        _, _, a, ga = heapq.heappop(heap)
        _, _, b, gb = heapq.heappop(heap)
        if len(a) < len(b):
            a, ga, b, gb = b, gb, a, ga
        over = len(a) + len(b) - bins
        if over <= 0 and b[0] <= a[-1]:
            a += b  # only empty bins are met, and the order holds
            ga += gb
        else:
            over = max(0, over)
            for j in range(over):  # the smaller of these meet the larger of those
                k = len(a) - over + j
                a[k] += b[len(b) - 1 - j]
                ga[k] += gb[len(b) - 1 - j]
            a += b[: len(b) - over]
            ga += gb[: len(gb) - over]
            order = sorted(range(len(a)), key=a.__getitem__, reverse=True)
            a, ga = [a[k] for k in order], [ga[k] for k in order]
        spread = a[0] - (a[-1] if len(a) == bins else 0)
        heapq.heappush(heap, (-spread, ticket, a, ga))
        ticket += 1
    return heap[0][3] if heap else []


def windows(sizes: list[int], capacity: int) -> list[list[int]]:
    """Groups of positions, none above ``capacity``; no size may exceed it."""
    count = -(-sum(sizes) // capacity)
    while sizes:
        groups = differencing(sizes, count)
        if max(sum(sizes[i] for i in g) for g in groups) <= capacity:
            return groups
        count += 1
    return []


def pack(docs: DataFrame, vocab_path: str, end_id: int, capacity: int = 4096, longest_piece: int = 1024, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a piece: doc_id, start, length, ids (32-bit little-endian), doc_tokens, sequence_id, offset.

    ``longest_piece`` bounds the pieces that share windows: short enough to
    balance well, long enough to leave most documents uncut.
    """
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocab_path)
        width, end = enc.dtype.itemsize, np.array([end_id], enc.dtype).tobytes()
        sequence = TaskContext.get().partitionId() << 40
        bucket, held = [], 0

        def made(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        def wide(ids: bytes) -> bytes:
            return np.frombuffer(ids, enc.dtype).astype("<u4").tobytes()

        def emptied() -> Iterator[tuple]:
            nonlocal sequence
            for group in windows([x[2] for x in bucket], capacity):
                at = 0
                for doc, start, length, ids, total in (bucket[i] for i in group):
                    yield doc, start, length, wide(ids), total, sequence, at
                    at += length
                sequence += 1

        for part in steps(batches):
            rows = []
            for doc, ids in zip(part.column(0).to_pylist(), enc.encode(part.column(1).to_pylist()), strict=True):
                ids += end
                total = len(ids) // width
                full = total // capacity * capacity
                for start in range(0, full, capacity):
                    rows.append((doc, start, capacity, wide(ids[start * width : (start + capacity) * width]), total, sequence, 0))
                    sequence += 1
                for start in range(full, total, longest_piece):
                    length = min(longest_piece, total - start)
                    bucket.append((doc, start, length, ids[start * width : (start + length) * width], total))
                    held += length
                if held >= BUCKET_WINDOWS * capacity:
                    rows += emptied()
                    bucket, held = [], 0
            if rows:
                yield made(rows)
        if bucket:
            yield made(list(emptied()))
        enc.forget()

    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def packed_digests(docs: DataFrame) -> DataFrame:
    pieces = pack(docs, vocabulary("word_bpe_49k.json"), 2)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
