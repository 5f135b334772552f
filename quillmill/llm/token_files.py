"""Token-id files: fixed-width bit packing with block offsets.

A store is one folder of Parquet files whose rows are blocks. A block holds
whole documents, in ascending id order, each id in the fewest bits that the
vocabulary needs; beside the packed bytes it keeps where its documents begin,
so that one document, or any range of one, is read without the rest. ``part``
and ``block`` order the blocks; the small table of part totals turns positions
inside a part into positions in the whole store.

Defined cases: a null or empty text is stored as its end id alone; repeated
ids stay separate documents, next to each other, ordered by their packed ids;
null ids sort first; an empty table gives a store of no blocks. Other columns
than id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.llm.common import scratch, steps
from quillmill.llm.vocab import encoder, vocabulary

BLOCK_IDS = 1 << 16


def bits_for(vocabulary_size: int) -> int:
    return max(1, int(vocabulary_size - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids one after another, ``bits`` bits each, lowest bit first."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    wide = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    return np.packbits(np.unpackbits(wide, axis=1, bitorder="little")[:, :bits].ravel(), bitorder="little").tobytes()


def unpack(payload: bytes, bits: int, start: int, count: int) -> np.ndarray:
    """``count`` ids from position ``start`` on; reads only the bytes that hold them."""
    if not count:
        return np.zeros(0, np.uint32)
    if bits in (8, 16, 32):
        return np.frombuffer(payload, f"<u{bits // 8}", count, start * bits // 8).astype(np.uint32)
    first, last = start * bits // 8, -(-(start + count) * bits // 8)
    loose = np.unpackbits(np.frombuffer(payload, np.uint8, last - first, first), bitorder="little")
    loose = loose[start * bits - first * 8 :][: count * bits].reshape(count, bits)
    full = np.zeros((count, 32), np.uint8)
    full[:, :bits] = loose
    return np.packbits(full, axis=1, bitorder="little").view("<u4").ravel()


def range_parts(ids: DataFrame, column: str, parts: int) -> list[int]:
    """Upper bounds that deal the ids into about equal ranges; at most ``parts`` numbers reach the driver."""
    if parts < 2:
        return []
    at = [i / parts for i in range(1, parts)]
    found = ids.select(F.percentile_approx(F.col(column), at, 100 * parts).alias("b")).first()["b"]
    return sorted(set(found or []))


def write_store(docs: DataFrame, path: str, vocab_path: str, end_id: int, doc_id: str = "doc_id", text: str = "text", parts: int | None = None) -> None:
    """Encodes each text, adds ``end_id``, and writes the store in ascending id order with one shuffle."""
    import zstandard

    spark = docs.sparkSession
    parts = parts or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    bounds = np.array(range_parts(docs, doc_id, parts), np.int64)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocab_path)
        end, squeeze = np.array([end_id], enc.dtype).tobytes(), zstandard.ZstdCompressor(level=1)
        for part in steps(batches):
            ids = np.array([-(1 << 63) if x is None else x for x in part.column(0).to_pylist()], np.int64)
            found = [squeeze.compress(x + end) for x in enc.encode(part.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(np.searchsorted(bounds, ids), pa.int32()), part.column(0), pa.array(found, pa.binary())], names=["part", "doc_id", "ids"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, open_ = encoder(vocab_path), zstandard.ZstdDecompressor()
        bits, names = bits_for(enc.size), ["part", "block", "first", "n_ids", "bits", "payload", "doc_ids", "doc_starts"]
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        part, block, first, held, docs_, starts, pieces = -1, 0, 0, 0, [], [], []

        def flush() -> pa.RecordBatch:
            row = [part, block, first, held, bits, pack(np.concatenate(pieces), bits), docs_, starts]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=names)

        for batch in batches:
            for p, doc, squeezed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if docs_ and (p != part or held >= BLOCK_IDS):
                    yield flush()
                    block, first, held, docs_, starts, pieces = block + 1, first + held, 0, [], [], []
                if p != part:
                    part, block, first = p, 0, 0
                docs_.append(doc)
                starts.append(held)
                pieces.append(np.frombuffer(open_.decompress(squeezed), enc.dtype))
                held += len(pieces[-1])
        if docs_:
            yield flush()

    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    encoded = source.mapInArrow(encode, "part int, doc_id long, ids binary")
    dealt = encoded.repartitionById(len(bounds) + 1, F.col("part")).sortWithinPartitions("part", "doc_id", "ids")
    made = dealt.mapInArrow(blocks, "part int, block int, first long, n_ids long, bits int, payload binary, doc_ids array<long>, doc_starts array<long>")
    made.write.option("compression", "zstd").parquet(path)


def part_starts(spark: SparkSession, path: str) -> dict[int, int]:
    """Position of each part's first id in the whole store: one number a part."""
    totals = sorted((r["part"], r["n"]) for r in spark.read.parquet(path).groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    ends = np.cumsum([0, *[n for _, n in totals]])
    return {p: int(at) for (p, _), at in zip(totals, ends, strict=False)}


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """One row a document: doc_id, start (ids before it in the store), n_tokens, ids (packed again as 32-bit little-endian bytes)."""
    begins = part_starts(spark, path)

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = unpack(row["payload"], row["bits"], 0, row["n_ids"]).astype("<u4")
                cuts = np.array([*row["doc_starts"], row["n_ids"]], np.int64)
                start = begins[row["part"]] + row["first"] + cuts[:-1]
                found = [ids[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(start), pa.array(np.diff(cuts)), pa.array(found, pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])

    return spark.read.parquet(path).mapInArrow(documents, "doc_id long, start long, n_tokens long, ids binary")


def read_tokens(spark: SparkSession, path: str, doc: int, start: int = 0, count: int | None = None) -> list[int]:
    """Random access: a range of one document's ids, from the one block that holds it."""
    row = spark.read.parquet(path).where(F.array_contains("doc_ids", F.lit(doc).cast("long"))).first()
    if row is None:
        raise KeyError(doc)
    k = row["doc_ids"].index(doc)
    begin, end = row["doc_starts"][k], [*row["doc_starts"], row["n_ids"]][k + 1]
    most = max(0, end - begin - start)
    return unpack(bytes(row["payload"]), row["bits"], begin + start, most if count is None else min(count, most)).tolist()



def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "token-store")
    write_store(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, vocabulary("byte_bpe_50k.json"), 2)
    return read_store(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


__all__ = ["bits_for", "op4_token_files", "pack", "part_starts", "read_store", "read_tokens", "unpack", "write_store"]
