"""Helpers shared by the corpus operators.

Everything here is about plumbing that must behave the same for every
operator: where shared scratch tables go, how documents are dealt into
train and held-out folds, and how a text column is mapped in Arrow batches.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmill.session import shared_dir

#: Rows handed to a worker function at once; bounds what one step holds in memory.
STEP_ROWS = 256


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it again: lineage ends there, and a lost executor costs nothing."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fold(doc_id: Column, mod: int) -> Column:
    """crc32 of the id's decimal text, modulo ``mod``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % mod


def steps(batches: Iterable[pa.RecordBatch], rows: int = STEP_ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def annotate(
    df: DataFrame,
    text: str,
    keep: Sequence[str],
    out: T.StructType,
    worker: Callable[[list[str | None]], list[list]],
    rows: int = STEP_ROWS,
    done: Callable[[], None] | None = None,
) -> DataFrame:
    """Adds columns computed from ``text`` to the kept columns, without a shuffle.

    ``worker`` gets a list of texts (nulls stay None) and returns one list per
    field of ``out``. A kept column whose name is also in ``out`` is replaced.
    ``done`` is called when a task ends, to let go of what it has gathered.
    """
    made = set(out.fieldNames())
    kept = [k for k in keep if k not in made]
    column = "__text"
    while column in kept:
        column += "_"
    source = df.select(*[F.col(f"`{k}`") for k in kept], F.col(f"`{text}`").cast("string").alias(column))
    schema = T.StructType([*source.schema.fields[:-1], *out.fields])
    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [to_arrow_type(f.dataType) for f in out.fields]
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in steps(batches, rows):
            found = worker(part.column(part.num_columns - 1).to_pylist())
            added = [pa.array(v, kind) for v, kind in zip(found, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], *added], names=names)
        if done:
            done()

    return source.mapInArrow(run, schema)


def kept(docs: DataFrame, text: str, judge: Callable[[DataFrame, str, tuple[str, ...]], DataFrame], condition: Column) -> DataFrame:
    """The rows of ``docs`` for which ``condition`` holds after ``judge``, with their own columns.

    Columns go under names of their own meanwhile, so none clashes with what
    ``judge`` adds.
    """
    names = docs.columns
    tags = tuple(f"__c{i}" for i in range(len(names)))
    judged = judge(docs.toDF(*tags), tags[names.index(text)], tags)
    return judged.where(condition).select(*tags).toDF(*names)
