"""First rows of each key, from a stream whose state lets go of old keys.

A key's state is the time it was last met. A timer fires once the watermark is
``delay`` beyond that time, and the key leaves the state. Rows that come later
than the watermark allows never reach the state, so a key whose rows all carry
times of one stretch (an id with its date) is passed on once: when its state is
gone, its late copies are refused. State that was lost with its checkpoint is
made again from what is stored: those keys enter it before the first row, with
timers of their own, and are not passed on again.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType

from quillmill.sources import files

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER_SETTING = "spark.sql.streaming.stateStore.providerClass"
KEY, TIME = "__key", "__time"
#: A store of keys that are only ever added: on disk, with small buffers; a batch writes what it adds, and nothing is read to count keys.
#: Memory isn't bounded by number: filters would share the cache, in whose parts those of large files find no room, so each lookup reads them anew.
ROCKSDB = "spark.sql.streaming.stateStore.rocksdb"
GROWING = {PROVIDER_SETTING: PROVIDER, f"{ROCKSDB}.changelogCheckpointing.enabled": "true", f"{ROCKSDB}.trackTotalNumberOfRows": "false", f"{ROCKSDB}.boundedMemoryUsage": "false", f"{ROCKSDB}.writeBufferSizeMB": "16"}


@contextmanager
def settings(spark: SparkSession, wanted: dict[str, str]) -> Iterator[None]:
    """Settings for streams that are started within; a checkpoint keeps the store that it began with."""
    before = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


class FirstSeen(StatefulProcessor):
    """Rows in are (key, time in milliseconds, columns); out come the columns of a key's first row of earliest time."""

    def __init__(self, columns: list[str], delay_ms: int):
        self.columns, self.delay = columns, delay_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at long")

    def _met(self, at: int) -> None:
        """Notes a time and moves the key's timer behind it."""
        held = self.last.get()
        if held is not None:
            if held[0] >= at:
                return
            self.handle.deleteTimer(held[0] + self.delay)
        self.last.update((at,))
        self.handle.registerTimer(at + self.delay)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        known = self.last.exists()
        first, latest = None, None
        for batch in rows:
            if not len(batch):
                continue
            batch.columns = [*self.columns, TIME, KEY]  # Spark renames those that begin with an underscore
            least = batch.loc[batch[TIME].idxmin()]
            if first is None or least[TIME] < first[TIME]:
                first = least
            latest = max(int(batch[TIME].max()), latest or 0)
        if latest is None:
            return
        self._met(latest)
        if not known:
            yield pd.DataFrame([first[self.columns].tolist()], columns=self.columns)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        return iter(())

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self._met(int(initialState.iloc[:, 1].max()))

    def close(self) -> None:
        pass


def milliseconds(interval: str) -> int:
    """Of an interval such as ``2 hours``."""
    return int(pd.Timedelta(interval).total_seconds() * 1000)


def first_seen(stream: DataFrame, key: str, time: str, delay: str, stored: DataFrame | None = None) -> DataFrame:
    """The stream with one row for each value of ``key``, the earliest of the batch that brings it.

    ``stored`` has the key and time of rows passed on earlier; it counts only
    when the checkpoint is new. Rows without a key or time are left out.
    """
    columns = stream.columns
    schema: StructType = stream.schema
    at = lambda df: df.withColumn(TIME, F.unix_millis(F.col(time).cast("timestamp"))).withColumn(KEY, F.col(key).cast("string")).where(F.col(KEY).isNotNull() & F.col(TIME).isNotNull())
    keyed = at(stream.withWatermark(time, delay)).groupBy(KEY)
    initial = None if stored is None else at(stored).select(KEY, TIME).groupBy(KEY)
    return keyed.transformWithStateInPandas(FirstSeen(columns, milliseconds(delay)), outputStructType=schema, outputMode="Append", timeMode="EventTime", initialState=initial)


def collected(spark: SparkSession, out: str, schema: StructType) -> DataFrame:
    """What ``collect_first`` has stored."""
    held = files.names(spark, out)
    return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(*[f"{out}/{n}" for n in held]) if held else spark.createDataFrame([], schema)


def collect_first(stream: DataFrame, out: str, checkpoint: str, key: str, time: str, delay: str) -> StreamingQuery:
    """Appends what ``first_seen`` passes on to ``out`` until all input is read.

    With a new checkpoint the rows in ``out`` are the state to start from. Each
    life of a checkpoint has a name, and its batches have folders of their own
    under it, so a batch that is taken again replaces its own folder, and a new
    life's batches, which count from 0 again, none of another's.
    """
    spark = stream.sparkSession
    if files.exists(spark, f"{checkpoint}/life"):
        life = files.read_text(spark, f"{checkpoint}/life")
        stored = None if files.exists(spark, f"{checkpoint}/commits") else collected(spark, out, stream.schema).select(key, time)
    else:
        life = uuid.uuid4().hex
        stored = collected(spark, out, stream.schema).select(key, time) if files.names(spark, out) else None
        files.write_text(spark, f"{checkpoint}/life", life)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/{life}-{number:08d}")

    with settings(spark, {PROVIDER_SETTING: PROVIDER}):  # the store that keeps timers
        return first_seen(stream, key, time, delay, stored).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
