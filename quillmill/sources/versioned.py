"""Stored tables in hash buckets, of which one write switches the version.

A table is a folder of data, a folder of bucket parts for each write, and a
folder of manifests, each naming for every bucket the folder that holds it.
The manifest with the highest number is the table. An upsert hashes the new
rows' keys, reads and writes only the buckets they fall into, and then puts the
next manifest in place in a single rename that fails if another writer was
first; it then starts over from that writer's version. A reader keeps the
folders that its manifest names, so it sees one version or the other, never
a mixture and never nothing. A write that fails before the rename leaves data
that no manifest names, and the table as it was.

Columns may come and go: a version has the columns of the one before it, then
new ones; parts written earlier read as null in those they lack. A plain
Parquet folder of earlier days is read as version 0, and its first upsert
writes all buckets.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillmill.operators.merge import aligned
from quillmill.sources import files

BUCKETS = 16
BUCKET = "__bucket"
#: Other writers that an upsert gives way to before it gives up.
RETRIES = 20

Merge = Callable[[DataFrame, DataFrame], DataFrame]


class Conflict(RuntimeError):
    """Another writer put the same version in place."""


@dataclass
class Manifest:
    version: int
    keys: list[str]
    buckets: int
    schema: str
    #: For each bucket that has rows the folder that holds them.
    parts: dict[int, str] = field(default_factory=dict)

    def text(self) -> str:
        return json.dumps({"version": self.version, "keys": self.keys, "buckets": self.buckets, "schema": json.loads(self.schema), "parts": self.parts})

    @classmethod
    def parsed(cls, text: str) -> Manifest:
        found = json.loads(text)
        return cls(found["version"], found["keys"], found["buckets"], json.dumps(found["schema"]), {int(b): p for b, p in found["parts"].items()})

    def struct(self) -> StructType:
        return StructType.fromJson(json.loads(self.schema))


class VersionedTable:
    """``keys`` are what rows are hashed by; null key parts count as ``''``."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], buckets: int = BUCKETS):
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), list(keys), buckets

    def _number(self, name: str) -> int | None:
        stem = name.removesuffix(".json")
        return int(stem) if stem.isdigit() and stem != name else None

    def versions(self) -> list[int]:
        return sorted(n for x in files.names(self.spark, f"{self.path}/_versions") if (n := self._number(x)) is not None)

    def manifest(self, version: int | None = None) -> Manifest | None:
        """The newest, or a given one; None if there is none."""
        known = self.versions()
        if version is not None and version not in known:
            raise ValueError(f"{self.path} has no version {version}")
        if not known:
            return None
        return Manifest.parsed(files.read_text(self.spark, f"{self.path}/_versions/{known[-1] if version is None else version:010d}.json"))

    def _parts(self, found: Manifest, buckets: list[int] | None = None) -> DataFrame:
        paths = [f"{self.path}/{p}" for b, p in sorted(found.parts.items()) if buckets is None or b in buckets]
        kind = found.struct()
        return self.spark.read.schema(kind).parquet(*paths) if paths else self.spark.createDataFrame([], kind)

    def exists(self) -> bool:
        return bool(self.versions()) or self._legacy() is not None

    def _legacy(self) -> DataFrame | None:
        if not any(n.endswith(".parquet") for n in files.names(self.spark, self.path)):
            return None
        try:
            return self.spark.read.parquet(self.path)
        except AnalysisException:
            return None

    def read(self, version: int | None = None) -> DataFrame | None:
        """The table at its newest version, or at an earlier one; None if nothing was ever written."""
        found = self.manifest(version)
        return self._legacy() if found is None else self._parts(found)

    def bucket(self, buckets: int) -> Column:
        return F.pmod(F.xxhash64(*[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in self.keys]), F.lit(buckets)).cast("int")

    def _written(self, rows: DataFrame, buckets: int, folder: str) -> list[int]:
        """Writes rows into a folder for each bucket, a file each unless one is too large for it; gives the buckets that have rows."""
        rows.withColumn(BUCKET, self.bucket(buckets)).repartition(F.col(BUCKET)).write.partitionBy(BUCKET).parquet(f"{self.path}/{folder}")
        return [int(n.partition("=")[2]) for n in files.names(self.spark, f"{self.path}/{folder}") if n.startswith(f"{BUCKET}=")]

    def upsert(self, new: DataFrame, merge: Merge, extra: tuple[str, ...] = ()) -> int:
        """Merges ``new`` into the buckets that its keys fall into, and puts the next version in place; gives its number.

        ``merge`` gets those buckets' old rows and the new ones, with the same
        columns; ``extra`` columns of the new rows, such as their order, are
        for it alone.
        """
        staging = f"_data/{uuid.uuid4().hex}"
        buckets = base.buckets if (base := self.manifest()) else self.buckets
        touched = self._written(new, buckets, staging)  # once: the plan isn't run again for another try
        fresh = [f"{self.path}/{staging}/{BUCKET}={b}" for b in touched]
        staged = self.spark.read.schema(new.schema).parquet(*fresh) if fresh else new.limit(0)
        for _ in range(RETRIES):
            base = self.manifest()
            if base and base.keys != self.keys:
                raise ValueError(f"{self.path} is keyed by {base.keys}, not {self.keys}")
            legacy = self._legacy() if base is None else None
            if base:
                old = self._parts(base, touched)
            else:
                old = legacy if legacy is not None else staged.drop(*extra).limit(0)
            merged = merge(*aligned(old, staged, extra))
            folder = f"_data/{uuid.uuid4().hex}"
            held = self._written(merged, buckets, folder)
            stay = {b: p for b, p in base.parts.items() if b not in touched} if base else {}
            parts = stay | {b: f"{folder}/{BUCKET}={b}" for b in held}
            made = Manifest((base.version if base else 0) + 1, self.keys, buckets, merged.schema.json(), parts)
            try:
                self.publish(made)
            except Conflict:
                continue
            self._delete(staging)
            return made.version
        raise Conflict(f"{self.path} had {RETRIES} other writers in the meantime")

    def publish(self, made: Manifest) -> None:
        """Puts a manifest in place in one rename; Conflict if its number is taken."""
        jvm, context = self.spark.sparkContext._jvm, self.spark.sparkContext
        aside, final = (f"{self.path}/_versions/{n}" for n in (f".{uuid.uuid4().hex}", f"{made.version:010d}.json"))
        files.write_text(self.spark, aside, made.text())
        at = jvm.org.apache.hadoop.fs.Path
        none = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        options = context._gateway.new_array(getattr(jvm, "org.apache.hadoop.fs.Options$Rename"), 1)
        options[0] = none
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(at(final).toUri(), context._jsc.hadoopConfiguration()).rename(at(aside), at(final), options)
        except Exception as error:
            if "FileAlreadyExists" in str(error):
                files.file_system(self.spark, aside)[0].delete(at(aside), False)
                raise Conflict(f"version {made.version} of {self.path} is taken") from None
            raise

    def _delete(self, folder: str) -> None:
        system, at = files.file_system(self.spark, f"{self.path}/{folder}")
        system.delete(at, True)

    def vacuum(self, keep: int = 2) -> int:
        """Forgets all but the newest ``keep`` versions and deletes data that none of them names; readers of older ones must be done, and no writer at work. Gives the folders deleted."""
        known = self.versions()
        held = {p for v in known[-keep:] for p in self.manifest(v).parts.values()}
        for v in known[:-keep]:
            self._delete(f"_versions/{v:010d}.json")
        gone = 0
        for write in files.names(self.spark, f"{self.path}/_data"):
            inside = [f"_data/{write}/{n}" for n in files.names(self.spark, f"{self.path}/_data/{write}") if n.startswith(f"{BUCKET}=")]
            left = [p for p in inside if p in held]
            for p in inside:
                if p not in held:
                    self._delete(p)
                    gone += 1
            if not left:
                self._delete(f"_data/{write}")
        return gone
