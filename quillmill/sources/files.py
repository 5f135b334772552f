"""Raw line files, CSV tables and their side files."""

from __future__ import annotations

import csv
import io
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.functions.records import at, raw_json, trend_record
from quillmill.functions.text import name_key, strip
from quillmill.operators.merge import first_by_key

#: Bytes of lines that a task makes distinct, about.
TASK_BYTES = 16 << 20


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists, on whatever file system Spark reads it from."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def file_system(spark: SparkSession, path: str):
    """(file system, path) as Hadoop objects."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def names(spark: SparkSession, path: str) -> list[str]:
    """What lies in a folder, sorted; nothing if there is no such folder."""
    system, at = file_system(spark, path)
    return sorted(f.getPath().getName() for f in system.listStatus(at)) if system.exists(at) else []


def read_text(spark: SparkSession, path: str) -> str:
    system, at = file_system(spark, path)
    stream = system.open(at)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    system, at = file_system(spark, path)
    stream = system.create(at, True)
    try:
        stream.write(bytearray(text.encode("utf-8")))
    finally:
        stream.close()


def write_lines(rows: DataFrame, folder: str, name: str) -> None:
    """Writes a text column as ``{name}-{part}.jsonl`` beside what is there. The same name again replaces its files.

    Parts are written aside and then renamed, so that nobody reads half a file.
    """
    spark, aside = rows.sparkSession, f"{folder}/_{name}"
    system, at = file_system(spark, aside)
    rows.write.mode("overwrite").text(aside)
    for old in names(spark, folder):
        if old.startswith(f"{name}-") and old.endswith(".jsonl"):
            system.delete(file_system(spark, f"{folder}/{old}")[1], False)
    parts = sorted((f.getPath() for f in system.listStatus(at) if f.getLen() and f.getPath().getName().startswith("part-")), key=lambda f: f.getName())
    for i, part in enumerate(parts):
        if not system.rename(part, file_system(spark, f"{folder}/{name}-{i:05d}.jsonl")[1]):
            raise OSError(f"{part} can't be renamed")
    system.delete(at, True)


def raw_dir(spark: SparkSession, root: str, provider: str, query_id: str) -> str:
    """raw/{provider}/{query_id}; works of the first provider may lie in the older raw/{query_id}."""
    new, old = f"{root}/raw/{provider}/{query_id}", f"{root}/raw/{query_id}"
    if exists(spark, new):
        return new
    if provider == "openalex" and exists(spark, old):
        return old
    raise FileNotFoundError(new)


def line_bytes(spark: SparkSession, path: str) -> int:
    """The size of a folder's line files."""
    system, at = file_system(spark, path)
    return sum(f.getLen() for f in system.listStatus(at) if f.getPath().getName().endswith(".jsonl"))


def json_lines(spark: SparkSession, path: str, key: str) -> DataFrame:
    """(v VARIANT, ord) of line files: blank and unreadable lines go, as do rows without the key; the first row of a key stays.

    ``ord`` is the place in file, then line order, so that first means first.
    Rows are dealt by key into partitions of some ``TASK_BYTES`` of lines, so that a task sorts no more as files grow.
    """
    lines = spark.read.option("pathGlobFilter", "*.jsonl").text(path)
    placed = lines.select("value", F.struct(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line")).alias("ord"))
    parsed = placed.where("trim(value) <> ''").select(raw_json(F.col("value")).alias("v"), "ord")
    named = parsed.withColumn("id", at(F.col("v"), f"$.{key}")).where("coalesce(id, '') <> ''")
    parts = max(spark.sparkContext.defaultParallelism, -(-line_bytes(spark, path) // TASK_BYTES))
    return first_by_key(named.repartition(parts, "id"), ["id"], [F.col("ord")])


def trend_records(spark: SparkSession, root: str, query_id: str, provider: str = "openalex") -> DataFrame:
    """Normalised records of one collection, with their input place."""
    path = raw_dir(spark, root, provider, query_id)
    collected = meta(spark, path).get("collected_at") or ""
    return json_lines(spark, path, "id").select(*trend_record(F.col("v"), query_id, collected, provider), "ord")


PUBMED = "pmid string, doi string, title string, journal string, mesh_terms array<string>, month_bucket string, provider string"


def pubmed_records(spark: SparkSession, root: str, query_id: str) -> DataFrame:
    rows = json_lines(spark, raw_dir(spark, root, "pubmed", query_id), "pmid")
    read = lambda n, k: at(F.col("v"), f"$.{n}", k).alias(n)
    return rows.select(*[read(*f.split(" ")) for f in PUBMED.split(", ")], "ord")


def side_file(spark: SparkSession, path: str) -> dict:
    """A small JSON object; {} if it is missing or unreadable."""
    if not exists(spark, path):
        return {}
    try:
        found = json.loads(read_text(spark, path))  # Spark's readers skip names with an underscore
    except ValueError:
        return {}
    return found if isinstance(found, dict) else {}


def meta(spark: SparkSession, path: str) -> dict:
    return side_file(spark, f"{path}/_meta.json")


INGREDIENT_COLUMNS = {"inci": "INCI name", "inn": "INN name", "cas": "CAS No", "chem": "Chem/IUPAC Name / Description"}


def ingredients_csv(spark: SparkSession, path: str, fetched_at: str = "") -> DataFrame:
    """Ingredient rows from a CSV whose columns are found by name; rows without an INCI name go."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    raw = raw.toDF(*[c.lstrip("﻿") for c in raw.columns])
    c = {k: strip(F.coalesce(F.col(f"`{v}`"), F.lit(""))) if v in raw.columns else F.lit("") for k, v in INGREDIENT_COLUMNS.items()}
    return raw.where(c["inci"] != "").select(
        name_key(c["inci"]).alias("name_key"),
        c["inci"].alias("inci_name"),
        F.lit(None).cast("int").alias("cid"),
        F.nullif(c["cas"], F.lit("")).alias("cas"),
        F.filter(F.array(c["inn"], c["chem"]), lambda x: x != "").alias("synonyms"),
        F.array(F.lit("cosing")).alias("sources"),
        F.lit(fetched_at).alias("fetched_at"),
    )


def unmatched_csv(spark: SparkSession, path: str) -> DataFrame:
    """An exported list of unmatched terms; all columns are text, empty cells too."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    rows = rows.toDF(*[c.lstrip("﻿") for c in rows.columns])
    return rows.fillna("")


def cell(value) -> str:
    return "" if value is None else str(value)


def export_csv(rows: DataFrame, fields: list[str], limit: int = 1_000_000) -> tuple[bytes, int]:
    """The exchange form of a report: BOM, CRLF, True/False, empty nulls; and its number of rows.

    One file in a fixed byte form is made on the driver, so it is bounded; larger
    results are for ``write.csv`` or ``write.parquet``.
    """
    found = rows.select(*fields).limit(limit + 1).collect()
    if len(found) > limit:
        raise ValueError(f"more than {limit} rows; write them with Spark")
    text = io.StringIO(newline="")
    out = csv.writer(text, lineterminator="\r\n")
    out.writerow(fields)
    out.writerows([cell(v) for v in r] for r in found)
    return text.getvalue().encode("utf-8-sig"), len(found)


def write_json_array(rows: DataFrame, path: str) -> int:
    """A whole table as one JSON array, a row a line, nulls kept; gives the number of rows. One file, in the order of ``rows``, a partition at a time."""
    system, at = file_system(rows.sparkSession, path)
    stream, n = system.create(at, True), 0
    put = lambda text: stream.write(bytearray(text.encode("utf-8")))
    try:
        put("[")
        for r in rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).toLocalIterator():
            put(("," if n else "") + "\n" + r[0])
            n += 1
        put("\n]\n")
    finally:
        stream.close()
    return n


def write_json_table(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


