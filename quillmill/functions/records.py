"""Projections from raw JSON (as VARIANT) to typed records.

A field of an unexpected type gives null, never a lost row: paths are read one
by one with ``try_variant_get``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmill.functions.dates import parse_date
from quillmill.functions.text import bare_doi, collapse, strip


def raw_json(text: Column) -> Column:
    return F.try_parse_json(text)


def at(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, path, kind)


def items(v: Column, path: str) -> Column:
    """The array at ``path``; anything else is an empty one."""
    return F.coalesce(at(v, path, "array<variant>"), F.array().cast("array<variant>"))


def texts(v: Column, path: str, inner: str = "$") -> Column:
    """Non-empty strings at ``inner`` of the array's elements; other elements are skipped."""
    return F.filter(F.transform(items(v, path), lambda x: at(x, inner)), lambda s: s.isNotNull() & (s != ""))


def display_names(v: Column, field: str) -> Column:
    return texts(v, f"$.{field}", "$.display_name")


def authors(v: Column) -> Column:
    return texts(v, "$.authorships", "$.author.display_name")


def trend_record(v: Column, query_id: str, collected_at: str, provider: str = "openalex") -> list[Column]:
    """The fifteen columns of a bibliographic trend record."""
    date = parse_date(at(v, "$.publication_date"), at(v, "$.publication_year", "int"))
    return [
        at(v, "$.id").alias("openalex_id"),
        bare_doi(at(v, "$.doi")).alias("doi"),
        at(v, "$.title").alias("title"),
        at(v, "$.publication_date").alias("publication_date"),
        date["month_bucket"].alias("month_bucket"),
        date["date_precision"].alias("date_precision"),
        date["year"].alias("year"),
        at(v, "$.primary_location.source.display_name").alias("journal"),
        *[display_names(v, f).alias(f) for f in ("keywords", "topics", "concepts")],
        F.coalesce(at(v, "$.cited_by_count", "bigint"), F.lit(0)).alias("citation_count"),
        F.lit(collected_at).alias("collected_at"),
        F.lit(query_id).alias("query_id"),
        F.lit(provider).alias("provider"),
    ]


#: Texts whose indexes are made at once.
INDEXED = 256


def inverted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, entries) of (doc_id, text): of each text its words, between blanks and line ends, with their positions; a null text has none."""
    for batch in batches:
        for at in range(0, batch.num_rows, INDEXED):
            part = batch.slice(at, INDEXED)
            words, positions, ends, stops = [], [], [0], [0]
            for text in part.column(1).to_pylist():
                index: dict[str, list[int]] = {}
                for i, word in enumerate(w for w in (text or "").replace("\n", " ").split(" ") if w):
                    index.setdefault(word, []).append(i)
                words += index
                for p in index.values():
                    positions += p
                    stops.append(len(positions))
                ends.append(len(words))
            places = pa.ListArray.from_arrays(pa.array(stops, pa.int32()), pa.array(positions, pa.int32()))
            entries = pa.StructArray.from_arrays([pa.array(words, pa.string()), places], ["word", "positions"])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), entries)], names=["doc_id", "entries"])


def words_in_order(entries: Column) -> Column:
    """Text from an array of struct(word, positions); equal positions keep the order of words. Nothing is null."""
    placed = F.flatten(F.transform(entries, lambda e, k: F.transform(e["positions"], lambda p: F.struct(p.alias("at"), k.alias("k"), e["word"].alias("w")))))
    return F.nullif(F.array_join(F.transform(F.array_sort(placed), lambda x: x["w"]), " "), F.lit(""))


def restore_abstract(index_json: Column) -> Column:
    """Text from an inverted index ``{word: [positions]}``; equal positions keep the order of words. Nothing readable is null."""
    entries = F.map_entries(F.from_json(index_json, "map<string,string>"))
    numbers = lambda v: F.filter(F.coalesce(F.from_json(v, "array<string>"), F.array().cast("array<string>")), lambda p: p.rlike(r"^-?\d+$"))
    read = F.transform(entries, lambda e: F.struct(e["key"].alias("word"), numbers(e["value"]).cast("array<int>").alias("positions")))
    return words_in_order(read)


def paper_record(v: Column) -> list[Column]:
    """Fourteen columns of an evidence record."""
    doi = bare_doi(at(v, "$.doi"))
    return [
        doi.alias("doi"),
        at(v, "$.id").alias("openalex_id"),
        at(v, "$.title").alias("title"),
        authors(v).alias("authors"),
        at(v, "$.publication_year", "int").alias("year"),
        at(v, "$.primary_location.source.display_name").alias("journal"),
        restore_abstract(at(v, "$.abstract_inverted_index")).alias("abstract"),
        F.lit(None).cast("string").alias("tldr"),
        display_names(v, "keywords").alias("keywords"),
        display_names(v, "topics").alias("topics"),
        at(v, "$.cited_by_count", "bigint").alias("citation_count"),
        at(v, "$.open_access.is_oa", "boolean").alias("is_open_access"),
        F.coalesce(F.concat(F.lit("https://doi.org/"), doi), at(v, "$.id")).alias("url"),
        F.coalesce(at(v, "$.is_retracted", "boolean"), F.lit(False)).alias("is_retracted"),
    ]


def trial_record(v: Column, query: str, captured_at: str) -> list[Column]:
    p = "$.protocolSection"
    nct = F.coalesce(at(v, f"{p}.identificationModule.nctId"), F.lit(""))
    return [
        nct.alias("nct_id"),
        F.coalesce(at(v, f"{p}.identificationModule.briefTitle"), F.lit("")).alias("title"),
        F.coalesce(at(v, f"{p}.statusModule.overallStatus"), F.lit("")).alias("status"),
        at(v, f"{p}.designModule.phases[0]").alias("phase"),
        at(v, f"{p}.sponsorCollaboratorsModule.leadSponsor.class").alias("sponsor_class"),
        at(v, f"{p}.designModule.enrollmentInfo.count", "int").alias("enrollment"),
        texts(v, f"{p}.conditionsModule.conditions").alias("conditions"),
        texts(v, f"{p}.armsInterventionsModule.interventions", "$.name").alias("interventions"),
        F.coalesce(F.to_json(at(v, f"{p}.outcomesModule", "variant")), F.lit("{}")).alias("outcomes_json"),
        at(v, f"{p}.statusModule.studyFirstPostDateStruct.date").alias("first_posted"),
        F.coalesce(at(v, "$.hasResults", "boolean"), F.lit(False)).alias("results_posted"),
        F.concat(F.lit("https://clinicaltrials.gov/study/"), nct).alias("url"),
        F.lit(query).alias("matched_query"),
        F.lit(captured_at).alias("captured_at"),
    ]


def oa_location(v: Column, checked_at: str) -> list[Column]:
    open_ = F.coalesce(at(v, "$.is_oa", "boolean"), F.lit(False))
    best = lambda f: F.when(open_, at(v, f"$.best_oa_location.{f}"))
    return [
        F.lower(strip(F.coalesce(at(v, "$.doi"), F.lit("")))).alias("doi"),
        open_.alias("is_oa"),
        F.coalesce(F.nullif(at(v, "$.oa_status"), F.lit("")), F.lit("closed")).alias("oa_status"),
        best("url_for_pdf").alias("pdf_url"),
        best("url").alias("landing_url"),
        best("host_type").alias("host_type"),
        best("license").alias("license"),
        F.lit(checked_at).alias("checked_at"),
    ]


def first_text(v: Column, path: str) -> Column:
    """A field that is a list or a single value: its first value."""
    return F.coalesce(at(v, f"{path}[0]"), F.nullif(at(v, path), F.lit("")))


def issued_year(v: Column, path: str = "$.issued") -> Column:
    return at(v, f"{path}['date-parts'][0][0]", "int")


def update_date(v: Column, path: str = "$.updated") -> Column:
    """Date parts as ``YYYY[-MM[-DD]]``."""
    parts = F.filter(F.coalesce(at(v, f"{path}['date-parts'][0]", "array<int>"), F.array().cast("array<int>")), lambda p: p.isNotNull())
    padded = F.transform(F.slice(parts, 1, 3), lambda p, i: F.lpad(p.cast("string"), F.when(i == 0, 4).otherwise(2), F.lit("0")))
    return F.nullif(F.array_join(padded, "-"), F.lit(""))


def retractions(v: Column, doi: Column) -> Column:
    """array of struct(role, retraction_doi, update_type, update_date): who retracted this paper, and which papers this notice retracts."""
    own = F.lower(strip(F.coalesce(doi, F.lit(""))))
    foreign = lambda d: d.isNotNull() & (d != "") & (F.lower(strip(d)) != own)
    by = F.transform(items(v, "$.relation['is-retracted-by']"), lambda x: F.struct(F.lit("retracted").alias("role"), at(x, "$.id").alias("retraction_doi"), F.lit("retraction").alias("update_type"), F.lit(None).cast("string").alias("update_date")))
    of = F.transform(items(v, "$['update-to']"), lambda x: F.struct(F.lit("notice").alias("role"), at(x, "$.DOI").alias("retraction_doi"), F.coalesce(at(x, "$.type"), F.lit("")).alias("update_type"), update_date(x).alias("update_date")))
    both = F.concat(by, F.filter(of, lambda x: x["update_type"].contains("retraction")))
    return F.filter(both, lambda x: foreign(x["retraction_doi"]))


def public_record(columns: list[str]) -> list[Column]:
    """The public columns of a paper: null lists as empty ones, the retraction flag lifted out of ``verification``."""
    lists = {"authors", "keywords", "topics", "mesh_terms"}
    made = []
    for name in columns:
        if name in lists:
            made.append(F.coalesce(F.col(name), F.array().cast("array<string>")).alias(name))
        elif name == "is_retracted":
            made.append(F.coalesce(F.col("verification.is_retracted"), F.lit(False)).alias(name))
        else:
            made.append(F.col(name))
    return made


def page_text(markup: Column) -> Column:
    """What stands between the tags of well-formed or broken markup, with single blanks."""
    return collapse(F.regexp_replace(F.regexp_replace(markup, r"(?is)<(script|style)\b.*?</\1\s*>", " "), r"(?s)<[^>]*>", " "))
