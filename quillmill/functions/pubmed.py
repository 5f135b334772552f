"""PubMed XML to article rows. Broken documents give a row with a status instead of failing the job."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "key string, status string, pmid string, title string, abstract string, journal string, mesh_terms array<string>, doi string"


def _flat(node: ET.Element | None) -> str | None:
    return None if node is None else " ".join("".join(node.itertext()).split()) or None


def articles(xml: str) -> list[dict]:
    """All articles of a document that have a citation part; raises ValueError if it can't be read."""
    try:
        root = ET.fromstring(xml)
    except ET.ParseError as error:
        raise ValueError(f"unreadable XML: {error}") from error
    found = []
    for node in root.findall("PubmedArticle"):
        if (citation := node.find("MedlineCitation")) is None:
            continue
        sections = [t for s in citation.findall("Article/Abstract/AbstractText") if (t := _flat(s))]
        ids = [_flat(i) for i in node.findall("PubmedData/ArticleIdList/ArticleId") if i.get("IdType") == "doi"]
        found.append(
            {
                "pmid": _flat(citation.find("PMID")),
                "title": _flat(citation.find("Article/ArticleTitle")),
                "abstract": " ".join(sections) or None,
                "journal": _flat(citation.find("Article/Journal/Title")),
                "mesh_terms": [t for d in citation.findall("MeshHeadingList/MeshHeading/DescriptorName") if (t := _flat(d))],
                "doi": ids[0] if ids else None,
            }
        )
    return found


def parse_articles(documents: DataFrame, key: str, xml: str) -> DataFrame:
    """One row an article (status ok), or one for a document without any (empty) or that can't be read (error)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows, none = [], dict.fromkeys(["pmid", "title", "abstract", "journal", "mesh_terms", "doi"])
            for k, x in zip(batch["key"], batch["xml"], strict=True):
                try:
                    found = articles(x or "")
                    rows += [{"key": k, "status": "ok", **a} for a in found] or [{"key": k, "status": "empty", **none}]
                except ValueError:
                    rows.append({"key": k, "status": "error", **none})
            yield pd.DataFrame(rows, columns=["key", "status", *none])

    return documents.select(F.col(key).cast("string").alias("key"), F.col(xml).alias("xml")).mapInPandas(run, SCHEMA)
