"""Stored tables whose schema grows in numbered, repeatable steps."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Step = Callable[[DataFrame], DataFrame]


def add_columns(**kinds: str) -> Step:
    """A step that adds what is missing."""
    return lambda df: df.withColumns({c: F.lit(None).cast(k) for c, k in kinds.items() if c not in df.columns}) if kinds else df


#: The paper table: its first form and what was added since.
PAPER_STEPS: list[Step] = [
    add_columns(key="string", doi="string", openalex_id="string", title="string", authors="array<string>", year="int", journal="string", abstract="string", tldr="string", keywords="array<string>", topics="array<string>", citation_count="bigint", is_open_access="boolean", url="string"),
    add_columns(crossref_verified="boolean", title_match="boolean", found_in_sources="array<string>", is_retracted="boolean", has_doi="boolean", confidence_score="int", collected_at="string"),
    add_columns(evidence="string"),
    add_columns(mesh_terms="array<string>"),
]


def migrate(df: DataFrame, version: int, steps: list[Step]) -> tuple[DataFrame, int]:
    """The table after the steps that its version lacks; a newer version than ours is refused."""
    if version > len(steps):
        raise ValueError(f"table is at version {version}, this code knows {len(steps)}")
    for step in steps[version:]:
        df = step(df)
    return df, len(steps)
