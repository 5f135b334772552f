"""Small tables with awkward rows, and plain versions of what the operators do."""

from __future__ import annotations

import re

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def awkward(spark):
    """Nulls, empty and very long texts, repeated rows, odd white space."""
    rows = [
        (1, "The cat sat on the mat.", "en", "s", 1),
        (1, "The cat sat on the mat.", "en", "s", 1),
        (None, "no id at all", "en", None, None),
        (3, None, None, None, None),
        (4, "", "en", "s", 0),
        (5, "  \n\t ", "en", "s", 5),
        (6, "word " * 60_000, "en", "s", 300_000),
        (7, "Füße, Ελλάς\u00a0日本語 🎉\x00\x1c!", "de", "s", 20),
        (8, "<|endoftext|> it's  12,345\n\n\nx", "en", "s", 9),
        (10_000_000_000, "far away id", "en", "s", 9),
        (-5, "a negative id", "en", "s", 9),
    ]
    return spark.createDataFrame(rows, DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def clashing(df, *names):
    """Extra columns whose names the operators use for themselves."""
    from pyspark.sql import functions as F

    return df.withColumns({n: F.lit("mine") for n in names})


def lower(text: str | None) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def split(text: str | None) -> list[str]:
    return [w for w in re.split(r"[\x20\x09-\x0D]+", lower(text)) if w]
