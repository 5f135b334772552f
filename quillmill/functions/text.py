"""Text normalisation and keys.

Java's ``\\s`` and Spark's ``trim`` know ASCII white space only, so patterns
here ask for Unicode classes. What no built-in function offers (NFKC, case
folding, sequence similarity) runs in pandas functions; apply those to distinct
values where a column repeats.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

BLANKS = r"(?U)\s+"
JOINERS = r"(?U)[-_/\s]+"
#: Query parameters whose values are never logged.
SECRET_PARAMETERS = ("api_key", "apikey", "key", "token", "access_token", "secret", "password")


def strip(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"(?U)^\s+", ""), r"(?U)\s+$", "")


def collapse(c: Column) -> Column:
    return strip(F.regexp_replace(c, BLANKS, " "))


@pandas_udf(T.StringType())
def nfkc(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v))


@pandas_udf(T.StringType())
def _fold(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else v.casefold())


def norm_term(c: Column) -> Column:
    """Lower case, NFKC, then runs of blanks, hyphens, underscores and slashes as one blank. Null gives ''."""
    folded = nfkc(F.lower(F.coalesce(c, F.lit(""))))
    return strip(F.regexp_replace(strip(folded), JOINERS, " "))


def norm_term_plain(c: Column) -> Column:
    """``norm_term`` for text that NFKC leaves as it is; stays in the JVM."""
    return strip(F.regexp_replace(strip(F.lower(F.coalesce(c, F.lit("")))), JOINERS, " "))


def name_key(c: Column) -> Column:
    """Case-folded, with single blanks."""
    return _fold(collapse(F.coalesce(c, F.lit(""))))


def norm_title(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"(?U)\W+", " "))  # no white space is left but these blanks


def norm_mesh(c: Column) -> Column:
    return F.lower(strip(c))


def suggested_key(c: Column) -> Column:
    return F.replace(F.upper(strip(F.coalesce(c, F.lit("")))), F.lit(" "), F.lit("_"))


def empty_to_null(c: Column) -> Column:
    return F.when(strip(c) != "", c)


def empty_list_to_null(c: Column) -> Column:
    return F.when(F.size(c) > 0, c)


def bare_doi(c: Column) -> Column:
    """Trimmed, lower-cased, less one resolver prefix; empty is null."""
    return F.nullif(F.regexp_replace(F.lower(strip(c)), r"^(https?://doi\.org/|doi:)", ""), F.lit(""))


def record_key(doi: Column, work_id: Column) -> Column:
    return F.lower(strip(F.coalesce(F.nullif(doi, F.lit("")), work_id, F.lit(""))))


def cas_number(names: Column) -> Column:
    """The first list entry that has the form of a registry number."""
    return F.get(F.filter(names, lambda s: s.rlike(r"^\d{2,7}-\d{2}-\d$")), F.lit(0))


def scrub_url(c: Column) -> Column:
    """The URL less query parameters that carry secrets; the others keep their order."""
    names = "|".join(map(re.escape, SECRET_PARAMETERS))
    query = F.regexp_extract(c, r"\?([^#]*)", 1)
    kept = F.filter(F.split(query, "&"), lambda p: ~p.rlike(f"(?i)^({names})(=|$)"))
    head, tail = F.regexp_extract(c, r"^([^?#]*)", 1), F.regexp_extract(c, r"(#.*)$", 1)
    joined = F.array_join(kept, "&")
    return F.concat(head, F.when(joined != "", F.concat(F.lit("?"), joined)).otherwise(""), tail)


#: As in ``difflib``: in a text of so many characters, those that make up more than about a hundredth of it start no block.
LONG_TEXT = 200


def matching_chars(a: str, b: str) -> int:
    """Characters in the matching blocks that ``difflib.SequenceMatcher(None, a, b)`` finds.

    Bit ``i * width + j`` of an integer tells that ``a[i]`` equals ``b[j]``, so a block is a run of bits ``width + 1`` apart.
    Runs are doubled until none is left; of the longest the lowest bit starts first, in a and then in b.
    """
    width, masks, bit = len(b) // 8 * 8 + 8, {}, 1
    for c in b:
        masks[c] = masks.get(c, 0) | bit
        bit += bit
    if common := len(b) >= LONG_TEXT:
        most = len(b) // 100 + 1
        masks = {c: m for c, m in masks.items() if m.bit_count() <= most}
    rows = {c: m.to_bytes(width // 8, "little") for c, m in masks.items()}
    none = bytes(width // 8)
    grid = int.from_bytes(b"".join([rows.get(c, none) for c in a]), "little")
    starts = int.from_bytes((b"\1" + none[1:]) * len(a), "little")
    step, total, todo = width + 1, 0, [(0, len(a), 0, len(b), grid)]
    while todo:
        alo, ahi, blo, bhi, runs = todo.pop()
        i, j, k = alo, blo, 0
        if runs:
            k, shorter = 1, []
            while longer := runs & (runs >> k * step):
                shorter.append(runs)
                runs, k = longer, k + k
            p, held = k, runs
            for s in reversed(shorter):
                p >>= 1
                if longer := held & (s >> k * step):
                    held, k = longer, k + p
            at = (held & -held).bit_length() - 1
            i, j = alo + at // width, at % width
            runs = shorter[0] if shorter else runs
        if common:  # frequent characters start no block, but lengthen it
            while i > alo and j > blo and a[i - 1] == b[j - 1]:
                i, j, k = i - 1, j - 1, k + 1
            while i + k < ahi and j + k < bhi and a[i + k] == b[j + k]:
                k += 1
        total += k
        for rlo, rhi, clo, chi in ((alo, i, blo, j), (i + k, ahi, j + k, bhi)) if k else ():
            high, wide = rhi - rlo, chi - clo
            if high > 0 and wide > 0:
                first = starts & ((1 << high * width) - 1)
                inside = (runs >> (rlo - alo) * width) & (((first << wide) - first) << clo)
                if inside or (common and a[rlo] == b[clo]):
                    todo.append((rlo, rhi, clo, chi, inside))
    return total


def similarity(a: str, b: str) -> float:
    return 2.0 * matching_chars(a, b) / (len(a) + len(b)) if a and b else 0.0


@pandas_udf(T.DoubleType())
def _similar(left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series([similarity(a, b) for a, b in zip(left, right, strict=True)], dtype=float)


def title_similarity(primary: Column, other: Column) -> Column:
    """Ratio of matching blocks of the normalised titles; 0 if either is empty. The order of the two matters."""
    return _similar(norm_title(primary), norm_title(other))


@pandas_udf(T.DoubleType())
def exact_round(values: pd.Series, digits: pd.Series) -> pd.Series:
    """Rounds the binary value half to even, where ``F.round`` rounds its decimal rendering half up."""
    return pd.Series([None if pd.isna(v) else round(float(v), int(d)) for v, d in zip(values, digits, strict=True)], dtype=float)
