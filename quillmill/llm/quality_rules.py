"""Quality rules over repetition: how much of a text lies inside n-grams and lines that it has more than once.

The words of a text become numbers in order of their first appearance. For each
n-gram length a rolling hash goes over them in numpy (the hash of n words is
the one of n - 1 words, moved on by one word), windows with equal hashes are
compared word by word, and the characters of the words that any later copy of a
window covers are added up, overlaps once. A hash that two different n-grams share is noticed by that
comparison; the length is then ranked exactly, pair by pair. Lines are handled
alike: characters of lines that repeat an earlier one.

A text fails a rule when the covered share of its word characters exceeds the
limit for that length. Limits fall with the length, as long repeats are rarer
by chance. The base counts come from the same arrays; beside the base rules, a
text fails with more than one symbol in ten words.

Defined cases: null and empty texts have no words, so they are too short and
not kept; a text shorter than an n-gram length has nothing repeated at that
length; texts of any length are read whole, in memory linear in their words;
repeated rows are judged alike, each text on its own; an empty table gives no
rows. Other columns pass through when they are kept.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmill.llm.common import annotate, kept

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
WINDOW = 3
#: Fewer words than this, or a larger percentage of words in repeated 3-word windows, fail the base rules.
LEAST_WORDS = 50
MOST_REPEATED = 50
#: Largest share of word characters inside later copies of n-grams, by n: above what one repeated sentence makes of a text of 50 words.
NGRAMS = {5: 0.20, 6: 0.19, 7: 0.18, 8: 0.17, 9: 0.16, 10: 0.15}
#: Largest share of line characters in lines that repeat an earlier one.
LINE_CHARS = 0.20
#: Most symbols to a word.
MOST_SYMBOLS = 0.10
FACTOR = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xBF58476D1CE4E5B9)


@dataclass(frozen=True)
class Limits:
    ngrams: tuple[tuple[int, float], ...] = tuple(NGRAMS.items())
    line_chars: float = LINE_CHARS
    symbols: float = MOST_SYMBOLS


def scrambled(ids: np.ndarray) -> np.ndarray:
    """One 64-bit number for each word number, spread over all bits."""
    x = ids.astype(np.uint64) * FACTOR
    x ^= x >> np.uint64(29)
    return x * MIX


def repeated(ids: np.ndarray, codes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of starts of equal windows of ``n`` words, each with the next one in the text; ``codes`` are the windows' hashes."""
    for tried in (codes, None):
        if tried is None:
            tried = exact(ids, n)
        order = np.argsort(tried, kind="stable")
        same = tried[order[1:]] == tried[order[:-1]]
        left, right = order[:-1][same], order[1:][same]
        if all((ids[left + k] == ids[right + k]).all() for k in range(n)):
            break
    return left, right


def inside(starts: np.ndarray, n: int, words: int) -> np.ndarray:
    """Which of the words lie in a window of ``n`` words that begins at any of ``starts``."""
    steps = np.zeros(words + 1, np.int32)
    steps[np.unique(starts)] += 1
    steps[np.unique(starts) + n] -= 1
    return np.cumsum(steps[:-1]) > 0


def exact(ids: np.ndarray, n: int) -> np.ndarray:
    """A number for each window of ``n`` words, equal exactly where the windows are."""
    ranks, words = ids.astype(np.int64), int(ids.max()) + 1
    for k in range(1, n):
        ranks = np.unique(ranks[:-1] * words + ids[k : k + len(ranks) - 1], return_inverse=True)[1].astype(np.int64)
    return ranks


def repeats(ids: np.ndarray, lengths: list[int]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each n-gram length that has repeats, their ``repeated`` pairs. Longer repeats lie within shorter ones, so the search ends where none is left."""
    found = {}
    codes = one = scrambled(ids)
    for n in range(2, max(lengths) + 1):
        if len(codes) < 3:
            break
        codes = codes[:-1] * FACTOR + one[n - 1 :]
        if n in lengths:
            pairs = repeated(ids, codes, n)
            if not len(pairs[0]):
                break
            found[n] = pairs
    return found


def line_repeats(text: str) -> tuple[int, int, int]:
    """Of the lines with a word: how many equal an earlier one, the characters of all, and those of the repeats."""
    seen: set[str] = set()
    again = chars = again_chars = 0
    for line in text.split("\n"):
        if not line or not line.strip(SPACES):
            continue
        chars += len(line)
        if line in seen:
            again, again_chars = again + 1, again_chars + len(line)
        else:
            seen.add(line)
    return again, chars, again_chars


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def judge(text: str | None, limits: Limits = Limits()) -> dict:
    """All counts of a text, the shares that the rules look at, and the first rule that it fails ('' for none)."""
    text = text or ""
    words = text.encode(errors="surrogatepass").split()
    dup_lines, line_chars, dup_chars = line_repeats(text)
    word_chars = len(text) - sum(map(text.count, SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    lengths = [n for n, _ in limits.ngrams]
    pairs = repeats(ids, [WINDOW, *lengths])
    repeat_words = int(inside(np.concatenate(pairs[WINDOW]), WINDOW, len(ids)).sum()) if WINDOW in pairs else 0
    shares = dict.fromkeys(lengths, 0.0)
    if set(pairs) - {WINDOW}:
        sizes = np.array([len(w.decode(errors="surrogatepass")) for w in words])
        shares |= {n: float(sizes[inside(pairs[n][1], n, len(ids))].sum() / word_chars) for n in lengths if n in pairs}
    failed = ""
    if len(words) < LEAST_WORDS:
        failed = "short"
    elif 100 * repeat_words > MOST_REPEATED * len(words):
        failed = "repeated_words"
    elif dup_chars > limits.line_chars * line_chars:
        failed = "lines"
    elif symbols > limits.symbols * len(words):
        failed = "symbols"
    else:
        failed = next((f"{n}_grams" for n, most in limits.ngrams if shares[n] > most), "")
    return {
        "n_words": len(words),
        "word_chars": word_chars,
        "n_symbols": symbols,
        "n_dup_lines": dup_lines,
        "n_repeat_words": repeat_words,
        "dup_line_share": dup_chars / line_chars if line_chars else 0.0,
        "dup_ngram_shares": list(shares.values()),
        "failed_rule": failed,
    }


def quality(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), limits: Limits = Limits()) -> DataFrame:
    """Kept columns with the counts, the shares of characters in repeated lines and n-grams, and ``failed_rule``."""
    out = T.StructType()
    for name in NAMES:
        out.add(name, "long")
    out.add("dup_line_share", "double").add("dup_ngram_shares", T.ArrayType(T.DoubleType())).add("failed_rule", "string")

    def worker(texts: list[str | None]) -> list[list]:
        found = [judge(t, limits) for t in texts]
        return [[f[name] for f in found] for name in out.fieldNames()]

    return annotate(docs, text, keep, out, worker)


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def sound(docs: DataFrame, text: str = "text", limits: Limits = Limits()) -> DataFrame:
    """The rows of ``docs`` that fail no rule, with their own columns."""
    return kept(docs, text, lambda d, t, tags: quality(d, t, tags, limits), F.col("failed_rule") == "")


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", *NAMES, base_failed().alias("base_failed"), (F.col("failed_rule") == "").alias("kept"), "failed_rule", "dup_line_share")
