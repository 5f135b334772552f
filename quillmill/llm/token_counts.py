"""Exact token counts at every prefix by dynamic programming.

For byte-pair merges, the last token of a prefix is the only vocabulary entry
that ends there and forms a stable pair with the last token of what precedes
it. So the count at a prefix follows from the counts at shorter ones, and no
prefix is encoded anew. The table of a unit (what the pattern cuts before any
merge) is kept by its letters, since units share most prefixes.

A text's table says for each of its code points by how much the count of the
text up to there exceeds the count before it: one byte each, and four where a
step doesn't fit. It is put together from the tables of white-space separated
chunks. Its sum is the text's count; ``count_at`` and ``longest_within`` answer
any truncation and budget question from it, without the text.

Defined cases: a null text counts as empty, and has no tokens and an empty
table; an empty table of documents gives no rows; repeated rows are counted one
by one; a special string within a text is one token, and its beginnings are
counted as the ordinary text that they are; units of more than ``LONG`` letters
have the same counts as others, but their tables aren't kept for later texts;
what is kept is bounded by number of entries (``PREFIXES``, ``GENERATION``).
"""

from __future__ import annotations

import json
from array import array
from functools import lru_cache
from itertools import accumulate
from operator import sub

import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmill.llm.common import annotate
from quillmill.llm.vocab import BYTE_LETTERS, CHUNK, GENERATION, LETTERS, WHITE, Memo, ragged, vocabulary

#: Fixed value: the pattern by which byte-level vocabularies cut a text into units.
UNIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
LEADING = regex.compile(f"[{WHITE}]*")
PREFIXES = 800_000
NEVER = 1 << 60
LONG = 100
#: More than the longest vocabulary entry; and numbers that many prefixes share, made once.
WIDE = 1024
CODES = list(range(16 * WIDE))
STEPS = {n: n.to_bytes(1, "little", signed=True) for n in range(-128, 128)}
#: Units whose beginnings fall into two units, an apostrophe and a letter.
SHORTENED = ("'re", "'ve", "'ll")
LIMIT = 512


@lru_cache(maxsize=2)
def merges(path: str) -> tuple[dict[str, int], dict[tuple[str, str], int], list[str], int]:
    with open(path, encoding="utf-8") as f:
        whole = json.load(f)
    model = whole["model"]
    ranks = {tuple(m.split(" ") if isinstance(m, str) else m): i for i, m in enumerate(model["merges"])}
    return model["vocab"], ranks, [t["content"] for t in whole["added_tokens"]], max(map(len, model["vocab"]))


class PrefixCounter:
    """Token counts of a byte-level vocabulary file, without its library.

    ``kind`` is the type of a step in tables: ``b``, or ``i`` where bytes don't suffice.
    """

    def __init__(self, path: str, kind: str = "b"):
        self.path, self.kind = path, kind
        self.vocab, self.ranks, self.special, self.longest = merges(path)
        self.pairs: dict[tuple[str, str], bool] = {}
        self.tables: dict[str, bytes] = {"": b""}  # prefix -> steps up to it
        self.last: dict[str, int] = {"": 0}  # prefix -> its count times WIDE, and the length of its last token
        self.inner = Memo(self._behind_blank)
        self.rests = Memo(self.chunk, GENERATION // 8)
        self.outer = Memo(self.chunk)

    def _merged(self, symbols: list[str]) -> list[str]:
        """What the merge rules make of some symbols, lowest rank first."""
        rank = self.ranks.get
        while len(symbols) > 1:
            ranks = [rank(pair, NEVER) for pair in zip(symbols, symbols[1:], strict=False)]
            least = min(ranks)
            if least == NEVER:
                break
            at = ranks.index(least)
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    def _stable(self, a: str, b: str) -> bool:
        """Whether the two tokens, side by side, stay as they are."""
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) > 1_000_000:
                self.pairs.clear()
            known = self.pairs[a, b] = self._merged(list(a + b)) == ([a, b] if a else [b])
        return known

    def _table(self, unit: str) -> bytes:
        """By how much the token count of each byte prefix of a unit exceeds that of the one before. ``unit`` is in the byte alphabet.

        Only prefixes that aren't known yet are worked out.
        """
        tables = self.tables
        steps = tables.get(unit)
        if steps is not None:
            return steps
        last, vocab, stable, longest = self.last, self.vocab, self._stable, self.longest
        if len(last) > PREFIXES:
            last.clear()
            tables.clear()
            last[""], tables[""] = 0, b""
        known = len(unit) - 1
        while unit[:known] not in tables:
            known -= 1
        steps, count = tables[unit[:known]], last[unit[:known]] // WIDE
        for end in range(known + 1, len(unit) + 1):
            for start in range(max(0, end - longest), end):
                token = unit[start:end]
                if token in vocab:
                    before = last[unit[:start]]
                    if stable(unit[start - before % WIDE : start], token):
                        break
            code = before - before % WIDE + WIDE + end - start
            prefix = unit[:end]
            last[prefix] = CODES[code] if code < len(CODES) else code
            steps += STEPS[code // WIDE - count]
            tables[prefix] = steps
            count = code // WIDE
        return steps

    def table(self, unit: str) -> list[int]:
        """Token counts of all byte prefixes of one unit, the empty one first."""
        return [0, *accumulate(array("b", self._table(unit)))] if len(unit) <= LONG else self._long(unit)

    def _long(self, unit: str) -> list[int]:
        """The table of a unit too long to keep by its prefixes."""
        sizes, counts, vocab, stable, longest = [0], [0], self.vocab, self._stable, self.longest
        for end in range(1, len(unit) + 1):
            for start in range(max(0, end - longest), end):
                token = unit[start:end]
                if token in vocab and stable(unit[start - sizes[start] : start], token):
                    break
            sizes.append(end - start)
            counts.append(counts[start] + 1)
        return counts

    def total(self, unit: str) -> int:
        """Count of a whole unit."""
        return self.table(unit)[-1]

    @staticmethod
    def letters(unit: str) -> str:
        return (unit if unit.isascii() and unit.isalpha() else unit.encode().decode("latin-1").translate(BYTE_LETTERS))

    def counts(self, unit: str) -> list[int]:
        """Counts up to each code point of a unit, zero first."""
        if unit in SHORTENED:
            return [0, 1, 2, self.total(unit)]
        letters = self.letters(unit)
        found = self.table(letters)
        if len(letters) == len(unit):
            return found
        at, out = 0, [0]
        for c in unit:
            at += len(c.encode())
            out.append(found[at])
        return out

    def _steps(self, counts: list[int]) -> bytes:
        return array(self.kind, map(sub, counts[1:], counts)).tobytes()

    def chunk(self, chunk: str) -> bytes:
        """Steps of white space, what follows it up to the next, or both."""
        blanks = LEADING.match(chunk).end()
        whole = [0]
        for unit in UNIT.findall(chunk):
            before = whole.pop()
            whole += [before + n for n in self.counts(unit)]
        if 1 < blanks < len(chunk):  # white space at the end of a prefix is one unit, else its last letter is cut off
            whole[: blanks + 1] = self.counts(chunk[:blanks])
        return self._steps(whole)

    def _alone(self, chunk: str) -> bytes:
        return self.outer[chunk] if len(chunk) <= LONG else self.chunk(chunk)

    def _behind_blank(self, chunk: str) -> bytes:
        """A blank and letters are one unit; what follows letters is counted alone."""
        if chunk.isalpha():
            if self.kind == "b" and chunk.isascii() and len(chunk) < LONG:
                return self._table("Ġ" + chunk)
            return self._steps(self.counts(" " + chunk))
        start = LETTERS.match(chunk)
        if not start or not start[0].isalpha():
            return self.chunk(" " + chunk)
        rest = chunk[start.end() :]
        return self._behind_blank(start[0]) + (self.rests[rest] if len(rest) <= LONG else self.chunk(rest))

    def _piece(self, text: str) -> bytes:
        """Steps of a text without special strings."""
        if not text or ragged(text):
            return b"".join(map(self._alone, CHUNK.findall(text)))
        inner, alone = self.inner.__getitem__, self._alone
        lines = []
        for line in text.split("\n"):
            first, *rest = line.split(" ")
            lines.append(alone(first) + b"".join(map(inner, rest)))
        return alone("\n").join(lines)

    def sum(self, steps: bytes) -> int:
        return int(np.frombuffer(steps, self.kind).sum(dtype=np.int64))

    def steps(self, text: str | None) -> bytes:
        """The table of a text: a step for each code point, of type ``kind``."""
        if not text:
            return b""
        if not any(s in text for s in self.special):
            return self._piece(text)
        parts, at = [], 0
        for found in regex.finditer("|".join(map(regex.escape, self.special)), text):
            piece, special = text[at : found.start()], found[0]
            before = self._piece(piece + special[:-1])  # up to its last letter a special string is ordinary text
            parts += [before, array(self.kind, [self.sum(self._piece(piece)) + 1 - self.sum(before)]).tobytes()]
            at = found.end()
        return b"".join([*parts, self._piece(text[at:])])

    def index(self, text: str | None) -> bytes:
        """The table of a text behind a byte that gives the bytes of a step."""
        try:
            return bytes([array(self.kind).itemsize]) + self.steps(text)
        except OverflowError:
            return counter(self.path, "i").index(text)


def counts_of(index: bytes) -> np.ndarray:
    """Token counts of all prefixes of the text whose table this is, the empty one first."""
    steps = np.frombuffer(index, f"<i{index[0]}", offset=1)
    return np.concatenate([[0], np.cumsum(steps, dtype=np.int64)])


def count_at(index: bytes, end: int) -> int:
    """Number of tokens of the text's first ``end`` code points."""
    return int(np.frombuffer(index, f"<i{index[0]}", offset=1)[:end].sum(dtype=np.int64))


def longest_within(index: bytes, budget: int) -> int:
    """Code points of the longest prefix of at most ``budget`` tokens. Counts may fall as a text grows, so all prefixes count."""
    fits = np.flatnonzero(counts_of(index) <= budget)
    return int(fits[-1]) if len(fits) else 0


_COUNTERS: dict[tuple[str, str], PrefixCounter] = {}


def counter(path: str, kind: str = "b") -> PrefixCounter:
    if (path, kind) not in _COUNTERS:
        _COUNTERS[path, kind] = PrefixCounter(path, kind)
    return _COUNTERS[path, kind]


def token_counts(docs: DataFrame, vocab_path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), budget: int = LIMIT) -> DataFrame:
    """Kept columns with n_bytes and n_tokens of each whole text, and fits: the code points of its longest prefix within ``budget``.

    Rows stay as they are, nulls and repeats included.
    """
    out = T.StructType().add("n_bytes", "long").add("n_tokens", "long").add("fits", "long")

    def worker(texts: list[str | None]) -> list[list]:
        find = counter(vocab_path).index
        rows = [[], [], []]
        for t in texts:
            index = find(t)
            n = count_at(index, len(index))
            for row, value in zip(rows, (len(t.encode()) if t else 0, n, longest_within(index, budget) if n > budget else len(t or "")), strict=True):
                row.append(value)
        return rows

    return annotate(docs, text, keep, out, worker)


def prefix_counts(docs: DataFrame, vocab_path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Kept columns with prefix_table: what ``count_at`` and ``longest_within`` need to answer questions about any prefix."""
    out = T.StructType().add("prefix_table", T.BinaryType())
    return annotate(docs, text, keep, out, lambda texts: [list(map(counter(vocab_path).index, texts))])


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary("byte_bpe_50k.json"), budget=LIMIT)
    return found.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"), "fits")
