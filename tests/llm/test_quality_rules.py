"""Operator 11 against counting by hand."""

from __future__ import annotations

import random
import re
from collections import Counter

import duckdb
import numpy as np
from helpers import awkward, clashing, empty

from quillmill.llm import quality_rules as q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plainly(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    dup = [x in lines[:i] for i, x in enumerate(lines)] if len(lines) < 400 else [x in seen or seen.add(x) for seen in [set()] for x in lines]
    chars = sum(map(len, words))

    def marked(n, later):
        grams = [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]
        times, met, inside = Counter(grams), set(), set()
        for i, g in enumerate(grams):
            if times[g] > 1 and (g in met or not later):
                inside.update(range(i, i + n))
            met.add(g)
        return inside

    repeat_words = len(marked(3, False))
    shares = {n: sum(len(words[i]) for i in marked(n, True)) / chars if chars else 0 for n in q.NGRAMS}
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    base = len(words) < 50 or 100 * repeat_words > 50 * len(words)
    again = sum(len(x) for x, d in zip(lines, dup, strict=True) if d)
    bad = base or again > 0.2 * sum(map(len, lines)) or symbols > 0.1 * len(words) or any(shares[n] > most for n, most in q.NGRAMS.items())
    return len(words), chars, symbols, sum(map(bool, dup)), repeat_words, base, not bad


def test_query_by_hand(spark, small):
    got = {r["doc_id"]: r for r in q.op11_quality_rules(spark, small).collect()}
    docs = duckdb.sql(f"select doc_id, text from '{small}/documents.parquet'").fetchall()
    assert len(got) == len(docs)
    for doc_id, text in docs:
        r = got[doc_id]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"], r["kept"]) == plainly(text), doc_id


def test_clean_documents_stay_and_poor_ones_go(spark, small):
    labels = dict(duckdb.sql(f"select doc_id, quality from '{small}/labels.parquet'").fetchall())
    rows = [r for r in q.op11_quality_rules(spark, small).collect() if not r["base_failed"] and r["doc_id"] in labels]
    assert all(r["kept"] for r in rows if labels[r["doc_id"]] == 1)
    assert not any(r["kept"] for r in rows if labels[r["doc_id"]] == 0)


def test_random_texts():
    lot = random.Random(5)
    for _ in range(300):
        text = "".join(lot.choice(["a", "b", "cé", "#", "dd|d", "\n", " ", "\t", "\n\n", "x y z w v u t\n"]) + lot.choice(["", " "]) for _ in range(lot.randint(0, 400)))
        j = q.judge(text)
        base = j["n_words"] < 50 or 100 * j["n_repeat_words"] > 50 * j["n_words"]
        assert (*[j[n] for n in q.NAMES], base, j["failed_rule"] == "") == plainly(text)


def test_hashes_that_collide_are_noticed():
    ids = np.array([1, 2, 3, 9, 1, 2, 3, 4, 5, 6])
    same = np.zeros(len(ids) - 2, np.uint64)
    assert [x.tolist() for x in q.repeated(ids, same, 3)] == [[0], [4]]


def test_awkward_rows(spark):
    docs = clashing(awkward(spark), "n_words", "failed_rule", "__text")
    found = q.quality(docs, keep=("doc_id", "lang", "__text")).collect()
    assert len(found) == docs.count()
    by_id = {r["doc_id"]: r for r in found}
    assert [by_id[i]["failed_rule"] for i in (3, 4, 5, 6)] == ["short", "short", "short", "repeated_words"]
    assert by_id[6]["n_words"] == by_id[6]["n_repeat_words"] == 60_000 and by_id[1]["__text"] == "mine"
    assert q.quality(empty(spark)).count() == 0
    assert q.sound(docs).count() == 0 and q.sound(docs).columns == docs.columns
