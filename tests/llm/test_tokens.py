"""Encoding, exact counts at prefixes, token files and packing."""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pytest
from helpers import awkward, clashing, empty
from hypothesis import given, settings
from hypothesis import strategies as st

from quillmill.llm import packing, token_counts, token_files
from quillmill.llm.vocab import Encoder, Memo, tokenizer, vocabulary

BYTE, WORD = vocabulary("byte_bpe_50k.json"), vocabulary("word_bpe_49k.json")
TEXTS = st.lists(st.sampled_from(["the", "Cat's", " ", "  ", "\n", "\n\n", "\t", "é", "Straße", "ΣΑΣ", "日本", "İ", "e\u0301", "\u0301", "12", "###", "<|endoftext|>", "\u00a0", "\x1c", "'ll", "🎉", ",", "x²", "½y", "Ⅷ", "_a"]), max_size=12).map("".join)


@pytest.mark.parametrize("path", [BYTE, WORD])
@settings(max_examples=300, deadline=None)
@given(text=TEXTS)
def test_encoder_gives_what_the_library_gives(path, text):
    own = Encoder(path) if path not in _ENC else _ENC[path]
    _ENC[path] = own
    assert own.ids(text).tolist() == tokenizer(path).encode(text, add_special_tokens=False).ids


_ENC: dict = {}
_COUNT = token_counts.PrefixCounter(BYTE)


@settings(max_examples=150, deadline=None)
@given(text=TEXTS)
def test_counts_and_budgets_at_every_prefix(text):
    library = tokenizer(BYTE)
    exact = [len(library.encode(text[:end], add_special_tokens=False).ids) for end in range(len(text) + 1)]
    for index in (_COUNT.index(text), token_counts.counter(BYTE, "i").index(text)):
        assert token_counts.counts_of(index).tolist() == exact
        assert [token_counts.count_at(index, end) for end in range(len(text) + 1)] == exact
        for budget in range(max(exact) + 2):
            assert token_counts.longest_within(index, budget) == max(k for k, n in enumerate(exact) if n <= budget)


def test_unit_tables_and_budgets():
    library = tokenizer(BYTE)
    size = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    assert _COUNT.table("international") == [size("international"[:i]) for i in range(14)]
    word = "internationalizationabilityness"
    assert token_counts.longest_within(_COUNT.index(word), 3) == 27
    long = "abcdefgh" * 9000 + "a" * 5000
    for t in (long, "!" * 3000, "  " * 700 + "x", "-" * 999 + "\n" * 400):
        assert token_counts.count_at(_COUNT.index(t), len(t)) == size(t)
    assert _COUNT.table("ab" * 60)[:101] == _COUNT.table("ab" * 50)
    for t in ("they'll we've 'r 'l 'v", "a<|endoftext|>b  <|endoftext|", " <|endoftext|><|endoftext|> x", "x \n  y\n\n z", "=" * 200):
        assert token_counts.counts_of(_COUNT.index(t)).tolist() == [size(t[:end]) for end in range(len(t) + 1)]
    assert token_counts.longest_within(_COUNT.index("one two three four"), 0) == 0 and token_counts.counts_of(_COUNT.index(None)).tolist() == [0]


def test_steps_that_a_byte_cannot_hold(monkeypatch):
    """A unit whose count falls by more than 128 at once goes to four bytes a step."""
    odd = token_counts.PrefixCounter(BYTE)
    monkeypatch.setattr(odd, "counts", lambda unit: [0, 300, 1])
    monkeypatch.setattr(token_counts.counter(BYTE, "i"), "counts", lambda unit: [0, 300, 1])
    assert token_counts.counts_of(odd.index("zz")).tolist() == [0, 300, 1]
    token_counts._COUNTERS.clear()


def test_memo_is_bounded_and_keeps_what_is_used():
    made = []
    memo = Memo(lambda k: made.append(k) or k * 2, size=3)
    for k in (1, 2, 3, 1, 4, 1, 5, 6, 1):
        assert memo[k] == k * 2
        assert len(memo) <= 3
    assert made == [1, 2, 3, 4, 5, 6]


def test_token_counts_table(spark):
    rows = token_counts.token_counts(clashing(awkward(spark), "n_tokens", "n_bytes"), BYTE).collect()
    assert len(rows) == 11 and set(rows[0].asDict()) == {"doc_id", "n_bytes", "n_tokens", "fits"}
    got = sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"]) for r in rows)
    want = sorted((str(r["doc_id"]), len((r["text"] or "").encode()), len(tokenizer(BYTE).encode(r["text"] or "", add_special_tokens=False).ids)) for r in awkward(spark).collect())
    assert got == want
    assert token_counts.token_counts(empty(spark), BYTE).count() == 0
    texts = {r["doc_id"]: r["text"] or "" for r in awkward(spark).collect()}
    for r in token_counts.prefix_counts(awkward(spark), BYTE).collect():
        counts = token_counts.counts_of(bytes(r["prefix_table"]))
        assert len(counts) == len(texts[r["doc_id"]]) + 1 and counts[-1] == max(n for d, _, n in got if d == str(r["doc_id"]))
    for r in rows:
        text = texts[r["doc_id"]]
        assert r["fits"] == len(text) if r["n_tokens"] <= 512 else len(tokenizer(BYTE).encode(text[: r["fits"]], add_special_tokens=False).ids) <= 512 < len(tokenizer(BYTE).encode(text[: r["fits"] + 1], add_special_tokens=False).ids)


@given(st.integers(1, 20), st.lists(st.integers(0, (1 << 20) - 1), max_size=50), st.integers(0, 50), st.integers(0, 50))
def test_bit_packing(bits, ids, start, count):
    ids = np.array(ids, np.uint32) & ((1 << bits) - 1)
    start = min(start, len(ids))
    count = min(count, len(ids) - start)
    packed = token_files.pack(ids, bits)
    assert len(packed) == -(-len(ids) * bits // 8)
    assert token_files.unpack(packed, bits, start, count).tolist() == ids[start : start + count].tolist()


def test_store_round_trip(spark, tmp_path):
    path = str(tmp_path / "store")
    token_files.write_store(clashing(awkward(spark), "ids", "part", "block"), path, BYTE, 2, parts=3)
    rows = token_files.read_store(spark, path).collect()
    library = tokenizer(BYTE)
    docs = sorted(awkward(spark).collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0))
    want, at = [], 0
    for r in docs:
        ids = [*library.encode(r["text"] or "", add_special_tokens=False).ids, 2]
        want.append((r["doc_id"], at, len(ids), np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert sorted(((r["doc_id"], r["start"], r["n_tokens"], bytes(r["ids"])) for r in rows), key=lambda x: x[1]) == want
    assert token_files.read_tokens(spark, path, 7)[-1] == 2
    assert token_files.read_tokens(spark, path, 6, 100, 3) == library.encode("word " * 60_000, add_special_tokens=False).ids[100:103]
    with pytest.raises(KeyError):
        token_files.read_tokens(spark, path, 99)


def test_empty_store(spark, tmp_path):
    path = str(tmp_path / "store")
    token_files.write_store(empty(spark), path, BYTE, 2, parts=3)
    assert token_files.read_store(spark, path).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 1024), max_size=80))
def test_windows(sizes):
    groups = packing.windows(sizes, 4096)
    assert sorted(i for g in groups for i in g) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in g) <= 4096 for g in groups)
    assert len(groups) <= -(-sum(sizes) // 4096) + 2


def test_differencing_is_near_equal():
    sizes = np.random.default_rng(1).integers(1, 1024, 2000).tolist()
    loads = [sum(sizes[i] for i in g) for g in packing.differencing(sizes, 250)]
    assert max(loads) - min(loads) < 60 and sum(loads) == sum(sizes)
    assert packing.differencing([5, 5, 5], 1) == [[0, 1, 2]] or sorted(packing.differencing([5, 5, 5], 1)[0]) == [0, 1, 2]
    assert packing.windows([4096, 4096, 1], 4096) and packing.windows([], 4096) == []


def test_packing_covers_all_ids(spark):
    docs = awkward(spark)
    rows = packing.pack(clashing(docs, "start", "ids", "offset"), WORD, 2).collect()
    library = tokenizer(WORD)
    want = sorted((str(r["doc_id"]), tuple([*library.encode(r["text"] or "", add_special_tokens=False).ids, 2])) for r in docs.collect())
    by_sequence, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[str(r["doc_id"])].append((r["start"], tuple(np.frombuffer(r["ids"], "<u4").tolist())))
        assert len(r["ids"]) == 4 * r["length"] and r["length"] <= 4096
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    for doc, ids in want:
        if doc != "1":  # the repeated row is checked by its number of pieces below
            assert tuple(i for _, p in sorted(pieces[doc]) for i in p) == ids
    assert len(pieces["1"]) == 2
    assert packing.pack(empty(spark), WORD, 2).count() == 0


def test_queries_on_small_tables(spark, small):
    ids = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    library = tokenizer(BYTE)
    counts = {r["doc_id"]: r for r in token_counts.op2_token_counts(spark, small).collect()}
    files = {r["doc_id"]: r for r in token_files.op4_token_files(spark, small).collect()}
    at = 0
    for doc in sorted(ids):
        found = [*library.encode(ids[doc] or "", add_special_tokens=False).ids, 2]
        assert counts[doc]["n_tokens"] == len(found) - 1 and counts[doc]["over_limit"] == (len(found) - 1 > 512)
        assert (files[doc]["start"], files[doc]["n_tokens"], files[doc]["ids_crc32"]) == (at, len(found), zlib.crc32(np.array(found, "<u4").tobytes()))
        at += len(found)
    rows = packing.op6_packing(spark, small).collect()
    full = defaultdict(int)
    for r in rows:
        full[r["sequence_id"]] += r["length"]
    used = sum(full.values())
    padded = sum(n if n & (n - 1) == 0 else 4096 for n in full.values())
    assert used == sum(len(tokenizer(WORD).encode(t or "", add_special_tokens=False).ids) + 1 for t in ids.values())
    assert padded < 1.1 * used
