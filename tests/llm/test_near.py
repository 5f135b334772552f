"""Fingerprints, near-duplicates, decontamination and URL filters against plain versions."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from helpers import awkward, clashing, empty, lower, split
from pyspark.sql import functions as F

from quillmill.llm import decontaminate, near_dups, sketches, url_filters


def shown(df):
    return df._jdf.queryExecution().toString()


def native(df):
    assert not re.search("Python|Arrow|Pandas", shown(df)), "runs Python"


# --- bottom-k sketches ---------------------------------------------------------------------------------------------


def sketch_rows(spark, texts, k=4):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", sketches.fingerprint(F.col("text"), k).alias("fp"))
    return {r["i"]: r["fp"] for r in df.collect()}


def test_fingerprints(spark):
    got = sketch_rows(spark, ["a b c d e f", "A  b\nc d e f ", "a b", "", None, "a b c d e", "x " * 20])
    assert got[0] == got[1] and len(got[0]) == 2 and got[0] == sorted(got[0])
    assert len(got[2]) == 1 and got[3] == [] and got[4] == [] and len(got[5]) == 1 and len(got[6]) == 1


def test_estimates_are_exact_below_k(spark):
    a, b = "one two three four five six seven", "one two three four five six other"
    df = spark.createDataFrame([(a, b), (a, ""), ("", ""), (a, a)], "a string, b string")
    fa, fb = sketches.fingerprint(F.col("a"), 64), sketches.fingerprint(F.col("b"), 64)
    rows = df.select(sketches.resemblance(fa, fb, 64).alias("r"), sketches.containment(fa, fb, 64).alias("c"), sketches.distinct_shingles(fa, 64).alias("n"), sketches.distinct_shingles(sketches.merged(fa, fb, 64), 64).alias("u")).collect()
    assert [tuple(r) for r in rows] == [(0.5, pytest.approx(2 / 3), 3.0, 4.0), (0.0, 0.0, 3.0, 3.0), (1.0, 1.0, 0.0, 0.0), (1.0, 1.0, 3.0, 3.0)]


def test_estimates_of_long_texts(spark):
    base = [f"w{i}" for i in range(4000)]
    other = base[:2000] + [f"v{i}" for i in range(2000)]
    row = spark.createDataFrame([(" ".join(base), " ".join(other))], "a string, b string").select(sketches.fingerprint(F.col("a")).alias("a"), sketches.fingerprint(F.col("b")).alias("b"))
    got = row.select(sketches.resemblance(F.col("a"), F.col("b")).alias("r"), sketches.distinct_shingles(F.col("a")).alias("n"), sketches.containment(F.col("a"), F.col("b")).alias("c")).first()
    assert got["r"] == pytest.approx(1 / 3, abs=0.13) and got["n"] == pytest.approx(4000, rel=0.3) and got["c"] == pytest.approx(0.5, abs=0.2)


def test_merged_parts(spark):
    rows = [(k, [int(x) for x in v]) for k, v in (("a", [5, 1, 9]), ("a", [1, 2, 8]), ("b", [3]), ("c", []))]
    got = {r["k"]: r["fp"] for r in sketches.merged_by(spark.createDataFrame(rows, "k string, fp array<long>"), ["k"], "fp", 4).collect()}
    assert got == {"a": [1, 2, 5, 8], "b": [3]}


def test_successors(spark):
    ids = [5, 6, 300, 70_000, 10_000_000_000, -4, -(1 << 62), (1 << 62)]
    got = {r["id"]: r["next_id"] for r in sketches.successors(spark.createDataFrame([(i,) for i in ids], "id long")).collect()}
    order = sorted(ids, reverse=True)
    assert got == dict(zip(order, order[1:] + order[:1], strict=True))


def test_next_document(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").where("doc_id % 3 <> 1")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    order = sorted(texts, reverse=True)
    pairs = sketches.with_next(docs.select("doc_id", "text"))
    native(pairs)
    got = {r["doc_id"]: r for r in pairs.collect()}
    assert len(got) == len(order)
    for a, b in zip(order, order[1:] + order[:1], strict=True):
        assert got[a]["text"] == texts[a] and got[a]["next_text"] == texts[b] and got[a]["next_fp"] == got[b]["fp"]


def test_op3(spark, small):
    df = sketches.op3_fingerprints(spark, small)
    native(df)
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    order = sorted(texts, reverse=True)
    rows = {r["doc_id"]: r for r in df.collect()}
    exact = lambda t: {tuple(w[i : i + 5]) for w in [t.lower().split()] for i in range(max(1, len(w) - 4))} if t.split() else set()
    wrong = []
    for a, b in zip(order, order[1:] + order[:1], strict=True):
        n = len(texts[a])
        edited = texts[a][: n - n // 2] + texts[b][: n // 2]
        r = rows[a]
        assert (r["n_chars"], r["edited_sha256"]) == (n, hashlib.sha256(edited.encode()).hexdigest())
        x, y = exact(texts[a]), exact(edited)
        wrong.append(abs(r["near_edited"] - len(x & y) / len(x | y)))
        assert r["near_next"] == 1.0 if texts[a] == texts[b] else r["near_next"] < 1
    assert max(wrong) < 0.2 and sum(wrong) / len(wrong) < 0.03


def test_sketches_of_awkward_rows(spark):
    rows = sketches.with_next(awkward(spark).select("doc_id", "text")).collect()
    assert len(rows) == 11
    assert sketches.with_next(empty(spark).select("doc_id", "text")).count() == 0
    one = sketches.with_next(spark.createDataFrame([(7, "only")], "doc_id long, text string")).first()
    assert (one["text"], one["next_text"]) == ("only", "only")


# --- SimHash -------------------------------------------------------------------------------------------------------


def plain_simhash(text):
    words = split(text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(pairs):
    root = {k: k for k, _ in pairs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, fa) in enumerate(pairs):
        for b, fb in pairs[:i]:
            if (fa ^ fb).bit_count() <= 2:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: find(k) for k, _ in pairs}


def test_simhash(spark, small):
    for r in [*awkward(spark).collect(), *spark.read.parquet(f"{small}/documents.parquet").limit(60).collect()]:
        if r["doc_id"] != 6:
            assert near_dups.simhash(r["text"]) % (1 << 64) == plain_simhash(r["text"])
    assert near_dups.simhash("word " * 60_000) % (1 << 64) == xxhash.xxh64_intdigest(b"word word word", 42)


@pytest.mark.parametrize("paired", [48, 1])
def test_components(spark, monkeypatch, paired):
    """Chains of values two bits apart, copies, and strangers; with and without the way for large buckets."""
    monkeypatch.setattr(near_dups, "PAIRED", paired)
    base = [0x123456789ABCDEF0, 0xFFFFFFFFFFFFFFFF, 0]
    values = []
    for b in base:
        for i in range(0, 30, 2):
            b ^= 3 << i
            values.append(b)
        values.append(b)
    values += [0x0F0F0F0F0F0F0F0F ^ (1 << i) ^ (1 << (i + 20)) ^ (1 << (i + 33)) for i in range(12)]
    pairs = [(i * 7 % 101, v) for i, v in enumerate(values)]
    signed = [(k, v - (1 << 64) if v >> 63 else v) for k, v in pairs]
    rows = spark.createDataFrame(signed, "doc_id long, fp long")
    got = {r["doc_id"]: r["component"] for r in near_dups.components(rows, "doc_id").collect()}
    assert got == plain_components(pairs)


def test_near_duplicates_of_awkward_rows(spark):
    rows = near_dups.near_duplicates(clashing(awkward(spark), "fp", "component")).collect()
    assert len(rows) == 11
    got = {r["doc_id"]: r["component"] for r in rows}
    assert got[1] == 1 and got[3] == got[4] == got[5] == 3 and got[None] is None
    assert near_dups.near_duplicates(empty(spark)).count() == 0
    kept = near_dups.distinct_documents(clashing(awkward(spark), "fp", "component"))
    assert kept.columns[-2:] == ["fp", "component"]
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(["1", "None", "3", "6", "7", "8", "10000000000", "-5"])


def test_op8(spark, small):
    rows = near_dups.op8_near_dups(spark, small).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    pairs = [(k, plain_simhash(t)) for k, t in sorted(texts.items())]
    want = plain_components(pairs)
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in rows} == {k: (f"{v:016x}", want[k]) for k, v in pairs}


# --- decontamination -----------------------------------------------------------------------------------------------


def plain_hits(text, items, width=13):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words, hit, found = word.findall(lower(text)), set(), set()
    for item, body in items:
        seq = word.findall(lower(body))
        wins = [tuple(seq[i : i + width]) for i in range(max(1, len(seq) - width + 1))] if seq else []
        for w in set(wins):
            for i in range(len(words) - len(w) + 1):
                if tuple(words[i : i + len(w)]) == w:
                    hit |= set(range(i, i + len(w)))
                    found.add(str(item))
    return len(words), sorted(hit), sorted(found)


@pytest.mark.parametrize("block", [16_000_000, 200])
def test_contamination(spark, block):
    long = " ".join(f"w{i}" for i in range(40))
    items = [(1, long), (2, "Short item, here!"), (10, "short ITEM here"), (3, "..."), (4, None), (None, "nameless words"), (5, " ".join(f"w{i}" for i in range(20, 60)))]
    texts = [long, "x " + " ".join(f"w{i}" for i in range(5, 25)) + " y", "a short-item here b", "w1 w2 w3", None, "", " ".join(f"w{i}" for i in range(12)), "nameless words", "pad " * 400 + " ".join(f"w{i}" for i in range(13)), long + " | " + long, "Short Item HERE short item here"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.contamination(clashing(docs, "hits", "items", "n_words"), bench, block_chars=block).collect()
    for r in found:
        n, hit, named = plain_hits(texts[r["doc_id"]], items)
        named = [x for x in named if x != "None"]
        assert (r["n_words"], r["hits"], r["items"]) == (n, hit, named)
        assert r["contaminated"] == (len(hit) > 0 and 20 * len(hit) >= n)
    kept = decontaminate.decontaminated(clashing(docs, "hits", "__text"), bench)
    assert kept.columns == ["doc_id", "text", "hits", "__text"]
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in found if not r["contaminated"]}


def test_contamination_of_awkward_rows(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    rows = decontaminate.contamination(awkward(spark), none).collect()
    assert len(rows) == 11 and not any(r["contaminated"] for r in rows)
    some = spark.createDataFrame([(1, "word word word")], "item_id long, text string")
    assert {r["doc_id"] for r in decontaminate.contamination(awkward(spark), some).where("contaminated").collect()} == {6}
    assert decontaminate.contamination(empty(spark), some).count() == 0


def test_spans_go():
    assert decontaminate.without_spans("Keep this, BAD words; and Keep.", [2, 3]) == "Keep this, ; and Keep."
    assert decontaminate.without_spans(None, [1]) is None and decontaminate.without_spans("a", []) == "a"


def test_op10(spark, small):
    """All documents, with windows as tuples of words in a plain dictionary."""
    where = defaultdict(set)
    for item, text in spark.read.parquet(f"{small}/benchmark.parquet").select("item_id", "text").collect():
        seq = plain_words(text)
        for k in range(max(1, len(seq) - 12) if seq else 0):
            where[tuple(seq[k : k + 13])].add(str(item))
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    rows = {r["doc_id"]: r for r in decontaminate.op10_decontaminate(spark, small).collect()}
    assert set(rows) == set(texts) and any(r["contaminated"] for r in rows.values())
    for doc, text in texts.items():
        seq, hit, named = plain_words(text), set(), set()
        for length in {len(w) for w in where}:
            for k in range(len(seq) - length + 1):
                if found := where.get(tuple(seq[k : k + length])):
                    hit |= set(range(k, k + length))
                    named |= found
        digest = hashlib.sha256(",".join(sorted(named)).encode()).hexdigest()
        r = rows[doc]
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == (len(seq), len(hit), len(named), digest, bool(hit) and 20 * len(hit) >= len(seq))


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def test_passages_are_removed(spark):
    passage = " ".join(f"w{i}" for i in range(13))
    docs = spark.createDataFrame([(1, f"Before, {passage}; after."), (2, "Clean text."), (3, None), (3, f"{passage}")], "doc_id long, text string").selectExpr("*", "'mine' as hits", "doc_id as __c0")
    got = decontaminate.cleaned(docs, spark.createDataFrame([(1, passage.upper())], "item_id long, text string"))
    assert got.columns == docs.columns
    assert sorted((r["doc_id"], r["text"] or "", r["hits"]) for r in got.collect()) == [(1, "Before, ; after.", "mine"), (2, "Clean text.", "mine"), (3, "", "mine"), (3, "", "mine")]


def test_a_block_of_items_is_small():
    """Two million characters: a few tens of bytes for each word, found again all the same."""
    lot = np.random.default_rng(8)
    items = [(str(i), " ".join(f"w{x}" for x in lot.integers(0, 20_000, 400))) for i in range(800)]
    made = decontaminate.Windows(items)
    table = made.tables[13]
    held = sum(x.nbytes for x in (made.words, table.hashes, table.starts, table.owners, table.marks))
    assert held < 50 * len(made.words)
    counts, hits, names = made.scan([items[5][1], "w1 w2", f"x {items[7][1][:2000]} y {items[9][1]}"])
    assert counts[0] == len(hits[0]) == 400 and names == [["5"], [], ["7", "9"]]


# --- URL filters ---------------------------------------------------------------------------------------------------

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/e", "allow"), ("", "", "block"), ("org", "", "block"), ("dup.io", "/", "allow"), ("dup.io", "/", "block"), (None, "/", "block")]
URLS = ["http://EXAMPLE.com/en/x", "https://www.example.com/en/", "https://a.www.example.com/en/?q", "http://x.net/es/", "http://x.net/e", "http://x.net/", "http://org", "http://notorg/", None, "no scheme", "://", "http://com/", "http://example.com:80/en/", "ftp://a.b.org#x://y", "http://dup.io/", "http://x.com?//y", "http://example.com/en"]


def plain_verdict(url):
    at = (url or "").find("://")
    rest = url[at + 3 :] if at >= 0 else ""
    host = lower(re.split(r"[/?#]", rest, maxsplit=1)[0])
    path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
    best = None
    for h, p, v in RULES:
        if h is not None and h and host and (host == h or host.endswith("." + h)) and path.startswith(p):
            best = max(best, (len(h + p), h + p, v)) if best else (len(h + p), h + p, v)
    return host, path, best[1] if best else None, best[2] if best else "allow"


@pytest.mark.parametrize("limit", [1000, 2])
def test_url_filters(spark, limit):
    pages = spark.createDataFrame(list(enumerate(URLS)) + [(0, URLS[0])], "page_id int, url string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    found = url_filters.filter_urls(clashing(pages, "host", "verdict", "row"), rules, ("page_id", "verdict"), broadcast_rules=limit)
    native(found)
    rows = found.collect()
    assert len(rows) == len(URLS) + 1
    for r in rows:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == plain_verdict(URLS[r["page_id"]]), URLS[r["page_id"]]
    assert url_filters.filter_urls(pages.limit(0), rules, ("page_id",)).count() == 0
    assert {r["verdict"] for r in url_filters.filter_urls(pages, rules.limit(0), ("page_id",), default="block").collect()} == {"block"}


def test_op5(spark, small):
    from compare import connect, differences

    df = url_filters.op5_url_filters(spark, small)
    native(df)
    assert differences(df, connect(small), url_filters.ORACLE) == ""
    assert defaultdict(int, {r["verdict"]: 1 for r in df.collect()})["block"]
