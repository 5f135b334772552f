"""The three trained models, and the pipeline."""

from __future__ import annotations

import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from helpers import awkward, clashing, empty, split
from pyspark.sql import functions as F

import corpus_pipeline
from quillmill.llm import language_id, lbl, lm, near_dups, packing, toxicity
from quillmill.llm.common import fold
from quillmill.llm.vocab import tokenizer, vocabulary
from quillmill.session import shared_dir


def test_every_training_position_teaches(spark):
    """Tasks visit all positions of all texts: the tokens they learned from are those of the table."""
    docs = spark.createDataFrame([(f"{'a b c d e ' * (i % 7)}w{i}",) for i in range(300)] + [(None,), ("",)], "text string").repartition(5)
    model, _ = lm.fit(docs)
    rows = lm.lessons(docs, spark.sparkContext.broadcast(model)).where("class = -1").collect()
    assert sum(np.frombuffer(bytes(r["tally"]), "<f8").sum() for r in rows) == model.total == sum(5 * (i % 7) + 2 for i in range(300)) + 2


def test_folds(spark):
    rows = spark.createDataFrame([(i,) for i in (0, 7, -3, 10**12, None)], "i long").select("i", fold(F.col("i"), 7).alias("f")).collect()
    assert [r["f"] for r in rows] == [zlib.crc32(("" if r["i"] is None else str(r["i"])).encode()) % 7 for r in rows]


def test_shared_dir_is_read_from_the_session(spark):
    assert shared_dir(spark).startswith("/tmp/checkpoints")


# --- language model ------------------------------------------------------------------------------------------------


def test_base_scores_are_exact(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    rows = {r["doc_id"]: r for r in lm.op1_lm_scores(spark, small).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    train = Counter()
    for k, t in texts.items():
        if zlib.crc32(str(k).encode()) % 7 != 2:
            train.update([*split(t), None])
    total, types = sum(train.values()), len(train)
    assert set(rows) == set(texts)
    for k, t in texts.items():
        words = [*split(t), None]
        r = rows[k]
        assert r["held_out"] == (zlib.crc32(str(k).encode()) % 7 == 2)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(words), sum(train[w] > 0 for w in words), total)
        assert r["base_score"] == pytest.approx(sum(math.log10((train[w] + 1) / (total + types + 1)) for w in words))


def test_words_beyond_the_dictionary_meet_their_counts(spark):
    rows = [(i, f"common word{i % 40} Rare{i}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model, counts = lm.fit(docs, dictionary=20)
    assert len(model.frequent) < 25 and model.total == 1200 and model.types == 342
    probe = spark.createDataFrame([(1, "common rare7 rare7 unseen"), (1, "common rare7 rare7 unseen"), (2, None)], "doc_id long, text string")
    got = sorted((tuple(r) for r in lm.score(probe, model, counts).collect()), key=str)
    base = sum(math.log10((c + 1) / (1200 + 342 + 1)) for c in (300, 1, 1, 0, 300))
    assert [g[:3] for g in got] == [(1, 5, 4), (1, 5, 4), (2, 1, 1)]
    assert got[0][3] == pytest.approx(base) and got[0] == got[1]


def test_probabilities_are_normalised(spark):
    rng = random.Random(1)
    docs = spark.createDataFrame([(i, " ".join(rng.choice("abc") + str(rng.randrange(9)) for _ in range(30))) for i in range(200)], "doc_id long, text string")
    model, _ = lm.fit(docs)
    for before in ([], [3], [3, 9], [1, 5, 7], [20, 20, 1, 2]):
        ids = np.array([[*before, k] for k in range(lbl.LEAVES)], np.uint16)
        found = model.net.log10(ids.reshape(-1), np.arange(lbl.LEAVES) * ids.shape[1]).reshape(ids.shape)[:, -1]
        assert (10**found).sum() == pytest.approx(1, abs=1e-3)
    known = [w for w in model.frequent if w != b" "]
    ids = {w: int(model.ids[i]) for i, w in enumerate(model.frequent)}
    assert len(known) == 27 and all(0 < ids[w] <= lm.HEADS for w in known)


def plain_scores(model, text, counts):
    """Token by token: the prediction of the last three leaves, a softmax over classes, and one over the leaves of the class."""
    w = {k: v.astype(float) for k, v in model.net.weights.items()}
    places = {v: i for i, v in enumerate(model.frequent)}
    leaf = lambda t: int(model.ids[places[t]]) if t in places else lm.group(t)
    shares = lambda z: np.exp(z - z.max()) / np.exp(z - z.max()).sum()
    tokens, before, total = [*lm.words(text), b" "], [0, 0, 0], 0.0
    for t in tokens:
        guess = sum(w["context"][before[-1 - i]] @ w["mix"][i] for i in range(3))
        at = leaf(t)
        k = at // lbl.MEMBERS
        members = slice(k * lbl.MEMBERS, (k + 1) * lbl.MEMBERS)
        total += math.log10(shares(w["group"] @ guess + w["group_bias"])[k])
        total += math.log10(shares(w["leaf"][members] @ guess + w["bias"][members])[at % lbl.MEMBERS])
        if at > lm.HEADS:
            total += math.log10(counts[t] + 1) - model.group_mass[at]
        before.append(at)
    return total


def test_scores_against_a_plain_version(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    model, counts = lm.fit(docs.where(fold(F.col("doc_id"), 7) != 2), dictionary=9000)
    tally = Counter({r["token"].encode(): r["c"] for r in counts.collect()})
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = lm.score(docs, model, counts).collect()
    assert len(rows) == len(texts)
    for r in rows[:60]:
        assert r["score"] == pytest.approx(plain_scores(model, texts[r["doc_id"]], tally), rel=1e-4)
    held = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def table_model(names):
    """A model whose dictionary holds the end and these words."""
    frequent = [b" ", *names]
    ids = np.array([i if i <= lm.HEADS else lm.group(w) for i, w in enumerate(frequent)], np.uint16)
    n = len(frequent)
    return lm.Model(n, n, frequent, np.ones(n, np.int64), ids, np.zeros(lbl.LEAVES), 1, lbl.Net.new(np.ones(lbl.LEAVES)))


def test_numbers_of_odd_texts():
    """Cut and looked up column by column as word by word; a slice keeps to its own rows."""
    texts = ["Ab C\tÄÉ  x\x0b\x0cQ\x1cz  ", "", None, "  lead É\x85e\n\nB nil\x00 AB c c", " \r\n", "c\u2003c \u0130 c"] * 2
    model = table_model([b"ab", b"c", "ÄÉ".encode(), b"b"])
    for part in (slice(0, 12), slice(1, 3), slice(4, 5), slice(3, 12), slice(0, 0)):
        flat, sizes = lm.cut(pa.array(texts, pa.string())[part])
        plain = [lm.words(t) for t in texts[part]]
        assert [w.encode() for w in flat.to_pylist()] == [w for ws in plain for w in ws] and sizes.tolist() == [len(ws) for ws in plain]
        place, ids, stops, at, rare = model.number(pa.array(texts, pa.string())[part])
        tokens = [w for ws in plain for w in [*ws, b" "]]
        assert place.tolist() == [model.frequent.index(w) if w in model.frequent else -1 for w in tokens]
        assert ids.tolist() == [model.frequent.index(w) if w in model.frequent else lm.group(w) for w in tokens]
        assert stops.tolist() == np.cumsum([len(ws) + 1 for ws in plain]).tolist() and [tokens[i].decode() for i in at] == rare.to_pylist()


def test_reading_steps_are_bounded_and_whole(monkeypatch):
    monkeypatch.setattr(lm, "READ_BYTES", 1000)
    texts = ["a" * (37 * i % 400) for i in range(200)] + ["b" * 5000, None, ""]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])
    parts = list(lm.read([batch, batch.slice(0, 0), batch.slice(190)]))
    assert [t for p in parts for t in p.column(0).to_pylist()] == texts + texts[190:]
    assert all(p.nbytes <= 1000 or p.num_rows == 1 for p in parts)


def test_numbering_costs_less_than_a_lookup_for_each_word():
    rng = np.random.default_rng(0)
    names = [f"w{i}".encode() for i in range(30_000)]
    picked = (30_000 * rng.random(600_000) ** 3).astype(int)
    texts = [" ".join(f"W{i}" for i in part) for part in picked.reshape(2000, 300)]
    column, model = pa.array(texts, pa.string()), table_model(names)
    places = {w: i for i, w in enumerate(model.frequent)}

    def cost(f):
        found = []
        for _ in range(3):
            began = time.thread_time()
            f()
            found.append(time.thread_time() - began)
        return min(found)

    by_word = cost(lambda: np.fromiter((places.get(w, -1) for t in column.to_pylist() for w in [*lm.words(t), b" "]), np.int32))
    assert cost(lambda: model.number(column)) < 0.7 * by_word


def test_a_step_against_a_plain_version():
    """One minibatch, with very frequent leaves: the gradients written out in doubles, added up row by row."""
    rng = np.random.default_rng(0)
    net = lbl.Net.new(rng.integers(1, 50, lbl.LEAVES).astype(float))
    for name, x in net.weights.items():
        x += rng.normal(0, 0.3, x.shape).astype(np.float32)
        net.history[name] += rng.random(x.shape).astype(np.float32)
    target = (lbl.LEAVES * rng.random(1500) ** 8).astype(np.uint16)
    before = (lbl.LEAVES * rng.random((1500, lbl.ORDER)) ** 8).astype(np.uint16)
    w = {k: v.astype(float) for k, v in net.weights.items()}
    own, members = target.astype(int) // lbl.MEMBERS, lbl.MEMBERS
    held = np.unique(own)
    drawn = dict(zip(held.tolist(), net.draw(held, np.random.default_rng(5)), strict=True))
    odds = lambda x: 1 / (1 + np.exp(-x))
    steps = {k: np.zeros(v.shape) for k, v in w.items()}
    classes = net.unigrams.reshape(-1, members).sum(axis=1)
    for t, k, b in zip(target.tolist(), own.tolist(), before.tolist(), strict=True):
        guess = sum(w["context"][x] @ m for x, m in zip(b, w["mix"], strict=True))
        pull = -lbl.RATIO * classes * odds(w["group"] @ guess + w["group_bias"] - np.log(lbl.RATIO * classes))
        pull[k] += 1 - odds(w["group"][k] @ guess + w["group_bias"][k] - np.log(lbl.RATIO * classes[k]))
        inner = lambda at: w["leaf"][at] @ guess + w["bias"][at] - np.log(lbl.RATIO * net.unigrams[at] / classes[k])  # noqa: B023, E731
        gain, lost = 1 - odds(inner(t)), -lbl.RATIO / lbl.DRAWN * odds(inner(drawn[k]))
        back = pull @ w["group"] + gain * w["leaf"][t] + lost @ w["leaf"][drawn[k]]
        steps["leaf"][t] += gain * guess
        steps["bias"][t] += gain
        np.add.at(steps["leaf"], drawn[k], lost[:, None] * guess)
        np.add.at(steps["bias"], drawn[k], lost)
        for i, x in enumerate(b):
            steps["context"][x] += w["mix"][i] @ back
            steps["mix"][i] += np.outer(w["context"][x], back)
        steps["group"] += pull[:, None] * guess
        steps["group_bias"] += pull
    history = {k: v + steps[k] ** 2 for k, v in net.history.items()}
    net.step(before, target, np.random.default_rng(5))
    for k in w:
        assert np.allclose(net.history[k], history[k], rtol=1e-3, atol=1e-4), k
        assert np.allclose(net.weights[k], w[k] + lbl.RATE * steps[k] / np.sqrt(history[k]), atol=1e-4), k


def test_steep_scores_are_normalised():
    scores = np.array([[500, 0, -500], [-900, -901, -902], [1, 2, 3]], np.float32)
    for rows in (scores, scores[2:]):
        plain = rows.astype(float) - np.logaddexp.reduce(rows.astype(float), axis=1)[:, None]
        for c in range(3):
            assert np.allclose(lbl.chosen(rows.copy(), np.full(len(rows), c)), plain[:, c], atol=1e-4)


def test_what_tasks_learn_merges_in_any_order():
    rng = np.random.default_rng(0)
    start = lbl.Net.new(rng.integers(1, 50, lbl.LEAVES).astype(float))
    parts = []
    for seed in range(4):
        net, ids = start.copy(), rng.integers(0, 300, 3000).astype(np.uint16)
        net.train(ids, np.arange(0, 3000, 30), np.random.default_rng(seed))
        parts.append((net, np.bincount(ids, minlength=lbl.LEAVES)))
    whole, left, right = lbl.Total(), lbl.Total(), lbl.Total()
    for i, (net, tally) in enumerate(parts):
        for row in lbl.learned(start, net, tally):
            whole.add(*row)
            (left if i < 2 else right).add(*row)
    again = lbl.Total()
    for row in [*right.means(), *left.means()]:
        again.add(*row)
    a, b = whole.applied(start), again.applied(start)
    n = np.stack([t for _, t in parts])[:, :300, None]
    mean = (n * np.stack([net.weights["leaf"][:300] for net, _ in parts])).sum(axis=0) / n.sum(axis=0)
    assert np.allclose(a.weights["leaf"][:300], mean, atol=2e-3) and (a.weights["leaf"][300:] == start.weights["leaf"][300:]).all()
    assert all(np.allclose(a.weights[k], b.weights[k], atol=2e-3) for k in a.weights)


def test_the_model_learns_order(spark):
    """Words that follow each other strictly: far better than counts alone, on unseen texts too."""
    ring = [f"w{i}" for i in range(20)]
    text = lambda s: " ".join(ring[(s + j) % 20] for j in range(60))
    docs = spark.createDataFrame([(i, text(i)) for i in range(200)], "doc_id long, text string")
    model, counts = lm.fit(docs)
    for r in lm.score(spark.createDataFrame([(1, text(3))], "doc_id long, text string"), model, counts).collect():
        assert r["score"] > 0.3 * r["base_score"]


def test_language_model_of_awkward_rows(spark):
    model, counts = lm.fit(awkward(spark).select("doc_id", "text"))
    assert lm.score(clashing(awkward(spark), "score", "n_tokens"), model, counts).count() == 11
    assert lm.score(empty(spark), model, counts).count() == 0
    blank, none = lm.fit(empty(spark))
    row = lm.score(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), blank, none).first()
    assert (row["n_tokens"], row["n_known"], row["base_score"]) == (3, 0, 0.0)
    assert row["score"] < 0


# --- language identification ---------------------------------------------------------------------------------------

SYLLABLES = {"aa": ["ka", "ta", "ra", "ma"], "bb": ["ish", "esh", "osh", "ush"], "cc": ["züg", "bög", "läg", "füg"]}


def spoken(rng, lang, n=40):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


def test_language_id(spark):
    rng = random.Random(3)
    rows = [(i, spoken(rng, lang), lang) for i, lang in enumerate(list(SYLLABLES) * 60)]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    probe = [(i, spoken(rng, lang), lang) for i, lang in enumerate(list(SYLLABLES) * 10)]
    found = language_id.identify(clashing(spark.createDataFrame(probe, "doc_id long, text string, truth string"), "lang_pred"), model, keep=("truth", "lang_pred"))
    rows = found.collect()
    assert found.columns == ["truth", "lang_pred", "score", "rejected"]
    assert all(r["lang_pred"] == r["truth"] and not r["rejected"] and 0 < r["score"] <= 1 for r in rows)
    odd = {r["doc_id"]: r for r in language_id.identify(awkward(spark), model).collect()}
    assert [odd[k]["lang_pred"] for k in (3, 4, 5)] == ["und"] * 3 and odd[3]["rejected"] and odd[3]["score"] == 0
    far = spark.createDataFrame([(1, "0101 1010 0x"), (2, "12 ² ½")], "doc_id long, text string")
    assert [r["rejected"] for r in language_id.identify(far, model).orderBy("doc_id").collect()] == [True, True]
    assert language_id.identify(empty(spark), model).count() == 0


def test_language_id_without_labels(spark):
    model = language_id.fit(empty(spark))
    assert {r["lang_pred"] for r in language_id.identify(awkward(spark), model).collect()} == {"und"}


def test_op9_on_held_out_texts(spark, small):
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    rows = language_id.op9_language_id(spark, small).collect()
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == len(truth) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) / len(held) > 0.9


def test_far_texts_are_rejected(spark, small):
    """Letters at random and scripts never learned go, at any length; held-out texts stay."""
    rng = random.Random(11)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randint(2, 9)))
    latin, cyrillic, han = "abcdefghijklmnopqrstuvwxyz", [chr(c) for c in range(0x430, 0x450)], [chr(c) for c in range(0x4E00, 0x9FFF)]
    far = [" ".join(word(letters) for _ in range(n)) for letters in (latin, cyrillic, han) for n in (10, 50, 200, 1000) for _ in range(5)]
    docs = spark.read.parquet(f"{small}/documents.parquet")
    model = language_id.fit(language_id.training_rows(docs))
    assert all(model.predict(far)[2])
    held = [r["text"] for r in docs.where("lang is not null").collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert np.mean(model.predict([t for t in held if language_id.readable(t)])[2]) < 0.03


def test_copies_of_one_text_leave_other_languages_alone(spark):
    """12,000 copies of a text of the first language beside 500 texts of another."""
    rng = random.Random(4)
    one = spoken(rng, "aa")
    rows = [(one, "aa")] * 12_000 + [(spoken(rng, "aa"), "aa") for _ in range(300)] + [(spoken(rng, "bb"), "bb") for _ in range(500)]
    model = language_id.fit(spark.createDataFrame(rows, "text string, lang string"), sample=800)
    assert set(model.labels) == {"aa", "bb"}
    probe = [spoken(rng, lang) for lang in ("aa", "bb") for _ in range(20)]
    langs, scores, rejected = model.predict(probe)
    assert langs == ["aa"] * 20 + ["bb"] * 20 and not any(rejected)
    assert model.predict([probe[0], probe[0]])[1] == pytest.approx([scores[0]] * 2, rel=1e-5)


def test_every_language_keeps_several_live_centroids(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    model = language_id.fit(language_id.training_rows(docs))
    texts = [r["text"] for r in docs.collect() if language_id.readable(r["text"])]
    nearest = (model.weigh(language_id.counts(texts)) @ model.vectors.T).argmax(axis=1)
    live = Counter(model.labels[k] for k in set(nearest.tolist()))
    assert set(live) == set(model.labels) and min(live.values()) >= 2


def test_unlearned_languages_are_rejected(spark, small):
    """Each language in turn is left out of training: its texts go, those of the others stay."""
    docs = spark.read.parquet(f"{small}/documents.parquet").where("lang is not null")
    held = [(r["text"], r["lang"]) for r in docs.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 and language_id.readable(r["text"])]
    gone, lost = [], []
    for lang in sorted({lang for _, lang in held}):
        model = language_id.fit(language_id.training_rows(docs).where(F.col("lang") != lang))
        rejected = model.predict([t for t, _ in held])[2]
        gone += [x for x, (_, at) in zip(rejected, held, strict=True) if at == lang]
        lost += [x for x, (_, at) in zip(rejected, held, strict=True) if at != lang]
    assert np.mean(gone) >= 0.9
    assert np.mean(lost) <= 0.01


def test_what_lies_between_letters_does_not_count():
    a, b = language_id.counts(["the cat*** sat", "The 12 cat & sat!"])
    assert (a == b).all() and a.sum() == 11  # " the cat sat "
    assert language_id.counts(["", "日本"])[0].sum() == 0


# --- toxicity ------------------------------------------------------------------------------------------------------


def test_toxicity_finds_documents_and_sentences(spark):
    rng = random.Random(5)
    word = lambda: rng.choice("abcdefgh") + rng.choice("aeiou") + rng.choice("lmnrst") + rng.choice("aeiou")
    sentence = lambda bad: " ".join([word() for _ in range(6)] + ([f"grub{word()}"] if bad else [])) + "."
    bag = lambda bad: " ".join(sentence(bad and i == 2) for i in range(5))
    rows = [(i, bag(i % 4 == 0), int(i % 4 == 0)) for i in range(400)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(1, None), (2, 9), (10**6, 1)], "doc_id long, toxic int")
    scorer = toxicity.fit(docs, labels)
    probe = [(i, bag(i % 2 == 0)) for i in range(60)]
    found = toxicity.toxicity(clashing(spark.createDataFrame(probe, "doc_id long, text string"), "score"), scorer, keep=("doc_id", "text", "score")).collect()
    assert np.mean([r["predicted"] == (r["doc_id"] % 2 == 0) for r in found]) > 0.95
    for r in found:
        for s in r["offending"]:
            assert "grub" in r["text"][s["start"] : s["end"]]
    odd = {r["doc_id"]: r for r in toxicity.toxicity(awkward(spark), scorer).collect()}
    assert odd[3]["score"] == odd[4]["score"] == odd[5]["score"] == pytest.approx(1 / (1 + math.exp(-scorer.leak))) and odd[3]["score"] < 0.1
    assert odd[6]["predicted"] == 0
    assert toxicity.toxicity(empty(spark), scorer).count() == 0


def test_toxicity_without_both_labels(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    scorer = toxicity.fit(docs, spark.createDataFrame([(1, 1)], "doc_id long, toxic int"))
    assert toxicity.toxicity(docs, scorer).first()["score"] < 1e-9


def plain_toxicity(scorer, text):
    """The noisy-or, sentence by sentence and feature by feature; words that share a beginning bring it into their sentence once, as in training."""
    clean = 1 - 1 / (1 + math.exp(-scorer.leak))
    for s in {s for s in re.split(r"[.!?\n]+", (text or "").lower()) if s.strip()}:
        slots = set()
        for w in set(s.split()):
            word = w.strip(toxicity.EDGE)
            names = [word] + [f"{n}:{word[:n]}" for n in toxicity.STEMS if len(word) > n] if word else []
            slots |= {zlib.crc32(x.encode()) % toxicity.SIZE for x in names}
        z = scorer.bias + sum(float(scorer.weights[k]) for k in slots)
        clean *= 1 - 1 / (1 + math.exp(-z))
    return 1 - clean


def test_scores_are_the_noisy_or_of_all_sentences(spark, small):
    docs, labels = (spark.read.parquet(f"{small}/{n}.parquet") for n in ("documents", "labels"))
    scorer = toxicity.fit(toxicity.training_rows(docs), toxicity.training_rows(labels))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = toxicity.op7_toxicity(spark, small).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        assert r["score"] == pytest.approx(plain_toxicity(scorer, texts[r["doc_id"]]), abs=1e-9)
    long = next(t for t in texts.values() if t and scorer.score(t) < toxicity.THRESHOLD and len(toxicity.sentences(t)) > 20)
    assert scorer.score(f"{long}\n{long}\n{long}") == pytest.approx(scorer.score(long))


def test_long_clean_texts_stay_clean(spark, small):
    medium = f"{small}/../sf0.01"
    docs, labels = (spark.read.parquet(f"{medium}/{n}.parquet") for n in ("documents", "labels"))
    scorer = toxicity.fit(toxicity.training_rows(docs), toxicity.training_rows(labels))
    long = [r["text"] for r in docs.join(labels.where("toxic = 0"), "doc_id").collect() if len(toxicity.sentences(r["text"])) > 100]
    assert len(long) >= 10 and all(scorer.score(t) < toxicity.THRESHOLD for t in long)
    rng = random.Random(2)
    unseen = ". ".join(" ".join(f"zq{rng.randrange(10**6)}" for _ in range(8)) for _ in range(2000))
    assert scorer.score(unseen) < toxicity.THRESHOLD


def test_clean_texts_of_every_language_and_length_stay(spark, small):
    """Held-out rows of the larger table; few of its toxic texts are in other languages than English."""
    large = f"{small}/../sf0.1"
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{large}/labels.parquet").collect()}
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{large}/documents.parquet").select("doc_id", "lang", "n_chars").collect()}
    rows = [r for r in toxicity.op7_toxicity(spark, large).collect() if r["held_out"] and labels.get(r["doc_id"]) in (0, 1)]
    edges = np.quantile([docs[r["doc_id"]]["n_chars"] or 0 for r in rows], [0.25, 0.5, 0.75])
    called = {}
    for r in rows:
        d = docs[r["doc_id"]]
        for group in (d["lang"], int(np.searchsorted(edges, d["n_chars"] or 0)), "all"):
            called.setdefault((group, labels[r["doc_id"]]), []).append(r["predicted"])
    for group, label in called:
        if label == 0 and group is not None:
            assert np.mean(called[group, 0]) <= 0.03 + 1.5 / len(called[group, 0]), group
    assert np.mean(called["all", 0]) <= 0.02 and np.mean(called["all", 1]) >= 0.85


def test_hot_ids_are_thinned_by_rows(spark):
    """One id holds 3,000 rows; the sample is bounded, and other ids teach as well."""
    rows = [(0, "fine words here. nothing else.")] * 3000 + [(i, f"word{i} and grubby things. more." if i % 2 else f"word{i} and good things. more.") for i in range(1, 200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int")
    scorer = toxicity.fit(docs, labels, sample=200)
    assert scorer.score("some grubby things.") > 0.3 > scorer.score("some good things.")
    tied = toxicity.toxicity(docs.where("doc_id = 0"), scorer).select("score").distinct()
    assert tied.count() == 1


def test_op7_rows(spark, small):
    rows = toxicity.op7_toxicity(spark, small).collect()
    assert len(rows) == spark.read.parquet(f"{small}/documents.parquet").count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)


# --- pipeline ------------------------------------------------------------------------------------------------------


def test_pipeline_against_plain_versions(spark, small):
    """Each stage's decisions, worked out again one document at a time, on what its predecessor kept."""
    from test_near import plain_components, plain_hits, plain_simhash

    docs = spark.read.parquet(f"{small}/documents.parquet")
    kept = {r["doc_id"]: r["text"] for r in docs.collect()}
    model = language_id.fit(language_id.training_rows(docs))
    kept = {k: t for k, t in kept.items() if not model.predict([t])[2][0]}
    at = docs.where(F.col("doc_id").isin(list(kept)))
    labels = spark.read.parquet(f"{small}/labels.parquet")
    scorer = toxicity.fit(toxicity.training_rows(at), toxicity.training_rows(labels))
    kept = {k: t for k, t in kept.items() if scorer.score(t) < toxicity.THRESHOLD}
    parts = plain_components([(k, plain_simhash(t)) for k, t in sorted(kept.items())])
    kept = {k: t for k, t in kept.items() if parts[k] == k}
    items = [tuple(r) for r in spark.read.parquet(f"{small}/benchmark.parquet").select("item_id", "text").collect()]
    clean = {}
    for k, t in kept.items():
        n, hit, _ = plain_hits(t, items)
        if not (hit and 20 * len(hit) >= n):
            clean[k] = t
    rows = corpus_pipeline.run(spark, small).collect()
    library = tokenizer(vocabulary("word_bpe_49k.json"))
    lengths = Counter()
    for r in rows:
        lengths[r["doc_id"]] += r["length"]
    assert dict(lengths) == {k: len(library.encode(t or "", add_special_tokens=False).ids) + 1 for k, t in clean.items()}
    assert len(clean) < docs.count()


def test_stages_keep_columns_and_stand_odd_rows(spark, small):
    docs = clashing(awkward(spark), "score", "rejected", "fp", "hits")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, small)
        assert out.columns == docs.columns, name
        assert out.count() <= 11
    assert corpus_pipeline.STAGES[-1][1](spark, docs, small).count() > 0
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty(spark), small).count() == 0
    assert near_dups.distinct_documents(docs).columns == docs.columns and packing.BUCKET_WINDOWS
