"""Operator 13 against an exhaustive search."""

from __future__ import annotations

import hashlib
import heapq
import random
import re
from collections import defaultdict
from zlib import crc32

import duckdb
from hypothesis import given, settings
from hypothesis import strategies as st

from quillmill.llm import conversations as c

BLANKS = " \t\n\x0b\x0c\r"
TABLE = "conv_id long, turn long, role string, text string"


def searched(rows):
    """(cost, audit, roles) of the cheapest, least repair; rows are (role, fault). Cheapest first, as roads are."""
    heap, done = [(0, "", 0, ())], set()
    while heap:
        cost, audit, i, roles = heapq.heappop(heap)
        initials = "".join(r[:1] for r in roles)
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", initials):
            return cost, audit, roles
        if (here := (i, initials[-1:])) in done:
            continue
        done.add(here)
        fits = {"": "su", "s": "u", "u": "a", "a": "u"}[initials[-1:]]
        steps = [("I", 5, 0, r) for r in ("user", "assistant")]
        if i < len(rows):
            role, fault = rows[i]
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, roles))
            if fault not in ("blank", "duplicate"):
                more = 5 if fault == "truncated" else 0
                steps += [("K", more, 1, role), ("R", 1 + more, 1, "user"), ("R", 1 + more, 1, "assistant")]
        for edit, price, taken, role in steps:
            if role[:1] and role[:1] in fits:
                heapq.heappush(heap, (cost + price, audit + edit, i + taken, (*roles, role)))


def plainly(rows):
    """The report on (turn, role, text) rows in order."""
    faults, seen = [], set()
    for _, role, text in rows:
        said = text.strip(BLANKS)
        faults.append("blank" if not said else "duplicate" if (role, text) in seen else "" if said[-1] in ".!?" else "truncated")
        seen.add((role, text))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    letters = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(letters, letters[1:], strict=False))
    cost, audit, roles = searched([(r, f) for (_, r, _), f in zip(rows, faults, strict=True)])
    left, texts = list(rows), []
    for edit in audit:
        row = None if edit == "I" else left.pop(0)
        if edit != "D":
            texts.append(row[2] if row else "")
    whole = "\n".join(f"{r}:{t}" for r, t in zip(roles, texts, strict=True))
    return gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, hashlib.sha256(whole.encode()).hexdigest()


def broken(rows):
    """The damage of the query, by conversation."""
    found = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = role if role is not None else " ", text if text is not None else " "
        lot = crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        made = (turn, "user" if lot == 4 else role, "" if lot == 1 else re.sub("[.!?]", "", text) if lot == 2 else text)
        found[conv] += [made] * (0 if lot == 0 else 2 if lot == 3 else 1)
    return {k: sorted(v, key=lambda r: (r[0] is not None, r[0] or 0)) for k, v in found.items()}


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def held(df):
    rows = df.collect()
    assert len({r["conv_id"] for r in rows}) == len(rows)
    return {r["conv_id"]: tuple(r[x] for x in COLUMNS) for r in rows}


def test_query_by_search(spark, small):
    for folder in (small, small.replace("sf0.001", "sf0.01")):
        rows = duckdb.sql(f"select conv_id, turn, role, text from '{folder}/conversations.parquet'").fetchall()
        assert held(c.op13_conversation_repair(spark, folder)) == {k: plainly(v) for k, v in broken(rows).items()}


def test_query_on_awkward_rows(spark, tmp_path):
    rows = [(None, 1, "user", "Hi."), (None, 2, "assistant", "Ho."), (1, None, None, None), (1, 5, "tool", "x!"), (1, 2, "", "No."), (2, None, "user", " \x0b "), (4, 3, "user", "long. " * 200_000)]
    dropped = next(i for i in range(10_000, 20_000) if crc32(f"{i}:0".encode()) % 20 == 0)
    rows.append((dropped, 0, "user", "All of it goes."))
    twice = [(7, t, r, x) for t, r, x in [(0, "system", "Be good."), (1, "user", "Say."), (1, "user", "Say."), (9, "assistant", "Said.")]]
    spark.createDataFrame(rows + twice, TABLE).withColumnRenamed("missing", "x").selectExpr("*", "'mine' as cost", "1 as block").write.parquet(f"{tmp_path}/conversations.parquet")
    got = held(c.op13_conversation_repair(spark, str(tmp_path)))
    assert got == {k: plainly(v) for k, v in broken(rows + twice).items()}
    assert got[dropped] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())
    assert c.reports(spark.createDataFrame([], TABLE)).count() == 0 == c.edits(spark.createDataFrame([], TABLE)).count()


ROWS = st.lists(st.tuples(st.sampled_from(["s", "u", "u", "a", "a", "t", ""]), st.sampled_from([0, 0, 0, 1, 2, 3])), max_size=9)


@settings(max_examples=300, deadline=None)
@given(ROWS, st.integers(1, 4))
def test_cheapest_and_least(rows, block):
    cost, audit, _ = c.repair(rows)
    assert (cost, audit) == searched([(r, c.FAULTS[f]) for r, f in rows])[:2]
    blocks = [rows[i : i + block] for i in range(0, len(rows), block)]
    ends, state, spelled = c.word_of(c.ENDS), c.START, ""
    behind = []
    for b in reversed(blocks):
        behind.insert(0, ends)
        ways = c.crossing(b)
        known = c.costs_of(ends)
        ends = c.word_of(tuple(min(x + y for x, y in zip(ways[s * 4 : s * 4 + 4], known, strict=True) if x is not None) for s in range(4)))
    for i, b in enumerate(blocks):
        piece, _, state = c.trace(b, c.layers(b, behind[i]), state, i == len(blocks) - 1)
        spelled += piece
    assert not rows or spelled == audit


def test_long_conversations_in_blocks(spark):
    """Blocks of five rows give what whole conversations give, with one that holds most rows and repeats itself."""
    lot = random.Random(9)
    texts = ["Yes.", "No!", "Why?", "cut", " ", "Well. ", "ok.", "", "a longer answer."]
    rows = [(lot.choice([0, 0, 0, 1, 2, None]), lot.choice([None, *range(60)]), lot.choice(["system", "user", "assistant", "tool", None]), lot.choice([*texts, None])) for _ in range(900)]
    rows += [(0, 7, "user", "the same again.")] * 200
    table = spark.createDataFrame(rows, TABLE).repartition(3)
    whole, cut = held(c.reports(table)), held(c.reports(table, block=5))
    assert whole == cut and len(whole) == 4
    assert held(c.reports(table, block_bytes=100)) == whole
    edits = c.edits(table, block=5)
    assert edits.columns == ["conv_id", *c.EDIT]
    by_conv = defaultdict(list)
    for r in edits.orderBy("conv_id", "block", "at").collect():
        by_conv[r["conv_id"]].append(r)
    for conv, of in by_conv.items():
        assert "".join(r["edit"] for r in of) == whole[conv][6] and sum(r["cost"] for r in of) == whole[conv][5]
        assert re.fullmatch("(s?(ua)+)?", "".join(r["new_role"][:1] for r in of if r["edit"] != "D"))
