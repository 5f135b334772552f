"""Cheapest repair of the structure of conversations.

A conversation's roles shall follow a grammar: nothing, or an optional system
turn and then pairs of a user's and an assistant's turn. Rows are kept, given
another role, deleted, or joined by an empty turn, each at a cost. For every
turn a bitset of grammar states is kept for each cost: the states from which
the rest of the conversation can be completed at just that cost. The layers of
one turn lie side by side in one word, so a step (delete: two layers up,
another role: one, an inserted turn: five) is a shift of that word. The first
layer that holds the start state is the cost of the cheapest repair; following
the bits from there, the least letter first, gives the least audit. States
differ by at most 10 in cost, as two inserted turns lead from any to any that
is still of use, so words stay short: layers are counted from the lowest.

Conversations are dealt by id and read in order of their turns, each held by
one task while it is repaired. Those of more than ``BLOCK`` rows or
``BLOCK_BYTES`` are cut into blocks of consecutive rows: each block gives the
costs from any state at its start to any at its end, these are put together
from the last to the first, each block then follows its bits from every state
that may be its first, and the states that are taken are passed on. What one
task holds of such a conversation is a block's rows, or some 40 numbers for
each of its blocks.

Defined cases: nulls in role and text read as one blank, null turns come first,
a null conversation id is an id of its own; rows of equal turn are ordered by
role, first characters and hash of their text; repeated rows are repeats (all but the first are deleted); roles
are known by their first letter, and a role that begins with none of s, u and a
can't be kept; a conversation without rows has no row in ``edits``; an empty
table gives no rows. Texts may be of any length. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmill.llm.common import steps, stored

#: Rows and bytes of text that one task holds at once.
BLOCK = 4096
BLOCK_BYTES = 16_000_000
#: Characters of a text that order rows of equal turn and role; those that share them follow a hash of the text.
HEAD = 64
#: Costs of a new role, a deleted row, an inserted turn, and of a truncated row that stays.
REROLE, DELETE, INSERT, BROKEN = 1, 2, 5, 5
#: States: nothing yet, after a system turn, after a user's, after an assistant's. A conversation may end in the first and the last.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = 4
#: The state after a turn of either role that isn't a system turn; an inserted turn and a new role lead there.
AFTER = (USER, USER, ASSISTANT, USER)
ROLES = {USER: "user", ASSISTANT: "assistant"}
#: The state after a kept row, by its role's first letter and the state before it.
KEPT = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
#: Layers of a word.
LAYERS = 16
MASK = (1 << (STATES * LAYERS)) - 1
ENDS = (0, None, None, 0)
FAULTS = ("", "blank", "duplicate", "truncated")
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
LEGAL = {"su", "ua", "au"}

Costs = tuple[int | None, ...]
#: What the rest of a conversation costs: the cost of the lowest layer, and the layers.
Word = tuple[int, int]


def _sources(after: dict[int, int]) -> list[tuple[int, int]]:
    """(bit of the state after, bits of the states before it)."""
    found: dict[int, int] = {}
    for before, then in after.items():
        found[then] = found.get(then, 0) | 1 << before
    return list(found.items())


STEPS = {letter: _sources(after) for letter, after in KEPT.items()}
ANY = _sources(dict(enumerate(AFTER)))
LOWEST = sum(1 << (STATES * k) for k in range(LAYERS))


def before(word: int, moves: list[tuple[int, int]]) -> int:
    """In all layers at once, the states from which one of ``moves`` leads into a state of ``word``."""
    out = 0
    for then, sources in moves:
        out |= ((word >> then) & LOWEST) * sources
    return out


def up(word: int, layers: int) -> int:
    return (word << (STATES * layers)) & MASK


def settled(base: int, word: int) -> Word:
    """With turns inserted, and the lowest layer that has a state first."""
    word |= up(before(word, ANY), INSERT)
    word |= up(before(word, ANY), INSERT)
    while word and not word & (1 << STATES) - 1:
        word >>= STATES
        base += 1
    return base, word


def word_of(costs: Costs) -> Word:
    base = min(c for c in costs if c is not None)
    return settled(base, sum(1 << (STATES * (c - base) + s) for s, c in enumerate(costs) if c is not None and c - base < LAYERS))


def costs_of(word: Word) -> Costs:
    """The lowest cost of each state."""
    base, bits = word
    return tuple(next((base + k for k in range(LAYERS) if bits >> (STATES * k + s) & 1), None) for s in range(STATES))


def layers(rows: list[tuple[str, int]], end: Word) -> list[Word]:
    """A word before each row, and the one behind the last; a row is its role's first letter and its fault."""
    words = [end]
    for letter, fault in reversed(rows):
        base, word = words[-1]
        here = up(word, DELETE)
        if fault not in (BLANK, DUPLICATE):
            extra = BROKEN if fault == TRUNCATED else 0
            here |= up(before(word, ANY), REROLE + extra)
            if letter in STEPS:
                here |= up(before(word, STEPS[letter]), extra)
        words.append(settled(base, here))
    words.reverse()
    return words


def holds(word: Word, state: int, cost: int) -> bool:
    layer = cost - word[0]
    return 0 <= layer < LAYERS and bool(word[1] >> (STATES * layer + state) & 1)


def trace(rows: list[tuple[str, int]], words: list[Word], state: int, last: bool = True) -> tuple[str, list[int], int]:
    """The least audit from ``state``, the state after each of its edits, and the state at the end. Only the last block ends with inserted turns."""
    cost = costs_of(words[0])[state]
    if cost is None:
        return "", [], -1
    at, audit, after = 0, [], []
    while at < len(rows) or (last and not (cost == 0 and ENDS[state] == 0)):
        options = []
        if at < len(rows):
            letter, fault = rows[at]
            options.append(("D", state, DELETE, 1))
        options.append(("I", AFTER[state], INSERT, 0))
        if at < len(rows) and fault not in (BLANK, DUPLICATE):
            extra = BROKEN if fault == TRUNCATED else 0
            if state in KEPT.get(letter, {}):
                options.append(("K", KEPT[letter][state], extra, 1))
            options.append(("R", AFTER[state], REROLE + extra, 1))
        for edit, then, price, taken in options:
            if holds(words[at + taken], then, cost - price):
                state, cost, at = then, cost - price, at + taken
                audit.append(edit)
                after.append(state)
                break
        else:
            raise AssertionError("a layer without a way on")
    return "".join(audit), after, state


def repair(rows: list[tuple[str, int]]) -> tuple[int, str, list[int]]:
    """Cost, audit and states of one whole conversation."""
    words = layers(rows, word_of(ENDS))
    audit, after, _ = trace(rows, words, START)
    return costs_of(words[0])[START], audit, after


def fault(role: str, text: str, seen: set[bytes]) -> int:
    """A row's first fault; adds the row to those seen."""
    key = hashlib.blake2b(f"{len(role)}:{role}{text}".encode(errors="surrogatepass"), digest_size=16).digest()
    again = key in seen
    seen.add(key)
    said = text.rstrip(" \t\n\x0b\x0c\r")
    if not said:
        return BLANK
    return DUPLICATE if again else 0 if said[-1] in ".!?" else TRUNCATED


def price(edit: str, fault: str) -> int:
    broken = BROKEN if fault == "truncated" else 0
    return {"D": DELETE, "I": INSERT, "K": broken, "R": REROLE + broken}[edit]


#: What ``edits`` adds to the id: the block and the place in it, the edit and its cost, the row with its first fault (nulls where a turn is inserted), and the role of what is left (null where the row is deleted).
EDIT = ["block", "at", "edit", "cost", "turn", "role", "text", "fault", "new_role"]


def edit_schema(source: DataFrame) -> T.StructType:
    conv, turn = source.schema["conv"], source.schema["turn"]
    out = T.StructType().add("conv", conv.dataType).add("block", "long").add("at", "long").add("edit", "string").add("cost", "long")
    return out.add("turn", turn.dataType).add("role", "string").add("text", "string").add("fault", "string").add("new_role", "string")


def arrow_batches(rows: Iterable[tuple], schema: T.StructType, size: int = 2048, most: int = 1 << 24) -> Iterator[pa.RecordBatch]:
    """Rows as record batches of so many rows, or fewer if their strings are long."""
    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = to_arrow_schema(schema)
    held: list[tuple] = []
    weight = 0
    for row in rows:
        held.append(row)
        weight += sum(len(x) for x in row if isinstance(x, str))
        if len(held) == size or weight > most:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), kinds, strict=True)], schema=kinds)
            held, weight = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), kinds, strict=True)], schema=kinds)


def rows_of(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for part in steps(batches):
        yield from zip(*[c.to_pylist() for c in part.columns], strict=True)


def runs(rows: Iterable[tuple], width: int) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """Neighbouring rows that agree in the first ``width`` values."""
    return groupby(rows, key=lambda r: r[:width])


def edit_rows(conv, block: int, codes: list[tuple[str, int]], turns: list[tuple], audit: str, after: list[int]) -> Iterator[tuple]:
    """Rows of ``edits``; ``turns`` are (turn, role, text)."""
    at = 0
    for i, (edit, state) in enumerate(zip(audit, after, strict=True)):
        if edit == "I":
            yield conv, block, i, edit, INSERT, None, None, None, None, ROLES[state]
            continue
        turn, role, text = turns[at]
        wrong = FAULTS[codes[at][1]]
        yield conv, block, i, edit, price(edit, wrong), turn, role, text, wrong, {"D": None, "K": role, "R": ROLES.get(state)}[edit]
        at += 1


def turns_in_order(conversations: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    said = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    rows = conversations.select(F.col(f"`{conv_id}`").alias("conv"), F.col(f"`{turn}`").alias("turn"), said(role).alias("role"), said(text).alias("text"))
    return rows.withColumns({"head": F.substring("text", 1, HEAD), "tie": F.xxhash64("text")})


ORDER = ["conv", "turn", "role", "head", "tie"]


def repair_short(rows: DataFrame) -> DataFrame:
    """Conversations that one task can hold, in one shuffle; the result is in order within its partitions."""
    schema = edit_schema(rows)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for (conv,), group in runs(rows_of(batches), 1):
            turns = [r[1:] for r in group]
            seen: set[bytes] = set()
            codes = [(role[:1], fault(role, text, seen)) for _, role, text in turns]
            _, audit, after = repair(codes)
            yield from edit_rows(conv, 0, codes, turns, audit, after)

    ordered = rows.repartition(F.col("conv")).sortWithinPartitions(*ORDER).select("conv", "turn", "role", "text")
    return ordered.mapInArrow(lambda batches: arrow_batches(found(batches), schema), schema)


def cut(rows: DataFrame, block: int) -> DataFrame:
    """Rows of long conversations in blocks of consecutive ones, numbered by (block, pos) in order; ``kind`` is what is wrong with a row by itself."""
    marked = stored(rows.withColumns({"key": F.to_json(F.struct("conv")), "lot": F.monotonically_increasing_id()}), "long-turns")
    parts = max(1, marked.count() // block)
    order = [*ORDER, "lot"]
    schema = T.StructType([rows.schema["conv"], T.StructField("key", T.StringType()), rows.schema["turn"]])
    schema = schema.add("role", "string").add("text", "string").add("block", "long").add("pos", "integer").add("letter", "string").add("kind", "integer").add("same", "binary")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        first = TaskContext.get().partitionId() << 32
        for _, group in runs(rows_of(batches), 2):
            for i, (conv, key, turn, role, text) in enumerate(group):
                own: set[bytes] = set()
                kind = fault(role, text, own)
                yield conv, key, turn, role, text, first + i // block, i % block, role[:1], kind, own.pop()

    spread = marked.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("conv", "key", "turn", "role", "text")
    return stored(spread.mapInArrow(lambda batches: arrow_batches(number(batches), schema), schema), "long-blocks")


def in_blocks(rows: DataFrame) -> DataFrame:
    """A row for each block: its rows' letters and kinds in order, and the places where a role and text are first met in the conversation."""
    firsts = rows.groupBy("key", "same", "block").agg(F.min("pos").alias("pos"))
    homes = firsts.groupBy("key", "same").agg(F.min("block").alias("block"))
    fresh = firsts.join(homes, ["key", "same", "block"]).groupBy("key", "block").agg(F.collect_list("pos").alias("fresh"))
    listed = rows.groupBy("key", "block").agg(F.any_value("conv").alias("conv"), F.sort_array(F.collect_list(F.struct("pos", "letter", "kind"))).alias("listed"))
    return listed.join(fresh, ["key", "block"], "left").select("key", "block", F.col("listed.letter").alias("letters"), F.col("listed.kind").alias("kinds"), "fresh")


def block_codes(letters: list[str], kinds: list[int], fresh: list[int] | None) -> list[tuple[str, int]]:
    new = set(fresh or ())
    return [(a, k if k == BLANK or i in new else DUPLICATE) for i, (a, k) in enumerate(zip(letters, kinds, strict=True))]


def crossing(codes: list[tuple[str, int]]) -> list[int | None]:
    """Cost from each state before a block to each behind it, row by row; None where there is no way."""
    columns = [costs_of(layers(codes, word_of(tuple(0 if s == t else None for s in range(STATES))))[0]) for t in range(STATES)]
    return [columns[t][s] for s in range(STATES) for t in range(STATES)]


def ends_of_blocks(table: pa.Table) -> pa.Table:
    """What the rest of a conversation costs behind each of its blocks, from the last to the first."""
    blocks = sorted(table.to_pylist(), key=lambda r: r["block"], reverse=True)
    out, ends = [], list(costs_of(word_of(ENDS)))
    for i, r in enumerate(blocks):
        out.append({"key": r["key"], "block": r["block"], "ends": ends, "last": i == 0})
        ways = [r["costs"][s * STATES : (s + 1) * STATES] for s in range(STATES)]
        ends = [min(c + e for c, e in zip(w, ends, strict=True) if c is not None) for w in ways]
    return pa.Table.from_pylist(out, pa.schema([("key", pa.string()), ("block", pa.int64()), ("ends", pa.list_(pa.int64())), ("last", pa.bool_())]))


def states_at_blocks(table: pa.Table) -> pa.Table:
    """The state before each block, from the first to the last."""
    out, state = [], START
    for r in sorted(table.to_pylist(), key=lambda r: r["block"]):
        out.append({"key": r["key"], "block": r["block"], "state": state})
        state = r["leads"][state]
    return pa.Table.from_pylist(out, pa.schema([("key", pa.string()), ("block", pa.int64()), ("state", pa.int32())]))


def repair_long(rows: DataFrame, block: int) -> DataFrame:
    """Conversations of any length, by blocks; the result is in order within its partitions."""
    numbered = cut(rows, block)
    blocks = stored(in_blocks(numbered), "long-codes")
    of = T.StructType().add("key", "string").add("block", "long")

    def cross(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for key, at, letters, kinds, fresh in rows_of(batches):
            yield key, at, crossing(block_codes(letters, kinds, fresh))

    costs = T.StructType([*of.fields]).add("costs", T.ArrayType(T.LongType()))
    crossings = blocks.mapInArrow(lambda b: arrow_batches(cross(b), costs, 16), costs)
    ends = crossings.groupBy("key").applyInArrow(ends_of_blocks, "key string, block long, ends array<long>, last boolean")

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for key, at, letters, kinds, fresh, end, last in rows_of(batches):
            codes = block_codes(letters, kinds, fresh)
            words = layers(codes, word_of(tuple(end)))
            ways = [trace(codes, words, state, last) for state in range(STATES)]
            yield key, at, [w[2] for w in ways], [w[0] for w in ways], [bytes(w[1]) for w in ways]

    ways = T.StructType([*of.fields]).add("leads", T.ArrayType(T.IntegerType())).add("audits", T.ArrayType(T.StringType())).add("states", T.ArrayType(T.BinaryType()))
    traced = stored(blocks.join(ends, ["key", "block"]).mapInArrow(lambda b: arrow_batches(follow(b), ways, 16), ways), "long-traces")
    starts = traced.select("key", "block", "leads").groupBy("key").applyInArrow(states_at_blocks, "key string, block long, state int")
    taken = traced.join(starts, ["key", "block"]).select("key", "block", F.col("audits")[F.col("state")].alias("audit"), F.col("states")[F.col("state")].alias("states"))

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for key, at, audit, states, letters, kinds, fresh in rows_of(batches):
            codes, pos = block_codes(letters, kinds, fresh), 0
            for i, (edit, state) in enumerate(zip(audit, states, strict=True)):
                wrong = None if edit == "I" else FAULTS[codes[pos][1]]
                yield key, at, i, None if edit == "I" else pos, edit, price(edit, wrong), wrong, ROLES[state] if edit in "IR" else None
                pos += edit != "I"

    letters = T.StructType([*of.fields]).add("at", "long").add("pos", "integer").add("edit", "string").add("cost", "long").add("fault", "string").add("given", "string")
    spelled = taken.join(blocks, ["key", "block"]).mapInArrow(lambda b: arrow_batches(spell(b), letters), letters)
    names = numbered.groupBy("key").agg(F.any_value("conv").alias("conv"))
    role = F.when(F.col("edit") == "K", F.col("role")).when(F.col("edit") != "D", F.col("given"))
    made = spelled.join(numbered.drop("conv"), ["key", "block", "pos"], "left").join(names, "key").select("conv", "block", "at", "edit", "cost", "turn", "role", "text", "fault", role.alias("new_role"))
    return made.repartition(F.col("conv")).sortWithinPartitions("conv", "block", "at")


def _parts(conversations: DataFrame, conv_id: str, turn: str, role: str, text: str, block: int, block_bytes: int) -> list[DataFrame]:
    """Edits of short and, if there are any, of long conversations."""
    rows = turns_in_order(conversations, conv_id, turn, role, text)
    sizes = rows.groupBy("conv").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length("text")).alias("bytes"))
    long = stored(sizes.where((F.col("rows") > block) | (F.col("bytes") > block_bytes)).select(F.col("conv").alias("long")), "long-ids")
    if long.isEmpty():
        return [repair_short(rows)]
    same = F.col("conv").eqNullSafe(F.col("long"))
    return [repair_short(rows.join(long, same, "left_anti")), repair_long(rows.join(long, same, "left_semi"), block)]


def edits(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", block: int = BLOCK, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A row for each edit: the id and ``EDIT``. In order of (block, at), what is not deleted is the repaired conversation; an inserted turn's text is empty."""
    made = [p.withColumnRenamed("conv", conv_id) for p in _parts(conversations, conv_id, turn, role, text, block, block_bytes)]
    return made[0] if len(made) == 1 else made[0].unionByName(made[1])


def reports(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", block: int = BLOCK, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A row for each conversation that has rows: what was wrong, the repair's cost and audit, and the SHA-256 of what it leaves. Edits go by one at a time."""
    parts = _parts(conversations, conv_id, turn, role, text, block, block_bytes)
    schema = T.StructType().add("conv", parts[0].schema["conv"].dataType).add("gaps", "long").add("blank", "long").add("duplicate", "long").add("truncated", "long")
    schema = schema.add("illegal", "long").add("cost", "long").add("audit", "string").add("repaired_sha256", "string")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for (conv,), group in runs(rows_of(batches), 1):
            wrong, illegal, total, audit, left = dict.fromkeys(FAULTS, 0), 0, 0, [], 0
            first = latest = None
            distinct, letter, sha = 0, None, hashlib.sha256()
            for _, _, _, edit, cost, turn, role, text, fault, new_role in group:
                audit.append(edit)
                total += cost
                if edit != "I":
                    wrong[fault] += 1
                    illegal += letter is not None and letter + role[:1] not in LEGAL
                    letter = role[:1]
                    if turn is not None and turn != latest:
                        first, latest, distinct = turn if first is None else first, turn, distinct + 1
                if edit != "D":
                    sha.update(f"{chr(10) if left else ''}{new_role}:{text or ''}".encode(errors="surrogatepass"))
                    left += 1
            gaps = latest - first + 1 - distinct if distinct else 0
            yield conv, gaps, *[wrong[f] for f in FAULTS[1:]], illegal, total, "".join(audit), sha.hexdigest()

    made = [p.mapInArrow(lambda batches: arrow_batches(digest(batches), schema), schema).withColumnRenamed("conv", conv_id) for p in parts]
    return made[0] if len(made) == 1 else made[0].unionByName(made[1])


def damaged(conversations: DataFrame) -> DataFrame:
    """What the query does to its table before repair, by the crc32 of each row's ``conv_id:turn``."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    lot = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    text = F.when(F.col("lot") == 1, "").when(F.col("lot") == 2, F.translate(said("text"), ".!?", "")).otherwise(said("text"))
    rows = conversations.select("conv_id", "turn", F.when(lot == 4, "user").otherwise(said("role")).alias("role"), said("text").alias("text"), lot.alias("lot")).where("lot <> 0")
    return rows.select("conv_id", "turn", "role", text.alias("text"), F.explode(F.when(F.col("lot") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    found = reports(damaged(conversations)).withColumnRenamed("conv_id", "id")
    ids = conversations.select("conv_id").distinct()
    every = ids.join(found, ids["conv_id"].eqNullSafe(found["id"]), "left").drop("id")
    none = {c: 0 for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")} | {"audit": "", "repaired_sha256": hashlib.sha256().hexdigest()}
    return every.fillna(none)
