"""Repair of the structure of conversations by the cheapest edits, with checkpointed dynamic programming.

A conversation's roles must read ``(s?(ua)+)?`` by their initials: four states. How much the rest of a conversation costs from each state is
a vector of four numbers, computed backward. Conversations are sorted over the whole cluster and cut into blocks of about the square root of
their length. Each block is reduced to what it costs from any state to any other, those matrices give the vector behind each block, and only
these checkpoints are kept. Walking forward, a block's own vectors are computed again from its checkpoint, and the walk takes the edit with the
smallest letter among those that are tight. As any block can be walked from each state it may be entered in, blocks are walked side by side
and the right walk is chosen afterwards, so a long conversation is no single task's work until its turns are put out in order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize, release
from .rows import core, text_key

#: What edits cost.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: States: nothing yet, after system, after user, after assistant. Where a role's initial leads, and which role an insert or a new role has.
START, SYSTEM, USER, ASSISTANT = range(4)
KEEP = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
NEXT = (USER, USER, ASSISTANT, USER)
NEXT_ROLE = ("user", "user", "assistant", "user")
END = (0, 4, 2, 0)
#: A row as one letter: its initial (s, u, a, or x for any other), in upper case if it is truncated; d for one that must go.
FORCED = "d"
FAR = 1 << 40
BLOCK = 64

BLANK = r"[^\x20\x09-\x0D]"


def faults(role: Column, text: Column, seen: Column) -> Column:
    """'blank', 'duplicate', 'truncated' or null: a row's first fault; ``seen`` tells whether its role and text came earlier."""
    return F.when(~text.rlike(BLANK), "blank").when(seen, "duplicate").when(~text.rlike(r"[.!?][\x20\x09-\x0D]*\z"), "truncated")


def _closed(vector: list[int]) -> list[int]:
    """With inserted turns in front."""
    for _ in range(3):
        vector = [min(v, INSERT + vector[NEXT[s]]) for s, v in enumerate(vector)]
    return vector


def _steps(code: str, state: int) -> Iterator[tuple[str, int, int]]:
    """(edit, its cost, next state) of a row from a state, the smallest letter first."""
    yield "D", DELETE, state
    if code != FORCED:
        late = TRUNCATED if code.isupper() else 0
        if (state, code.lower()) in KEEP:
            yield "K", late, KEEP[state, code.lower()]
        yield "R", REROLE + late, NEXT[state]


_TABLE = {code: [list(_steps(code, s)) for s in range(4)] for code in "suaxSUAXd"}


def backward(codes: str, vector: list[int]) -> list[list[int]]:
    """The cost vectors in front of each row and, last, behind all."""
    out = [list(vector)]
    for code in reversed(codes):
        behind = out[-1]
        out.append(_closed([min(cost + behind[to] for _, cost, to in steps) for steps in _TABLE[code]]))
    return out[::-1]


def transfer(codes: str) -> list[int]:
    """16 costs: from each state in front of a block to each state behind it."""
    columns = [backward(codes, [0 if s == t else FAR for s in range(4)])[0] for t in range(4)]
    return [columns[t][s] for s in range(4) for t in range(4)]


def through(matrix: list[int], vector: list[int]) -> list[int]:
    return [min(matrix[4 * s + t] + vector[t] for t in range(4)) for s in range(4)]


def walk(codes: str, vector: list[int], state: int) -> tuple[list[str], int]:
    """The edits at each row, inserts in front of it first, and the state behind."""
    vectors, edits = backward(codes, vector), []
    for i, code in enumerate(codes):
        here, behind, made = vectors[i], vectors[i + 1], ""
        while True:
            tight = [(e, to) for e, cost, to in _TABLE[code][state] if cost + behind[to] == here[state]]
            insert = INSERT + here[NEXT[state]] == here[state]
            if insert and (not tight or tight[0][0] > "I"):
                made, state = made + "I", NEXT[state]
            else:
                break
        edits.append(made + tight[0][0])
        state = tight[0][1]
    return edits, state


def finish(state: int) -> str:
    """The inserts behind the last row."""
    made = ""
    while END[state]:
        made, state = made + "I", NEXT[state]
    return made


def _narrow(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    rows = core(turns, conv=conv_col, turn=turn_col, role=role_col, text=text_col)
    conv = F.coalesce(F.concat(F.lit("="), F.col("conv").cast("string")), F.lit(""))
    return rows.select(conv.alias("conv"), F.col("conv").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                       F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text")).withColumn("key", text_key(F.col("text")))


#: Ascending order puts nulls first.
ORDER = ["conv", "turn", "role", "key"]
BLOCKS = ("conv string, part int, block int, turns array<long>, roles array<string>, keys array<struct<a:long,b:long>>, copies array<long>, codes string, "
          "matrix array<long>, first string, last string, illegal long")


def _blocks(rows: DataFrame) -> DataFrame:
    """One row per block of rows that follow one another: (conv, part, block) order them. ``rows``: conv, turn, role, key, copies, code, room."""
    names = ["turn", "role", "key", "copies"]
    out_schema = pa.schema([("conv", pa.string()), ("part", pa.int32()), ("block", pa.int32()), ("turns", pa.list_(pa.int64())), ("roles", pa.list_(pa.string())),
                            ("keys", pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))), ("copies", pa.list_(pa.int64())), ("codes", pa.string()),
                            ("matrix", pa.list_(pa.int64())), ("first", pa.string()), ("last", pa.string()), ("illegal", pa.int64())])

    def run(batches):
        from pyspark import TaskContext
        part = TaskContext.get().partitionId()
        conv, block, held, codes, room = None, 0, {n: [] for n in names}, [], BLOCK

        def made():
            initials = [r[:1] for r in held["role"]]
            wrong = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
            wrong += sum(n - 1 for n in held["copies"])
            text = "".join(codes)
            return {"conv": conv, "part": part, "block": block, "turns": held["turn"], "roles": held["role"], "keys": held["key"], "copies": held["copies"],
                    "codes": text, "matrix": transfer(text), "first": initials[0], "last": initials[-1], "illegal": wrong}
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if codes and (row["conv"] != conv or len(codes) >= room):
                    out.append(made())
                    block = 0 if row["conv"] != conv else block + 1
                    held, codes = {n: [] for n in names}, []
                conv, room = row["conv"], row["room"]
                codes.append(row["code"])
                for n in names:
                    held[n].append(row[n])
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=out_schema)
        if codes:
            yield pa.RecordBatch.from_pylist([made()], schema=out_schema)
    return rows.mapInArrow(run, BLOCKS)


def _checkpoints(blocks: DataFrame) -> DataFrame:
    """(conv, part, block, behind, wrong): the cost vector behind each block of a conversation that has several, and its pairs across their ends."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["part", "block"])
        behind, vector = [], list(END)
        for matrix in rows["matrix"].iloc[::-1]:
            behind.append(vector)
            vector = through([int(x) for x in matrix], vector)
        wrong = [0, *(int(a + b not in ("su", "ua", "au")) for a, b in zip(rows["last"].iloc[:-1], rows["first"].iloc[1:]))]
        return pd.DataFrame({"conv": rows["conv"], "part": rows["part"], "block": rows["block"], "behind": behind[::-1], "wrong": wrong})
    schema = "conv string, part int, block int, behind array<long>, wrong long"
    return blocks.select("conv", "part", "block", "matrix", "first", "last").groupBy("conv").applyInPandas(lambda rows: run(rows), schema)


def _entries(exits: DataFrame) -> DataFrame:
    """(conv, part, block, entry, ends): the state in front of each block, and whether it is the conversation's last."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["part", "block"])
        state, entry = START, []
        for leaves in rows["exits"]:
            entry.append(state)
            state = int(leaves[state])
        return pd.DataFrame({"conv": rows["conv"], "part": rows["part"], "block": rows["block"], "entry": entry, "ends": [False] * (len(rows) - 1) + [True]})
    return exits.groupBy("conv").applyInPandas(lambda rows: run(rows), "conv string, part int, block int, entry int, ends boolean")


def _exits(codes: Column, behind: Column) -> Column:
    def run(codes: pd.Series, behind: pd.Series) -> pd.Series:
        return pd.Series([[walk(c, [int(x) for x in v], s)[1] for s in range(4)] for c, v in zip(codes, behind)])
    return F.pandas_udf(run, "array<int>")(codes, behind)


def _edits(codes: Column, behind: Column, entry: Column, ends: Column) -> Column:
    def run(codes: pd.Series, behind: pd.Series, entry: pd.Series, ends: pd.Series) -> pd.Series:
        out = []
        for c, v, s, last in zip(codes, behind, entry, ends):
            made, state = walk(c, [int(x) for x in v], int(s))
            out.append([*made[:-1], made[-1] + "|" + finish(state)] if last else made)
        return pd.Series(out)
    return F.pandas_udf(run, "array<string>")(codes, behind, entry, ends)


def plan_repairs(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The edits and the counts of faults, for ``repaired_turns`` and for reports.

    Edits: (conv, turn, role, key, copies, code, edits), one row per distinct row of a conversation; ``edits`` are those in front of and at its
    first copy, further copies are deleted, and after ``|`` come the inserts that end the conversation. Counts: (conv, gaps, blank, duplicate,
    truncated, illegal).
    """
    rows = _narrow(turns, conv_col, turn_col, role_col, text_col)
    lean = rows.select("conv", "turn", "role", "key", (~F.col("text").rlike(BLANK)).alias("blank"),
                       faults(F.col("role"), F.col("text"), F.lit(False)).eqNullSafe("truncated").alias("late"))
    lean = materialize(lean.groupBy("conv", "turn", "role", "key", "blank", "late").agg(F.count("*").alias("copies")), "turns")
    # where a role and a text stand at several turns, all but the first are duplicates
    place = F.struct(F.col("turn").isNotNull().alias("set"), F.coalesce("turn", F.lit(0)).alias("turn"))
    again = materialize(lean.where("NOT blank").groupBy("conv", "role", "key").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "again")
    known = lean.join(again, ["conv", "role", "key"], "left")
    repeat = F.col("first").isNotNull() & (place != F.col("first")) & ~F.col("blank")
    initial = F.substring("role", 1, 1)
    letter = F.when(initial.isin("s", "u", "a"), initial).otherwise("x")
    code = F.when(F.col("blank") | repeat, FORCED).otherwise(F.when(F.col("late"), F.upper(letter)).otherwise(letter))
    long = materialize(lean.groupBy("conv").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK * BLOCK).select(
        "conv", F.ceil(F.sqrt("n")).cast("int").alias("room")), "long")
    coded = known.withColumns({"repeat": repeat, "code": code}).join(long, "conv", "left").withColumn("room", F.coalesce("room", F.lit(BLOCK)))
    ordered = coded.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER)
    blocks = materialize(_blocks(ordered.select("conv", "turn", "role", "key", "copies", "code", "room")), "blocks")

    several = materialize(blocks.groupBy("conv").agg(F.count("*").alias("n")).where("n > 1").select("conv"), "several")
    parts = blocks.join(several, "conv")
    ends = materialize(_checkpoints(parts), "checkpoints")
    at = ["conv", "part", "block"]
    entries = materialize(_entries(parts.select(*at, "codes").join(ends, at).select(*at, _exits(F.col("codes"), F.col("behind")).alias("exits"))), "entries")
    whole = blocks.join(ends, at, "left").join(entries, at, "left")
    whole = whole.withColumns({"behind": F.coalesce("behind", F.array(*map(F.lit, END)).cast("array<long>")), "entry": F.coalesce("entry", F.lit(START)),
                               "ends": F.coalesce("ends", F.lit(True))})
    walked = whole.withColumn("edits", _edits(F.col("codes"), F.col("behind"), F.col("entry"), F.col("ends")))
    letters = F.split("codes", "")
    each = F.arrays_zip(F.col("turns").alias("turn"), F.col("roles").alias("role"), F.col("keys").alias("key"), "copies", letters.alias("code"), "edits")
    edits = materialize(walked.select("conv", F.inline(F.slice(each, 1, F.length("codes")))), "edits")

    wrong = whole.groupBy("conv").agg(F.sum(F.col("illegal") + F.coalesce("wrong", F.lit(0))).alias("illegal"))
    copies = F.col("copies")
    once = copies.isNotNull() & ~F.col("blank")
    counted = coded.groupBy("conv", "turn").agg(
        F.sum(F.when(F.col("blank"), copies).otherwise(0)).alias("blank"), F.sum(F.when(once & F.col("repeat"), copies).when(once, copies - 1).otherwise(0)).alias("duplicate"),
        F.sum(F.when(once & ~F.col("repeat") & F.col("late"), 1).otherwise(0)).alias("truncated"))
    counted = counted.groupBy("conv").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps"), *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")])
    counts = materialize(counted.join(wrong, "conv"), "faults")
    release(lean, again, long, blocks, several, ends, entries)
    return edits, counts


REPAIRED = "conv string, place long, edit string, cost long, role string, text string"


def repaired_turns(turns: DataFrame, edits: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, place, edit, cost, role, text): one row per edit, in order within a partition that holds the whole conversation.

    Inserted turns have an empty text; deleted ones have neither role nor text. Each text moves once, to its conversation's partition, and is
    read there row by row.
    """
    rows = _narrow(turns, conv_col, turn_col, role_col, text_col)
    both = edits.select("conv", "turn", "role", "key", "copies", "code", "edits", F.lit(None).cast("string").alias("text"), F.lit(0).alias("side")).unionByName(
        rows.select("conv", "turn", "role", "key", F.lit(None).cast("long").alias("copies"), F.lit(None).cast("string").alias("code"),
                    F.lit(None).cast("string").alias("edits"), "text", F.lit(1).alias("side")))
    both = both.repartition("conv").sortWithinPartitions(*ORDER, "side")
    schema = pa.schema([("conv", pa.string()), ("place", pa.int64()), ("edit", pa.string()), ("cost", pa.int64()), ("role", pa.string()), ("text", pa.string())])

    def run(batches):
        conv, state, place, plan = None, START, 0, None
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                out = []

                def put(edit, cost, role, text):
                    nonlocal place
                    out.append({"conv": conv, "place": place, "edit": edit, "cost": cost, "role": role, "text": text})
                    place += 1
                for row in batch.slice(at, 1024).to_pylist():
                    if row["side"] == 0:
                        if row["conv"] != conv:
                            conv, state, place = row["conv"], START, 0
                        plan = row
                        continue
                    if plan is None:  # a further copy
                        put("D", DELETE, None, None)
                    else:
                        edits, _, tail = plan["edits"].partition("|")
                        late = TRUNCATED if plan["code"].isupper() else 0
                        for edit in edits:
                            if edit == "I":
                                put(edit, INSERT, NEXT_ROLE[state], "")
                                state = NEXT[state]
                            elif edit == "D":
                                put(edit, DELETE, None, None)
                            elif edit == "K":
                                put(edit, late, row["role"], row["text"])
                                state = KEEP[state, row["role"][:1]]
                            else:
                                put(edit, REROLE + late, NEXT_ROLE[state], row["text"])
                                state = NEXT[state]
                        left, plan_tail, plan = plan["copies"], tail, None
                    left -= 1
                    if not left:
                        for _ in plan_tail:
                            put("I", INSERT, NEXT_ROLE[state], "")
                            state = NEXT[state]
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=schema)
    return both.select("conv", "role", "copies", "code", "edits", "text", "side").mapInArrow(run, REPAIRED)


def digests(repaired: DataFrame) -> DataFrame:
    """(conv, cost, audit, repaired_sha256) of ``repaired_turns``: costs summed, edits' letters in order, hash of ``role:text`` lines."""
    schema = pa.schema([("conv", pa.string()), ("cost", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string())])

    def run(batches):
        conv, cost, audit, digest, empty = None, 0, [], None, True
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if digest is None or row["conv"] != conv:
                    if digest is not None:
                        out.append({"conv": conv, "cost": cost, "audit": "".join(audit), "repaired_sha256": digest.hexdigest()})
                    conv, cost, audit, digest, empty = row["conv"], 0, [], hashlib.sha256(), True
                cost += row["cost"]
                audit.append(row["edit"])
                if row["role"] is not None:
                    digest.update((("" if empty else "\n") + row["role"] + ":" + row["text"]).encode())
                    empty = False
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
        if digest is not None:
            yield pa.RecordBatch.from_pylist([{"conv": conv, "cost": cost, "audit": "".join(audit), "repaired_sha256": digest.hexdigest()}], schema=schema)
    return repaired.mapInArrow(run, "conv string, cost long, audit string, repaired_sha256 string")


def repair_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256): one row per conversation of ``turns``.

    A row's first fault counts: blank (no visible character), duplicate (role and text seen earlier), truncated (the last visible character ends
    no sentence). Keep (K) costs 0, a new role (R) 2, Delete (D, the only edit for blank and duplicate rows) 3, an Insert (I) of an empty
    user or assistant turn 2, and a truncated row that stays 1. ``audit`` is the cheapest edits' letters that give role initials
    ``(s?(ua)+)?``, the smallest in ASCII of equally cheap ones.

    Rows go by turn, nulls first, then role, then a hash of the text, so equal turns have a defined order. Null roles and texts count as one
    space, null conversation ids are one conversation, a role without an initial can't be kept. Repeated rows are duplicates; other columns
    are left out; an empty table gives no rows. ``repaired_turns`` gives the turns themselves.
    """
    edits, counts = plan_repairs(turns, conv_col, turn_col, role_col, text_col)
    told = digests(repaired_turns(turns, edits, conv_col, turn_col, role_col, text_col))
    ids = _narrow(turns, conv_col, turn_col, role_col, text_col).select("conv", "conv_id").distinct()
    return ids.join(counts, "conv").join(told, "conv").select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def damaged(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text), nulls of the texts as one space, damaged by ``crc32("conv_id:turn") % 20``: 0 drops a row, 1 empties
    its text, 2 takes its sentence ends away, 3 repeats it, 4 makes its role user."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("kind") == 3, F.sequence(F.lit(1), F.lit(2))).otherwise(F.sequence(F.lit(1), F.lit(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times)).drop("col")
