"""Hard negatives, conversation repair and personal data: whole given tables, planted cases and edges against plain versions."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from parcelflow.llm import negatives, personal, repair
from tests.llm import plain

SF = os.environ.get("PARCELFLOW_LLM_SF", "/root/testdata/sf0.001")
VECTORS = "vec_id long, label int, embedding array<double>, rank string, score long, row long, cluster string, anchor int"
TURNS = "conv_id long, turn long, role string, text string, conv string, key int, copies int, code string"


def table(spark, name, *cols):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/{name}.parquet").select(*cols).collect()]


def relabelled(rows):
    return [(i, (k + 1) % 10 if i % 7 == 0 else k, [int(np.floor(256 * float(x))) for x in v]) for i, k, v in rows]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_hard_negatives_of_the_table(spark):
    want = plain.negatives(relabelled(table(spark, "embeddings", "vec_id", "label", "embedding")))
    got = [tuple(r) for r in entry.queries()["op11_hard_negatives"](spark, SF).collect()]
    assert sorted(got) == sorted(want) and want


def test_hard_negatives_planted(spark):
    """Many equal vectors, ties, vectors of other lengths, zeros, large numbers; more pages and bundles than one."""
    rng = random.Random(5)
    rows = [(i, i % 3, [rng.randint(-9, 9) for _ in range(4)]) for i in range(600)]
    rows = [(i, k, [3, 4, 0, 1] if i % 3 == 0 else v) for i, k, v in rows] + [(700, 1, [0, 0, 0, 0]), (750, 1, []), (751, 2, [1]), (800, 5, [10 ** 9, 10 ** 9, 1, 0]),
                                                                             (801, 5, [10 ** 8, 10 ** 9, 0, 0]), (802, 6, [10 ** 8, 10 ** 9 - 10 ** 8, 7, 0])]
    rows += [(850, 7, [1, 1, 1, 1]), (851, 7, [0, 0, 0, 0]), (852, 8, [0, 0, 0, 0])]  # a positive with score 0
    full = [(i, k, v + [0] * (4 - len(v))) for i, k, v in rows]
    none = [(None, 1, [1.0, 2.0, 3.0, 4.0]), (900, None, [1.0]), (901, 1, None), (950, 1, [1.0, None]), (951, 1, [float("nan")]), (952, 1, [float("inf")])]
    given = [(i, k, None if v is None else [None if x is None else float(x) for x in v], "r", 1, 2, "c", 3) for i, k, v in rows + none[1:]]
    df = spark.createDataFrame(given, VECTORS)
    got = negatives.mine_hard_negatives(df, F.col("vec_id") % 50 == 0, clusters=5, bundle=3, page=50).collect()
    assert sorted(map(tuple, got)) == sorted(plain.negatives(full)) and len(got) > 50
    assert negatives.mine_hard_negatives(df, F.lit(False)).count() == 0
    assert negatives.mine_hard_negatives(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    small = [(50, 1, [2.0]), (50, 1, [2.0]), (None, 2, [1.0]), (7, 2, [1.0])]  # a repeated row is another row, a null id comes last
    got = negatives.mine_hard_negatives(spark.createDataFrame(small, "vec_id long, label int, embedding array<double>"), F.col("vec_id") == 50).collect()
    assert sorted((r.anchor_id, r.positive_id, r.rank, r.negative_id or -1, r.negative_score) for r in got) == [(50, 50, 1, 7, 2)] * 2 + [(50, 50, 2, -1, 2)] * 2


def test_exact_scores():
    big = np.array([[2 ** 40, 3]]), np.array([[2 ** 40, 5], [1, 1]])
    assert negatives.inner(*big).tolist() == [[negatives.MOST, 2 ** 40 + 3]]
    near = np.array([[2 ** 26 + 1, 2 ** 26 + 1]])
    assert negatives.inner(near, near).tolist() == [[2 * (2 ** 26 + 1) ** 2]]


def test_bound_is_never_too_low():
    rng = np.random.default_rng(1)
    rows, queries = rng.integers(-50, 50, (300, 6)), rng.integers(-50, 50, (80, 6))
    centres = negatives.fit_centres(list(queries), 4)
    cosines = negatives._cosines(negatives._directions(queries)[0], centres)
    own = cosines.argmax(axis=1)
    radii = np.array([np.arccos(cosines[own == k, k].min()) if (own == k).any() else 0 for k in range(len(centres))])
    bounds, norms = negatives._bounds(rows, centres, radii), negatives._directions(queries)[1]
    assert (queries @ rows.T <= (norms[:, None] * bounds[:, own].T) + 1e-6).all()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_repair_of_the_table(spark):
    want = plain.repairs(table(spark, "conversations", "conv_id", "turn", "role", "text"))
    got = [tuple(r) for r in entry.queries()["op12_conversation_repair"](spark, SF).collect()]
    assert {r[0]: r[1:] for r in got} == want and len(got) == len(want)


@pytest.fixture(scope="module")
def long_turns():
    rng, rows = random.Random(1), []
    for conv, n in [(1, 5000), (2, 300), (3, 65), (4, 64), (None, 130), (5, 1), (6, 3)]:
        for k in range(n):
            role = rng.choice(["system", "user", "assistant", "user", "assistant", "tool", None, "", "User"])
            rows.append((conv, None if k % 41 == 7 else k, role, rng.choice(["Hi.", "ok", "", "What? ", None, f"t{rng.randint(0, 50)}.", f"u{k}", "é　", "\n"])))
    return rows + [(7, 1, "user", "same.")] * 6 + [(8, None, None, None)] * 2


def test_repair_planted(spark, long_turns):
    """Several blocks per conversation, equal rows, nulls, roles of no known initial."""
    df = spark.createDataFrame([(*r, "c", 1, 2, "d") for r in long_turns], TURNS)
    got = {r[0]: tuple(r)[1:] for r in repair.repair_conversations(df).collect()}
    by, seen = {}, set()
    for conv, turn, role, text in long_turns:
        by.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
        seen.add(by[conv][-1][2])
    keys = spark.createDataFrame([(t,) for t in seen], "t string").selectExpr("t", "xxhash64(t) a", "xxhash64(1, t) b").collect()
    order = {r.t: (r.a, r.b) for r in keys}
    assert set(got) == set(by)
    for conv, rows in by.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], order[r[2]]))
        assert got[conv] == plain.repair(rows), conv
    assert repair.repair_conversations(df.limit(0)).count() == 0
    edits, _ = repair.plan_repairs(df)
    turns = repair.repaired_turns(df, edits).where("conv = '=3' AND role IS NOT NULL").orderBy("place").collect()
    assert plain.sha("\n".join(f"{t.role}:{t.text}" for t in turns)) == got[3][-1]


def test_walk_takes_the_smallest_letters():
    rng = random.Random(3)
    for _ in range(300):
        codes = "".join(rng.choice("suaxSUAXd") for _ in range(rng.randint(1, 9)))
        names = {"s": "system", "u": "user", "a": "assistant", "x": "tool", "d": "user"}
        rows = [(i, names[c.lower()], "" if c == "d" else f"t{i}" + ("" if c.isupper() else ".")) for i, c in enumerate(codes)]
        *_, cost, audit, _ = plain.repair(rows)
        edits, state = repair.walk(codes, list(repair.END), repair.START)
        assert "".join(edits) + repair.finish(state) == audit
        split = rng.randint(0, len(codes))  # the same through a checkpoint
        behind = repair.through(repair.transfer(codes[split:]), list(repair.END))
        first, state = repair.walk(codes[:split], behind, repair.START)
        second, state = repair.walk(codes[split:], list(repair.END), state)
        assert first + second == edits and repair.through(repair.transfer(codes[:split]), behind)[0] == cost


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_personal_data_of_the_table(spark):
    got = {r.doc_id: r for r in entry.queries()["op13_personal_data"](spark, SF).collect()}
    docs = table(spark, "documents", "doc_id", "text")
    assert len(got) == len(docs)
    for doc_id, text in docs:
        found = plain.personal(text)
        shown, r = [f"{k}:{a}:{b}" for a, _, k, b in found], got[doc_id]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for _, _, k, _ in found) for x in ("email", "ip", "card", "phone")]
        assert r.base_sha256 == plain.sha(",".join(shown)) and [s for s in r.spans.split(",") if s and not s.startswith("context")] == shown


@pytest.mark.parametrize("letters", ["a1@.+- %_é()9 0\n5b", "0123456789 -.+()", "ab@.@-_1 "])
def test_base_spans(letters):
    rng = random.Random(letters)
    for _ in range(8000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 50)))
        assert personal.base_spans(text) == [(a, k, b) for a, k, _, b in plain.personal(text)], text


def test_unseen_identifiers(spark):
    """Values that stand where many known ones stand are found, and so are those that only their patterns reach; ordinary numbers are not."""
    cards = ["4111 1111 1111 1111", "5500 0000 0000 0004", "4012888888881881", "5105105105105100", "6011000990139424"]
    texts = [f"please pay from account {c} before monday number {i}" for i, c in enumerate(cards)]
    texts += [f"a note. reach me under +1 (555) 010-{1000 + i} after lunch" for i in range(6)]
    texts += ["please pay from account AB-99-771-224 before monday", "reach me under 5550104242 after lunch", "the file AB-99-771-224 is here",
              "the year 20250101 was long", "the year 20260101 was short", "x" * 5000 + " 123456 " + "y" * 5000, None, "", "   "]
    rows = [(i, t, "e", 1, 2) for i, t in enumerate(texts)]
    rows += [(11, texts[11], "e", 1, 2), (None, texts[11], None, None, None), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kind string, value int, start int")
    got = personal.find_personal_data(docs).collect()
    assert len(got) == len(rows)
    found = {r.doc_id: [(f.kind, texts[r.doc_id][f.start:f.end]) for f in r.findings] for r in got if r.doc_id is not None}
    assert found[11] == [("context", "AB-99-771-224")] == found[13] and found[12] == [("context", "5550104242")]
    assert not any(found[i] for i in range(14, len(texts))) and found[0] == [("card", cards[0])]
    assert sorted(len(r.findings) for r in got if r.doc_id is None) == [0, 1]
    assert personal.find_personal_data(docs.limit(0)).count() == 0
    copies = docs.limit(1).crossJoin(spark.range(50)).select("doc_id", "text").unionByName(docs.where("doc_id = 11").select("doc_id", "text").limit(1))
    assert all(f.kind != "context" for r in personal.find_personal_data(copies).collect() for f in r.findings)  # one seed, however often


def test_values_known_in_one_round_serve_the_next(spark):
    edges = [(1, s, True) for s in (10, 11, 12, 13, 14, 15, 16, 17, 18)] + [(2, s, True) for s in (10, 11, 12, 13, 14, 15)] + [(1, 20, False), (2, 20, False), (1, 21, False), (2, 21, False), (1, 22, False), (2, 22, False)]
    edges += [(3, v, False) for v in (20, 21, 22, 30)] + [(4, v, False) for v in (20, 21, 22, 30)]
    given = spark.createDataFrame(edges, "pattern long, value long, seed boolean")
    got = {r.value: r["round"] for r in personal.discover(given, 3, 3, 0.5, 0.6).collect()}
    assert got == {20: 1, 21: 1, 22: 1, 30: 2}
