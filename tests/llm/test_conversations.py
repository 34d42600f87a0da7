"""Conversation repair against plain statements of its rules."""

import random

import plain_turns as plain
import pytest

from gradeflow.llm import conversations as c
from gradeflow.llm.survivors import Survivors

COLUMNS = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def turns_of(rng, n):
    return [(rng.choice("suax"), rng.random() < 0.15, rng.random() < 0.3) for _ in range(n)]


def test_cheapest_edits_equal_every_string_tried():
    rng = random.Random(1)
    for n in [0, 1, 1, 2, 2, 3, 3, 4, 4, 5, 5, 5] * 4:
        turns = turns_of(rng, n)
        search = Survivors()
        for t in turns:
            search.turn(*t)
        cost, edits, tail = search.finish()
        assert plain.brute(turns) == plain.cheapest(turns) == (cost, "".join(edits) + tail)


def test_long_sequences_and_what_is_held():
    """Edits that are certain leave the tree; tied ends are kept whole until they are resolved."""
    rng = random.Random(2)
    for kinds in ("suax", "ua", "a", "x"):
        turns = [(rng.choice(kinds), False, rng.random() < 0.1) for _ in range(400)]
        search, most = Survivors(), 0
        for t in turns:
            search.turn(*t)
            most = max(most, max(len(search.edits_to(s)) for s in search.node))
        cost, edits, tail = search.finish()
        assert (cost, "".join(edits) + tail) == plain.cheapest(turns)
    regular = Survivors()
    for i in range(2000):
        regular.turn("ua"[i % 2], False, False)
        regular.done.clear()
        assert max(len(regular.edits_to(s)) for s in regular.node) <= 2000


def made(seed=3, sizes=(0, 1, 2, 3, 5, 8, 30, 200)):
    rng = random.Random(seed)
    texts = ["Hello.", "Why?", "cut off", "", " \t\n", "Fine!\n ", "é. ", None, "x" * 3000 + "."]
    rows = []
    for conv, n in enumerate(sizes):
        for t in range(n):
            rows.append((conv, rng.choice([t, t, t, t + 1, None]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]),
                         rng.choice(texts) if rng.random() < 0.6 else f"Text {rng.randrange(10**6)}."))
    rows += [(None, t, "user", "To nobody.") for t in range(7)]
    rows += [rows[-1]] * 3
    return rows


@pytest.fixture
def table(spark):
    kinds = "conv_id long, turn long, role string, text string, said string, conv int, seq string"
    return lambda rows: spark.createDataFrame([(*r, "z", 1, None) for r in rows], kinds).repartition(3)


def got(report):
    return sorted((tuple(r) for r in report.select("conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "sha").collect()), key=str)


@pytest.mark.parametrize("bits", [10, 3, 1, 0])
def test_repair_for_any_block(table, bits, monkeypatch):
    monkeypatch.setattr(c, "BLOCK_BITS", bits)
    monkeypatch.setattr(c, "PIECE_BYTES", 2000)
    rows = made()
    report = c.repair(table(rows)).report()
    want = plain.report(rows, {r[0] for r in rows})
    none = plain.hashlib.sha256().hexdigest()
    assert [(*r[:8], r[8] or none) for r in got(report)] == sorted(want, key=str)


def test_a_long_conversation_is_many_blocks(table, monkeypatch):
    monkeypatch.setattr(c, "BLOCK_BITS", 4)
    rng = random.Random(5)
    rows = [(1, t, rng.choice(["user", "assistant"]), f"{rng.randrange(500)}.") for t in range(1500)] + [(2, 0, "user", "Hi."), (2, 1, "assistant", "Yes.")]
    found = c.repair(table(rows))
    assert found.edits.where("conv = 1").count() >= 90
    assert got(found.report()) == sorted(plain.report(rows, {1, 2}), key=str)
    kept = [(r.role, r.text) for r in found.turns().where("conv = 2").collect()]
    assert kept == [("user", "Hi."), ("assistant", "Yes.")]


def test_empty_table(table):
    found = c.repair(table([]))
    assert found.report().count() == 0 and found.turns().count() == 0


def test_the_query(spark, table, tmp_path):
    rows = made(9, [1, 1, 1, 1, 1, 1, 1, 1, 4, 6, 20, 60])
    table(rows).write.parquet(f"{tmp_path}/conversations.parquet")
    result = sorted((tuple(r[x] for x in COLUMNS) for r in c.op12(spark, str(tmp_path)).collect()), key=str)
    assert result == sorted(plain.report(plain.damaged(rows), {r[0] for r in rows}), key=str)


def test_the_query_on_a_given_table(spark):
    folder = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    result = sorted((tuple(r[x] for x in COLUMNS) for r in c.op12(spark, folder).collect()), key=str)
    assert result == sorted(plain.report(plain.damaged(rows), {r[0] for r in rows}), key=str)
