"""Conversation repair against a plain dynamic programme over all edits."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import pytest

from marketweek.llm import repair

COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string, conv int, copies string, seen int, c int, n long"
MOVES = {("E", "s"): "S", ("E", "u"): "U", ("S", "u"): "U", ("A", "u"): "U", ("U", "a"): "A"}


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        last = re.sub(r"[ \t\n\x0b\x0c\r]+\Z", "", text)[-1:]
        out.append("b" if not last else "d" if (role, text) in seen else "" if last in ".!?" else "t")
        seen.add((role, text))
    return out


def least(rows):
    """``(cost, audit, repaired turns)`` over every edit at every state."""
    now = {"E": (0, "", ())}

    def better(table, state, value):
        if state not in table or value[:2] < table[state][:2]:
            table[state] = value

    def insert(table):
        for _ in range(3):
            for state, (cost, audit, kept) in list(table.items()):
                for initial, role in (("u", "user"), ("a", "assistant")):
                    if (state, initial) in MOVES:
                        better(table, MOVES[state, initial], (cost + 5, audit + "I", kept + ((role, ""),)))

    for (_, role, text), fault in zip(rows, faults(rows)):
        insert(now)
        after = {}
        for state, (cost, audit, kept) in now.items():
            better(after, state, (cost + 2, audit + "D", kept))
            if fault in ("b", "d"):
                continue
            extra = 5 * (fault == "t")
            if (state, role[:1]) in MOVES:
                better(after, MOVES[state, role[:1]], (cost + extra, audit + "K", kept + ((role, text),)))
            for initial, name in (("u", "user"), ("a", "assistant")):
                if (state, initial) in MOVES:
                    better(after, MOVES[state, initial], (cost + 1 + extra, audit + "R", kept + ((name, text),)))
        now = after
    insert(now)
    return min((now[s] for s in "EA" if s in now), key=lambda v: v[:2])


def expected(raw):
    conversations = {}
    for conv, turn, role, text in raw:
        rows = conversations.setdefault(conv, [])
        harm = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if harm == 1 else re.sub("[.!?]", "", text) if harm == 2 else text
        rows += [(turn, "user" if harm == 4 else role, text)] * (0 if harm == 0 else 2 if harm == 3 else 1)
    out = {}
    for conv, rows in conversations.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        found, turns = faults(rows), [r[0] for r in rows if r[0] is not None]
        cost, audit, kept = least(rows)
        out[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
            found.count("b"), found.count("d"), found.count("t"),
            sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:])),
            cost, audit, hashlib.sha256("\n".join(r + ":" + t for r, t in kept).encode()).hexdigest(),
        )
    return out


def compared(spark, rows, **options):
    df = spark.createDataFrame([(*r, 1, "x", 2, 3, 4) for r in rows], SCHEMA).repartition(3)
    got = repair.repairs(df, **options)
    assert got.columns == ["conv_id", *COLUMNS]
    got = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in got.collect()}
    assert got == expected(rows)
    return got


@pytest.fixture(scope="module")
def odd_rows():
    rng = random.Random(3)
    texts = ["Hi.", "No", "Yes!", " ", None, "", "What?", "a b", "x.\n", "é中."]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", None, "", "unknown"]
    rows = []
    for conv in [None, -5, *range(150)]:
        for turn in range(rng.randrange(12)):
            turn = rng.choice([turn, turn, turn, None, turn + rng.randrange(3)])
            rows.append((conv, turn, rng.choice(roles), rng.choice(texts)))
    return rows


def test_equals_brute_force(spark, odd_rows):
    got = compared(spark, odd_rows)
    assert {letter for r in got.values() for letter in r[6]} == set("DKR")


def test_insertions_between_given_states():
    """A whole conversation never needs one (deleting is cheaper), a passage may."""
    found = {(p["start"], p["end"]): (p["cost"], p["audit"]) for p in repair.passages([("a", repair.OK)])}
    assert found[repair.START, repair.ASSISTANT] == (repair.INSERT, "IK") and found[repair.START, repair.USER] == (1, "R")


@pytest.mark.parametrize("segment", [5, 64])
def test_long_conversations_in_segments(spark, odd_rows, segment):
    rng = random.Random(4)
    long = [
        (900, None if k < 3 else k // 2, rng.choice(["user", "assistant", "system"]), f"{rng.randrange(250)}{rng.choice(['.', '!', '', ' '])}")
        for k in range(700)
    ]
    same = [(901, 4, "user", "Again.")] * 200 + [(901, k, "user", "Again.") for k in range(5, 60)]
    compared(spark, odd_rows[:200] + long + same, segment=segment)


def test_extremes(spark):
    rows = [
        (1, -(2**63), "user", "a."), (1, 2**63 - 1, "assistant", "b."), (2, 0, "user", "w " * 200_000 + "."),
        (2, 1, "assistant", "\x00."), (3, None, None, None), (4, 7, "assistant", "x" * 1000),
    ]
    df = spark.createDataFrame([(*r, 1, "x", 2, 3, 4) for r in rows], SCHEMA)
    got = {r.conv_id: r for r in repair.repairs(df).collect()}
    want = expected(rows)
    want[1] = (min(want[1][0], 2**63 - 1), *want[1][1:])
    assert {k: tuple(r[c] for c in COLUMNS) for k, r in got.items()} == want


def test_empty_and_dropped(spark):
    assert repair.repairs(spark.createDataFrame([], SCHEMA)).count() == 0
    dropped = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    compared(spark, [(dropped, 0, "user", "Hello.")])


def test_search_is_optimal_and_ascii_least():
    rng = random.Random(5)
    for _ in range(400):
        rows = [(k, rng.choice("suax"), rng.choice(["q.", "q", "", f"{k}.", f"{k}"])) for k in range(rng.randrange(9))]
        effect = {"b": repair.LOST, "d": repair.LOST, "t": repair.CUT, "": repair.OK}
        turns = [(role, effect[f]) for (_, role, _), f in zip(rows, faults(rows))]
        assert repair.whole(turns) == least(rows)[:2]
        cut = rng.randrange(len(turns) + 1)
        halves = [{(p["start"], p["end"]): (p["cost"], p["audit"]) for p in repair.passages(part)} for part in (turns[:cut], turns[cut:])]
        ends = repair.chain(*halves)
        assert min((c + repair.CLOSING[e], a + "I" * (repair.CLOSING[e] // 5)) for (s, e), (c, a) in ends.items() if s == 0) == least(rows)[:2]


def test_bounds_never_exceed_what_is_attained():
    rng = random.Random(6)
    turns = [(rng.choice("suax"), rng.choice([0, 0, 1, 2])) for _ in range(300)]
    bounds = repair.suffix_bounds(turns, repair.CLOSING)
    for k in range(0, 300, 17):
        for state in repair.STATES:
            found = repair.cheapest(turns[k:], state, repair.suffix_bounds(turns[k:], repair.CLOSING))
            assert found[0] == bounds[k][state]
