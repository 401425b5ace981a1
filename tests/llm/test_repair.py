"""Conversation repair against a brute-force version that keeps the best audit of every state as text."""

from __future__ import annotations

import hashlib
import random
import zlib
from itertools import product

import pytest

from watchloom.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string"
NAMES = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
SPACES = " \t\n\x0b\x0c\r"


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        hit = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if hit == 0:
            continue
        if hit == 1:
            text = ""
        if hit == 2:
            text = "".join(c for c in text if c not in ".!?")
        row = (conv, turn, "user" if hit == 4 else role, text)
        out += [row] * (2 if hit == 3 else 1)
    return out


def faults_of(rows):
    seen, found = set(), []
    for role, text in rows:
        bare = text.strip(SPACES)
        found.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return found


def best_edits(rows, faults):
    """(cost, audit, repaired lines): every state keeps its cheapest, then least audit; insertions are tried all over."""
    best = {"": (0, "", ())}  # by the last initial said

    def put(into, state, value):
        if state not in into or value < into[state]:
            into[state] = value

    def insert(states):
        states = dict(states)
        for _ in range(4):
            for state, (cost, audit, lines) in list(states.items()):
                role = "assistant" if state == "u" else "user"
                put(states, role[0], (cost + 2, audit + "I", (*lines, role + ":")))
        return states

    for (role, text), fault in zip(rows, faults, strict=True):
        new = {}
        for state, (cost, audit, lines) in insert(best).items():
            put(new, state, (cost + 3, audit + "D", lines))
            if fault in ("blank", "duplicate"):
                continue
            more = cost + (fault == "truncated")
            if role and state + role[:1] in ("s", "u", "su", "ua", "au"):
                put(new, role[:1], (more, audit + "K", (*lines, f"{role}:{text}")))
            for other in ("user", "assistant"):
                if state + other[0] in ("u", "su", "ua", "au"):
                    put(new, other[0], (more + 2, audit + "R", (*lines, f"{other}:{text}")))
        best = new
    return min(v for s, v in insert(best).items() if s in ("", "a"))


def brute(rows):
    after, out = damage(rows), {}
    for conv in {r[0] for r in rows}:
        own = sorted(((t is not None, t or 0, role, text) for c, t, role, text in after if c == conv))
        turns = {t for some, t, *_ in own if some}
        said = [r[2:] for r in own]
        faults = faults_of(said)
        cost, audit, lines = best_edits(said, faults)
        initials = [role[:1] for role, _ in said]
        out[conv] = (
            max(turns) - min(turns) + 1 - len(turns) if turns else 0, *[faults.count(f) for f in ("blank", "duplicate", "truncated")],
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )
    return out


def results(spark, rows, partitions=3):
    df = spark.createDataFrame(rows, SCHEMA).repartition(partitions)
    found = repair.repair(repair.damaged(df)).collect()
    assert len({r.conv_id for r in found}) == len(found)
    return {r.conv_id: tuple(r[c] for c in NAMES) for r in found}


def talks(seed, convs, most):
    dice = random.Random(seed)
    texts = ["Fine.", "so what", "Why?", "", " \t", "Yes!", "line\nbreak.", "ünï 😀.", None]
    return [
        (conv, None if dice.random() < 0.05 else dice.randrange(most), dice.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]),
         dice.choice(texts) if dice.random() < 0.4 else f"text {dice.random()}" + dice.choice([".", "", "!  "]))
        for conv in range(convs) for _ in range(dice.randrange(most))
    ] + [(None, k, "user", f"x{k}.") for k in range(4)]


def test_row_tables():
    """Distinct audits of one start never continue one another, which the order of stretches rests on."""
    for paths in repair.PATHS:
        for before in range(4):
            audits = [a for (s, _), (_, a) in paths.items() if s == before]
            assert all(not b.startswith(a) for a, b in product(audits, audits) if a is not b)


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, seed):
    rows = talks(seed, 60, 14)
    assert results(spark, rows) == brute(rows)


def test_conversations_over_many_chunks(spark, monkeypatch):
    """Chunks of four rows: conversations that start, end and go on in them, and pieces of few bytes."""
    monkeypatch.setattr(repair, "CHUNK", 2)
    monkeypatch.setattr(repair, "PIECE", 20)
    rows = talks(11, 12, 60) + [(77, None, "user", "Same.")] * 30 + [(78, k, "user", f"{k}.") for k in range(50)]
    assert results(spark, rows, 5) == brute(rows)


def test_one_conversation_holds_most_rows(spark):
    rows = [(1, k, ("user", "assistant")[k % 2], f"t{k % 4000}" + "." * (k % 7 > 0)) for k in range(20_000)] + talks(5, 20, 6)
    assert results(spark, rows) == brute(rows)


def test_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").collect()]
    assert results(spark, rows) == brute(rows)


def test_odd_rows(spark):
    rows = [(1, 0, "user", "Hi."), (1, 0, "user", "Hi."), (2, None, None, None), (3, 5, "system", "x" * 300_000 + "."), (4, 1, "system", "Only.")]
    extra = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS pos", "'x' AS fault", "true AS gone", "2 AS copy")
    got = {r.conv_id: tuple(r[c] for c in NAMES) for r in repair.repair(repair.damaged(extra)).collect()}
    assert got == brute(rows)
    assert repair.repair(repair.damaged(spark.createDataFrame([], SCHEMA))).collect() == []


def test_whole_drop_keeps_the_conversation(spark):
    conv = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    got = results(spark, [(conv, 0, "user", "Hi."), (5000, 1, "user", "Hi.")])
    assert got[conv] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_names_of_conversations_may_be_strings(spark):
    df = spark.createDataFrame([("a", 0, "user", "Hi."), ("a", 1, "assistant", "Ho.")], "conv_id string, turn int, role string, text string")
    [r] = repair.repair(repair.damaged(df)).collect()
    assert r.conv_id == "a"


def test_against_sql(spark):
    import duckdb

    rows = talks(21, 40, 9)
    con = duckdb.connect()
    con.register("conversations", spark.createDataFrame(rows, SCHEMA).toArrow())
    want = con.sql(repair.sql()).select("conv_id", *NAMES).fetchall()
    assert {r[0]: r[1:] for r in want} == results(spark, rows)
