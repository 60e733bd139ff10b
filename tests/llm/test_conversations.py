"""Conversation repair: the programme against a search of all edits, figures and hashes against plain Python."""

from __future__ import annotations

import hashlib
import heapq
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from carryover.llm import conversations as c
from carryover.llm import turns as t
from carryover.llm.common import table
from carryover.llm.queries import QUERIES
from tests.conftest import SF_DIR

GOAL = re.compile("(s?(ua)+)?")
FULL = re.compile("[^\x20\x09-\x0d]")
SCHEMA = "conv_id long, turn long, role string, text string"
NAMES = ["conv_id", *c.FIGURE_NAMES, "repaired_sha256"]


def cheapest(turns):
    """(cost, audit, repaired) of (role, text, fault), by trying edits in order of cost and audit."""
    heap, seen = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, at, roles, out = heapq.heappop(heap)
        if at == len(turns) and GOAL.fullmatch(roles):
            return cost, audit, out
        # what matters of the roles: whether any turn is left, whether only a system turn, and the last
        key = (at, roles if len(roles) < 2 else "x" + roles[-1])
        if key in seen or not re.fullmatch("s?(ua)*u?", roles):
            continue
        seen.add(key)
        for role in ("user", "assistant"):
            heapq.heappush(heap, (cost + 2, audit + "I", at, roles + role[0], (*out, f"{role}:")))
        if at < len(turns):
            role, text, fault = turns[at]
            heapq.heappush(heap, (cost + 3, audit + "D", at + 1, roles, out))
            if fault not in ("blank", "duplicate"):
                more = cost + (fault == "truncated")
                heapq.heappush(heap, (more, audit + "K", at + 1, roles + (role[:1] or "?"), (*out, f"{role}:{text}")))
                for new in ("user", "assistant"):
                    heapq.heappush(heap, (more + 2, audit + "R", at + 1, roles + new[0], (*out, f"{new}:{text}")))


def damaged(rows):
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        yield from [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)


def want(rows, hurt=damaged):
    out = []
    by = {r[0]: [] for r in rows}
    for r in hurt(rows):
        by[r[0]].append(r[1:])
    for conv, own in by.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, turns, known = set(), [], [r[0] for r in own if r[0] is not None]
        for _, role, text in own:
            solid = FULL.findall(text)
            fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else ""
            seen.add((role, text))
            turns.append((role, text, fault))
        counts = [sum(x[2] == f for x in turns) for f in ("blank", "duplicate", "truncated")]
        bad = sum((a[0][:1] + b[0][:1]) not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        cost, audit, lines = cheapest(turns)
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        out.append((conv, gaps, *counts, bad, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r[n] for n in NAMES) for r in df.collect()), key=str)


def test_programme_against_search():
    rng = random.Random(3)
    roles = ["system", "user", "assistant", "tool", ""]
    for _ in range(1500):
        some = rng.sample(roles, rng.randint(1, 4))
        turns = [(rng.choice(some), "x", rng.choice(["", "", "blank", "duplicate", "truncated"])) for _ in range(rng.randint(0, 8))]
        faults = {"": t.FINE, "blank": t.BLANK, "duplicate": t.DUPLICATE, "truncated": t.TRUNCATED}
        symbols = bytes(t.symbol(r, faults[f]) for r, _, f in turns)
        cost, audit, lines = cheapest(turns)
        assert t.repair(symbols) == (cost, audit), turns
        assert [f"{r}:{x}" for r, x in t.edited(audit, t.START, [x[:2] for x in turns])[0]] == list(lines)


def test_long_runs_and_cut_audits():
    symbols = bytes([4] * 3001 + [8] * 2900 + [12] * 5 + [7] * 1030 + [9] * 77)
    cost, audit = t.repair(symbols)
    plain, here = [t.END], t.END
    for s in reversed(symbols):
        here = t.before(t.step(s), here)
        plain.append(here)
    assert cost == here[t.START] and sum(e != "I" for e in audit) == len(symbols)
    rng = random.Random(1)
    for _ in range(20):
        cuts = sorted(rng.randint(0, len(symbols)) for _ in range(4))
        sizes = [b - a for a, b in zip([0, *cuts], [*cuts, len(symbols)])]
        parts = t.split(audit, sizes)
        assert "".join(parts) == audit
        state, at = t.START, 0
        for part, size in zip(parts, sizes):
            state, at = t.after(part, state, symbols[at : at + size]), at + size
        assert state in (t.START, t.ASSISTANT)


ODD = [
    (1, 0, "user", "Hi."), (1, 0, "user", "Hi."), (1, None, None, None), (1, None, "assistant", "Early!"), (1, 5, "assistant", "Hi."), (1, 9, "user", "Hi."),
    (None, 1, "user", "No id."), (None, None, "", ""), (None, 2, "assistant", "none\t\n"), (2, None, "user", None), (3, 7, "tool", "x?" * 40_000), (3, 8, "umpire", "é🙂 \n"),
    (4, 1, "user", "a:b\nc."), (4, 1, "assistant", "same turn."), (4, 2, "user", "a:b\nc."), (4, -3, "system", "first."), (5, 1, " ", " "),
]


def frame(spark, rows, parts=3):
    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumn("copies", F.lit("x")).withColumn("again", F.lit(1)).withColumn("part", F.lit(2)).repartition(parts)


@pytest.mark.parametrize("piece", [c.PIECE_BYTES, 0])
def test_odd_rows(spark, piece):
    """Also with pieces of one turn each: a cut conversation gives what a whole one gives."""
    df = frame(spark, ODD)
    rows = c.mend(c.damage(df), piece)
    assert got(c.digests(rows)) == want(ODD)
    plain = [(a, b, *(" " if x is None else x for x in r)) for a, b, *r in ODD]
    assert got(c.digests(c.mend(c.undamaged(df), piece))) == want(plain, lambda x: x)
    assert c.digests(c.mend(c.damage(df.limit(0)))).count() == 0


def test_all_dropped(spark):
    gone = [i for i in range(500) if zlib.crc32(f"{i}:0".encode()) % 20 == 0][:3]
    rows = [(i, 0, "user", "Hello.") for i in gone]
    empty = hashlib.sha256(b"").hexdigest()
    assert got(c.digests(c.mend(c.damage(frame(spark, rows))))) == sorted(((i, 0, 0, 0, 0, 0, 0, "", empty) for i in gone), key=str)


def test_one_conversation_with_most_rows(spark):
    """One conversation over many ranges, one saying in many of its turns, and small ones beside it."""
    rng = random.Random(8)
    roles = ["user", "assistant", "user", "assistant", "system", "tool"]
    hot = [(50, k, rng.choice(roles), rng.choice(["The same.", f"Turn {k}", f"Turn {k}.", " ", f"{k} " * 50])) for k in range(3000)]
    rest = [(i, k, rng.choice(roles[:4]), f"{i} {k}.") for i in range(200) if i != 50 for k in range(rng.randint(1, 6))]
    texts = [(f"c{a}", b, r, x) for a, b, r, x in hot + rest]
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "13")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        mended = c.mend(c.damage(frame(spark, hot + rest)))
        assert mended.where("conv_id = 50").count() > 5
        assert got(c.digests(mended)) == want(hot + rest)
        turns = c.repaired_turns(mended).where("conv_id = 50").orderBy("part", "piece", "position").collect()
        whole = "\n".join(f"{x.role}:{x.text}" for x in turns)
        assert hashlib.sha256(whole.encode()).hexdigest() == next(r for r in want(hot) if r[0] == 50)[-1]
        named = spark.createDataFrame(texts, "conv_id string, turn int, role string, text string").repartition(3)
        assert got(c.digests(c.mend(c.damage(named)))) == want(texts)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])


def test_whole_table(spark):
    rows = [(x.conv_id, x.turn, x.role, x.text) for x in table(spark, SF_DIR, "conversations").collect()]
    assert got(QUERIES["op11_conversations"](spark, SF_DIR)) == want(rows)
