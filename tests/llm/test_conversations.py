"""Conversation repair against a plain search over all edits, by both ways, and its defined cases."""

import functools
import hashlib
import itertools
import random
import re
import zlib

import duckdb
import pytest

from sheaf.llm import conversations as C

SHAPE = "conv_id long, turn long, role string, text string, rows int, segment string, Audit int"


@functools.cache
def least(symbols: tuple, state: int = 0, inserted: int = 0) -> tuple[int, str] | None:
    """The least (cost, string) by trying every edit; states are the written initials' own grammar."""
    step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    found = [(0, "")] if not symbols and state in (0, 3) else []
    ways = [("I", 2, w, symbols, inserted + 1) for w in "ua" if inserted < 4]
    if symbols:
        (initial, fault), rest = symbols[0], symbols[1:]
        ways.append(("D", 3, None, rest, 0))
        if fault not in (C.BLANK, C.DUPLICATE):
            extra = int(fault == C.TRUNCATED)
            ways += [("K", extra, initial, rest, 0), ("R", 2 + extra, "u", rest, 0), ("R", 2 + extra, "a", rest, 0)]
    for label, cost, written, rest, n in ways:
        to = state if written is None else step.get((state, written))
        if to is not None and (after := least(rest, to, n)) is not None:
            found.append((cost + after[0], label + after[1]))
    return min(found, default=None)


def plain(rows):
    """{conv_id: (gaps, blank, duplicate, truncated, illegal, cost, audit, sha256)} of damaged-to-be rows, straight from the rules."""
    out = {}
    for conv in {r[0] for r in rows}:
        own = []
        for _, turn, role, text in (r[:4] for r in rows if r[0] == conv):
            role, text = " " if role is None else role, " " if text is None else text
            how = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            text = "" if how == 1 else re.sub("[.!?]", "", text) if how == 2 else text
            own += [(turn, "user" if how == 4 else role, text)] * (0 if how == 0 else 2 if how == 3 else 1)
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2][:64], hashlib.sha256(r[2].encode()).hexdigest()))
        faults, seen = [], set()
        for _, role, text in own:
            solid = re.sub(r"[\x20\x09-\x0D]", "", text)
            faults.append(C.BLANK if not solid else C.DUPLICATE if (role, text) in seen else C.TRUNCATED if solid[-1] not in ".!?" else C.FINE)
            seen.add((role, text))
        cost, audit = least(tuple((role[:1], f) for (_, role, _), f in zip(own, faults, strict=True)))
        lines, state, left = [], "", list(own)
        for e in audit:
            if e != "I":
                _, role, text = left.pop(0)
            if e != "D":
                role = role if e == "K" else "assistant" if state == "u" else "user"
                lines.append(f"{role}:{'' if e == 'I' else text}")
                state = role[0]
        turns = [t for t, _, _ in own if t is not None]
        pairs = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, *(faults.count(k) for k in (C.BLANK, C.DUPLICATE, C.TRUNCATED)), pairs, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def some_rows():
    rng = random.Random(12)
    texts = ["Hello there.", "yes", "No! \t\n", "", None, "   \x0b", "the same old story", "Ärger?", "one\x85", "x" * 70 + ".", "x" * 70 + "?"]
    rows = []
    for conv in [*range(60), None]:
        for turn in range(rng.randrange(1, 9)):
            turn = None if rng.random() < 0.1 else turn * rng.choice([1, 1, 3])
            row = (conv, turn, rng.choice(["user", "assistant", "user", "assistant", "system", None, "", "tool", "a"]), rng.choice(texts))
            rows += [row] * rng.choice([1, 1, 1, 2])
    rows += [(1000, t, ("user", "assistant")[t % 2], f"turn {t}{'.' if t % 7 else ''}") for t in range(900)]
    rows += [(1001, None, "user", f"{'y' * 64}{t % 90}") for t in range(300)] + [(1002, 5, "system", "Same.")] * 200
    rng.shuffle(rows)
    return rows


def by_conversation(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


def test_least_path_against_all_edits():
    rng = random.Random(1)
    for n in range(7):
        for _ in range(60):
            symbols = [(rng.choice(["s", "u", "a", "t", ""]), rng.randrange(4)) for _ in range(n)]
            path = list(C.shortest_path(symbols, 0, C.AT_END, True))
            assert (sum(e.cost for e, _, _ in path), "".join(e.label for e, _, _ in path)) == least(tuple(symbols))


def test_both_ways_against_the_rules(spark):
    rows = some_rows()
    small = [r for r in rows if r[0] is None or r[0] < 1000]
    shaped = lambda rows: spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SHAPE)
    assert by_conversation(C.repaired_digests(shaped(small))) == plain(small)
    # every conversation in segments, of which long ones have several
    whole = by_conversation(C.repaired_digests(shaped(rows)))
    assert by_conversation(C.repaired_digests(shaped(rows), most_rows=0, segment=600)) == whole
    mixed = C.repair(C.damaged(shaped(rows)), most_rows=50, segment=600)
    pieces = mixed.where("conv_id = 1000").orderBy("segment").collect()
    assert len(pieces) > 3 and "".join(p.audit for p in pieces) == whole[1000][6] and sum(p.cost for p in pieces) == whole[1000][5]
    con = duckdb.connect()
    con.register("conversations", shaped(rows).toPandas().astype({"conv_id": "Int64", "turn": "Int64"}))
    assert {r[0]: r[1:] for r in con.execute(C.SQL).fetchall()} == whole


def test_sorted_ties_and_a_repaired_conversation(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "assistant", "Hello."), (1, 2, "user", "Hi."), (2, 4, "user", "One."), (2, 9, "assistant", "Two.")]
    found = {r.conv_id: r for r in C.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert found[1].audit == "KIKKI" and found[1].cost == 4 and [tuple(t) for t in found[1].repaired] == [("system", "Be kind."), ("user", ""), ("assistant", "Hello."), ("user", "Hi."), ("assistant", "")]
    assert found[2].audit == "KK" and (found[2].low, found[2].high, found[2].turns) == (4, 9, 2)


def test_empty_table_and_texts_of_any_size(spark):
    shape = "conv_id long, turn long, role string, text string"
    assert C.repaired_digests(spark.createDataFrame([], shape)).count() == 0 and C.repair(spark.createDataFrame([], shape)).count() == 0
    rows = [(3, t, ("user", "assistant")[t % 2], "w " * 1_000_000 + f"{t}.") for t in range(6)]
    df = spark.createDataFrame(rows, shape)
    assert by_conversation(C.repaired_digests(df)) == plain(rows) == by_conversation(C.repaired_digests(df, most_bytes=1 << 20, segment=1 << 20))


@pytest.mark.parametrize("turn", [2**63 - 1])
def test_turns_far_apart(spark, turn):
    rows = [(1, -turn, "user", "A."), (1, turn, "assistant", "B.")]
    found = C.digests(*C.repaired(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()
    assert found[0].gaps is None and found[0].audit == "KK"  # more gaps than a long holds
