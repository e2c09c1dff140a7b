"""Conversation repair against an enumeration of all edits, and chunks against whole conversations."""

import hashlib
import itertools
import random
import re

import pytest

from colloquy.llm import conversation_repair as cr

GRAMMAR = re.compile("(s?(ua)+)?")


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        words = re.sub("[\x20\x09-\x0D]", "", text)
        out.append("blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def brute(rows):
    """(cost, audit, repaired lines) by trying every edit of every row and up to two insertions at every place."""
    inserts = [p for k in range(3) for p in itertools.product("ua", repeat=k)]
    names = {"u": "user", "a": "assistant"}
    best = None
    kinds = faults(rows)
    for fates in itertools.product("DKua", repeat=len(rows)):
        if any(f != "D" and k in ("blank", "duplicate") for f, k in zip(fates, kinds, strict=True)):
            continue
        price = sum({"D": 4, "K": 0, "u": 3, "a": 3}[f] + 3 * (f != "D" and k == "truncated") for f, k in zip(fates, kinds, strict=True))
        if best and price > best[0]:
            continue
        for added in itertools.product(inserts, repeat=len(rows) + 1):
            cost = price + 3 * sum(map(len, added))
            if best and cost > best[0]:
                continue
            initials, audit, lines = "", "", []
            for i, extra in enumerate(added):
                initials, audit = initials + "".join(extra), audit + "I" * len(extra)
                lines += [f"{names[x]}:" for x in extra]
                if i < len(rows):
                    (role, text), fate = rows[i], fates[i]
                    audit += fate if fate in "DK" else "R"
                    if fate != "D":
                        initials += role[:1] if fate == "K" else fate
                        lines.append(f"{role if fate == 'K' else names[fate]}:{text}")
            if GRAMMAR.fullmatch(initials) and (best is None or (cost, audit) < best[:2]):
                best = cost, audit, lines
    return best


def expected(conv, rows):
    """rows: (turn, role, text) in order."""
    said = [(r, t) for _, r, t in rows]
    kinds, (cost, audit, lines) = faults(said), brute(said)
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(said))
    digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
    return (conv, gaps, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest)


TEXTS = ["a.", "b!", "cut", "", " \n", "c?", "a. ", "é"]


def conversations(seed, n, longest):
    draw = random.Random(seed)
    out = {}
    for conv in range(n):
        turns = sorted(draw.sample(range(12), draw.randrange(longest + 1)))
        out[conv] = [(t, draw.choice(["system", "user", "assistant", "tool", "assistant", "user"]), draw.choice(TEXTS)) for t in turns]
    return out


def frame(spark, convs):
    rows = [(c, t, r, x) for c, said in convs.items() for t, r, x in said]
    random.Random(0).shuffle(rows)
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)


@pytest.mark.parametrize("chunk_rows", [2, 100])
def test_equals_all_edits(spark, chunk_rows):
    convs = conversations(4, 120, 4)
    asked = spark.createDataFrame([(c,) for c in convs], "conv_id long")
    found = {r["conv_id"]: tuple(r) for r in cr.repair_conversations(frame(spark, convs), asked, chunk_rows=chunk_rows).collect()}
    for conv, rows in convs.items():
        assert found[conv] == expected(conv, rows)


def test_chunks_equal_the_whole(spark):
    """One conversation holds most rows; fix-up passes make chunks of any length agree."""
    draw = random.Random(5)
    convs = {1: [(i, draw.choice(["user", "assistant", "system"]), draw.choice(["x.", "cut", "", f"{i}.", f"{i}?"])) for i in range(900)],
             2: [(i, "user" if i % 2 == 0 else "assistant", f"{i}.") for i in range(301)], 3: [(0, "user", "a.")]}
    rows = frame(spark, convs)
    whole = sorted(map(tuple, cr.repair_conversations(rows).collect()))
    assert whole == sorted(map(tuple, cr.repair_conversations(rows, chunk_rows=40).collect()))
    price = {"D": 4, "K": 0, "R": 3, "I": 3}
    for conv, *_, cost, audit, _ in whole:
        kinds = faults([(r, t) for _, r, t in convs[conv]])
        fates = [a for a in audit if a != "I"]
        assert cost == sum(price[a] for a in audit) + 3 * sum(k == "truncated" and a != "D" for k, a in zip(kinds, fates, strict=True))


def test_fix_up_stops_where_vectors_are_parallel():
    draw = random.Random(6)
    codes = bytes(draw.choice([0, 1, 2, 3, 5, 9, 10]) for _ in range(5000))
    for _ in range(20):
        before, now = (tuple(draw.randrange(8) for _ in range(4)) for _ in range(2))
        before, now = (tuple(x - min(v) for x in v) for v in (before, now))
        front, total = cr.solve(codes, before)
        again, constant, rerun = cr.fix_up(codes, before, now, front, total)
        assert (again, constant) == cr.solve(codes, now) and rerun < 200


def test_odd_rows(spark):
    rows = [(None, 1, "user", "a."), (None, None, None, None), (1, None, "user", "a."), (1, None, "user", "a."), (1, 3, "assistant", "b."),
            (2, 5, "", "a."), (3, 1, "user", "long " * 50_000 + "end.")]
    turns = spark.createDataFrame([(*r, 0, 0) for r in rows], "conv_id long, turn long, role string, text string, k int, run int")
    asked = spark.createDataFrame([(None,), (1,), (2,), (3,), (9,)], "conv_id long")
    found = {r["conv_id"]: tuple(r) for r in cr.repair_conversations(turns, asked).collect()}
    nothing = hashlib.sha256(b"").hexdigest()
    assert found[9] == (9, 0, 0, 0, 0, 0, 0, "", nothing)
    assert found[None][1:8] == (0, 1, 0, 0, 1, 7, "DKI")  # a role of one space, then one empty answer
    assert found[1][1:8] == (0, 0, 1, 0, 1, 4, "KDK")
    assert found[2][1:8] == (0, 0, 0, 0, 0, 4, "D") and found[2][8] == nothing
    assert found[3][6:8] == (3, "KI")
    assert cr.repair_conversations(turns.where("false")).collect() == []
