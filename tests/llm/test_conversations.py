import hashlib
import heapq
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from heronry.llm import conversations as cv

GRAMMAR = re.compile(r"(s?(ua)+)?")


def hurt(rows):
    out = {}
    for conv, turn, role, text in rows:
        mine = out.setdefault(conv, [])
        lot = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if lot:
            row = (turn, "user" if lot == 4 else role, "" if lot == 1 else re.sub("[.!?]", "", text) if lot == 2 else text)
            mine += [row] * (2 if lot == 3 else 1)
    return {c: sorted(m, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])) for c, m in out.items()}


def cheapest(rows):
    """Cost, audit and lines by a search over edit sequences in order of (cost, audit); it knows no states."""
    live = lambda s: any(GRAMMAR.fullmatch(s + t) for t in ("", "a", "ua"))
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, initials, lines = heapq.heappop(heap)
        if i == len(rows) and GRAMMAR.fullmatch(initials):
            return cost, audit, "\n".join(lines)
        key = (i, initials[-2:] if len(initials) > 2 else initials)
        if key in done:
            continue
        done.add(key)
        steps = [(2, "I", 0, r, "") for r in ("user", "assistant")]
        if i < len(rows):
            role, text, fault = rows[i]
            steps.append((3, "D", 1, None, ""))
            if fault in ("", "truncated"):
                more = fault == "truncated"
                steps += [(more, "K", 1, role, text), *((2 + more, "R", 1, r, text) for r in ("user", "assistant"))]
        for c, e, n, role, text in steps:
            said = initials if role is None else initials + (role[:1] or "-")
            if live(said):
                heapq.heappush(heap, (cost + c, audit + e, i + n, said, lines if role is None else (*lines, f"{role}:{text}")))


def plain(rows):
    out = []
    for conv, mine in hurt(rows).items():
        seen, judged = set(), []
        for _, role, text in mine:
            ends = re.findall(r"[^\x20\x09-\x0D]", text)
            judged.append((role, text, "blank" if not ends else "duplicate" if (role, text) in seen else "truncated" if ends[-1] not in ".!?" else ""))
            seen.add((role, text))
        turns = [t for t, _, _ in mine if t is not None]
        cost, audit, text = cheapest(judged)
        faults = [f for _, _, f in judged]
        bad = sum(a[:1] + b[:1] not in ("su", "ua", "au") for (_, a, _), (_, b, _) in zip(mine, mine[1:]))
        out.append((conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), bad, cost, audit, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


def table(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("n", F.lit("x")).withColumn("audit", F.lit("y"))


def got(df):
    return sorted((tuple(r) for r in cv.report(df).collect()), key=repr)


def test_equal_to_a_search(spark):
    rng = random.Random(3)
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "unknown"]
    texts = ["Yes.", "No!", "cut off", "", " \n\t", None, "é?  ", "\x1c", "a\x0b.", "ends. not"]
    text = lambda: rng.choice(texts) if rng.random() < 0.7 else f"text {rng.randrange(9)}."
    rows = [(c, t if rng.random() < 0.95 else None, rng.choice(roles), text()) for c in range(250) for t in range(rng.randrange(1, 9)) for _ in range(1 + (rng.random() < 0.1))]
    rows += [(None, 1, "user", "Null."), (None, None, None, None), (300, 5, "user", "A."), (300, 5, "user", "B."), (300, 5, "user", "A."), (300, -4, "assistant", "C")]
    assert got(table(spark, rows)) == plain(rows)


def test_long_conversations_and_texts(spark):
    rows = [(1, t, ("user", "assistant")[t % 2], f"{'word ' * (40_000 if t == 7 else 1)}{t}.") for t in range(300)] + [(2, 1, "assistant", "x " * 500_000)]
    assert got(table(spark, rows)) == plain(rows)


def test_a_row_repeated_and_a_conversation_of_many_turns(spark):
    """Copies of a row are letters; 20,000 turns of one conversation are dealt to several ranges."""
    rows = spark.range(20_000).selectExpr("5L AS conv_id", "id AS turn", "if(id % 2 = 0, 'user', 'assistant') AS role", "concat('t', id % 7000, '.') AS text")
    copies = spark.range(30_000).selectExpr("6L AS conv_id", "1L AS turn", "'user' AS role", "'same.' AS text")
    out = {r.conv_id: r for r in cv.report(rows.union(copies)).collect()}
    lot = zlib.crc32(b"6:1") % 20
    assert lot not in (0, 1, 2)
    n = 30_000 * (2 if lot == 3 else 1)
    assert (out[6].duplicate, out[6].cost, out[6].audit) == (n - 1, 3 * (n - 1) + 2, "K" + "D" * (n - 1) + "I")
    assert len(out[5].audit.replace("I", "")) > 18_000 and out[5].duplicate > 10_000


def test_nothing_left_and_empty(spark):
    dropped = next(i for i in range(1000) if zlib.crc32(f"{i}:1".encode()) % 20 == 0)
    assert got(table(spark, [(dropped, 1, "user", "x")])) == [(dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert got(table(spark, []).limit(0)) == []


def test_repaired_rows(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "user", "Hi."), (1, 2, "user", "Hi."), (1, 4, "assistant", "Bye.")]
    clean = table(spark, rows).select("conv_id", "turn", "role", "text", F.lit(1).cast("long").alias("n"))
    want = [(1, 0, "system", "Be kind."), (1, 1, "user", "Hi."), (1, 2, "assistant", "Bye.")]
    assert [tuple(r) for r in cv.repaired(clean).orderBy("place").collect()] == want


@pytest.mark.parametrize("seed", range(3))
def test_endings_are_worked_out_once(seed):
    rng = random.Random(seed)
    signatures = sorted({"".join(rng.choice("uaUA1") for _ in range(rng.randrange(12))) for _ in range(500)}, key=lambda s: s[::-1])
    automaton = cv.Automaton()
    solved = list(automaton.repairs(iter(signatures)))
    assert [s for s, _, _ in solved] == signatures and len(automaton.costs) < 60
    for s, cost, audit in solved[::25]:
        rows = [({"s": "system", "u": "user", "a": "assistant"}[c.lower()] if c.isalpha() else "user", "x", "blank" if c.isdigit() else "truncated" if c.isupper() else "") for c in s]
        assert cheapest(rows)[:2] == (cost, audit)
