"""Conversation repair against enumeration of all edits, and its defined cases."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest

from platewise.llm import conversations as cv
from platewise.llm import queries

WS = " \t\n\x0b\x0c\r"


def enumerated(rows, most=2):
    """The cheapest repair by trying everything: up to `most` inserts in every gap, every edit of every row."""
    gaps = [""] + ["".join(x) for k in range(1, most + 1) for x in itertools.product("ua", repeat=k)]
    best = None
    for edits in itertools.product(*[["D"] if faulty else ["K", "U", "A", "D"] for _, faulty, _ in rows]):
        kept = [(i, e) for i, e in enumerate(edits)]
        for inserts in itertools.product(gaps, repeat=len(rows) + 1):
            said, cost, letters, out = "", 0, "", []
            for i, e in kept + [(len(rows), None)]:
                said, letters, cost = said + inserts[i], letters + "I" * len(inserts[i]), cost + 2 * len(inserts[i])
                out += [(c, None) for c in inserts[i]]
                if e is None:
                    break
                role, _, late = rows[i]
                cost += {"K": 0, "U": 2, "A": 2, "D": 3}[e] + (e != "D" and late)
                letters += "R" if e in "UA" else e
                if e != "D":
                    said += role if e == "K" else e.lower()
                    out.append((said[-1], i))
            if re.fullmatch("(s?(ua)+)?", said) and (best is None or (cost, letters) < best[:2]):
                best = (cost, letters, out)
    return best


def parsed(rows):
    chart = cv.Chart()
    for r in rows:
        chart.add(*r)
    return chart.edits()


def test_chart_equals_enumeration():
    rng = random.Random(3)
    for _ in range(150):
        rows = [(rng.choice("suaat x"), rng.random() < 0.2, rng.random() < 0.3) for _ in range(rng.randint(0, 3))]
        rows = [(a, f, t and not f) for a, f, t in rows]
        cost, edits = parsed(rows)
        want = enumerated(rows)
        assert (cost, cv.audit(edits)) == want[:2], rows
        out = [(x[0][0] if x[0] in cv.ROLES.values() else x[0], x[1]) for i, e in enumerate(edits) for x in cv.lines_of(e, rows[i][0], i)]
        assert [a for a, _ in out] == [a for a, _ in want[2]] or not rows


def slow_chart(rows):
    """The same parse with whole audits as strings."""
    items = {0: (0, "")}
    for initial, faulty, late in rows:
        best = {}
        for p, (cost, said) in items.items():
            for q, more in cv.INSERTS[p]:
                moves = [(q, 3, "D")]
                if not faulty:
                    moves.append((cv.READ[q, cv.WANTS[q]], 2 + late, "R"))
                    if (q, initial) in cv.READ:
                        moves.append((cv.READ[q, initial], late, "K"))
                for to, price, letter in moves:
                    x = (cost + 2 * len(more) + price, said + "I" * len(more) + letter)
                    best[to] = min(best.get(to, x), x)
        items = best
    return min((c + 2 * len(m), s + "I" * len(m)) for p, (c, s) in items.items() for q, m in cv.INSERTS[p] if q in (0, 3))


def test_ranks_order_long_audits():
    rng = random.Random(4)
    for n in (5, 20, 200):
        for _ in range(60):
            rows = [(rng.choice("suaxa"), False, rng.random() < 0.3) if rng.random() < 0.8 else ("u", True, False) for _ in range(n)]
            cost, edits = parsed(rows)
            assert (cost, cv.audit(edits)) == slow_chart(rows)


def expected(table):
    """The contract, in plain Python."""
    out, convs = {}, defaultdict(list)
    for conv, turn, role, text in table:
        convs[conv]
        role, text = " " if role is None else role, " " if text is None else text
        hit = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if hit:
            text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
            convs[conv] += [(turn, "user" if hit == 4 else role, text)] * (2 if hit == 3 else 1)
    for conv, rows in convs.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
        flags, counts, seen = [], [0, 0, 0], set()
        for turn, role, text in rows:
            solid = text.rstrip(WS)
            fault = 0 if not solid else 1 if (role, text) in seen else 2 if solid[-1] not in ".!?" else 3
            seen.add((role, text))
            if fault < 3:
                counts[fault] += 1
            flags.append((role[:1], fault < 2, fault == 2))
        turns = [t for t, _, _ in rows if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(flags, flags[1:]))
        cost, edits = parsed(flags)
        assert (cost, cv.audit(edits)) == slow_chart(flags)
        said = [f"{r}:{t}" for e, row in zip(edits, rows) for r, t in cv.lines_of(e, *row[1:])]
        out[conv] = (gaps, *counts, illegal, cost, cv.audit(edits), hashlib.sha256("\n".join(said).encode()).hexdigest())
    return out


@pytest.fixture(scope="module")
def table():
    rng = random.Random(9)
    texts = ["Yes.", "No", "Well?\n", "", " \t", "ok", "Yes.", None, "Long words. " * 9000, "(a) ", "naïve …"]
    roles = ["user", "assistant", "system", "tool", None, "", "user", "assistant"]
    rows = []
    for conv in [*range(60), None]:
        for turn in range(rng.randint(1, 9)):
            turn = rng.choice([turn, turn, turn, turn + 3, None, 0])
            rows += [(conv, turn, rng.choice(roles), rng.choice(texts))] * rng.choice([1, 1, 1, 2])
    rows += [(777, t, "user" if t % 2 else "assistant", rng.choice(texts)) for t in range(900)]  # a busy conversation
    gone = [(800 + k, t, "user", "Lost.") for k in range(4000) for t in [0] if zlib.crc32(f"{800 + k}:0".encode()) % 20 == 0][:2]
    return rows + gone


def test_query_equals_contract(spark, tmp_path, table):
    df = spark.createDataFrame(table, "conv_id long, turn long, role string, text string").selectExpr("*", "'x' as kind", "1 as seq").repartition(5)
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    got = queries.op11_conversation_repair(spark, str(tmp_path))
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert {r[0]: tuple(r)[1:] for r in got.collect()} == expected(table)


def test_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert cv.repair_report(cv.damage(df), df).count() == 0 and cv.repaired_turns(df).count() == 0


def test_repaired_turns(spark):
    rows = [(1, 0, "assistant", "Hi."), (1, 1, "user", "Go."), (1, 2, "user", "Now."), (2, 0, "user", " ")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = sorted(map(tuple, cv.repaired_turns(df).collect()))
    assert got == [(1, 0, "user", ""), (1, 1, "assistant", "Hi."), (1, 2, "user", "Go."), (1, 3, "assistant", "Now.")]
