import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabularium.llm import queries, turns
from tabularium.session import table

SOLID = re.compile(r"[^\x20\x09-\x0D]")


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        show = lambda v: " " if v is None else str(v)
        fault = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        role, text = show(role), show(text)
        if fault == 0:
            continue
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        role = "user" if fault == 4 else role
        out += [(conv, turn, role, text)] * (2 if fault == 3 else 1)
    return out


def in_order(rows):
    return sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, hashlib.sha256(f"{len(r[2])}:{r[2]}:{r[3]}".encode()).hexdigest()))


def brute(rows):
    """One conversation's rows after damage: all results, by keeping the least (cost, audit, repaired) of every state."""
    rows = in_order(rows)
    times = [r[1] for r in rows if r[1] is not None]
    gaps = max(times) - min(times) + 1 - len(set(times)) if times else 0
    seen, faults = set(), {"blank": 0, "duplicate": 0, "truncated": 0}
    follow = {"": "u", "s": "u", "u": "a", "a": "u"}
    full = {"u": "user", "a": "assistant"}

    def put(best, state, value):
        if state not in best or value < best[state]:
            best[state] = value

    def inserted(best):
        for _ in range(3):
            for state, (cost, audit, done) in list(best.items()):
                put(best, follow[state], (cost + 3, audit + "I", (*done, full[follow[state]] + ":")))
        return best

    best = inserted({"": (0, "", ())})
    for _, _, role, text in rows:
        solid = SOLID.findall(text)
        fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else None
        seen.add((role, text))
        if fault:
            faults[fault] += 1
        new = {}
        for state, (cost, audit, done) in best.items():
            put(new, state, (cost + 4, audit + "D", done))
            if fault in ("blank", "duplicate"):
                continue
            more = 3 if fault else 0
            start = role[:1]
            if (start == "s" and state == "") or (start in ("u", "a") and follow[state] == start):
                put(new, start, (cost + more, audit + "K", (*done, f"{role}:{text}")))
            put(new, follow[state], (cost + more + 3, audit + "R", (*done, f"{full[follow[state]]}:{text}")))
        best = inserted(new)
    cost, audit, done = min(v for k, v in best.items() if k in ("", "a"))
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(done).encode()).hexdigest()


def expected(rows):
    groups = {r[0]: [] for r in rows}
    for r in damaged(rows):
        groups[r[0]].append(r)
    empty = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    return {k: brute(v) if v else empty for k, v in groups.items()}


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def result(df):
    rows = df.collect()
    assert len({r.conv_id for r in rows}) == len(rows)
    return {r.conv_id: tuple(r[c] for c in COLUMNS) for r in rows}


def made(rng, convs, longest):
    rows = []
    for c in range(convs):
        n = rng.randrange(1, longest)
        for t in range(n):
            turn = rng.choice([t, t, t, t + 1, None, 2 * t])
            role = rng.choice(["user", "assistant", "system", "tool", "u", None]) if rng.random() < 0.4 else ("user", "assistant")[t % 2]
            text = rng.choice([f"Said {rng.random()}.", "Same.", "cut", " \t\n", "", None, "Why?\x0b ", "é!", f"{rng.random()} open"])
            rows.append((c if c else None, turn, role, text))
    return rows


@pytest.mark.parametrize(("block_bits", "fan_bits"), [(12, 10), (3, 10), (2, 1)])
def test_against_brute_force(spark, block_bits, fan_bits):
    rng = random.Random(block_bits)
    rows = made(rng, 60, 14) + [("500" and 500, t % 90, ("user", "assistant", "user")[t % 3], f"row {t % 70}.") for t in range(160)]
    rows += [(600, 1, "user", "Hi.")] * 40 + [(700, -(1 << 62), "user", "a."), (700, 1 << 62, "user", "b.")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "conv_id long, turn long, role string, text string, key int, at int")
    got = result(turns.trial(df, block_bits=block_bits, fan_bits=fan_bits))
    want = expected(rows)
    assert want[700][0] == (1 << 63) - 1 and got[700][0] == want[700][0]
    assert got == want


def test_empty_table_and_dropped_conversations(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert turns.trial(df).collect() == []
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(gone, 0, "user", "Hi.")], df.schema)
    assert result(turns.trial(df)) == expected([(gone, 0, "user", "Hi.")])


def test_long_conversation_over_blocks(spark):
    """A third of the rows under one id, over many partitions."""
    df = spark.range(9000).selectExpr("CASE WHEN id % 3 = 0 THEN -1 ELSE id div 7 END AS conv_id", "id AS turn", "CASE WHEN hash(id) % 5 = 0 THEN 'user' ELSE 'assistant' END AS role",
                                      "concat('t', hash(id) % 900, CASE WHEN hash(id) % 11 = 0 THEN '' ELSE '.' END) AS text")
    rows = [tuple(r) for r in df.collect()]
    assert result(turns.trial(df, block_bits=6, fan_bits=2)) == expected(rows)


def test_very_long_text(spark):
    rows = [(1, 0, "user", "word " * 600_000), (1, 1, "assistant", "end." + " " * 300_000), (1, 2, "user", "?"), (1, 3, "user", "." * 100_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert result(turns.trial(df)) == expected(rows)


def test_tables_compose():
    """Cost and order of audits through composed tables, against the table of the whole stretch."""
    rng = np.random.default_rng(5)
    for _ in range(20):
        code = rng.integers(0, 4, 30) + np.where(rng.random(30) < 0.2, turns.BLANK, 0) + np.where(rng.random(30) < 0.2, turns.CUT, 0)
        cuts = np.sort(rng.choice(np.arange(1, 30), 4, replace=False))
        start = np.append(0, cuts)
        size = np.diff(np.append(start, 30))
        cost, rank = turns.composed(*turns.tables(code, start, size))
        whole_cost, whole_rank = (x[0] for x in turns.tables(code, np.array([0]), np.array([30])))
        assert (cost == whole_cost).all()
        for q in range(4):
            ok = whole_cost[q] < turns.FAR
            assert (np.argsort(rank[q][ok]) == np.argsort(whole_rank[q][ok])).all()


def test_repaired_rows_read_well(spark):
    reports, repaired = turns.repair(table(spark, "/root/testdata/sf0.001", "conversations").filter("turn <> 1"))
    roles = repaired.groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "step", "role"))), lambda x: F.substring(x["role"], 1, 1)), "").alias("r"))
    assert roles.filter("NOT r RLIKE '^(s?(ua)+)?$'").count() == 0 and reports.count() > 10


def test_query_against_brute_force(spark):
    folder = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert result(queries.op11_turns(spark, folder)) == expected(rows)
