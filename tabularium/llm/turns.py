"""Operator 11, conversation structure repair: cheapest edits by dynamic programming, ties by prefix-doubling ranks of audits.

A repaired conversation reads ``(s?(ua)+)?`` in role initials. A node is a row boundary and the last role written; its arcs are
the edits (Delete, Insert, Keep, Rerole), told apart by their initials. Costs to the end make some arcs optimal. Nodes are then ranked by the
first letter of their least audit, by 2, 4, 8 ... letters (a pair of ranks makes the next rank), while pointers along that audit
double with them. Initials out of one node differ, so the first rank settles its arc; later ranks compare whole audits.

A conversation may hold any share of the rows, so rows are sorted by range and cut into blocks of bounded size wherever they fall. Inside
a block, conversations that lie wholly in it are settled. Of one that reaches its border only a 4 x 4 table goes on, cost and rank of the
least audit from each state to each other. Tables compose, costs by sum and minimum, ranks by pairs; where a conversation has
very many, blocks of tables are composed first. The chosen states then settle each block. Rows that repeat are found by an aggregate.

Null roles and texts count as one space. Rows are taken by turn, nulls first, and rows of one turn by the SHA-256 of length of role,
role and text; equal rows are exchangeable. Null conversation ids are one conversation. An empty role cannot be kept. Other columns
are not read. Empty tables give no rows. ``digest`` reads a conversation in order, since its hash is a chain, but holds one batch of it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from tabularium.llm.common import staged

# Costs, letters in ASCII order, legal pairs and what follows each state. States: nothing yet, system, user, assistant.
DELETE, INSERT, REROLE, CUT_SHORT = 4, 3, 3, 3
LETTERS = np.frombuffer(b"\0DIKR", np.uint8)
NEXT = np.array([2, 2, 3, 2])
KEPT = np.array([[1, 2, 4, 4], [4, 2, 4, 4], [4, 4, 3, 4], [4, 2, 4, 4]])  # state after keeping s, u, a, other; 4: impossible
TAIL_COST = np.array([0, 6, 3, 0])
TAIL = ("", "ua", "a", "")
LEGAL = np.zeros((4, 4), bool)
LEGAL[[0, 1, 2], [1, 2, 1]] = True

BLOCK_BITS, FAN_BITS = 12, 10  # rows of a block, tables that are composed at once
FAR = 1 << 40
BLANK, CUT, AGAIN = 4, 8, 16  # flags beside the role's code
WHITE = " \t\n\x0b\x0c\r"


def least_audits(code: np.ndarray, start: np.ndarray, size: np.ndarray, end_cost: np.ndarray):
    """Nodes of many stretches of rows, each with its costs behind the last row: cost, letter, rank, audit length, pointers by powers of
    two, and the first node of each stretch. Node ``base + 4 * i + state`` stands before row i."""
    base = np.append(0, np.cumsum(4 * (size + 1)))
    cost = np.full(int(base[-1]), FAR)
    cost[(base[1:] - 4)[:, None] + np.arange(4)] = end_cost
    only_delete, worse = (code & (BLANK | AGAIN)) > 0, np.where(code & CUT, CUT_SHORT, 0)
    kept_to = KEPT[:, code & 3].T  # row, state

    order = np.argsort(-size, kind="stable")
    active = len(order)
    for back in range(1, int(size.max(initial=0)) + 1):
        while active and size[order[active - 1]] < back:
            active -= 1
        of = order[:active]
        row = start[of] + size[of] - back
        here = base[of + 1] - 4 * (back + 1)
        after = np.full((active, 5), FAR)
        after[:, :4] = cost[(here + 4)[:, None] + np.arange(4)]
        keep = np.take_along_axis(after, kept_to[row], 1)
        best = np.minimum(keep, after[:, NEXT] + REROLE) + worse[row][:, None]
        best[only_delete[row]] = FAR
        best = np.minimum(best, after[:, :4] + DELETE)
        user, assistant = best[:, 2].copy(), best[:, 3].copy()
        best[:, 2] = np.minimum(user, assistant + INSERT)
        best[:, 3] = np.minimum(assistant, user + INSERT)
        best[:, :2] = np.minimum(best[:, :2], best[:, 2:3] + INSERT)
        cost[here[:, None] + np.arange(4)] = best
    cost = np.minimum(cost, FAR)

    stretch = np.repeat(np.arange(len(size)), 4 * (size + 1))
    place = np.arange(len(cost)) - base[stretch]
    layer, state = place // 4, place % 4
    inner = np.flatnonzero((layer < size[stretch]) & (cost < FAR))
    row, q, mine, level = start[stretch[inner]] + layer[inner], state[inner], cost[inner], inner - state[inner]
    padded = np.append(cost, np.full(5, FAR))
    free = ~only_delete[row]
    kept = kept_to[row, q]
    targets = [
        (inner + 4, DELETE, True), (level + NEXT[q], INSERT, True), (level + 4 + np.minimum(kept, 3), worse[row], free & (kept < 4)),
        (level + 4 + NEXT[q], worse[row] + REROLE, free),
    ]
    letter, pointer = np.zeros(len(cost), np.int64), np.arange(len(cost))
    for k in (4, 3, 2, 1):  # the least initial last
        to, price, allowed = targets[k - 1]
        optimal = (padded[to] + price == mine) & allowed
        letter[inner[optimal]], pointer[inner[optimal]] = k, to[optimal]

    rank, length, pointers = letter.copy(), (letter > 0).astype(np.int64), [pointer]
    while True:
        pair = rank * (int(rank.max(initial=0)) + 1) + rank[pointer]
        _, rank = np.unique(pair, return_inverse=True)
        length = length + length[pointer]
        pointer = pointer[pointer]
        if (pointer == pointers[-1]).all():
            return cost, letter, rank, length, pointers, base[:-1]
        pointers.append(pointer)


def walked(code, start, size, end_cost, entry):
    """Along the least audit of each stretch from its entry state: cost, audit, exit state and the steps of each row.

    A step is a character: u, a (inserted role), K, D, or U, A (role given to the row)."""
    cost, letter, _, length, pointers, base = least_audits(code, start, size, end_cost)
    first = base + entry
    seen = first
    for pointer in reversed(pointers):
        seen = np.unique(np.append(seen, pointer[seen]))
    stretch = np.searchsorted(base, seen, side="right") - 1
    exits = np.zeros(len(size), np.int64)
    last = letter[seen] == 0
    exits[stretch[last]] = (seen[last] - base[stretch[last]]) % 4
    seen, stretch = seen[~last], stretch[~last]
    order = np.lexsort((-length[seen], stretch))
    seen, stretch = seen[order], stretch[order]
    layer, state, kind = (seen - base[stretch]) // 4, (seen - base[stretch]) % 4, letter[seen]
    gives_user = NEXT[state] == 2
    step = np.choose(kind - 1, [ord("D"), np.where(gives_user, ord("u"), ord("a")), ord("K"), np.where(gives_user, ord("U"), ord("A"))]).astype(np.uint8)
    rows = np.append(0, np.cumsum(size))
    edges = np.append(0, np.cumsum(np.bincount(rows[stretch] + layer, minlength=int(rows[-1]))))
    text, all_steps = LETTERS[kind].tobytes().decode(), step.tobytes().decode()
    cuts = np.append(0, np.cumsum(np.bincount(stretch, minlength=len(size))))
    audits = [text[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return cost[first], audits, exits, [all_steps[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]


def tables(code, start, size) -> tuple[np.ndarray, np.ndarray]:
    """Cost and rank of the least audit from each state to each other, for each stretch: arrays (stretch, from, to)."""
    n = len(size)
    end = np.full((n, 4, 4), FAR)
    end[:, range(4), range(4)] = 0
    cost, _, rank, _, _, base = least_audits(code, np.repeat(start, 4), np.repeat(size, 4), end.reshape(4 * n, 4))
    at = base.reshape(n, 1, 4) + np.arange(4)[None, :, None]
    return cost[at], rank[at]


def chained(cost: np.ndarray, rank: np.ndarray, entry: int, end_cost: np.ndarray) -> tuple[int, list[tuple[int, int]]]:
    """The least way through tables in a row: its cost, and entry and exit state of each."""
    togo = [end_cost]
    for c in cost[::-1]:
        togo.append(np.minimum((c + togo[-1]).min(axis=1), FAR))
    states, q = [], entry
    for c, r, rest in zip(cost, rank, togo[-2::-1], strict=True):
        total = c[q] + rest
        to = min(range(4), key=lambda k: (total[k], r[q][k]))
        states.append((q, to))
        q = to
    return int(togo[-1][entry]), states


def composed(cost: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One table for tables in a row; ranks by pairs."""
    c, r = cost[0], rank[0]
    for c2, r2 in zip(cost[1:], rank[1:], strict=True):
        new, pairs = np.full((4, 4), FAR), {}
        for q in range(4):
            for to in range(4):
                via = min(range(4), key=lambda k: (c[q][k] + c2[k][to], r[q][k]))
                new[q][to] = min(FAR, c[q][via] + c2[via][to])
                pairs[q, to] = (int(r[q][via]), int(r2[via][to]))
        ranks = {p: i for i, p in enumerate(sorted(set(pairs.values())))}
        c, r = new, np.array([[ranks[pairs[q, to]] for to in range(4)] for q in range(4)])
    return c, r


def arranged(df: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """Rows with a number ``at`` that ascends through the conversations, staged: key, at, mark, role, text."""
    role_, text_ = (F.coalesce(F.col(c), F.lit(" ")) for c in (role, text))
    rows = df.select(key_of(conv), F.col(turn).alias("turn"), role_.alias("role"), text_.alias("text"), F.monotonically_increasing_id().alias("tie"))
    rows = rows.withColumn("mark", F.unhex(F.sha2(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", F.lit(":"), "text"), 256)))
    by = [F.col("key"), F.col("turn").asc_nulls_first(), F.col("mark"), F.col("tie")]  # the last splits even equal rows
    rows = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    return staged(rows.select("key", F.monotonically_increasing_id().alias("at"), "mark", "role", "text"))


def key_of(conv: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(conv).cast("string")), F.lit("")).alias("key")


SEGMENT = "audit string, cost long, blank long, duplicate long, truncated long, illegal long, first int, last int, costs array<long>, ranks array<long>"
PLANNED = f"key string, block long, at long, code int, steps string, {SEGMENT}"
STATES = "key string, b long, entry int, out int, joint long"
_PLANNED = pa.schema([
    ("key", pa.string()), ("block", pa.int64()), ("at", pa.int64()), ("code", pa.int32()), ("steps", pa.string()), ("audit", pa.string()),
    *[(c, pa.int64()) for c in ("cost", "blank", "duplicate", "truncated", "illegal")], ("first", pa.int32()), ("last", pa.int32()),
    ("costs", pa.list_(pa.int64())), ("ranks", pa.list_(pa.int64())),
])
_STATES = pa.schema([("key", pa.string()), ("b", pa.int64()), ("entry", pa.int32()), ("out", pa.int32()), ("joint", pa.int64())])


def plan_block(rows: pa.Table, firsts: pa.Table) -> pa.Table:
    """Settle the conversations inside a block; those at its borders get their tables."""
    if not rows.num_rows:
        return _PLANNED.empty_table()
    rows = rows.sort_by("at").combine_chunks()
    at, code = rows.column("at").to_numpy(), rows.column("code").to_numpy().astype(np.int64)
    code = np.where(np.isin(at, firsts.column("at").to_numpy()), code, code | AGAIN)
    name = rows.column("key").combine_chunks().dictionary_encode().indices.to_numpy()
    start = np.append(0, np.flatnonzero(np.diff(name)) + 1)
    size = np.diff(np.append(start, len(at)))
    border = np.zeros(len(size), bool)
    border[[0, -1]] = True
    inside, edge, last = np.flatnonzero(~border), np.flatnonzero(border), start + size - 1

    blank, again, cut = (code & BLANK) > 0, (code & AGAIN) > 0, (code & CUT) > 0
    wrong = np.append(False, ~LEGAL[code[:-1] & 3, code[1:] & 3])
    wrong[start] = False
    faults = [np.add.reduceat(x.astype(np.int64), start) for x in (blank, again & ~blank, cut & ~again & ~blank, wrong)]

    steps, ends = np.full(len(at), None, object), {c: np.full(len(at), None, object) for c in ("audit", "cost", "costs", "ranks")}
    if len(inside):
        price, audits, exits, made = walked(code, start[inside], size[inside], np.tile(TAIL_COST, (len(inside), 1)), 0)
        steps[np.repeat(~border, size)] = made
        tails = [TAIL[q] for q in exits]
        steps[last[inside]] += np.array(tails, object)
        ends["audit"][last[inside]] = [a + "I" * len(t) for a, t in zip(audits, tails, strict=True)]
        ends["cost"][last[inside]] = price
    costs, ranks = tables(code, start[edge], size[edge])
    for i, s in enumerate(edge):
        ends["costs"][last[s]], ends["ranks"][last[s]] = costs[i].ravel().tolist(), ranks[i].ravel().tolist()

    def at_ends(values):
        out = np.full(len(at), None, object)
        out[last] = values
        return out.tolist()

    columns = [rows.column("key"), rows.column("block"), rows.column("at"), code, steps.tolist(), ends["audit"].tolist(), ends["cost"].tolist(),
               *map(at_ends, faults), at_ends(code[start] & 3), at_ends(code[last] & 3), ends["costs"].tolist(), ends["ranks"].tolist()]
    return pa.Table.from_arrays([c if isinstance(c, pa.ChunkedArray) else pa.array(c, f.type) for c, f in zip(columns, _PLANNED, strict=True)], schema=_PLANNED)


def _tables_of(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.array(table.column(c).to_pylist(), np.int64).reshape(-1, 4, 4) for c in ("costs", "ranks"))


def _joints(table: pa.Table) -> list[int]:
    first, last = table.column("first").to_pylist(), table.column("last").to_pylist()
    return [0] + [int(not LEGAL[a, b]) for a, b in zip(last[:-1], first[1:], strict=True)]


def choose_all(parts: pa.Table) -> pa.Table:
    """Entry and exit states of the parts of a whole conversation."""
    return _chosen(parts, 0, TAIL_COST)


def choose_between(parts: pa.Table, chosen: pa.Table) -> pa.Table:
    """Entry and exit states of neighbouring parts, between the states chosen for all of them."""
    return _chosen(parts, chosen.column("entry")[0].as_py(), np.where(np.arange(4) == chosen.column("out")[0].as_py(), 0, FAR))


def _chosen(parts: pa.Table, entry: int, end: np.ndarray) -> pa.Table:
    parts = parts.sort_by("b")
    _, states = chained(*_tables_of(parts), entry, end)
    return pa.Table.from_arrays([parts.column("key"), parts.column("b"), pa.array([s[0] for s in states], pa.int32()), pa.array([s[1] for s in states], pa.int32()),
                                 pa.array(_joints(parts), pa.int64())], schema=_STATES)


def merge(parts: pa.Table) -> pa.Table:
    parts = parts.sort_by("b")
    cost, rank = composed(*_tables_of(parts))
    return pa.table({
        "key": parts.column("key")[:1], "b": parts.column("up")[:1], "first": parts.column("first")[:1], "last": parts.column("last")[-1:],
        "costs": pa.array([cost.ravel().tolist()], pa.list_(pa.int64())), "ranks": pa.array([rank.ravel().tolist()], pa.list_(pa.int64())),
    })


def settle(parts: DataFrame, fan_bits: int) -> DataFrame:
    """States of all parts (key, b, first, last, costs, ranks), and how many illegal pairs their borders add."""
    levels, joints = [parts], []
    most = lambda df: df.groupBy("key").count().agg(F.max("count")).first()[0] or 0
    while most(levels[-1]) > 1 << fan_bits:
        above = levels[-1].withColumn("up", F.shiftright("b", fan_bits)).groupBy("key", "up").applyInArrow(merge, "key string, b long, first int, last int, costs array<long>, ranks array<long>")
        levels.append(staged(above))
    chosen = levels[-1].groupBy("key").applyInArrow(choose_all, STATES)
    for below in reversed(levels[:-1]):
        chosen = staged(chosen)
        joints.append(chosen)
        grouped = below.withColumn("up", F.shiftright("b", fan_bits)).groupBy("key", "up")
        chosen = grouped.cogroup(chosen.withColumnRenamed("b", "up").groupBy("key", "up")).applyInArrow(choose_between, STATES)
    for upper in joints:  # borders between upper parts count once, with no states
        chosen = chosen.unionByName(upper.select("key", F.lit(-1).cast("long").alias("b"), F.lit(0).alias("entry"), F.lit(0).alias("out"), "joint"))
    return staged(chosen)


def finish_block(rows: pa.Table, states: pa.Table) -> pa.Table:
    """Settle the stretches at a block's borders between their chosen states; a conversation's last one gets its closing inserts."""
    if not rows.num_rows:
        return _PLANNED.empty_table()
    rows = rows.sort_by("at").combine_chunks()
    code, key = rows.column("code").to_numpy().astype(np.int64), rows.column("key").to_pylist()
    start = np.append(0, np.flatnonzero([a != b for a, b in zip(key[:-1], key[1:], strict=True)]) + 1).astype(np.int64)
    size = np.diff(np.append(start, len(key)))
    given = {r["key"]: r for r in states.to_pylist()}
    mine = [given[key[s]] for s in start]
    entry, out = (np.array([m[c] for m in mine]) for c in ("entry", "out"))
    cost, audits, _, steps = walked(code, start, size, np.where(np.arange(4) == out[:, None], 0, FAR), entry)
    tails = [TAIL[m["out"]] if m["final"] else "" for m in mine]
    audit, price = [None] * len(key), [None] * len(key)
    for s, n, a, c, t in zip(start, size, audits, cost, tails, strict=True):
        steps[s + n - 1] += t
        audit[s + n - 1], price[s + n - 1] = a + "I" * len(t), int(c) + INSERT * len(t)
    for name, values in (("steps", steps), ("audit", audit), ("cost", price)):
        k = _PLANNED.get_field_index(name)
        rows = rows.set_column(k, _PLANNED.field(k), pa.array(values, _PLANNED.field(k).type))
    return rows


def repair(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", block_bits: int = BLOCK_BITS, fan_bits: int = FAN_BITS) -> tuple[DataFrame, DataFrame]:
    """Two tables. Reports, one row per conversation (as ``key_of``): blank, duplicate, truncated, illegal, cost, audit. Repaired rows: key, at,
    step (with ``at`` their order), role, text."""
    rows = arranged(df, conv, turn, role, text)
    solid = F.rtrim("text", F.lit(WHITE))
    initial = F.substring("role", 1, 1)
    code = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    flags = F.when(solid == "", BLANK).when(~F.substring(solid, -1, 1).isin(".", "!", "?"), CUT).otherwise(0)
    block = F.shiftright("at", block_bits).alias("block")
    light = rows.select("key", block, "at", (code + flags).alias("code"))
    firsts = rows.groupBy("key", "mark").agg(F.min("at").alias("at")).select(block, "at")
    planned = staged(light.groupBy("block").cogroup(firsts.groupBy("block")).applyInArrow(plan_block, PLANNED))

    parts = planned.filter("costs IS NOT NULL").select("key", F.col("block").alias("b"), "first", "last", "costs", "ranks")
    states = settle(parts, fan_bits)
    ends = states.groupBy("key").agg(F.max("b").alias("b"), F.lit(True).alias("final"))
    chosen = states.filter("b >= 0").join(ends, ["key", "b"], "left").select(F.col("b").alias("block"), "key", "entry", "out", F.coalesce("final", F.lit(False)).alias("final"))
    open_rows = planned.filter("steps IS NULL")
    finished = staged(open_rows.groupBy("block").cogroup(chosen.groupBy("block")).applyInArrow(finish_block, PLANNED))

    settled = planned.filter("steps IS NOT NULL").unionByName(finished)
    counts = ["cost", "blank", "duplicate", "truncated", "illegal"]
    pieces = settled.filter("audit IS NOT NULL").select("key", "block", "audit", *counts)
    pieces = pieces.unionByName(states.filter("joint > 0").select("key", F.lit(-1).cast("long").alias("block"), F.lit("").alias("audit"), *[F.lit(0).cast("long").alias(c) for c in counts[:-1]], F.col("joint").alias("illegal")))
    listed = F.array_sort(F.collect_list(F.struct("block", "audit")))  # as long as the audit itself
    reports = pieces.groupBy("key").agg(*[F.sum(c).alias(c) for c in counts], F.array_join(F.transform(listed, lambda x: x["audit"]), "").alias("audit"))

    char = F.split("steps", "")
    steps = rows.select("key", "at", "role", "text").join(settled.select("at", char.alias("steps")), "at")
    steps = steps.select("key", "at", F.posexplode("steps").alias("step", "does"), "role", "text").filter("does NOT IN ('D', '')")
    user, assistant = F.col("does").isin("u", "U"), F.col("does").isin("a", "A")
    repaired = steps.select("key", "at", "step", F.when(user, "user").when(assistant, "assistant").otherwise(F.col("role")).alias("role"),
                            F.when(F.col("does").isin("u", "a"), "").otherwise(F.col("text")).alias("text"))
    return reports, repaired


def digest(repaired: DataFrame) -> DataFrame:
    """key and repaired_sha256, of ``role:text`` lines in order; one pass over sorted rows, a batch at a time."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key, chain = None, None
        for batch in batches:
            done = []
            lines = pc.binary_join_element_wise(batch.column("role"), batch.column("text"), ":").to_pylist()
            for key, line in zip(batch.column("key").to_pylist(), lines, strict=True):
                if key == open_key:
                    chain.update(b"\n")
                else:
                    if chain is not None:
                        done.append((open_key, chain.hexdigest()))
                    open_key, chain = key, hashlib.sha256()
                chain.update(line.encode())
            yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], pa.string()) for k in (0, 1)], ["key", "repaired_sha256"])
        if chain is not None:
            yield pa.RecordBatch.from_arrays([pa.array([open_key]), pa.array([chain.hexdigest()])], ["key", "repaired_sha256"])

    ordered = repaired.repartition("key").sortWithinPartitions("key", "at", "step").select("key", "role", "text")
    return ordered.mapInArrow(work, "key string, repaired_sha256 string")


def damage(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows with nulls as one space, damaged by crc32 of ``conv:turn``: dropped, emptied, without ends of sentences, repeated, given to the user."""
    shown = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (conv, turn, role, text)]
    fault = F.crc32(F.concat(shown[0], F.lit(":"), shown[1])) % 20
    rows = df.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), shown[2].alias("role"), shown[3].alias("text"), fault.alias("fault")).filter("fault <> 0")
    times = F.explode(F.array_repeat(F.lit(0), F.when(F.col("fault") == 3, 2).otherwise(1)))
    return rows.select(
        F.col("conv").alias(conv), F.col("turn").alias(turn), F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias(role),
        F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias(text), times.alias("_copy"),
    ).drop("_copy")


def trial(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", **sizes: int) -> DataFrame:
    """Damage, repair and digest: one row per original conversation. Gaps beyond a long are null."""
    broken = damage(df, conv, turn, role, text)
    reports, repaired = repair(broken, conv, turn, role, text, **sizes)
    wide = [f(F.col(turn).cast("decimal(20,0)")) for f in (F.max, F.min)]
    gaps = broken.groupBy(key_of(conv)).agg(F.coalesce((wide[0] - wide[1] + 1 - F.countDistinct(turn)).try_cast("long"), F.when(F.count(turn) == 0, 0).cast("long")).alias("gaps"))
    all_ids = df.groupBy(key_of(conv)).agg(F.first(F.col(conv)).alias(conv))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    out = all_ids.join(gaps, "key", "left").join(reports, "key", "left").join(digest(repaired), "key", "left")
    return out.select(
        conv, F.when(F.col("audit").isNull(), F.lit(0).cast("long")).otherwise(F.col("gaps")).alias("gaps"), *[zero(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )
