"""Conversation repair against an exhaustive search with another method, on odd input and across ranges."""

import hashlib
import heapq
import random
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spotrace.llm import conversation_repair as cr
from spotrace.llm import queries
from tests.llm.test_llm import SMALL

WHITE = " \t\n\x0b\x0c\r"
GOAL = re.compile(r"(s?(ua)+)?")


def damaged(rows):
    """The contract's damage, row by row."""
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        out += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))


def expected(rows):
    """Counts, then the least (cost, edits) of all edit sequences by a search over (row, roles so far)."""
    seen, faults = set(), []
    for _, role, text in rows:
        bare = text.strip(WHITE)
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
        seen.add((role, text))
        faults.append(fault)
    turns = [t for t, *_ in rows if t is not None]
    initials = [r[:1] for _, r, _ in rows]
    # Only what may still follow matters of the roles so far: nothing, system, user or assistant last.
    states = {"": "", "s": "s", "u": "u", "a": "a"}
    ok = {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}
    queue, done = [(0, "", 0, "", ())], set()
    cost, audit, lines = None, None, None
    while queue:
        cost, audit, at, last, lines = heapq.heappop(queue)
        if at == len(rows) and last in ("", "a"):
            break
        if (at, last) in done:
            continue
        done.add((at, last))
        for role in ("user", "assistant"):
            if (last, role[0]) in ok:
                heapq.heappush(queue, (cost + 2, audit + "I", at, role[0], (*lines, f"{role}:")))
        if at == len(rows):
            continue
        _, role, text = rows[at]
        extra = int(faults[at] == "truncated")
        heapq.heappush(queue, (cost + 3, audit + "D", at + 1, last, lines))
        if faults[at] in ("blank", "duplicate"):
            continue
        if (last, role[:1]) in ok:
            heapq.heappush(queue, (cost + extra, audit + "K", at + 1, states[role[:1]], (*lines, f"{role}:{text}")))
        for new in ("user", "assistant"):
            if (last, new[0]) in ok:
                heapq.heappush(queue, (cost + 2 + extra, audit + "R", at + 1, new[0], (*lines, f"{new}:{text}")))
    assert GOAL.fullmatch("".join(x[0] for x in lines))
    return (
        max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
        *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
        sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
        cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    )


def check(df, rows):
    got = {r.conv_id: tuple(r[n] for n in (*cr.COUNTS, "audit", "repaired_sha256")) for r in df.collect()}
    assert got.keys() == {r[0] for r in rows}
    for conv in got:
        assert got[conv] == expected(damaged([r for r in rows if r[0] == conv])), conv


ROLES = ["user", "assistant", "system", "tool", "", None, "a", "student"]
TEXTS = ["Yes.", "no", "", " \t", None, "What?", "a ", "Fine!", "wait...\n", "x", "é", "Yes. "]
SCHEMA = "conv_id long, turn long, role string, text string"


def made(seed, conversations, longest):
    rng = random.Random(seed)
    rows = []
    for conv in range(conversations):
        n = rng.randint(1, longest)
        steady = rng.random() < 0.5
        for k in range(n):
            turn = None if rng.random() < 0.05 else k + rng.choice([0, 0, 0, 0, -1, 3])
            role = ("user", "assistant")[k % 2] if steady and rng.random() < 0.8 else rng.choice(ROLES)
            rows.append((conv if conv else None, turn, role, rng.choice(TEXTS) if rng.random() < 0.5 else f"{k} said."))
    return rows


@pytest.mark.parametrize("partitions", ["1", "7", "40"])
def test_odd_conversations(spark, partitions):
    rows = made(3, 60, 12)
    rows += rows[:9] * 4
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame([(*r, 1, "z") for r in rows], SCHEMA + ", part int, codes string")
        check(cr.damage_and_repair(df), rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_long_conversations_go_by_blocks(spark, monkeypatch):
    rng = random.Random(5)
    rows = made(4, 5, 8)
    rows += [(77, k // 2, rng.choice(ROLES[:5]), rng.choice(TEXTS + [f"t{k}", f"t{k}."])) for k in range(2500)]
    rows += [(78, 5, "user", "the same.")] * 900 + [(79, k, "user", "again and again") for k in range(700)]
    check(cr.damage_and_repair(spark.createDataFrame(rows, SCHEMA).repartition(3)), rows)


def test_empty_table_and_dropped_rows(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert cr.damage_and_repair(df).collect() == []
    gone = next(c for c in range(10_000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows = [(gone, 0, "user", "Hello.")]
    check(cr.damage_and_repair(spark.createDataFrame(rows, SCHEMA)), rows)
    assert cr.damage_and_repair(spark.createDataFrame(rows, SCHEMA)).first().repaired_sha256 == hashlib.sha256(b"").hexdigest()


def test_given_conversations(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    check(queries.QUERIES["op13_conversation_repair"](spark, SMALL), rows)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.just(0), st.sampled_from(ROLES[:5]), st.sampled_from(["a.", "b.", "c", "d", ""])), max_size=40))
def test_paths_are_the_least_of_the_cheapest(rows):
    got = cr.repair([(*r, 1) for r in rows])
    assert (got["cost"], got["audit"]) == expected(rows)[5:7]
    assert cr.digest(got["repaired"]) == expected(rows)[7]


@settings(max_examples=200, deadline=None)
@given(st.text("suaoSUAO", max_size=30), st.integers(0, 30))
def test_products_of_parts_are_the_whole(codes, at):
    assert cr._product(cr.cost_matrix(codes[:at]), cr.cost_matrix(codes[at:])) == cr.cost_matrix(codes)
    assert cr.through(cr.cost_matrix(codes), cr.LAST) == cr.window_prices(codes, cr.LAST)[0]
