"""Cheapest repair of role sequences by an auction shortest-path search over an integer-cost lattice.

A conversation is repaired to an optional system row and then user and assistant rows in turn.  Nodes of the lattice are
(rows read, state); the states are nothing written, a system row written, a user row written, an assistant row
written.  Arcs keep, rerole or delete the next row, or insert an empty one.  The search holds a price per node and
a path from the start: at the path's end it extends along the arc of least cost plus price if that equals the node's
price, else it raises the price to that sum and contracts the path.  Prices never exceed the cost still to pay, so the arcs of
the final path are tight; among equal arcs it takes the least letter, and a smaller letter that was not tight
then never becomes so, since prices only rise.  The path is therefore the ASCII-least of the cheapest.

Rows that must go (blank, duplicate) are no choice: they are deleted where they stand, before any insertion there.

The search runs over windows of 16 rows from the last to the first, each with the exact prices of the next as those of its
exits, so its work is linear in the rows.  Windows recur, and a task remembers them.

Rows are dealt by ranges of (conversation, turn, role, text).  Nearly every conversation lies inside one range and is
finished while its range is read.  Those at the borders of ranges, and those of many rows, become blocks: blocks
learn their repeated rows by a join on digests, their exit prices by (min, +) products per range and then per
conversation, and are traced for each state they may start in.  Only the hash of a long conversation, which has no
parallel form, reads its blocks in order, one at a time.  Equal rows fold into one with a count before they are dealt.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spotrace.session import materialize

WINDOW = 16
BLOCK_ROWS = 512
BLOCK_CHARS = 1_000_000
NEVER = 1 << 60

START, SYSTEM, USER, ASSISTANT = range(4)
# The state that a user or assistant row leads to, and the role it must have.
NEXT = (USER, USER, ASSISTANT, USER)
ROLE = ("user", "user", "assistant", "user")
KEEPS = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
LEGAL = {"su", "ua", "au"}
# What is still to pay after the last row, by state, and the insertions that it buys.
LAST = (0, 4, 2, 0)
ENDING = ("", "II", "I", "")
WHITE = " \t\n\x0b\x0c\r"


@lru_cache(maxsize=200_000)
def auction(window: str, exits: tuple[int, ...], entry: int) -> tuple[int, str, int]:
    """(cost, letters, exit state) of the cheapest path through a window, ties by least letters.

    ``window`` has a letter per row: s, u, a or o for any other role, upper case if the row is truncated.
    """
    width = len(window)
    later = min(exits[USER], exits[ASSISTANT])
    known = (min(exits), min(exits[SYSTEM], later), later, later)
    price = [list(known) for _ in range(width)]
    price.append(list(exits))
    path, letters = [(0, entry)], []
    while True:
        row, state = path[-1]
        if row == width:
            return price[0][entry], "".join(letters), state
        code = window[row]
        role, extra = code.lower(), int(code.isupper())
        there = NEXT[state]
        best, letter, to = 3 + price[row + 1][state], "D", (row + 1, state)
        if (cost := 2 + price[row][there]) < best:
            best, letter, to = cost, "I", (row, there)
        kept = KEEPS.get((state, role))
        if kept is not None and (cost := extra + price[row + 1][kept]) < best:
            best, letter, to = cost, "K", (row + 1, kept)
        if (cost := 2 + extra + price[row + 1][there]) < best:
            best, letter, to = cost, "R", (row + 1, there)
        if price[row][state] < best:
            price[row][state] = best
            if len(path) > 1:
                path.pop()
                letters.pop()
        else:
            path.append(to)
            letters.append(letter)


def _solved(window: str, exits: tuple[int, ...], entry: int) -> tuple[int, str, int]:
    """As :func:`auction`, which remembers windows by the differences of their exit prices."""
    least = min(exits)
    cost, letters, state = auction(window, tuple(x - least for x in exits), entry)
    return cost + least, letters, state


def window_prices(codes: str, exits: tuple[int, ...]) -> list[tuple[int, ...]]:
    """Prices by state at the start of each window and at the end of all."""
    out = [tuple(exits)]
    for s in reversed(range(0, len(codes), WINDOW)):
        out.append(tuple(_solved(codes[s:s + WINDOW], out[-1], e)[0] for e in range(4)))
    return out[::-1]


def trace(codes: str, prices: list[tuple[int, ...]], entry: int) -> tuple[str, int]:
    """(letters, exit state) of the least cheapest path from ``entry``."""
    out = []
    for w, s in enumerate(range(0, len(codes), WINDOW)):
        _, letters, entry = _solved(codes[s:s + WINDOW], prices[w + 1], entry)
        out.append(letters)
    return "".join(out), entry


def cost_matrix(codes: str) -> list[int]:
    """Cheapest cost from each state before to each state behind the rows, row by row; NEVER if there is no way."""
    to_user, to_assistant = window_prices(codes, (2, 2, 0, 2))[0], window_prices(codes, (4, 4, 2, 0))[0]
    n = len(codes)
    one_system = [3 * (n - 1) + (c == "S") for c in codes if c in "sS"]
    return [
        3 * n, min(one_system, default=NEVER), to_user[0], to_assistant[0],
        NEVER, 3 * n, to_user[1], to_assistant[1],
        NEVER, NEVER, to_user[2], to_assistant[2],
        NEVER, NEVER, to_user[3], to_assistant[3],
    ]


def through(matrix: list[int], exits: tuple[int, ...]) -> tuple[int, ...]:
    """Prices before, from prices behind."""
    return tuple(min(NEVER, min(matrix[4 * e + f] + exits[f] for f in range(4))) for e in range(4))


def _product(a: list[int], b: list[int]) -> list[int]:
    return [min(NEVER, min(a[4 * e + k] + b[4 * k + f] for k in range(4))) for e in range(4) for f in range(4)]


class Rows:
    """Rows of one conversation in order: turn, role, text, how often they come (0: dropped)."""

    def __init__(self, rows: list[tuple], repeated: set[int] | None = None):
        """``repeated`` numbers the rows whose role and text came earlier; without it they are found here."""
        self.rows = [r for r in rows if r[3]] if repeated is None else rows
        self.blank = self.duplicate = self.truncated = self.illegal = self.forced = 0
        self.must_go: list[bool] = []
        codes, seen, last = [], set(), None
        self.first = ""
        for k, (_, role, text, copies) in enumerate(self.rows):
            initial, bare = role[:1], text.strip(WHITE)
            if last is None:
                self.first = initial
            elif last + initial not in LEGAL:
                self.illegal += 1
            self.illegal += copies - 1
            last = initial
            again = (role, text) in seen if repeated is None else k in repeated
            if repeated is None:
                seen.add((role, text))
            go = True
            if not bare:
                self.blank += copies
                self.forced += copies
            elif again:
                self.duplicate += copies
                self.forced += copies
            else:
                go = False
                self.duplicate += copies - 1
                self.forced += copies - 1
                cut = bare[-1] not in ".!?"
                self.truncated += cut
                code = initial if initial in ("s", "u", "a") else "o"
                codes.append(code.upper() if cut else code)
            self.must_go.append(go)
        self.last = last or ""
        self.codes = "".join(codes)
        turns = [t for t, *_ in self.rows if t is not None]
        self.turns = (turns[0], turns[-1], len(set(turns))) if turns else None

    def gaps(self) -> int:
        return self.turns[1] - self.turns[0] + 1 - self.turns[2] if self.turns else 0

    def repaired(self, letters: str, state: int) -> tuple[str, list[str]]:
        """(audit with the rows that must go, repaired lines) of a traced path."""
        audit, lines = [], []
        at = 0

        def insert():
            nonlocal at, state
            audit.append("I")
            lines.append(ROLE[state] + ":")
            state = NEXT[state]
            at += 1

        for (_, role, text, copies), go in zip(self.rows, self.must_go):
            if go:
                audit.append("D" * copies)
                continue
            while letters[at] == "I":
                insert()
            letter = letters[at]
            at += 1
            audit.append(letter + "D" * (copies - 1))
            if letter == "K":
                lines.append(f"{role}:{text}")
                state = KEEPS[state, role[:1]]
            elif letter == "R":
                lines.append(f"{ROLE[state]}:{text}")
                state = NEXT[state]
        while at < len(letters):
            insert()
        return "".join(audit), lines


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def repair(rows: list[tuple]) -> dict:
    """Counts, cheapest edits and digest of one whole conversation."""
    held = Rows(rows)
    prices = window_prices(held.codes, LAST)
    letters, state = trace(held.codes, prices, START)
    audit, lines = held.repaired(letters + ENDING[state], START)
    return {
        "gaps": held.gaps(), "blank": held.blank, "duplicate": held.duplicate, "truncated": held.truncated,
        "illegal": held.illegal, "cost": prices[0][START] + 3 * held.forced, "audit": audit, "repaired": "\n".join(lines),
    }


def digest(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


_LIST = {"turns": T.LongType(), "roles": T.StringType(), "texts": T.StringType(), "copies": T.LongType()}


def _longs(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.LongType()) for n in names]


def _text(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.StringType()) for n in names]


def _lists(kind: T.DataType, *names: str) -> list[T.StructField]:
    return [T.StructField(n, T.ArrayType(kind)) for n in names]


PLACE = _longs("part", "block")
ROWS = [T.StructField(n, T.ArrayType(k)) for n, k in _LIST.items()]
RESULT = [*_longs(*COUNTS), *_text("audit", "repaired_sha256")]
SUMMARY = [
    *_longs("blank", "duplicate", "truncated", "illegal", "forced", "first_turn", "last_turn", "n_turns"),
    *_text("first", "last"), *_lists(T.LongType(), "matrix"),
]
SUMMED = ("blank", "duplicate", "truncated", "illegal", "forced")


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _mapped(df: DataFrame, schema: T.StructType, fn: Callable[[Iterator[dict]], Iterator[dict]], most: int = 256) -> DataFrame:
    """Rows of a partition, in order, through a function from dicts to dicts."""
    arrow = _arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        size = 0
        for row in fn(r for b in batches for s in range(0, b.num_rows, most) for r in b.slice(s, most).to_pylist()):
            held.append(row)
            size += 1 + len(row.get("texts") or ())
            if size >= 4096:
                yield pa.RecordBatch.from_pylist(held, arrow)
                held, size = [], 0
        yield pa.RecordBatch.from_pylist(held, arrow)

    return df.mapInArrow(run, schema)


def damage(conversations: DataFrame) -> DataFrame:
    """The rows after damage: conv_id, turn, role, text, copies (0 marks a dropped row, 2 a repeated one).

    By crc32 of ``conv_id:turn`` modulo 20: 0 drops a row, 1 empties its text, 2 takes its ``.!?`` out, 3 repeats it,
    4 makes it the user's.  A null role or text is one space; a null number reads as one space in the key and stays null.
    """
    known = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")]
    kind = F.crc32(F.concat(known[0], F.lit(":"), known[1]).cast("binary")) % 20
    return conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), known[2].alias("role"),
                                known[3].alias("text"), kind.alias("kind")).select(
        "conv_id", "turn",
        F.expr("CASE kind WHEN 0 THEN '' WHEN 4 THEN 'user' ELSE role END").alias("role"),
        F.expr("CASE WHEN kind IN (0, 1) THEN '' WHEN kind = 2 THEN translate(text, '.!?', '') ELSE text END").alias("text"),
        F.expr("CASE kind WHEN 0 THEN 0L WHEN 3 THEN 2L ELSE 1L END").alias("copies"),
    )


def fold(rows: DataFrame) -> DataFrame:
    """Equal rows of a batch become one with the sum of their copies, before any exchange."""
    keys = rows.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            once = pa.Table.from_batches([batch]).group_by(keys, use_threads=False).aggregate([("copies", "sum")])
            yield from once.select([*keys, "copies_sum"]).rename_columns([*keys, "copies"]).cast(batch.schema).to_batches()

    return rows.mapInArrow(run, rows.schema)


def _deal(rows: DataFrame) -> DataFrame:
    """One row per conversation inside a range, or per block of one that may go on outside it."""
    conv = rows.schema["conv_id"]
    schema = T.StructType([conv, *PLACE, *RESULT, *ROWS])

    def run(found: Iterator[dict]) -> Iterator[dict]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()

        def as_block(conv_id, block: int, held: list[tuple]) -> dict:
            return {"conv_id": conv_id, "part": part, "block": block, **dict(zip(_LIST, map(list, zip(*held))))}

        held, size, block = [], 0, 0
        conv_id, at_border = None, True
        for row in found:
            if held and (row["conv_id"] != conv_id or len(held) >= BLOCK_ROWS or size >= BLOCK_CHARS):
                same = row["conv_id"] == conv_id
                if same or at_border or block:
                    yield as_block(conv_id, block, held)
                else:
                    made = repair(held)
                    yield {"conv_id": conv_id, **made, "repaired_sha256": digest(made["repaired"])}
                at_border, block = at_border and same, block + 1 if same else 0
                held, size = [], 0
            turn, role, text, copies = row["turn"], row["role"], row["text"], row["copies"]
            if held and held[-1][:3] == (turn, role, text) and bool(held[-1][3]) == bool(copies):
                held[-1] = (turn, role, text, held[-1][3] + copies)
            else:
                held.append((turn, role, text, copies))
                size += len(role) + len(text)
            conv_id = row["conv_id"]
        if held:
            yield as_block(conv_id, block, held)

    return _mapped(rows, schema, run)


def _summed(parts: list[dict]) -> dict:
    """The summary of consecutive stretches of one conversation."""
    out = dict(parts[0])
    for p in parts[1:]:
        for name in SUMMED:
            out[name] += p[name]
        out["illegal"] += bool(out["last"] is not None and p["first"] is not None and out["last"] + p["first"] not in LEGAL)
        out["first"] = p["first"] if out["first"] is None else out["first"]
        out["last"] = out["last"] if p["last"] is None else p["last"]
        if p["n_turns"]:
            if out["n_turns"]:
                out["n_turns"] += p["n_turns"] - (out["last_turn"] == p["first_turn"])
            else:
                out["first_turn"], out["n_turns"] = p["first_turn"], p["n_turns"]
            out["last_turn"] = p["last_turn"]
        out["matrix"] = _product(out["matrix"], p["matrix"])
    return out


def _join(a: DataFrame, b: DataFrame, *names: str, how: str = "inner") -> DataFrame:
    """Join on conv_id, of which null equals null, and ``names``; ``b`` gives its other columns."""
    on = F.col("conv_id").eqNullSafe(F.col("_conv_id"))
    for n in names:
        on = on & (F.col(n) == F.col(f"_{n}"))
    keys = {n: f"_{n}" for n in ("conv_id", *names)}
    return a.join(b.withColumnsRenamed(keys), on, how).drop(*keys.values())


def _with_repeats(blocks: DataFrame) -> DataFrame:
    """Blocks with the numbers of their rows whose role and text the conversation has earlier."""
    key = F.sha2(F.concat(F.length("row.roles").cast("string"), F.lit(":"), F.col("row.roles"), F.col("row.texts")), 256)
    rows = blocks.select(
        "conv_id", "part", "block", F.posexplode(F.arrays_zip("roles", "texts", "copies")).alias("pos", "row")
    ).where("row.copies > 0").select("conv_id", F.struct("part", "block", "pos").alias("place"), key.alias("key"))
    firsts = rows.groupBy("conv_id", "key").agg(F.min("place").alias("earliest"), F.count("*").alias("n")).where("n > 1")
    again = _join(rows, firsts, "key").where("place > earliest").select("conv_id", "place.part", "place.block", "place.pos")
    numbers = again.groupBy("conv_id", "part", "block").agg(F.collect_list("pos").alias("again"))
    return _join(blocks, numbers, "part", "block", how="left")


def _summaries(blocks: DataFrame) -> DataFrame:
    conv = blocks.schema["conv_id"]

    def run(found: Iterator[dict]) -> Iterator[dict]:
        for b in found:
            again = set(b["again"] or ())
            kept = [k for k, c in enumerate(b["copies"]) if c]
            rows = [tuple(b[n][k] for n in _LIST) for k in kept]
            held = Rows(rows, {i for i, k in enumerate(kept) if k in again})
            turns = held.turns or (None, None, 0)
            yield {
                **b, "codes": held.codes, "must_go": held.must_go, "blank": held.blank, "duplicate": held.duplicate,
                "truncated": held.truncated, "illegal": held.illegal, "forced": held.forced,
                "first_turn": turns[0], "last_turn": turns[1], "n_turns": turns[2],
                "first": held.first if rows else None, "last": held.last if rows else None, "matrix": cost_matrix(held.codes),
                **{n: [r[i] for r in rows] for i, n in enumerate(_LIST)},
            }

    fields = [conv, *PLACE, *ROWS, *_text("codes"), *_lists(T.BooleanType(), "must_go"), *SUMMARY]
    return _mapped(blocks, T.StructType(fields), run, 16)


def _with_exits(blocks: DataFrame) -> DataFrame:
    """conv_id, part, block, the prices behind each block and the counts of the whole conversation."""
    conv, names = blocks.schema["conv_id"], [f.name for f in SUMMARY]
    summary = F.struct(*names)
    parts = blocks.groupBy("conv_id", "part").agg(F.sort_array(F.collect_list(F.struct("block", summary.alias("s")))).alias("each"))

    def of_part(found: Iterator[dict]) -> Iterator[dict]:
        for p in found:
            yield {"conv_id": p["conv_id"], "part": p["part"], **_summed([x["s"] for x in p["each"]])}

    summed = _mapped(parts, T.StructType([conv, *_longs("part"), *SUMMARY]), of_part)
    whole = summed.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("part", summary.alias("s")))).alias("each"))

    def of_conversation(found: Iterator[dict]) -> Iterator[dict]:
        for c in found:
            total, behind = _summed([x["s"] for x in c["each"]]), LAST
            counts = {n: total[n] for n in COUNTS[1:-1]}
            counts["gaps"] = total["last_turn"] - total["first_turn"] + 1 - total["n_turns"] if total["n_turns"] else 0
            counts["cost"] = through(total["matrix"], LAST)[START] + 3 * total["forced"]
            for x in reversed(c["each"]):
                yield {"conv_id": c["conv_id"], "part": x["part"], "exits": list(behind), **counts}
                behind = through(x["s"]["matrix"], behind)

    ends = _mapped(whole, T.StructType([conv, *_longs("part"), *_lists(T.LongType(), "exits"), *_longs(*COUNTS)]), of_conversation)
    joined = _join(parts, ends, "part")

    def of_block(found: Iterator[dict]) -> Iterator[dict]:
        for p in found:
            behind = tuple(p["exits"])
            for x in reversed(p["each"]):
                yield {"conv_id": p["conv_id"], "part": p["part"], "block": x["block"], "exits": list(behind), **{n: p[n] for n in COUNTS}}
                behind = through(x["s"]["matrix"], behind)

    return _mapped(joined, T.StructType([conv, *PLACE, *_lists(T.LongType(), "exits"), *_longs(*COUNTS)]), of_block)


def _joined(blocks: DataFrame) -> DataFrame:
    """Whole conversations from their blocks."""
    conv = blocks.schema["conv_id"]
    mine = blocks.select("conv_id", "part", "block", *_LIST, "codes", "must_go")
    known = _join(mine, _with_exits(blocks), "part", "block")

    def traced(found: Iterator[dict]) -> Iterator[dict]:
        for b in found:
            prices = window_prices(b["codes"], tuple(b["exits"]))
            ways = [trace(b["codes"], prices, e) for e in range(4)]
            yield {**b, "letters": [w[0] for w in ways], "leaves": [w[1] for w in ways]}

    fields = [conv, *PLACE, *ROWS, *_lists(T.BooleanType(), "must_go"), *_longs(*COUNTS), *_lists(T.StringType(), "letters"), *_lists(T.LongType(), "leaves")]
    pieces = _mapped(known, T.StructType(fields), traced, 16)

    def in_order(found: Iterator[dict]) -> Iterator[dict]:
        out, sha, state, written, audit = None, None, START, False, []

        def add(piece: str, lines: list[str]) -> None:
            nonlocal written
            audit.append(piece)
            if lines:
                sha.update((("\n" if written else "") + "\n".join(lines)).encode("utf-8", "surrogatepass"))
                written = True

        def closed() -> dict:
            add(*Rows([]).repaired(ENDING[state], state))
            return {**out, "audit": "".join(audit), "repaired_sha256": sha.hexdigest()}

        for b in found:
            if out is None or b["conv_id"] != out["conv_id"]:
                if out is not None:
                    yield closed()
                out = {n: b[n] for n in ("conv_id", *COUNTS)}
                sha, state, written, audit = hashlib.sha256(), START, False, []
            held = Rows([])
            held.rows, held.must_go = [tuple(b[n][k] for n in _LIST) for k in range(len(b["copies"]))], b["must_go"]
            add(*held.repaired(b["letters"][state], state))
            state = b["leaves"][state]
        if out is not None:
            yield closed()

    dealt = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "part", "block")
    return _mapped(dealt, T.StructType([conv, *RESULT]), in_order, 16)


def repair_damaged(rows: DataFrame) -> DataFrame:
    """Repair conversations given as conv_id, turn, role, text, copies (as :func:`damage` makes them).

    One row per conv_id: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.  Rows are taken by turn,
    nulls first, then by role and text; a conversation without rows has zeros, an empty audit and the hash of
    nothing.  All null conv_ids are one conversation.  Stores two tables in the shared folder.
    """
    keys = ["conv_id", "turn", "role", "text"]
    dealt = materialize(_deal(fold(rows).repartitionByRange(*keys).sortWithinPartitions(*keys)), "conversations")
    names = ["conv_id", *(f.name for f in RESULT)]
    blocks = materialize(_summaries(_with_repeats(dealt.where("block IS NOT NULL").drop(*names[1:]))), "blocks")
    return dealt.where("block IS NULL").select(*names).union(_joined(blocks).select(*names))


def damage_and_repair(conversations: DataFrame) -> DataFrame:
    """Damage rows by their numbers, then repair every conversation; see :func:`damage` and :func:`repair_damaged`.

    Columns other than conv_id, turn, role and text are not read; repeated rows are rows; no rows give no rows.
    """
    return repair_damaged(damage(conversations))
