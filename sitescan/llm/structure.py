"""Repair of the structure of conversations: the cheapest edits of their rows that leave (s?(ua)+)?, read as role initials.

A row is a symbol (its role's initial and its fault). What the rest of a conversation costs at least, seen from each state of the pattern (nothing
said yet, after the system, after a user, after an assistant), is a vector of four numbers; a symbol maps the vector after it to the vector before
it. Less their smallest entry there are only a few dozen such vectors, so for every block of four symbols and each of them the vector before the
block is in a table (Four Russians), and a conversation is worked through from its end by one look-up a block. A block is expanded from its
end to trace its edits, which are chosen from its beginning: at each place the least letter among those that reach the least cost.

At scale: rows are dealt out by ranges of (conversation, turn, role, text), so that one conversation may lie in many tasks, and cut into segments
of `SEGMENT` rows. Each segment is a 4x4 matrix of costs, made by look-up; matrices of a conversation are applied from its end (16 numbers per 4,096
rows); then each segment is traced alone for each state it may be entered in. Equal rows are counted before they are sent, so they take one place.
The digest of a repaired conversation is one hash over all of it, and `audit` one string, so a last task streams its rows and holds
only its audit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, slices, small_batches

REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Rows of a segment.
SEGMENT = 4096
BLANKS = r"\x20\x09-\x0D"
#: Symbols: nothing, a row that must go, then initials s, u, a, other of sound rows and of truncated ones.
NOTHING, GONE, SOUND, CUT, SYMBOLS = 0, 1, 2, 6, 10
#: States: nothing yet, after the system, after a user, after an assistant; what an added or changed row leads to; where a kept initial leads.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = (USER, USER, ASSISTANT, USER)
KEEP = {(START, 0): SYSTEM, (START, 1): USER, (SYSTEM, 1): USER, (USER, 2): ASSISTANT, (ASSISTANT, 1): USER}
ROLE = {USER: "user", ASSISTANT: "assistant"}
FAR = 1 << 40

Costs = tuple[int, int, int, int]


def _closed(v: list[int]) -> list[int]:
    """Costs where rows may be inserted first: one or two."""
    for _ in range(2):
        v = [min(c, INSERT + v[NEXT[q]]) for q, c in enumerate(v)]
    return v


def _choices(symbol: int, after: Costs, q: int) -> list[tuple[int, str, int]]:
    """(cost, letter, next state) of what can be done with a row in state q, letters ascending."""
    out = [(DELETE, "D", q)]
    if symbol != GONE:
        initial, more = (symbol - SOUND) % 4, TRUNCATED if symbol >= CUT else 0
        if (q, initial) in KEEP:
            out.append((more, "K", KEEP[q, initial]))
        out.append((more + REROLE, "R", NEXT[q]))
    return [(c + after[to], x, to) for c, x, to in out]


def before(symbol: int, after: Costs) -> Costs:
    """Least costs from each state before a symbol, from those after it."""
    if symbol == NOTHING:
        return after
    return tuple(_closed([min(_choices(symbol, after, q))[0] for q in range(4)]))


END: Costs = tuple(_closed([0, FAR, FAR, 0]))


def _reduced(v: Costs) -> tuple[Costs, int]:
    low = min(v)
    return tuple(c - low if c < FAR else FAR for c in v), low


class Tables(NamedTuple):
    vectors: list[Costs]
    number: dict[Costs, int]
    step: list[list[int]]  # symbol, vector after -> vector before
    block_to: np.ndarray  # block, vector after -> vector before
    block_cost: np.ndarray  # and what was taken off it
    piece: list[list[list[tuple[str, int]]]]  # symbol, vector after, state -> letters and state


@lru_cache
def tables(length: int = 4) -> Tables:
    """All vectors that can come up after any symbols, and the tables of blocks of `length` symbols."""
    number: dict[Costs, int] = {}
    vectors: list[Costs] = []

    def of(v: Costs) -> int:
        if v not in number:
            number[v] = len(vectors)
            vectors.append(v)
        return number[v]

    for v in (END, *(tuple(0 if p == q else FAR for p in range(4)) for q in range(4))):
        of(_reduced(v)[0])
    step, cost = [[] for _ in range(SYMBOLS)], [[] for _ in range(SYMBOLS)]
    at = 0
    while at < len(vectors):
        for s in range(SYMBOLS):
            v, low = _reduced(before(s, vectors[at]))
            step[s].append(of(v))
            cost[s].append(low)
        at += 1
    one, low = np.array(step, np.int16), np.array(cost, np.int16)
    to, total = np.arange(len(vectors))[None, :], np.zeros((1, len(vectors)), np.int16)
    for _ in range(length):
        total = (total[None] + low[:, to]).reshape(-1, len(vectors))
        to = one[:, to].reshape(-1, len(vectors))

    def piece(s: int, after: Costs, q: int) -> tuple[str, int]:
        if s == NOTHING:
            return "", q
        here, letters = before(s, after), ""
        while True:
            fits = [(x, to) for c, x, to in _choices(s, after, q) if c == here[q]]
            if here[q] == INSERT + here[NEXT[q]]:
                fits.append(("I", NEXT[q]))
            if not fits:  # a state that cannot be left this way
                return letters, q
            x, q = min(fits)
            letters += x
            if x != "I":
                return letters, q

    pieces = [[[piece(s, v, q) for q in range(4)] for v in vectors] for s in range(SYMBOLS)]
    return Tables(vectors, number, step, to, total, pieces)


#: Letters that end a conversation in each state.
CLOSING = ("", "II", "I", "")


def blocks_of(symbols: bytes, length: int) -> list[int]:
    """Numbers of the blocks of `length` symbols, the first filled up with NOTHING in front."""
    raw = np.frombuffer(symbols.rjust(-(-len(symbols) // length) * length, bytes([NOTHING])), np.uint8).reshape(-1, length)
    return (raw @ (SYMBOLS ** np.arange(length - 1, -1, -1))).tolist()


def matrix_of(symbols: bytes, length: int = 4) -> list[int]:
    """Least costs of a segment, by state before it (rows) and state after it (columns), row by row."""
    t = tables(length)
    ids = [t.number[tuple(0 if p == q else FAR for p in range(4))] for q in range(4)]
    total = [0] * 4
    for block in reversed(blocks_of(symbols, length)):
        to, cost = t.block_to[block], t.block_cost[block]
        for q in range(4):
            total[q] += int(cost[ids[q]])
            ids[q] = int(to[ids[q]])
    return [min(FAR, t.vectors[ids[q]][p] + total[q]) for p in range(4) for q in range(4)]


def through(matrix: list[int], after: Costs) -> Costs:
    """Reduced costs before a segment, from those after it."""
    return _reduced(tuple(min(min(FAR, matrix[4 * p + q] + after[q]) for q in range(4)) for p in range(4)))[0]


def trace(symbols: bytes, after: Costs, last: bool, length: int = 4) -> list[str]:
    """The letters of a segment's edits, for each state in which it may be entered."""
    t = tables(length)
    padded = symbols.rjust(-(-len(symbols) // length) * length, bytes([NOTHING]))
    blocks = blocks_of(symbols, length)
    bounds = [t.number[after]]
    for block in reversed(blocks):
        bounds.append(int(t.block_to[block][bounds[-1]]))
    bounds.reverse()
    said: list[list[str]] = [[] for _ in range(4)]
    state = list(range(4))
    for k in range(len(blocks)):
        part = padded[k * length : (k + 1) * length]
        inside = [bounds[k + 1]]
        for s in reversed(part[1:]):
            inside.append(t.step[s][inside[-1]])
        for s, v in zip(part, reversed(inside), strict=True):
            row = t.piece[s][v]
            for q in range(4):
                letters, state[q] = row[state[q]]
                said[q].append(letters)
    return ["".join(x) + (CLOSING[q] if last else "") for x, q in zip(said, state, strict=True)]


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, n: rows after the damage that crc32 of `conv_id:turn` modulo 20 names, nulls being one space. n counts equal rows;
    it is 0 where they were dropped, so that each conversation keeps a row."""
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn")).cast("binary")) % 20
    df = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), text_of("role").alias("role"), text_of("text").alias("text"), kind.alias("kind"))
    role = F.when(F.col("kind") == 0, "").when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    text = F.when(F.col("kind") <= 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    n = F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1)
    return df.select("conv_id", "turn", role.alias("role"), text.alias("text"), n.alias("n")).groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("n"))


def _with_faults(df: DataFrame) -> DataFrame:
    """`df` with fault: '' none, b blank, d duplicate, t truncated, of the first of the n equal rows; the others are duplicates unless blank."""
    blank = ~F.col("text").rlike(f"[^{BLANKS}]")
    key = F.sha2(F.concat(F.col("role"), F.lit("\n"), F.col("text")).cast("binary"), 256)
    df = df.withColumn("key", F.when((F.col("n") > 0) & ~blank, key))
    # earlier: a smaller turn, null being the smallest; only what is said at several turns is joined
    place = F.struct(F.col("turn").isNotNull(), "turn")
    again = df.filter("key is not null").groupBy("conv_id", "key").agg(F.min(place).alias("first"), F.count("*").alias("times")).filter("times > 1")
    again = again.select(F.col("conv_id").alias("_c"), F.col("key").alias("_k"), "first")
    df = df.join(again, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("key") == F.col("_k")), "left")
    cut = ~F.col("text").rlike(rf"[.!?][{BLANKS}]*\z")
    fault = F.when(F.col("n") == 0, "").when(blank, "b").when(F.col("first").isNotNull() & (F.col("first") < place), "d").when(cut, "t").otherwise("")
    return df.select("conv_id", "turn", "role", "text", "n", fault.alias("fault"))


def _symbol() -> Column:
    """The symbol of the first of the equal rows. An initial is the first character of a role as it is, so an empty role has none."""
    initial = F.substring("role", 1, 1)
    of = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    return F.when(F.col("n") == 0, NOTHING).when(F.col("fault").isin("b", "d"), GONE).otherwise(of + F.when(F.col("fault") == "t", CUT).otherwise(SOUND)).cast("int")


SEGMENTS = pa.schema([("conv_id", pa.int64()), ("at", pa.int64()), ("symbols", pa.binary()), ("matrix", pa.list_(pa.int64()))])
BOUNDED = pa.schema([("conv_id", pa.int64()), ("at", pa.int64()), ("symbols", pa.binary()), ("after", pa.list_(pa.int64())), ("last", pa.bool_())])
PLANS = pa.schema([("conv_id", pa.int64()), ("at", pa.int64()), ("plans", pa.list_(pa.string()))])
DDL = {id(SEGMENTS): "conv_id long, at long, symbols binary, matrix array<long>", id(BOUNDED): "conv_id long, at long, symbols binary, after array<long>, last boolean", id(PLANS): "conv_id long, at long, plans array<string>"}


def _mapped(df: DataFrame, each, schema: pa.Schema) -> DataFrame:
    """Rows that the generator `each` makes of an iterator over the rows of a task, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for b in batches for part in slices([b]) for row in part.to_pylist())
        held: list[dict] = []
        for row in each(rows):
            held.append(row)
            if len(held) == 512:
                yield pa.RecordBatch.from_pylist(held, schema)
                held = []
        yield pa.RecordBatch.from_pylist(held, schema)

    return df.mapInArrow(run, DDL[id(schema)])


def _matrices(rows):
    for r in rows:
        symbols = bytes(x["symbol"] for x in r["rows"])
        yield {"conv_id": r["conv_id"], "at": r["at"], "symbols": symbols, "matrix": matrix_of(symbols)}


def _bounds(rows):
    """Segments of a conversation from its end, with the reduced costs after each."""
    conv, after, first = None, END, True
    for r in rows:
        last = first or r["conv_id"] != conv
        if last:
            conv, after, first = r["conv_id"], END, False
        yield {"conv_id": conv, "at": r["at"], "symbols": r["symbols"], "after": list(after), "last": last}
        after = through(r["matrix"], after)


def _plans(rows):
    for r in rows:
        yield {"conv_id": r["conv_id"], "at": r["at"], "plans": trace(r["symbols"], tuple(r["after"]), r["last"])}


RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
DONE = pa.schema([("conv_id", pa.int64()), *((c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string()), ("repaired_sha256", pa.string())])
DDL[id(DONE)] = RESULT


class _Repaired:
    """One conversation, its rows taken one by one."""

    def __init__(self, conv_id):
        self.conv_id, self.state, self.plan, self.read = conv_id, START, "", 0
        self.blank = self.duplicate = self.truncated = self.illegal = self.cost = self.turns = 0
        self.low = self.high = self.initial = None
        self.audit: list[str] = []
        self.hash, self.any = hashlib.sha256(), False

    def segment(self, plans: list[str]) -> None:
        self.plan, self.read = plans[self.state], 0

    def _say(self, role: str, text: str) -> None:
        self.hash.update((("\n" if self.any else "") + role + ":" + text).encode("utf-8", "surrogatepass"))
        self.any = True

    def _inserted(self) -> None:
        while self.plan[self.read : self.read + 1] == "I":
            self.state = NEXT[self.state]
            self._say(ROLE[self.state], "")
            self.cost += INSERT
            self.audit.append("I")
            self.read += 1

    def row(self, turn: int | None, role: str, text: str, n: int, fault: str) -> None:
        if not n:
            return
        if turn is not None:
            self.turns += turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn
        initial = role[:1]
        self.illegal += n - 1 + (self.initial is not None and self.initial + initial not in ("su", "ua", "au"))
        self.initial = initial
        self.blank += n if fault == "b" else 0
        self.duplicate += n if fault == "d" else n - 1 if fault != "b" else 0
        self.truncated += fault == "t"
        self._inserted()
        letter = self.plan[self.read]
        self.read += 1
        if letter != "D":
            self.state = KEEP[self.state, "sua".index(initial)] if letter == "K" else NEXT[self.state]
            self._say(role if letter == "K" else ROLE[self.state], text)
            self.cost += (letter == "R") * REROLE + (fault == "t") * TRUNCATED
        self.cost += DELETE * (n - 1 + (letter == "D"))
        self.audit.append(letter + "D" * (n - 1))

    def result(self) -> dict:
        self._inserted()
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return {"conv_id": self.conv_id, "gaps": gaps, "blank": self.blank, "duplicate": self.duplicate, "truncated": self.truncated, "illegal": self.illegal, "cost": self.cost, "audit": "".join(self.audit), "repaired_sha256": self.hash.hexdigest()}


def _results(rows):
    now: _Repaired | None = None
    for r in rows:
        if now is None or r["conv_id"] != now.conv_id:
            if now is not None:
                yield now.result()
            now = _Repaired(r["conv_id"])
        if r["plans"] is not None:
            now.segment(r["plans"])
        else:
            now.row(r["turn"], r["role"], r["text"], r["n"], r["fault"])
    if now is not None:
        yield now.result()


def repaired(rows: DataFrame) -> DataFrame:
    """One row per conversation of `rows` (conv_id, turn, role, text, n): its faults, and the cheapest repair as `audit` and digest.

    A conversation's rows count in order of turn (nulls first); ties go by role and text, in byte order. n says how often a row stands there (0: not at
    all, the conversation is named only). A null conv_id is a conversation of its own. Texts may be of any length: one is held at a time. Roles whose first
    character is not s, u or a, and empty ones, cannot be kept. Rows that repeat and texts that are blank must go. No rows give no rows.
    """
    spark = rows.sparkSession
    small_batches(spark)
    scratch = Scratch(spark)
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role")]
    marked = _with_faults(rows).withColumn("symbol", _symbol())
    dealt = marked.repartitionByRange(*order, F.substring("text", 1, 200)).sortWithinPartitions(*order, "text")
    kept = scratch.written(dealt.withColumn("at", F.monotonically_increasing_id()), "turns-in-order")

    segment = F.floor(F.col("at") / SEGMENT)
    cells = kept.groupBy("conv_id", segment.alias("segment")).agg(F.array_sort(F.collect_list(F.struct("at", "symbol"))).alias("rows"))
    made = _mapped(cells.select("conv_id", F.col("rows")[0]["at"].alias("at"), "rows"), _matrices, SEGMENTS)
    back = made.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), F.col("at").desc())
    plans = _mapped(_mapped(back, _bounds, BOUNDED).repartition("conv_id", "at"), _plans, PLANS)

    none = lambda kind: F.lit(None).cast(kind)
    said = F.when(F.col("symbol") != GONE, F.col("text"))
    both = kept.select("conv_id", "at", F.lit(1).alias("kind"), "turn", "role", said.alias("text"), "n", "fault", none("array<string>").alias("plans"))
    heads = plans.select("conv_id", "at", F.lit(0).alias("kind"), none("long").alias("turn"), none("string").alias("role"), none("string").alias("text"), none("long").alias("n"), none("string").alias("fault"), "plans")
    stream = both.unionByName(heads).repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "at", "kind")
    return _mapped(stream, _results, DONE)
