"""Repair of conversations against a plain search over all edits."""

import hashlib
import random
import zlib

import pytest

from sitescan.llm import structure
from sitescan.llm.structure import damaged, matrix_of, repaired, tables, through, trace

BLANK = " \t\n\x0b\x0c\r"
KEEPS = {"": "su", "s": "u", "u": "a", "a": "u"}


def plain(turns):
    """The result of (turn, role, text) rows by trying all edits, the best (cost, audit) kept per last role."""
    turns = sorted(turns, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, faults = set(), []
    for _, role, text in turns:
        solid = text.rstrip(BLANK)
        faults.append("b" if not solid else "d" if (role, text) in seen else "t" if solid[-1] not in ".!?" else "")
        seen.add((role, text))
    best = {"": (0, "", ())}

    def offer(into, state, value):
        if state not in into or value < into[state]:
            into[state] = value

    def opened(states):
        out = dict(states)
        for _ in range(3):
            for q, (c, x, lines) in list(out.items()):
                to = "a" if q == "u" else "u"
                offer(out, to, (c + 5, x + "I", (*lines, ("assistant:" if to == "a" else "user:"))))
        return out

    for (_, role, text), fault in zip(turns, faults, strict=True):
        after = {}
        for q, (c, x, lines) in opened(best).items():
            offer(after, q, (c + 2, x + "D", lines))
            if fault in ("b", "d"):
                continue
            more = 5 if fault == "t" else 0
            if role[:1] and role[:1] in KEEPS[q]:
                offer(after, role[0], (c + more, x + "K", (*lines, role + ":" + text)))
            to = "a" if q == "u" else "u"
            offer(after, to, (c + more + 1, x + "R", (*lines, ("assistant:" if to == "a" else "user:") + text)))
        best = after
    cost, audit, lines = min(v for q, v in opened(best).items() if q in ("", "a"))
    known = [t for t, _, _ in turns if t is not None]
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(turns, turns[1:], strict=False)]
    return (
        max(known) - min(known) + 1 - len(set(known)) if known else 0, faults.count("b"), faults.count("d"), faults.count("t"),
        sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    )


def broken(rows):
    out = {}
    for conv, turn, role, text in rows:
        out.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 1:
            text = ""
        if kind == 2:
            text = "".join(c for c in text if c not in ".!?")
        if kind:
            out[conv] += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def made(seed, convs=120, longest=14):
    rnd = random.Random(seed)
    texts = ["Yes.", "No!", "Why?", "cut off", "", " \n", "Ends. \t", "é.", "so...", " ", None]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", "U", None]
    rows = []
    for conv in range(convs):
        turns = [rnd.choice([None, *range(8)]) if conv % 4 == 0 else t for t in range(rnd.randint(1, longest))]
        rows += [(conv, t, rnd.choice(roles), rnd.choice(texts) if rnd.random() < 0.5 else f"said {rnd.random()}.") for t in turns]
    return [*rows, (None, None, None, None), (None, 0, "user", "Null."), (None, 1, "assistant", "Yes.")]


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
SCHEMA = "conv_id long, turn long, role string, text string"


def held(spark, rows):
    got = repaired(damaged(spark.createDataFrame(rows, SCHEMA))).collect()
    want = {c: plain(turns) for c, turns in broken(rows).items()}
    assert len(got) == len(want)
    for r in got:
        assert tuple(r[c] for c in COLUMNS) == want[r.conv_id], r.conv_id


def test_against_a_plain_search(spark):
    held(spark, made(1) + made(2, convs=20)[:40])  # ids that come twice: repeated turns and rows


def test_conversations_over_many_segments(spark, monkeypatch):
    monkeypatch.setattr(structure, "SEGMENT", 4)
    held(spark, made(3, convs=12, longest=90))


def test_costs_by_table_are_those_by_symbol():
    rnd = random.Random(5)
    for _ in range(200):
        symbols = bytes(rnd.randrange(structure.SYMBOLS) for _ in range(rnd.randint(1, 23)))
        v = structure.END
        for s in reversed(symbols):
            v = structure.before(s, v)
        low = min(v)
        assert through(matrix_of(symbols), structure.END) == tuple(c - low for c in v)
        assert trace(symbols, structure.END, True) == trace(symbols, structure.END, True, length=1)


def test_vectors_are_few():
    assert len(tables().vectors) < 100


def test_one_long_conversation_and_long_texts(spark):
    rows = [(7, t, ("user", "assistant")[t % 2], f"turn {t % 900}." if t % 11 else "x" * 50 + " cut") for t in range(6000)]
    held(spark, rows + [(8, 0, "user", "word " * 300_000 + "."), (8, 1, "assistant", "!" * 1_000_000)])


def test_rows_that_repeat(spark):
    held(spark, [(1, 0, "user", "Same.")] * 500 + [(1, None, "user", " ")] * 30 + [(1, 2, "assistant", "Yes.")])


@pytest.mark.parametrize("rows", [[], [(3, t, "user", "Gone.") for t in range(400) if zlib.crc32(f"3:{t}".encode()) % 20 == 0]])
def test_no_rows(spark, rows):
    held(spark, rows)


def test_extra_columns(spark):
    df = spark.createDataFrame([(1, 0, "user", "Yes.", 5, "k"), (1, 1, "assistant", "No.", 6, "l")], SCHEMA + ", n int, symbol string")
    assert repaired(damaged(df)).count() == 1
