"""Windows read back: digests, budget, masks and escapes."""

import hashlib
import random

import pytest

from sitescan.llm.chat import escape, parse, read_back, unescape, windows


def rows():
    rnd = random.Random(1)
    bits = ["<|im_end|>", "<|im_start|>", "assistant", "<\\|", "<|", "|", "\\", "\n", "é", " word ", "<\\\\|im_end|>"]
    out = []
    for conv in range(40):
        n = rnd.randint(1, 14)
        for turn in range(n):
            role = "system" if turn == 0 and conv % 3 == 0 else rnd.choice(["user", "assistant", "assistant", "tool\nx\\n"])
            out.append((conv, turn, role, "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 120)))))
    return [*out, (50, 0, "assistant", None), (51, None, None, None), (52, 0, "assistant", "same"), (52, 0, "assistant", "same"), (53, 0, "user", "z" * 9000), (53, 1, "assistant", "y" * 9000), (None, 0, "assistant", "n")]


def test_escapes_are_reversible():
    for _, _, _, text in rows():
        text = text or ""
        assert unescape(escape(text)) == text and "<|" not in escape(text)


def test_read_back(spark):
    df = spark.createDataFrame([(*r, 1) for r in rows()], "conv_id long, turn long, role string, text string, window int")
    made = windows(df, budget=64, history=2)
    got = {r.conv_id: r for r in read_back(made).collect()}
    by = {}
    for c, t, role, text in rows():
        by.setdefault(c, []).append((-1 if t is None else t, role or "", text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        said = "".join(x for _, r, x in turns if r == "assistant")
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        assert got[c].loss_chars == len(said) and got[c].loss_sha256 == hashlib.sha256(said.encode()).hexdigest()


def test_windows_keep_system_turn_history_and_budget(spark):
    df = spark.createDataFrame(rows(), "conv_id long, turn long, role string, text string")
    seen = {}
    for w in windows(df, budget=64, history=2).collect():
        turns = parse(w.formatted)
        assert len(turns) == len(w.turn_no) == len(w.repeated)
        new = [n for n, old in zip(w.turn_no, w.repeated, strict=True) if not old]
        seen.setdefault(w.conv_id, []).extend(new)
        assert sum(w.repeated) <= 3
        if w.window and w.conv_id is not None and w.conv_id % 3 == 0 and w.conv_id < 40:
            assert turns[0][0] == "system" and w.repeated[0]
        assert len(w.loss) == sum(r == "assistant" and not old for (r, _), old in zip(turns, w.repeated, strict=True))
    assert all(sorted(v) == list(range(len(v))) for v in seen.values())
    assert windows(df.limit(0)).count() == 0


def test_windows_keep_the_budget(spark):
    said = [(1, i, "user" if i % 2 else "assistant", "a" * 1984) for i in range(6)] + [(2, 0, "user", "b" * 24), (2, 1, "assistant", "c" * 7984), (2, 2, "user", "d" * 24)]
    said += [(3, i, "system", "s" * 384) for i in range(40)] + [(4, i, "system" if i == 0 else "user", "t" * 700) for i in range(9)]
    mixed = [(100 + c if c is not None else 99, *r) for c, *r in rows()]
    made = {}
    for budget, part in ((512, said), (64, mixed)):
        for w in windows(spark.createDataFrame(part, "conv_id long, turn long, role string, text string"), budget=budget).collect():
            turns = parse(w.formatted)
            # what a window holds besides system turns: only one turn, without history, may be over the budget
            others = [r != "system" for r, _ in turns]
            assert sum(-(-len(t) // 4) + 4 for _, t in turns) <= budget or len(turns) == 1 or (turns[0][0] == "system" and len(turns) == 2), (w.conv_id, others)
            made.setdefault(w.conv_id, []).append([n for n, old in zip(w.turn_no, w.repeated, strict=True) if not old])
    assert made[1] == [[0], [1], [2], [3], [4], [5]] and made[2] == [[0], [1], [2]] and len(made[3]) == 10


def test_digests_of_the_given_conversations_equal_the_sql_twin(spark):
    duckdb = pytest.importorskip("duckdb")
    from sitescan.llm.queries import OP2_SQL, op2_chat

    folder = "/root/testdata/sf0.01"
    try:
        got = op2_chat(spark, folder).collect()
    except Exception:
        pytest.skip("no test data")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW conversations AS SELECT * FROM '{folder}/conversations.parquet'")
    want = sorted(c.execute(f"SELECT conv_id, n_turns, turns_sha256, loss_chars, loss_sha256 FROM ({OP2_SQL})").fetchall())
    assert sorted((r.conv_id, r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got) == want
    # what is formatted is at least all turns with their marks
    marks = len("<|im_start|>") + len("<|im_end|>") + 2
    least = dict(c.execute(f"SELECT conv_id, sum(length(coalesce(role, '')) + length(coalesce(text, '')) + {marks}) FROM conversations GROUP BY 1").fetchall())
    assert all(r.formatted_chars >= least[r.conv_id] for r in got if r.conv_id != -1)
