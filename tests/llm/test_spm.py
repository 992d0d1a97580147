"""The streaming search against the model's own library, a plain Viterbi and exact round trips."""

import random

import numpy as np
import pytest

from sitescan.llm.queries import MODEL
from sitescan.llm.spm import SPACE, Vocabulary, decode, encode

sentencepiece = pytest.importorskip("sentencepiece")


@pytest.fixture(scope="module")
def vocabulary():
    return Vocabulary.load(MODEL)


def texts():
    rnd = random.Random(5)
    alphabet = "abcdefghij thein     \n\té漢字😀.,!?0123"
    made = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 120))) for _ in range(300)]
    return [*made, "", " ", "a" * 5000, " " * 100, "the cat " * 900, "x▁y ▁"]


def test_ids_equal_the_library(vocabulary):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for t in texts():
        if SPACE not in t:
            assert np.frombuffer(vocabulary.encode(t), np.int32).tolist() == library.encode(t)


def test_pair_rule_equals_merging(vocabulary):
    for t in texts():
        vocabulary.encode(t)
    for key, stays in vocabulary.pairs.items():
        p, q = vocabulary.pieces[key >> 32], vocabulary.pieces[key & 0xFFFFFFFF]
        assert stays == (vocabulary.merged(p + q) == [p, q])


def test_unigram_equals_full_viterbi():
    rnd = random.Random(2)
    pieces = sorted({"".join(rnd.choice("ab▁") for _ in range(rnd.randint(1, 4))) for _ in range(40)} | set("ab▁"))
    scores = [-rnd.random() * len(p) for p in pieces]
    v = Vocabulary(["<u>", *[f"<{i}>" for i in range(256)], *pieces], [0.0] * 257 + scores, list(range(1, 257)), {0}, "unigram")
    for _ in range(50):
        t = "".join(rnd.choice("ab▁") for _ in range(200))
        best = [0.0] + [-1e18] * len(t)
        for end in range(1, len(t) + 1):
            best[end] = max(best[end - n] + v.scores[v.ids[t[end - n : end]]] for n in range(1, 5) if n <= end and t[end - n : end] in v.ids)
        got = list(v.search(t))
        assert "".join(v.pieces[i] for i in got) == t
        assert abs(sum(v.scores[i] for i in got) - best[-1]) < 1e-9


def test_round_trip_on_spark(spark):
    rows = [(i, t, "x") for i, t in enumerate([*texts(), None])]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = decode(encode(df, MODEL), MODEL).collect()
    assert len(out) == len(rows)
    assert all(r.decoded == (r.text or "") for r in out)
    assert decode(encode(df.limit(0), MODEL), MODEL).count() == 0
