"""The five stages against plain Python on a small corpus."""

import hashlib
import os

import numpy as np
import pandas as pd
import pytest

pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_on_a_small_corpus(spark, tmp_path):
    from test_near_dedup import grouped

    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 5))
    key = hashlib.sha1(b"k").hexdigest()
    rows, good = [], {}
    item = " ".join(word() for _ in range(20))
    for i in range(120):
        text = " ".join(word() for _ in range(40))
        if i % 10 == 3:
            text = "BUY!! NOW!! $$$ ### " * 12
        elif i % 10 == 4:
            text = text + " " + item
        elif i % 10 == 5:
            text = rows[i - 4][1] + " more"
        elif i % 10 == 6:
            text = text + f' token = "{key}" end'
        rows.append((i, text, "en", f"s{i % 4}", len(text)))
        good[i] = i % 10 != 3
    d = str(tmp_path)
    pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source", "n_chars"]).to_parquet(f"{d}/documents.parquet")
    pd.DataFrame({"doc_id": range(90), "quality": [int(good[i]) for i in range(90)], "toxic": 0}).to_parquet(f"{d}/labels.parquet")
    pd.DataFrame({"item_id": [0], "text": [item]}).to_parquet(f"{d}/benchmark.parquet")
    want = [(i, t) for i, t, *_ in rows if good[i]]
    groups = grouped(want, 5)
    want = {i: t.replace(key, "<secret>") for i, t in want if groups[i][1] == i and item not in t}
    got = {r.doc_id: r for r in pipeline.run(spark, f"file://{d}").collect()}
    assert set(got) == set(want)
    assert all(got[i].exact and got[i].text_sha256 == hashlib.sha256(t.encode()).hexdigest() for i, t in want.items())
    assert [n for n, _ in pipeline.STAGES][0] == "quality classifier" and os.path.isdir(d)


def test_stages_take_odd_rows_and_clashing_columns(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, keep string, p_doc int, ids string, decoded string, _c string, kept boolean, rep long, site string, path string"
    more = (1.5, "k", 3, "i", "d", "c", True, 9, "s", "p")
    good = " ".join(f"word{i % 7} stone{i}" for i in range(30))
    rows = [(None, None, None, None, None, *more), (1, "", None, "s", 0, *more), (2, good, "en", None, 5, *more), (2, good, "en", None, 5, *more), (3, good + " end", "en", "s", 1, *more), (4, None, "en", "s", None, *more), (5, "long " * 60_000, None, None, 7, *(None,) * 10)]
    d = str(tmp_path)
    pd.DataFrame({"doc_id": [1, 2, None, 2], "quality": [1, 1, 0, None], "toxic": [0, None, 1, 0]}).astype("Int64").to_parquet(f"{d}/labels.parquet")
    pd.DataFrame({"item_id": [None, 1, 2], "text": [None, "", "one two three four five six"]}).astype({"item_id": "Int64"}).to_parquet(f"{d}/benchmark.parquet")
    docs = spark.createDataFrame(rows, schema)
    for at, (name, stage) in enumerate(pipeline.STAGES[:-1]):
        kept = stage(spark, docs, f"file://{d}")
        assert kept.columns == docs.columns and kept.dtypes == docs.dtypes, name
        kept.write.parquet(f"file://{d}/{at}")
        docs = spark.read.parquet(f"file://{d}/{at}")
        got = sorted(((r.doc_id, r.n_chars, r.keep) for r in docs.collect()), key=str)
        want = [(1, 0, "k"), (2, 5, "k"), (2, 5, "k"), (3, 1, "k"), (4, None, "k"), (5, 7, None), (None, None, "k")]
        assert got == (want if name == "quality classifier" else [w for i, w in enumerate(want) if i not in (2, 3)]), name
    out = pipeline.STAGES[-1][1](spark, docs, f"file://{d}").collect()
    assert len(out) == 5 and all(r.exact for r in out)
    for name, stage in pipeline.STAGES:
        assert stage(spark, spark.createDataFrame([], schema), f"file://{d}").count() == 0, name
