"""Signatures, links and groups against plain Python on small sets."""

import random
import re
import tracemalloc

import numpy as np

from sitescan.llm import near_dedup as nd


def plain_set(text, size):
    """Distinct runs of `size` words, as tuples; the whole sequence where there are fewer words."""
    lower = (text or "").translate({i: i + 32 for i in range(65, 91)})
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def grouped(rows, size, percent=80):
    """id -> (set size, smallest id reachable), by comparing all pairs."""
    sets = {i: plain_set(t, size) for i, t in rows}
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def rows():
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdefg") for _ in range(3))
    out, at = [], 0
    for _ in range(8):
        base = [word() for _ in range(60)]
        for edits in range(10):
            w = list(base)
            for _ in range(edits):
                w[rnd.randrange(60)] = word()
            out.append((at, " ".join(w)))
            at += 1
    out += [(at, ""), (at + 1, None), (at + 2, "one"), (at + 3, "ONE"), (at + 4, " \t\n"), (at + 5, "a b"), (at + 6, "b a"), (at + 7, "w " * 30000)]
    return out


def test_groups_equal_all_pairs(spark):
    data = rows()
    df = spark.createDataFrame([(i, t, -1) for i, t in data], "doc_id long, text string, rep int")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in nd.near_duplicates(df, shingle=2).collect()}
    assert got == grouped(data, 2)


def test_components_of_a_long_chain(spark):
    rnd = random.Random(2)
    ids = list(range(300))
    rnd.shuffle(ids)
    edges = [(a, b) for a, b in zip(ids, ids[1:], strict=False)] + [(1000, 1001), (5000, 5000)]
    got = {r.node: r.component for r in nd.components(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()}
    assert {i: got.get(i, i) for i in ids} == dict.fromkeys(ids, 0)
    assert got[1001] == 1000 and got.get(5000, 5000) == 5000


def test_signature_estimates_similarity():
    rng = np.random.default_rng(0)
    for j in (0.2, 0.5, 0.8):
        n = 500
        both = int(2 * n * j / (1 + j))
        pool = rng.integers(0, 2**63, 2 * n, dtype=np.uint64)
        a, b = pool[:n], np.concatenate([pool[:both], pool[n : 2 * n - both]])
        s = nd.super_minhash(np.concatenate([a, b]), np.repeat([0, 1], n), 2, 128)
        assert abs((s[0] == s[1]).mean() - j) < 0.13
    one = nd.super_minhash(np.array([7], np.uint64), np.array([0]), 1, 16)
    assert sorted((one[0] >> np.uint64(32)).tolist()) == list(range(16))


def test_bounds_between_groups_lose_no_pair(spark):
    data = [(i, t) for i, t in rows() if t and i < 80]
    sets = {i: nd.shingle_set(t, 2) for i, t in data}
    outlines = nd.outlines(spark.createDataFrame(data, "doc_id long, text string"), 2)
    left = outlines.selectExpr("1L as key", "rep", "rep as g", "n", "bits")
    got = {(r.a, r.b) for r in nd._between(left, 80).collect()}
    for a in sets:
        for b in sets:
            both = len(np.intersect1d(sets[a], sets[b]))
            if a > b and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                assert (a, b) in got


def test_a_set_of_millions_is_signed_in_bounded_memory():
    rng = np.random.default_rng(1)
    elements = np.unique(rng.integers(0, 2**63, 3_000_000, dtype=np.uint64))
    tracemalloc.start()
    sig = nd.super_minhash(elements, np.zeros(len(elements), np.int64), 1)
    assert tracemalloc.get_traced_memory()[1] < 60e6
    tracemalloc.stop()
    # the same as over parts, slot by slot the least
    parts = [nd.super_minhash(p, np.zeros(len(p), np.int64), 1) for p in (elements[:50_000], elements[50_000:200_000], elements[200_000:])]
    assert (sig == np.minimum.reduce(parts)).all()


def test_rows_of_one_document_and_the_ones_that_stay(spark):
    base = " ".join(f"w{i}" for i in range(40))
    rows = [(3, base, "a", 1), (3, base, "a", 1), (3, "other text of this very document here", "b", 2), (1, base + " end", "c", 3), (2, None, "d", 4), (None, base, "e", 5), (7, "", "f", 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, rep string, kept int")
    got = nd.deduplicated(df)
    assert got.columns == df.columns
    assert sorted((str(r.doc_id), r.rep) for r in got.collect()) == [("1", "c"), ("2", "d"), ("7", "f"), ("None", "e")]
    twice = spark.createDataFrame([(1, "b b", "x", 1), (1, "a a", "y", 2), (1, "a a", "y", 2)], df.schema)
    assert [r.text for r in nd.deduplicated(twice).collect()] == ["a a"]


def test_empty_and_null_ids(spark):
    assert nd.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    got = nd.near_duplicates(spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f")], "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.kept) for r in got) == [("1", True), ("1", True), ("None", True)]
