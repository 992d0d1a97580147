"""Winnowing against a plain Python version; neighbours against a sorted list."""

import hashlib
import random
import re
import struct

import pytest
import xxhash

from sitescan.llm import fingerprints
from sitescan.llm.fingerprints import edited_fingerprints, marks, winnow


def rows():
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcdeé漢") for _ in range(rnd.randint(1, 9)))
    texts = [" ".join(word() for _ in range(rnd.randint(0, 60))) for _ in range(60)]
    texts += ["", None, " \n\t", "x", "word " * 3000, texts[0], texts[0]]
    ids = rnd.sample(range(-500, 900), len(texts))
    return list(zip(ids, texts, strict=True))


def test_selection_is_minimum_of_each_window(spark):
    df = winnow(spark.createDataFrame(rows(), "doc_id long, text string"), "text", "m", k=1, window=5)
    df = winnow(df, "text", "all", k=1, window=1)
    for r in df.select(marks(df["m"]).alias("m"), marks(df["all"]).alias("all")).collect():
        values = [x.hash for x in sorted(r["all"], key=lambda x: x.pos)]
        want = []
        for at in range(max(1, len(values) - 4) if values else 0):
            part = values[at : at + 5]
            pick = at + max(i for i, v in enumerate(part) if v == min(part))
            if pick not in want:
                want.append(pick)
        assert [(x.pos, x.hash) for x in r["m"]] == [(i, values[i]) for i in want]


def test_next_and_edited(spark):
    data = rows()
    df = spark.createDataFrame([(i, t, t) for i, t in data], "doc_id long, text string, next string")
    got = {r.doc_id: r for r in edited_fingerprints(df).collect()}
    assert len(got) == len(data)
    order = sorted((i, t or "") for i, t in data)
    seen = {}
    for at, (i, t) in enumerate(order):
        after = order[(at + 1) % len(order)][1]
        q = len(t) // 4
        edited = t[: len(t) - q] + after[:q]
        assert got[i].n_chars == len(t)
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert seen.setdefault(t, got[i].fingerprint) == got[i].fingerprint
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
        if edited == t:
            assert got[i].near_edited == 1


def test_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert edited_fingerprints(empty).count() == 0
    one = edited_fingerprints(spark.createDataFrame([(7, "a b c d e f")], "doc_id long, text string")).collect()
    assert one[0].near_next == 1
    odd = spark.createDataFrame([(None, "a"), (1, None), (1, "b"), (1, "b")], "doc_id long, text string")
    assert edited_fingerprints(odd).count() == 4


def plain(text, k=4, window=4):
    """Selected (hash, position) of a text: a hash that rolls, and the rightmost smallest of each window."""
    tokens = [xxhash.xxh64(t.encode(), seed=42).intdigest() & 1073741823 for t in re.findall(r"[^\x20\x09-\x0D]{1,4}", text.lower())]
    if not tokens:
        return []
    if len(tokens) < k:
        h = 42
        for t in tokens:
            h = xxhash.xxh64(struct.pack("<q", t), seed=h).intdigest()
        return [(h & (2**31 - 1), 0)]
    prime, base, h, hashes = 2**31 - 1, 1_000_003, 0, []
    for i, t in enumerate(tokens):
        h = (h * base + t - (tokens[i - k] * pow(base, k, prime) if i >= k else 0)) % prime
        if i >= k - 1:
            hashes.append(h)
    out = []
    for at in range(max(1, len(hashes) - window + 1)):
        part = hashes[at : at + window]
        pick = at + max(i for i, v in enumerate(part) if v == min(part))
        if not out or out[-1][1] != pick:
            out.append((hashes[pick], pick))
    return out


def alike(a, b):
    a, b = {h for h, _ in a}, {h for h, _ in b}
    return len(a & b) / len(a | b) if a | b else 1.0


def test_given_documents_against_plain_python(spark):
    try:
        docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    except Exception:
        pytest.skip("no test data")
    rows = sorted((r.doc_id, r.text or "") for r in docs.collect())
    got = {r.doc_id: r for r in edited_fingerprints(docs).collect()}
    assert len(got) == len(rows)
    made = [plain(t) for _, t in rows]
    for at, (i, t) in enumerate(rows):
        after, q = rows[(at + 1) % len(rows)][1], len(t) // 4
        edited = plain(t[: len(t) - q] + after[:q])
        r = got[i]
        assert r.fingerprint == "".join(f"{h:08X}" for h, _ in made[at]) and r.positions == [p for _, p in made[at]]
        assert r.edited_fingerprint == "".join(f"{h:08X}" for h, _ in edited)
        assert abs(r.near_edited - alike(made[at], edited)) < 1e-12 and abs(r.near_next - alike(made[at], made[(at + 1) % len(rows)])) < 1e-12


def test_neighbours_of_odd_ids(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "_SPAN", 4)
    rnd = random.Random(6)
    for ids in (
        [rnd.randrange(-(2**63), 2**63) for _ in range(300)],
        [*range(250), 2**62, -(2**63), 2**63 - 1],
        [5] * 200 + list(range(100)),
        [None] * 150 + [2**63 - 1] * 20,
        [(shard << 33) + n for shard in range(5) for n in range(60)] + [2**62 + n for n in range(40)],
    ):
        rows = [(i, f"{at:03d} " + "x" * (at % 9)) for at, i in enumerate(ids)]
        df = spark.createDataFrame(rows, "doc_id long, text string")
        beside, order = fingerprints.beside_next(df)
        from pyspark.sql import functions as F

        got = beside.withColumn("next", F.lead("text").over(order)).filter("guest = 0").select("doc_id", "text", "next").collect()
        assert len(got) == len(rows)
        # in a circle through all rows, by id
        after = {(r.doc_id, r.text): r.next for r in got}
        owner = {t: i for i, t in rows}
        at, seen = rows[0][1], []
        for _ in rows:
            seen.append(at)
            at = after[owner[at], at]
        assert at == rows[0][1] and len(set(seen)) == len(rows)
        low = [-(2**63) - 1 if owner[t] is None else owner[t] for t in seen]
        assert sum(a > b for a, b in zip(low, [*low[1:], low[0]], strict=True)) <= 1


def test_buckets_stay_small(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(fingerprints, "_CELLS", 4)
    monkeypatch.setattr(fingerprints, "_SPAN", 16)
    n = F.col("id")
    for ids in (n, F.xxhash64(n), F.shiftleft(n % 40, 33) + n, F.lit(None).cast("long"), F.when(n % 2 == 0, 7).otherwise(n), F.shiftleft(n % 3, 60) + F.shiftleft(n % 7, 30) + n):
        docs = spark.range(0, 6000, 1, 4).select(ids.alias("doc_id"), F.concat(F.lit("text "), (n % 4000).cast("string")).alias("text"))
        beside, _ = fingerprints.beside_next(docs)
        assert beside.groupBy("bucket").count().agg(F.max("count")).first()[0] <= 4 * 16 + 2


def test_many_equal_rows(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(fingerprints, "_SPAN", 16)
    same = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("one and the same").alias("text"))
    other = spark.range(50).select("id", F.concat(F.lit("other "), F.col("id").cast("string")).alias("text"))
    beside, order = fingerprints.beside_next(same.union(other))
    assert beside.groupBy("bucket").count().agg(F.max("count")).first()[0] <= 4 * 16 + 2
    got = beside.withColumn("next", F.lead("text").over(order)).filter("guest = 0").groupBy("text", "next").count().collect()
    after = {(r.text, r.next): r["count"] for r in got}
    assert after["one and the same", "one and the same"] == 2999 and after["one and the same", "other 0"] == 1 and after["other 49", "one and the same"] == 1
    assert sum(after.values()) == 3050
