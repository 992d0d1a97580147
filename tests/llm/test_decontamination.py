"""Containment against plain sets."""

import random

from sitescan.llm.common import words_of
from sitescan.llm.decontamination import contained_items, decontaminated


def shingled(text, k=5):
    w = words_of(text)
    return {tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def data():
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(4))
    items = [(i, " ".join(word() for _ in range(rnd.choice([5, 8, 12, 20, 40, 90, 300])))) for i in range(60)] + [(100, "two words"), (101, ""), (102, None)]
    docs = []
    for d in range(80):
        w = [word() for _ in range(rnd.choice([3, 50, 400, 3000]))]
        for _ in range(rnd.randint(0, 2)):
            part = rnd.choice(items[:60])[1].split()
            if rnd.random() < 0.5:
                cut = int(len(part) * rnd.uniform(0.6, 1))
                part = part[:cut]
            if rnd.random() < 0.3:
                part[rnd.randrange(len(part))] = word()
            at = rnd.randrange(len(w))
            w[at:at] = part
        docs.append((d, " ".join(w).upper() if d % 7 == 0 else "\n".join(w)))
    return docs + [(200, None), (201, ""), (202, "Two  WORDS"), (202, "Two  WORDS")], items


def test_pairs_equal_plain_sets(spark):
    docs, items = data()
    want = []
    for d, text in docs:
        s = shingled(text)
        for i, item in items:
            t = shingled(item)
            if t and 100 * len(s & t) >= 80 * len(t):
                want.append((d, i, len(t), len(s & t)))
    df = spark.createDataFrame([(d, t, 5) for d, t in docs], "doc_id long, text string, item_id int")
    it = spark.createDataFrame(items, "item_id long, text string")
    assert len(want) > 30
    assert sorted(tuple(r) for r in contained_items(df, it).collect()) == sorted(want)
    bad = {d for d, *_ in want}
    assert sorted(r.doc_id for r in decontaminated(df, it).collect()) == sorted(d for d, _ in docs if d not in bad)
    assert decontaminated(df, it).columns == df.columns
    assert contained_items(df.limit(0), it).count() == 0 and contained_items(df, it.limit(0)).count() == 0


def test_items_of_one_to_eight_shingles_are_never_missed(spark):
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(6))
    items = [(i, " ".join(word() for _ in range(5 + i // 100))) for i in range(800)]
    docs = []
    for i, text in items:
        w = [word() for _ in range(200)]
        at = rnd.randrange(200)
        docs.append((i, " ".join([*w[:at], text, *w[at:]])))
    got = contained_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(tuple(r) for r in got.collect()) == [(i, i, 1 + i // 100, 1 + i // 100) for i in range(800)]
