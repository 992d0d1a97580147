"""License scans against plain searches and DuckDB."""

import random
import re

import duckdb
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from sitescan.llm import licenses as L

SCHEMA = "doc_id long, text string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SMALL = {c: c + 32 for c in range(65, 91)}


def plain(text):
    """n_words, n_base, first_word, last_word, base_labels by comparing every run of words."""
    words, hits = WORD.findall((text or "").translate(SMALL)), []
    for phrase, label in L.BASE.items():
        p = phrase.split()
        hits += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    return len(words), len(hits), min((i for i, _ in hits), default=None), max((i for i, _ in hits), default=None), ",".join(sorted({x for _, x in hits}))


def kept(rules, hits):
    """Detections that no other contains, by all pairs."""
    rank = lambda h: (-L.KINDS[rules[h[0]].kind][0], h[1] - h[2], h[0], h[1])
    return {h for h in hits if rules[h[0]].kind == "base" or not any(o[1] <= h[1] and h[2] <= o[2] and rank(o) < rank(h) for o in hits)}


def odd():
    long = "Lorem ipsum é " * 90_000
    return [
        (1, None), (2, ""), (3, " \t-- \x00"), (4, "Released UNDER THE MIT LICENSE."), (5, "under the mit\nlicense under-the--mit license, cc by-nc CC BY NC 4.0"),
        (6, "apache license version 2.0"), (7, "apache license version 20"), (8, "xunder the mit license"), (9, "under the mit licenseé under the mit license\u00a0x"),
        (10, long + "Cc-By_nc"), (10, long + "Cc-By_nc"), (None, "Apache License, Version 2"), (11, "ÉCC by nc cc by nc"), (12, "cc by nc " * 3000), (13, "under the mit licenſe K"),
    ]


@pytest.fixture(scope="module")
def rules():
    return L.all_rules()


def test_rules_are_many_and_gated_by_what_they_hold(rules):
    assert len(rules) > 400 and len({r[:3] for r in rules}) == len(rules)
    assert all(r.kind in L.KINDS and all(" ".join(k.split()) == k for k in r.keywords) for r in rules)


@settings(max_examples=300, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.data())
def test_what_a_rule_matches_passes_its_gate(data):
    rules = L.scanner().rules
    i = data.draw(st.integers(0, len(rules) - 1))
    text = data.draw(st.from_regex(re.compile(rules[i].pattern), fullmatch=True))
    n, hits = L.scanner().scan("see " + text + " end")
    assert i in {h[0] for h in hits} and hits == L.scanner().scan("see " + text + " end", gated=False)[1]


def test_every_rule_has_an_example_that_it_finds(rules):
    for i, r in enumerate(rules):
        said = re.sub(r"\(\?:([^()|]*)[^()]*\)\??", r"\1", re.sub(r"\(\?:([^()|]*)[^()]*\)\??", r"\1", r.pattern))
        said = re.sub(r"\[.*?\](?:\{[\d,]+\}\??)?", lambda m: m[0][1] * int((re.search(r"\{(\d+)", m[0]) or [0, 1])[1]), said)
        said = said.replace("?", "").split("|")[0]
        assert i in {h[0] for h in L.scanner().scan(said)[1]}, (r, said)


def test_suppression_is_that_of_all_pairs(rules):
    rnd = random.Random(7)
    bits = ["under the", "mit license", "licensed under the", "apache license version 2 0", "cc by nc", "cc by nc sa 4 0", "gnu general public license", "version 2 or later", "all rights reserved", "creative commons attribution", "noncommercial", "word", "the mit license mit", "bsd", "3 clause", "license"]
    s = L.scanner()
    for _ in range(200):
        text = " ".join(rnd.choice(bits) for _ in range(rnd.randint(1, 30)))
        hits = s.scan(text)[1]
        assert hits == s.scan(text, gated=False)[1]
        assert {h[:3] for h in hits if h[3]} == {h[:3] for h in kept(rules, hits)}


def test_labels_of_known_texts():
    labels = lambda text: {L.scanner().rules[r].label for r, _, _, k in L.scanner().scan(text)[1] if k}
    assert labels("SPDX-License-Identifier: Apache-2.0") == {"apache-2"}
    assert labels("SPDX-License-Identifier: ISC") == {"isc"}
    assert labels("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.") == {"gpl", "gpl-3-or-later"}
    assert labels("Creative Commons Attribution-ShareAlike 4.0 International License") == {"cc-by-sa-4"}
    assert labels("Distributed under the GNU Lesser General Public License v2.1") == {"lgpl-2.1"}
    assert labels("A plain text about apache helicopters, a license plate and the mit campus") == set()


def test_against_plain_words(spark):
    rows = odd()
    got = L.license_report(spark.createDataFrame(rows, SCHEMA)).collect()
    key = lambda r: (str(r[0]), *map(str, r[1:6]))
    assert sorted(map(key, got)) == sorted(map(key, [(i, *plain(t)) for i, t in rows]))
    for r in got:
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
        assert r.labels == ",".join(sorted(set(r.labels.split(",")))) and (r.score > 0) == bool(r.labels)


def test_base_columns_on_given_documents(spark):
    path = "/root/testdata/sf0.01/documents.parquet"
    got = sorted(tuple(r)[:6] for r in L.license_report(spark.read.parquet(path)).collect())
    phrases = " UNION ALL ".join(f"SELECT doc_id, '{label}' AS label, i - 1 AS place FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM words) WHERE w[i : i + {len(p.split()) - 1}] = {p.split()}" for p, label in L.BASE.items())
    want = duckdb.sql(f"""
      WITH words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM '{path}'),
      hits AS ({phrases})
      SELECT doc_id, len(w), count(label), min(place), max(place), coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') FROM words LEFT JOIN hits USING (doc_id) GROUP BY doc_id, w ORDER BY doc_id""").fetchall()
    assert got == want


def test_empty_table_and_clashing_names(spark):
    assert L.license_report(spark.createDataFrame([], SCHEMA)).count() == 0
    df = spark.createDataFrame([(1, "cc by nc", 5, "x")], SCHEMA + ", found int, labels string")
    assert L.license_report(df).first().labels == "cc-by-nc"
    out = L.scanned(df, into="hits")
    assert out.columns == [*df.columns, "hits"] and out.first().hits.n_words == 3
