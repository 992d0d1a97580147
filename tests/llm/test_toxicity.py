"""Decoding of hidden words, and held-out accuracy on a small corpus."""

import random

import numpy as np

from sitescan.llm import toxicity as tx

LEXICON = ["idiot", "moron", "stupid", "trash"]
PLAIN = "the and of table river green window letter music morning paper stone garden".split()


def corpus():
    rnd = random.Random(8)
    hide = {"i": "1", "o": "0", "a": "4", "s": "$"}
    docs, labels = [], []
    for i in range(600):
        words = [rnd.choice(PLAIN) for _ in range(rnd.randint(5, 40))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(3):
                w = rnd.choice(LEXICON)
                kind = rnd.random()
                w = "".join(hide.get(c, c) for c in w) if kind < 0.3 else " ".join(w) if kind < 0.5 else w
                words.insert(rnd.randrange(len(words)), w)
        docs.append((i, " ".join(words), "en"))
        labels.append((i, 1, int(toxic)))
    return docs, labels


def test_restores_words(spark):
    docs, _ = corpus()
    reader = tx.Reader(tx.log_model(tx.trigram_counts(spark.createDataFrame(docs, "doc_id long, text string, lang string"))))
    assert {"idiot", "moron", "stupid", "trash"} <= reader.words("1d10t m.o.r.o.n $tuupid t r a s h")
    assert reader.words("the river 2024 of") == {"the", "river", "2024", "of"}
    assert reader.words(None) == reader.words("") == set()
    assert reader.restored("the 1d10t!!") == "the idiot"


def test_viterbi_equals_all_readings():
    rng = np.random.default_rng(0)
    model = np.log(rng.dirichlet(np.ones(29), (29, 29)))
    decoder = tx.Decoder(model)
    for token in ("1d10t", "a.b", "s$5", "oo0", "x y z"):
        paths = [(0.0, (0, 0), "")]
        for i in range(len(token)):
            paths = [(p + q + (model[s[0], s[1], c] if c >= 0 else 0), s if c < 0 else (s[1], c), t + x) for p, s, t in paths for x, c, q in decoder.options(token, i) if not (c == 0 and s[1] == 0)]
        best = max((p + model[s[0], s[1], 0], t) for p, s, t in paths)[1]
        assert decoder.read(token) == best.split()


def test_held_out_accuracy_and_edges(spark):
    docs, labels = corpus()
    df = spark.createDataFrame([*docs, (900, None, "en"), (901, "", "en"), (902, "idiot " * 20000, "en")], "doc_id long, text string, lang string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in tx.scored(df, lab).collect()}
    assert len(got) == 603
    held = [i for i, *_ in docs if got[i].held_out]
    assert 150 < len(held) < 250
    assert sum(got[i].predicted == labels[i][2] for i in held) >= 0.97 * len(held)
    assert got[900].predicted == got[901].predicted == 0 and got[902].predicted == 1
    none = tx.scored(df, lab.filter("toxic = 0")).collect()
    assert all(r.predicted == 0 for r in none)


def test_restores_spaced_words_with_repeats_and_chunks(spark):
    docs, _ = corpus()
    reader = tx.Reader(tx.log_model(tx.trigram_counts(spark.createDataFrame(docs, "doc_id long, text string, lang string"))))
    assert "stupid" in reader.words("the s t u u u p i d river") and "stupid" in reader.words("s t u u u u u u p i d")
    assert "idiot" in reader.words("the id iot river") and "idiot" in reader.words("i d iot")
    assert "of" in reader.words("river o f table")
    assert reader.restored("the t r a s h table") == "the trash table"
    assert reader.restored("river s t u u u p i d window") == "river stupid window"


def test_one_double_letter_equals_the_search():
    rng = np.random.default_rng(1)
    decoder = tx.Decoder(np.log(rng.dirichlet(np.ones(29), (29, 29)) + 1e-4))
    hit = 0
    for _ in range(400):
        word = "".join(rng.choice(list("abcdé"), rng.integers(2, 9)))
        if tx._DOUBLE.search(word) and (one := decoder.one_double(word)) is not None:
            assert [one] == decoder.read(word), word
            hit += 1
    assert hit > 100 and decoder.one_double("aaa") is None and decoder.one_double("aabb") is None


def test_clashing_columns(spark):
    docs, labels = corpus()
    df = spark.createDataFrame([(i, t, "x", 7, 8.0) for i, t, _ in docs[:60]], "doc_id long, text string, words string, fold int, score double")
    lab = spark.createDataFrame([(*r, "t") for r in labels[:60]], "doc_id long, quality int, toxic int, text string")
    got = tx.scored(df, lab)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"] and got.count() == 60
    assert tx.scored(df.limit(0), lab).count() == 0


def odd_texts():
    rnd = random.Random(4)
    letters = "abiIoößÉİΣ 1034$@!.,()«»\n\t| *é́"
    some = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 60))) for _ in range(400)]
    return [*some, None, "", "  ", "a", "a b", "aa", "a a a a a", "...", "$$$ $$$", "x", "y z", "the id iot of", "d"]


def one_by_one(decoder, text):
    """The words of a text, each token, run and chunk by itself."""
    tokens = tx.unicodedata.normalize("NFC", (text or "").lower()).split()
    out = set()
    for i in range(len(tokens)):
        for k in (1, 2, 3):
            part = tokens[i : i + k]
            if len(part) == k and (k == 1 or (max(map(len, part)) <= 3 and sum(map(len, part)) > 3)):
                plain = tx.trimmed("".join(part))
                out.update(decoder.read(plain) if tx.doubtful(plain) else [plain] if plain else [])
    for run in tx.spaced_runs(tokens):
        if len(run) > 1:
            run = tx._LONG.sub(r"\1 \1", " ".join(run))
            out.update(decoder.read(run) if any(c.isalpha() for c in run) else run.split())
    return out


def test_texts_read_together_equal_tokens_read_one_by_one():
    model = np.log(np.random.default_rng(2).dirichlet(np.ones(29), (29, 29)) + 1e-4)
    reader, texts = tx.Reader(model), odd_texts()
    text, word, words = reader.words_of(texts)
    words, got = words.to_pylist(), [set() for _ in texts]
    for t, w in zip(text.tolist(), word.tolist(), strict=True):
        got[t].add(words[w])
    expected = [one_by_one(reader.decoder, t) for t in texts]
    assert got == expected == [reader.words(t) for t in texts]
    assert len(words) == len(set(words)) and all(words)


def test_tokens_that_read_as_themselves_are_not_settled_one_by_one(monkeypatch):
    asked, token = [], tx.Reader.token
    monkeypatch.setattr(tx.Reader, "token", lambda self, t: asked.append(t) or token(self, t))
    reader = tx.Reader(np.log(np.random.default_rng(3).dirichlet(np.ones(29), (29, 29))))
    assert reader.words(" ".join(PLAIN)) >= {w for w in PLAIN if not tx._DOUBLE.search(w)}
    assert sorted(asked) == sorted(w for w in PLAIN if tx._DOUBLE.search(w))


def test_evidence_of_words_equals_a_walk_from_special_to_general():
    rnd = random.Random(5)
    words = sorted({"".join(rnd.choice("ab$é") for _ in range(rnd.randint(1, 9))) for _ in range(600)})
    sets = [rnd.sample(words, 12) for _ in range(200)]
    seen = tx.Counter(f for s in sets for f in {f for w in s for f in tx.features(w)})
    keys = sorted(k for k, c in seen.items() if c >= 3)
    toxic = np.array([rnd.randint(0, seen[k]) for k in keys], float)
    evidence = tx.Evidence(keys, toxic, np.array([seen[k] for k in keys], float), 0.1)
    value = dict(zip(keys, evidence.value.tolist(), strict=False))
    walk = {w: next((value[f] for f in reversed(tx.features(w)) if f in value), 0.0) for w in words}
    got = evidence.of(tx.pa.array(words))
    assert got.tolist() == [walk[w] for w in words] and 0 < np.count_nonzero(got) < len(words)

    # the second text has each word twice, the last has none
    text = np.repeat(np.arange(len(sets) + 1), [24 if i == 1 else 12 for i in range(len(sets))] + [0])
    word = np.array([words.index(w) for i, s in enumerate(sets) for w in (s * 2 if i == 1 else s)])
    x = tx.strongest(text, word, got[word], len(sets) + 1)
    for s, row in zip([*sets, []], x.tolist(), strict=True):
        top = sorted((walk[w] for w in s), reverse=True) + [0.0] * 3
        assert row == [top[0], top[1] + top[2], float(np.log1p(sum(v > 2 for v in top)))]
    assert not tx.Evidence([], np.zeros(0), np.zeros(0), 0.1).of(tx.pa.array(words)).any()


def test_trigrams_of_many_texts_equal_those_of_each(spark):
    texts = odd_texts()
    code = {" ": 0, **tx._CODE}
    expected = np.zeros((29, 29, 29))
    for t in texts:
        if t:
            raw = (" " + t.lower() + " ").encode()
            s = [27 if b > 127 else 0 if chr(b).isspace() else code.get(chr(b), 28) for b in raw]
            for a in zip(s, s[1:], s[2:]):
                expected[a] += 28 not in a
    assert np.array_equal(tx.trigram_counts(spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)), expected)
