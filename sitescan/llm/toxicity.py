"""Toxicity of texts that hide their words: a noisy-channel decoder in front of a word-evidence classifier.

Channel: a writer meant plain letters and wrote look-alikes (1 for i or l, $ for s), put punctuation or spaces between letters,
or repeated them. A token's characters form a lattice of what each may stand for; Viterbi search under a character
trigram model, whose counts come from all words of the corpus, picks the likeliest reading. A token whose lattice has one
path only (plain letters without repeats) is its own reading, and one of plain letters with one double letter has two readings, which
differ in a few trigrams; all others are searched, each once as long as it is remembered. Runs of
two and more one-character tokens are read as one lattice, in which a letter repeated over spaces may be dropped; two and
three neighbouring tokens of up to three characters are also read as one word. The tokens of all texts of a batch are numbered
and settled together: those that are their own reading as arrays, the others one by one.

Classifier: toxic documents are marked by words, and by words of the same beginning. The share of toxic documents among
those that have a word is shrunk towards that of its 7-, 6- and 5-letter beginnings and at last the base rate; a
document's evidence is the strongest log-odds of its words. A logistic curve over that evidence, fitted on documents left out
of the counts, gives the score. Only (id, text) of documents and the toxic label of training rows are read.

Null and empty texts have no evidence and get the curve's base score. With one class of labels only, or none, all scores are the
base rate. Repeated rows are scored row by row; no rows give none. Only doc_id and text of the documents and doc_id and toxic of the labels are
read, so other columns may have any name. At most `most_labelled` rows are used for training, chosen by hash; their texts are
decoded once, and the restored words written. Features of less than `least_toxic` toxic documents are not counted.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, crc_fold, logistic_fit, slices, small_batches

#: What a written character may stand for.
LOOKALIKES = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "*": "aeiou"}
#: Log probabilities of the channel: look-alike, dropped mark, dropped repeat, dropped space, space as word border.
_LIKE, _MARK, _REPEAT, _JOIN, _BORDER = -1.2, -1.5, -3.0, -1.0, -0.7
_TAIL = ".,;:!?\"')]}»…"
_AROUND = _TAIL + "([{«"
_ROWS = 4096  # texts of a slice of a batch; bytes bound it first, unless texts are short
_N = 29  # border, a to z, other letters, digits and marks
_CODE = {c: i + 1 for i, c in enumerate("abcdefghijklmnopqrstuvwxyz")}
_TABLE = bytes(i - 96 if 97 <= i <= 122 else 0 if i in (9, 10, 11, 12, 13, 32) else 27 if i > 127 else 28 for i in range(256))
_CACHE = 200_000
_DOUBLE = re.compile(r"(.)\1")
_LONG = re.compile(r"(\S)(?: \1){2,}(?=\s|\Z)")


def trigram_counts(docs: DataFrame) -> np.ndarray:
    """Counts of all character trigrams (border, a-z, other letters) over all words of all texts: 29^3 numbers, whatever the corpus.

    Trigrams with digits or marks are left out: the model is of what writers mean, not of how they hide it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_N**3, np.int64)
        for batch in slices(batches, 0, _ROWS):
            # the mark between two texts stands in all trigrams that reach from one into the other
            texts = "0".join(f" {t.lower()} " for t in batch.column(0).to_pylist() if t)
            s = np.frombuffer(texts.encode("utf-8", "replace").translate(_TABLE), np.uint8).astype(np.int32)
            total += np.bincount(s[:-2] * (_N * _N) + s[1:-1] * _N + s[2:], minlength=_N**3)
            cube = total.reshape(_N, _N, _N)
            cube[28] = cube[:, 28] = cube[:, :, 28] = 0
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["k", "c"])

    out = np.zeros(_N**3)
    for k, c in docs.select(F.col("text").cast("string")).mapInArrow(run, "k long, c long").groupBy("k").agg(F.sum("c")).collect():
        out[k] = c
    return out.reshape(_N, _N, _N)


def log_model(counts: np.ndarray) -> np.ndarray:
    """log P(c | a, b), interpolated with the bigram and a uniform share."""
    two = counts.sum(0)
    p2 = (two + 0.5) / (two.sum(1, keepdims=True) + 0.5 * _N)
    return np.log((counts + 4 * p2[None]) / (counts.sum(2, keepdims=True) + 4))


class Decoder:
    """The likeliest reading of tokens."""

    def __init__(self, model: np.ndarray):
        self.model = model.tolist()

    def options(self, token: str, i: int) -> list[tuple[str, int, float]]:
        """(letters read, code, log probability) of character i; code -1: dropped."""
        c = token[i]
        if c == " ":
            return [("", -1, _JOIN), (" ", 0, _BORDER)]
        code = _CODE.get(c)
        if code or c.isalpha():
            out = [(c, code or 27, 0.0)]
            if (i and token[i - 1] == c) or (i > 1 and token[i - 1] == " " and token[i - 2] == c):
                out.append(("", -1, _REPEAT))
            return out
        out = [(x, _CODE[x], _LIKE) for x in LOOKALIKES.get(c, "")]
        if c.isdigit():
            out.append((c, 28, 0.0))
            if i and token[i - 1] == c:
                out.append(("", -1, _REPEAT))
        else:
            out.append(("", -1, _MARK if i == 0 or token[i - 1] != c else 0.0))
        return out

    def one_double(self, token: str) -> str | None:
        """`read` for plain letters of which two equal ones stand together in one place: compares the trigrams that differ."""
        m = _DOUBLE.search(token)
        i = m.end()
        if token[i : i + 1] == token[i - 1] or _DOUBLE.search(token, i):
            return None
        code = [_CODE.get(c, 27) for c in token[max(0, i - 3) : i + 1]]
        before, at, after = code[0] if i > 2 else 0, code[1 if i > 2 else 0], code[-1] if i < len(token) else 0
        both = self.model[before][at][at] + self.model[at][at][after]
        one = self.model[before][at][after] + _REPEAT
        return token if both >= one else token[: i - 1] + token[i:]

    def read(self, token: str) -> list[str]:
        """The words of a lower-case token or of a run of spaced letters, by Viterbi search over (last two codes)."""
        model = self.model
        states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
        for i in range(len(token)):
            new: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for letters, code, p in self.options(token, i):
                for (a, b), (score, path) in states.items():
                    if code < 0:
                        key, s, way = (a, b), score + p, path
                    elif code == 0 and b == 0:
                        continue
                    else:
                        key, s, way = (b, code), score + p + model[a][b][code], (path, letters)
                    if key not in new or s > new[key][0]:
                        new[key] = (s, way)
            states = new
        best = max(((s + model[a][b][0], path) for (a, b), (s, path) in states.items()), key=lambda x: x[0])[1]
        out = []
        while best is not None:
            best, letters = best
            out.append(letters)
        return "".join(reversed(out)).split()


def doubtful(token: str) -> bool:
    if token.isalpha():
        return _DOUBLE.search(token) is not None
    return any(c.isalpha() for c in token)


def trimmed(token: str) -> str:
    """Without quotes and punctuation around it and without runs of one mark at its end."""
    token = token.strip(_AROUND)
    while len(token) > 2 and token[-1] == token[-2] and not token[-1].isalnum():
        token = token.rstrip(token[-1])
    return token.strip(_TAIL)


def spaced_runs(tokens: list[str]) -> Iterator[list[str]]:
    """The runs of one-character tokens, and all other tokens, each alone."""
    run: list[str] = []
    for t in tokens:
        if len(t) == 1:
            run.append(t)
            continue
        if run:
            yield run
            run = []
        yield [t]
    if run:
        yield run


def joined(tokens: list[str], text: np.ndarray) -> tuple[list[str], np.ndarray]:
    """What neighbouring tokens of a text may be together, and the number of that text: runs of two and more one-character tokens, with
    their spaces, three and more equal characters in a row written as two; and two and three tokens of up to three characters, put together."""
    n = np.fromiter(map(len, tokens), np.int32, len(tokens))
    same = text[:-1] == text[1:]
    two = (n[:-1] <= 3) & (n[1:] <= 3) & same
    at2 = np.flatnonzero(two & (n[:-1] + n[1:] > 3))
    at3 = np.flatnonzero(two[:-1] & two[1:] & (n[:-2] + n[1:-1] + n[2:] > 3))
    # pairs of neighbours inside a run, and where they begin and end
    edge = np.flatnonzero(np.diff(np.concatenate([[False], (n[:-1] == 1) & (n[1:] == 1) & same, [False]]).astype(np.int8)))
    out = [tokens[i] + tokens[i + 1] for i in at2.tolist()]
    out += [tokens[i] + tokens[i + 1] + tokens[i + 2] for i in at3.tolist()]
    out += [_LONG.sub(r"\1 \1", " ".join(tokens[a : b + 1])) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)]
    return out, text[np.concatenate([at2, at3, edge[::2]])]


def numbered(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """All tokens, runs and chunks of texts: the numbers of their texts and their own, and what they are."""
    tokens, found, n = [], [], np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        found = unicodedata.normalize("NFC", (t or "").lower()).split()
        tokens += found
        n[i] = len(found)
    text = np.repeat(np.arange(len(texts)), n)
    del found
    more, of = joined(tokens, text)
    tokens += more
    coded = pa.array(tokens, pa.string()).dictionary_encode()
    return np.concatenate([text, of]), coded.indices.to_numpy(), coded.dictionary


def doubled(tokens: list[str]) -> np.ndarray:
    """Whether a character stands twice in a row in each token."""
    s = np.frombuffer("\n".join(tokens).encode("utf-32-le"), np.uint32)
    out = np.zeros(len(tokens) + 1, bool)
    out[np.searchsorted(np.flatnonzero(s == 10), np.flatnonzero((s[:-1] == s[1:]) & (s[1:] != 10)))] = True
    return out[:-1]


class Reader:
    """Restored words of whole texts. What was searched for is remembered, in bounded number."""

    def __init__(self, model: np.ndarray):
        self.decoder, self.cache, self.runs = Decoder(model), {}, {}

    def _remember(self, cache: dict, key: str, words: list[str]) -> tuple[str, ...]:
        found = tuple(words)
        if len(key) <= 40:
            if len(cache) >= _CACHE:
                cache.clear()
            cache[key] = found
        return found

    def token(self, token: str) -> tuple[str, ...]:
        found = self.cache.get(token)
        if found is None:
            plain = trimmed(token)
            if not doubtful(plain):
                words = [plain] if plain else []
            elif plain.isalpha() and (one := self.decoder.one_double(plain)):
                words = [one]
            else:
                words = self.decoder.read(plain)
            found = self._remember(self.cache, token, words)
        return found

    def run(self, run: str) -> tuple[str, ...]:
        """The words of a run of spaced characters."""
        found = self.runs.get(run)
        if found is None:
            found = self._remember(self.runs, run, self.decoder.read(run) if any(c.isalpha() for c in run) else run.split())
        return found

    def readings(self, tokens: list[str]) -> tuple[list[str], np.ndarray]:
        """The words of tokens and runs, by token, and how many each has."""
        bare = [t.strip(_AROUND) for t in tokens]
        plain = np.fromiter(map(str.isalpha, bare), bool, len(bare)) & ~doubled(bare)
        count = plain.astype(np.int64)
        rest = np.flatnonzero(~plain)
        found = [self.run(t) if " " in t else self.token(t) for t in compress(tokens, (~plain).tolist())]
        count[rest] = np.fromiter(map(len, found), np.int64, len(found))
        words, last = [], 0
        for i, w in zip(rest.tolist(), found, strict=True):
            words += bare[last:i]
            words += w
            last = i + 1
        return words + bare[last:], count

    def words_of(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """Numbers of texts and of words of all tokens, runs and chunks, and the distinct words. A word may come again in a text."""
        text, token, tokens = numbered(texts)
        words, count = self.readings(tokens.to_numpy(zero_copy_only=False).tolist())
        word = pa.array(words, pa.string()).dictionary_encode()
        n = count[token]
        at = np.repeat((np.cumsum(count) - count)[token] - (np.cumsum(n) - n), n)
        at += np.arange(len(at))
        return np.repeat(text, n), word.indices.to_numpy()[at], word.dictionary

    def words(self, text: str | None) -> set[str]:
        """The words of a text."""
        return set(self.words_of([text])[2].to_pylist())

    def restored(self, text: str | None) -> str:
        """The text with every token and every run of spaced letters replaced by its reading."""
        runs = spaced_runs((text or "").lower().split())
        return " ".join(w for run in runs for w in (self.run(_LONG.sub(r"\1 \1", " ".join(run))) if len(run) > 1 else self.token(run[0])))


#: The last reader of this worker, by the model it belongs to: what it remembers serves the next task.
_readers: dict[tuple, object] = {}


def _last(key: tuple, make):
    if key not in _readers:
        _readers.clear()
        _readers[key] = make()
    return _readers[key]


def features(word: str) -> list[str]:
    """A word's beginnings of 5, 6 and 7 letters and, marked by '$', itself, from general to special."""
    return [*(word[:n] for n in (5, 6, 7) if len(word) > n), word + "$"]


def features_at(words: pa.Array, keys: pa.Array) -> np.ndarray:
    """A row for each of `features`: the places in `keys` of these features of all words, -1 where a word or `keys` has none."""
    n = pc.utf8_length(words).to_numpy()
    at = [np.flatnonzero(n > k) for k in (5, 6, 7)] + [np.arange(len(words))]
    begin = [pc.utf8_slice_codeunits(words.take(pa.array(i)), 0, k) for i, k in zip(at, (5, 6, 7), strict=False)]
    found = pc.index_in(pa.concat_arrays([*begin, pc.binary_join_element_wise(words, "$", "")]), value_set=keys)
    out = np.full((4, len(words)), -1)
    out[np.repeat(np.arange(4), [len(i) for i in at]), np.concatenate(at)] = pc.fill_null(found, -1).to_numpy()
    return out


class Evidence:
    """Log-odds of words from counted features.

    Whoever has a feature has the more general ones too, so the log-odds of every counted feature are worked out once, from general to
    special, and a word has those of its most special counted feature."""

    def __init__(self, keys: list[str], toxic: np.ndarray, total: np.ndarray, base: float, weight: float = 6.0):
        p: dict[str, float] = {}
        toxic, total = toxic.tolist(), total.tolist()
        self.keys = pa.array(keys, pa.string())
        for i in sorted(range(len(keys)), key=lambda i: (keys[i][-1] == "$", len(keys[i]))):
            k = keys[i]
            more = k[: min(7, len(k) - 2)] if k[-1] == "$" else k[:-1]
            p[k] = (toxic[i] + weight * p.get(more, base)) / (total[i] + weight)
        q = np.array([p[k] for k in keys])
        #: by key, and 0 for no key
        self.value = np.append(np.maximum(0.0, np.log(q / (1 - q)) - np.log(base / (1 - base))), 0.0)

    def of(self, words: pa.Array) -> np.ndarray:
        return self.at(features_at(words, self.keys))

    def at(self, at: np.ndarray) -> np.ndarray:
        """The log-odds of words by `features_at`."""
        best = at[0]
        for special in at[1:]:
            best = np.where(special >= 0, special, best)
        return self.value[best]


def strongest(text: np.ndarray, word: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """For each of n texts the value of its strongest word, of the next two, and how many are strong; each word of a text counts once."""
    text, word, value = (x[value > 0] for x in (text, word, value))
    once = np.unique(text * (word.max(initial=0) + 1) + word, return_index=True)[1]
    text, value = text[once], value[once]
    order = np.lexsort((-value, text))
    text, value = text[order], np.append(value[order], [0.0] * 3)
    start, stop = np.searchsorted(text, np.arange(n)), np.searchsorted(text, np.arange(n), "right")
    top = [np.where(start + k < stop, value[start + k], 0.0) for k in range(3)]
    return np.column_stack([top[0], top[1] + top[2], np.log1p(np.bincount(text[value[:-3] > 2], minlength=n))])


def pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each pair of numbers once, in ascending order."""
    size = b.max(initial=0) + 1
    return np.divmod(np.unique(a * size + b), size)


def spaced(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Numbers of texts and of their words, and the distinct words, of texts whose words stand between single spaces."""
    lists = pc.split_pattern(texts.cast(pa.string()), " ")
    word = lists.flatten().dictionary_encode()
    text = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy())
    some = pc.not_equal(word.dictionary, "").to_numpy(zero_copy_only=False)[word.indices.to_numpy()]
    return text[some], word.indices.to_numpy()[some], word.dictionary


def train(docs: DataFrame, labels: DataFrame, most_labelled: int = 200_000, least_toxic: int = 3) -> tuple:
    """(character model, feature keys, toxic, total, base rate, curve) from rows whose crc32 of the id is not 1 modulo 3."""
    small_batches(docs.sparkSession)
    model = log_model(trigram_counts(docs))
    rows = labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int")).dropna().dropDuplicates(["doc_id"])
    rows = rows.withColumn("fold", crc_fold("doc_id").cast("int")).filter("fold != 1")
    n = rows.count()
    if n > most_labelled:
        rows = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 53)) < int((1 << 53) * most_labelled / n))
    key = ("reader", uuid.uuid4().hex)

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _last(key, lambda: Reader(model))
        for batch in slices(batches, 0, _ROWS):
            text, word, words = reader.words_of(batch.column(0).to_pylist())
            text, word = pairs(text, word)
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(text, np.arange(batch.num_rows + 1)), pa.int32()), words.take(pa.array(word)))
            yield pa.RecordBatch.from_arrays([pc.binary_join(lists, " "), *batch.columns[1:]], ["words", "fold", "toxic"])

    # the labelled rows are bounded (16 bytes each), so they go to the documents and no text is shuffled
    data = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(rows), "doc_id").select("text", "fold", "toxic")
    scratch = Scratch(docs.sparkSession)
    data = scratch.written(data.mapInArrow(decoded, "words string, fold int, toxic int"), "words")
    size = {(r.fold, r.toxic): r.n for r in data.groupBy("fold", "toxic").agg(F.count("*").alias("n")).collect()}
    toxic, total = sum(v for (_, t), v in size.items() if t), sum(size.values())
    none = np.zeros(0)
    if toxic in (0, total):
        base = min(max(toxic / total if total else 0.0, 1e-6), 1 - 1e-6)
        return model, [], none, none, base, np.array([np.log(base / (1 - base)), 0, 0, 0])

    def all_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 0, _ROWS):
            seen: dict[int, Counter] = {}
            for t, fold in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen.setdefault(fold, Counter()).update({k for w in t.split() for k in features(w)})
            for fold, counts in seen.items():
                yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array([fold] * len(counts), pa.int32()), pa.array(list(counts.values()), pa.int64())], ["k", "fold", "c"])

    def counted_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, counts = pa.array(keys, pa.string()), {f: np.zeros(len(keys), np.int64) for f in (0, 2)}
        for batch in slices(batches, 0, _ROWS):
            text, word, words = spaced(batch.column(0))
            at = features_at(words, wanted)[:, word]
            text, at = pairs(np.broadcast_to(text, at.shape)[at >= 0], at[at >= 0])
            fold = batch.column(1).to_numpy()[text]
            for f, c in counts.items():
                c += np.bincount(at[fold == f], minlength=len(keys))
        for f, c in counts.items():
            some = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(np.full(len(some), f, np.int32)), pa.array(c[some])], ["k", "fold", "c"])

    def summed(rows: DataFrame, run, k: str) -> DataFrame:
        """k, fold, c: documents per feature and fold."""
        return rows.select("words", "fold").mapInArrow(run, f"k {k}, fold int, c long").groupBy("k", "fold").agg(F.sum("c").alias("c"))

    # features of few toxic documents say nothing; the others are bounded by the number of labelled rows
    bad = summed(data.filter("toxic = 1"), all_features, "string")
    bad = bad.groupBy("k").agg(F.sum(F.when(F.col("fold") == 0, F.col("c"))).alias("t0"), F.sum(F.when(F.col("fold") == 2, F.col("c"))).alias("t2"))
    bad = bad.na.fill(0).filter(F.col("t0") + F.col("t2") >= least_toxic).toPandas().sort_values("k")
    keys = bad.k.tolist()
    t = {0: bad.t0.to_numpy(np.float64), 2: bad.t2.to_numpy(np.float64)}
    n = {f: t[f].copy() for f in (0, 2)}
    for k, f, c in summed(data.filter("toxic = 0"), counted_features, "long").collect():
        n[f][k] += c
    base = toxic / total

    # the curve is fitted on each fold with the counts of the other one
    def evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = {f: Evidence(keys, t[2 - f], n[2 - f], base) for f in (0, 2)}
        for batch in slices(batches, 0, _ROWS):
            text, word, words = spaced(batch.column(0))
            at = features_at(words, by[0].keys)
            value = np.where(batch.column(1).to_numpy()[text] == 0, by[0].at(at)[word], by[2].at(at)[word])
            x = strongest(text, word, value, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in x.T), batch.column(2).cast(pa.float64())], list("abcy"))

    fit = data.mapInArrow(evidence, "a double, b double, c double, y double").toPandas().to_numpy()
    scratch.drop(data)
    return model, keys, t[0] + t[2], n[0] + n[2], base, logistic_fit(fit[:, :3], fit[:, 3])


def score(docs: DataFrame, trained: tuple) -> DataFrame:
    """doc_id, score of every row."""
    model, keys, toxic, total, base, curve = trained
    key = ("scorer", uuid.uuid4().hex)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, evidence = _last(key, lambda: (Reader(model), Evidence(keys, toxic, total, base)))
        for batch in slices(batches, 1, _ROWS):
            text, word, words = reader.words_of(batch.column(1).to_pylist())
            x = strongest(text, word, evidence.of(words)[word], batch.num_rows)
            p = 1 / (1 + np.exp(-np.clip(curve[0] + x @ curve[1:], -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p)], ["doc_id", "score"])

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")


def scored(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of `docs`."""
    out = score(docs, train(docs, labels))
    return out.select("doc_id", (crc_fold("doc_id") == 1).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
