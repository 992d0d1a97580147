"""Quality of documents: a classifier's evidence combined with the record of their site and path.

A logistic classifier reads the shape of a whole text. Its probabilities, summed per path and site by grouped aggregation over all
documents, give each site and path a posterior mean that is shrunk, the sparser the more: paths towards their site, sites
towards the corpus. How strongly comes from the data (method of moments of a beta-binomial). A document's score has the odds of
its own evidence times the odds of its path, taken without the document itself, against the corpus, the latter to the power `site_weight`.

Nulls and empty texts have the shape of an empty text; null sites and paths are one group of their own. Repeated rows count
and are answered row by row. Without labels of both classes every document has probability 1/2. An empty input gives no rows. `scored`
reads doc_id, text and the columns of site and path and returns only its own; `kept` returns the input's columns, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, logistic_fit, slices, small_batches, written

_NAMES = list("abcdefgh")
_UPPER = bytes(1 if 65 <= i <= 90 else 0 for i in range(256))
_MARK = bytes(1 if i in b"!$%&*#|<>{}[]=^~@\\/_+" else 0 for i in range(256))
_DIGIT = bytes(1 if 48 <= i <= 57 else 0 for i in range(256))


def shape(text: str | None) -> list[float]:
    """Of a whole text: shares of capitals, marks and digits, of words seen before, of words equal to the one before, of words
    without a letter, the mean word length and the logarithm of the number of words."""
    words = text.split() if text else []
    if not words:
        return [0.0] * 8
    raw = text.encode("utf-8", "replace")
    n, k = len(raw), len(words)
    share = lambda table: raw.translate(table).count(1) / n
    same = sum(map(str.__eq__, words, words[1:])) / k
    return [share(_UPPER), share(_MARK), share(_DIGIT), 1 - (len(set(words)) / k) ** 0.5, same, 1 - sum(map(str.isalpha, (w[0] for w in words))) / k, n / k / 10, float(np.log1p(k)) / 10]


def _squares(x: np.ndarray) -> np.ndarray:
    return np.concatenate([x, np.sqrt(np.abs(x[:, :5]))], 1)


def shapes(docs: DataFrame, site: Column, path: Column) -> DataFrame:
    """doc_id, site, path and the shape (a to h) of every row: all that is needed of a text, in 64 bytes. Written once, as texts are
    read for it, so neither training nor aggregation moves or reads a text again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 3):
            x = np.array([shape(t.as_py()) for t in batch.column(3)]).reshape(-1, 8)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array(c) for c in x.T)], ["doc_id", "site", "path", *_NAMES])

    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), site.alias("site"), path.alias("path"), F.col("text").cast("string"))
    return written(rows.mapInArrow(run, "doc_id long, site string, path string, " + ", ".join(f"{c} double" for c in _NAMES)), "shapes")


def train(seen: DataFrame, labels: DataFrame, most_labelled: int = 100_000) -> np.ndarray:
    """Weights of the classifier from at most `most_labelled` labelled rows of `shapes`, chosen by hash: a few MB, which may be broadcast."""
    rows = labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int").alias("y")).dropna().dropDuplicates(["doc_id"])
    n = rows.count()
    if n > most_labelled:
        rows = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 53)) < int((1 << 53) * most_labelled / n))
    got = seen.join(F.broadcast(rows), "doc_id").select(*(F.col(c).cast("float") for c in _NAMES), F.col("y").cast("float")).toPandas().to_numpy(float)
    if len(got) == 0 or got[:, 8].min() == got[:, 8].max():
        return np.zeros(14)
    return logistic_fit(_squares(got[:, :8]) * 10, got[:, 8])


def _probability(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(weights[0] + _squares(x) * 10 @ weights[1:], -12, 12)))


def judged(seen: DataFrame, weights: np.ndarray) -> DataFrame:
    """doc_id, site, path, p_doc of rows of `shapes`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([c.to_numpy() for c in batch.columns[3:]]).reshape(-1, 8)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(_probability(x, weights))], ["doc_id", "site", "path", "p_doc"])

    return seen.mapInArrow(run, "doc_id long, site string, path string, p_doc double")


def _strength(groups: DataFrame, of: str, n: str, mean: str, above: str, outer_n: str | Column, count: int, v: float) -> float:
    """How many documents' worth of the outer mean a group is given: within-group over between-group variance."""
    a, spread, k = groups.agg(F.sum(F.col(n) * (F.col(mean) - F.col(above)) ** 2), F.sum(F.col(n) - F.col(n) * F.col(n) / outer_n), F.count("*")).first()
    between = max(0.0, ((a or 0.0) - max(0, k - count) * v) / spread) if spread else 0.0
    return min(1e6, max(1.0, v / between - 1)) if between else 1e6


def posteriors(evidence: DataFrame) -> tuple[DataFrame, dict[str, float]]:
    """Of rows (site, path, p_doc): site, path, site_posterior, path_posterior and the counts and sums (np, sp, ns, ss) that
    they come from, by grouped aggregation; and the corpus' mean `m` with the strengths `ks` and `kp` of shrinking."""
    paths = evidence.groupBy("site", "path").agg(F.count("*").alias("np"), F.sum("p_doc").alias("sp")).withColumn("mp", F.col("sp") / F.col("np"))
    sites = paths.groupBy("site").agg(F.sum("np").alias("ns"), F.sum("sp").alias("ss")).withColumn("ms", F.col("ss") / F.col("ns"))
    n, s, k = sites.agg(F.sum("ns"), F.sum("ss"), F.count("*")).first()
    m = min(max(s / n, 1e-6), 1 - 1e-6) if n else 0.5
    v = m * (1 - m)
    ks = _strength(sites.withColumn("m", F.lit(m)), "site", "ns", "ms", "m", F.lit(float(n or 1)), 1, v)
    sites = sites.withColumn("site_posterior", (F.col("ss") + ks * m) / (F.col("ns") + ks))
    both = paths.join(sites, "site")
    kp = _strength(both, "path", "np", "mp", "ms", F.col("ns"), k, v)
    both = both.withColumn("path_posterior", (F.col("sp") + kp * F.col("site_posterior")) / (F.col("np") + kp))
    return both.select("site", "path", "site_posterior", "path_posterior", "np", "sp", "ns", "ss"), {"m": m, "ks": ks, "kp": kp}


def _named(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def fitted(docs: DataFrame, labels: DataFrame, site: Column, path: Column) -> tuple[np.ndarray, DataFrame, DataFrame, dict[str, float]]:
    """Classifier weights, judged rows, group posteriors (both written) and the numbers of `posteriors`."""
    seen = shapes(docs, site, path)
    weights = train(seen, labels)
    rows = written(judged(seen, weights), "judged")
    groups, numbers = posteriors(rows)
    return weights, rows, written(groups, "posteriors"), numbers


def score_of(p: np.ndarray, group: np.ndarray, numbers: dict[str, float], site_weight: float) -> np.ndarray:
    """Scores of documents of evidence `p` in groups of rows (np, sp, ns, ss), from each of which the document itself is taken out."""
    n, s, n_site, s_site = group
    m, ks, kp = numbers["m"], numbers["ks"], numbers["kp"]
    site = (s_site - p + ks * m) / (n_site - 1 + ks)
    path = (s - p + kp * site) / (n - 1 + kp)
    p, path = (np.clip(x, 1e-6, 1 - 1e-6) for x in (p, path))
    odds = np.log(p / (1 - p)) + site_weight * (np.log(path / (1 - path)) - np.log(m / (1 - m)))
    return 1 / (1 + np.exp(-odds))


def scored(docs: DataFrame, labels: DataFrame, site: Column | None = None, path: Column | None = None, site_weight: float = 0.5, threshold: float = 0.5) -> DataFrame:
    """doc_id, site, path, p_doc, site_posterior, path_posterior, score and keep of every row of `docs`. Sites default to source, paths
    to lang within it."""
    site, path = _named(F.col("source") if site is None else site), _named(F.col("lang") if path is None else path)
    _, rows, groups, numbers = fitted(docs, labels, site, path)
    rows = rows.join(groups, ["site", "path"]).select("doc_id", "site", "path", "p_doc", "site_posterior", "path_posterior", "np", "sp", "ns", "ss")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([c.to_numpy() for c in batch.columns[6:]], float)
            score = score_of(batch.column(3).to_numpy(), x, numbers, site_weight)
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(score), pa.array(score >= threshold)], [*batch.schema.names[:6], "score", "keep"])

    return rows.mapInArrow(run, "doc_id long, site string, path string, p_doc double, site_posterior double, path_posterior double, score double, keep boolean")


def kept(docs: DataFrame, labels: DataFrame, site: Column | None = None, path: Column | None = None, site_weight: float = 0.5, threshold: float = 0.5, most_groups: int = 200_000) -> DataFrame:
    """The rows of `docs` that are good enough, with their columns, decided in one pass over the texts.

    Up to `most_groups` sites and paths (48 bytes and their names each) are sent to the rows; more are joined, hot groups split by Spark.
    """
    site, path = _named(F.col("source") if site is None else site), _named(F.col("lang") if path is None else path)
    weights, _, groups, numbers = fitted(docs, labels, site, path)
    own, key = fresh(docs, "_path"), fresh(docs, "_site")
    groups = groups.select(F.col("site").alias(key), F.col("path").alias(own), F.array(*(F.col(c).cast("double") for c in ("np", "sp", "ns", "ss"))).alias(group := fresh(docs, "_group")))
    if groups.count() <= most_groups:
        groups = F.broadcast(groups)
    rows = docs.withColumns({key: site, own: path}).join(groups, [key, own]).select(*(F.col(f"`{c}`") for c in docs.columns), group)
    at, names = docs.columns.index("text"), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, at):
            p = _probability(np.array([shape(t.as_py()) for t in batch.column(at)]).reshape(-1, 8), weights)
            x = batch.column(len(names)).flatten().to_numpy().reshape(-1, 4).T
            good = score_of(p, x, numbers, site_weight) >= threshold
            yield pa.RecordBatch.from_arrays(batch.columns[:-1], names).filter(pa.array(good))

    return rows.mapInArrow(run, docs.schema)
