"""Helpers shared by the text operators: the shared folder, written tables and word hashes."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SPACE = re.compile(rb"[\x20\x09-\x0D]")
#: Odd 64-bit multipliers of the splitmix64 finaliser.
_M1, _M2, GOLDEN = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


#: Bytes of an Arrow batch that goes to or comes from a Python worker, unless the session sets its own.
BATCH_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir. Only a local session, whose driver and executors are one
    process, gets a temporary one where that is unset; a cluster must name it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def small_batches(spark: SparkSession) -> None:
    """Bound the bytes of Arrow batches, in Spark and in its Python workers, whatever the length of texts, unless the session does."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(BATCH_BYTES))


def slices(batches: Iterator[pa.RecordBatch], text: int | None = None, rows: int = 512, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of Arrow batches in pieces of at most `rows` rows and, but for single rows, `most` bytes of column `text`."""
    for batch in batches:
        n = batch.num_rows
        total = np.zeros(n + 1, np.int64)
        if text is not None and n:
            np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False), out=total[1:])
        at = 0
        while at < n:
            stop = max(at + 1, min(n, at + rows, int(np.searchsorted(total, total[at] + most, "right")) - 1))
            yield batch.slice(at, stop - at)
            at = stop


class Scratch:
    """Tables that a job writes into the shared folder, and deletes there when later steps no longer need them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def written(self, df: DataFrame, name: str) -> DataFrame:
        """Write `df` as Parquet and read it back: cuts the lineage and survives a lost executor."""
        path = f"{shared_dir(self.spark)}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (path, out)
        return out

    def drop(self, *tables: DataFrame) -> None:
        for df in tables:
            self._delete(self.paths.pop(id(df))[0])

    def drop_all_but(self, *tables: DataFrame) -> None:
        self.drop(*(df for _, df in list(self.paths.values()) if all(df is not t for t in tables)))

    def _delete(self, path: str) -> None:
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """One table of `Scratch`, kept as long as the shared folder is."""
    return Scratch(df.sparkSession).written(df, name)


def fresh(df: DataFrame, name: str) -> str:
    """`name`, with underscores in front until no column of `df` has it, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_fold(col: str, folds: int = 3) -> F.Column:
    """crc32 of the decimal text of `col`, modulo `folds`; null counts as empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % folds


def times_golden(k: int) -> np.uint64:
    """k * GOLDEN modulo 2^64."""
    return np.uint64((int(GOLDEN) * k) & 0xFFFFFFFFFFFFFFFF)


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser of a uint64 array."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def words_of(text: str | None) -> list[bytes]:
    """The runs of `[^\\x20\\x09-\\x0D]` of the text with A-Z in lower case, as UTF-8; null has none."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def hashed_words(text: str | None, step: int = 1 << 20) -> np.ndarray:
    """`word_hashes(words_of(text))`, the words of about `step` bytes at a time, so that a long text's words are never all held."""
    if not text:
        return np.empty(0, np.uint64)
    raw = text.encode("utf-8", "surrogatepass").lower()
    if len(raw) <= step:
        return word_hashes(raw.split())
    out, at = [], 0
    while at < len(raw):
        cut = _SPACE.search(raw, at + step)
        stop = cut.end() if cut else len(raw)
        out.append(word_hashes(raw[at:stop].split()))
        at = stop
    return np.concatenate(out)


def shingles(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of `size` words, in order; of the whole sequence where there are fewer words; none for no words."""
    n = len(h)
    if n == 0:
        return h
    k = min(size, n)
    out = mix(h[: n - k + 1] + times_golden(k))
    for i in range(1, k):
        out = mix(out ^ h[i : n - k + 1 + i] + times_golden(i))
    return out


def logistic_fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Logistic weights (the constant first) by Newton steps, lightly shrunk; for small, bounded training tables."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    keep = np.diag([1e-6] + [ridge] * (x.shape[1] - 1))
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w = w + np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + keep, x.T @ (y - p) - keep @ w)
    return w
