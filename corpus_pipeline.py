"""A training corpus from `documents`, in five stages.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and is written as Parquet and read again for the
next. All but the last return the columns of `documents`, whatever others there are and whatever their names: the first three drop rows,
the fourth changes texts. The last returns the tokens of every document that is left.

In every stage null and empty texts are rows like others (an empty text has its shape's score, no near copies, no benchmark item, no secrets, no
ids), texts of any length are read whole, a null in any other column is a value of its own, and no rows give none. What repeats
or ties is said with each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sitescan.llm import decontamination, near_dedup, quality, secrets
from sitescan.llm.common import table, written
from sitescan.llm.queries import encoded


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps. Rows that repeat are judged row by row; a score at the threshold stays."""
    return quality.kept(docs, table(spark, sf_dir, "labels"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the smallest id: five-word shingles, similarity of 0.8 and more. Of rows that
    repeat an id the one with the least text stays; rows without an id stay."""
    return near_dedup.deduplicated(docs, shingle=5, percent=80)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item (0.8 and more of its five-word shingles). Rows that repeat are judged row by row."""
    return decontamination.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced by a mark, row by row; n_chars is counted again where that was done."""
    return secrets.redacted(docs, secrets.trained(docs))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_ids, text_sha256, exact, row by row."""
    return encoded(docs)


STAGES = [
    ("quality classifier", good_quality),
    ("MinHash near-dedup", one_of_each_group),
    ("benchmark decontamination", without_benchmark),
    ("secret scans", without_secrets),
    ("SentencePiece encoding", tokens),
]

#: Trained models and tokens are not to be had in SQL; tests/llm/test_pipeline.py holds the result against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
