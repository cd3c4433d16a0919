"""A corpus in five stages: quality, repeated lines, near-duplicates, secrets, packing into training sequences.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written and read again as the next stage's docs. All
but the last keep the columns of documents, others of any name among them.

Defined results, for all stages: a null text counts as empty and stays null where it isn't changed; empty and very long texts
are treated whole, like any other; a null doc_id stays null; an empty table gives an empty result. Rows equal in doc_id and text
are treated alike by quality, lines and secrets, are one document for near_duplicates, and are packed each for itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ranklake.llm import bestfit_pack, line_dedup, pu_quality, secret_scan, simhash_dedup
from ranklake.llm.common import materialize, remove, table, tokenizer_path


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars, where there is one, follows the text."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labels of documents not held out, predicts to be good."""
    return pu_quality.keep(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines of repeated three-line windows; a document all of whose lines are repeats goes."""
    cleaned, (n_lines, n_removed) = line_dedup.remove_repeats(docs), line_dedup.count_columns(docs)
    return _counted(cleaned.where(F.col(n_removed) < F.col(n_lines)).select(*docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles with a similarity of 0.8 or more."""
    return simhash_dedup.deduplicate(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with secrets masked."""
    return _counted(secret_scan.redact(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences of 2,048 tokens."""
    return bestfit_pack.pack(docs, tokenizer_path("word_bpe_49k.json"), capacity=2048)


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("secrets", secrets), ("packing", packing)]

#: SQL can't express the classifier, the fingerprints or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), ""
    for name, stage in STAGES[:-1]:
        docs, path = materialize(stage(spark, docs, sf_dir), name)
        if before:  # it has been read
            remove(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
