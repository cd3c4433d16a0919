"""Sources: question sets, raw and parsed documents, run files, vectors and labels. No schema is inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ranklake.functions import text as X

RAW = "id BIGINT, name STRING, link STRING, passage STRING"
CLAUSE = "STRUCT<clause_id: STRING, clause_no: STRING, text: STRING, char_start: INT, char_end: INT>"
ARTICLE = f"STRUCT<article_id: STRING, article_no: STRING, title: STRING, text: STRING, char_start: INT, char_end: INT, clauses: ARRAY<{CLAUSE}>>"
PARSED = f"doc_id STRING, name STRING, link STRING, parse_status STRING, articles ARRAY<{ARTICLE}>, appendix STRING"
RUN = "qid STRING, question STRING, unit_ids ARRAY<STRING>, candidates ARRAY<STRUCT<unit_id: STRING, context_id: STRING, text: STRING>>, ranked_units ARRAY<STRUCT<unit_id: STRING, context_id: STRING, row: INT, score: DOUBLE, dense_rank: INT>>"
SPANS = "qid STRING, spans ARRAY<STRUCT<context_id: STRING, khoan_id: STRING, unit_type: STRING, matched_span: STRING, confidence: DOUBLE, role: STRING>>"


def question_set(spark: SparkSession, path: str) -> DataFrame:
    """(qid, question, answer) of JSON objects {qid: {question, answer}}, one a file; answer is null on target sets."""
    whole = spark.read.text(path, wholetext=True)
    entries = F.explode(F.from_json("value", "map<string, struct<question: string, answer: string>>"))
    return whole.select(entries.alias("qid", "v")).select("qid", "v.question", "v.answer")


def raw_documents(spark: SparkSession, path: str, skip_empty: bool = True) -> DataFrame:
    """Normalised documents of JSON files, one a file; doc_pos is the file's place among the sorted names.

    The rank comes from the distinct names only, whose number is that of the files.
    """
    rows = spark.read.schema(RAW).json(path, multiLine=True).select("*", F.col("_metadata.file_name").alias("file"))
    names = rows.select("file").distinct().withColumn("doc_pos", F.row_number().over(W.orderBy("file")) - 1)
    out = normal_document(rows.join(names, "file")).drop("file")
    return out.where(F.length(X.strip(F.col("passage"))) > 0) if skip_empty else out


def normal_document(rows: DataFrame) -> DataFrame:
    """Null passages become empty; a missing name comes from the link."""
    missing = F.coalesce(F.col("name"), F.lit("")) == ""
    return rows.withColumns({
        "name_is_fallback": missing,
        "name": F.when(missing, X.name_from_link(F.col("link"))).otherwise(F.col("name")),
        "passage": F.coalesce(F.col("passage"), F.lit("")),
    })


def one_document(docs: DataFrame, doc_id: int | str, key: str = "id") -> DataFrame:
    return docs.where(F.col(key) == F.lit(doc_id))


def parsed_documents(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    return spark.read.schema(PARSED).format(kind).load(path)


def run_file(spark: SparkSession, path: str) -> DataFrame:
    """(qid, unit_id, rank, score, dense_rank) of JSON lines in any of the three shapes of a run; ranks from 1."""
    rows = spark.read.schema(RUN).json(path)
    empty = F.array().cast("array<struct<unit_id: string, score: double, dense_rank: int>>")
    none = [F.lit(None).cast("double").alias("score"), F.lit(None).cast("int").alias("dense_rank")]

    def plain(ids: Column) -> Column:
        return F.transform(ids, lambda u: F.struct(u.alias("unit_id"), *none))

    units = F.coalesce(
        F.transform("ranked_units", lambda u: F.struct(u["unit_id"].alias("unit_id"), u["score"].alias("score"), u["dense_rank"].alias("dense_rank"))),
        plain(F.col("unit_ids")), plain(F.col("candidates.unit_id")), empty,
    )
    return rows.select("qid", F.posexplode(units).alias("pos", "u")).select("qid", "u.unit_id", (F.col("pos") + 1).alias("rank"), "u.score", "u.dense_rank")


def vectors(spark: SparkSession, path: str, units: DataFrame | None = None) -> DataFrame:
    """Vectors by row; where units are given their number must be the same."""
    out = spark.read.schema("row_id BIGINT, unit_id STRING, vec ARRAY<FLOAT>").parquet(path)
    if units is not None:
        n, m = out.count(), units.count()
        if n != m:
            raise ValueError(f"{n} vectors for {m} units")
    return out


def span_labels(spark: SparkSession, *paths: str) -> DataFrame:
    """(qid, part_no, doc_id, unit_id, unit_type, span, confidence, role) of label files of several splits."""
    rows = spark.read.schema(SPANS).json(list(paths))
    return rows.select("qid", F.posexplode("spans").alias("part_no", "s")).select(
        "qid", "part_no", F.col("s.context_id").alias("doc_id"), F.col("s.khoan_id").alias("unit_id"), "s.unit_type", F.col("s.matched_span").alias("span"), "s.confidence", "s.role"
    )
