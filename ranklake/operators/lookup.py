"""Lookups between hits, units, articles, documents and citations; all are equi-joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ranklake.functions import text as X
from ranklake.operators.parse import article_of


def expand(hits: DataFrame, units: DataFrame) -> DataFrame:
    """Units of the documents hit, with the document's score, in the order of hits and then of the document."""
    joined = hits.select("qid", "doc_id", F.col("score").alias("doc_score"), F.col("rank").alias("doc_rank")).join(units, "doc_id")
    return joined.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy("doc_rank", "row_id")))


def with_text(ranked: DataFrame, units: DataFrame, key: str = "row_id", legacy_fallback: bool = False) -> DataFrame:
    """Texts for units that survived. An unknown id has none; with legacy_fallback it has its document's first article's."""
    texts = units.select(key, "text").join(ranked.select(key).distinct(), key, "left_semi").dropDuplicates([key])
    out = ranked.join(texts, key, "left")
    if not legacy_fallback:
        return out
    first = units.groupBy("doc_id").agg(F.min_by("article_text", "row_id").alias("__first"))
    return out.join(first, "doc_id", "left").withColumn("text", F.coalesce("text", "__first")).drop("__first")


def article_of_unit(ranked: DataFrame, units: DataFrame) -> DataFrame:
    """article_id, article_no, title and article_text of each unit: of repeated unit ids the first row's."""
    first = units.groupBy("unit_id").agg(F.min_by(F.struct("article_id", "article_no", "title", "article_text"), "row_id").alias("a"))
    return ranked.join(first, "unit_id", "left").select(*ranked.columns, "a.*")


def number_index(docs: DataFrame, key: str = "doc_id", text: str = "passage") -> DataFrame:
    """(number, doc_ids, usable): documents by number; a number with more than one document is ambiguous."""
    rows = docs.select(key, X.document_number(F.col(text)).alias("number")).where("number is not null")
    return rows.groupBy("number").agg(F.array_sort(F.collect_set(key)).alias("doc_ids")).withColumn("usable", F.size("doc_ids") == 1)


def link_citations(citations: DataFrame, numbers: DataFrame, units: DataFrame) -> DataFrame:
    """(citation columns, doc_id, unit_id, outcome) for citations (cid, number, article_no, clause_no).

    The number leads to a document, the article's number to an article, the clause's number to a unit; outcome names the step
    that failed: no_number, unknown_document, ambiguous_document, unknown_article, unknown_clause, or linked.
    """
    known = numbers.select("number", "usable", F.element_at("doc_ids", 1).cast("string").alias("doc_id"))
    a = citations.join(known, "number", "left")
    articles = units.groupBy("doc_id", "article_no").agg(F.min_by("article_id", "row_id").alias("article_id"))
    b = a.join(articles, ["doc_id", "article_no"], "left")
    clauses = units.where("clause_no <> ''").groupBy("article_id", "clause_no").agg(F.min_by("unit_id", "row_id").alias("clause_unit"))
    c = b.join(clauses, ["article_id", "clause_no"], "left")
    asked = F.coalesce("clause_no", F.lit("")) != ""
    outcome = (
        F.when(F.col("number").isNull(), "no_number").when(F.col("usable").isNull(), "unknown_document").when(~F.col("usable"), "ambiguous_document")
        .when(F.col("article_id").isNull(), "unknown_article").when(asked & F.col("clause_unit").isNull(), "unknown_clause").otherwise("linked")
    )
    unit = F.when(outcome == "linked", F.when(asked, F.col("clause_unit")).otherwise(F.col("article_id")))
    return c.select(*citations.columns, "doc_id", unit.alias("unit_id"), outcome.alias("outcome"))


def same_question(a: DataFrame, b: DataFrame, text: str = "question") -> DataFrame:
    """(qid_a, qid_b) of rows with the same question but for white space at the ends."""
    x = a.select(F.col("qid").alias("qid_a"), X.strip(F.col(text)).alias("q"))
    y = b.select(F.col("qid").alias("qid_b"), X.strip(F.col(text)).alias("q"))
    return x.join(y, "q").select("qid_a", "qid_b")


def question_classes(rows: DataFrame, text: str = "question") -> DataFrame:
    """(qid, class_id, n): the smallest qid and the number of rows with the same question but for white space at the ends."""
    q = rows.select("qid", X.strip(F.col(text)).alias("q")).where("q is not null")
    return q.join(q.groupBy("q").agg(F.min("qid").alias("class_id"), F.count(F.lit(1)).alias("n")), "q").select("qid", "class_id", "n")


def followed(retrieved: DataFrame, units: DataFrame, numbers: DataFrame, most: int = 25, near: int = 120) -> DataFrame:
    """Articles named inside retrieved texts (qid, rank, doc_id, text): (qid, doc_id, article_id, nth).

    A named article is of the same document, unless a document number stands within ``near`` characters after it and the word
    for this document doesn't come first. At most ``most`` articles a query, in order.
    """
    pattern = rf"(?iU)\bĐiều\s+(\d+[a-zA-ZđĐ]?)\b([\s\S]{{0,{near}}})"
    text = F.col("text")
    rows = retrieved.select("qid", "rank", "doc_id", F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)).alias("no"), F.regexp_extract_all(text, F.lit(pattern), F.lit(2)).alias("after")).alias("m"))
    m = rows.select("qid", "rank", "doc_id", F.posexplode("m").alias("pos", "m")).select("qid", "rank", "doc_id", "pos", F.col("m.no").alias("article_no"), F.col("m.after").alias("after"))
    number = F.upper(F.regexp_extract("after", f"({X.LEGAL_ID})", 1))
    head = F.element_at(F.split("after", X.LEGAL_ID), 1)
    other = F.when((number != "") & ~head.rlike(r"(?iU)\bnày\b"), number)
    usable = numbers.where("usable").select("number", F.element_at("doc_ids", 1).cast("string").alias("other_doc"))
    m = m.withColumn("number", other).join(usable, "number", "left")
    target = F.when(F.col("number").isNull(), F.col("doc_id").cast("string")).otherwise(F.col("other_doc"))
    articles = units.groupBy(F.col("doc_id").alias("to_doc"), "article_no").agg(F.min_by("article_id", "row_id").alias("article_id"))
    found = m.withColumn("to_doc", target).join(articles, ["to_doc", "article_no"])
    once = found.groupBy("qid", "to_doc", "article_id").agg(F.min(F.struct("rank", "pos")).alias("first"))
    nth = F.row_number().over(W.partitionBy("qid").orderBy("first", "article_id"))
    return once.withColumn("nth", nth).where(F.col("nth") <= most).select("qid", F.col("to_doc").alias("doc_id"), "article_id", "nth")


def remaining(work: DataFrame, done: DataFrame, key: str = "qid") -> DataFrame:
    """Rows not yet done: with an append, the resumable batch."""
    return work.join(done.select(key).distinct(), key, "left_anti")


def only(rows: DataFrame, wanted: DataFrame, key: str = "qid") -> DataFrame:
    return rows.join(wanted.select(key).distinct(), key, "left_semi")


def article_ids(ranked: DataFrame, unit: str = "unit_id") -> DataFrame:
    return ranked.withColumn("article_id", article_of(F.col(unit)))
