"""Weak labels of answers from the units they quote, end to end."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ranklake.functions import text as X
from ranklake.operators import align, bm25, pack, parse

KEY = "part_id"
#: Parsed documents, or what parses those whose ids (doc_id, a string) it is given.
Parsed = DataFrame | Callable[[DataFrame], DataFrame]


def quoted_parts(answers: DataFrame) -> DataFrame:
    """(part_id, qid, part_no, role, part): the quoted core of each part of an answer (qid, answer), where it is long enough to align."""
    rows = align.parts(answers.where(X.strip(F.coalesce("answer", F.lit(""))) != "")).withColumn("part", align.quote_core(F.col("part")))
    id = F.concat_ws(":", F.col("qid").cast("string"), "part_no")
    return rows.where(X.token_count(F.col("part")) >= align.QUOTE_WORDS).select(id.alias(KEY), "qid", "part_no", "role", "part")


def unit_candidates(parts: DataFrame, index: dict[str, DataFrame], parsed: Parsed, k_docs: int = 20, n_units: int = 20, unit_index: dict[str, DataFrame] | None = None) -> DataFrame:
    """Units (part_id, ..., rank, unit_id, text) that each part is aligned to.

    The k_docs best documents are searched with the part and its sentences, and taken apart into units in order; of these the
    n_units that share most tokens with the part stay. With an index of units these are ranked by it, and the ranks are trusted.
    """
    asked = parts.select(F.col(KEY).alias("qid"), F.col("part").alias("question"))
    spark = parts.sparkSession
    hits = bm25.kept(spark, bm25.search_variants(index, asked, k_docs).select("qid", F.col("doc_id").cast("string").alias("doc_id"), F.col("rank").alias("doc_rank")))
    ids = bm25.kept(spark, hits.select("doc_id").distinct())
    wanted = parsed(ids) if callable(parsed) else parsed.withColumn("doc_id", F.col("doc_id").cast("string")).join(ids, "doc_id", "left_semi")
    units = parse.units(wanted).select("doc_id", "row_id", "unit_id", "unit_type", "text", "article_text")
    rows = hits.join(units, "doc_id").join(asked, "qid")
    if unit_index is not None:
        ranked = bm25.rescore(unit_index, asked, rows.withColumn("score", F.lit(0.0)).withColumn("rank", F.lit(0)), key="row_id")
        return _named(pack.prefilter(ranked, n_units, already_ranked=True))
    # rank orders documents first and then units in them; it stands in for a list position.
    ordered = rows.withColumn("rank", F.struct("doc_rank", "row_id"))
    return _named(pack.prefilter(ordered, n_units))


def _named(rows: DataFrame) -> DataFrame:
    return rows.drop("rank").withColumnsRenamed({"place": "rank", "qid": KEY, "question": "part"})


def label_answers(answers: DataFrame, index: dict[str, DataFrame], parsed: Parsed, emit: float = 0.3, trust: float = 0.6, **search) -> DataFrame:
    """(qid, part_no, role, doc_id, clause_id, unit_type, span, confidence, trusted): the unit each part of an answer quotes.

    A part labels the unit it aligns to best, the first of equals, from a score of ``emit``; clause_id is null for units that are whole
    articles or documents. Blank answers and parts of fewer than five words give no row.
    """
    parts = quoted_parts(answers)
    best = align.best_alignment(unit_candidates(parts, index, parsed, **search), emit=emit, trust=trust, by=(KEY,))
    clause = F.when(F.col("unit_type") == "clause", F.col("unit_id"))
    return best.join(parts.select(KEY, "qid", "part_no", "role"), KEY).select("qid", "part_no", "role", "doc_id", clause.alias("clause_id"), "unit_type", "span", "confidence", "trusted")


def online_items(wanted: DataFrame, parsed: DataFrame, docs: DataFrame, expand: bool = False) -> DataFrame:
    """wanted (qid, doc_id, unit_id, score, ...) with kind, text, covered, name, link and document_number.

    A unit is a clause or a whole article by its id; of repeated ids the first counts. With ``expand`` a clause gives its article's
    text. covered lists the ids whose text is given. Fails on an id that the document lacks. docs: (doc_id, name, link).
    """
    mine = parsed.withColumn("doc_id", F.col("doc_id").cast("string")).join(wanted.select(F.col("doc_id").cast("string").alias("doc_id")).distinct(), "doc_id", "left_semi")

    def entries(a: Column, i: Column) -> Column:
        all_ids = F.concat(F.array(a["article_id"]), F.transform(a["clauses"], lambda k: k["clause_id"]))
        whole = F.struct(i.alias("a"), F.lit(-1).alias("k"), a["article_id"].alias("unit_id"), a["text"].alias("text"), all_ids.alias("covered"))
        clause = lambda k, j: F.struct(
            i.alias("a"), j.alias("k"), k["clause_id"].alias("unit_id"), (a["text"] if expand else k["text"]).alias("text"), (all_ids if expand else F.array(k["clause_id"])).alias("covered")
        )
        return F.concat(F.array(whole), F.transform(a["clauses"], clause))

    rows = mine.select("doc_id", "parse_status", F.inline(F.flatten(F.transform("articles", entries))))
    asked = wanted.select(F.col("doc_id").cast("string").alias("doc_id"), "unit_id").distinct()
    article = F.when(F.col("parse_status") == "fallback", "doc_fallback").otherwise("article_fallback")
    found = rows.join(asked, ["doc_id", "unit_id"]).withColumn("kind", F.when(F.col("k") >= 0, "clause").otherwise(article))
    first = found.groupBy("doc_id", "unit_id").agg(F.min_by(F.struct("kind", "text", "covered"), F.struct("a", "k")).alias("u"))
    named = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce("name", F.lit("")).alias("name"), F.coalesce("link", F.lit("")).alias("link"))
    out = wanted.withColumn("doc_id", F.col("doc_id").cast("string")).join(first, ["doc_id", "unit_id"], "left").join(named, "doc_id", "left")
    kind = F.when(F.col("u").isNull(), F.raise_error(F.concat(F.lit("no such unit: "), "unit_id")).cast("string")).otherwise(F.col("u.kind"))
    number = F.regexp_extract(F.coalesce("name", F.lit("")), NAME_NUMBER, 0)
    return out.select(*[c for c in wanted.columns], kind.alias("kind"), F.col("u.text").alias("text"), F.col("u.covered").alias("covered"), "name", "link", number.alias("document_number"))


# --- fixed value: a document's number within its name --------------------------------------------------------------------
NAME_NUMBER = r"(?U)\b\d{1,4}/\d{4}/[\wĐđ-]+"
