"""Local alignment of answers to units, and weak labels from it. The alignment is an Arrow function; the rest is SQL."""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ranklake.functions import text as X
from ranklake.functions.shipping import ship

MATCH, MISMATCH, GAP = 2, -1, -1
SPAN = "struct<span string, score double>"

# --- fixed values: markers of quoted and amended law --------------------------------------------------------------------
AMENDED = r"(?iU)Trước đây,?\s*(?:căn cứ|theo)?.*?quy định như sau:?"
QUOTE_OPENS = r"(?iU)như sau:?\s*"
QUOTE_ENDS = r"(?iU)(?:Theo đó|Như vậy|Tóm lại)\b"
QUOTE_WORDS = 5
# ------------------------------------------------------------------------------------------------------------------------


def matrix(a: list[str], b: list[str]) -> np.ndarray:
    """Local alignment scores of all prefixes, by anti-diagonals: each is one vector operation."""
    code: dict[str, int] = {}
    x = np.array([code.setdefault(t, len(code)) for t in a])
    y = np.array([code.setdefault(t, len(code)) for t in b])
    n, m = len(x), len(y)
    h = np.zeros((n + 1, m + 1), np.int32)
    flat, width = h.ravel(), m + 1
    for d in range(2, n + m + 1):
        i = np.arange(max(1, d - m), min(n, d - 1) + 1)
        at = i * width + (d - i)
        same = np.where(x[i - 1] == y[d - i - 1], MATCH, MISMATCH)
        flat[at] = np.maximum(0, np.maximum(flat[at - width - 1] + same, np.maximum(flat[at - width], flat[at - 1]) + GAP))
    return h


def best_cell(a: list[str], b: list[str]) -> tuple[int, int, int]:
    """The largest score of ``matrix`` and the first cell by rows that has it; one row of scores is held at a time."""
    code: dict[str, int] = {}
    x = [code.setdefault(t, len(code)) for t in a]
    y = np.array([code.setdefault(t, len(code)) for t in b])
    steps = np.arange(len(y) + 1)
    above, best, at = np.zeros(len(y) + 1, np.int64), 0, (0, 0)
    for i, t in enumerate(x, 1):
        row = np.zeros(len(y) + 1, np.int64)
        row[1:] = np.maximum(0, np.maximum(above[:-1] + np.where(y == t, MATCH, MISMATCH), above[1:] + GAP))
        above = np.maximum.accumulate(row - GAP * steps) + GAP * steps
        j = int(above.argmax())
        if above[j] > best:
            best, at = int(above[j]), (i, j)
    return best, *at


def align(answer: str | None, unit: str | None) -> tuple[str, float]:
    """The span of the unit that the answer's words align to best, and its score out of a perfect one.

    The first largest cell by rows is the end; the way back prefers diagonal, then up, then left. An alignment of i words
    with a positive score has fewer than 2i gaps, so the way back stays within 3i words of the unit: scores of all cells are
    held for these only.
    """
    text = unicodedata.normalize("NFC", unit or "")
    a = unicodedata.normalize("NFC", answer or "").split()
    words = [(m[0], m.start(), m.end()) for m in re.finditer(r"\S+", text)]
    if not a or not words:
        return "", 0.0
    b = [w for w, _, _ in words]
    best, i, j = best_cell(a, b)
    if not best:
        return "", 0.0
    at = max(0, j - 3 * i)
    b, words, j = b[at:j], words[at:j], j - at
    h = matrix(a[:i], b)
    end = j
    while i and j and h[i, j]:
        here = h[i, j]
        if here == h[i - 1, j - 1] + (MATCH if a[i - 1] == b[j - 1] else MISMATCH):
            i, j = i - 1, j - 1
        elif here == h[i - 1, j] + GAP:
            i -= 1
        else:
            j -= 1
    if j >= end:
        return "", 0.0
    return text[words[j][1] : words[end - 1][2]], min(1.0, best / (MATCH * len(a)))


def aligned(answer: Column, unit: Column) -> Column:
    """struct<span, score>."""

    ship(SparkSession.active())

    @F.pandas_udf(SPAN)
    def udf(a: pd.Series, u: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([align(x, y) for x, y in zip(a, u, strict=True)], columns=["span", "score"])

    return udf(answer, unit)


def parts(answers: DataFrame, text: str = "answer") -> DataFrame:
    """(qid, part_no, part, role): an answer cut before the first passage on law that was in force; null role without one."""
    c = F.coalesce(F.col(text), F.lit(""))
    before = F.element_at(F.split(c, AMENDED, 2), 1)
    later = F.substring(c, F.length(before) + 1, F.length(c))
    cut = c.rlike(AMENDED)
    both = F.filter(F.array(F.struct(F.lit("current").alias("role"), X.strip(before).alias("part")), F.struct(F.lit("previous").alias("role"), X.strip(later).alias("part"))), lambda p: p["part"] != "")
    one = F.array(F.struct(F.lit(None).cast("string").alias("role"), X.strip(c).alias("part")))
    return answers.select("qid", F.posexplode(F.when(cut, both).otherwise(one)).alias("part_no", "p")).select("qid", "part_no", "p.part", "p.role")


def quote_core(part: Column) -> Column:
    """What is quoted: after the words that open a quotation and before those that conclude; the part where that is empty."""
    opened = F.element_at(F.split(part, QUOTE_OPENS, 2), -1)
    core = X.strip(F.element_at(F.split(opened, QUOTE_ENDS, 2), 1))
    return F.when(part.rlike(QUOTE_OPENS) & (core != ""), core).otherwise(part)


def best_alignment(pairs: DataFrame, answer: str = "part", unit: str = "text", emit: float = 0.3, trust: float = 0.6, by: tuple[str, ...] = ("qid", "part_no")) -> DataFrame:
    """Of each part's candidate units the best aligned one, the first by rank of equals, where its score is ``emit`` or more."""
    scored = pairs.where(X.token_count(F.col(answer)) >= QUOTE_WORDS).withColumn("__a", aligned(F.col(answer), F.col(unit)))
    scored = scored.withColumn("span", F.col("__a.span")).withColumn("confidence", F.round("__a.score", 9)).drop("__a")
    w = W.partitionBy(*by).orderBy(F.col("confidence").desc(), "rank")
    best = scored.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
    return best.where(F.col("confidence") >= emit).withColumn("trusted", F.col("confidence") >= trust)


def string_pairs(candidates: DataFrame, answer: str = "answer", text: str = "text", least: float = 0.45, gold_tokens: int = 10) -> DataFrame:
    """Training pairs without alignment: of each answer's candidates the unit with the largest F1 of token sets, from ``least``."""
    a, t = X.token_set(F.col(answer)), X.token_set(F.col(text))
    scored = candidates.where(X.token_count(F.col(answer)) >= gold_tokens).withColumn("f1", F.round(X.set_f1(a, t), 9))
    w = W.partitionBy("qid").orderBy(F.col("f1").desc(), "rank")
    return scored.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n").where(F.col("f1") >= least)


def hard_negatives(positives: DataFrame, units: DataFrame, n: int = 3, least_tokens: int = 20, most_coverage: float = 0.35) -> DataFrame:
    """(qid, row_id, nth): units near a positive (qid, row_id, doc_id, article_id, text) that aren't it.

    Of its article first, then of its document; those of the most similar length first. Units that hold much of the positive
    or are short are left out.
    """
    p = positives.select("qid", "doc_id", F.col("row_id").alias("__row"), F.col("article_id").alias("__article"), F.col("text").alias("__text"))
    near = p.join(units.select("doc_id", "row_id", "article_id", "text"), "doc_id").where("row_id <> __row")
    size, other = X.token_count(F.col("__text")), X.token_count(F.col("text"))
    near = near.where((other >= least_tokens) & (X.coverage(X.tokens(F.lower("__text")), X.tokens(F.lower("text"))) <= most_coverage))
    far = F.round(F.abs(F.log(other / F.greatest(size, F.lit(1)))), 9)
    w = W.partitionBy("qid").orderBy((F.col("article_id") != F.col("__article")).cast("int"), "__far", "row_id")
    return near.withColumn("__far", far).withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= n).select("qid", "row_id", "nth")


def agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """(n, both, same, share): labels (qid, unit_id) of two sources, compared where both have one."""
    x, y = (d.groupBy("qid").agg(F.collect_set("unit_id").alias(n)) for n, d in (("x", a), ("y", b)))
    j = x.join(y, "qid", "full")
    both = F.col("x").isNotNull() & F.col("y").isNotNull()
    same = both & F.arrays_overlap("x", "y")
    return j.agg(F.count(F.lit(1)).alias("n"), F.count_if(both).alias("both"), F.count_if(same).alias("same"), F.round(F.count_if(same) / F.nullif(F.count_if(both), F.lit(0)), 6).alias("share"))


def length_only(pairs: DataFrame, positive: str = "positive", negative: str = "negative") -> DataFrame:
    """How often the longer text is the positive: near a half if length gives nothing away."""
    p, n = X.token_count(F.col(positive)), X.token_count(F.col(negative))
    return pairs.agg(F.count(F.lit(1)).alias("n"), F.count_if(p > n).alias("longer"), F.count_if(p < n).alias("shorter"), F.round(F.avg((p > n).cast("int")), 6).alias("share"))


def control_group(filtered: DataFrame, every: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """Rows of the filtered group, and n others of all rows by hash order, with their group."""
    others = every.join(filtered.select("qid"), "qid", "left_anti").orderBy(F.xxhash64("qid", F.lit(seed)), "qid").limit(n)
    return filtered.withColumn("group", F.lit("filtered")).unionByName(others.withColumn("group", F.lit("control")), allowMissingColumns=True)
