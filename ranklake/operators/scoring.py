"""METEOR (exact stage) and ROUGE-L of answers against references; Arrow functions, for they align token sequences."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ranklake.functions.shipping import ship


def meteor(reference: list[str], candidate: list[str], alpha: float = 0.9, beta: float = 3.0, gamma: float = 0.5) -> float:
    """Unigrams are matched from the end, each to the last free equal one; chunks are runs adjacent in both."""
    ref, cand = [t.lower() for t in reference], [t.lower() for t in candidate]
    free: dict[str, list[int]] = {}
    for j, t in enumerate(ref):
        free.setdefault(t, []).append(j)
    match = []
    for i in range(len(cand) - 1, -1, -1):
        at = free.get(cand[i])
        if at:
            match.append((i, at.pop()))
    m = len(match)
    if not m:
        return 0.0
    match.reverse()
    chunks = 1 + sum(b[0] != a[0] + 1 or b[1] != a[1] + 1 for a, b in zip(match, match[1:], strict=False))
    p, r = m / len(cand), m / len(ref)
    return p * r / (alpha * p + (1 - alpha) * r) * (1 - gamma * (chunks / m) ** beta)


def lcs(a: list, b: list) -> int:
    """Length of the longest common subsequence, a row at a time."""
    codes: dict = {}
    y = np.array([codes.setdefault(t, len(codes)) for t in b])
    row = np.zeros(len(b) + 1, np.int64)
    for t in a:
        hit = y == codes.get(t, -1)
        row[1:] = np.maximum.accumulate(np.where(hit, row[:-1] + 1, row[1:]))
    return int(row[-1]) if len(b) else 0


def rouge_tokens(text: str, ascii_only: bool = True) -> list[str]:
    """Lower-case alphanumeric tokens; the common library knows ASCII only and so drops diacritics."""
    return re.findall(r"[a-z0-9]+" if ascii_only else r"\w+", text.lower())


def rouge_l(reference: str, candidate: str, ascii_only: bool = True) -> float:
    a, b = rouge_tokens(reference, ascii_only), rouge_tokens(candidate, ascii_only)
    n = lcs(a, b) if a and b else 0
    return 2 * n / (len(a) + len(b)) if n else 0.0


def meteor_column(reference: Column, candidate: Column) -> Column:
    ship(SparkSession.active())

    @F.pandas_udf("double")
    def udf(r: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series([meteor((x or "").split(), (y or "").split()) for x, y in zip(r, c, strict=True)])

    return udf(reference, candidate)


def rouge_column(reference: Column, candidate: Column, ascii_only: bool = True) -> Column:
    ship(SparkSession.active())

    @F.pandas_udf("double")
    def udf(r: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series([rouge_l(x or "", y or "", ascii_only) for x, y in zip(r, c, strict=True)])

    return udf(reference, candidate)


def score_submission(predicted: DataFrame, reference: DataFrame) -> DataFrame:
    """(n, meteor, rouge): means over (id, answer) of both; fails where the ids differ."""
    n, m = predicted.count(), reference.count()
    if n != m:
        raise ValueError(f"{n} predictions for {m} references")
    if not predicted.join(reference, "id", "left_anti").isEmpty():
        raise ValueError("a prediction has an id without a reference")
    both = predicted.select("id", F.col("answer").alias("p")).join(reference.select("id", F.col("answer").alias("r")), "id")
    scored = both.select(meteor_column(F.col("r"), F.col("p")).alias("m"), rouge_column(F.col("r"), F.col("p")).alias("g"))
    return scored.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("m"), 6).alias("meteor"), F.round(F.avg("g"), 6).alias("rouge"))
