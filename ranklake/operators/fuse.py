"""Set operations and fusion of ranked lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def stacked(*lists: DataFrame) -> DataFrame:
    """Lists under each other with their number; columns that one lacks are null."""
    parts = [x.withColumn("list_no", F.lit(n)) for n, x in enumerate(lists)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def union(*lists: DataFrame, key: str = "unit_id", row: str | None = None) -> DataFrame:
    """Union of ranked lists without repeats: the first list that has a unit supplies its row, and ``rank`` runs on.

    With ``row``, units are told apart by that column where it isn't null; a unit that several lists have keeps the first
    list's columns and the first row number known.
    """
    every = stacked(*lists)
    if row:
        every = every.withColumn("__k", F.coalesce(F.col(row).cast("string"), F.concat(F.lit("u"), F.col(key).cast("string"))))
    else:
        every = every.withColumn("__k", F.col(key))
    w = W.partitionBy("qid", "__k").orderBy("list_no", "rank")
    once = every.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n", "__k")
    return once.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy("list_no", "rank", key)))


def rrf(*lists: DataFrame, key: str = "unit_id", k: int = 60, weights: tuple[float, ...] | None = None, rank_base: int = 1) -> DataFrame:
    """(qid, key, score, rank): the sum of weight / (k + rank) over the lists; ranks of the lists count from 1."""
    weights = weights or (1.0,) * len(lists)
    every = stacked(*[x.select("qid", key, "rank") for x in lists])
    weight = F.element_at(F.array(*map(F.lit, weights)), F.col("list_no") + 1)
    part = weight / (k + F.col("rank") - 1 + rank_base)
    found = every.groupBy("qid", key).agg(F.round(F.sum(part), 12).alias("score"), F.min(F.struct("list_no", "rank")).alias("__first"))
    w = W.partitionBy("qid").orderBy(F.col("score").desc(), "__first", key)
    return found.withColumn("rank", F.row_number().over(w)).drop("__first")


def blend(run: DataFrame, alpha: float, k: int = 60, key: str = "unit_id") -> DataFrame:
    """Weighted blend of dense_rank and rerank_rank, both from 0; ties keep the order of rerank_rank; alpha 0 is that order."""
    if alpha == 0:
        score = -F.col("rerank_rank").cast("double")
    else:
        missing = F.raise_error("dense_rank is missing").cast("double")
        score = F.when(F.col("dense_rank").isNull(), missing).otherwise(F.round(alpha / (k + F.col("dense_rank")) + (1 - alpha) / (k + F.col("rerank_rank")), 12))
    w = W.partitionBy("qid").orderBy(F.col("blend").desc(), "rerank_rank", key)
    return run.withColumn("blend", score).withColumn("rank", F.row_number().over(w))


def linear_blend(run: DataFrame, alpha: float, key: str = "unit_id") -> DataFrame:
    """Order by alpha dense_rank + (1 - alpha) rerank_rank, the smallest first."""
    score = F.round(alpha * F.col("dense_rank") + (1 - alpha) * F.col("rerank_rank"), 12)
    w = W.partitionBy("qid").orderBy("blend", "rerank_rank", key)
    return run.withColumn("blend", score).withColumn("rank", F.row_number().over(w))


def window_blend(run: DataFrame, window: int, base: str = "dense_rank", score: str = "score", key: str = "unit_id") -> DataFrame:
    """Only the first ``window`` units of the base order (from 0) are ordered by score; the rest stay as they are."""
    inside = F.col(base) < window
    w = W.partitionBy("qid").orderBy((~inside).cast("int"), F.when(inside, -F.col(score)), base, key)
    return run.withColumn("rank", F.row_number().over(w))


def diverse(ranked: DataFrame, k: int, per_group: int | None = None, group: str = "doc_id") -> DataFrame:
    """The first k, with at most ``per_group`` of a group."""
    if per_group is not None:
        w = W.partitionBy("qid", group).orderBy("rank")
        ranked = ranked.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= per_group).drop("__n")
    return ranked.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy("rank"))).where(F.col("rank") <= k)


def label_union(a: DataFrame, b: DataFrame) -> DataFrame:
    """(qid, source, ids) of two sets of labels (qid, ids): agree, a_only, b_only, disagree or none.

    Labels that agree or come from one side are united; of labels that disagree neither is taken.
    """
    x, y = a.select("qid", F.col("ids").alias("ia")), b.select("qid", F.col("ids").alias("ib"))
    none = F.array().cast(a.schema["ids"].dataType)
    both = x.join(y, "qid", "full").withColumn("ia", F.coalesce("ia", none)).withColumn("ib", F.coalesce("ib", none))
    has_a, has_b = F.size("ia") > 0, F.size("ib") > 0
    source = F.when(has_a & has_b & F.arrays_overlap("ia", "ib"), "agree").when(has_a & has_b, "disagree").when(has_a, "a_only").when(has_b, "b_only").otherwise("none")
    return both.select("qid", source.alias("source"), F.array_sort(F.when(source == "disagree", none).otherwise(F.array_union("ia", "ib"))).alias("ids"))


def gold_union(*labels: DataFrame, key: str = "unit_id") -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), [x.select("qid", key) for x in labels]).distinct()


def split_membership(tuned: DataFrame, held_out: DataFrame, every: DataFrame, key: str = "qid") -> DataFrame:
    """(key, part): tuned, held_out, both (a leak) or untouched."""
    t, h = (x.select(key).distinct().withColumn(n, F.lit(True)) for n, x in (("t", tuned), ("h", held_out)))
    part = F.when(F.col("t") & F.col("h"), "both").when(F.col("t"), "tuned").when(F.col("h"), "held_out").otherwise("untouched")
    return every.select(key).distinct().join(t, key, "left").join(h, key, "left").select(key, part.alias("part"))
