"""Exact dense retrieval: blocks of queries against batches of vectors, k best kept at every step."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

DIGITS = 9
#: Queries in one block: its matrix is what each task holds, and bounds the broadcast.
QUERY_BLOCK = 2048


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalised(v: Column) -> Column:
    size = F.sqrt(dot(v, v))
    return F.when(size > 0, F.transform(v, lambda x: x.cast("double") / size))


def top_k(queries: DataFrame, vectors: DataFrame, k: int, qid: str = "qid", key: str = "row_id", vec: str = "vec", exclude_self: bool = False) -> DataFrame:
    """(qid, key, score, rank): the k vectors with the largest inner products; ties go by key.

    Queries come in blocks; each batch of vectors is multiplied with a block and keeps k a query, then partitions are merged.
    No pair but those kept leaves a task.
    """
    spark = vectors.sparkSession
    numbered = queries.select(F.col(qid).alias("qid"), F.col(vec).alias("qvec"))
    blocks = max(1, -(-numbered.count() // QUERY_BLOCK))
    parts = []
    key_type = vectors.schema[key].dataType.simpleString()
    qid_type = queries.schema[qid].dataType.simpleString()
    for n in range(blocks):
        block = numbered if blocks == 1 else numbered.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == n)
        rows = block.collect()  # about QUERY_BLOCK vectors
        if not rows:
            continue
        ids = np.array([r["qid"] for r in rows])
        known = spark.sparkContext.broadcast((ids, np.array([r["qvec"] for r in rows], dtype=np.float64)))

        def best(batches: Iterator[pd.DataFrame], known=known) -> Iterator[pd.DataFrame]:
            ids, q = known.value
            for b in batches:
                if not len(b):
                    continue
                keys = b[key].to_numpy()
                s = np.round(q @ np.stack(b[vec].to_numpy()).astype(np.float64).T, DIGITS)
                if exclude_self:
                    s[ids[:, None] == keys[None, :]] = -np.inf
                order = np.lexsort((np.broadcast_to(keys, s.shape), -s), axis=1)[:, :k]
                score = np.take_along_axis(s, order, axis=1)
                live = np.isfinite(score).ravel()
                yield pd.DataFrame({"qid": np.repeat(ids, order.shape[1])[live], key: keys[order].ravel()[live], "score": score.ravel()[live]})

        parts.append(vectors.select(key, vec).where(F.col(vec).isNotNull()).mapInPandas(best, f"qid {qid_type}, {key} {key_type}, score double"))
    if not parts:
        return spark.createDataFrame([], f"qid {qid_type}, {key} {key_type}, score double, rank int")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    w = W.partitionBy("qid").orderBy(F.col("score").desc(), key)
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def rescore(candidates: DataFrame, queries: DataFrame, vectors: DataFrame, key: str = "row_id") -> DataFrame:
    """Candidates (qid, unit_id, key, score) with the cosine of unit vectors; those without a vector keep their score.

    The vector comes by ``key``; where that is null, by unit_id, of repeated ids the last row.
    """
    by_id = vectors.groupBy("unit_id").agg(F.max_by("vec", key).alias("id_vec"))
    by_key = vectors.select(key, F.col("vec").alias("key_vec"))
    joined = candidates.join(queries.select("qid", F.col("vec").alias("qvec")), "qid", "left").join(by_key, key, "left").join(by_id, "unit_id", "left")
    new = F.round(dot(F.col("qvec"), F.coalesce("key_vec", "id_vec")), DIGITS)
    out = joined.withColumn("score", F.coalesce(new, "score")).drop("qvec", "key_vec", "id_vec", "rank")
    return out.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy(F.col("score").desc(), "unit_id", key)))


def unit_positions(vectors: DataFrame, key: str = "row_id") -> DataFrame:
    """(unit_id, key, n): the last row of each unit id and how many rows share it."""
    return vectors.groupBy("unit_id").agg(F.max(key).alias(key), F.count(F.lit(1)).alias("n"))


def collapse(hits: DataFrame, to: str = "doc_id", k: int = 100) -> DataFrame:
    """(qid, to, rank): documents in the order of their first unit."""
    first = hits.groupBy("qid", to).agg(F.min("rank").alias("best"))
    return first.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy("best", to))).where(F.col("rank") <= k).select("qid", to, "rank")


def patch(old: DataFrame, new: DataFrame, key: str = "row_id") -> DataFrame:
    """Vectors with those of changed units replaced; all others stay."""
    return old.join(new.select(key, F.col("vec").alias("__new")), key, "left").withColumn("vec", F.coalesce("__new", "vec")).drop("__new")
