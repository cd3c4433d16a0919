"""Ranking metrics, percentiles, bucket tables, comparisons and resampling."""

from __future__ import annotations

import random
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def query_stats(run: DataFrame, gold: DataFrame, key: str = "unit_id") -> DataFrame:
    """(qid, ranks, n_gold): sorted ranks at which gold was found; queries without a run keep an empty list.

    Repeated ids in the gold or the run count once (the first rank).
    """
    wanted = gold.where(F.col(key).isNotNull()).select("qid", key).distinct()
    best = run.groupBy("qid", key).agg(F.min("rank").alias("rank"))
    return wanted.join(best, ["qid", key], "left").groupBy("qid").agg(F.array_sort(F.collect_list("rank")).alias("ranks"), F.count(F.lit(1)).alias("n_gold"))


def found_at(k: Column) -> Column:
    return F.size(F.filter("ranks", lambda r: r <= k))


def hit(k: Column) -> Column:
    return F.avg((found_at(k) > 0).cast("int"))


def recall_micro(k: Column) -> Column:
    return F.sum(found_at(k)) / F.sum("n_gold")


def recall_strict(k: Column) -> Column:
    """Share of queries all of whose gold is found."""
    return F.avg((found_at(k) == F.col("n_gold")).cast("int"))


def reciprocal(k: Column | None = None) -> Column:
    first = F.get("ranks", F.lit(0))
    ok = first.isNotNull() if k is None else first.isNotNull() & (first <= k)
    return F.avg(F.when(ok, 1 / first).otherwise(F.lit(0.0)))


def ndcg(k: Column) -> Column:
    """Binary gain, logarithm to base 2."""
    gain = F.aggregate(F.filter("ranks", lambda r: r <= k), F.lit(0.0), lambda s, r: s + 1 / F.log2(r + 1))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n_gold"), k).cast("int")), F.lit(0.0), lambda s, r: s + 1 / F.log2(r + 1))
    return F.avg(gain / ideal)


def evaluate(run: DataFrame, gold: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 10, 50), key: str = "unit_id", digits: int = 6) -> DataFrame:
    """(k, n_queries, hit, recall_micro, recall_strict, mrr, ndcg), one row a cut; one pass over the queries."""
    stats = query_stats(run, gold, key).withColumn("k", F.explode(F.array(*map(F.lit, ks))))
    k = F.col("k")
    metrics = {"hit": hit(k), "recall_micro": recall_micro(k), "recall_strict": recall_strict(k), "mrr": reciprocal(k), "ndcg": ndcg(k)}
    return stats.groupBy("k").agg(F.count(F.lit(1)).alias("n_queries"), *[F.round(m, digits).alias(n) for n, m in metrics.items()])


def values_at(values: DataFrame, value: str, positions: dict[str, Column], bins: int = 4096) -> DataFrame:
    """One row (n, a column for each position): the values at these indices, from 0 on, of all sorted ones; n stands for their number.

    Values are counted, counts are summed by ``bins`` equal ranges, and only ranges that hold a wanted index are ordered: each in a
    task of its own, none with all values.
    """
    counts = values.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    ends = counts.agg(F.min("v").alias("least"), F.max("v").alias("largest"), F.sum("c").alias("n"))
    width = (F.col("largest") - F.col("least")).cast("double")
    part = F.when(width > 0, F.least(F.floor((F.col("v") - F.col("least")) / width * bins), F.lit(bins - 1))).otherwise(F.lit(0))
    placed = counts.crossJoin(F.broadcast(ends)).select("v", "c", "n", part.cast("int").alias("bin"))
    sums = placed.groupBy("bin").agg(F.sum("c").alias("s"), F.max("n").alias("n"))  # ``bins`` rows at most
    upto = sums.withColumn("before", F.sum("s").over(W.orderBy("bin")) - F.col("s"))
    holds = F.lit(False)
    for at in positions.values():
        holds |= (at >= F.col("before")) & (at < F.col("before") + F.col("s"))
    wanted = upto.where(holds).select("bin", "before")
    rows = placed.join(F.broadcast(wanted), "bin").withColumn("upto", F.col("before") + F.sum("c").over(W.partitionBy("bin").orderBy("v")))
    return rows.agg(F.max("n").alias("n"), *[F.min(F.when(F.col("upto") > at, F.col("v"))).alias(name) for name, at in positions.items()])


def floor_percentiles(values: DataFrame, value: str = "value", ps: tuple[int, ...] = (50, 90, 95, 99)) -> DataFrame:
    """(n, p50, ...): the value at index min(n - 1, floor(n p / 100)) of the sorted ones."""
    return values_at(values, value, {f"p{p}": F.least(F.col("n") - 1, F.floor(F.col("n") * p / 100)) for p in ps})


def length_stats(texts: DataFrame, size: Column, low: int, high: int) -> DataFrame:
    """(n, mean, p10, p50, p90, p99, below, above) of lengths: shares under ``low`` and over ``high``."""
    values = texts.select(size.cast("long").alias("value"))
    shares = values.agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.avg((F.col("value") < low).cast("int")), 6).alias("below"), F.round(F.avg((F.col("value") > high).cast("int")), 6).alias("above"))
    return floor_percentiles(values, ps=(10, 50, 90, 99)).crossJoin(F.broadcast(shares))


def rank_buckets(first_ranks: DataFrame, rank: str = "rank") -> DataFrame:
    """(bucket, label, n, share, cumulative) of first ranks: 1, 2-3, 4-10, 11-50, outside (null or beyond)."""
    r = F.col(rank)
    bucket = F.when(r <= 1, 1).when(r <= 3, 2).when(r <= 10, 3).when(r <= 50, 4).otherwise(5)
    names = F.element_at(F.array(*map(F.lit, ("1", "2-3", "4-10", "11-50", "outside"))), F.col("bucket"))
    counts = first_ranks.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))  # five rows at most
    total = F.sum("n").over(W.partitionBy(F.lit(0)))
    upto = F.sum("n").over(W.partitionBy(F.lit(0)).orderBy("bucket"))
    return counts.select("bucket", names.alias("label"), "n", F.round(F.col("n") / total, 6).alias("share"), F.round(upto / total, 6).alias("cumulative"))


def compare(a: DataFrame, b: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """(wins, losses, ties, mean_difference) of b against a by query, both (qid, value)."""
    d = a.select("qid", F.col("value").alias("x")).join(b.select("qid", F.col("value").alias("y")), "qid").select((F.col("y") - F.col("x")).alias("d"))
    return d.agg(
        F.count_if(F.col("d") > tolerance).alias("wins"), F.count_if(F.col("d") < -tolerance).alias("losses"), F.count_if(F.abs("d") <= tolerance).alias("ties"), F.round(F.avg("d"), 6).alias("mean_difference")
    )


def bootstrap(differences: DataFrame, value: str = "value", resamples: int = 2000, seed: int = 42, exact: bool = False, order: str = "qid") -> DataFrame:
    """(n, mean, low, high): mean of paired differences and the values at 2.5 and 97.5 % of the resampled means.

    The distributed form draws each row a Poisson(1) number of times in each resample, from hashes, so that rows never meet:
    sums and counts are aggregated by resample. The exact form draws with Python's generator in the order of ``order``, on one
    task: for evaluation sets that fit there.
    """
    if exact:

        def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            rows = pd.concat(list(batches)).sort_values("k")["v"].tolist()
            rng, n, means = random.Random(seed), len(rows), []
            if not n:
                return
            for _ in range(resamples):
                means.append(sum(rows[rng.randrange(n)] for _ in range(n)) / n)
            means.sort()
            yield pd.DataFrame({"n": [n], "mean": [sum(rows) / n], "low": [means[int(0.025 * resamples)]], "high": [means[int(0.975 * resamples)]]})

        one = differences.select(F.col(order).alias("k"), F.col(value).cast("double").alias("v")).coalesce(1)
        return one.mapInPandas(draw, "n long, mean double, low double, high double")
    u = (F.pmod(F.xxhash64(F.col(order), F.col("b"), F.lit(seed)), F.lit(1 << 30)) + 0.5) / (1 << 30)
    # The distribution function of Poisson(1), to nine draws.
    bounds, p, upto = [], 0.36787944117144233, 0.0
    for k in range(10):
        upto += p
        bounds.append(upto)
        p /= k + 1
    times = F.lit(10)
    for k in range(9, -1, -1):
        times = F.when(F.col("u") <= bounds[k], k).otherwise(times)
    rows = differences.select(order, F.col(value).cast("double").alias("v"))
    drawn = rows.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1)))).withColumn("u", u).withColumn("t", times)
    means = drawn.groupBy("b").agg((F.sum(F.col("t") * F.col("v")) / F.greatest(F.sum("t"), F.lit(1))).alias("m"))
    ends = means.agg(F.array_sort(F.collect_list("m")).alias("m"))  # ``resamples`` numbers
    whole = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean"))
    low, high = (F.element_at("m", F.lit(int(q * resamples) + 1)) for q in (0.025, 0.975))
    return whole.crossJoin(F.broadcast(ends)).select("n", F.round("mean", 6).alias("mean"), F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


def two_fold(values: DataFrame, param: str = "param", fold: Column | None = None) -> DataFrame:
    """(fold, param, own_mean, other_mean, n): the parameter best on each half, by mean, and its mean on the other half."""
    half = F.pmod(F.xxhash64("qid"), F.lit(2)).cast("int") if fold is None else fold
    means = values.withColumn("fold", half).groupBy("fold", param).agg(F.avg("value").alias("m"), F.count(F.lit(1)).alias("n"))
    w = W.partitionBy("fold").orderBy(F.round("m", 9).desc(), param)
    best = means.withColumn("r", F.row_number().over(w)).where("r = 1").select("fold", param, F.col("m").alias("own"))
    other = means.select((1 - F.col("fold")).alias("fold"), param, F.col("m").alias("other"), "n")
    return best.join(other, ["fold", param]).select("fold", param, F.round("own", 6).alias("own_mean"), F.round("other", 6).alias("other_mean"), "n")


def sweep(cases: DataFrame, grid: DataFrame, value: Column, by: tuple[str, ...]) -> DataFrame:
    """Mean of ``value`` over all cases for each row of a small grid of parameters."""
    n = grid.count()
    if n > 10_000:
        raise ValueError("a grid has at most 10,000 rows")
    return cases.crossJoin(F.broadcast(grid)).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(value), 6).alias("mean"))


def thresholds(values: DataFrame, levels: tuple[float, ...] = (0.70, 0.80, 0.90, 0.95), value: str = "value", by: tuple[str, ...] = ()) -> DataFrame:
    """(by, level, n, share): how many values reach each level."""
    rows = values.withColumn("level", F.explode(F.array(*map(F.lit, levels))))
    return rows.groupBy(*by, "level").agg(F.count_if(F.col(value) >= F.col("level")).alias("n"), F.round(F.avg((F.col(value) >= F.col("level")).cast("int")), 6).alias("share"))


def sign_groups(pairs: DataFrame, old: str, new: str, *means: str, tolerance: float = 1e-9) -> DataFrame:
    """(sign, n, mean of each column) of cases that lose, stay or win."""
    d = F.col(new) - F.col(old)
    sign = F.when(d > tolerance, "win").when(d < -tolerance, "lose").otherwise("same")
    return pairs.groupBy(sign.alias("sign")).agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(m), 6).alias(m) for m in means])


def error_classes(run: DataFrame, gold: DataFrame, k: int, pool: int, key: str = "unit_id") -> DataFrame:
    """(qid, class): ok within k, rerank_miss within the pool, retrieval_miss outside, by the first gold unit."""
    first = F.get("ranks", F.lit(0))
    kind = F.when(first <= k, "ok").when(first <= pool, "rerank_miss").otherwise("retrieval_miss")
    return query_stats(run, gold, key).select("qid", kind.alias("class"), first.alias("first_rank"))


def duplicate_audit(units: DataFrame, key: str = "unit_id", within: str = "article_id") -> DataFrame:
    """(ids, rows, duplicated_ids, rows_with_one, shadowed, same_place): identity of units, one row."""
    by = units.groupBy(key).agg(F.count(F.lit(1)).alias("n"), (F.min(within) == F.max(within)).alias("same"), F.countDistinct(F.xxhash64("text")).alias("texts"))
    dup = F.col("n") > 1
    zero = F.lit(0).cast("long")
    return by.agg(
        F.count(F.lit(1)).alias("ids"), F.coalesce(F.sum("n"), zero).alias("rows"), F.count_if(dup).alias("duplicated_ids"), F.coalesce(F.sum(F.when(dup, F.col("n"))), zero).alias("rows_with_one"),
        F.coalesce(F.sum(F.when(dup, F.col("n") - 1)), zero).alias("shadowed"), F.count_if(dup & F.coalesce("same", F.lit(False))).alias("same_place"), F.count_if(dup & (F.col("texts") > 1)).alias("texts_differ"),
    )


def histogram(rows: DataFrame, by: str, name: str = "size") -> DataFrame:
    """(size, n): how many groups have so many rows."""
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias(name)).groupBy(name).agg(F.count(F.lit(1)).alias("n"))


def stratified(rows: DataFrame, bucket: Column, per_bucket: int, key: str, seed: int = 0) -> DataFrame:
    """A seeded sample of ``per_bucket`` rows of each bucket, by hash order."""
    w = W.partitionBy("bucket").orderBy(F.xxhash64(key, F.lit(seed)), key)
    return rows.withColumn("bucket", bucket).withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= per_bucket)


def hold_out(rows: DataFrame, key: str, share: float, seed: int = 0) -> DataFrame:
    """rows with a boolean ``held_out`` by a hash of the key: stable under added rows."""
    return rows.withColumn("held_out", F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1_000_000)) < int(share * 1_000_000))


def rates(rows: DataFrame, **flags: tuple[Column, Column | None]) -> DataFrame:
    """One row of rates: of each (flag, within) the share of flagged rows among those within; 0 where there are none."""
    out = []
    for name, (flag, within) in flags.items():
        base = F.count(F.lit(1)) if within is None else F.count_if(within)
        on = F.coalesce(flag, F.lit(False)) if within is None else F.coalesce(flag & within, F.lit(False))
        out.append(F.coalesce(F.round(F.count_if(on) / F.nullif(base, F.lit(0)), 6), F.lit(0.0)).alias(name))
    return rows.agg(*out)


def oracle_ceiling(candidates: DataFrame, value: str = "value", pool: int = 10, take: int = 2) -> DataFrame:
    """(qid, first_value, best_value): summed value of the first ``take`` and of the best ``take`` within the pool."""
    inside = candidates.where(F.col("rank") <= pool)
    best = W.partitionBy("qid").orderBy(F.col(value).desc(), "rank")
    ranked = inside.withColumn("b", F.row_number().over(best))
    return ranked.groupBy("qid").agg(F.round(F.sum(F.when(F.col("rank") <= take, F.col(value)).otherwise(0.0)), 6).alias("first_value"), F.round(F.sum(F.when(F.col("b") <= take, F.col(value)).otherwise(0.0)), 6).alias("best_value"))


def cutoff_loss(units: DataFrame, cap: int, start: str = "char_start") -> DataFrame:
    """(n, beyond, share): units that begin after the first ``cap`` characters of their document."""
    return units.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(start) >= cap).alias("beyond"), F.round(F.avg((F.col(start) >= cap).cast("int")), 6).alias("share"))


def contained(pairs: DataFrame, gold: str, context: str) -> DataFrame:
    """(n, hits, rate): contexts that hold the gold text."""
    ok = F.contains(F.col(context), F.col(gold))
    return pairs.agg(F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("hits"), F.round(F.avg(ok.cast("int")), 6).alias("rate"))
