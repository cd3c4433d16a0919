"""Audits of repeated ids, packed contexts and the size of units; each is an aggregation to one row or a few."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ranklake.functions import text as X
from ranklake.operators.align import aligned
from ranklake.operators.metrics import bootstrap, values_at


def repeated_ids(units: DataFrame, key: str = "unit_id", within: str = "article_id", doc: str = "doc_id", order: str = "row_id") -> DataFrame:
    """(key, n, n_docs, place, identical, jaccard) of ids that several units bear, by the first and last of these in order.

    place: same_article, other_article or other_document. Ids are counted first, so only texts of repeated ones are shuffled.
    """
    repeated = units.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(key)
    by = units.join(repeated, key, "left_semi").groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct(doc).alias("n_docs"), (F.min(within) == F.max(within)).alias("one"), F.min_by("text", order).alias("a"), F.max_by("text", order).alias("b"),
    )
    place = F.when(F.col("n_docs") > 1, "other_document").when(F.col("one"), "same_article").otherwise("other_article")
    alike = F.round(X.jaccard(X.token_set(F.lower("a")), X.token_set(F.lower("b"))), 9)
    return by.select(key, "n", "n_docs", place.alias("place"), (X.strip(F.col("a")) == X.strip(F.col("b"))).alias("identical"), alike.alias("jaccard"))


def repeated_id_damage(repeated: DataFrame) -> DataFrame:
    """One row over ``repeated_ids``: where they stand, how many texts differ, and the Jaccard similarity of those that do."""
    places = [F.count_if(F.col("place") == p).alias(p) for p in ("same_article", "other_article", "other_document")]
    differ = ~F.col("identical")
    counts = repeated.agg(
        F.count(F.lit(1)).alias("ids"), *places, F.count_if("identical").alias("identical"), F.count_if(differ).alias("differ"), F.count_if(differ & (F.col("jaccard") == 0)).alias("disjoint"),
        F.round(F.avg(F.when(differ, F.col("jaccard"))), 6).alias("mean"),
    )
    n = F.col("n")
    at = {"p10": F.floor(n / 10), "low": F.floor((n - 1) / 2), "high": F.floor(n / 2), "p90": F.floor(9 * n / 10)}
    levels = values_at(repeated.where(differ), "jaccard", at).select(F.round("p10", 6).alias("p10"), F.round((F.col("low") + F.col("high")) / 2, 6).alias("median"), F.round("p90", 6).alias("p90"))
    return counts.crossJoin(F.broadcast(levels))  # one row each


def most_repeated(repeated: DataFrame, k: int = 10, key: str = "unit_id") -> DataFrame:
    """The k ids that most units bear; of equals the last by id first."""
    return repeated.orderBy(F.col("n").desc(), F.col(key).desc()).limit(k).select(key, "n", "n_docs")


def basket_impact(run: DataFrame, repeated: DataFrame, key: str = "unit_id") -> DataFrame:
    """One row: places that each query's basket loses where ids come more than once, and its rows whose id is a repeated one."""
    marked = run.join(repeated.select(key).distinct().withColumn("dup", F.lit(1)), key, "left")
    by = marked.groupBy("qid").agg((F.count(F.lit(1)) - F.countDistinct(key)).alias("lost"), F.count("dup").alias("dup_rows"))
    n = F.col("n")
    levels = values_at(by, "lost", {"median": F.floor(n / 2), "p90": F.floor(9 * n / 10)}).drop("n")
    whole = by.agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("lost"), 6).alias("mean"), F.max("lost").alias("most"), F.count_if(F.col("lost") >= 1).alias("lost_one"), F.count_if(F.col("lost") >= 5).alias("lost_five"),
        F.round(F.avg("dup_rows"), 6).alias("mean_dup_rows"), F.min(F.struct(-F.col("lost"), "qid"))["qid"].alias("worst"),
    )
    return whole.crossJoin(F.broadcast(levels))


def best_coverages(answers: DataFrame, hits: DataFrame, parsed: DataFrame, answer: str = "answer", least_tokens: int = 10) -> DataFrame:
    """(qid, clause, article): of the documents hit (qid, doc_id), the largest share of an answer's tokens that one clause or one
    article holds; 0 where nothing is hit. Answers of fewer tokens are left out."""
    gold = answers.select("qid", X.tokens(F.lower(answer)).alias("gold")).where(F.size("gold") >= least_tokens)
    found = parsed.join(hits.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", F.inline("articles"))
    texts = found.select("doc_id", X.tokens(F.lower("text")).alias("whole"), F.transform("clauses", lambda k: X.tokens(F.lower(k["text"]))).alias("parts"))
    each = gold.join(hits.select("qid", "doc_id").distinct(), "qid").join(texts, "doc_id")
    scored = each.select("qid", X.coverage(F.col("gold"), F.col("whole")).alias("article"), F.array_max(F.transform("parts", lambda p: X.coverage(F.col("gold"), p))).alias("clause"))
    best = scored.groupBy("qid").agg(F.max("clause").alias("clause"), F.max("article").alias("article"))
    zero = F.lit(0.0)
    return gold.select("qid").join(best, "qid", "left").select("qid", F.round(F.coalesce("clause", zero), 9).alias("clause"), F.round(F.coalesce("article", zero), 9).alias("article"))


def aligned_scores(pairs: DataFrame, part: str = "part", clause: str = "text", article: str = "article_text") -> DataFrame:
    """pairs with clause and article: the scores at which the part aligns to its clause and to the whole article."""
    return pairs.withColumn("clause", aligned(F.col(part), F.col(clause))["score"]).withColumn("article", aligned(F.col(part), F.col(article))["score"])


def chunking_ceiling(scores: DataFrame, big: float = 0.10, tiny: float = 0.02, levels: tuple[float, ...] = (0.80, 0.90, 0.95)) -> DataFrame:
    """One row over (clause, article): means, gains of ``big`` or more and under ``tiny``, and how many reach each level."""
    gain = F.round(F.col("article") - F.col("clause"), 9)
    reach = [F.count_if(F.col(c) >= v).alias(f"{c}_{round(100 * v)}") for v in levels for c in ("clause", "article")]
    return scores.agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("clause"), 6).alias("mean_clause"), F.round(F.avg("article"), 6).alias("mean_article"), F.round(F.avg(gain), 6).alias("mean_gain"),
        F.count_if(gain >= big).alias("needs_article"), F.count_if(gain < tiny).alias("clause_enough"), *reach,
    )


def build_report(questions: DataFrame, contexts: DataFrame, repeated: DataFrame, expected_median: int, most_shift: int = 90, floor: int = 250, ceiling: int = 1200, most_untitled: float = 0.10) -> DataFrame:
    """One row that checks packages: questions (qid, answer), contexts (qid, text, title, unit_id), repeated ids (unit_id).

    Counts of questions, of those without a context and with an answer, of contexts, shares of untitled contexts and of those with
    a repeated id, lengths in tokens a question, and whether titles, answers and the median are as they should be.
    """
    size = X.token_count(F.col("text")).cast("long")
    marked = contexts.join(repeated.select("unit_id").distinct().withColumn("dup", F.lit(1)), "unit_id", "left")
    by = marked.groupBy("qid").agg(
        F.count(F.lit(1)).alias("contexts"), F.count_if(X.strip(F.coalesce("title", F.lit(""))) == "").alias("untitled"), F.count("dup").alias("dup"), F.sum(size).alias("total"),
    )
    zero = F.lit(0).cast("long")
    rows = questions.select("qid", F.col("answer").isNotNull().alias("answered")).join(by, "qid", "left").select("qid", "answered", *[F.coalesce(c, zero).alias(c) for c in ("contexts", "untitled", "dup", "total")])
    n = F.col("n")
    levels = values_at(rows, "total", {"p10": F.floor(n / 10), "median": F.floor(n / 2), "p90": F.floor(9 * n / 10)}).drop("n")
    share = lambda c: F.coalesce(F.round(F.sum(c) / F.nullif(F.sum("contexts"), zero), 6), F.lit(0.0))
    whole = rows.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("contexts") == 0).alias("without_context"), F.count_if("answered").alias("answered"), F.coalesce(F.sum("contexts"), zero).alias("contexts"),
        share("untitled").alias("untitled"), share("dup").alias("repeated_ids"), F.round(F.avg("total"), 6).alias("mean"),
        F.round(F.avg((F.col("total") < floor).cast("int")), 6).alias("below"), F.round(F.avg((F.col("total") > ceiling).cast("int")), 6).alias("above"),
    )
    out = whole.crossJoin(F.broadcast(levels)).withColumn("shift", F.col("median") - expected_median)
    titles = (F.col("contexts") > 0) & (F.col("untitled") < most_untitled)
    return out.withColumns({"titles_ok": titles, "answers_ok": F.col("answered") == F.col("n"), "median_ok": F.coalesce(F.abs("shift") <= most_shift, F.lit(False))})


def rescored_ceiling(candidates: DataFrame, score: Callable[[Column, Column], Column], gold: str = "question", text: str = "text", pool: int = 10) -> DataFrame:
    """(qid, first_value, best_value, best_ranks): the score of the first two texts joined, and of the pair that greed finds.

    Of the first ``pool`` candidates the one with the best score is taken, then the one that makes the best joined text with it, both
    in the order of rank; of equals the first. Blank texts add nothing.
    """
    inside = candidates.where(F.col("rank") <= pool).select("qid", "rank", F.col(gold).alias("g"), X.strip(F.coalesce(text, F.lit(""))).alias("t"))

    def joined(a: Column, b: Column) -> Column:
        return F.array_join(F.filter(F.array(a, b), lambda x: x != ""), "\n\n")

    w = W.partitionBy("qid")
    single = inside.withColumn("v", F.round(score(F.col("g"), F.col("t")), 9))
    one = single.withColumn("k", F.row_number().over(w.orderBy(F.col("v").desc(), "rank"))).where("k = 1").select("qid", F.col("rank").alias("r1"), F.col("t").alias("t1"), F.col("v").alias("v1"))
    others = inside.join(one, "qid").where("rank <> r1")
    pair = F.when(F.col("rank") < F.col("r1"), joined(F.col("t"), F.col("t1"))).otherwise(joined(F.col("t1"), F.col("t")))
    two = others.withColumn("p", pair).withColumn("v2", F.round(score(F.col("g"), F.col("p")), 9)).withColumn("k", F.row_number().over(w.orderBy(F.col("v2").desc(), "rank"))).where("k = 1").select("qid", F.col("rank").alias("r2"), "v2")
    firsts = inside.where("rank <= 2").groupBy("qid").agg(F.max("g").alias("g"), F.transform(F.array_sort(F.collect_list(F.struct("rank", "t"))), lambda x: x["t"]).alias("ts"))
    first = firsts.withColumn("p", F.array_join(F.filter("ts", lambda x: x != ""), "\n\n")).withColumn("v", F.round(score(F.col("g"), F.col("p")), 9)).select("qid", F.col("v").alias("first_value"))
    ranks = F.array_join(F.array_sort(F.array_compact(F.array("r1", "r2"))), ",")
    return one.join(two, "qid", "left").join(first, "qid", "left").select("qid", "first_value", F.coalesce("v2", "v1").alias("best_value"), ranks.alias("best_ranks"))


def extra_text_penalty(answers: DataFrame, extras: DataFrame, score: Callable[[Column, Column], Column], group: str, seed: int = 42, resamples: int = 2000, most: int = 1_000) -> DataFrame:
    """(n, mean, low, high, loss): what an answer of one group (qid, answer, group) loses when a drawn text is put after it.

    Each answer draws one of at most ``most`` extras (text), by hash; these are the pool of the draw, a bounded list. loss is the
    share of the group among all answers times the mean loss.
    """
    drawn = extras.select("text").where(X.strip(F.coalesce("text", F.lit(""))) != "").orderBy(F.xxhash64("text", F.lit(seed)), "text").limit(most).agg(F.array_sort(F.collect_list("text")).alias("pool"))
    mine = answers.where(F.col("group") == group).crossJoin(F.broadcast(drawn)).where(F.size("pool") > 0)
    nth = F.pmod(F.xxhash64("qid", F.lit(seed)), F.size("pool")).cast("int")
    value = score(F.col("answer"), F.concat("answer", F.lit("\n"), F.get("pool", nth))) - 1.0
    ci = bootstrap(mine.select("qid", value.alias("value")), resamples=resamples, seed=seed)
    share = answers.agg((F.count_if(F.col("group") == group) / F.nullif(F.count(F.lit(1)), F.lit(0))).alias("share"))
    return ci.crossJoin(F.broadcast(share)).select("n", "mean", "low", "high", F.round(F.col("share") * F.abs("mean"), 6).alias("loss"))
