"""Queries over ranking metrics, comparisons and audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ranklake.functions import text as X
from ranklake.operators import fuse, lookup, metrics, parse, scoring
from ranklake.plans.registry import query
from ranklake.plans.retrieval import DENSE_SQL, RUNS_SQL, dense_run, dense_vectors, dense_queries, first_run, two_runs
from ranklake.plans.tables import GOLD_SQL, LEGAL_SQL, documents, gold, parsed_legal, questions, table, toks

STATS_SQL = f"""{RUNS_SQL}, {GOLD_SQL},
st AS (SELECT qid, list_sort(list(rank) FILTER (WHERE rank IS NOT NULL)) AS ranks, count(*) AS n_gold FROM gold LEFT JOIN a USING (qid, doc_id) GROUP BY qid)"""


def _run_and_gold(spark, sf):
    a = first_run(spark, sf)
    return a, gold(spark, sf)


@query("gold_by_sentence", f"WITH {GOLD_SQL} SELECT qid, doc_id FROM gold")
def gold_by_sentence(spark, sf):
    return gold(spark, sf)


@query("query_stats", f"{STATS_SQL} SELECT qid, CAST(coalesce(len(ranks), 0) AS BIGINT) AS n_found, n_gold, CAST(ranks[1] AS INTEGER) AS first_rank FROM st")
def query_stats(spark, sf):
    s = metrics.query_stats(*_run_and_gold(spark, sf), key="doc_id")
    return s.select("qid", F.size("ranks").cast("long").alias("n_found"), "n_gold", F.get("ranks", F.lit(0)).alias("first_rank"))


@query(
    "ranking_metrics",
    f"""{STATS_SQL}, x AS (SELECT *, unnest([1, 3, 5, 10, 20]) AS k, coalesce(ranks, []) AS rs FROM st),
y AS (SELECT k, n_gold, list_filter(rs, lambda r: r <= k) AS f, list_transform(list_filter(rs, lambda r: r <= k), lambda r: 1 / log2(r + 1)) AS gains, list_transform(range(1, least(n_gold, k) + 1), lambda r: 1 / log2(r + 1)) AS ideals FROM x)
SELECT CAST(k AS INTEGER) AS k, count(*) AS n_queries, round(avg(CASE WHEN len(f) > 0 THEN 1 ELSE 0 END), 6) AS hit, round(sum(len(f)) / sum(n_gold), 6) AS recall_micro,
       round(avg(CASE WHEN len(f) = n_gold THEN 1 ELSE 0 END), 6) AS recall_strict, round(avg(coalesce(1 / f[1], 0)), 6) AS mrr, round(avg(coalesce(list_sum(gains), 0) / list_sum(ideals)), 6) AS ndcg FROM y GROUP BY k""",
)
def ranking_metrics(spark, sf):
    return metrics.evaluate(*_run_and_gold(spark, sf), ks=(1, 3, 5, 10, 20), key="doc_id")


@query(
    "label_metrics",
    f"""WITH {DENSE_SQL}, g AS (SELECT qid, vec_id AS row_id FROM (SELECT vec_id AS qid, label FROM embeddings WHERE vec_id % 100 = 0) JOIN embeddings USING (label) WHERE vec_id <> qid),
st AS (SELECT qid, list_sort(list(rank) FILTER (WHERE rank IS NOT NULL)) AS ranks, count(*) AS n_gold FROM g LEFT JOIN top USING (qid, row_id) GROUP BY qid)
SELECT CAST(k AS INTEGER) AS k, count(*) AS n_queries, round(avg(CASE WHEN len(list_filter(coalesce(ranks, []), lambda r: r <= k)) > 0 THEN 1 ELSE 0 END), 6) AS hit FROM (SELECT *, unnest([1, 10, 50]) AS k FROM st) GROUP BY k""",
)
def label_metrics(spark, sf):
    """Dense retrieval where vectors of the query's label are the gold."""
    v = dense_vectors(spark, sf).select("row_id", "doc_id")
    q = dense_queries(spark, sf).select(F.col("qid"), F.col("qid").alias("row_id")).join(v, "row_id").select("qid", "doc_id")
    g = q.join(v, "doc_id").where("row_id <> qid").select("qid", "row_id")
    return metrics.evaluate(dense_run(spark, sf), g, ks=(1, 10, 50), key="row_id").select("k", "n_queries", "hit")


@query("rank_percentiles", f"{STATS_SQL}, v AS (SELECT list_sort(list(ranks[1])) AS x, count(*) AS n FROM st WHERE len(ranks) > 0) SELECT n, " + ", ".join(f"x[CAST(least(n - 1, floor(n * {p} / 100)) AS INTEGER) + 1] AS p{p}" for p in (50, 90, 95, 99)) + " FROM v")
def rank_percentiles(spark, sf):
    s = metrics.query_stats(*_run_and_gold(spark, sf), key="doc_id").where(F.size("ranks") > 0)
    return metrics.floor_percentiles(s.select(F.get("ranks", F.lit(0)).cast("long").alias("value")))


@query(
    "rank_buckets",
    f"""{STATS_SQL}, bk AS (SELECT CASE WHEN ranks[1] <= 1 THEN 1 WHEN ranks[1] <= 3 THEN 2 WHEN ranks[1] <= 10 THEN 3 WHEN ranks[1] <= 50 THEN 4 ELSE 5 END AS bucket FROM st), bg AS (SELECT bucket, count(*) AS n FROM bk GROUP BY 1)
SELECT CAST(bucket AS INTEGER) AS bucket, ['1', '2-3', '4-10', '11-50', 'outside'][bucket] AS label, n, round(n / sum(n) OVER (), 6) AS share, round(sum(n) OVER (ORDER BY bucket) / sum(n) OVER (), 6) AS cumulative FROM bg""",
)
def rank_buckets(spark, sf):
    s = metrics.query_stats(*_run_and_gold(spark, sf), key="doc_id")
    return metrics.rank_buckets(s.select(F.get("ranks", F.lit(0)).alias("rank")))


@query(
    "length_stats",
    f"""WITH v AS (SELECT len({toks("text")}) AS x FROM documents), s AS (SELECT list_sort(list(x)) AS l, count(*) AS n, round(avg(x), 6) AS mean, round(avg(CASE WHEN x < 50 THEN 1 ELSE 0 END), 6) AS below, round(avg(CASE WHEN x > 1000 THEN 1 ELSE 0 END), 6) AS above FROM v)
SELECT CAST(n AS BIGINT) AS n, """ + ", ".join(f"CAST(l[CAST(least(n - 1, floor(n * {p} / 100)) AS INTEGER) + 1] AS BIGINT) AS p{p}" for p in (10, 50, 90, 99)) + ", mean, below, above FROM s",
)
def length_stats(spark, sf):
    return metrics.length_stats(documents(spark, sf), X.token_count(F.col("text")), 50, 1000)


@query("error_classes", f"{STATS_SQL} SELECT qid, CASE WHEN ranks[1] <= 3 THEN 'ok' WHEN ranks[1] <= 20 THEN 'rerank_miss' ELSE 'retrieval_miss' END AS class, CAST(ranks[1] AS INTEGER) AS first_rank FROM st")
def error_classes(spark, sf):
    return metrics.error_classes(*_run_and_gold(spark, sf), k=3, pool=20, key="doc_id")


REC_SQL = f"""{RUNS_SQL}, {GOLD_SQL}, ga AS (SELECT qid, coalesce(max(1.0 / a.rank), 0) AS x, coalesce(max(1.0 / b.rank), 0) AS y FROM gold LEFT JOIN a USING (qid, doc_id) LEFT JOIN b USING (qid, doc_id) GROUP BY qid)"""


def _reciprocal(run, g):
    s = metrics.query_stats(run, g, "doc_id")
    return s.select("qid", F.coalesce(1 / F.get("ranks", F.lit(0)), F.lit(0.0)).alias("value"))


@query("win_loss_tie", f"{REC_SQL} SELECT count_if(y - x > 1e-9) AS wins, count_if(y - x < -1e-9) AS losses, count_if(abs(y - x) <= 1e-9) AS ties, round(avg(CAST(y AS DOUBLE) - CAST(x AS DOUBLE)), 6) AS mean_difference FROM ga")
def win_loss_tie(spark, sf):
    a, b = two_runs(spark, sf)
    g = gold(spark, sf)
    return metrics.compare(_reciprocal(a, g), _reciprocal(b, g))


@query("paired_bootstrap")
def paired_bootstrap(spark, sf):
    """Confidence interval of the difference in reciprocal rank of two runs; resampling is by hash, which SQL engines differ in."""
    a, b = two_runs(spark, sf)
    g = gold(spark, sf)
    d = _reciprocal(a, g).withColumnRenamed("value", "x").join(_reciprocal(b, g), "qid").select("qid", (F.col("value") - F.col("x")).alias("value"))
    return metrics.bootstrap(d)


ALPHAS = (0.0, 0.3, 0.5, 0.7, 1.0)


def _alpha_values(spark, sf):
    """(qid, param, value): reciprocal rank of the gold for each weight of a linear blend."""
    a, b = two_runs(spark, sf)
    g = gold(spark, sf)
    both = a.select("qid", "doc_id", F.col("rank").alias("x")).join(b.select("qid", "doc_id", F.col("rank").alias("y")), ["qid", "doc_id"])
    rows = both.withColumn("param", F.explode(F.array(*map(F.lit, ALPHAS))))
    w = metrics.W.partitionBy("qid", "param").orderBy(F.round(F.col("param") * F.col("x") + (1 - F.col("param")) * F.col("y"), 9), "y", "doc_id")
    ranked = rows.withColumn("rank", F.row_number().over(w)).join(g, ["qid", "doc_id"], "left_semi")
    return ranked.groupBy("qid", "param").agg((1 / F.min("rank")).alias("value"))


ALPHA_SQL = f"""{RUNS_SQL}, {GOLD_SQL}, z AS (SELECT a.qid, a.doc_id, a.rank AS x, b.rank AS y, unnest(CAST([0.0, 0.3, 0.5, 0.7, 1.0] AS DOUBLE[])) AS param FROM a JOIN b ON a.qid = b.qid AND a.doc_id = b.doc_id),
zr AS (SELECT *, row_number() OVER (PARTITION BY qid, param ORDER BY round(param * x + (1 - param) * y, 9), y, doc_id) AS rank FROM z),
av AS (SELECT qid, param, CAST(1 AS DOUBLE) / min(rank) AS value FROM zr SEMI JOIN gold USING (qid, doc_id) GROUP BY ALL)"""


@query("alpha_sweep", f"{ALPHA_SQL} SELECT param, count(*) AS n, round(avg(value), 6) AS mean FROM av GROUP BY param")
def alpha_sweep(spark, sf):
    return _alpha_values(spark, sf).groupBy("param").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@query(
    "two_fold_choice",
    f"""{ALPHA_SQL}, m AS (SELECT qid % 2 AS fold, param, avg(value) AS v, count(*) AS n FROM av GROUP BY ALL), bb AS (SELECT fold, param, v AS own FROM m QUALIFY row_number() OVER (PARTITION BY fold ORDER BY round(v, 9) DESC, param) = 1)
SELECT CAST(bb.fold AS INTEGER) AS fold, bb.param, round(own, 6) AS own_mean, round(m.v, 6) AS other_mean, m.n FROM bb JOIN m ON m.fold = 1 - bb.fold AND m.param = bb.param""",
)
def two_fold_choice(spark, sf):
    return metrics.two_fold(_alpha_values(spark, sf), fold=(F.col("qid") % 2).cast("int"))


@query("grid_sweep", f"WITH v AS (SELECT len({toks('text')}) AS x FROM documents) SELECT CAST(b AS INTEGER) AS budget, CAST(k AS INTEGER) AS k, count(*) AS n, round(avg(least(x, b * k)), 6) AS mean FROM v, (SELECT unnest([100, 200, 400]) AS b), (SELECT unnest([1, 2, 3]) AS k) GROUP BY ALL")
def grid_sweep(spark, sf):
    grid = spark.createDataFrame([(b, k) for b in (100, 200, 400) for k in (1, 2, 3)], "budget int, k int")
    cases = documents(spark, sf).select(X.token_count(F.col("text")).alias("x"))
    return metrics.sweep(cases, grid, F.least(F.col("x"), F.col("budget") * F.col("k")), ("budget", "k"))


@query("coverage_levels", f"{STATS_SQL}, v AS (SELECT coalesce(len(ranks), 0) / n_gold AS x, unnest(CAST([0.7, 0.8, 0.9, 0.95] AS DOUBLE[])) AS level FROM st) SELECT level, count_if(x >= level) AS n, round(avg(CASE WHEN x >= level THEN 1 ELSE 0 END), 6) AS share FROM v GROUP BY level")
def coverage_levels(spark, sf):
    s = metrics.query_stats(*_run_and_gold(spark, sf), key="doc_id")
    return metrics.thresholds(s.select((F.size("ranks") / F.col("n_gold")).alias("value")))


@query("loser_groups", f"{REC_SQL} SELECT CASE WHEN y - x > 1e-9 THEN 'win' WHEN y - x < -1e-9 THEN 'lose' ELSE 'same' END AS sign, count(*) AS n, round(avg(len({toks('text')})), 6) AS n_tokens FROM ga JOIN benchmark ON qid = item_id GROUP BY 1")
def loser_groups(spark, sf):
    a, b = two_runs(spark, sf)
    g = gold(spark, sf)
    d = _reciprocal(a, g).withColumnRenamed("value", "x").join(_reciprocal(b, g).withColumnRenamed("value", "y"), "qid").join(questions(spark, sf), "qid")
    return metrics.sign_groups(d.withColumn("n_tokens", X.token_count(F.col("question"))), "x", "y", "n_tokens")


@query("oracle_ceiling", f"{RUNS_SQL}, v AS (SELECT qid, rank, CAST(len({toks('text')}) AS DOUBLE) AS v FROM a JOIN documents USING (doc_id) WHERE rank <= 10), w2 AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY v DESC, rank) AS b FROM v) SELECT qid, sum(CASE WHEN rank <= 2 THEN v ELSE 0 END) AS first_value, sum(CASE WHEN b <= 2 THEN v ELSE 0 END) AS best_value FROM w2 GROUP BY qid")
def oracle_ceiling(spark, sf):
    a = first_run(spark, sf)
    v = a.join(documents(spark, sf).select("doc_id", X.token_count(F.col("text")).cast("double").alias("value")), "doc_id")
    return metrics.oracle_ceiling(v)


@query("hits_histogram", f"{RUNS_SQL}, h AS (SELECT doc_id, count(*) AS size FROM a GROUP BY 1) SELECT size, count(*) AS n FROM h GROUP BY 1")
def hits_histogram(spark, sf):
    a = first_run(spark, sf)
    return metrics.histogram(a, "doc_id")


@query("cutoff_loss", f"WITH {LEGAL_SQL}, o AS (SELECT ln.doc_id, i, length('Điều ' || (i // 3 + 1) || '. ' || x) AS head, length((i % 3) || '. ' || x) AS item, x FROM ln), s AS (SELECT *, coalesce(sum(CASE WHEN i % 3 = 0 THEN head ELSE item END + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos0, count(*) OVER (PARTITION BY doc_id, i // 3) AS m FROM o), u AS (SELECT CASE WHEN i % 3 = 0 THEN pos0 + head - length(x) ELSE pos0 + item - length(x) END AS start FROM s WHERE i % 3 > 0 OR m = 1) SELECT count(*) AS n, count_if(start >= 2000) AS beyond, round(avg(CASE WHEN start >= 2000 THEN 1 ELSE 0 END), 6) AS share FROM u")
def cutoff_loss(spark, sf):
    return metrics.cutoff_loss(parse.units(parsed_legal(spark, sf)), 2000)


@query("context_holds_gold", f"{RUNS_SQL}, {GOLD_SQL} SELECT count(*) AS n, count_if(contains(coalesce(text, ''), s)) AS hits, round(avg(CASE WHEN contains(coalesce(text, ''), s) THEN 1 ELSE 0 END), 6) AS rate FROM a JOIN ql USING (qid) JOIN documents USING (doc_id) WHERE rank <= 5")
def context_holds_gold(spark, sf):
    a = first_run(spark, sf)
    longest = X.longest(X.sentences(F.col("question")))
    q = questions(spark, sf).select("qid", longest.alias("gold"))
    rows = a.where("rank <= 5").join(q, "qid").join(documents(spark, sf).select("doc_id", F.coalesce("text", F.lit("")).alias("context")), "doc_id")
    return metrics.contained(rows, "gold", "context")


@query("stratified_sample")
def stratified_sample(spark, sf):
    """Ten documents of each language by hash order; hashes differ between engines."""
    return metrics.stratified(documents(spark, sf).select("doc_id", "lang"), F.col("lang"), 10, "doc_id").select("bucket", "doc_id", "nth")


@query("label_union", "WITH a AS (SELECT doc_id AS qid, [doc_id] AS ids FROM labels WHERE quality = 1), b AS (SELECT doc_id AS qid, [doc_id + toxic] AS ids FROM labels WHERE toxic IS NOT NULL) SELECT qid, CASE WHEN a.ids IS NOT NULL AND b.ids IS NOT NULL THEN CASE WHEN list_has_any(a.ids, b.ids) THEN 'agree' ELSE 'disagree' END WHEN a.ids IS NOT NULL THEN 'a_only' ELSE 'b_only' END AS source, CAST(CASE WHEN a.ids IS NOT NULL AND b.ids IS NOT NULL AND NOT list_has_any(a.ids, b.ids) THEN 0 ELSE 1 END AS INTEGER) AS n FROM a FULL JOIN b USING (qid)")
def label_union(spark, sf):
    rows = table(spark, sf, "labels")
    a = rows.where("quality = 1").select(F.col("doc_id").alias("qid"), F.array("doc_id").alias("ids"))
    b = rows.where("toxic is not null").select(F.col("doc_id").alias("qid"), F.array(F.col("doc_id") + F.col("toxic")).alias("ids"))
    return fuse.label_union(a, b).select("qid", "source", F.size("ids").alias("n"))


@query("gold_union", "SELECT doc_id AS qid, doc_id AS unit_id FROM labels WHERE quality = 1 UNION SELECT doc_id, doc_id FROM labels WHERE toxic = 0")
def gold_union(spark, sf):
    rows = table(spark, sf, "labels").select(F.col("doc_id").alias("qid"), F.col("doc_id").alias("unit_id"), "quality", "toxic")
    return fuse.gold_union(rows.where("quality = 1"), rows.where("toxic = 0"))


@query("split_membership", "SELECT doc_id AS qid, CASE WHEN t AND h THEN 'both' WHEN t THEN 'tuned' WHEN h THEN 'held_out' ELSE 'untouched' END AS part FROM (SELECT DISTINCT d.doc_id, coalesce(quality = 1, FALSE) AS t, coalesce(toxic = 1, FALSE) AS h FROM documents d LEFT JOIN labels USING (doc_id))")
def split_membership(spark, sf):
    rows = table(spark, sf, "labels").withColumnRenamed("doc_id", "qid")
    return fuse.split_membership(rows.where("quality = 1"), rows.where("toxic = 1"), documents(spark, sf).withColumnRenamed("doc_id", "qid"))


@query("remaining_work", "SELECT doc_id AS qid FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def remaining_work(spark, sf):
    d = documents(spark, sf).select(F.col("doc_id").alias("qid"))
    return lookup.remaining(d, table(spark, sf, "labels").withColumnRenamed("doc_id", "qid"))


@query("labelled_only", "SELECT doc_id AS qid FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def labelled_only(spark, sf):
    d = documents(spark, sf).select(F.col("doc_id").alias("qid"))
    return lookup.only(d, table(spark, sf, "labels").withColumnRenamed("doc_id", "qid"))


@query("flag_rates", "SELECT coalesce(round(count_if(quality = 1) / nullif(count(*), 0), 6), 0) AS good, coalesce(round(count_if(quality = 1 AND toxic = 1) / nullif(count_if(toxic = 1), 0), 6), 0) AS good_of_toxic FROM labels")
def flag_rates(spark, sf):
    good, toxic = F.col("quality") == 1, F.col("toxic") == 1
    return metrics.rates(table(spark, sf, "labels"), good=(good, None), good_of_toxic=(good, toxic))


def turns(spark, sf):
    """(id, question, answer): a user's turn and the assistant's next one."""
    c = table(spark, sf, "conversations")
    w = metrics.W.partitionBy("conv_id").orderBy("turn")
    rows = c.withColumn("answer", F.lead("text").over(w)).withColumn("next", F.lead("role").over(w))
    return rows.where("role = 'user' and next = 'assistant'").select(F.concat_ws(":", "conv_id", "turn").alias("id"), F.col("text").alias("question"), "answer")


@query("meteor_rouge")
def meteor_rouge(spark, sf):
    """Answers scored against their questions: alignments aren't expressible in SQL."""
    t = turns(spark, sf)
    return t.select("id", F.round(scoring.meteor_column(F.col("question"), F.col("answer")), 6).alias("meteor"), F.round(scoring.rouge_column(F.col("question"), F.col("answer")), 6).alias("rouge"))
