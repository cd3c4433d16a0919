"""Queries over lexical and dense retrieval, fusion and hybrid search."""

from __future__ import annotations

from pyspark.sql import functions as F

from ranklake.functions import text as X
from ranklake.operators import bm25, dense, fuse, lookup, parse
from ranklake.plans.registry import query
from ranklake.sources import sinks
from ranklake.plans.tables import BM25_SQL, FIRST_SQL, TERMS_SQL, documents, questions, search_sql, sents, table, toks


_SAVED = {}


def once(spark, sf, name, make):
    """What all queries of the application read; it is made again where the tables' files have changed."""
    known = (spark.sparkContext.applicationId, sf, name)
    for t in ("documents", "benchmark"):
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf}/{t}.parquet")
        status = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path)
        known += (status.getLen(), status.getModificationTime())
    if known not in _SAVED:
        _SAVED[known] = make()
    return _SAVED[known]


def saved(spark, sf, name, docs, key):
    return once(spark, sf, name, lambda: sinks.saved_index(spark, docs, sinks.scratch(spark), key))


def index(spark, sf):
    return saved(spark, sf, "documents", documents(spark, sf), "doc_id")


def first_sentences(spark, sf):
    return questions(spark, sf).withColumn("question", F.element_at(X.sentences(F.col("question")), 1))


def first_run(spark, sf, k=20):
    """Documents ranked by the whole passage."""
    return once(spark, sf, f"whole {k}", lambda: bm25.search(index(spark, sf), questions(spark, sf), k))


def two_runs(spark, sf, k=20):
    """Documents ranked by the whole passage and by its first sentence."""
    return first_run(spark, sf, k), once(spark, sf, f"first {k}", lambda: bm25.search(index(spark, sf), first_sentences(spark, sf), k))


RUNS_SQL = f"WITH {BM25_SQL}, {TERMS_SQL}, {FIRST_SQL}, {search_sql('t', 'a', 20)}, {search_sql('t2', 'b', 20)}"


@query("bm25_term_stats", f"WITH {BM25_SQL} SELECT term, df, round(idf, 6) AS idf FROM i")
def bm25_term_stats(spark, sf):
    return index(spark, sf)["term_stats"].select("term", "df", F.round("idf", 6).alias("idf"))


@query("bm25_corpus_stats", f"WITH {BM25_SQL} SELECT n, round(avgdl, 6) AS avgdl, round((SELECT avg(x) FROM r), 6) AS avg_idf FROM c")
def bm25_corpus_stats(spark, sf):
    return index(spark, sf)["corpus_stats"].select("n", F.round("avgdl", 6).alias("avgdl"), F.round("avg_idf", 6).alias("avg_idf"))


@query("bm25_search", f"WITH {BM25_SQL}, {TERMS_SQL}, {search_sql('t', 'a', 10)} SELECT qid, doc_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM a")
def bm25_search(spark, sf):
    return bm25.search(index(spark, sf), questions(spark, sf), 10).select("qid", "doc_id", F.round("score", 6).alias("score"), "rank")


@query("bm25_capped", f"WITH {BM25_SQL.replace('lower(text)', 'lower(substr(text, 1, 2000))')}, {TERMS_SQL}, {search_sql('t', 'a', 10)} SELECT qid, doc_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM a")
def bm25_capped(spark, sf):
    """The only query that cuts texts: a bound of the memory that segmenting takes, off in all others."""
    i = bm25.build_index(documents(spark, sf), cap=2000)
    return bm25.search(i, questions(spark, sf), 10).select("qid", "doc_id", F.round("score", 6).alias("score"), "rank")


@query(
    "bm25_multi_query",
    f"""WITH {BM25_SQL}, s AS (SELECT item_id, trim(text, ' ' || chr(10)) AS t, {sents("text")} AS s FROM benchmark),
v AS (SELECT item_id, t, s, (SELECT x FROM (SELECT unnest(s) AS x, generate_subscripts(s, 1) AS i) ORDER BY length(x) DESC, i LIMIT 1) AS longest FROM s),
u AS (SELECT DISTINCT item_id AS qid, unnest(CASE WHEN len(s) > 1 THEN [t, longest, s[1], s[-1]] ELSE [t] END) AS variant FROM v),
t AS (SELECT qid, variant, term, count(*) AS qtf FROM (SELECT qid, variant, unnest({toks("lower(variant)")}) AS term FROM u) GROUP BY ALL),
{search_sql("t", "a", 20, "qid, variant")}, m AS (SELECT qid, doc_id, max(score) AS score FROM a GROUP BY ALL)
SELECT qid, doc_id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM m QUALIFY rank <= 20""",
)
def bm25_multi_query(spark, sf):
    return bm25.search_variants(index(spark, sf), questions(spark, sf), 20).select("qid", "doc_id", F.round("score", 6).alias("score"), "rank")


@query(
    "bm25_rescore",
    f"""{RUNS_SQL}, z AS (SELECT b.qid, b.doc_id, coalesce(s.score, 0.0) AS score FROM b LEFT JOIN a_s s ON b.qid = s.qid AND b.doc_id = s.doc_id)
SELECT qid, doc_id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM z""",
)
def bm25_rescore(spark, sf):
    _, b = two_runs(spark, sf)
    out = bm25.rescore(index(spark, sf), questions(spark, sf), b, key="doc_id")
    return out.select("qid", "doc_id", F.round("score", 6).alias("score"), "rank")


def dense_queries(spark, sf):
    """The stated query set: every vector whose id is divisible by 100."""
    return table(spark, sf, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vec"))


def dense_vectors(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("row_id"), F.col("vec_id").cast("string").alias("unit_id"), F.col("label").alias("doc_id"), F.col("embedding").alias("vec"))


DENSE_SQL = """q AS (SELECT vec_id AS qid, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id % 100 = 0),
d AS (SELECT qid, vec_id AS row_id, label AS doc_id, round(list_dot_product(v, CAST(embedding AS DOUBLE[])), 9) AS score FROM q, embeddings WHERE vec_id <> qid),
top AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, row_id) AS rank FROM d QUALIFY rank <= 50)"""


def dense_run(spark, sf, k=50):
    hits = dense.top_k(dense_queries(spark, sf), dense_vectors(spark, sf), k, exclude_self=True)
    return hits.join(dense_vectors(spark, sf).select("row_id", "unit_id", "doc_id"), "row_id")


@query("dense_top_k", f"WITH {DENSE_SQL} SELECT qid, row_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM top")
def dense_top_k(spark, sf):
    return dense.top_k(dense_queries(spark, sf), dense_vectors(spark, sf), 50, exclude_self=True).select("qid", "row_id", F.round("score", 6).alias("score"), "rank")


@query("dense_rescore", f"WITH {DENSE_SQL} SELECT qid, row_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM top")
def dense_rescore(spark, sf):
    """Candidates stripped of their scores get them back from the vectors."""
    stripped = dense_run(spark, sf).select("qid", "row_id", "unit_id", F.lit(0.0).alias("score"), "rank")
    out = dense.rescore(stripped, dense_queries(spark, sf), dense_vectors(spark, sf))
    w = F.row_number().over(bm25.W.partitionBy("qid").orderBy(F.col("score").desc(), "row_id"))
    return out.withColumn("rank", w).select("qid", "row_id", F.round("score", 6).alias("score"), "rank")


@query("collapse_to_group", f"WITH {DENSE_SQL}, f AS (SELECT qid, doc_id, min(rank) AS best FROM top GROUP BY ALL) SELECT qid, doc_id, CAST(row_number() OVER (PARTITION BY qid ORDER BY best, doc_id) AS INTEGER) AS rank FROM f")
def collapse_to_group(spark, sf):
    return dense.collapse(dense_run(spark, sf))


@query("unit_positions", "SELECT md5(trim(x)) AS unit_id, count(*) AS n FROM (SELECT unnest(string_split(coalesce(text, ''), chr(10))) AS x FROM documents) WHERE trim(x) <> '' GROUP BY 1")
def unit_positions(spark, sf):
    return dense.unit_positions(parse.line_units(documents(spark, sf))).select("unit_id", "n")


@query("patch_vectors", "SELECT vec_id AS row_id, round(CAST(embedding[1] AS DOUBLE) * CASE WHEN label = 1 THEN 2 ELSE 1 END, 6) AS first FROM embeddings")
def patch_vectors(spark, sf):
    v = dense_vectors(spark, sf).select("row_id", "vec")
    new = dense_vectors(spark, sf).where("doc_id = 1").select("row_id", F.transform("vec", lambda x: x * F.lit(2).cast("float")).alias("vec"))
    return dense.patch(v, new).select("row_id", F.round(F.element_at("vec", 1).cast("double"), 6).alias("first"))


@query(
    "union_first_wins",
    f"""{RUNS_SQL}, e AS (SELECT *, 0 AS list_no FROM a UNION ALL SELECT *, 1 FROM b), o AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY qid, doc_id ORDER BY list_no, rank) = 1)
SELECT qid, doc_id, CAST(list_no AS INTEGER) AS list_no, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY qid ORDER BY list_no, rank, doc_id) AS INTEGER) AS rank FROM o""",
)
def union_first_wins(spark, sf):
    return fuse.union(*two_runs(spark, sf), key="doc_id").select("qid", "doc_id", "list_no", F.round("score", 6).alias("score"), "rank")


@query(
    "rrf",
    f"""{RUNS_SQL}, e AS (SELECT qid, doc_id, 0.7 / (60 + rank) AS s, 0 AS list_no, rank FROM a UNION ALL SELECT qid, doc_id, 0.3 / (60 + rank), 1, rank FROM b),
g AS (SELECT qid, doc_id, round(sum(CAST(s AS DOUBLE)), 12) AS score, min(list_no * 1000 + rank) AS f FROM e GROUP BY ALL)
SELECT qid, doc_id, round(score, 9) AS score, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, f, doc_id) AS INTEGER) AS rank FROM g""",
)
def rrf(spark, sf):
    return fuse.rrf(*two_runs(spark, sf), key="doc_id", weights=(0.7, 0.3)).select("qid", "doc_id", F.round("score", 9).alias("score"), "rank")


def reranked(spark, sf):
    """Documents of both runs with their ranks in each, from 0."""
    a, b = two_runs(spark, sf)
    both = a.select("qid", "doc_id", (F.col("rank") - 1).alias("dense_rank"), "score").join(b.select("qid", "doc_id", (F.col("rank") - 1).alias("rerank_rank")), ["qid", "doc_id"])
    return both.select("qid", "doc_id", "dense_rank", "rerank_rank", "score")


BOTH_SQL = f"{RUNS_SQL}, z AS (SELECT a.qid, a.doc_id, a.rank - 1 AS d, b.rank - 1 AS r, a.score FROM a JOIN b ON a.qid = b.qid AND a.doc_id = b.doc_id)"


@query("weighted_blend", f"{BOTH_SQL} SELECT qid, doc_id, CAST(row_number() OVER (PARTITION BY qid ORDER BY round(CAST(0.7 AS DOUBLE) / (60 + d) + (1 - CAST(0.7 AS DOUBLE)) / (60 + r), 12) DESC, r, doc_id) AS INTEGER) AS rank FROM z")
def weighted_blend(spark, sf):
    return fuse.blend(reranked(spark, sf), 0.7, key="doc_id").select("qid", "doc_id", "rank")


@query("linear_blend", f"{BOTH_SQL} SELECT qid, doc_id, CAST(row_number() OVER (PARTITION BY qid ORDER BY round(CAST(0.3 AS DOUBLE) * d + CAST(0.7 AS DOUBLE) * r, 12), r, doc_id) AS INTEGER) AS rank FROM z")
def linear_blend(spark, sf):
    return fuse.linear_blend(reranked(spark, sf), 0.3, key="doc_id").select("qid", "doc_id", "rank")


@query("window_blend", f"{BOTH_SQL} SELECT qid, doc_id, CAST(row_number() OVER (PARTITION BY qid ORDER BY CASE WHEN r < 5 THEN 0 ELSE 1 END, CASE WHEN r < 5 THEN -score END, r, doc_id) AS INTEGER) AS rank FROM z")
def window_blend(spark, sf):
    return fuse.window_blend(reranked(spark, sf), 5, base="rerank_rank", key="doc_id").select("qid", "doc_id", "rank")


@query(
    "cut_diverse",
    f"""{RUNS_SQL}, s AS (SELECT a.*, source FROM a JOIN documents USING (doc_id)), m AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY qid, source ORDER BY rank) <= 2)
SELECT qid, doc_id, source, CAST(row_number() OVER (PARTITION BY qid ORDER BY rank) AS INTEGER) AS rank FROM m QUALIFY row_number() OVER (PARTITION BY qid ORDER BY rank) <= 10""",
)
def cut_diverse(spark, sf):
    a = first_run(spark, sf)
    return fuse.diverse(a.join(documents(spark, sf).select("doc_id", "source"), "doc_id"), 10, 2, "source").select("qid", "doc_id", "source", "rank")


@query(
    "expand_hits",
    f"""WITH {BM25_SQL}, {TERMS_SQL}, {search_sql('t', 'a', 10)}, l AS (SELECT doc_id, i - 1 AS pos, trim(x) AS x FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS x, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents))
SELECT qid, l.doc_id, CAST(pos AS INTEGER) AS pos, md5(x) AS unit_id, round(score, 6) AS doc_score FROM a JOIN l USING (doc_id) WHERE x <> ''""",
)
def expand_hits(spark, sf):
    hits = bm25.search(index(spark, sf), questions(spark, sf), 10)
    return lookup.expand(hits, parse.line_units(documents(spark, sf))).select("qid", "doc_id", "pos", "unit_id", F.round("doc_score", 6).alias("doc_score"))


def unit_index(spark, sf):
    return saved(spark, sf, "units", parse.line_units(documents(spark, sf)), "row_id")


def dense_documents(spark, sf, k=20):
    """(qid, doc_id, rank): the dense arm. The test tables give no vectors of texts, so the vector with a question's or document's
    number stands for it."""
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vec"))
    q = questions(spark, sf).join(v.withColumnRenamed("doc_id", "qid"), "qid").select("qid", "vec")
    return dense.top_k(q, v, k, key="doc_id").select("qid", "doc_id", "rank")


def hybrid(spark, sf, docs=100, units=300, k=50):
    """Units of the best documents by words and by vectors, and the best units of all, united and ranked by the unit index; texts
    come last."""
    every = parse.line_units(documents(spark, sf))
    q = questions(spark, sf)
    both = bm25.kept(spark, fuse.union(bm25.search(index(spark, sf), q, docs).select("qid", "doc_id", "rank"), dense_documents(spark, sf), key="doc_id").select("qid", "doc_id", "rank", F.lit(0.0).alias("score")))
    of_docs = lookup.expand(both, every).select("qid", "row_id", "rank", F.lit(0.0).alias("score"))
    u = unit_index(spark, sf)
    best = bm25.search(u, q, units, key="row_id").select("qid", "row_id", "rank", "score")
    united = bm25.kept(spark, fuse.union(of_docs, best, key="row_id").select("qid", "row_id", "score", "rank"))
    ranked = bm25.kept(spark, bm25.rescore(u, q, united, key="row_id").where(F.col("rank") <= k))
    return lookup.with_text(ranked.select("qid", "row_id", "score", "rank"), every)


@query(
    "hybrid_search",
    f"""WITH {BM25_SQL}, {TERMS_SQL}, {search_sql('t', 'a', 100)},
l AS (SELECT doc_id, doc_id || ':' || (i - 1) AS row_id, trim(x) AS x FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS x, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents) WHERE trim(x) <> ''),
uw AS (SELECT row_id, {toks("lower(x)")} AS w FROM l), ul AS (SELECT row_id, len(w) AS dl FROM uw), uc AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM ul),
up AS (SELECT term, row_id, count(*) AS tf FROM (SELECT row_id, unnest(w) AS term FROM uw) GROUP BY ALL),
ur AS (SELECT term, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) AS x FROM up, uc GROUP BY term),
ui AS (SELECT term, CASE WHEN x < 0 THEN 0.25 * (SELECT avg(x) FROM ur) ELSE x END AS idf FROM ur),
us AS (SELECT qid, row_id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 9) AS score FROM t JOIN ui USING (term) JOIN up USING (term) JOIN ul USING (row_id), uc GROUP BY ALL),
ub AS (SELECT qid, row_id FROM us QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, row_id) <= 300),
dd AS (SELECT b.item_id AS qid, e.vec_id AS doc_id, round(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 9) AS s FROM benchmark b JOIN embeddings q ON q.vec_id = b.item_id, embeddings e),
dn AS (SELECT qid, doc_id FROM dd QUALIFY row_number() OVER (PARTITION BY qid ORDER BY s DESC, doc_id) <= 20),
cand AS (SELECT qid, row_id FROM a JOIN l USING (doc_id) UNION SELECT qid, row_id FROM dn JOIN l USING (doc_id) UNION SELECT qid, row_id FROM ub),
f AS (SELECT qid, row_id, coalesce(score, 0.0) AS score FROM cand LEFT JOIN us USING (qid, row_id))
SELECT qid, row_id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, row_id) AS INTEGER) AS rank, md5(x) AS digest FROM f JOIN l USING (row_id) QUALIFY rank <= 50""",
)
def hybrid_search(spark, sf):
    return hybrid(spark, sf).select("qid", "row_id", F.round("score", 6).alias("score"), "rank", F.md5("text").alias("digest"))
