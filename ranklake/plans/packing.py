"""Queries over selection, expansion, formatting and packing of context, and over alignment."""

from __future__ import annotations

from pyspark.sql import functions as F

from ranklake.functions import text as X
from ranklake.operators import align, bm25, lookup, pack, parse
from ranklake.plans import registry
from ranklake.plans.registry import query
from ranklake.plans.retrieval import RUNS_SQL, first_run, once
from ranklake.plans.tables import LEGAL_SQL, documents, gold, parsed_legal, questions, toks


def candidates(spark, sf, k=10):
    """(qid, question, rank, unit_id, text): the best documents of each passage, whose texts are looked up once an application."""
    d = documents(spark, sf).select("doc_id", F.col("doc_id").cast("string").alias("unit_id"), F.coalesce("text", F.lit("")).alias("text"))
    all_ranks = once(spark, sf, "candidates", lambda: bm25.kept(spark, first_run(spark, sf).join(d, "doc_id").join(questions(spark, sf), "qid")))
    return all_ranks.where(F.col("rank") <= k)


CAND_SQL = f"{RUNS_SQL}, cand AS (SELECT a.qid, rank, a.doc_id, coalesce(d.text, '') AS text, q.text AS question, score FROM a JOIN documents d USING (doc_id) JOIN benchmark q ON q.item_id = a.qid WHERE rank <= 10)"


def _overlap(a: str, b: str) -> str:
    return f"len(list_intersect(list_distinct({toks(f'lower({a})')}), list_distinct({toks(f'lower({b})')})))"


@query("top_units_by_overlap", f"{CAND_SQL} SELECT qid, doc_id, CAST(row_number() OVER (PARTITION BY qid ORDER BY {_overlap('question', 'text')} DESC, rank) AS INTEGER) AS place FROM cand QUALIFY place <= 3")
def top_units_by_overlap(spark, sf):
    return pack.top_units(candidates(spark, sf), 3).select("qid", "doc_id", "place")


@query("prefilter_units", f"{CAND_SQL}, s AS (SELECT *, count(*) OVER (PARTITION BY qid) AS n FROM cand) SELECT qid, doc_id, CAST(row_number() OVER (PARTITION BY qid ORDER BY CASE WHEN n <= 5 THEN 0 ELSE {_overlap('question', 'text')} END DESC, rank) AS INTEGER) AS place FROM s QUALIFY place <= 5")
def prefilter_units(spark, sf):
    return pack.prefilter(candidates(spark, sf), 5).select("qid", "doc_id", "place")


@query("select_span")
def select_span(spark, sf):
    """The part of each candidate nearest to its question: parts end before a look-behind, which DuckDB lacks."""
    return candidates(spark, sf, 3).select("qid", "doc_id", F.md5(pack.select_span(F.col("question"), F.col("text"))).alias("digest"))


@query(
    "coverage_and_f1",
    f"""{CAND_SQL}, cs AS (SELECT qid, doc_id, {toks("lower(question)")} AS g, list_distinct({toks("lower(text)")}) AS c, list_distinct({toks("lower(question)")}) AS s FROM cand)
SELECT qid, doc_id, round(len(list_filter(g, lambda x: list_contains(c, x))) / len(g), 6) AS coverage, round(2 * len(list_intersect(s, c)) / (len(s) + len(c)), 6) AS f1, round(len(list_intersect(s, c)) / len(list_distinct(list_concat(s, c))), 6) AS jaccard FROM cs""",
)
def coverage_and_f1(spark, sf):
    q, t = F.lower("question"), F.lower("text")
    a, b = X.token_set(q), X.token_set(t)
    return candidates(spark, sf).select("qid", "doc_id", F.round(X.coverage(X.tokens(q), X.tokens(t)), 6).alias("coverage"), F.round(X.set_f1(a, b), 6).alias("f1"), F.round(X.jaccard(a, b), 6).alias("jaccard"))


def legal_units(spark, sf):
    return parse.units(parsed_legal(spark, sf))


def legal_expanded(spark, sf, budget):
    u = legal_units(spark, sf)
    chosen = u.where("unit_type = 'clause'").select("row_id", "doc_id", "article_pos", "unit_id", "article_no", "title", "article_text")
    return pack.expand_adjacent(chosen, u, budget)


EXPAND_SQL = f"""WITH {LEGAL_SQL}, z AS (SELECT *, len({toks("text")}) AS k FROM lu WHERE unit_type = 'clause'),
y AS (SELECT *, sum(k) OVER (PARTITION BY doc_id, article_pos ORDER BY clause_pos) AS upto, sum(k) OVER (PARTITION BY doc_id, article_pos) AS total, count(*) OVER (PARTITION BY doc_id, article_pos) AS m FROM z),
h AS (SELECT x.doc_id, x.article_pos, x.clause_pos, any_value(x.unit_id) AS unit_id, any_value(x.m) AS m, any_value(x.title) AS title, any_value(x.article_text) AS article_text, min(o.clause_pos) FILTER (WHERE o.clause_pos >= x.clause_pos AND o.upto - x.upto + x.k >= 40) AS hi,
             max(o.clause_pos) FILTER (WHERE o.clause_pos <= x.clause_pos AND o.total - o.upto + o.k >= 40) AS lo FROM y x JOIN y o ON x.doc_id = o.doc_id AND x.article_pos = o.article_pos GROUP BY 1, 2, 3),
e AS (SELECT *, CASE WHEN hi IS NOT NULL THEN clause_pos ELSE coalesce(lo, 0) END AS a, coalesce(hi, m - 1) AS b FROM h)"""


@query("expand_adjacent", f"{EXPAND_SQL} SELECT CAST(doc_id AS VARCHAR) AS doc_id, unit_id, CAST(b - a + 1 AS BIGINT) AS n_items, b - a + 1 = m AS whole FROM e")
def expand_adjacent(spark, sf):
    return legal_expanded(spark, sf, 40).select("doc_id", "unit_id", F.size("items").cast("long").alias("n_items"), "whole")


@query(
    "format_context",
    f"""{EXPAND_SQL}, i AS (SELECT e.doc_id, e.unit_id, any_value(e.title) AS title, any_value(e.b - e.a + 1) AS n, any_value(e.m) AS m, any_value(e.article_pos) AS ap, string_agg(z.clause_no || '. ' || z.text, chr(10) ORDER BY z.clause_pos) AS body
FROM e JOIN z ON e.doc_id = z.doc_id AND e.article_pos = z.article_pos AND z.clause_pos BETWEEN e.a AND e.b GROUP BY 1, 2)
SELECT CAST(doc_id AS VARCHAR) AS doc_id, unit_id, md5(CASE WHEN n > 1 AND n = m THEN 'Điều ' || (ap + 1) || '. ' || title ELSE title END || chr(10) || CASE WHEN n > 1 AND n < m THEN '…' || chr(10) ELSE '' END || body) AS digest FROM i""",
)
def format_context(spark, sf):
    out = pack.decide_text(legal_expanded(spark, sf, 40), single="F2", many="G2")
    return out.select("doc_id", "unit_id", F.md5("formatted").alias("digest"))


@query("format_variants", f"""WITH {LEGAL_SQL}, z AS (SELECT *, article_pos + 1 AS no FROM lu WHERE unit_type = 'clause') SELECT CAST(doc_id AS VARCHAR) AS doc_id, unit_id, md5(text) AS f0, md5(title || chr(10) || text) AS f1, md5(title || chr(10) || clause_no || '. ' || text) AS f2, md5('Điều ' || no || '. ' || title || chr(10) || clause_no || '. ' || text) AS f3, md5(title || chr(10) || '…' || chr(10) || clause_no || '. ' || text) AS f4 FROM z""")
def format_variants(spark, sf):
    u = legal_units(spark, sf).where("unit_type = 'clause'")
    c = [F.col(x) for x in ("article_no", "title", "article_text", "clause_no", "text")]
    return u.select("doc_id", "unit_id", *[F.md5(pack.format_clause(v, *c)).alias(v.lower()) for v in ("F0", "F1", "F2", "F3", "F4")])


@query("article_if_short", f"WITH {LEGAL_SQL} SELECT CAST(doc_id AS VARCHAR) AS doc_id, unit_id, md5(CASE WHEN len({toks('article_text')}) <= 60 THEN article_text ELSE text END) AS digest FROM lu")
def article_if_short(spark, sf):
    return legal_units(spark, sf).select("doc_id", "unit_id", F.md5(pack.article_if_short(F.col("text"), F.col("article_text"), 60)).alias("digest"))


@query("body_budget", f"WITH {LEGAL_SQL} SELECT CAST(doc_id AS VARCHAR) AS doc_id, unit_id, CAST(greatest(200 - len({toks('title')}), 1) AS INTEGER) AS budget FROM lu")
def body_budget(spark, sf):
    return legal_units(spark, sf).select("doc_id", "unit_id", pack.body_budget(200, F.col("title")).cast("int").alias("budget"))


@query("first_k", f"{CAND_SQL} SELECT qid, doc_id, CAST(rank AS INTEGER) AS place FROM cand WHERE rank <= 3")
def first_k(spark, sf):
    return pack.first_k(candidates(spark, sf), 3).select("qid", "doc_id", "place")


@query("exact_top", f"{CAND_SQL}, o AS (SELECT *, lower(array_to_string({toks('text')}, ' ')) AS k FROM cand), u AS (SELECT * FROM o WHERE k <> '' QUALIFY row_number() OVER (PARTITION BY qid, k ORDER BY rank) = 1) SELECT qid, doc_id, CAST(row_number() OVER (PARTITION BY qid ORDER BY rank) AS INTEGER) AS place FROM u QUALIFY place <= 3")
def exact_top(spark, sf):
    return pack.exact_top(candidates(spark, sf), 3).select("qid", "doc_id", "place")


@query("pack_greedy")
def pack_greedy(spark, sf):
    """An order-dependent fold, tested against a loop."""
    return pack.greedy(candidates(spark, sf)).select("qid", F.array_join("picked.unit_id", ",").alias("units"), "total")


@query("pack_exact")
def pack_exact(spark, sf):
    return pack.greedy(candidates(spark, sf), most=3, target=None, cap=None, similar=None).select("qid", F.array_join("picked.unit_id", ",").alias("units"), "total")


@query("qa_packages", f"{CAND_SQL} SELECT CAST(q.item_id AS VARCHAR) AS id, count(c.qid) AS n_contexts, coalesce(md5(string_agg(c.text, '|' ORDER BY c.rank)), md5('')) AS digest FROM benchmark q LEFT JOIN (SELECT * FROM cand WHERE rank <= 3) c ON c.qid = q.item_id GROUP BY 1")
def qa_packages(spark, sf):
    d = documents(spark, sf).select("doc_id", F.col("source").alias("name"), F.lit("").alias("link"), F.lit("").alias("document_number"), F.lit("").alias("article_no"), F.lit("").alias("clause_no"), F.lit("").alias("title"))
    rows = pack.first_k(candidates(spark, sf), 3).join(d, "doc_id").withColumn("item", pack.context_item())
    p = pack.packages(rows.select("qid", "place", "item"), questions(spark, sf).withColumn("answer", F.lit(None).cast("string")))
    return p.select(F.col("id").cast("string").alias("id"), F.size("contexts").cast("long").alias("n_contexts"), F.md5(F.array_join("contexts.text", "|")).alias("digest"))


@query("align_spans")
def align_spans(spark, sf):
    """Weak labels: of the 20 best documents of each passage the one it aligns to best. Alignment isn't SQL."""
    rows = candidates(spark, sf, 20).withColumn("part_no", F.lit(0)).withColumn("part", align.quote_core(F.col("question")))
    return align.best_alignment(rows).select("qid", "doc_id", F.round("confidence", 6).alias("confidence"), "trusted", F.md5("span").alias("span"))


@query("string_pairs", f"{CAND_SQL}, cs AS (SELECT qid, doc_id, rank, list_distinct({toks('lower(text)')}) AS c, list_distinct({toks('lower(question)')}) AS s, len({toks('question')}) AS n FROM cand), f AS (SELECT qid, doc_id, rank, round(2 * len(list_intersect(s, c)) / (len(s) + len(c)), 9) AS f1 FROM cs WHERE n >= 10), fb AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY qid ORDER BY f1 DESC, rank) = 1) SELECT qid, doc_id, round(f1, 6) AS f1 FROM fb WHERE f1 >= 0.45")
def string_pairs(spark, sf):
    return align.string_pairs(candidates(spark, sf), answer="question").select("qid", "doc_id", F.round("f1", 6).alias("f1"))


STRING_PAIRS_20_SQL = registry._ORACLES["string_pairs"].replace("rank <= 10)", "rank <= 20)")


@query("string_pairs_20", STRING_PAIRS_20_SQL)
def string_pairs_20(spark, sf):
    """``string_pairs`` over all 20 ranks of the run."""
    return align.string_pairs(candidates(spark, sf, 20), answer="question").select("qid", "doc_id", F.round("f1", 6).alias("f1"))


@query(
    "hard_negatives",
    f"""WITH {LEGAL_SQL}, u AS (SELECT *, doc_id || ':' || lpad(CAST(article_pos AS VARCHAR), 6, '0') || ':' || lpad(CAST(clause_pos AS VARCHAR), 6, '0') AS row_id, {toks("lower(text)")} AS w FROM lu),
p AS (SELECT * FROM u WHERE unit_type = 'clause' AND article_pos = 0 AND clause_pos = 0), n AS (SELECT p.doc_id AS qid, u.row_id, u.article_pos <> 0 AS far, round(abs(ln(len(u.w) / greatest(len(p.w), 1))), 9) AS d FROM p JOIN u ON p.doc_id = u.doc_id AND p.row_id <> u.row_id
WHERE len(u.w) >= 20 AND CASE WHEN len(p.w) > 0 THEN len(list_filter(p.w, lambda x: list_contains(u.w, x))) / len(p.w) ELSE 0 END <= 0.35)
SELECT qid, row_id, CAST(row_number() OVER (PARTITION BY qid ORDER BY far, d, row_id) AS INTEGER) AS nth FROM n QUALIFY nth <= 3""",
)
def hard_negatives(spark, sf):
    u = legal_units(spark, sf)
    p = u.where("unit_type = 'clause' and article_pos = 0 and clause_pos = 0").select(F.col("doc_id").cast("long").alias("qid"), "doc_id", "row_id", "article_id", "text")
    return align.hard_negatives(p, u)


@query("source_agreement", "WITH x AS (SELECT doc_id, quality AS u FROM labels WHERE quality IS NOT NULL), y AS (SELECT doc_id, 1 - toxic AS u FROM labels WHERE toxic IS NOT NULL), j AS (SELECT x.u AS a, y.u AS b FROM x FULL JOIN y USING (doc_id)) SELECT count(*) AS n, count_if(a IS NOT NULL AND b IS NOT NULL) AS both, count_if(a = b) AS same, round(count_if(a = b) / nullif(count_if(a IS NOT NULL AND b IS NOT NULL), 0), 6) AS share FROM j")
def source_agreement(spark, sf):
    from ranklake.plans.tables import table

    t = table(spark, sf, "labels").withColumnRenamed("doc_id", "qid")
    return align.agreement(t.where("quality is not null").select("qid", F.col("quality").alias("unit_id")), t.where("toxic is not null").select("qid", (1 - F.col("toxic")).alias("unit_id")))


@query("length_only_check", f"{CAND_SQL}, g AS (SELECT len({toks('question')}) AS p, len({toks('text')}) AS n FROM cand) SELECT count(*) AS n, count_if(p > n) AS longer, count_if(p < n) AS shorter, round(avg(CASE WHEN p > n THEN 1 ELSE 0 END), 6) AS share FROM g")
def length_only_check(spark, sf):
    return align.length_only(candidates(spark, sf), "question", "text")


@query(
    "link_citations",
    f"""WITH {LEGAL_SQL}, c AS (SELECT doc_id AS cid, CASE WHEN doc_id % 11 = 0 THEN NULL ELSE (doc_id % 997) || '/2020/QH1' END AS number, CAST(doc_id % 3 + 1 AS VARCHAR) AS article_no, CAST(doc_id % 4 AS VARCHAR) AS clause_no FROM documents),
n AS (SELECT (doc_id % 997) || '/2020/QH1' AS number, CAST(min(doc_id) AS VARCHAR) AS doc_id, count(*) = 1 AS usable FROM ll GROUP BY 1),
ar AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, CAST(a + 1 AS VARCHAR) AS article_no, doc_id || '_' || (a + 1) AS article_id FROM la), cl AS (SELECT DISTINCT regexp_replace(unit_id, '_[^_]*$', '') AS article_id, clause_no, unit_id FROM lu WHERE clause_no <> ''),
j AS (SELECT cid, c.number, usable, n.doc_id, ar.article_id, cl.unit_id, c.clause_no FROM c LEFT JOIN n USING (number) LEFT JOIN ar ON ar.doc_id = n.doc_id AND ar.article_no = c.article_no LEFT JOIN cl ON cl.article_id = ar.article_id AND cl.clause_no = c.clause_no)
SELECT cid, CASE WHEN number IS NULL THEN 'no_number' WHEN usable IS NULL THEN 'unknown_document' WHEN NOT usable THEN 'ambiguous_document' WHEN article_id IS NULL THEN 'unknown_article' WHEN unit_id IS NULL THEN 'unknown_clause' ELSE 'linked' END AS outcome, CASE WHEN usable AND unit_id IS NOT NULL THEN unit_id END AS unit_id FROM j""",
)
def link_citations(spark, sf):
    number = F.concat((F.col("doc_id") % 997).cast("string"), F.lit("/2020/QH1"))
    d = documents(spark, sf)
    c = d.select(F.col("doc_id").alias("cid"), F.when(F.col("doc_id") % 11 != 0, number).alias("number"), (F.col("doc_id") % 3 + 1).cast("string").alias("article_no"), (F.col("doc_id") % 4).cast("string").alias("clause_no"))
    n = lookup.number_index(d.select("doc_id", F.concat(F.lit("Số: "), number, F.lit("\n")).alias("passage")))
    return lookup.link_citations(c, n, legal_units(spark, sf)).select("cid", "outcome", "unit_id")


@query("follow_citations", "SELECT doc_id AS qid, doc_id || '_2' AS article_id, CAST(1 AS INTEGER) AS nth FROM (SELECT doc_id, len(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x) <> '')) AS n FROM documents) WHERE n > 3")
def follow_citations(spark, sf):
    """Each document's text names its own second article, which is followed where there is one."""
    hits = documents(spark, sf).select(F.col("doc_id").alias("qid"), F.lit(1).alias("rank"), "doc_id", F.lit("theo quy định tại Điều 2 của văn bản này").alias("text"))
    none = spark.createDataFrame([], "number string, doc_ids array<string>, usable boolean")
    return lookup.followed(hits, legal_units(spark, sf), none).select("qid", "article_id", "nth")


@query("late_text", f"{RUNS_SQL} SELECT qid, doc_id, md5(coalesce(text, '')) AS digest FROM a JOIN documents USING (doc_id)")
def late_text(spark, sf):
    a = first_run(spark, sf)
    d = documents(spark, sf).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return lookup.with_text(a, d, key="doc_id").select("qid", "doc_id", F.md5("text").alias("digest"))


@query("article_lookup", f"WITH {LEGAL_SQL} SELECT unit_id, CASE WHEN unit_type = 'clause' THEN regexp_replace(unit_id, '_[^_]*$', '') ELSE unit_id END AS article_id, md5(title) AS title FROM lu")
def article_lookup(spark, sf):
    u = legal_units(spark, sf)
    return lookup.article_of_unit(u.select("unit_id"), u).select("unit_id", "article_id", F.md5("title").alias("title"))


@query("control_group")
def control_group(spark, sf):
    """Passages with gold, and five others by hash order."""
    q = questions(spark, sf)
    return align.control_group(lookup.only(q, gold(spark, sf)), q, 5).select("qid", "group")
