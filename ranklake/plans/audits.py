"""Queries over audits of ids, baskets and packages, over weak labels, and over functions that have no other query."""

from __future__ import annotations

from pyspark.sql import functions as F

from ranklake.functions import text as X
from ranklake.operators import align, answers, audit, bm25, labelling, lookup, metrics, pack, parse, scoring
from ranklake.plans.evaluation import turns
from ranklake.plans.packing import CAND_SQL, candidates, legal_units
from ranklake.plans.registry import query
from ranklake.plans.retrieval import RUNS_SQL, first_run, index
from ranklake.plans.tables import LEGAL_SQL, documents, parsed_legal, questions, table, toks


def shared_ids(spark, sf):
    """Legal units whose ids come more than once: in an article, in a document, or in several documents."""
    u, doc = legal_units(spark, sf), F.col("doc_id").cast("long")
    other = F.concat(F.col("article_no"), F.lit("_x"), F.col("clause_no"))
    id = F.when(doc % 5 == 0, F.concat_ws("_", "doc_id", "article_no")).when(doc % 2 == 0, F.concat(F.col("doc_id"), F.lit("_c"), F.col("clause_no"))).otherwise(other)
    return u.select("doc_id", "row_id", "article_id", "text", id.alias("unit_id"))


def _level(name: str, index_sql: str) -> str:
    return f"l[CAST({index_sql} AS BIGINT) + 1] AS {name}"


SHARED_SQL = f"""{LEGAL_SQL}, su AS (SELECT doc_id, article_pos, text, doc_id || ':' || lpad(CAST(article_pos AS VARCHAR), 6, '0') || ':' || lpad(CAST(clause_pos AS VARCHAR), 6, '0') AS row_id,
CASE WHEN doc_id % 5 = 0 THEN doc_id || '_' || (article_pos + 1) WHEN doc_id % 2 = 0 THEN doc_id || '_c' || clause_no ELSE (article_pos + 1) || '_x' || clause_no END AS unit_id FROM lu),
sr AS (SELECT unit_id, count(*) AS n, count(DISTINCT doc_id) AS n_docs, count(DISTINCT article_pos) AS n_articles, min_by(text, row_id) AS a, max_by(text, row_id) AS b FROM su GROUP BY 1 HAVING count(*) > 1),
st AS (SELECT *, list_distinct({toks('lower(a)')}) AS x, list_distinct({toks('lower(b)')}) AS y FROM sr),
rep AS (SELECT unit_id, n, n_docs, CASE WHEN n_docs > 1 THEN 'other_document' WHEN n_articles = 1 THEN 'same_article' ELSE 'other_article' END AS place, a = b AS identical, round(len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))), 9) AS jaccard FROM st)"""


@query("repeated_ids", f"WITH {SHARED_SQL} SELECT unit_id, n, n_docs, place, identical, round(jaccard, 6) AS jaccard FROM rep")
def repeated_ids(spark, sf):
    return audit.repeated_ids(shared_ids(spark, sf)).withColumn("jaccard", F.round("jaccard", 6))


@query(
    "repeated_id_damage",
    f"""WITH {SHARED_SQL}, d AS (SELECT list_sort(list(jaccard)) AS l, count(*) AS m, round(avg(jaccard), 6) AS mean, count_if(jaccard = 0) AS disjoint FROM rep WHERE NOT identical)
SELECT (SELECT count(*) FROM rep) AS ids, (SELECT count_if(place = 'same_article') FROM rep) AS same_article, (SELECT count_if(place = 'other_article') FROM rep) AS other_article, (SELECT count_if(place = 'other_document') FROM rep) AS other_document,
(SELECT count_if(identical) FROM rep) AS identical, m AS differ, disjoint, mean, m AS n, round(l[CAST(m // 10 AS BIGINT) + 1], 6) AS p10, round((l[CAST((m - 1) // 2 AS BIGINT) + 1] + l[CAST(m // 2 AS BIGINT) + 1]) / 2, 6) AS median, round(l[CAST(9 * m // 10 AS BIGINT) + 1], 6) AS p90 FROM d""",
)
def repeated_id_damage(spark, sf):
    r = audit.repeated_id_damage(audit.repeated_ids(shared_ids(spark, sf)))
    return r.withColumn("n", F.col("differ"))


@query("most_repeated_ids", f"WITH {SHARED_SQL} SELECT unit_id, n, n_docs FROM rep ORDER BY n DESC, unit_id DESC LIMIT 10")
def most_repeated_ids(spark, sf):
    return audit.most_repeated(audit.repeated_ids(shared_ids(spark, sf)))


def _basket(spark, sf):
    """The run with ids that some documents share, and those ids."""
    id = F.when(F.col("doc_id") % 2 == 0, F.floor(F.col("doc_id") / 8).cast("string")).otherwise(F.concat(F.lit("o"), F.col("doc_id").cast("string")))
    a = first_run(spark, sf)
    dup = documents(spark, sf).select(id.alias("unit_id")).groupBy("unit_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return a.withColumn("unit_id", id), dup


BASKET_ID = "CASE WHEN doc_id % 2 = 0 THEN CAST(doc_id // 8 AS VARCHAR) ELSE 'o' || doc_id END"


@query(
    "basket_impact",
    f"""{RUNS_SQL}, di AS (SELECT {BASKET_ID} AS unit_id FROM documents GROUP BY 1 HAVING count(*) > 1), ba AS (SELECT qid, {BASKET_ID} AS unit_id FROM a),
bq AS (SELECT qid, count(*) - count(DISTINCT ba.unit_id) AS lost, count(di.unit_id) AS dup_rows FROM ba LEFT JOIN di USING (unit_id) GROUP BY 1), bl AS (SELECT list_sort(list(lost)) AS l, count(*) AS n FROM bq)
SELECT any_value(n) AS n, round(avg(lost), 6) AS mean, max(lost) AS most, count_if(lost >= 1) AS lost_one, count_if(lost >= 5) AS lost_five, round(avg(dup_rows), 6) AS mean_dup_rows, arg_min(qid, (-lost, qid)) AS worst,
any_value(l[CAST(n // 2 AS BIGINT) + 1]) AS median, any_value(l[CAST(9 * n // 10 AS BIGINT) + 1]) AS p90 FROM bq, bl""",
)
def basket_impact(spark, sf):
    return audit.basket_impact(*_basket(spark, sf))


COVERED = "CASE WHEN len(g) > 0 THEN len(list_filter(g, lambda x: list_contains({c}, x))) / len(g) ELSE 0 END"


@query(
    "chunking_ceiling",
    f"""{RUNS_SQL}, {LEGAL_SQL.strip()}, gq AS (SELECT item_id AS qid, {toks('lower(text)')} AS g FROM benchmark WHERE len({toks('text')}) >= 10), hq AS (SELECT qid, doc_id FROM a WHERE rank <= 5),
cu AS (SELECT qid, max({COVERED.format(c="cw")}) AS v FROM (SELECT qid, g, {toks("lower(lu.text)")} AS cw FROM gq JOIN hq USING (qid) JOIN lu USING (doc_id) WHERE unit_type = 'clause') GROUP BY 1),
au AS (SELECT qid, max({COVERED.format(c="aw")}) AS v FROM (SELECT qid, g, {toks("lower(coalesce(body, title))")} AS aw FROM gq JOIN hq USING (qid) JOIN la USING (doc_id)) GROUP BY 1),
cc AS (SELECT qid, round(coalesce(cu.v, 0), 9) AS clause, round(coalesce(au.v, 0), 9) AS article FROM gq LEFT JOIN cu USING (qid) LEFT JOIN au USING (qid)), cd AS (SELECT *, round(article - clause, 9) AS gain FROM cc)
SELECT count(*) AS n, round(avg(clause), 6) AS mean_clause, round(avg(article), 6) AS mean_article, round(avg(gain), 6) AS mean_gain, count_if(gain >= 0.1) AS needs_article, count_if(gain < 0.02) AS clause_enough, """
    + ", ".join(f"count_if({c} >= {v / 100}) AS {c}_{v}" for v in (80, 90, 95) for c in ("clause", "article")) + " FROM cd",
)
def chunking_ceiling(spark, sf):
    a = first_run(spark, sf)
    hits = a.where("rank <= 5").select("qid", F.col("doc_id").cast("string").alias("doc_id"))
    parsed = parsed_legal(spark, sf, hits).withColumn("doc_id", F.col("doc_id").cast("string"))
    return audit.chunking_ceiling(audit.best_coverages(questions(spark, sf), hits, parsed, "question"))


@query("aligned_ceiling")
def aligned_ceiling(spark, sf):
    """The same by alignment, for the labelled part of each passage; alignment isn't SQL."""
    labels = bm25.kept(spark, label_answers(spark, sf).where("clause_id is not null and trusted").select("qid", "part_no", "doc_id", F.col("clause_id").alias("unit_id")))
    units = parse.units(parsed_legal(spark, sf, labels)).join(labels.select("unit_id").distinct(), "unit_id", "left_semi").groupBy("unit_id").agg(F.min_by(F.struct("text", "article_text"), "row_id").alias("u"))
    parts = labelling.quoted_parts(questions(spark, sf).withColumnRenamed("question", "answer")).select("qid", "part_no", "part")
    pairs = labels.drop("doc_id").join(units, "unit_id").join(parts, ["qid", "part_no"]).select("qid", "part", "u.text", "u.article_text")
    return audit.chunking_ceiling(audit.aligned_scores(pairs), big=0.03, tiny=0.03)


@query("label_answers")
def label_answers(spark, sf):
    """Each passage as an answer: parts, search, units, prefilter and alignment in a row. Alignment isn't SQL."""
    rows = questions(spark, sf).withColumnRenamed("question", "answer")
    return labelling.label_answers(rows, index(spark, sf), lambda ids: parsed_legal(spark, sf, ids))


@query(
    "build_report",
    f"""{CAND_SQL}, bc AS (SELECT qid, {BASKET_ID} AS unit_id, CASE WHEN doc_id % 4 > 0 THEN 'x' ELSE '' END AS title, len({toks('text')}) AS size FROM cand WHERE rank <= 3 AND qid % 6 <> 0),
di AS (SELECT {BASKET_ID} AS unit_id FROM documents GROUP BY 1 HAVING count(*) > 1),
bb AS (SELECT item_id, item_id % 2 = 0 AS answered, count(bc.qid) AS contexts, count_if(title = '') AS untitled, count(di.unit_id) AS dup, coalesce(sum(size), 0) AS total FROM benchmark LEFT JOIN bc ON qid = item_id LEFT JOIN di USING (unit_id) GROUP BY ALL), bl AS (SELECT list_sort(list(total)) AS l, count(*) AS n FROM bb)
SELECT any_value(n) AS n, count_if(contexts = 0) AS without_context, count_if(answered) AS answered, CAST(sum(contexts) AS BIGINT) AS contexts, round(sum(untitled) / sum(contexts), 6) AS untitled, round(sum(dup) / sum(contexts), 6) AS repeated_ids, round(avg(total), 6) AS mean,
round(avg(CASE WHEN total < 250 THEN 1 ELSE 0 END), 6) AS below, round(avg(CASE WHEN total > 1200 THEN 1 ELSE 0 END), 6) AS above, CAST(any_value(l[CAST(n // 10 AS BIGINT) + 1]) AS BIGINT) AS p10, CAST(any_value(l[CAST(n // 2 AS BIGINT) + 1]) AS BIGINT) AS median, CAST(any_value(l[CAST(9 * n // 10 AS BIGINT) + 1]) AS BIGINT) AS p90,
CAST(any_value(l[CAST(n // 2 AS BIGINT) + 1]) - 620 AS BIGINT) AS shift, sum(untitled) / sum(contexts) < 0.1 AS titles_ok, count_if(answered) = any_value(n) AS answers_ok, abs(any_value(l[CAST(n // 2 AS BIGINT) + 1]) - 620) <= 90 AS median_ok FROM bb, bl""",
)
def build_report(spark, sf):
    _, dup = _basket(spark, sf)
    id = F.when(F.col("doc_id") % 2 == 0, F.floor(F.col("doc_id") / 8).cast("string")).otherwise(F.concat(F.lit("o"), F.col("doc_id").cast("string")))
    c = candidates(spark, sf, 3).where("qid % 6 <> 0").select("qid", id.alias("unit_id"), "text", F.when(F.col("doc_id") % 4 > 0, "x").otherwise("").alias("title"))
    q = questions(spark, sf).select("qid", F.when(F.col("qid") % 2 == 0, "x").alias("answer"))
    return audit.build_report(q, c, dup, 620)


F1 = "round(CASE WHEN len(g) + len({c}) > 0 THEN 2 * len(list_intersect(g, {c})) / (len(g) + len({c})) ELSE 0 END, 9)"


def _words(c: str) -> str:
    return f"list_distinct({toks(f'lower({c})')})"


@query(
    "rescored_ceiling",
    f"""{CAND_SQL}, s1 AS (SELECT qid, rank, trim(text, ' ' || chr(10)) AS t, {_words("question")} AS g, {_words("text")} AS c FROM cand), s2 AS (SELECT *, {F1.format(c="c")} AS v FROM s1),
o1 AS (SELECT qid, rank AS r1, c AS c1, v AS v1 FROM s2 QUALIFY row_number() OVER (PARTITION BY qid ORDER BY v DESC, rank) = 1),
p2 AS (SELECT qid, rank, r1, v1, g, list_distinct(list_concat(c, c1)) AS u FROM s2 JOIN o1 USING (qid) WHERE rank <> r1),
o2 AS (SELECT qid, rank AS r2, {F1.format(c="u")} AS v2 FROM p2 QUALIFY row_number() OVER (PARTITION BY qid ORDER BY v2 DESC, rank) = 1),
f1 AS (SELECT qid, any_value(g) AS g, list_distinct(flatten(list(c))) AS u FROM s2 WHERE rank <= 2 GROUP BY 1)
SELECT o1.qid, round({F1.format(c="f1.u").replace("(g", "(f1.g")}, 6) AS first_value, round(coalesce(v2, v1), 6) AS best_value, CASE WHEN r2 IS NULL THEN CAST(r1 AS VARCHAR) ELSE least(r1, r2) || ',' || greatest(r1, r2) END AS best_ranks FROM o1 LEFT JOIN o2 USING (qid) LEFT JOIN f1 ON f1.qid = o1.qid""",
)
def rescored_ceiling(spark, sf):
    score = lambda g, t: X.set_f1(X.token_set(F.lower(g)), X.token_set(F.lower(t)))
    r = audit.rescored_ceiling(candidates(spark, sf), score)
    return r.withColumns({c: F.round(c, 6) for c in ("first_value", "best_value")})


@query("rescored_meteor")
def rescored_meteor(spark, sf):
    """``rescored_ceiling`` by METEOR, which isn't SQL."""
    return audit.rescored_ceiling(candidates(spark, sf, 5), scoring.meteor_column, pool=5)


@query("extra_text_penalty")
def extra_text_penalty(spark, sf):
    """METEOR that answers in a conversation lose when the lead of another passage is put after them; draws are by hash."""
    t = turns(spark, sf).where("trim(answer) <> ''").select(F.col("id").alias("qid"), "answer", F.when(F.length("answer") % 2 == 0, "even").otherwise("odd").alias("group"))
    return audit.extra_text_penalty(t, questions(spark, sf).select(X.longest(X.sentences(F.col("question"))).alias("text")), scoring.meteor_column, "even", resamples=200)


@query(
    "online_items",
    f"""WITH {LEGAL_SQL}, oi AS (SELECT doc_id, article_pos, doc_id || '_' || (article_pos + 1) || CASE WHEN unit_type = 'clause' THEN ',' || string_agg(unit_id, ',' ORDER BY clause_pos) ELSE '' END AS covered, any_value(article_text) AS t FROM lu GROUP BY doc_id, article_pos, unit_type),
w AS (SELECT DISTINCT doc_id, article_pos, unit_type FROM lu) SELECT CAST(doc_id AS VARCHAR) AS doc_id, CASE WHEN unit_type = 'clause' THEN doc_id || '_' || (article_pos + 1) || '_1' ELSE doc_id || '_' || (article_pos + 1) END AS unit_id,
CASE WHEN unit_type = 'clause' THEN 'clause' ELSE 'article_fallback' END AS kind, md5(t) AS digest, covered, 'Nghị định ' || (doc_id % 90 + 1) || '/2017/NĐ-CP' AS name, (doc_id % 90 + 1) || '/2017/NĐ-CP' AS document_number FROM w JOIN oi USING (doc_id, article_pos)""",
)
def online_items(spark, sf):
    """The first unit of each article, with the article's text."""
    parsed = parsed_legal(spark, sf)
    first = parse.units(parsed).where("clause_pos = 0").select(F.lit(1).alias("qid"), "doc_id", "unit_id", F.lit(1.0).alias("score"))
    docs = documents(spark, sf).select("doc_id", F.format_string("Nghị định %d/2017/NĐ-CP", F.col("doc_id") % 90 + 1).alias("name"), F.lit("").alias("link"))
    return labelling.online_items(first, parsed, docs, expand=True).select("doc_id", "unit_id", "kind", F.md5("text").alias("digest"), F.array_join("covered", ",").alias("covered"), "name", "document_number")


@query("precision_recall", f"{CAND_SQL}, cs AS (SELECT qid, doc_id, {_words('text')} AS c, {_words('question')} AS g FROM cand) SELECT qid, doc_id, CASE WHEN len(c) > 0 THEN round(len(list_intersect(g, c)) / len(c), 6) ELSE 0 END AS precision, round(len(list_intersect(g, c)) / len(g), 6) AS recall FROM cs")
def precision_recall(spark, sf):
    g, c = X.token_set(F.lower("question")), X.token_set(F.lower("text"))
    return candidates(spark, sf).select("qid", "doc_id", F.round(X.set_precision(g, c), 6).alias("precision"), F.round(X.set_recall(g, c), 6).alias("recall"))


@query("composed", "SELECT doc_id, md5(nfc_normalize(replace(replace(text, 'e', 'e' || chr(769)), 'a', 'a' || chr(770) || chr(769)))) AS digest FROM documents WHERE text IS NOT NULL")
def composed(spark, sf):
    """Texts with parted accents, composed."""
    parted = F.replace(F.replace("text", F.lit("e"), F.lit("e\u0301")), F.lit("a"), F.lit("a\u0302\u0301"))
    return documents(spark, sf).where("text is not null").select("doc_id", F.md5(X.nfc(parted)).alias("digest"))


@query("first_integer", "SELECT doc_id, TRY_CAST(nullif(regexp_extract(coalesce(text, ''), '([0-9]+)', 1), '') AS INTEGER) AS first FROM documents")
def first_integer(spark, sf):
    return documents(spark, sf).select("doc_id", X.first_integer(F.coalesce("text", F.lit(""))).alias("first"))


@query("article_always", f"WITH {LEGAL_SQL} SELECT CAST(doc_id AS VARCHAR) AS doc_id, unit_id, md5(article_text) AS digest FROM lu")
def article_always(spark, sf):
    return legal_units(spark, sf).select("doc_id", "unit_id", F.md5(pack.article_if_short(F.col("text"), F.col("article_text"), None)).alias("digest"))


@query(
    "answer_parts",
    "SELECT doc_id AS qid, 0 AS part_no, CASE WHEN doc_id % 2 = 0 THEN 'current' END AS role, md5('Hiện nay ' || source) AS digest FROM documents WHERE source IS NOT NULL UNION ALL SELECT doc_id, 1, 'previous', md5('Trước đây, theo luật cũ quy định như sau: ' || source) FROM documents WHERE doc_id % 2 = 0 AND source IS NOT NULL",
)
def answer_parts(spark, sf):
    old = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit(" Trước đây, theo luật cũ quy định như sau: "), "source")).otherwise("")
    rows = documents(spark, sf).where("source is not null").select(F.col("doc_id").alias("qid"), F.concat(F.lit("Hiện nay "), "source", old).alias("answer"))
    return align.parts(rows).select("qid", "part_no", "role", F.md5("part").alias("digest"))


@query(
    "targeted_output",
    "SELECT doc_id, ['targeted_xml_tags', 'targeted_wrong_tag', 'targeted_malformed_tags', 'targeted_missing_wrapper', 'targeted_empty'][doc_id % 5 + 1] AS method, doc_id % 5 = 0 AS valid, CASE WHEN doc_id % 5 = 0 THEN 'k' || doc_id ELSE '' END AS conclusion FROM documents",
)
def targeted_output(spark, sf):
    k, body = F.col("doc_id") % 5, F.concat(F.lit("k"), F.col("doc_id").cast("string"))
    wrapped = F.concat(F.lit("<CONCLUSION>"), body, F.lit("</CONCLUSION>"))
    raw = F.when(k == 0, wrapped).when(k == 1, F.concat(F.lit("<LEAD>"), body, F.lit("</LEAD>"))).when(k == 2, F.concat(wrapped, F.lit(" <CONCLUSION>"))).when(k == 3, body).otherwise(F.lit("<CONCLUSION> </CONCLUSION>"))
    return documents(spark, sf).select("doc_id", answers.parse_targeted(raw, "conclusion").alias("p")).select("doc_id", "p.method", "p.valid", "p.conclusion")


@query(
    "resolved_blocks",
    """SELECT doc_id, prefer, CASE WHEN doc_id % 2 = 0 THEN 'model_initial' WHEN doc_id % 3 = 0 THEN 'model_targeted_retry' ELSE 'template_fallback' END AS lead_source,
CASE WHEN prefer AND doc_id % 7 = 0 THEN 'model_quality_retry' WHEN doc_id % 5 = 0 THEN 'model_initial' WHEN doc_id % 7 = 0 THEN 'model_targeted_retry' ELSE 'missing' END AS conclusion_source,
CASE WHEN prefer AND doc_id % 7 = 0 THEN 'y' WHEN doc_id % 5 = 0 THEN 'x' WHEN doc_id % 7 = 0 THEN 'y' ELSE '' END AS conclusion, (doc_id % 2 = 0 OR doc_id % 3 = 0) AND (doc_id % 5 = 0 OR doc_id % 7 = 0) AS model_blocks_complete,
doc_id % 5 = 0 OR doc_id % 7 = 0 AS answer_complete FROM documents, (SELECT unnest([TRUE, FALSE]) AS prefer)""",
)
def resolved_blocks(spark, sf):
    d = F.col("doc_id")

    def block(lead_every, lead, end_every, end):
        return F.struct(F.when(d % lead_every == 0, lead).otherwise("").alias("lead"), F.when(d % end_every == 0, end).alias("conclusion"))

    rows = documents(spark, sf)
    args = block(2, "a", 5, "x"), block(3, "b", 1, ""), block(1, "", 7, "y"), X.citations(F.lit("Điều 2 Luật Mẫu 2020"))
    out = [rows.select("doc_id", F.lit(p).alias("prefer"), answers.resolve_blocks(*args, prefer_conclusion_retry=p).alias("b")) for p in (True, False)]
    return out[0].unionByName(out[1]).select("doc_id", "prefer", "b.lead_source", "b.conclusion_source", "b.conclusion", "b.model_blocks_complete", "b.answer_complete")


@query("longer_retry", "SELECT doc_id, doc_id % 2 = 0 AND doc_id % 3 = 0 AND doc_id % 5 <> 0 AND n_chars >= 500 AS needed FROM documents WHERE n_chars IS NOT NULL")
def longer_retry(spark, sf):
    d = F.col("doc_id")
    raw = F.concat(F.when(d % 2 == 0, "<CONCLUSION> a").otherwise("a"), F.when(d % 5 == 0, "</conclusion>").otherwise(""))
    return documents(spark, sf).where("n_chars is not null").select("doc_id", answers.needs_longer_retry(raw, d % 3 != 0, F.col("n_chars"), F.lit(500)).alias("needed"))


@query(
    "usable_examples",
    f"SELECT doc_id, doc_id % 3 > 0 AND trim(coalesce(text, ''), ' ' || chr(10)) <> '' AND length(trim(coalesce(text, ''), ' ' || chr(10))) <= 1600 AND coalesce(source, '') <> '' AND len({toks('text')}) <= 120 AS usable FROM documents",
)
def usable_examples(spark, sf):
    return documents(spark, sf).select("doc_id", answers.usable_example(F.col("text"), F.col("source"), F.col("text"), F.col("doc_id") % 3 > 0).alias("usable"))


@query(
    "package_problems",
    """WITH b AS (SELECT item_id AS i FROM benchmark), p AS (SELECT CASE WHEN i % 7 = 0 THEN ' ' WHEN i % 7 = 1 THEN 'same' ELSE CAST(i AS VARCHAR) END AS id, i FROM b)
SELECT id, 'missing_id' AS problem FROM p WHERE i % 7 = 0 UNION ALL SELECT id, 'missing_question' FROM p WHERE i % 5 = 0 UNION ALL SELECT id, 'missing_contexts' FROM p WHERE i % 4 = 0 UNION ALL SELECT id, 'missing_text' FROM p WHERE i % 4 = 1
UNION ALL SELECT 'same', 'repeated_id' FROM p WHERE i % 7 = 1 HAVING count(*) > 1""",
)
def package_problems(spark, sf):
    q = F.col("qid")
    text = lambda *t: F.array(*[F.struct(F.lit(x).cast("string").alias("text")) for x in t])
    contexts = F.when(q % 4 == 1, text("a", " ")).when(q % 4 > 1, text("a"))
    id = F.when(q % 7 == 0, " ").when(q % 7 == 1, "same").otherwise(q.cast("string"))
    return answers.violations(questions(spark, sf).select(id.alias("id"), F.when(q % 5 == 0, F.lit(None)).otherwise("x").alias("question"), contexts.alias("contexts")))


@query("hold_out")
def hold_out(spark, sf):
    """A tenth of the documents by hash; hashes differ between engines."""
    return metrics.hold_out(documents(spark, sf).select("doc_id"), "doc_id", 0.1)


@query("scored_submission")
def scored_submission(spark, sf):
    """Answers in a conversation against their questions; METEOR isn't SQL."""
    t = turns(spark, sf)
    return scoring.score_submission(t.select("id", F.col("question").alias("answer")), t.select("id", "answer"))


def _number(id):
    """A document's number, one for each id: a citation's first part has four digits at most, its last any."""
    id = id.cast("decimal(20,0)")
    first, last = F.abs(id) % 10_000, F.floor(F.abs(id) / 10_000) + 1
    return F.concat(first.cast("decimal(4,0)").cast("string"), F.when(id < 0, "/2019/QH").otherwise("/2020/QH"), last.cast("decimal(20,0)").cast("string"))


@query(
    "followed_numbers",
    """WITH n AS (SELECT doc_id, len(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x) <> '')) AS n FROM documents), h AS (SELECT n.doc_id AS qid, coalesce(m.doc_id, n.doc_id) AS to_doc FROM n LEFT JOIN n m ON m.doc_id = n.doc_id + 1 AND n.doc_id % 2 = 0)
SELECT qid, CAST(to_doc AS VARCHAR) AS doc_id, to_doc || '_1' AS article_id FROM h JOIN n ON n.doc_id = to_doc WHERE n.n > 0""",
)
def followed_numbers(spark, sf):
    """Texts of even documents cite the next document's first article by its number, others and those without a next one their own."""
    d = documents(spark, sf)
    before = d.select((F.col("doc_id") - 1).alias("doc_id"), F.lit(True).alias("has_next")).distinct()
    numbers = d.select(_number(F.col("doc_id")).alias("number"), F.array(F.col("doc_id")).alias("doc_ids"), F.lit(True).alias("usable"))
    text = F.when((F.col("doc_id") % 2 == 0) & F.col("has_next"), F.concat(F.lit("theo Điều 1 Luật số "), _number(F.col("doc_id") + 1))).otherwise("theo Điều 1 của Luật này")
    hits = d.join(before, "doc_id", "left").select(F.col("doc_id").alias("qid"), F.lit(1).alias("rank"), "doc_id", text.alias("text"))
    return lookup.followed(hits, legal_units(spark, sf), numbers).select("qid", "doc_id", "article_id")
