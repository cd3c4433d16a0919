"""Queries over answers: blocks, checks, retries, bundles and submissions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ranklake.functions import text as X
from ranklake.operators import answers
from ranklake.plans.evaluation import turns
from ranklake.plans.packing import CAND_SQL, candidates
from ranklake.plans.registry import query
from ranklake.plans.tables import documents, questions, table, toks


def written(spark, sf):
    """(doc_id, answer): documents as answers: the first line, a quotation, and a last line that a marker opens."""
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.trim(x) != "")
    # Not ``F.trim`` itself: that takes the element's index for the characters to trim.
    d = documents(spark, sf).select("doc_id", F.transform(lines, lambda x: F.trim(x)).alias("l")).where(F.size("l") >= 3)
    n = F.size("l")
    return d.select("doc_id", F.concat_ws("\n", F.lit("Căn cứ Điều 5 Luật Mẫu 2020:"), F.array_join(F.slice("l", 1, n - 1), "\n"), F.concat(F.lit("Theo đó, "), F.element_at("l", -1))).alias("answer"))


WRITTEN_SQL = "l AS (SELECT doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l FROM documents), wr AS (SELECT doc_id, array_to_string(l[1:len(l) - 1], chr(10)) AS quotation, 'Theo đó, ' || l[-1] AS conclusion FROM l WHERE len(l) >= 3)"


@query("split_answer_first", f"WITH {WRITTEN_SQL} SELECT doc_id, md5('Căn cứ Điều 5 Luật Mẫu 2020:') AS lead, md5(quotation) AS quotation, md5(conclusion) AS conclusion, 'high' AS confidence, 'first_line+marker:Theo đó' AS method FROM wr")
def split_answer_first(spark, sf):
    b = written(spark, sf).select("doc_id", answers.split_first(F.col("answer")).alias("b"))
    return b.select("doc_id", F.md5("b.lead").alias("lead"), F.md5("b.quotation").alias("quotation"), F.md5("b.conclusion").alias("conclusion"), "b.confidence", "b.method")


@query("split_answer_last", f"WITH {WRITTEN_SQL} SELECT doc_id, md5('Căn cứ Điều 5 Luật Mẫu 2020:') AS lead, md5(quotation) AS quotation, md5(conclusion) AS conclusion FROM wr")
def split_answer_last(spark, sf):
    b = written(spark, sf).select("doc_id", answers.split_last(F.col("answer")).alias("b"))
    return b.select("doc_id", F.md5("b.lead").alias("lead"), F.md5("b.quotation").alias("quotation"), F.md5("b.conclusion").alias("conclusion"))


@query("assemble_answer", f"WITH {WRITTEN_SQL} SELECT doc_id, md5('Căn cứ Điều 5 Luật Mẫu 2020:' || chr(10) || quotation || chr(10) || conclusion) AS digest FROM wr")
def assemble_answer(spark, sf):
    b = written(spark, sf).select("doc_id", answers.split_first(F.col("answer")).alias("b"))
    return b.select("doc_id", F.md5(answers.assemble(F.col("b.lead"), F.col("b.quotation"), F.col("b.conclusion"))).alias("digest"))


@query("eligibility", f"WITH {WRITTEN_SQL} SELECT doc_id, length(quotation) <= 12000 AND length(conclusion) <= 1800 AS eligible FROM wr")
def eligibility(spark, sf):
    b = written(spark, sf).select("doc_id", answers.split_first(F.col("answer")).alias("b"))
    return b.select("doc_id", (F.size(answers.eligibility(F.col("b"))) == 0).alias("eligible"))


@query("citation_metadata", "SELECT doc_id, (doc_id % 90 + 1) || '/2017/NĐ-CP' AS document_number, 'Điều ' || (doc_id % 9 + 1) AS article, 'khoản ' || (doc_id % 5 + 1) AS clause, 'điểm a' AS point, (doc_id % 90 + 1) || '/2017/NĐ-CP|điều ' || (doc_id % 9 + 1) || '|khoản ' || (doc_id % 5 + 1) AS signature FROM documents")
def citation_metadata(spark, sf):
    lead = F.format_string("Căn cứ điểm a khoản %d Điều %d Nghị định %d/2017/NĐ-CP và Điều %d quy định:", F.col("doc_id") % 5 + 1, F.col("doc_id") % 9 + 1, F.col("doc_id") % 90 + 1, F.col("doc_id") % 9 + 1)
    rows = documents(spark, sf).select("doc_id", lead.alias("lead"))
    c = rows.select("doc_id", X.citations(F.col("lead")).alias("c"), X.citation_signature(F.col("lead"), F.col("doc_id").cast("string")).alias("signature"))
    return c.select("doc_id", F.array_join("c.document_numbers", ";").alias("document_number"), F.array_join("c.articles", ";").alias("article"), F.array_join("c.clauses", ";").alias("clause"), F.array_join("c.points", ";").alias("point"), "signature")


@query("fallback_lead", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'Căn cứ nội dung pháp luật được cung cấp, quy định liên quan như sau:' ELSE 'Căn cứ theo Điều ' || (doc_id % 9 + 1) || ' Luật Mẫu 2020, quy định liên quan như sau:' END AS lead FROM documents")
def fallback_lead(spark, sf):
    text = F.when(F.col("doc_id") % 3 != 0, F.format_string("Theo Điều %d Luật Mẫu 2020", F.col("doc_id") % 9 + 1)).otherwise("")
    return documents(spark, sf).select("doc_id", answers.fallback_lead(X.citations(text)).alias("lead"))


@query("parse_model_output", "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'xml_tags' WHEN 1 THEN 'partial_xml_tags' WHEN 2 THEN 'json' ELSE 'unparsed' END AS method, doc_id % 2 = 0 AS valid, CASE WHEN doc_id % 4 < 3 THEN lang ELSE '' END AS conclusion FROM documents")
def parse_model_output(spark, sf):
    k = F.col("doc_id") % 4
    raw = (
        F.when(k == 0, F.concat(F.lit("<LEAD>"), "source", F.lit("</LEAD>\n<CONCLUSION> "), "lang", F.lit(" </CONCLUSION>"))).when(k == 1, F.concat(F.lit("<conclusion>"), "lang", F.lit("</conclusion>")))
        .when(k == 2, F.to_json(F.struct(F.col("source").alias("lead"), F.col("lang").alias("conclusion")))).otherwise(F.col("lang"))
    )
    p = documents(spark, sf).select("doc_id", answers.parse_output(raw).alias("p"))
    return p.select("doc_id", "p.method", "p.valid", "p.conclusion")


@query("conclusion_gates", f"SELECT id, CASE WHEN answer IS NULL OR trim(answer) = '' THEN 'missing_conclusion' ELSE '' END AS issues FROM (SELECT conv_id || ':' || turn AS id, role, lead(role) OVER w AS nxt, lead(text) OVER w AS answer FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND nxt = 'assistant'")
def conclusion_gates(spark, sf):
    t = turns(spark, sf)
    issues = answers.conclusion_issues(F.coalesce("question", F.lit("")), F.coalesce("question", F.lit("")), F.coalesce("answer", F.lit("")))
    return t.select("id", F.array_join(issues, ",").alias("issues"))


@query("retry_decisions")
def retry_decisions(spark, sf):
    """Whether a longer answer may replace a shorter one; the weights' inputs are Vietnamese expressions, tested on literals."""
    t = turns(spark, sf).select("id", F.coalesce("question", F.lit("")).alias("question"), F.coalesce("question", F.lit("")).alias("context"), F.substring(F.coalesce("answer", F.lit("")), 1, 80).alias("initial"), F.coalesce("answer", F.lit("")).alias("retry"))
    return answers.soft_decision(t).select("id", "initial_score", "retry_score", "accepted", F.array_join("reasons", ",").alias("reasons"))


def _packages(spark, sf):
    c = candidates(spark, sf, 5)
    item = F.struct(F.struct(F.lit("").alias("name"), F.lit("").alias("link")).alias("document"), F.col("unit_id").alias("document_number"), F.lit("").alias("article"), F.lit("").alias("clause"), F.lit("").alias("article_title"), F.col("text"), F.col("score").alias("retrieval_score"))
    lists = c.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", item.alias("item")))), lambda x: x["item"]).alias("contexts"))
    return questions(spark, sf).join(lists, "qid", "left").select(F.col("qid").cast("string").alias("id"), "question", "contexts", F.lit(None).cast("string").alias("reference_answer"))


@query("context_bundle", f"{CAND_SQL}, f AS (SELECT *, lower(array_to_string({toks('text')}, ' ')) AS k FROM cand WHERE rank <= 3), o AS (SELECT * FROM f WHERE k <> '' QUALIFY row_number() OVER (PARTITION BY qid, k ORDER BY rank) = 1) SELECT CAST(qid AS VARCHAR) AS id, count(*) AS n, string_agg(doc_id, ',' ORDER BY rank) AS numbers FROM o GROUP BY qid")
def context_bundle(spark, sf):
    b = answers.bundle(_packages(spark, sf).where("contexts is not null"), 3)
    return b.select("id", F.col("bundle.selected_context_count").cast("long").alias("n"), F.array_join("bundle.citation_metadata.document_numbers", ",").alias("numbers"))


@query("package_violations", "SELECT CAST(item_id AS VARCHAR) AS id, 'missing_question' AS problem FROM benchmark WHERE item_id % 5 = 0 UNION ALL SELECT CAST(item_id AS VARCHAR), 'missing_contexts' FROM benchmark")
def package_violations(spark, sf):
    none = F.array().cast("array<struct<text: string>>")
    p = questions(spark, sf).select(F.col("qid").cast("string").alias("id"), F.when(F.col("qid") % 5 == 0, " ").otherwise(F.col("question")).alias("question"), none.alias("contexts"))
    return answers.violations(p)


@query("submission", "SELECT doc_id AS id, lang AS answer FROM documents")
def submission(spark, sf):
    return answers.submission(documents(spark, sf).select(F.col("doc_id").alias("id"), F.col("lang").alias("answer")))


@query("score_status", "SELECT count(*) AS n, count_if(quality = 1) AS with_reference, CASE WHEN count_if(quality = 1) = 0 THEN 'not_available_no_reference' WHEN count_if(quality = 1) = count(*) THEN 'scored' ELSE 'partial_reference' END AS status FROM labels")
def score_status(spark, sf):
    return answers.score_status(table(spark, sf, "labels").select(F.when(F.col("quality") == 1, "x").alias("reference_answer")))


@query("few_shot")
def few_shot(spark, sf):
    """Two examples for each passage among the others; rounding of similarities is engine-specific, tested on literals."""
    q = questions(spark, sf).select(F.col("qid"), F.col("qid").alias("id"), "question", F.length("question").alias("context_length"), (F.col("qid") % 7).cast("string").alias("citation_group"))
    return answers.few_shot(q, q)


@query("shards", "SELECT item_id, CAST(item_id % 2 AS INTEGER) AS shard, item_id AS seed FROM benchmark")
def shards(spark, sf):
    return answers.shard(table(spark, sf, "benchmark").select("item_id"), 2, "item_id").select("item_id", "shard", "seed")
