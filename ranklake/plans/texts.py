"""Queries over text functions, units and identities."""

from __future__ import annotations

from pyspark.sql import functions as F

from ranklake.functions import text as X
from ranklake.operators import lookup, metrics, parse
from ranklake.plans.registry import query
from ranklake.plans.tables import LEGAL_SQL, documents, parsed_legal, questions, sents, table, toks


@query("name_from_link", "SELECT page_id, CASE WHEN n = '' THEN 'unknown' ELSE n END AS name FROM (SELECT page_id, regexp_replace(string_split(regexp_replace(coalesce(url, ''), '/+$', ''), '/')[-1], '\\.aspx$', '') AS n FROM pages)")
def name_from_link(spark, sf):
    return table(spark, sf, "pages").select("page_id", X.name_from_link(F.col("url")).alias("name"))


@query("clean_passage", "SELECT doc_id, length(replace(replace(coalesce(text, ''), 'stupid', ' '), 'worthless', ' ')) AS n_chars, md5(replace(replace(coalesce(text, ''), 'stupid', ' '), 'worthless', ' ')) AS digest FROM documents")
def clean_passage(spark, sf):
    c = X.clean_passage(F.coalesce("text", F.lit("")), ("stupid", "worthless"))
    return documents(spark, sf).select("doc_id", F.length(c).cast("long").alias("n_chars"), F.md5(c).alias("digest"))


@query("normal_space", "SELECT doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '\\r\\n\\n?', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), '[ \\t]{2,}', ' ', 'g'), ' ' || chr(10) || chr(9) || chr(13))) AS digest FROM documents")
def normal_space(spark, sf):
    return documents(spark, sf).select("doc_id", F.md5(parse.normal_space(F.col("text"))).alias("digest"))


@query("token_stats", f"SELECT doc_id, CAST(len({toks('text')}) AS BIGINT) AS n_tokens, CAST(len(list_distinct({toks('lower(text)')})) AS BIGINT) AS n_distinct FROM documents")
def token_stats(spark, sf):
    c = F.col("text")
    return documents(spark, sf).select("doc_id", X.token_count(c).cast("long").alias("n_tokens"), F.size(X.token_set(c)).cast("long").alias("n_distinct"))


@query(
    "sentence_variants",
    f"""WITH s AS (SELECT item_id, trim(text, ' ' || chr(10)) AS t, {sents("text")} AS s FROM benchmark),
v AS (SELECT item_id, t, s, (SELECT x FROM (SELECT unnest(s) AS x, generate_subscripts(s, 1) AS i) ORDER BY length(x) DESC, i LIMIT 1) AS longest FROM s),
u AS (SELECT item_id, unnest(CASE WHEN len(s) > 1 THEN [t, longest, s[1], s[-1]] ELSE [t] END) AS variant FROM v)
SELECT DISTINCT item_id, variant FROM u""",
)
def sentence_variants(spark, sf):
    return questions(spark, sf).select(F.col("qid").alias("item_id"), F.explode(X.query_variants(F.col("question"))).alias("variant"))


@query("line_units", "SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos, md5(x) AS unit_id FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i, trim(line) AS x FROM documents) WHERE x <> ''")
def line_units(spark, sf):
    return parse.line_units(documents(spark, sf)).select("doc_id", "pos", "unit_id")


@query(
    "duplicate_unit_audit",
    """WITH l AS (SELECT doc_id, trim(unnest(string_split(coalesce(text, ''), chr(10)))) AS x FROM documents),
g AS (SELECT md5(x) AS k, count(*) AS n, min(doc_id) = max(doc_id) AS same FROM l WHERE x <> '' GROUP BY 1)
SELECT count(*) AS ids, CAST(sum(n) AS BIGINT) AS rows, count_if(n > 1) AS duplicated_ids, CAST(coalesce(sum(n) FILTER (WHERE n > 1), 0) AS BIGINT) AS rows_with_one,
       CAST(coalesce(sum(n - 1) FILTER (WHERE n > 1), 0) AS BIGINT) AS shadowed, count_if(n > 1 AND same) AS same_place, CAST(0 AS BIGINT) AS texts_differ FROM g""",
)
def duplicate_unit_audit(spark, sf):
    return metrics.duplicate_audit(parse.line_units(documents(spark, sf)))


@query("parse_legal", f"WITH {LEGAL_SQL} SELECT doc_id, count(*) AS n_articles, CAST(sum(n) AS BIGINT) AS n_clauses, md5(string_agg(title, '|' ORDER BY a)) AS titles FROM la GROUP BY doc_id")
def parse_legal(spark, sf):
    p = parsed_legal(spark, sf)
    clauses = F.aggregate("articles", F.lit(0).cast("long"), lambda n, a: n + F.size(a["clauses"]))
    return p.where(F.size("articles") > 0).select("doc_id", F.size("articles").cast("long").alias("n_articles"), clauses.alias("n_clauses"), F.md5(F.array_join("articles.title", "|")).alias("titles"))


@query("legal_units", f"WITH {LEGAL_SQL} SELECT CAST(doc_id AS VARCHAR) AS doc_id, CAST(article_pos AS INTEGER) AS article_pos, CAST(clause_pos AS INTEGER) AS clause_pos, unit_id, unit_type, clause_no, md5(text) AS text_digest, md5(title) AS title_digest, md5(article_text) AS article_digest FROM lu")
def legal_units(spark, sf):
    u = parse.units(parsed_legal(spark, sf))
    return u.select("doc_id", "article_pos", "clause_pos", "unit_id", "unit_type", "clause_no", F.md5("text").alias("text_digest"), F.md5("title").alias("title_digest"), F.md5("article_text").alias("article_digest"))


@query("unit_offsets", f"WITH {LEGAL_SQL} SELECT CAST(sum(n) + count_if(n = 0) AS BIGINT) AS n, CAST(sum(n) + count_if(n = 0) AS BIGINT) AS exact FROM la")
def unit_offsets(spark, sf):
    """Units whose offsets cut their own text out of the main text: all of them."""
    p = parsed_legal(spark, sf)
    u = parse.units(p).join(p.select(F.col("doc_id").cast("string").alias("doc_id"), "main_text"), "doc_id")
    exact = F.substring(F.col("main_text"), F.col("char_start") + 1, F.length("text")) == F.col("text")
    return u.agg(F.count(F.lit(1)).alias("n"), F.count_if(exact).alias("exact"))


@query("unit_with_title", f"WITH {LEGAL_SQL} SELECT CAST(doc_id AS VARCHAR) AS doc_id, unit_id, md5(CASE WHEN title <> article_text THEN title || chr(10) || text ELSE text END) AS digest FROM lu")
def unit_with_title(spark, sf):
    u = parse.units(parsed_legal(spark, sf))
    return u.select("doc_id", "unit_id", F.md5(parse.with_title(F.col("text"), F.col("title"), F.col("article_text"))).alias("digest"))


@query("unit_ids", f"WITH {LEGAL_SQL} SELECT unit_type AS kind, CASE WHEN unit_type = 'clause' THEN regexp_replace(unit_id, '_[^_]*$', '') ELSE unit_id END AS article_id, count(*) AS n FROM lu GROUP BY ALL")
def unit_ids(spark, sf):
    u = parse.units(parsed_legal(spark, sf))
    return u.groupBy(parse.unit_kind(F.col("unit_id")).alias("kind"), parse.article_of(F.col("unit_id")).alias("article_id")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "changed_units",
    """WITH l AS (SELECT doc_id, trim(line) AS x, i FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents))
SELECT doc_id, count(*) AS n FROM l WHERE x <> '' AND x <> trim(replace(x, 'the', 'THE')) GROUP BY doc_id""",
)
def changed_units(spark, sf):
    new = parse.line_units(documents(spark, sf))
    old = parse.line_units(documents(spark, sf).withColumn("text", F.replace("text", F.lit("the"), F.lit("THE"))))
    return parse.changed_units(old, new).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


@query("question_types", "SELECT CASE WHEN regexp_matches(lower(coalesce(text, '')), '(^|[^\\p{L}\\p{N}_])ai([^\\p{L}\\p{N}_]|$)') THEN 'subject' ELSE 'other' END AS kind, count(*) AS n FROM conversations WHERE role = 'user' GROUP BY 1")
def question_types(spark, sf):
    c = table(spark, sf, "conversations").where("role = 'user'")
    return c.groupBy(X.question_type(F.coalesce("text", F.lit(""))).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("content_tokens", "SELECT item_id, CAST(len(list_distinct(list_filter(list_transform(regexp_extract_all(text, '[0-9a-zA-ZÀ-ỹĐđ]+'), lambda x: lower(x)), lambda x: length(x) > 1 AND NOT list_contains(['ai','bao','các','có','của','được','gì','hay','không','là','một','nào','những','phải','theo','thế','thì','trong','và','về'], x)))) AS BIGINT) AS n FROM benchmark")
def content_tokens(spark, sf):
    return questions(spark, sf).select(F.col("qid").alias("item_id"), F.size(X.content_tokens(F.col("question"))).cast("long").alias("n"))


@query("repeated_ngrams", f"WITH t AS (SELECT doc_id, {toks('lower(text)')} AS w FROM documents), g AS (SELECT doc_id, len(w) AS n, list_transform(range(1, greatest(len(w) - 2, 1)), lambda i: array_to_string(w[i:i + 3], ' ')) AS g FROM t) SELECT doc_id, CASE WHEN n >= 4 THEN round(1 - len(list_distinct(g)) / len(g), 6) ELSE 0.0 END AS ratio FROM g")
def repeated_ngrams(spark, sf):
    return documents(spark, sf).select("doc_id", F.round(X.repeated_ngrams(X.tokens(F.lower("text")), 4), 6).alias("ratio"))


@query("same_question", "SELECT doc_id AS qid_a, min(doc_id) OVER (PARTITION BY trim(text, ' ' || chr(10))) AS qid_b FROM documents WHERE text IS NOT NULL")
def same_question(spark, sf):
    """All documents against one of each class of equal texts: a pair a document, however large the class."""
    d = documents(spark, sf).select(F.col("doc_id").alias("qid"), F.col("text").alias("question"))
    first = d.groupBy(X.strip(F.col("question")).alias("question")).agg(F.min("qid").alias("qid"))
    return lookup.same_question(d, first)


@query("question_classes", "SELECT doc_id AS qid, min(doc_id) OVER w AS class_id, count(*) OVER w AS n FROM documents WHERE text IS NOT NULL WINDOW w AS (PARTITION BY trim(text, ' ' || chr(10)))")
def question_classes(spark, sf):
    """``same_question`` over all documents: a row each instead of all pairs."""
    return lookup.question_classes(documents(spark, sf).select(F.col("doc_id").alias("qid"), F.col("text").alias("question")))


@query("document_numbers", f"WITH {LEGAL_SQL}, n AS (SELECT doc_id, (doc_id % 50) || '/2020/QH' || (doc_id % 7) AS number FROM ll) SELECT number, CAST(min(doc_id) AS BIGINT) AS first_doc, count(*) AS n_docs, count(*) = 1 AS usable FROM n GROUP BY number")
def document_numbers(spark, sf):
    number = F.concat((F.col("doc_id") % 50).cast("string"), F.lit("/2020/qh"), (F.col("doc_id") % 7).cast("string"))
    d = documents(spark, sf).select("doc_id", F.concat(F.lit("Số: "), number, F.lit(".\n"), F.coalesce("text", F.lit(""))).alias("passage"))
    i = lookup.number_index(d)
    return i.select("number", F.element_at("doc_ids", 1).alias("first_doc"), F.size("doc_ids").cast("long").alias("n_docs"), "usable")
