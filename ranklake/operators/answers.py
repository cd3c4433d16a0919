"""Answers in three blocks: splitting, checks, retries, bundles of context and submissions; all SQL expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ranklake.functions import text as X

# --- fixed values: words that open a conclusion, and what disqualifies one ----------------------------------------------
FIRST_MARKERS = ("Theo đó", "Như vậy", "Do đó", "Vì vậy", "Từ đó", "Đồng thời", "Như đã phân tích")
LAST_MARKERS = ("Như vậy", "Theo đó", "Do đó", "Vì vậy", "Từ đó", "Như đã phân tích", "Tóm lại")
NESTED_QUOTE = r"(?imU)^(?:Căn cứ\b|Trước đây,\s*căn cứ\b|Hiện nay,\s*theo\s+quy\s+định\b|Theo\s+(?:Điều|khoản)\b|Tại\s+Điều\b)"
WEB_NOISE = r"(?iU)\(Hình từ Internet\)|Thư Viện Pháp Luật"
FALLBACK_LEAD = "Căn cứ theo %s, quy định liên quan như sau:"
BARE_LEAD = "Căn cứ nội dung pháp luật được cung cấp, quy định liên quan như sau:"
# ------------------------------------------------------------------------------------------------------------------------


def split_first(answer: Column) -> Column:
    """The first line, what follows up to the first line that opens with a marker, and the rest.

    struct<lead, quotation, conclusion, confidence, method, and start and end of each>; low confidence where a part is missing.
    """
    t = X.normal_newlines(F.coalesce(answer, F.lit("")))
    lead_end = F.length(F.element_at(F.split(t, "\n", 2), 1))
    rest = F.substring(t, lead_end + 1, F.length(t))
    quote_start = lead_end + F.length(rest) - F.length(F.regexp_replace(rest, "^[\n \t]+", ""))
    # A marker may stand at the start of any line but the quotation's first character.
    tail = F.substring(t, quote_start + 2, F.length(t))
    marker = rf"(?imU)^\s*({'|'.join(FIRST_MARKERS)})\b"
    before = F.element_at(F.split(tail, marker, 2), 1)
    # ^ would also match at the start of ``tail``, which is inside a line.
    first = F.regexp_extract(tail, marker, 1)
    inside = (before == "") & tail.rlike(rf"(?iU)^(?:{'|'.join(FIRST_MARKERS)})\b")
    later = F.substring(tail, F.length(F.element_at(F.split(tail, "\n", 2), 1)) + 2, F.length(tail))
    skip = F.when(inside, F.length(tail) - F.length(later)).otherwise(0)
    body = F.when(inside, later).otherwise(tail)
    found = body.rlike(marker) & (first != "")
    at = quote_start + 1 + skip + F.length(F.element_at(F.split(body, marker, 2), 1))
    cut = F.when(found, at).otherwise(F.length(t))
    lead = X.strip(F.substring(t, 1, lead_end))
    quotation = X.strip(F.substring(t, quote_start + 1, cut - quote_start))
    conclusion = F.when(found, X.strip(F.substring(t, cut + 1, F.length(t)))).otherwise("")
    high = found & (lead != "") & (quotation != "") & (conclusion != "")
    method = F.when(t == "", "empty").when(found, F.concat(F.lit("first_line+marker:"), F.regexp_extract(body, marker, 1))).otherwise("first_line+no_marker")
    spot = {"lead_start": F.lit(0), "lead_end": lead_end, "quotation_start": F.when(t == "", 0).otherwise(quote_start), "quotation_end": cut, "conclusion_start": cut, "conclusion_end": F.length(t)}
    return F.struct(
        lead.alias("lead"), quotation.alias("quotation"), conclusion.alias("conclusion"), F.when(high, "high").otherwise("low").alias("confidence"), method.alias("method"),
        *[c.cast("int").alias(n) for n, c in spot.items()],
    )


def split_last(answer: Column) -> Column:
    """struct<lead, quotation, conclusion>, where the last marker opens the conclusion; all empty where a part is missing."""
    t = X.normal_newlines(F.coalesce(answer, F.lit("")))
    lead = X.strip(F.element_at(F.split(t, "\n", 2), 1))
    rest = F.regexp_replace(F.substring(t, F.length(F.element_at(F.split(t, "\n", 2), 1)) + 1, F.length(t)), "^[\n \t]+", "")
    pattern = rf"(?sU)^(.*\n\s*|\s*)((?:{'|'.join(LAST_MARKERS)})\b.*)$"
    quotation, conclusion = X.strip(F.regexp_extract(rest, pattern, 1)), X.strip(F.regexp_extract(rest, pattern, 2))
    ok = (lead != "") & (quotation != "") & (conclusion != "")
    return F.struct(*[F.when(ok, c).otherwise("").alias(n) for n, c in (("lead", lead), ("quotation", quotation), ("conclusion", conclusion))])


def assemble(*parts: Column) -> Column:
    """Parts that aren't blank, a line each."""
    return F.array_join(F.filter(F.array(*[X.strip(F.coalesce(p, F.lit(""))) for p in parts]), lambda p: p != ""), "\n")


def reasons(**flags: Column) -> Column:
    """Names of the flags that hold, in order."""
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), n) for n, c in flags.items()]))


def eligibility(blocks: Column) -> Column:
    """What disqualifies split blocks from comparison; an empty array if nothing does."""
    return reasons(
        split_not_high_confidence=blocks["confidence"] != "high", lead_too_long=F.length(blocks["lead"]) > 600, quotation_too_long=F.length(blocks["quotation"]) > 12_000,
        conclusion_too_long=F.length(blocks["conclusion"]) > 1_800, nested_legal_quote_in_conclusion=blocks["conclusion"].rlike(NESTED_QUOTE), web_page_noise=blocks["conclusion"].rlike(WEB_NOISE),
    )


def _tag(c: Column, name: str) -> tuple[Column, Column]:
    pattern = rf"(?is)<{name}>(.*?)</{name}>"
    return c.rlike(pattern), X.strip(F.regexp_extract(c, pattern, 1))


def parse_output(raw: Column) -> Column:
    """struct<lead, conclusion, valid, method> of a model's text: tags, else a JSON object, else nothing."""
    c = X.strip(F.coalesce(raw, F.lit("")))
    (has_lead, lead), (has_end, end) = _tag(c, "LEAD"), _tag(c, "CONCLUSION")
    tagged = has_lead | has_end
    fields = F.from_json(c, "struct<lead: string, conclusion: string, _corrupt: string>", {"columnNameOfCorruptRecord": "_corrupt"})
    is_json = c.startswith("{") & fields["_corrupt"].isNull()
    j_lead, j_end = (X.strip(F.coalesce(fields[k], F.lit(""))) for k in ("lead", "conclusion"))
    a, b = F.when(tagged, lead).when(is_json, j_lead).otherwise(""), F.when(tagged, end).when(is_json, j_end).otherwise("")
    valid = (a != "") & (b != "")
    method = F.when(tagged & valid, "xml_tags").when(tagged, "partial_xml_tags").when(is_json & valid, "json").when(is_json, "partial_json").otherwise("unparsed")
    return F.struct(a.alias("lead"), b.alias("conclusion"), valid.alias("valid"), method.alias("method"))


def parse_targeted(raw: Column, target: str) -> Column:
    """As ``parse_output`` for a retry of one block: only a text that is just its wrapper counts."""
    if target not in ("lead", "conclusion"):
        raise ValueError(f"no such block: {target}")
    c = F.regexp_replace(X.strip(F.coalesce(raw, F.lit(""))), r"(?i)^```(?:xml|json|text)?\s*", "")
    c = X.strip(F.regexp_replace(c, r"\s*```$", ""))
    tag, other = target.upper(), "CONCLUSION" if target == "lead" else "LEAD"
    any_tag = r"(?i)</?(?:LEAD|CONCLUSION)\b[^>]*>"
    whole = rf"(?is)^<{tag}>\s*(.*?)\s*</{tag}>\z"
    value = X.strip(F.regexp_extract(c, whole, 1))
    method = (
        F.when(c.rlike(rf"(?i)</?{other}\b"), "targeted_wrong_tag").when(~c.rlike(whole) & c.rlike(any_tag), "targeted_malformed_tags").when(~c.rlike(whole), "targeted_missing_wrapper")
        .when(value.rlike(any_tag), "targeted_malformed_tags").when(value == "", "targeted_empty").otherwise("targeted_xml_tags")
    )
    valid = method == "targeted_xml_tags"
    got = F.when(valid, value).otherwise("")
    blank = F.lit("")
    return F.struct((got if target == "lead" else blank).alias("lead"), (got if target == "conclusion" else blank).alias("conclusion"), valid.alias("valid"), method.alias("method"))


def needs_longer_retry(raw: Column, valid: Column, output_tokens: Column, most: Column) -> Column:
    """Whether the conclusion was cut off at the token limit."""
    low = F.lower(raw)
    return ~valid & (output_tokens >= most) & F.contains(low, F.lit("<conclusion>")) & ~F.contains(low, F.lit("</conclusion>"))


def conclusion_issues(question: Column, context: Column, conclusion: Column) -> Column:
    """Likely omissions of a conclusion, from the question and the context alone."""
    c = X.squeeze(conclusion)
    n, kind, items = X.token_count(c), X.question_type(question), X.list_items(context)
    wanted = F.least(F.lit(2), F.size(X.amounts(context)))
    issues = reasons(
        vague_reference=c.rlike(X.VAGUE), short_list_answer=(kind == "procedure_or_list") & (items >= 2) & (n < 45), short_condition_answer=(kind == "condition") & (items >= 2) & (n < 40),
        missing_numeric_facts=(kind == "number_or_time") & (wanted > 0) & (F.size(X.amounts(c)) < wanted),
    )
    return F.when(c == "", F.array(F.lit("missing_conclusion"))).otherwise(issues)


def _changed(a: Column, b: Column) -> Column:
    return X.polarity(a) != X.polarity(b)


def _lost(a: Column, b: Column) -> Column:
    return F.size(F.array_except(X.amounts(a), X.amounts(b))) > 0


def retry_vetoes(question: Column, context: Column, initial: Column, retry: Column) -> Column:
    """Why a retried conclusion must not replace the first one; an empty array if it may."""
    kind = X.question_type(question)
    was, now = F.size(conclusion_issues(question, context, initial)), F.size(conclusion_issues(question, context, retry))
    shorter = kind.isin("procedure_or_list", "condition") & (X.token_count(retry) < X.token_count(initial))
    vetoes = reasons(
        yes_no_guard=kind == "yes_no", initial_not_flagged=was == 0, quality_not_improved=(was > 0) & (now >= was), polarity_changed=_changed(initial, retry), lost_numeric_fact=_lost(initial, retry),
        candidate_shorter=shorter,
    )
    return F.when(X.squeeze(retry) == "", F.array(F.lit("retry_empty"))).otherwise(vetoes)


def soft_score(question: Column, context: Column, answer: Column, initial: Column) -> Column:
    """Weighted score of an answer: issues, coverage of the question, of list items and of amounts, retention, length, repetition."""
    given = F.struct(
        X.content_tokens(question).alias("q"), X.content_tokens(answer).alias("a"), X.content_tokens(initial).alias("first"), X.list_items(context).alias("items"), X.amounts(context).alias("numbers"),
    )
    return X.let(given, lambda g: _weighted(question, context, answer, g["q"], g["a"], g["first"], g["items"], g["numbers"]))


def _weighted(question: Column, context: Column, answer: Column, q: Column, a: Column, first: Column, items: Column, numbers: Column) -> Column:
    keyword = F.when(F.size(q) > 0, X.overlap(q, a) / F.size(q)).otherwise(0.0)
    listed = F.when(items > 0, F.least(F.lit(1.0), X.list_items(answer) / items)).otherwise(0.0)
    numeric = F.when(F.size(numbers) > 0, F.least(F.lit(1.0), X.overlap(numbers, X.amounts(answer)) / F.least(F.lit(2), F.size(numbers)))).otherwise(0.0)
    retained = F.when(F.size(first) > 0, X.overlap(first, a) / F.size(first)).otherwise(1.0)
    budget = F.greatest(F.lit(220), F.least(F.lit(320), 18 * items))
    verbose = F.greatest(F.lit(0.0), (X.token_count(answer) - budget) / budget)
    words = F.transform(F.regexp_extract_all(answer, F.lit(f"({X.CONTENT_WORD})"), F.lit(1)), F.lower)
    return -4.0 * F.size(conclusion_issues(question, context, answer)) + 3.0 * keyword + 3.0 * listed + 2.0 * numeric + retained - 8.0 * verbose - 3.0 * X.repeated_ngrams(words, 4)


def soft_decision(rows: DataFrame, margin: float = 0.75) -> DataFrame:
    """rows (question, context, initial, retry) with initial_score, retry_score, reasons and accepted."""
    q, c, i, r = (F.col(x) for x in ("question", "context", "initial", "retry"))
    scored = rows.withColumn("initial_score", soft_score(q, c, i, i)).withColumn("retry_score", soft_score(q, c, r, i))
    safety = reasons(retry_empty=X.squeeze(r) == "", yes_no_guard=X.question_type(q) == "yes_no", polarity_changed=_changed(i, r), lost_numeric_fact=_lost(i, r))
    low = F.when((F.size("safety") == 0) & (F.col("retry_score") < F.col("initial_score") + margin), F.array(F.lit("score_margin_not_met"))).otherwise(F.array().cast("array<string>"))
    out = scored.withColumn("safety", safety).withColumn("reasons", F.concat("safety", low)).drop("safety")
    return out.withColumn("accepted", F.size("reasons") == 0).withColumns({x: F.round(x, 6) for x in ("initial_score", "retry_score")})


def fallback_lead(meta: Column) -> Column:
    """A lead from citations: points, clauses and articles, then named documents or else document numbers."""
    def live(k: str) -> Column:
        return F.filter(F.transform(F.coalesce(meta[k], F.array().cast("array<string>")), X.strip), lambda x: x != "")

    named = live("named_documents")
    documents = F.when(F.size(named) > 0, named).otherwise(live("document_numbers"))
    cited = F.array_join(F.concat(live("points"), live("clauses"), live("articles"), documents), " ")
    return F.when(cited != "", F.format_string(FALLBACK_LEAD, cited)).otherwise(BARE_LEAD)


def resolve_blocks(initial: Column, retry_lead: Column, retry_conclusion: Column, meta: Column, prefer_conclusion_retry: bool = False) -> Column:
    """struct<lead, conclusion, lead_source, conclusion_source, model_blocks_complete, answer_complete> by precedence."""
    def live(c: Column) -> Column:
        return F.when(F.coalesce(c, F.lit("")) != "", c)

    a, b = live(initial["lead"]), live(retry_lead["lead"])
    x, y = live(initial["conclusion"]), live(retry_conclusion["conclusion"])
    lead_source = F.when(a.isNotNull(), "model_initial").when(b.isNotNull(), "model_targeted_retry").otherwise("template_fallback")
    if prefer_conclusion_retry:
        conclusion, source = F.coalesce(y, x, F.lit("")), F.when(y.isNotNull(), "model_quality_retry").when(x.isNotNull(), "model_initial").otherwise("missing")
    else:
        conclusion, source = F.coalesce(x, y, F.lit("")), F.when(x.isNotNull(), "model_initial").when(y.isNotNull(), "model_targeted_retry").otherwise("missing")
    lead = F.coalesce(a, b, fallback_lead(meta))
    complete = (a.isNotNull() | b.isNotNull()) & (x.isNotNull() | y.isNotNull())
    return F.struct(
        lead.alias("lead"), conclusion.alias("conclusion"), lead_source.alias("lead_source"), source.alias("conclusion_source"), complete.alias("model_blocks_complete"),
        ((lead != "") & (conclusion != "")).alias("answer_complete"),
    )


def violations(packages: DataFrame) -> DataFrame:
    """(id, problem) of packages (id, question, contexts): missing or repeated ids, questions, contexts and texts."""
    def blank(c: Column) -> Column:
        return X.strip(F.coalesce(c, F.lit(""))) == ""

    repeated = packages.where(~blank(F.col("id"))).groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id", F.lit("repeated_id").alias("problem"))
    found = reasons(
        missing_id=blank(F.col("id")), missing_question=blank(F.col("question")), missing_contexts=F.coalesce(F.size("contexts"), F.lit(0)) <= 0,
        missing_text=F.exists(F.coalesce(F.col("contexts"), F.array().cast(packages.schema["contexts"].dataType)), lambda c: blank(c["text"])),
    )
    return packages.select("id", F.explode(found).alias("problem")).unionByName(repeated)


def bundle(packages: DataFrame, k: int) -> DataFrame:
    """packages with bundle: struct<text, the five lists of citations, selected, available> of the first k contexts.

    Contexts whose text differs from an earlier one in case and space only are left out.
    """
    first = F.filter(F.slice("contexts", 1, k), lambda c: X.strip(c["text"]) != "")
    keys = F.transform("__first", lambda c: X.dedup_key(c["text"]))
    rows = packages.withColumn("__first", first).withColumn("__keys", keys)
    once = F.filter("__first", lambda c, i: F.array_position("__keys", F.get("__keys", i)) == i + 1)
    rows = rows.withColumn("__once", once)

    def listed(get) -> Column:
        return F.array_distinct(F.filter(F.transform("__once", lambda c: X.strip(F.coalesce(get(c), F.lit("")))), lambda x: x != ""))

    meta = F.struct(
        listed(lambda c: c["document_number"]).alias("document_numbers"), listed(lambda c: c["document"]["name"]).alias("named_documents"), listed(lambda c: c["article"]).alias("articles"),
        listed(lambda c: c["clause"]).alias("clauses"), F.array().cast("array<string>").alias("points"),
    )
    text = F.array_join(F.transform("__once", lambda c: X.strip(c["text"])), "\n\n")
    out = F.struct(text.alias("text"), meta.alias("citation_metadata"), F.size("__once").alias("selected_context_count"), F.size("contexts").alias("available_context_count"))
    return rows.withColumn("bundle", out).drop("__first", "__keys", "__once")


def submission(results: DataFrame) -> DataFrame:
    """(id, answer); fails on a repeated id."""
    counted = results.groupBy("id").agg(F.first("answer").alias("answer"), F.count(F.lit(1)).alias("n"))
    checked = F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("repeated id "), F.col("id").cast("string"))).cast("string")).otherwise(F.col("answer"))
    return counted.select("id", checked.alias("answer"))


def score_status(packages: DataFrame) -> DataFrame:
    """(n, with_reference, status): scored, partial_reference or not_available_no_reference."""
    has = F.col("reference_answer").isNotNull()
    n = F.count(F.lit(1))
    status = F.when(F.count_if(has) == 0, "not_available_no_reference").when(F.count_if(has) == n, "scored").otherwise("partial_reference")
    return packages.agg(n.alias("n"), F.count_if(has).alias("with_reference"), status.alias("status"))


def usable_example(context: Column, lead: Column, conclusion: Column, eligible: Column) -> Column:
    a, b, c = (X.strip(F.coalesce(x, F.lit(""))) for x in (context, lead, conclusion))
    return eligible & (a != "") & (b != "") & (c != "") & (F.length(a) <= 1_600) & (X.token_count(b) <= 60) & (X.token_count(c) <= 120)


def few_shot(queries: DataFrame, examples: DataFrame, k: int = 2) -> DataFrame:
    """(qid, id, score, nth): the k examples (id, question, context_length, citation_group) nearest to each query.

    10 for the same type of question, 4 times the Jaccard similarity of content tokens, and similarity of context lengths. The
    query's own id and group are left out, and of each group one example is taken. Queries meet examples by type, and only the
    best of each group is kept.
    """
    def described(d: DataFrame, p: str) -> DataFrame:
        return d.select(
            F.col("qid" if p == "q" else "id").alias(f"{p}id"), X.question_type(F.col("question")).alias(f"{p}type"), X.content_tokens(F.col("question")).alias(f"{p}tokens"),
            F.col("context_length").alias(f"{p}len"), F.coalesce("citation_group", F.lit("")).alias(f"{p}group"),
        )

    q, e = described(queries, "q"), described(examples, "e")

    def best_of(asked: DataFrame) -> DataFrame:
        """The best example of each group for queries that meet those of type ``want``."""
        pairs = asked.join(e, (F.col("want") == F.col("etype")) & (F.col("qid") != F.col("eid")) & ((F.col("qgroup") == "") | (F.col("qgroup") != F.col("egroup"))))
        near = 1 - F.least(F.lit(1.0), F.abs(F.col("elen") - F.col("qlen")) / F.greatest(F.lit(1), F.col("qlen")))
        score = F.round(10.0 * (F.col("qtype") == F.col("etype")).cast("int") + 4.0 * X.jaccard(F.col("qtokens"), F.col("etokens")) + near, 9)
        own = F.when(F.col("egroup") == "", F.concat(F.lit("id:"), F.col("eid").cast("string"))).otherwise(F.col("egroup"))
        return pairs.groupBy("qid", own.alias("g")).agg(F.min(F.struct((-score).alias("s"), F.col("eid").cast("string").alias("eid"))).alias("m"))

    # Another type costs more than all else can gain, so other types are met only by queries with too few groups of their own.
    same = best_of(q.withColumn("want", F.col("qtype")))
    full = same.groupBy("qid").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= k).select("qid")
    types = F.broadcast(e.select(F.col("etype").alias("want")).distinct())  # as many as there are types of questions
    rest = best_of(q.join(full, "qid", "left_anti").crossJoin(types).where("want <> qtype"))
    best = same.unionByName(rest).groupBy("qid", "g").agg(F.min("m").alias("m"))
    w = W.partitionBy("qid").orderBy("m.s", "m.eid")
    return best.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= k).select("qid", F.col("m.eid").alias("id"), F.round(-F.col("m.s"), 6).alias("score"), "nth")


def shard(rows: DataFrame, n: int, key: str = "row_no") -> DataFrame:
    """rows with shard and seed from a row number: interleaved, so that shards together are the whole in order."""
    return rows.withColumn("shard", (F.col(key) % n).cast("int")).withColumn("seed", F.col(key))
