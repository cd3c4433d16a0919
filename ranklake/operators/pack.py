"""Selection, expansion, formatting and budgeted packing of context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ranklake.functions import text as X
from ranklake.operators.parse import usable_title


def select_span(question: Column, text: Column) -> Column:
    """The part of a text that shares most tokens with the question, the first of equals; the text where none does."""
    def best(x: Column) -> Column:
        scored = F.transform(x["parts"], lambda p, i: F.struct(X.overlap(x["q"], X.token_set(p)).alias("n"), (-i).alias("place"), p.alias("part")))
        return X.let(F.array_max(scored), lambda b: F.when((F.size(x["parts"]) > 1) & (b["n"] > 0), b["part"]).otherwise(text))

    return X.let(F.struct(X.split_units(text).alias("parts"), X.token_set(question).alias("q")), best)


def best_unit(candidates: DataFrame, question: str = "question", text: str = "text") -> DataFrame:
    """Of each query's candidates the one that shares most tokens with the question, the first by rank of equals."""
    return top_units(candidates, 1, question, text)


def top_units(candidates: DataFrame, n: int = 3, question: str = "question", text: str = "text", already_ranked: bool = False) -> DataFrame:
    """The first n by rank, or by shared tokens and then rank."""
    shared = X.overlap(X.token_set(F.col(question)), X.token_set(F.col(text)))
    order = [F.col("rank")] if already_ranked else [F.col("shared").desc(), F.col("rank")]
    rows = candidates if already_ranked else candidates.withColumn("shared", shared)
    return rows.withColumn("place", F.row_number().over(W.partitionBy("qid").orderBy(*order))).where(F.col("place") <= n)


def prefilter(candidates: DataFrame, n: int, question: str = "question", text: str = "text", already_ranked: bool = False) -> DataFrame:
    """As ``top_units``, but a list of n or fewer keeps its order."""
    rows = candidates.withColumn("__size", F.count(F.lit(1)).over(W.partitionBy("qid")))
    shared = F.when(F.col("__size") <= n, 0).otherwise(F.lit(0) if already_ranked else X.overlap(X.token_set(F.col(question)), X.token_set(F.col(text))))
    place = F.row_number().over(W.partitionBy("qid").orderBy(F.col("__shared").desc(), "rank"))
    return rows.withColumn("__shared", shared).withColumn("place", place).where(F.col("place") <= n).drop("__size", "__shared")


def adjacent_range(sizes: Column, at: Column, budget: Column) -> Column:
    """struct<lo, hi>, inclusive: from ``at`` on to where the tokens reach the budget; if the rest doesn't, from ``at`` back.

    Either way is one running sum.
    """
    return X.let(sizes, lambda s: _range(s, at, budget))


def _range(sizes: Column, at: Column, budget: Column) -> Column:
    n = F.size(sizes)

    def reach(some: Column, start: Column) -> Column:
        """How many of ``some`` it takes to reach the budget, and the sum."""
        none = F.struct(start.cast("long").alias("sum"), F.lit(0).alias("k"))
        step = lambda acc, x: F.when(acc["sum"] >= budget, acc).otherwise(F.struct((acc["sum"] + x).alias("sum"), (acc["k"] + 1).alias("k")))
        return F.aggregate(some, none, step)

    def ahead(f: Column) -> Column:
        back = reach(F.reverse(F.slice(sizes, F.lit(1), at)), f["sum"])
        lo = F.when(back["sum"] >= budget, at - back["k"]).otherwise(0)
        found = (f["sum"] >= budget) & (f["k"] > 0)
        return F.struct(F.when(found, at).otherwise(lo).cast("int").alias("lo"), F.when(found, at + f["k"] - 1).otherwise(n - 1).cast("int").alias("hi"))

    return X.let(reach(F.slice(sizes, at + 1, n), F.lit(0)), ahead)


def expand_adjacent(chosen: DataFrame, units: DataFrame, budget: int | Column, place: str = "clause_pos") -> DataFrame:
    """chosen (qid, row_id, ...) with items (array of struct<row_id, clause_no, text, n_tok>), whole and expanded.

    items are the neighbours of the unit in its article up to the budget of tokens. Where chosen has doc_id and article_pos, these
    say where a unit stands.
    """
    item = F.struct(F.col(place).alias("place"), "row_id", "clause_no", "text", X.token_count(F.col("text")).alias("n_tok"))
    articles = units.groupBy("doc_id", "article_pos").agg(F.array_sort(F.collect_list(item)).alias("all"))
    rows = chosen.withColumn("__d", F.col("doc_id")).withColumn("__a", F.col("article_pos")) if {"doc_id", "article_pos"} <= set(chosen.columns) else chosen.join(
        units.select("row_id", F.col("doc_id").alias("__d"), F.col("article_pos").alias("__a")), "row_id"
    )
    rows = rows.join(articles.select(F.col("doc_id").alias("__d"), F.col("article_pos").alias("__a"), "all"), ["__d", "__a"])
    limit = F.lit(budget) if isinstance(budget, int) else budget
    index = (F.array_position(F.transform("all", lambda x: x["row_id"]), F.col("row_id")) - 1).cast("int")
    rows = rows.withColumn("__r", adjacent_range(F.transform("all", lambda x: x["n_tok"]), index, limit))
    items = F.slice("all", F.col("__r.lo") + 1, F.col("__r.hi") - F.col("__r.lo") + 1)
    rows = rows.withColumn("items", F.transform(items, lambda x: F.struct(x["row_id"].alias("row_id"), x["clause_no"].alias("clause_no"), x["text"].alias("text"), x["n_tok"].alias("n_tok"))))
    return rows.withColumn("whole", F.size("items") == F.size("all")).withColumn("expanded", F.size("items") > 1).drop("__d", "__a", "__r", "all")


def article_if_short(unit_text: Column, article_text: Column, budget: int | None) -> Column:
    """The article where it has at most ``budget`` tokens (always, without one), else the unit."""
    if budget is None:
        return F.coalesce(article_text, unit_text)
    return F.when(X.token_count(article_text) <= budget, article_text).otherwise(unit_text)


def body_budget(budget: int, title: Column) -> Column:
    """What a title leaves of the budget, 1 at least."""
    return F.greatest(F.lit(budget) - X.token_count(title), F.lit(1))


ELLIPSIS = "…"


def numbered(no: Column, text: Column) -> Column:
    n = F.coalesce(X.strip(no), F.lit(""))
    return F.when(n != "", F.concat(n, F.lit(". "), X.strip(text))).otherwise(X.strip(text))


def format_clause(variant: str, article_no: Column, title: Column, article_text: Column, clause_no: Column, text: Column, most: int | None = None) -> Column:
    """One clause. F0: text; F1: title, text; F2: title, number and text; F3: as F2 with the article's number before the title;
    F4 and F5: as F2 with an ellipsis after the title. Without a usable title F0 and F1 are the text, others keep the number."""
    body = X.strip(text)
    if variant == "F0":
        return body
    heading = usable_title(title, article_text, most)
    if variant not in ("F1", "F2", "F3", "F4", "F5"):
        raise ValueError(f"no such variant: {variant}")
    head = F.concat(F.lit("Điều "), article_no, F.lit(". "), heading) if variant == "F3" else heading
    lines = {"F1": [head, body], "F4": [head, F.lit(ELLIPSIS), numbered(clause_no, text)], "F5": [head, F.lit(ELLIPSIS), numbered(clause_no, text)]}
    full = F.concat_ws("\n", *lines.get(variant, [head, numbered(clause_no, text)]))
    return F.when(heading != "", full).otherwise(body if variant == "F1" else numbered(clause_no, text))


def format_range(variant: str, article_no: Column, title: Column, article_text: Column, items: Column, whole: Column, most: int | None = None) -> Column:
    """Adjacent clauses. G0: texts with blank lines between; G1: title and numbered texts; G2: an ellipsis after the title where
    the range isn't the whole article. The title of a whole article has its number before it."""
    live = F.filter(items, lambda k: X.strip(k["text"]) != "")
    if variant == "G0":
        return F.array_join(F.transform(live, lambda k: X.strip(k["text"])), "\n\n")
    if variant not in ("G1", "G2"):
        raise ValueError(f"no such variant: {variant}")
    body = F.array_join(F.transform(live, lambda k: numbered(k["clause_no"], k["text"])), "\n")
    heading = usable_title(title, article_text, most)
    head = F.when(whole, F.concat(F.lit("Điều "), article_no, F.lit(". "), heading)).otherwise(heading)
    mark = F.when(~whole, F.lit(ELLIPSIS)) if variant == "G2" else F.lit(None).cast("string")
    return F.when(F.size(live) == 0, "").when(heading != "", F.concat_ws("\n", head, mark, body)).otherwise(body)


def decide_text(expanded: DataFrame, single: str = "F2", many: str = "G1", most: int | None = None) -> DataFrame:
    """expanded (items, whole, article_no, title, article_text) with formatted, body and context_title."""
    one = F.get("items", F.lit(0))
    a = [F.col("article_no"), F.col("title"), F.col("article_text")]
    formatted = F.when(F.size("items") == 1, format_clause(single, *a, one["clause_no"], one["text"], most)).otherwise(format_range(many, *a, F.col("items"), F.col("whole"), most))
    body = F.array_join(F.filter(F.transform("items", lambda k: k["text"]), lambda t: X.strip(t) != ""), "\n\n")
    return expanded.withColumn("formatted", formatted).withColumn("body", body).withColumn("context_title", usable_title(F.col("title"), F.col("article_text"), most))


def greedy(candidates: DataFrame, most: int = 3, target: int | None = 535, cap: int | None = 1200, similar: float | None = 0.7, text: str = "text", body: str | None = None) -> DataFrame:
    """(qid, picked, total): contexts packed in the order of rank under budgets of tokens.

    In this order: stop at ``most`` contexts; stop when something is kept and the total reached ``target``; skip blank ones; skip
    one that is like a kept one (Jaccard of token sets over ``similar``, or with None the same text but for case and space);
    stop when something is kept and this one would pass ``cap``. picked is an array of struct<rank, unit_id, text, n_tok>.

    The fold runs over one query's candidates, a list of bounded length; queries are spread over tasks.
    """
    key = F.col(body or text)
    marks = X.token_set(key) if similar is not None else F.array(X.dedup_key(key))
    entry = F.struct("rank", "unit_id", F.col(text).alias("text"), X.token_count(F.col(text)).cast("int").alias("n_tok"), marks.alias("marks"))
    lists = candidates.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct(F.col("rank").alias("r"), entry.alias("e")))).alias("c"))
    kept_type = "array<struct<rank:int,unit_id:string,text:string,n_tok:int,marks:array<string>>>"
    start = F.struct(F.array().cast(kept_type).alias("kept"), F.lit(0).alias("total"), F.lit(False).alias("done"))

    def step(s: Column, x: Column) -> Column:
        e = x["e"]
        n, some = F.size(s["kept"]), F.size(s["kept"]) > 0
        stop = s["done"] | (n >= most)
        if target is not None:
            stop |= some & (s["total"] >= target)
        blank = X.strip(e["text"]) == ""
        if similar is not None:
            like = F.exists(s["kept"], lambda k: (F.size(k["marks"]) > 0) & (X.jaccard(k["marks"], e["marks"]) > similar))
        else:
            like = F.exists(s["kept"], lambda k: k["marks"] == e["marks"])
        over = some & (s["total"] + e["n_tok"] > cap) if cap is not None else F.lit(False)
        skip = blank | like
        take = ~stop & ~skip & ~over
        item = F.struct(e["rank"].cast("int").alias("rank"), e["unit_id"].cast("string").alias("unit_id"), e["text"].alias("text"), e["n_tok"].alias("n_tok"), e["marks"].alias("marks"))
        return F.struct(
            F.when(take, F.array_append(s["kept"], item)).otherwise(s["kept"]).alias("kept"), F.when(take, s["total"] + e["n_tok"]).otherwise(s["total"]).alias("total"),
            (stop | (~skip & over)).alias("done"),
        )

    folded = lists.select("qid", F.aggregate("c", start, step).alias("s"))
    picked = F.transform("s.kept", lambda k: F.struct(k["rank"].alias("rank"), k["unit_id"].alias("unit_id"), k["text"].alias("text"), k["n_tok"].alias("n_tok")))
    return folded.select("qid", picked.alias("picked"), F.col("s.total").alias("total"))


def exact_top(candidates: DataFrame, k: int = 3, text: str = "text") -> DataFrame:
    """The first k whose texts differ but for case and space."""
    rows = candidates.where(X.strip(F.col(text)) != "").withColumn("__k", X.dedup_key(F.col(text)))
    once = rows.withColumn("__n", F.row_number().over(W.partitionBy("qid", "__k").orderBy("rank"))).where("__n = 1").drop("__n", "__k")
    return once.withColumn("place", F.row_number().over(W.partitionBy("qid").orderBy("rank"))).where(F.col("place") <= k)


def first_k(candidates: DataFrame, k: int) -> DataFrame:
    return candidates.withColumn("place", F.row_number().over(W.partitionBy("qid").orderBy("rank"))).where(F.col("place") <= k)


def article_label(article_no: Column) -> Column:
    return F.when(F.coalesce(article_no, F.lit("")) != "", F.concat(F.lit("Điều "), article_no)).otherwise("")


def clause_label(clause_no: Column) -> Column:
    return F.when(F.coalesce(clause_no, F.lit("")) != "", F.concat(F.lit("Khoản "), clause_no)).otherwise("")


def context_item(name: str = "name", link: str = "link", number: str = "document_number") -> Column:
    """struct<document, document_number, article, clause, article_title, text, retrieval_score> of a row."""
    c = F.col
    return F.struct(
        F.struct(c(name).alias("name"), c(link).alias("link")).alias("document"), F.coalesce(c(number), F.lit("")).alias("document_number"), article_label(c("article_no")).alias("article"),
        clause_label(c("clause_no")).alias("clause"), F.coalesce(c("title"), F.lit("")).alias("article_title"), c("text"), c("score").alias("retrieval_score"),
    )


def packages(contexts: DataFrame, questions: DataFrame) -> DataFrame:
    """(id, question, contexts, reference_answer): questions with their ordered context items (qid, place, item)."""
    lists = contexts.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "item"))), lambda x: x["item"]).alias("contexts"))
    none = F.array().cast(lists.schema["contexts"].dataType)
    return questions.join(lists, "qid", "left").select(F.col("qid").alias("id"), "question", F.coalesce("contexts", none).alias("contexts"), F.col("answer").alias("reference_answer"))
