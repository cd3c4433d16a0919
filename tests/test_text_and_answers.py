"""Text functions and answer operators on literals."""

import pytest
from pyspark.sql import functions as F

from ranklake.functions import text as X
from ranklake.operators import answers as A
from ranklake.operators import align, pack, parse, scoring


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


def test_tokens_split_at_unicode_space(spark):
    assert one(spark, X.tokens(F.col("t")), t=" a b \n c ") == ["a", "b", "c"]
    assert one(spark, X.tokens(F.col("t")), t=None) == []


@pytest.mark.parametrize(("link", "name"), [("https://x.vn/a/Luat-9.aspx", "Luat-9"), ("https://x.vn/a/", "a"), ("", "unknown"), (None, "unknown")])
def test_name_from_link(spark, link, name):
    assert one(spark, X.name_from_link(F.col("t")), t=link) == name


@pytest.mark.parametrize(
    ("question", "kind"),
    [("Ai được hưởng?", "subject"), ("Quyền lợi của người lao động?", "rights_and_duties"), ("Thẩm quyền thuộc về đâu", "other"), ("Mức phạt là bao nhiêu?", "number_or_time"), ("Khi nào phải nộp?", "condition"),
     ("Thủ tục như thế nào?", "procedure_or_list"), ("Có được nghỉ hay không?", "yes_no"), ("Xin chào", "other")],
)
def test_question_type(spark, question, kind):
    assert one(spark, X.question_type(F.col("t")), t=question) == kind


def test_variants(spark):
    assert one(spark, X.query_variants(F.col("t")), t="One only") == ["One only"]
    assert len(one(spark, X.query_variants(F.col("t")), t="A b. C d e f. G h?")) == 4


def test_citations(spark):
    c = one(spark, X.citations(F.col("t")), t="Căn cứ điểm a khoản 2 Điều 5 Nghị định 90/2017/NĐ-CP và Điều 5, điều 5 Luật Đất đai 2013")
    assert c["document_numbers"] == ["90/2017/NĐ-CP"] and c["articles"] == ["Điều 5"] and c["clauses"] == ["khoản 2"] and c["points"] == ["điểm a"] and c["named_documents"] == ["Luật Đất đai 2013"]


def test_overlaps(spark):
    g, c = F.array(*map(F.lit, "aab")), F.array(*map(F.lit, "abb"))
    assert one(spark, X.coverage(g, c)) == 1.0 and one(spark, X.multiset_overlap(g, c)) == 2
    assert one(spark, X.jaccard(F.array(F.lit("a")), F.array(F.lit("a"), F.lit("b")))) == 0.5


def test_split_first(spark):
    b = one(spark, A.split_first(F.col("t")), t="Căn cứ Điều 1:\nNội dung luật.\nTheo đó, đây là kết luận.\nDòng sau")
    assert (b["lead"], b["quotation"], b["conclusion"], b["confidence"]) == ("Căn cứ Điều 1:", "Nội dung luật.", "Theo đó, đây là kết luận.\nDòng sau", "high")
    b = one(spark, A.split_first(F.col("t")), t="Dòng một\nDòng hai")
    assert (b["confidence"], b["conclusion"], b["method"]) == ("low", "", "first_line+no_marker")
    assert one(spark, A.split_first(F.col("t")), t="")["method"] == "empty"
    # A marker that opens the quotation isn't its end.
    b = one(spark, A.split_first(F.col("t")), t="Mở\nTheo đó một\nNhư vậy hai")
    assert (b["quotation"], b["conclusion"]) == ("Theo đó một", "Như vậy hai")


def test_split_last_takes_the_last_marker(spark):
    b = one(spark, A.split_last(F.col("t")), t="Mở\nTheo đó một\nTóm lại hai")
    assert (b["quotation"], b["conclusion"]) == ("Theo đó một", "Tóm lại hai")
    assert one(spark, A.split_last(F.col("t")), t="Mở\nkhông có gì")["lead"] == ""


@pytest.mark.parametrize(
    ("raw", "method"),
    [("<LEAD>a</LEAD><CONCLUSION>b</CONCLUSION>", "xml_tags"), ("<conclusion>b</conclusion>", "partial_xml_tags"), ('{"lead": "a", "conclusion": "b"}', "json"), ('{"lead": "a"}', "partial_json"), ("plain", "unparsed")],
)
def test_parse_output(spark, raw, method):
    assert one(spark, A.parse_output(F.col("t")), t=raw)["method"] == method


@pytest.mark.parametrize(
    ("raw", "method"),
    [("```xml\n<CONCLUSION> b </CONCLUSION>\n```", "targeted_xml_tags"), ("<LEAD>a</LEAD>", "targeted_wrong_tag"), ("b", "targeted_missing_wrapper"), ("<CONCLUSION>b", "targeted_malformed_tags"), ("<CONCLUSION> </CONCLUSION>", "targeted_empty")],
)
def test_parse_targeted(spark, raw, method):
    p = one(spark, A.parse_targeted(F.col("t"), "conclusion"), t=raw)
    assert p["method"] == method and (p["conclusion"] == "b") == p["valid"]


def test_gates(spark):
    q, c, a, b = F.col("q"), F.col("c"), F.col("a"), F.col("b")
    issues = one(spark, A.conclusion_issues(q, c, a), q="Thủ tục như thế nào?", c="- một\n- hai\n", a="Theo quy định nêu trên.")
    assert issues == ["vague_reference", "short_list_answer"]
    assert one(spark, A.conclusion_issues(q, c, a), q="x", c="", a="  ") == ["missing_conclusion"]
    assert one(spark, A.conclusion_issues(q, c, a), q="Thời hạn bao nhiêu?", c="trong 30 ngày hoặc 2 tháng", a="Không rõ") == ["missing_numeric_facts"]
    vetoes = one(spark, A.retry_vetoes(q, c, a, b), q="Thời hạn bao nhiêu?", c="trong 30 ngày", a="Không rõ ràng", b="Trong 30 ngày")
    assert vetoes == []
    vetoes = one(spark, A.retry_vetoes(q, c, a, b), q="x", c="", a="Ông được nghỉ 5 ngày", b="Ông không được nghỉ")
    assert vetoes == ["initial_not_flagged", "polarity_changed", "lost_numeric_fact"]


def test_soft_decision(spark):
    rows = spark.createDataFrame([("Thời hạn bao nhiêu?", "trong 30 ngày", "Không rõ", "Thời hạn là 30 ngày"), ("a", "b", "c", " ")], "question string, context string, initial string, retry string")
    got = A.soft_decision(rows).orderBy(F.length("question").desc()).collect()
    assert got[0]["accepted"] and got[0]["retry_score"] > got[0]["initial_score"] + 0.75
    assert got[1]["reasons"] == ["retry_empty"]


def test_lead_and_blocks(spark):
    meta = X.citations(F.lit("khoản 1 Điều 2 Luật Mẫu 2020"))
    assert one(spark, A.fallback_lead(meta)) == "Căn cứ theo khoản 1 Điều 2 Luật Mẫu 2020, quy định liên quan như sau:"
    none = F.struct(F.lit("").alias("lead"), F.lit("").alias("conclusion"))
    retry = F.struct(F.lit("").alias("lead"), F.lit("k").alias("conclusion"))
    b = one(spark, A.resolve_blocks(none, none, retry, meta))
    assert (b["lead_source"], b["conclusion_source"], b["model_blocks_complete"], b["answer_complete"]) == ("template_fallback", "model_targeted_retry", False, True)


def test_bundle_drops_equal_texts(spark):
    row = "id string, question string, contexts array<struct<document: struct<name: string, link: string>, document_number: string, article: string, clause: string, text: string>>, reference_answer string"
    ctx = [(("L1", ""), "1/2020/QH1", "Điều 1", "", "A  b"), (("L1", ""), "1/2020/QH1", "Điều 2", "", "a b"), (("L2", ""), "", "Điều 3", "", "c")]
    df = spark.createDataFrame([("1", "q", ctx, None)], row)
    b = A.bundle(df, 3).first()["bundle"]
    assert b["text"] == "A  b\n\nc" and b["selected_context_count"] == 2 and b["citation_metadata"]["articles"] == ["Điều 1", "Điều 3"]
    assert A.bundle(df, 1).first()["bundle"]["citation_metadata"]["named_documents"] == ["L1"]
    assert A.violations(df.union(df)).collect()[0]["problem"] == "repeated_id"
    with pytest.raises(Exception, match="repeated id"):
        A.submission(spark.createDataFrame([("1", "a"), ("1", "b")], "id string, answer string")).collect()


def test_few_shot_leaves_out_own_group(spark):
    q = spark.createDataFrame([("q", "q", "Mức phạt bao nhiêu?", 10, "g1")], "qid string, id string, question string, context_length int, citation_group string")
    e = spark.createDataFrame([("a", "Mức phạt bao nhiêu?", 10, "g1"), ("b", "Mức lương bao nhiêu?", 10, "g2"), ("c", "Mức lương là bao nhiêu?", 99, "g2"), ("d", "Ai chịu?", 10, "")], "id string, question string, context_length int, citation_group string")
    assert [r["id"] for r in A.few_shot(q, e).orderBy("nth").collect()] == ["b", "d"]


LEGAL = "Mở đầu\nĐiều 1. Phạm vi\n1. Một\n2) Hai\n1. Lặp\nĐiều 2. Hiệu lực từ ngày ký.\nĐiều 3a: Tổ chức và hoạt\r\n\nđộng\nThân bài\nPHỤ LỤC I\n1. bảng"


def test_parser(spark):
    df = spark.createDataFrame([("7", LEGAL), ("8", "văn bản thường"), ("9", "  \n "), ("10", None)], "doc_id string, passage string")
    rows = {r["doc_id"]: r for r in parse.parse(df).collect()}
    a = rows["7"]["articles"]
    assert [x["article_no"] for x in a] == ["1", "2", "3a"] and rows["7"]["appendix"] == "PHỤ LỤC I\n1. bảng"
    assert [(k["clause_id"], k["text"]) for k in a[0]["clauses"]] == [("7_1_1", "Một"), ("7_1_2", "Hai"), ("7_1_1", "Lặp")]
    assert a[1]["text"] == "Hiệu lực từ ngày ký." and a[2]["title"] == "Tổ chức và hoạt động" and a[2]["text"] == "Thân bài"
    main = rows["7"]["main_text"]
    for x in a:
        assert main[x["char_start"] : x["char_end"]] == x["text"]
        for k in x["clauses"]:
            assert main[k["char_start"] : k["char_end"]] == k["text"]
    assert rows["8"]["parse_status"] == "fallback" and rows["8"]["articles"][0]["article_id"] == "8_" and rows["9"]["articles"] == [] and rows["10"]["articles"] == []
    u = parse.units(parse.parse(df)).where("doc_id = '7'").orderBy("row_id").collect()
    assert [r["unit_id"] for r in u] == ["7_1_1", "7_1_2", "7_1_1", "7_2", "7_3a"] and len({r["row_id"] for r in u}) == 5
    # A bare header takes the next line as its title.
    bare = parse.parse(spark.createDataFrame([("1", "Điều 5.\n1. Một")], "doc_id string, passage string")).first()["articles"]
    assert bare[0]["title"] == "1. Một" and bare[0]["clauses"][0]["text"] == "Một"


def test_adjacent_range_is_the_loop(spark):
    import random

    rng, cases = random.Random(3), []
    for _ in range(300):
        sizes = [rng.randint(0, 9) for _ in range(rng.randint(1, 7))]
        cases.append((sizes, rng.randrange(len(sizes)), rng.randint(1, 25)))
    rows = spark.createDataFrame(cases, "s array<int>, i int, b int").select("s", "i", "b", pack.adjacent_range(F.col("s"), F.col("i"), F.col("b")).alias("r")).collect()
    for r in rows:
        lo = hi = r["i"]
        total = r["s"][lo]
        while total < r["b"] and (hi + 1 < len(r["s"]) or lo):
            if hi + 1 < len(r["s"]):
                hi += 1
                total += r["s"][hi]
            else:
                lo -= 1
                total += r["s"][lo]
        assert (r["r"]["lo"], r["r"]["hi"]) == (lo, hi), r


def greedy_loop(texts, most=3, target=535, cap=1200, similar=0.7):
    kept, total = [], 0
    for k, t in enumerate(texts):
        words = set(t.lower().split())
        if len(kept) >= most or (target is not None and kept and total >= target):
            break
        if not t.strip() or any(words and w and len(words & w) / len(words | w) > similar for _, w in kept):
            continue
        if kept and total + len(t.split()) > cap:
            break
        kept.append((k, words))
        total += len(t.split())
    return ",".join(str(k) for k, _ in kept), total


def test_greedy_packing_is_the_loop(spark):
    import random

    rng, lists = random.Random(5), []
    for q in range(60):
        lists.append([" ".join(rng.choice("abcdefghij") for _ in range(rng.choice([0, 3, 5, 8]))) for _ in range(rng.randint(1, 8))])
    df = spark.createDataFrame([(q, k, str(k), t) for q, ts in enumerate(lists) for k, t in enumerate(ts)], "qid int, rank int, unit_id string, text string")
    got = {r["qid"]: (",".join(x["unit_id"] for x in r["picked"]), r["total"]) for r in pack.greedy(df, most=4, target=10, cap=16).collect()}
    assert got == {q: greedy_loop(ts, 4, 10, 16) for q, ts in enumerate(lists)}


def test_alignment(spark):
    assert align.align("b c d", "a b c d e") == ("b c d", 1.0)
    assert align.align("x", "a b") == ("", 0.0) and align.align("", "a") == ("", 0.0)
    span, score = align.align("b x d", "a b c d")
    assert span == "b c d" and abs(score - 3 / 6) < 1e-9
    h = align.matrix(list("abcab"), list("cabca"))
    import itertools

    ref = [[0] * 6 for _ in range(6)]
    for i, j in itertools.product(range(1, 6), range(1, 6)):
        ref[i][j] = max(0, ref[i - 1][j - 1] + (2 if "abcab"[i - 1] == "cabca"[j - 1] else -1), ref[i - 1][j] - 1, ref[i][j - 1] - 1)
    assert h.tolist() == ref
    p = align.parts(spark.createDataFrame([("1", "Hiện nay A. Trước đây, theo B quy định như sau: C")], "qid string, answer string")).orderBy("part_no").collect()
    assert [r["role"] for r in p] == ["current", "previous"]
    assert one(spark, align.quote_core(F.col("t")), t="Điều 1 như sau: abc def. Theo đó, x") == "abc def."


def test_alignment_reaches_the_end_of_a_long_text():
    text = "filler " * 20_000 + "alpha beta x gamma delta " + "filler " * 100
    assert align.align("alpha beta gamma delta", text) == ("alpha beta x gamma delta", 7 / 8)


def test_windowed_alignment_is_the_full_one():
    import random

    rng = random.Random(3)
    for _ in range(300):
        a, b = (rng.choices("abcd", k=rng.randint(1, n)) for n in (12, 60))
        h = align.matrix(a, b)
        i, j = divmod(int(h.argmax()), h.shape[1])
        assert align.best_cell(a, b) == ((int(h.max()), i, j) if h.max() else (0, 0, 0))
        best, end = int(h.max()), j
        while i and j and h[i, j]:
            if h[i, j] == h[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1):
                i, j = i - 1, j - 1
            elif h[i, j] == h[i - 1, j] - 1:
                i -= 1
            else:
                j -= 1
        assert align.align(" ".join(a), " ".join(b)) == ((" ".join(b[j:end]), min(1.0, best / (2 * len(a)))) if best else ("", 0.0))


def test_scores():
    assert scoring.meteor("a b c".split(), "a b c".split()) == pytest.approx(1 - 0.5 / 27)
    assert scoring.meteor(["a"], ["b"]) == 0.0
    assert scoring.rouge_l("the cat sat", "the cat") == pytest.approx(0.8) and scoring.lcs(list("abcbdab"), list("bdcaba")) == 4


def test_formats(spark):
    c = [F.lit(x) for x in ("5", "Tiêu đề", "Toàn văn", "2", " nội dung ")]
    want = {"F0": "nội dung", "F1": "Tiêu đề\nnội dung", "F2": "Tiêu đề\n2. nội dung", "F3": "Điều 5. Tiêu đề\n2. nội dung", "F4": "Tiêu đề\n…\n2. nội dung"}
    for v, text in want.items():
        assert one(spark, pack.format_clause(v, *c)) == text
    c[1] = F.lit("Toàn văn")
    assert one(spark, pack.format_clause("F1", *c)) == "nội dung" and one(spark, pack.format_clause("F3", *c)) == "2. nội dung"


def test_white_space_is_that_of_unicode(spark):
    every = [chr(k) for k in range(1, 0x3100) if not 0xD800 <= k < 0xE000]
    rows = spark.createDataFrame([(c, f"{c}{c}x{c}y{c}") for c in every], "c string, t string")
    old_tokens = F.filter(F.split("t", r"(?U)\s+"), lambda x: x != "")
    got = rows.select("c", "t", X.strip(F.col("t")).alias("s"), X.rstrip_at(F.col("t")).alias("r"), F.regexp_replace("t", r"(?U)^\s+|\s+\z", "").alias("s0"), F.regexp_replace("t", r"(?U)\s+\z", "").alias("r0"), old_tokens.alias("k")).collect()
    for g in got:
        assert (g["s"], g["r"], X.split_space(g["t"])) == (g["s0"], g["r0"], g["k"]), hex(ord(g["c"]))
    assert sum(g["s"] == f"x{g['c']}y" for g in got) == len(X.SPACES)
