"""Audits, weak labels, settings, readers and checks on literals and against loops."""

import json
import random
import re
import statistics
import unicodedata

import pytest
from pyspark.sql import functions as F

from ranklake.functions import text as X
from ranklake.operators import answers, audit, bm25, labelling, metrics, parse, scoring
from ranklake.plans import settings, tables
from ranklake.sources import readers, sinks


@pytest.mark.parametrize("values", [[3], [5, 5, 5], [1, 2, 10**9, 2, 7], None])
def test_values_at_are_those_of_a_sort(spark, values):
    values = values or [random.Random(4).randrange(10**6) for _ in range(500)]
    n = len(values)
    row = metrics.values_at(spark.createDataFrame([(v,) for v in values] + [(None,)], "x long"), "x", {"a": F.floor(F.col("n") / 10), "b": F.floor(F.col("n") / 2), "c": F.col("n") - 1}, bins=16).first()
    s = sorted(values)
    assert (row["n"], row["a"], row["b"], row["c"]) == (n, s[n // 10], s[n // 2], s[-1])


def test_values_at_of_nothing(spark):
    assert metrics.floor_percentiles(spark.createDataFrame([], "value long")).first().asDict() == {"n": None, "p50": None, "p90": None, "p95": None, "p99": None}


UNITS = [("d1", "d1_1", "u", "a b c", "1"), ("d1", "d1_1", "u", "a b d", "2"), ("d1", "d1_2", "v", "x", "3"), ("d1", "d1_3", "v", " x ", "4"), ("d1", "d1_3", "w", "p q", "5"), ("d2", "d2_1", "w", "r", "6"), ("d2", "d2_1", "single", "s", "7")]


def units(spark):
    return spark.createDataFrame(UNITS, "doc_id string, article_id string, unit_id string, text string, row_id string")


def test_repeated_ids(spark):
    r = {x["unit_id"]: x for x in audit.repeated_ids(units(spark)).collect()}
    assert {k: (v["n"], v["n_docs"], v["place"], v["identical"], v["jaccard"]) for k, v in r.items()} == {
        "u": (2, 1, "same_article", False, 0.5), "v": (2, 1, "other_article", True, 1.0), "w": (2, 2, "other_document", False, 0.0)
    }
    d = audit.repeated_id_damage(audit.repeated_ids(units(spark))).first()
    assert (d["ids"], d["same_article"], d["other_article"], d["other_document"], d["identical"], d["differ"], d["disjoint"], d["mean"], d["median"]) == (3, 1, 1, 1, 1, 2, 1, 0.25, statistics.median([0.5, 0.0]))
    assert [x["unit_id"] for x in audit.most_repeated(audit.repeated_ids(units(spark)), 2).collect()] == ["w", "v"]
    none = audit.repeated_id_damage(audit.repeated_ids(units(spark).limit(0))).first()
    assert (none["ids"], none["differ"], none["median"]) == (0, 0, None)


def test_basket_impact(spark):
    run = spark.createDataFrame([(1, "u"), (1, "u"), (1, "v"), (2, "w"), (2, "z")], "qid int, unit_id string")
    b = audit.basket_impact(run, audit.repeated_ids(units(spark))).first()
    assert (b["n"], b["mean"], b["most"], b["lost_one"], b["lost_five"], b["mean_dup_rows"], b["worst"], b["median"], b["p90"]) == (2, 0.5, 1, 1, 0, 2.0, 1, 1, 1)


def test_build_report(spark):
    q = spark.createDataFrame([(1, "x"), (2, None), (3, "y")], "qid int, answer string")
    c = spark.createDataFrame([(1, "a b", "", "u"), (1, "c", "t", "o"), (2, "d e f g", None, "o")], "qid int, text string, title string, unit_id string")
    r = audit.build_report(q, c, spark.createDataFrame([("u",)], "unit_id string"), expected_median=3, most_shift=0, floor=1, ceiling=3).first()
    assert (r["n"], r["without_context"], r["answered"], r["contexts"], r["untitled"], r["repeated_ids"]) == (3, 1, 2, 3, pytest.approx(2 / 3, abs=1e-6), pytest.approx(1 / 3, abs=1e-6))
    assert (r["p10"], r["median"], r["p90"], r["shift"], r["titles_ok"], r["answers_ok"], r["median_ok"]) == (0, 3, 4, 0, False, False, True)
    empty = audit.build_report(q, c.limit(0), c.select("unit_id").limit(0), 3).first()
    assert (empty["contexts"], empty["untitled"], empty["titles_ok"], empty["without_context"]) == (0, 0.0, False, 3)


LAW = "Điều 1. Phạm vi\n1. một hai ba bốn năm sáu bảy tám\n2. chín mười\nĐiều 2. Chung\nkhông có khoản nào"


def parsed(spark):
    return parse.parse(spark.createDataFrame([(7, LAW), (8, "chỉ có chữ"), (9, None)], "doc_id int, passage string"))


def test_best_coverages_and_ceiling(spark):
    a = spark.createDataFrame([(1, "một hai chín mười khác"), (2, "ngắn"), (3, "a b c d e")], "qid int, answer string")
    hits = spark.createDataFrame([(1, 7), (1, 8)], "qid int, doc_id int")
    best = {r["qid"]: (r["clause"], r["article"]) for r in audit.best_coverages(a, hits, parsed(spark), least_tokens=5).collect()}
    assert best == {1: (0.4, 0.8), 3: (0.0, 0.0)}
    c = audit.chunking_ceiling(audit.best_coverages(a, hits, parsed(spark), least_tokens=5)).first()
    assert (c["n"], c["mean_gain"], c["needs_article"], c["clause_enough"], c["article_80"], c["clause_80"]) == (2, 0.2, 1, 1, 1, 0)


def test_rescored_ceiling_is_the_loop(spark):
    rng = random.Random(5)
    rows = [(q, r, "a b c d e f", " ".join(rng.choices("abcdefxyz ", k=6)).strip()) for q in range(12) for r in range(1, 1 + (q % 4 or 4))]
    df = spark.createDataFrame(rows, "qid int, rank int, question string, text string")
    got = {r["qid"]: (r["first_value"], r["best_value"], r["best_ranks"]) for r in audit.rescored_ceiling(df, lambda g, t: X.set_f1(X.token_set(g), X.token_set(t)), pool=3).collect()}
    for q in range(12):
        mine = [(r, g, t) for k, r, g, t in rows if k == q and r <= 3]

        def value(chosen):
            s, g = {w for r, _, t in mine if r in chosen for w in t.split()}, set(mine[0][1].split())  # noqa: B023
            return round(2 * len(s & g) / (len(s) + len(g)), 9)

        one = max((r for r, *_ in mine), key=lambda r: (value([r]), -r))
        rest = [r for r, *_ in mine if r != one]
        pair = [one, max(rest, key=lambda r: (value([one, r]), -r))] if rest else [one]
        assert got[q] == (value([1, 2]), value(pair), ",".join(map(str, sorted(pair))))


def test_extra_text_penalty(spark):
    rows = [(k, f"w{k} x y z", "a" if k % 3 else "b") for k in range(30)]
    r = audit.extra_text_penalty(spark.createDataFrame(rows, "qid int, answer string, group string"), spark.createDataFrame([("one two",), (" ",), (None,)], "text string"), scoring.meteor_column, "a", resamples=50).first()
    want = statistics.fmean(scoring.meteor(t.split(), (t + "\none two").split()) - 1 for _, t, g in rows if g == "a")
    assert r["n"] == 20 and r["mean"] == pytest.approx(want, abs=1e-6) and r["loss"] == pytest.approx(2 / 3 * abs(want), abs=1e-6)


def test_online_items(spark):
    docs = spark.createDataFrame([(7, "Nghị định 90/2017/NĐ-CP về x", "l"), (8, None, None)], "doc_id int, name string, link string")
    want = spark.createDataFrame([(1, 7, "7_1_1", 0.5), (1, 7, "7_1", 0.4), (1, 7, "7_2", 0.3), (2, 8, "8_", 0.2)], "qid int, doc_id int, unit_id string, score double")
    for expand in (False, True):
        got = {r["unit_id"]: (r["kind"], r["covered"], r["document_number"], r["text"]) for r in labelling.online_items(want, parsed(spark), docs, expand).collect()}
        article = "1. một hai ba bốn năm sáu bảy tám\n2. chín mười"
        assert got["7_1_1"] == ("clause", ["7_1", "7_1_1", "7_1_2"] if expand else ["7_1_1"], "90/2017/NĐ-CP", article if expand else "một hai ba bốn năm sáu bảy tám")
        assert got["7_1"] == ("article_fallback", ["7_1", "7_1_1", "7_1_2"], "90/2017/NĐ-CP", article)
        assert got["7_2"][:2] == ("article_fallback", ["7_2"]) and got["8_"] == ("doc_fallback", ["8_"], "", "chỉ có chữ")
    with pytest.raises(Exception, match="no such unit"):
        labelling.online_items(want.withColumn("unit_id", F.lit("7_9")), parsed(spark), docs).collect()


def test_label_answers(spark):
    i = bm25.build_index(spark.createDataFrame([(7, LAW), (8, "chỉ có chữ"), (9, "một hai"), (10, "khác")], "doc_id int, text string"))
    a = spark.createDataFrame([(1, "Nay như sau: một hai ba bốn năm sáu bảy. Theo đó, x. Trước đây, theo luật cũ quy định như sau: không có khoản nào cả"), (2, " "), (3, None), (4, "một hai")], "qid int, answer string")
    got = {r["part_no"]: r for r in labelling.label_answers(a, i, parsed(spark)).collect()}
    assert {(r["qid"], r["part_no"], r["role"], r["doc_id"], r["clause_id"], r["unit_type"]) for r in got.values()} == {(1, 0, "current", "7", "7_1_1", "clause"), (1, 1, "previous", "7", None, "article_fallback")}
    assert got[0]["span"].startswith("một hai ba bốn năm sáu") and got[1]["span"] == "không có khoản nào"
    u = bm25.build_index(parse.units(parsed(spark)), "row_id")
    again = labelling.label_answers(a, i, parsed(spark), unit_index=u).collect()
    assert {(r["part_no"], r["clause_id"]) for r in again} == {(0, "7_1_1"), (1, None)}


def test_settings(spark):
    s = settings.from_arguments(["--alpha", "0.3", "--max-contexts", "2", "--questions", "train", "--run", "/a/top50.jsonl"])
    assert s.output == "packages_train_top50_alpha0.3_contexts2_tokens350" and settings.BuildSettings(out="x").output == "x"
    for wrong in (["--alpha", "1.5"], ["--max-contexts", "0"], ["--per-item", "0"], ["--questions", "other"]):
        with pytest.raises(SystemExit):
            settings.from_arguments(wrong)
    u = parse.units(parsed(spark))
    columns = {"rerank_rank": F.col("clause_pos"), "dense_rank": F.lit(0), "score": F.lit(1.0), "qid": F.lit("q"), "name": F.lit("n"), "link": F.lit(""), "document_number": F.lit("")}
    ranked = u.where("doc_id = '7' and article_no = '1'").withColumns(columns)
    q = spark.createDataFrame([("q", "?", None), ("none", "?", None)], "qid string, question string, answer string")
    got = {r["id"]: [c["text"] for c in r["contexts"]] for r in settings.build(settings.BuildSettings(per_item=2), ranked, u, q).collect()}
    assert got["none"] == [] and got["q"][0] == "Phạm vi\n1. một hai ba bốn năm sáu bảy tám" and len(got["q"]) == 2


def test_composition(spark):
    t = "e\u0301 a\u0302\u0301 a"
    got = spark.createDataFrame([(t,), (None,)], "t string").select(X.nfc(F.col("t")).alias("x")).collect()
    assert [r["x"] for r in got] == [unicodedata.normalize("NFC", t), None]


def test_first_integer_and_sets(spark):
    row = spark.range(1).select(X.first_integer(F.lit("Điều 12a 3")).alias("a"), X.first_integer(F.lit("x")).alias("b"), X.first_integer(F.lit("99999999999")).alias("c"))
    assert tuple(row.first()) == (12, None, None)
    g, c, none = F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"), F.lit("c"), F.lit("d"), F.lit("e")), F.array().cast("array<string>")
    assert tuple(spark.range(1).select(X.set_precision(g, c), X.set_recall(g, c), X.set_precision(g, none), X.set_recall(none, c)).first()) == (0.25, 0.5, 0.0, 0.0)


def test_score_submission(spark):
    a = spark.createDataFrame([(1, "a b"), (2, "c d e")], "id int, answer string")
    b = spark.createDataFrame([(1, "a b"), (2, "c x e")], "id int, answer string")
    s = scoring.score_submission(b, a).first()
    assert (s["n"], s["meteor"]) == (2, pytest.approx(statistics.fmean([scoring.meteor(["a", "b"], ["a", "b"]), scoring.meteor(["c", "d", "e"], ["c", "x", "e"])]), abs=1e-6))
    with pytest.raises(ValueError, match="predictions"):
        scoring.score_submission(b.limit(1), a)
    with pytest.raises(ValueError, match="without a reference"):
        scoring.score_submission(b.withColumn("id", F.col("id") + 5), a)


def test_hold_out_is_stable(spark):
    rows = spark.range(5000).withColumnRenamed("id", "k")
    held = {r["k"] for r in metrics.hold_out(rows, "k", 0.1, 3).where("held_out").collect()}
    assert 400 < len(held) < 600
    assert {r["k"] for r in metrics.hold_out(rows.where("k < 2000"), "k", 0.1, 3).where("held_out").collect()} == {k for k in held if k < 2000}


def test_longer_retry_and_examples(spark):
    def needed(raw, valid=False, n=10):
        return spark.range(1).select(answers.needs_longer_retry(F.lit(raw), F.lit(valid), F.lit(n), F.lit(10)).alias("x")).first()["x"]

    assert needed("<CONCLUSION>a") and not needed("<CONCLUSION>a</CONCLUSION>") and not needed("<CONCLUSION>a", True) and not needed("<CONCLUSION>a", n=9) and not needed("a")
    use = lambda c, a, b, ok=True: spark.range(1).select(answers.usable_example(F.lit(c), F.lit(a), F.lit(b), F.lit(ok)).alias("x")).first()["x"]
    assert use("c", "a", "b") and not use("c" * 1601, "a", "b") and not use("c", "a " * 61, "b") and not use("c", "a", "b " * 121) and not use("c", "a", " ") and not use("c", "a", "b", False)


def test_files(spark, tmp_path):
    (tmp_path / "x.bin").write_bytes(b"abc")
    d = sinks.file_digests(spark, str(tmp_path / "x.bin")).first()
    assert re.fullmatch("[0-9a-f]{32}", d["md5"]) and d["sha256"].startswith("ba7816bf8f01cfea")
    rows = spark.createDataFrame([(2, "b"), (1, "a")], "id int, t string")
    assert json.loads(sinks.json_array(rows, "id").first()["value"]) == [{"id": 1, "t": "a"}, {"id": 2, "t": "b"}]
    v = spark.createDataFrame([(0, "u", [1.0])], "row_id bigint, unit_id string, vec array<float>")
    v.write.parquet(str(tmp_path / "v"))
    assert readers.vectors(spark, str(tmp_path / "v"), v).count() == 1
    with pytest.raises(ValueError, match="vectors for"):
        readers.vectors(spark, str(tmp_path / "v"), v.limit(0))
    parsed(spark).write.parquet(str(tmp_path / "p"))
    assert readers.parsed_documents(spark, str(tmp_path / "p")).count() == 3
    span = {"context_id": "7", "khoan_id": None, "unit_type": "article", "matched_span": "x", "confidence": 0.5, "role": None}
    (tmp_path / "s.json").write_text(json.dumps({"qid": "1", "spans": [span, span]}))
    assert [r["part_no"] for r in readers.span_labels(spark, str(tmp_path / "s.json")).collect()] == [0, 1]
    assert readers.one_document(rows, 2).first()["t"] == "b"


def test_identity_reads_every_digit(spark):
    rows = spark.createDataFrame([(k,) for k in range(50)], "x int")
    assert sinks.fingerprint(rows).first() == sinks.fingerprint(rows.repartition(7)).first() != sinks.fingerprint(rows.where("x < 49")).first()


def test_only_wanted_documents_are_parsed(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    step = F.when(F.col("doc_id") == 2, F.raise_error(F.lit("was parsed"))).otherwise(F.col("text"))
    rows = tables.only_of(docs, spark.createDataFrame([("1",), ("1",)], "doc_id string")).select("doc_id", step.alias("text"))
    assert [tuple(r) for r in rows.collect()] == [(1, "a")]


def test_label_answers_asks_for_the_documents_hit(spark):
    a = spark.createDataFrame([(1, "Người lao động phải báo trước ba mươi ngày")], "qid int, answer string")
    i = bm25.build_index(spark.createDataFrame([(7, LAW), (8, "chỉ có chữ"), (9, "một hai"), (10, "khác")], "doc_id int, text string"))
    asked = []

    def some(ids):
        asked.extend(r["doc_id"] for r in ids.collect())
        return parsed(spark).where(F.col("doc_id").cast("string").isin(asked))

    got, want = labelling.label_answers(a, i, some).collect(), labelling.label_answers(a, i, parsed(spark)).collect()
    assert got == want and "7" in asked and not {"9", "10"} & set(asked)
