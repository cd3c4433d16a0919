"""Retrieval, fusion, metrics, sources and sinks."""

import json
import math
import os
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ranklake.operators import bm25, dense, fuse, metrics
from ranklake.plans import registry
from ranklake.sources import readers, sinks
from ranklake.streaming.resumable import resumable


def test_bm25_is_the_formula(spark):
    rng = random.Random(1)
    docs = [(k, " ".join(rng.choice("a b c d e f".split()) for _ in range(rng.randint(0, 12)))) for k in range(30)]
    index = bm25.build_index(spark.createDataFrame(docs, "doc_id int, text string"))
    q = spark.createDataFrame([("q", "a a f zz")], "qid string, question string")
    got = {r["doc_id"]: r["score"] for r in bm25.search(index, q, 30).collect()}
    words = [t.split() for _, t in docs]
    n, avg = len(docs), sum(map(len, words)) / len(docs)
    df = Counter(t for w in words for t in set(w))
    raw = {t: math.log(n - c + 0.5) - math.log(c + 0.5) for t, c in df.items()}
    mean = sum(raw.values()) / len(raw)
    idf = {t: x if x >= 0 else 0.25 * mean for t, x in raw.items()}
    for k, w in enumerate(words):
        c = Counter(w)
        s = sum(idf[t] * c[t] * 2.5 / (c[t] + 1.5 * (0.25 + 0.75 * len(w) / avg)) for t in "a a f".split() if c[t])
        assert got.get(k, 0.0) == pytest.approx(s, abs=1e-8)
    padded = bm25.search(index, spark.createDataFrame([("z", "zz")], "qid string, question string"), 3, pad_zero=True).orderBy("rank").collect()
    assert [r["doc_id"] for r in padded] == [0, 1, 2]


def test_words_after_50000_characters_are_indexed(spark):
    d = spark.createDataFrame([(1, "a " * 40_000 + "last"), (2, "b")], "doc_id int, text string")
    index = bm25.build_index(d)
    assert [r["doc_id"] for r in index["postings"].where("term = 'last'").collect()] == [1]
    assert index["doc_stats"].where("doc_id = 1").first()["dl"] == 40_001


def test_dense_is_brute_force(spark):
    rng = np.random.RandomState(0)
    v = rng.normal(size=(50, 8))
    df = spark.createDataFrame([(k, str(k % 40), v[k].tolist()) for k in range(50)], "row_id long, unit_id string, vec array<double>")
    q = df.where("row_id < 5").select(F.col("row_id").alias("qid"), "vec")
    got = dense.top_k(q, df, 7, exclude_self=True).collect()
    for i in range(5):
        s = v[i] @ v.T
        s[i] = -9e9
        assert [r["row_id"] for r in sorted((r for r in got if r["qid"] == i), key=lambda r: r["rank"])] == np.argsort(-s)[:7].tolist()
    # By unit id the last row counts; candidates without a vector keep their score.
    c = spark.createDataFrame([(0, None, "3", 0.5), (0, None, "none", 0.25)], "qid long, row_id long, unit_id string, score double")
    r = {x["unit_id"]: x["score"] for x in dense.rescore(c, q, df).collect()}
    assert r["3"] == pytest.approx(float(v[0] @ v[43]), abs=1e-8) and r["none"] == 0.25


def run(spark, *units):
    return spark.createDataFrame([("q", u, k + 1, 1.0 / (k + 1)) for k, u in enumerate(units)], "qid string, unit_id string, rank int, score double")


def order(df):
    return [r["unit_id"] for r in df.orderBy("rank").collect()]


def test_fusion(spark):
    a, b = run(spark, "x", "y", "z"), run(spark, "z", "w", "x")
    assert order(fuse.union(a, b)) == ["x", "y", "z", "w"]
    assert order(fuse.rrf(a, b)) == ["x", "z", "y", "w"]
    r = spark.createDataFrame([("q", "a", 0, 2), ("q", "b", 1, 1), ("q", "c", 2, 0)], "qid string, unit_id string, dense_rank int, rerank_rank int")
    assert order(fuse.blend(r, 0.0)) == ["c", "b", "a"] and order(fuse.blend(r, 1.0)) == ["a", "b", "c"] and order(fuse.linear_blend(r, 0.9)) == ["a", "b", "c"]
    with pytest.raises(Exception, match="dense_rank"):
        fuse.blend(r.withColumn("dense_rank", F.lit(None).cast("int")), 0.5).collect()
    d = run(spark, "1", "2", "3", "4").withColumn("doc_id", F.when(F.col("unit_id") < "4", "d").otherwise("e"))
    assert order(fuse.diverse(d, 3, 2)) == ["1", "2", "4"] and order(fuse.diverse(d, 3)) == ["1", "2", "3"]


def test_metrics(spark):
    gold = spark.createDataFrame([("q", "b"), ("q", "d"), ("q", "b"), ("p", "a")], "qid string, unit_id string")
    m = {r["k"]: r for r in metrics.evaluate(run(spark, "a", "b", "c"), gold, (1, 2, 3)).collect()}
    assert (m[1]["hit"], m[2]["hit"], m[2]["recall_micro"], m[3]["recall_strict"], m[3]["mrr"]) == (0.0, 0.5, pytest.approx(1 / 3, abs=1e-6), 0.0, 0.25)
    assert m[2]["ndcg"] == pytest.approx((1 / math.log2(3)) / (1 + 1 / math.log2(3)) / 2, abs=1e-6)
    # Any order of the same pool has the same hits at the pool's size.
    assert metrics.evaluate(run(spark, "c", "b", "a"), gold, (3,)).first()["hit"] == m[3]["hit"]
    values = spark.createDataFrame([(x,) for x in range(1, 11)], "value long")
    p = metrics.floor_percentiles(values).first()
    assert (p["p50"], p["p90"], p["p95"], p["p99"]) == (6, 10, 10, 10)


def test_bootstrap(spark):
    rows = spark.createDataFrame([(k, float(k % 5)) for k in range(200)], "qid int, value double")
    b = metrics.bootstrap(rows, resamples=400).first()
    e = metrics.bootstrap(rows, resamples=400, exact=True).first()
    for x in (b, e):
        assert x["n"] == 200 and x["mean"] == pytest.approx(2.0) and 1.7 < x["low"] < 2.0 < x["high"] < 2.3


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "qa.json").write_text(json.dumps({"1": {"question": "a", "answer": None}, "2": {"question": "b", "answer": "c"}}))
    assert sorted((r["qid"], r["question"], r["answer"]) for r in readers.question_set(spark, str(tmp_path / "qa.json")).collect()) == [("1", "a", None), ("2", "b", "c")]
    docs = tmp_path / "docs"
    docs.mkdir()
    for k, name in ((2, "N"), (10, None)):
        (docs / f"{k}.json").write_text(json.dumps({"id": k, "name": name, "link": "http://x/y.aspx", "passage": f"p{k}"}))
    (docs / "3.json").write_text(json.dumps({"id": 3, "name": "E", "link": "", "passage": None}))
    got = {r["id"]: r for r in readers.raw_documents(spark, str(docs)).collect()}
    assert set(got) == {2, 10} and got[10]["name"] == "y" and got[10]["name_is_fallback"] and got[10]["doc_pos"] == 0 and got[2]["doc_pos"] == 1
    lines = [{"qid": "1", "unit_ids": ["a", "b"]}, {"qid": "2", "candidates": [{"unit_id": "c"}]}, {"qid": "3", "ranked_units": [{"unit_id": "d", "score": 1.5, "dense_rank": 4}]}]
    (tmp_path / "run.jsonl").write_text("\n".join(map(json.dumps, lines)))
    assert sorted((r["qid"], r["unit_id"], r["rank"], r["score"]) for r in readers.run_file(spark, str(tmp_path / "run.jsonl")).collect()) == [("1", "a", 1, None), ("1", "b", 2, None), ("2", "c", 1, None), ("3", "d", 1, 1.5)]
    d = spark.createDataFrame([(1, "a b"), (2, "b")], "doc_id int, text string")
    sinks.save_index(bm25.build_index(d), str(tmp_path / "index"))
    assert sinks.load_index(spark, str(tmp_path / "index"))["corpus_stats"].first()["n"] == 2
    with pytest.raises(Exception, match="(?i)exist"):
        sinks.write_table(d, str(tmp_path / "index" / "postings"))
    identity = sinks.fingerprint(d).first()["identity"]
    assert sinks.fingerprint(d.orderBy(F.desc("doc_id"))).first()["identity"] == identity
    sinks.require_identity(identity, d)
    with pytest.raises(ValueError, match="cache"):
        sinks.require_identity(identity, d.limit(1))
    assert [x["unit_id"] for x in sinks.nested_run(run(spark, "x", "y").withColumn("doc_id", F.lit(1))).first()["candidates"]] == ["x", "y"]


def test_resumable_batches(spark, tmp_path):
    src, out, state = (str(tmp_path / x) for x in ("src", "out", "state"))
    spark.range(3).write.parquet(src)
    for _ in range(2):
        resumable(spark, src, "id long", lambda df: df.selectExpr("id * 2 as x"), out, state, 1).awaitTermination()
        assert sorted(r["x"] for r in spark.read.parquet(out).collect()) == [0, 2, 4]


def test_search_takes_one_pass_over_documents(spark, monkeypatch):
    import math
    import random
    from collections import Counter

    rng = random.Random(11)
    docs = [(f"d{i:03}", " ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(0, 7)))) for i in range(150)] + [("e", None)]
    queries = [(n, " ".join(rng.choice("abcxyz") for _ in range(4))) for n in range(9)]
    # Small bounds: several blocks of queries, a few documents at a time, many cuts.
    monkeypatch.setattr(bm25, "QUERY_BLOCK", 4)
    monkeypatch.setattr(bm25, "CELLS", 16)
    index = bm25.build_index(spark.createDataFrame(docs, "doc_id string, text string"))
    found = bm25.search(index, spark.createDataFrame(queries, "qid long, question string"), 5)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()  # the lists are found already
    words = {d: Counter((t or "").split()) for d, t in docs}
    df = Counter(w for c in words.values() for w in c)
    idf = {w: math.log(len(docs) - n + 0.5) - math.log(n + 0.5) for w, n in df.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {w: x if x >= 0 else 0.25 * mean for w, x in idf.items()}
    avgdl = sum(sum(c.values()) for c in words.values()) / len(docs)
    want = set()
    for q, text in queries:
        terms = Counter(text.split())
        scored = [(-round(sum(m * idf[w] * c[w] * 2.5 / (c[w] + 1.5 * (0.25 + 0.75 * sum(c.values()) / avgdl)) for w, m in terms.items() if w in c), 9), d) for d, c in words.items() if terms.keys() & c.keys()]
        want |= {(q, d, n, round(-s, 6)) for n, (s, d) in enumerate(sorted(scored)[:5], 1)}
    assert {(r["qid"], r["doc_id"], r["rank"], round(r["score"], 6)) for r in found.collect()} == want


def test_saved_index_takes_statistics_from_its_counts(spark, tmp_path):
    d = spark.createDataFrame([(1, "a b b"), (2, "a c"), (3, None)], "doc_id long, text string")
    saved, built = sinks.saved_index(spark, d, str(tmp_path / "index")), bm25.build_index(d)
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "index" / "counts")).collect())) == [("a", 2), ("b", 1), ("c", 1)]
    for name in ("term_stats", "corpus_stats"):
        assert sorted(map(tuple, saved[name].collect())) == sorted(map(tuple, built[name].collect()))


#: What a query scans once its run is found: rows of the run or of its candidates, k a question, and columns of documents that hold no text.
SCANS = {
    "hits_histogram": ["doc_id"],
    "cut_diverse": ["qid,doc_id,rank", "doc_id,source"],
    "pack_exact": ["qid,rank,unit_id,text"],
    "precision_recall": ["qid,doc_id,rank,text,question"],
}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test data")
@pytest.mark.parametrize("name", SCANS)
def test_after_a_search_only_its_run_is_read(spark, name):
    """No posting is scanned, and documents meet the run where they are read: it is broadcast, they aren't sorted."""
    plan = registry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert [re.sub(r":\w+", "", x) for x in re.findall(r"ReadSchema: struct<([^>]*)>", plan)] == SCANS[name]
    assert "SortMergeJoin" not in plan and "BuildRight" not in plan
