"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession

from ranklake.operators import bm25, dense, pack
from ranklake.plans import registry, retrieval
from ranklake.plans.packing import candidates
from ranklake.plans.tables import documents, questions

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def index_build(spark, sf):
    return bm25.build_index(documents(spark, sf))["postings"]


def search(spark, sf):
    return bm25.search(bm25.build_index(documents(spark, sf)), questions(spark, sf), 100)


def dense_search(spark, sf):
    return dense.top_k(retrieval.dense_queries(spark, sf), retrieval.dense_vectors(spark, sf), 300)


def packing(spark, sf):
    return pack.greedy(candidates(spark, sf))


QUERIES = {"bm25_index_build": index_build, "bm25_top_100": search, "dense_top_300": dense_search, "pack_greedy": packing} | {
    n: registry.queries()[n] for n in ("hybrid_search", "bm25_multi_query", "rrf", "ranking_metrics", "legal_units", "expand_adjacent", "duplicate_unit_audit", "length_stats")
}


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench").config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    times = {}
    for name, f in QUERIES.items():
        began = time.time()
        f(spark, SF).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "total seconds of headline queries", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": SF}))


if __name__ == "__main__":
    main()
