"""The queries of the data operators, by name, and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ranklake.llm import bestfit_pack, chunk_dedup, line_dedup, piece_codec, pivot_dedup, progressive_jpeg, pu_quality, secret_scan, simhash_dedup, token_counts
from ranklake.llm.common import table, tokenizer_path, tokenizer_pattern


def op1_pivot_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.98)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"), words=3, radius=3)


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(table(spark, sf_dir, "documents"))


def _secrets_sql() -> str:
    parts = []
    for i, r in enumerate(secret_scan.BASE + secret_scan.MORE):
        p = r.pattern.replace("'", "''")
        parts.append(f"""
    SELECT id, {i} AS place, '{r.kind}' AS kind,
           unnest(list_transform(range(1, len(m) + 1), lambda k: list_sum(list_transform(p[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:k - 1], lambda x: length(x))), 0))) AS b,
           unnest(list_transform(m, lambda x: length(x))) AS size, unnest(list_transform(g, lambda x: length(x))) AS kept, {r.least} AS least
    FROM (SELECT id, regexp_split_to_array(t, '{p}') AS p, regexp_extract_all(t, '{p}') AS m, regexp_extract_all(t, '{p}', {r.group}) AS g
          FROM d WHERE regexp_matches(t, '{p}'))""")
    return f"""
WITH d AS (SELECT doc_id AS id, coalesce(text, '') AS t FROM documents),
s AS (SELECT id, place, kind, CAST(b AS BIGINT) AS b, CAST(b + size AS BIGINT) AS e FROM ({" UNION ALL ".join(parts)}) WHERE kept >= least),
a AS (SELECT id, count_if(place = 0) AS n_assign, count_if(place = 1) AS n_access, count_if(place = 2) AS n_hex,
             string_agg(kind || ':' || b || ':' || e, ',' ORDER BY b, place) FILTER (WHERE place < 3) AS base,
             string_agg(kind || ':' || b || ':' || e, ',' ORDER BY b, place) AS spans FROM s GROUP BY id)
SELECT d.id AS doc_id, CAST(coalesce(n_assign, 0) AS BIGINT) AS n_assign, CAST(coalesce(n_access, 0) AS BIGINT) AS n_access,
       CAST(coalesce(n_hex, 0) AS BIGINT) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a ON d.id = a.id"""


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.round_trip(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op7_bestfit_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bestfit_pack.pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), capacity=2048, words=2_500_000)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.by_section(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.tiktoken"), tokenizer_pattern())


def op6_progressive_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return progressive_jpeg.digests(progressive_jpeg.media(table(spark, sf_dir, "documents")))


def op10_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pu_quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


LINES_SQL = """
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
w AS (SELECT doc_id, i, line, lead(line) OVER d AS b, lead(line, 2) OVER d AS c FROM l WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY line, b, c ORDER BY doc_id, i) AS nth FROM w WHERE c IS NOT NULL AND trim(concat(line, b, c)) <> ''),
x AS (SELECT DISTINCT doc_id, i + k AS i FROM r, (VALUES (0), (1), (2)) AS o(k) WHERE nth > 1)
SELECT l.doc_id, coalesce(string_agg(line, chr(10) ORDER BY l.i) FILTER (WHERE x.i IS NULL), '') AS text,
       CAST(count(*) AS INTEGER) AS n_lines, CAST(count(x.i) AS INTEGER) AS n_removed
FROM l LEFT JOIN x ON l.doc_id = x.doc_id AND l.i = x.i GROUP BY l.doc_id"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


def oracle_sql() -> dict[str, str]:
    return {"op3_secrets": _secrets_sql(), "op5_line_dedup": LINES_SQL}
