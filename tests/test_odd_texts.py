"""Queries agree with their SQL on texts that begin with numbers, lines that end in one, and large ids."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from ranklake.plans import registry

TEXTS = {
    0: "20. one line that begins like a clause", 1: "1. a\n2. b\n3. c\n4) d", 2: "a b\nc d1\ne f2\ng h3\n", 3: " x 0\n y 1 \n z 2 ", 4: None, 5: "", 6: "41) e", 7: "30. z", 9: "31. w", 10: "p\nq\nr\n7. s",
    9_998: "first", 9_999: "second", 10_000: "third", 10_001: "fourth", 123_456: "fifth", 123_457: "sixth", 20_010: "5. x", 20_012: "6) x",
}
NAMES = (
    "article_always", "article_if_short", "article_lookup", "assemble_answer", "body_budget", "expand_adjacent", "followed_numbers", "format_context", "format_variants", "legal_units", "online_items",
    "parse_legal", "repeated_ids", "repeated_id_damage", "split_answer_first", "split_answer_last",
)


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    path = tmp_path_factory.mktemp("odd")
    pq.write_table(pa.table({"doc_id": pa.array(list(TEXTS), pa.int64()), "text": pa.array(list(TEXTS.values()), pa.string()), "source": ["s"] * len(TEXTS)}), path / "documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{path}/documents.parquet'")
    return str(path), con


@pytest.mark.parametrize("name", NAMES)
def test_agrees_with_sql(spark, odd, name):
    path, con = odd
    got, want = registry.queries()[name](spark, path), con.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    cell = lambda v: f"{v:.6g}" if isinstance(v, float) else str(v)
    assert sorted(tuple(map(cell, r)) for r in got.select(*columns).collect()) == sorted(tuple(map(cell, r)) for r in want.fetchall())
