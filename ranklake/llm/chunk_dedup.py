"""Substring dedup by content-defined chunks.

A gear hash rolls over the bytes of a text: h = (h << 1) + gear[byte] in 16 bits, so it depends on the last 16 bytes only. A
chunk ends where the top bits of h are zero, at the least size or later, or at the greatest size; boundaries follow content,
so an insertion moves only the chunks it touches. Chunks are grouped by a 128-bit digest; the first occurrence of each, by
doc_id and then position, stays. Later occurrences are repeats; runs of adjacent repeats of at least ``least_run`` characters
are removed, and those that are a whole text; other shorter ones are chance and stay.

The hash is the same for all windows, so it is computed for all positions at once by doubling: the sum over 2k bytes is the
sum over the last k plus the sum over the k before, shifted by k.

Defined results: a null text counts as empty; an empty text has no chunk and stays; cuts are moved to the next character;
a very long text is cut whole; rows equal in doc_id and text are one document, all its copies get the same result; of
different texts of one doc_id, or of rows without one, the text with the smaller hash comes first; a null doc_id comes before
all others; an empty table gives an empty result; other columns are kept as they are, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ranklake.llm.common import hold, materialize, ship, text_or_empty, unused

WINDOW = 16


def gear_table(seed: int = 1) -> np.ndarray:
    """256 fixed 16-bit numbers from a hash of the byte's value."""
    return np.array([xxhash.xxh64_intdigest(bytes([b]), seed) & 0xFFFF for b in range(256)], dtype=np.uint16)


GEAR = gear_table()


def rolling(raw: np.ndarray) -> np.ndarray:
    """The gear hash after each byte."""
    h = GEAR[raw]
    k = 1
    while k < WINDOW:
        h[k:] += h[:-k] << k if len(h) > k else 0
        k *= 2
    return h


def cuts(raw: np.ndarray, bits: int, least: int, most: int) -> list[int]:
    """Ends of the chunks, in bytes; the last is the length."""
    n = len(raw)
    marks = (np.flatnonzero(rolling(raw) < (1 << (16 - bits))) + 1).tolist()
    out, at = [], 0
    for m in marks:
        while m - at > most:
            at += most
            out.append(at)
        if m - at >= least:
            at = m
            out.append(at)
    while n - at > most:
        at += most
        out.append(at)
    if at < n:
        out.append(n)
    return out


def chunk_ends(raw: bytes, bits: int, least: int, most: int) -> list[int]:
    """``cuts`` moved on to the start of the next character."""
    view = np.frombuffer(raw, np.uint8)
    out = []
    for c in cuts(view, bits, least, most):
        while c < len(raw) and raw[c] & 0xC0 == 0x80:
            c += 1
        if not out or c > out[-1]:
            out.append(c)
    return out


def text_mark() -> Column:
    """Tells texts of one doc_id apart, however many share it."""
    return F.xxhash64(text_or_empty())


def chunks(docs: DataFrame, bits: int, least: int, most: int) -> DataFrame:
    """(doc_id, th, start, size, h1, h2): a row a chunk, in code points; th is ``text_mark``."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("chunks")
        for b in batches:
            start, size, digest, count = [np.zeros(0)], [np.zeros(0)], [], []
            for t in b.column("text").to_pylist():
                raw = t.encode("utf-8", "surrogatepass")
                at, ends = 0, chunk_ends(raw, bits, least, most)
                for e in ends:
                    digest.append(xxhash.xxh3_128_digest(raw[at:e]))
                    at = e
                count.append(len(ends))
                chars = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])[[0, *ends]]
                start.append(chars[:-1])
                size.append(np.diff(chars))
            h = np.frombuffer(b"".join(digest), "<i8").reshape(-1, 2)
            row = pa.array(np.repeat(np.arange(len(count), dtype=np.int32), count))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(row), b.column("th").take(row), pa.array(np.concatenate(start).astype(np.int32)), pa.array(np.concatenate(size).astype(np.int32)), pa.array(h[:, 0]), pa.array(h[:, 1])],
                names=["doc_id", "th", "start", "size", "h1", "h2"],
            )

    rows = docs.select("doc_id", text_mark().alias("th"), text_or_empty().alias("text"))
    fields = [("th", T.LongType()), ("start", T.IntegerType()), ("size", T.IntegerType()), ("h1", T.LongType()), ("h2", T.LongType())]
    return rows.mapInArrow(run, T.StructType([docs.schema["doc_id"], *(T.StructField(*f) for f in fields)]))


def repeats(cut: DataFrame) -> DataFrame:
    """The rows of ``cut`` that occurred before.

    First the halves of digests that repeat are counted, which moves a number for each digest; only rows with such a half go
    further. Counts and first places are combined before their shuffles, and what the joins look up is written, so that they
    read two plain shuffles and Spark can split the partition of a very common chunk.
    """
    often, _ = materialize(cut.groupBy("h1").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h1"), "often")
    rows, _ = materialize(cut.join(often, "h1"), "repeated")
    place = F.struct("doc_id", "th", "start")
    first, _ = materialize(rows.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "first")
    return rows.join(first, ["h1", "h2"]).where(~place.eqNullSafe(F.col("first"))).select("doc_id", "th", "start", "size")


def result_columns(docs: DataFrame) -> list[str]:
    """What ``remove_repeats`` calls n_repeats, removed_chars and removed: with underscores after them where docs has these."""
    return unused(docs, "n_repeats", "removed_chars", "removed")


def remove_repeats(docs: DataFrame, bits: int = 4, least: int = 24, most: int = 256, least_run: int = 100) -> DataFrame:
    """docs with repeated passages removed from ``text``, and three columns by ``result_columns``.

    ``removed`` holds the removed spans (start, end) in code points of the original text. Texts are cut into chunks twice,
    which is cheaper than to keep the chunks; they are shuffled once, to meet their repeats, and cut with SQL functions.
    """
    cut = chunks(docs, bits, least, most)
    n_repeats, removed_chars, removed = result_columns(docs)
    key, id_, th, held = unused(docs, "_key", "_id", "_th", "_chunks")
    of_doc = repeats(cut).groupBy("doc_id", "th").agg(F.sort_array(F.collect_set(F.struct("start", (F.col("start") + F.col("size")).alias("end")))).alias("c"))
    found = of_doc.select(F.col("doc_id").alias(id_), F.col("th").alias(th), F.col("c").alias(held))
    both = docs.withColumn(key, text_mark()).join(found, F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col(key) == F.col(th)), "left")
    # Adjacent repeats make one run: it begins where no repeat ends and ends where none begins.
    begins = F.filter(held, lambda x, i: ~F.coalesce(F.get(held, i - 1)["end"] == x["start"], F.lit(False)))
    ends = F.filter(held, lambda x, i: ~F.coalesce(F.get(held, i + 1)["start"] == x["end"], F.lit(False)))
    runs = F.zip_with(begins, ends, lambda a, b: F.struct(a["start"].alias("start"), b["end"].alias("end")))
    none = F.array().cast("array<struct<start:int,end:int>>")
    long_runs = F.coalesce(F.filter(runs, lambda r: (r["end"] - r["start"] >= least_run) | ((r["start"] == 0) & (r["end"] == F.length("text")))), none)
    marked = both.withColumn(removed, long_runs).withColumn(n_repeats, F.coalesce(F.size(held), F.lit(0)))
    kept = F.transform(
        F.sequence(F.lit(0), F.size(removed)),
        lambda i: F.struct(F.coalesce(F.get(removed, i - 1)["end"], F.lit(0)).alias("a"), F.coalesce(F.get(removed, i)["start"], F.length("text")).alias("b")),
    )
    text = F.when(F.size(removed) > 0, F.array_join(F.transform(kept, lambda r: F.substring(F.col("text"), r["a"] + 1, r["b"] - r["a"])), "")).otherwise(F.col("text"))
    total = F.aggregate(removed, F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["start"])
    return marked.select(*[text.alias("text") if c == "text" else F.col(c) for c in docs.columns], F.greatest(n_repeats, F.lit(0)).alias(n_repeats), total.alias(removed_chars), removed)
