"""Line dedup by overlapping three-line windows, in DataFrame and SQL functions only.

Every three consecutive lines of a text are one window. Windows are hashed (128 bits) and grouped over the whole table; of
each repeated window the first occurrence, by doc_id and then position, stays. The positions that later occurrences cover
are merged, and their lines removed.

Defined results: a null text counts as empty; texts of fewer than three lines have no window and stay whole; windows of
blank lines only are ignored; a very long text is cut into all its lines; rows equal in doc_id and text are one document, all
their copies get the same result; of different texts of one doc_id, or of rows without one, the text with the smaller hash
comes first; a null doc_id comes before all others; an empty table gives an empty result; other columns are kept as they are,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ranklake.llm.common import materialize, text_or_empty, unused

WINDOW = 3


def _lines() -> Column:
    return F.split(text_or_empty(), "\n", -1)


def windows(docs: DataFrame) -> DataFrame:
    """(doc_id, th, h1, h2, at): a row for each window that isn't blank; th is a hash of the whole text."""
    lined = docs.select("doc_id", F.xxhash64(text_or_empty()).alias("th"), _lines().alias("lines")).where(F.size("lines") >= WINDOW)
    at = F.explode(F.sequence(F.lit(0), F.size("lines") - WINDOW)).alias("at")
    three = [F.get("lines", F.col("at") + k) for k in range(WINDOW)]
    rows = lined.select("doc_id", "th", "lines", at).select("doc_id", "th", "at", *[c.alias(f"l{k}") for k, c in enumerate(three)])
    blank = F.trim(F.concat_ws("", "l0", "l1", "l2")) == ""
    return rows.where(~blank).select("doc_id", "th", F.xxhash64("l0", "l1", "l2").alias("h1"), F.xxhash64(F.lit(1), "l0", "l1", "l2").alias("h2"), "at")


def covered(docs: DataFrame) -> DataFrame:
    """(doc_id, th, starts): for each document the sorted starts of windows that occurred before.

    Counts and first places are combined before their shuffle. The repeated windows are written, so that the join with all
    windows reads two plain shuffles and Spark can split the partition of a very common window.
    """
    w = windows(docs)
    place = F.struct("doc_id", "th", "at")
    repeated, _ = materialize(w.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "windows")
    later = w.join(repeated, ["h1", "h2"]).where(~place.eqNullSafe(F.col("first")))
    return later.groupBy("doc_id", "th").agg(F.sort_array(F.collect_set("at")).alias("starts"))


def count_columns(docs: DataFrame) -> tuple[str, str]:
    """What ``remove_repeats`` calls its counts: n_lines and n_removed, with underscores after them where docs has these."""
    n_lines, n_removed = unused(docs, "n_lines", "n_removed")
    return n_lines, n_removed


def remove_repeats(docs: DataFrame) -> DataFrame:
    """docs with repeated lines removed from ``text``, and two counts by ``count_columns``."""
    n_lines, n_removed = count_columns(docs)
    key, id_, th, starts, lines, kept = unused(docs, "_key", "_id", "_th", "_starts", "_lines", "_kept")
    found = covered(docs).select(F.col("doc_id").alias(id_), F.col("th").alias(th), F.col("starts").alias(starts))
    keyed = docs.withColumn(key, F.xxhash64(text_or_empty()))
    both = keyed.join(found, F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col(key) == F.col(th)), "left").withColumn(lines, _lines())
    # Windows have one length and are sorted, so the lines between one end and the next start are those that stay.
    n = F.size(lines)
    ranges = F.transform(
        F.sequence(F.lit(0), F.size(starts)),
        lambda i: F.struct(F.coalesce(F.get(starts, i - 1) + WINDOW, F.lit(0)).alias("a"), F.coalesce(F.get(starts, i), n).alias("b")),
    )
    stay = F.transform(F.filter(ranges, lambda r: r["b"] > r["a"]), lambda r: F.slice(lines, r["a"] + 1, r["b"] - r["a"]))
    hit = F.col(starts).isNotNull()
    both = both.withColumn(kept, F.when(hit, F.flatten(stay)))
    text = F.when(hit, F.array_join(kept, "\n")).otherwise(F.col("text"))
    removed = F.when(hit, n - F.size(kept)).otherwise(0)
    return both.select(*[text.alias("text") if c == "text" else F.col(c) for c in docs.columns], n.alias(n_lines), removed.alias(n_removed))
