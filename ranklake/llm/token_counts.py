"""Token counts by section: whole documents are encoded once and tokens are attributed to sections by their offsets.

A byte-level tokenizer's tokens tile the UTF-8 bytes of a text, so their spans are running sums of token lengths. Sections
tile the text too: a section is a line with the line end that closes it, or the fields of a row joined by a separator, each
with the separator after it. Both lists of intervals are sorted, so the interval join is a binary search of token starts
among section starts. A token that crosses a boundary is allocated by a rule:

- ``first`` (default): to the section of its first byte;
- ``largest``: to the section that holds most of its bytes, the earliest of equals.

Every token is counted once, so the counts of a document sum to its token count under either rule.

Defined results: a null text counts as empty; an empty text has one section with no tokens; a very long text is encoded
whole; repeated rows give repeated results; a null doc_id stays null and ids of any size keep their value; an empty table gives
an empty result; other columns, whatever their names, are dropped.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ranklake.llm.common import hold, ship, text_or_empty


class Encoder:
    """A byte-level encoder and the length in bytes of each of its tokens."""

    def __init__(self, ranks: bytes, pattern: str):
        mergeable = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        self.encoding = tiktoken.Encoding("sections", pat_str=pattern, mergeable_ranks=mergeable, special_tokens={})
        self.sizes = np.zeros(max(mergeable.values()) + 1, dtype=np.int64)
        self.sizes[list(mergeable.values())] = [len(t) for t in mergeable]

    def ids(self, text: str) -> np.ndarray:
        return self.encoding.encode_to_numpy(text).astype(np.int64)


def attribute(sizes: np.ndarray, starts: np.ndarray, total: int, rule: str = "first") -> np.ndarray:
    """Tokens of each section: token lengths in bytes, first bytes of the sections, bytes of the text."""
    ends = np.cumsum(sizes)
    begins = ends - sizes
    at = np.searchsorted(starts, begins, side="right") - 1
    if rule == "largest":
        bounds = np.append(starts, total)
        over = np.flatnonzero(ends > bounds[at + 1])
        for t in over.tolist():  # only tokens that cross a boundary
            inside = [min(ends[t], bounds[s + 1]) - max(begins[t], bounds[s]) for s in range(at[t], np.searchsorted(starts, ends[t], side="left"))]
            at[t] += int(np.argmax(inside))
    elif rule != "first":
        raise ValueError(f"no such rule: {rule}")
    return np.bincount(at, minlength=len(starts))


_ENCODERS: dict[str, Encoder] = {}


def encoder(ranks: bytes, pattern: str) -> Encoder:
    key = hashlib.sha256(ranks + pattern.encode()).hexdigest()
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(ranks, pattern)
    return _ENCODERS[key]


def by_section(docs: DataFrame, ranks_path: str, pattern: str, fields: list[str] | None = None, separator: str = "\n", rule: str = "first") -> DataFrame:
    """(doc_id, section, start, end, n_tokens, doc_tokens): a row for each section; offsets in code points, end exclusive.

    Without ``fields`` the sections are the parts of ``text`` that end with ``separator``. With them they are the fields of a row,
    null as empty, joined by ``separator``, which belongs to the field before it; a field may hold separators itself.
    """
    spark = docs.sparkSession
    ship(spark)
    ranks = spark.sparkContext.broadcast(Path(ranks_path).read_bytes())  # of the vocabulary's size
    mark = separator.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("sections")
        enc = encoder(ranks.value, pattern)
        for b in batches:
            out: list[list[np.ndarray]] = [[], [], [], [], []]
            width = []
            for parts in b.column("parts").to_pylist():
                t = separator.join(parts)
                raw = np.frombuffer(t.encode("utf-8"), np.uint8)
                if fields is None:
                    found = np.flatnonzero(raw[:-1] == mark[0]) + 1 if len(mark) == 1 else np.array([m.end() for m in re.finditer(re.escape(mark), raw.tobytes()) if m.end() < len(raw)], np.int64)
                    starts = np.concatenate([[0], found]).astype(np.int64) if len(raw) else np.zeros(1, np.int64)
                else:
                    sizes = np.array([len(x.encode("utf-8")) + len(mark) for x in parts], np.int64)
                    starts = np.cumsum(sizes) - sizes
                ids = enc.ids(t)
                n = attribute(enc.sizes[ids], starts, len(raw), rule)
                before = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])  # code points before each byte
                begin = before[np.minimum(starts, len(raw))]
                for x, y in zip(out, (np.arange(len(starts)), begin, np.append(begin[1:], before[-1]), n, np.full(len(starts), len(ids))), strict=True):
                    x.append(y)
                width.append(len(starts))
            section, begin, end, n, whole = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in out)
            row = pa.array(np.repeat(np.arange(len(width), dtype=np.int32), width))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(row), pa.array(section.astype(np.int32)), *(pa.array(x.astype(np.int64)) for x in (begin, end, n, whole))], names=["doc_id", "section", "start", "end", "n_tokens", "doc_tokens"]
            )

    parts = [text_or_empty()] if fields is None else [F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields]
    longs = [T.StructField(n, T.LongType()) for n in ("start", "end", "n_tokens", "doc_tokens")]
    return docs.select("doc_id", F.array(*parts).alias("parts")).mapInArrow(run, T.StructType([docs.schema["doc_id"], T.StructField("section", T.IntegerType()), *longs]))
