"""Best-fit packing of tokenised documents into sequences, by large-item matching over a histogram of lengths.

Documents longer than a sequence are cut into full pieces and a rest. Pieces are then whole numbers 1..capacity, so the plan
is made from their histogram, whose size doesn't depend on the data: pieces above a third of the capacity pair at most twice
a sequence (each takes the largest partner that fits, the largest first), smaller ones fill the remaining gaps, the longest
first, each in the tightest gap. The plan is a list of slots: pieces of one length with ranks from a to b go to sequences
from s on, at a fixed offset. Pieces of one length are dealt by a hash to as many groups as their number asks for and get
their rank from the sizes of the groups before theirs, so no length is gathered in one task; they find their slot by binary
search.

Defined results: a null text counts as empty and is the end token alone; a very long text is encoded whole and cut into
pieces; repeated rows are packed like any others, ties of length in an order by id; a null doc_id stays null and ids of any
size keep their value; an empty table gives an empty result; other columns, whatever their names, are dropped.
"""

from __future__ import annotations

import hashlib
import unicodedata
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from ranklake.llm.common import hold, materialize, ship, text_or_empty

#: Entries of a worker's table of words as they stand, and of that of lower-case words, by default; characters of the longest word
#: kept. A table half full takes a word up when it is met again, which a byte at its hash among SEEN tells.
WORDS, LONGEST, SEEN = 300_000, 48, 1 << 22
#: Pieces of one length are ranked in groups: of this many rows at least, and no more groups than that over all lengths.
GROUP_ROWS, GROUPS = 512, 65_536
#: Marks that may end a word of letters and then are one token group of their own; an apostrophe may start a contraction.
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


class WordTokens:
    """A tokenizer that lower-cases, drops white space and marks word ends, so that a text's ids are those of its words.

    Words are cut at spaces, tabs and line ends. A word of letters, or of letters and ASCII marks after them, is the same
    whatever its case and neighbours; the library encodes new ones together and the word-end marks part them again. Any
    other word is encoded by itself.
    """

    def __init__(self, model: str, words: int = WORDS):
        self.words = words
        self.tokenizer = Tokenizer.from_str(model)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        vocabulary = self.tokenizer.get_vocab()
        self._ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self._ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        """Empties the tables of words, so that the worker's next stage doesn't hold them."""
        self._known: dict[str, bytes] = {"": b""}  # words as they stand in the text
        self._plain: dict[str, bytes] = {}  # lower-case words of letters
        self._marks: dict[str, bytes] = {"": b""}  # groups of marks
        self._seen = bytearray(SEEN)

    def _kept(self, table: dict[str, bytes], fresh: dict[str, bytes], most: int, salt: int) -> None:
        """Takes new words up: all of them while the table is half empty, and then those that were met before."""
        seen, mask = self._seen, SEEN - 1
        free = most // 2 - len(table)
        for w, ids in fresh.items():
            at = (hash(w) ^ salt) & mask
            if (free > 0 or seen[at]) and len(w) <= LONGEST:
                table[w] = ids
                free -= 1
            seen[at] = 1

    def _one(self, word: str) -> bytes:
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, words: list[str]) -> dict[str, bytes]:
        """Encodings of lower-case words of letters: one call, parted at the word ends."""
        out: dict[str, bytes] = {}
        if words:
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
            cuts = np.flatnonzero(self._ends[ids]) + 1
            if len(cuts) == len(words) and cuts[-1] == len(ids):
                packed, at = ids.tobytes(), 0
                for w, cut in zip(words, (cuts * 4).tolist(), strict=True):
                    out[w] = packed[at:cut]
                    at = cut
            else:  # a word that the library parts differently
                out = {w: self._one(w) for w in words}
        return out

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text."""
        known, plain = self._known, self._plain
        split = [t.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") for t in texts]
        if len(known) > self.words:
            known.clear()
            known[""] = b""
        if len(plain) > self.words:
            plain.clear()
        fresh: dict[str, bytes] = {}
        parted: list[tuple[str, str, bytes]] = []
        for w in set().union(*split):
            if w in known:
                continue
            letters = w.rstrip(MARKS)
            if letters.isalpha() and (letters.isascii() or (unicodedata.is_normalized("NFC", letters) and "\u03a3" not in letters)):
                tail = w[len(letters) :]
                mark = self._marks.get(tail)
                if mark is None:
                    if len(self._marks) > 10_000:
                        self._marks = {"": b""}
                    mark = self._marks[tail] = self._one(tail)
                parted.append((w, letters.lower(), mark))
            else:
                fresh[w] = self._one(w)
        learnt = self._learn(list({x for _, x, _ in parted if x not in plain}))
        for w, x, mark in parted:
            ids = plain.get(x)
            fresh[w] = (learnt[x] if ids is None else ids) + mark
        self._kept(plain, learnt, self.words, 1)
        known.update(fresh)
        for words in split:
            yield np.frombuffer(b"".join(map(known.__getitem__, words)), "<u4")
        for w in fresh:
            del known[w]
        self._kept(known, fresh, self.words, 0)


_TOKENS: dict[str, WordTokens] = {}


def word_tokens(model: str, words: int) -> WordTokens:
    key = hashlib.sha256(f"{words} {model}".encode()).hexdigest()
    if key not in _TOKENS:
        _TOKENS[key] = WordTokens(model, words)
    return _TOKENS[key]


def pieces(docs: DataFrame, model_path: str, capacity: int, end_id: int = 0, words: int = WORDS) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, mark): each document's tokens and the end id, cut at ``capacity``; mark is a
    hash of the piece."""
    spark = docs.sparkSession
    ship(spark)
    model = spark.sparkContext.broadcast(Path(model_path).read_text(encoding="utf-8"))  # of the vocabulary's size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, end = word_tokens(model.value, words), np.array([end_id], "<u4")
        hold("pieces", t.forget)
        for b in batches:
            row, rows = [], []
            for i, body in enumerate(t.encode(b.column("text").to_pylist())):
                ids = np.concatenate([body, end])
                for k, at in enumerate(range(0, len(ids), capacity)):
                    part = ids[at : at + capacity]
                    crc = zlib.crc32(part.tobytes())
                    row.append(i)
                    rows.append((k, at, len(part), crc))
            k, at, n, crc = np.array(rows, np.int64).reshape(-1, 4).T
            index = pa.array(row, pa.int32())
            mark = (b.column("mark").take(index).to_numpy(zero_copy_only=False) ^ crc ^ k * 0x9E3779B1) & 0x7FFFFFFF
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(index), pa.array(k.astype(np.int32)), pa.array(at), pa.array(n), pa.array(crc), pa.array(mark)], names=["doc_id", "piece", "start", "length", "ids_crc32", "mark"]
            )

    return docs.select("doc_id", text_or_empty().alias("text"), F.xxhash64("doc_id").alias("mark")).mapInArrow(
        run, T.StructType([docs.schema["doc_id"], *(T.StructField(c, t) for c, t in (("piece", T.IntegerType()), *((c, T.LongType()) for c in ("start", "length", "ids_crc32", "mark"))))])
    )


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Slots (length, first rank, count, first sequence, offset) for ``histogram`` (length: count)."""
    left = {n: c for n, c in histogram.items() if c > 0}
    taken = dict.fromkeys(left, 0)
    slots: list[tuple[int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}  # free space: (first sequence, count) of groups of sequences
    sizes: list[int] = []  # of the gaps, sorted
    sequences = 0

    def put(n: int, count: int, first: int, offset: int) -> None:
        slots.append((n, taken[n], count, first, offset))
        taken[n] += count
        left[n] -= count

    def add_gap(gap: int, first: int, count: int) -> None:
        if gap and count:
            if gap not in gaps:
                gaps[gap] = []
                sizes.insert(bisect_left(sizes, gap), gap)
            gaps[gap].append((first, count))

    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        n = large[-1]
        if not left[n]:
            large.pop()
            continue
        at = bisect_left(large, capacity - n + 1) - 1
        while at >= 0 and not left[large[at]]:
            large.pop(at)
            at -= 1
        if at < 0:
            count, free = left[n], capacity - n
            put(n, count, sequences, 0)
        elif large[at] == n:  # equals pair with each other; an odd one is taken up by the next turn
            count, free = left[n] // 2, capacity - 2 * n
            if not count:
                below = next((m for m in reversed(large[:at]) if left[m]), None)
                count, free = 1, capacity - n - (below or 0)
                put(n, 1, sequences, 0)
                if below:
                    put(below, 1, sequences, n)
            else:
                put(n, count, sequences, 0)
                put(n, count, sequences, n)
        else:
            m = large[at]
            count, free = min(left[n], left[m]), capacity - n - m
            put(n, count, sequences, 0)
            put(m, count, sequences, n)
        add_gap(free, sequences, count)
        sequences += count

    for n in sorted((n for n in left if left[n]), reverse=True):
        while left[n]:
            at = bisect_left(sizes, n)
            if at == len(sizes):  # new sequences, as many as the rest of this length fills
                per = capacity // n
                count = -(-left[n] // per)
                add_gap(capacity, sequences, count)
                sequences += count
                continue
            gap = sizes[at]
            first, count = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap]
                sizes.pop(at)
            per = min(gap // n, left[n])  # the tightest gap is the one just used, as long as it holds another
            full = min(count, left[n] // per)
            for k in range(per):
                put(n, full, first, capacity - gap + k * n)
            add_gap(gap - per * n, first, full)
            add_gap(gap, first + full, count - full)
    return slots


def pack(docs: DataFrame, model_path: str, capacity: int = 2048, words: int = WORDS) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for every piece of every document.

    ``words`` bounds a worker's two tables of words, about 160 bytes an entry: it trades memory for time and changes no result.
    """
    spark = docs.sparkSession
    cut, _ = materialize(pieces(docs, model_path, capacity, words=words), "pieces")
    lengths = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}  # at most ``capacity`` numbers
    rows = max(GROUP_ROWS, sum(lengths.values()) // GROUPS)
    groups = spark.createDataFrame([(n, -(-c // rows)) for n, c in lengths.items()], "length long, groups long")
    dealt = cut.join(F.broadcast(groups), "length").withColumn("salt", F.pmod("mark", "groups")).drop("mark", "groups")
    before = np.zeros(capacity + 2, np.int64)  # first number of each length's groups
    for n, c in lengths.items():
        before[n + 1] = -(-c // rows)
    before = np.cumsum(before)
    sizes = np.zeros(int(before[-1]), np.int64)
    for r in dealt.groupBy("length", "salt").count().collect():  # at most ``capacity`` + GROUPS numbers
        sizes[before[r["length"]] + r["salt"]] = r["count"]
    starts = np.cumsum(sizes) - sizes
    starts -= np.repeat(np.append(starts, 0)[before[:-1]], np.diff(before))  # ranks begin anew with each length
    ordered = sorted(plan(lengths, capacity))
    columns = {n: np.array([s[k] for s in ordered], dtype=np.int64) for k, n in enumerate(("length", "rank", "count", "sequence", "offset"))}
    key = columns["length"] << 44 | columns["rank"]  # ranks stay under 2**44
    known = spark.sparkContext.broadcast((key, columns, before, starts))  # bounded as the counts are; slots by pairs of lengths

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("places")
        key, c, before, starts = known.value
        for b in batches:
            n, salt, nth = (b.column(x).to_numpy() for x in ("length", "salt", "nth"))
            rank = nth - 1 + starts[before[n] + salt]
            at = np.searchsorted(key, n << 44 | rank, side="right") - 1
            place = pa.array(c["sequence"][at] + rank - c["rank"][at]), pa.array(c["offset"][at])
            yield pa.RecordBatch.from_arrays([*(b.column(x) for x in kept), *place], names=[*kept, "sequence_id", "offset"])

    nth = F.row_number().over(W.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")).cast("long")
    kept = [f for f in cut.columns if f != "mark"]
    schema = T.StructType([*(cut.schema[f] for f in kept), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return dealt.withColumn("nth", nth).mapInArrow(place, schema)
