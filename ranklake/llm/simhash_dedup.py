"""SimHash near-duplicates found by the generalised pigeonhole principle.

A fingerprint has 64 bits. The bits are grouped into a few parts, correlated bits together; with thresholds t_i per part
that sum to radius - parts + 1, two fingerprints within ``radius`` bits agree within t_i bits in at least one part i. The
thresholds are unequal in general: dynamic programming gives each part the threshold for which the estimated number of
probes and candidates is least, from bit statistics and counted keys of all fingerprints. Each fingerprint is stored once a part and
probes its part's ball; the join keeps pairs that differ in ``radius`` bits or fewer, so no false candidate leaves it.

Defined results: a null text counts as empty; empty texts have fingerprint zero and link like any other; a very long text is
read whole; rows with equal text share a fingerprint and a component; a null doc_id is ignored when the smallest id of a
component is taken; an empty table gives an empty result; other columns of the input are dropped by ``near_duplicates`` and
kept, whatever their names, by ``deduplicate``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat
from math import comb

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ranklake.llm.common import connected_components, hold, materialize, remove, ship, text_or_empty, unused

BITS = 64
#: What one candidate costs, in probes: a comparison inside the join against a row that is made, shuffled and sorted.
CANDIDATE_COST = 0.01


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """Unsigned 64-bit SimHash of the word shingles of a text, A-Z lower-cased."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII case and ASCII space only
    if not w:
        return 0
    shingles = map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False)) if len(w) >= words else [b" ".join(w)]
    n = max(1, len(w) - words + 1)
    h = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(seed)), dtype="<u8", count=n)
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, n, 1 << 15):
        part = h[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n, bitorder="little").tobytes(), "little")


def fingerprint_column(text: Column, words: int = 3) -> Column:
    """The fingerprint as a signed long."""

    @F.pandas_udf("long")
    def udf(texts: pd.Series) -> pd.Series:
        hold("fingerprints")
        return pd.Series(np.array([fingerprint(t, words) for t in texts], dtype=np.uint64).view(np.int64))

    return udf(text)


def bit_statistics(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints and how many have bits i and j set, over all rows of ``fps`` (fp); 64 x 64 numbers."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hold("bits")
        n, both = 0, np.zeros((BITS, BITS))
        for b in batches:
            x = np.unpackbits(b["fp"].to_numpy(np.int64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            n, both = n + len(x), both + x.T @ x
        yield pd.DataFrame({"at": np.arange(-1, BITS * BITS), "n": np.concatenate([[n], both.ravel().astype(np.int64)])})

    rows = fps.select("fp").mapInPandas(count, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()
    found = {r["at"]: r["n"] for r in rows}
    return found.get(-1, 0), np.array([found.get(i, 0) for i in range(BITS * BITS)], dtype=float).reshape(BITS, BITS)


def group_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Bits in ``parts`` groups of nearly equal size; each group grows by the bit most correlated with it."""
    p = both.diagonal() / max(n, 1)
    cov = both / max(n, 1) - np.outer(p, p)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs(cov / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    left, groups = set(range(BITS)), []
    for k in range(parts):
        size = len(left) // (parts - k)
        group = [max(sorted(left), key=lambda b: corr[b, sorted(left)].sum())]
        left.remove(group[0])
        while len(group) < size:
            best = max(sorted(left), key=lambda b: corr[b, group].sum())
            group.append(best)
            left.remove(best)
        groups.append(sorted(group))
    return groups


def key_collisions(fps: DataFrame, groupings: list[list[list[int]]]) -> list[list[float]]:
    """For each group of bits of each grouping the number of pairs of fingerprints that agree in it, counted over all rows."""
    keys = [F.struct(F.lit(g).cast("short").alias("g"), F.lit(i).cast("short").alias("i"), _part(bits).alias("key")) for g, groups in enumerate(groupings) for i, bits in enumerate(groups)]
    counts = fps.select(F.explode(F.array(*keys)).alias("k")).groupBy("k.g", "k.i", "k.key").agg(F.count(F.lit(1)).alias("n"))
    pairs = counts.groupBy("g", "i").agg(F.sum(F.col("n").cast("double") * (F.col("n") - 1) / 2).alias("pairs")).collect()  # a number a group
    found = {(r["g"], r["i"]): r["pairs"] for r in pairs}
    return [[found.get((g, i), 0.0) for i in range(len(groups))] for g, groups in enumerate(groupings)]


def allocate(n: int, both: np.ndarray, groups: list[list[int]], radius: int, agree: list[float]) -> tuple[float, list[int]]:
    """The least estimated cost, and thresholds that sum to radius - parts + 1 (-1: the part isn't probed).

    ``agree`` are counted pairs that agree in each group; for those within a few bits of it they are multiplied by how much
    likelier that is for bits of the measured frequencies.
    """
    p = both.diagonal() / max(n, 1)
    differ = 2 * p * (1 - p)

    def cost(group: list[int], t: int, equal: float) -> float:
        if t < 0:
            return 0.0
        dist = np.zeros(t + 1)  # of the number of differing bits of two random fingerprints, cut at t
        dist[0] = 1
        for b in group:
            dist = dist * (1 - differ[b]) + np.concatenate([[0], dist[:-1]]) * differ[b]
        probes = max(n, 1) * sum(comb(len(group), e) for e in range(min(t, len(group)) + 1))
        random = n * (n - 1) / 2 * float(dist.sum())
        return probes + CANDIDATE_COST * max(random, equal * float(dist.sum() / dist[0]) if dist[0] else 0.0)

    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for g, equal in zip(groups, agree, strict=True):
        following: dict[int, tuple[float, list[int]]] = {}
        for used, (c, ts) in best.items():
            for t in range(-1, radius + 1):
                new = (c + cost(g, t, equal), [*ts, t])
                if used + t + 1 not in following or new < following[used + t + 1]:
                    following[used + t + 1] = new
        best = following
    return best[radius + 1]  # the sum of (t + 1) is radius + 1


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _ball(i: int, part: Column, deltas: list[int]) -> Column:
    """Part i and the keys that differ from ``part`` by one of the deltas."""
    return F.transform(F.array(*map(F.lit, deltas)), lambda d: F.struct(F.lit(i).cast("byte").alias("part"), part.bitwiseXOR(d).alias("key")))


def partition(fps: DataFrame, radius: int, parts: tuple[int, ...]) -> tuple[list[list[int]], list[int]]:
    """Groups of bits and their thresholds; of the numbers of parts given that with the least estimated cost."""
    n, both = bit_statistics(fps)
    groupings = [group_bits(n, both, m) for m in parts]
    counted = key_collisions(fps, groupings)
    (_, thresholds), groups = min(((allocate(n, both, g, radius, c), g) for g, c in zip(groupings, counted, strict=True)), key=lambda x: x[0][0])
    return groups, thresholds


def spread(fps: DataFrame) -> DataFrame:
    """Fingerprints dealt to as many tasks as a shuffle has, before each makes many rows."""
    spark = fps.sparkSession
    return fps.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))


def _part(bits: list[int]) -> Column:
    return F.col("fp").bitwiseAND(F.lit(_signed(sum(1 << b for b in bits))))


def _stored_and_probes(fps: DataFrame, groups: list[list[int]], thresholds: list[int]) -> tuple[DataFrame, DataFrame]:
    """(part, key, fp, ...) of each part as it is, and of all keys in its ball; other columns of ``fps`` stay."""
    store, probe = [], []
    for i, (g, t) in enumerate(zip(groups, thresholds, strict=True)):
        if t < 0:
            continue
        store.append(F.struct(F.lit(i).cast("byte").alias("part"), _part(g).alias("key")))
        probe.append(_ball(i, _part(g), [_signed(sum(1 << b for b in c)) for e in range(t + 1) for c in combinations(g, e)]))
    rows = (fps.select("*", F.explode(k).alias("k")).select("k.part", "k.key", *fps.columns) for k in (F.array(*store), F.concat(*probe)))
    stored, probes = rows
    return stored, probes


def _differ(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def links(fps: DataFrame, radius: int, groups: list[list[int]], thresholds: list[int]) -> DataFrame:
    """Pairs (src, dst), src < dst, of distinct fingerprints ``fps`` (fp) that differ in ``radius`` bits or fewer.

    With a column ``group``, pairs of one group that isn't null are left out. A pair that meets in several parts comes from
    the first of them.
    """
    stored, probes = _stored_and_probes(fps, groups, thresholds)
    stored = stored.withColumnsRenamed({"fp": "dst", "group": "gd"})
    probes = probes.withColumnsRenamed({"fp": "src", "group": "gs"})
    near = (stored["part"] == probes["part"]) & (stored["key"] == probes["key"]) & (F.col("src") < F.col("dst")) & (_differ(F.col("src"), F.col("dst")) <= radius)
    x = F.col("src").bitwiseXOR(F.col("dst"))
    for i in range(1, len(groups)):
        met_before = F.lit(False)
        for g, t in zip(groups[:i], thresholds[:i], strict=True):
            if t >= 0:
                met_before |= F.bit_count(x.bitwiseAND(F.lit(_signed(sum(1 << b for b in g))))) <= t
        near &= (probes["part"] != i) | ~met_before
    if "group" in fps.columns:
        near &= F.coalesce(F.col("gs") != F.col("gd"), F.lit(True))
    return probes.join(stored, near).select("src", "dst")


def star_links(fps: DataFrame, radius: int, groups: list[list[int]], thresholds: list[int], centres: int = 2) -> DataFrame:
    """Some of the pairs of ``links``, a few for each fingerprint whatever the size of its group.

    Each key's fingerprints have ``centres`` centres, those with the smallest hashes; probes meet these alone.
    """
    stored, probes = _stored_and_probes(fps.select("fp"), groups, thresholds)
    found = stored.groupBy("part", "key").agg(F.array_distinct(F.array(*[F.min_by("fp", F.xxhash64("fp", F.lit(s))) for s in range(centres)])).alias("c"))
    chosen, _ = materialize(found, "centres")  # so that the join reads two plain shuffles, whose large partitions can be split
    fp = F.col("fp")
    linked = probes["fp"]
    near = (chosen["part"] == probes["part"]) & (chosen["key"] == probes["key"]) & F.exists("c", lambda c: (c != linked) & (_differ(c, linked) <= radius))
    met = probes.join(chosen, near).select("fp", F.explode(F.filter("c", lambda c: (c != fp) & (_differ(c, fp) <= radius))).alias("c"))
    return met.select(F.least("fp", "c").alias("src"), F.greatest("fp", "c").alias("dst")).distinct()


#: Numbers of parts that are weighed against each other.
PARTS = (2, 3, 4, 5, 6)


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 3, parts: tuple[int, ...] = PARTS) -> DataFrame:
    """(doc_id, fingerprint, component_id, kept): components of fingerprints linked within ``radius`` bits.

    Links come in two turns, as in ``components``: a few for each fingerprint, with centres of the keys that it probes; then all
    those between fingerprints that are still in different components. So a group's pairs aren't all emitted.
    """
    ship(docs.sparkSession)
    with_fp, _ = materialize(docs.select("doc_id", fingerprint_column(text_or_empty(), words).alias("fp")), "simhash")
    classes, _ = materialize(with_fp.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    fps = spread(classes.select("fp"))
    groups, thresholds = partition(fps, radius, parts)
    first, p_first = materialize(star_links(fps, radius, groups, thresholds), "links")
    so_far, gone = connected_components(first)
    grouped = classes.join(so_far.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("component", "fp").alias("group"))
    second, p_second = materialize(links(spread(grouped), radius, groups, thresholds), "links")
    found, _ = connected_components(first.unionByName(second))
    for path in (p_first, p_second, *gone):
        remove(docs.sparkSession, path)
    member = classes.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))
    ids, _ = materialize(member.groupBy("component").agg(F.min("first").alias("component_id")), "ids")
    of_fp = member.join(ids, "component").select("fp", "component_id")
    return with_fp.join(of_fp, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept")
    )


def shingle_set(text: str | None, words: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text, A-Z lower-cased; empty without words."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return np.zeros(0, np.int64)
    shingles = map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False)) if len(w) >= words else [b" ".join(w)]
    n = max(1, len(w) - words + 1)
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(42)), dtype="<u8", count=n)).view(np.int64)


#: Min-hash bands and the hashes in each: sets of similarity s agree in some band with probability 1 - (1 - s^5)^24.
BANDS, BAND_HASHES = 24, 5
_FACTORS = np.array([xxhash.xxh64_intdigest(b"factor", k) | 1 for k in range(BANDS * BAND_HASHES)], dtype=np.uint64)
_OFFSETS = np.array([xxhash.xxh64_intdigest(b"offset", k) for k in range(BANDS * BAND_HASHES)], dtype=np.uint64)


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """A key a band of the least hashes of a set from ``shingle_set``; zeros for the empty set."""
    x = shingles.view(np.uint64)
    if not len(x):
        return np.zeros(BANDS, np.int64)
    low = np.full(len(_FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(x), 1 << 12):
        np.minimum(low, (x[None, at : at + (1 << 12)] * _FACTORS[:, None] + _OFFSETS[:, None]).min(axis=1), out=low)
    return (low * _FACTORS[::-1]).reshape(BANDS, BAND_HASHES).sum(axis=1, dtype=np.uint64).view(np.int64)


def _banded(rows: DataFrame) -> DataFrame:
    """(band, key, ...) of each band of ``rows`` (keys, ...)."""
    return rows.select(*[c for c in rows.columns if c != "keys"], F.posexplode("keys").alias("band", "key"))


def band_star_links(classes: DataFrame, centres: int = 2) -> DataFrame:
    """(a, b): each class of ``classes`` (cls, keys) with ``centres`` centres of each of its band keys."""
    rows = _banded(classes.select("cls", "keys"))
    some = F.array_distinct(F.array(*[F.min_by("cls", F.xxhash64("cls", "band", F.lit(k))) for k in range(centres)]))
    chosen, _ = materialize(rows.groupBy("band", "key").agg(some.alias("c"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "centres")
    met = rows.join(chosen, ["band", "key"]).select("cls", F.explode("c").alias("c")).where("cls <> c")
    return met.select(F.least("cls", "c").alias("a"), F.greatest("cls", "c").alias("b")).distinct()


def mixed_bands(classes: DataFrame) -> DataFrame:
    """(band, key, cls, keys, group) of ``classes`` (cls, keys, group): the bands that classes of different groups share."""
    rows = classes.select("cls", "keys", "group", F.posexplode("keys").alias("band", "key"))
    found = rows.groupBy("band", "key").agg(F.min("group").alias("x"), F.max("group").alias("y")).where("x <> y").select("band", "key")
    mixed, _ = materialize(found, "mixed")
    return rows.join(mixed, ["band", "key"])


def alike(a: str, b: str, similarity: float) -> Column:
    """Whether two sets have so large a Jaccard similarity; sizes alone decide first."""
    x, y = F.size(a), F.size(b)
    shared = F.size(F.array_intersect(a, b))
    return (F.least(x, y) >= similarity * F.greatest(x, y)) & (shared >= similarity * (x + y - shared))


def band_links(left: DataFrame, held: DataFrame, similarity: float) -> DataFrame:
    """(src, dst): pairs of ``mixed_bands`` of different groups whose sets in ``held`` (cls, s) are similar.

    Sets are compared within the join, so candidates that fail make no row; a pair is compared in its first common band.
    """
    rows = left.join(held, "cls")
    x, y = (rows.select("band", "key", *[F.col(c).alias(c[0] + end) for c in ("cls", "group", "keys", "s")]) for end in ("a", "b"))
    first = F.array_position(F.zip_with("ka", "kb", lambda p, q: p == q), True) == x["band"] + 1
    near = (x["band"] == y["band"]) & (x["key"] == y["key"]) & (F.col("ca") < F.col("cb")) & (F.col("ga") != F.col("gb")) & first & alike("sa", "sb", similarity)
    return x.join(y, near).select(F.col("ca").alias("src"), F.col("cb").alias("dst"))


def components(docs: DataFrame, words: int = 3, radius: int = 6, parts: tuple[int, ...] = PARTS, similarity: float = 0.8, shingle: int = 5) -> DataFrame:
    """(doc_id, th, component): texts linked by a Jaccard similarity of their sets of ``shingle``-word shingles of at least
    ``similarity``.

    Candidates are the pairs with fingerprints of ``words``-word shingles within ``radius`` bits and those whose sets share a
    min-hash band. Texts with equal sets are one class. Candidates are verified in two turns: first a few for each
    fingerprint and band, with centres of the keys that it probes; then all candidates whose ends are still in different
    components, those of bands within their join. The components are those of all verified pairs, while a dense group costs a
    few rows for each class, not one for each pair. th is a hash of the text.
    """
    spark = docs.sparkSession
    ship(spark)

    @F.pandas_udf("struct<fp long, k1 long, k2 long, keys array<long>>")
    def describe(texts: pd.Series) -> pd.DataFrame:
        hold("described")
        rows = []
        for t in texts:
            found = shingle_set(t, shingle)
            s = found.tobytes()
            rows.append((_signed(fingerprint(t, words)), _signed(xxhash.xxh64_intdigest(s, 1)), _signed(xxhash.xxh64_intdigest(s, 2)), band_keys(found)))
        return pd.DataFrame(rows, columns=["fp", "k1", "k2", "keys"])

    @F.pandas_udf("array<long>")
    def sets(texts: pd.Series) -> pd.Series:
        hold("sets")
        return pd.Series([shingle_set(t, shingle) for t in texts])

    text = text_or_empty()
    th = F.xxhash64(text).alias("th")
    # A text is found again by its hash and that of its id, so that the copies of one text aren't all gathered for it.
    at = F.xxhash64("doc_id").alias("at")
    rows, _ = materialize(docs.select("doc_id", th, describe(text).alias("d")).select("doc_id", "th", "d.fp", F.struct("d.k1", "d.k2").alias("cls"), "d.keys"), "described")
    classes, _ = materialize(rows.groupBy("cls").agg(F.min(F.struct("fp", "th", at, "keys")).alias("m")).select("cls", "m.fp", "m.th", "m.at", "m.keys"), "sets")
    fps, _ = materialize(classes.groupBy("fp").agg(F.count(F.lit(1)).alias("n"), F.min("cls").alias("cls")), "fps")
    groups, thresholds = partition(fps.select("fp"), radius, parts)
    same = fps.where("n > 1").select(F.col("fp").alias("src"), F.col("fp").alias("dst"))
    ends = {x: classes.select(F.col("cls").alias(x), F.col("fp").alias(y)) for x, y in (("a", "src"), ("b", "dst"))}

    def sets_of(some: DataFrame) -> tuple[DataFrame, str]:
        """(cls, s) of the classes of ``some`` (cls)."""
        asked = classes.join(some.distinct(), "cls").select("cls", "th", "at")
        source = docs.select(th, at, text.alias("text")).join(asked, ["th", "at"]).dropDuplicates(["th", "at"])
        return materialize(source.select("cls", sets(F.col("text")).alias("s")), "shingles")

    def verified(pairs: DataFrame) -> DataFrame:
        """Those pairs of classes (a, b) whose sets are similar, as (src, dst)."""
        pairs, p_pairs = materialize(pairs.distinct(), "pairs")
        held, p_held = sets_of(pairs.select(F.col("a").alias("cls")).union(pairs.select("b")))
        x, y = held.select(F.col("cls").alias("a"), F.col("s").alias("sa")), held.select(F.col("cls").alias("b"), F.col("s").alias("sb"))
        out, _ = materialize(pairs.join(x, "a").join(y, "b").where(alike("sa", "sb", similarity)).select(F.col("a").alias("src"), F.col("b").alias("dst")), "links")
        remove(spark, p_pairs)
        remove(spark, p_held)
        return out

    def classes_of(found: DataFrame) -> DataFrame:
        """(a, b): classes of linked fingerprints (src, dst)."""
        pairs = found.join(ends["a"], "src").join(ends["b"], "dst").where((F.col("src") < F.col("dst")) | (F.col("a") < F.col("b")))
        return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))

    first = verified(classes_of(star_links(spread(fps.select("fp")), radius, groups, thresholds).unionByName(same)).union(band_star_links(classes)))
    so_far, _ = connected_components(first)
    # A fingerprint of several classes has no group of its own, so none of its candidates is left out.
    label = F.when(F.col("n") == 1, F.coalesce("component", "cls")["k1"])
    grouped = fps.join(so_far.select(F.col("node").alias("cls"), "component"), "cls", "left").select("fp", label.alias("group"))
    of_class = classes.join(so_far.select(F.col("node").alias("cls"), "component"), "cls", "left").select("cls", "keys", F.coalesce("component", "cls")["k1"].alias("group"))
    second = verified(classes_of(links(spread(grouped), radius, groups, thresholds)))
    left, p_left = materialize(mixed_bands(of_class), "bands")
    held, p_held = sets_of(left.select("cls"))
    third, _ = materialize(band_links(left, held, similarity), "links")
    for path in (p_left, p_held):
        remove(spark, path)
    labels, _ = connected_components(first.unionByName(second).unionByName(third))
    out = rows.join(labels.select(F.col("node").alias("cls"), "component"), "cls", "left")
    return out.select("doc_id", "th", F.coalesce("component", "cls").alias("component"))


def deduplicate(docs: DataFrame, **how: object) -> DataFrame:
    """docs with one row of each component of ``components``: that with the smallest doc_id, of equals the smallest text.

    A null doc_id comes last; of rows equal in doc_id and text one stays.
    """
    labelled, _ = materialize(components(docs, **how), "components")
    id_, th, key = unused(docs, "_id", "_th", "_key")
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col("th").alias("th"))
    best = labelled.groupBy("component").agg(F.min(order).alias("m")).select(F.col("m.doc_id").alias(id_), F.col("m.th").alias(th))
    keyed = docs.withColumn(key, F.xxhash64(text_or_empty()))
    kept = keyed.join(best, F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col(key) == F.col(th)), "left_semi")
    return kept.dropDuplicates(["doc_id", key]).drop(key)
