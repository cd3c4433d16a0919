"""Embedding near-duplicates through a pivot-permutation index.

Reference points (pivots) are distinct vectors of the table, from a bounded sample with the smallest hashes. Every vector
is described by its nearest pivots in order of nearness, and stored in inverted lists by pivot. Two vectors are candidates if
their descriptions share at least ``shared`` pivots; candidates are verified by their cosine in double precision. Since a
candidate pair shares ``shared`` pivots, it meets among the first ``nearest - shared + 1`` of both descriptions in order of
pivot number, so only those lists are kept; a pair is counted in the list of its smallest shared pivot and in no other.

Lists are cut into blocks of bounded size and each pair of blocks is one task, whatever a list's length. A task returns for
each vector its number of links in the pair of blocks and the smallest vector of its component there: no pair of vectors
leaves it. Equal vectors of one label are one class with a multiplicity; its copies are never compared.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and vectors with a null label,
link with nothing and are components of their own; rows are told apart by vec_id, rows equal in vec_id, label and vector count
as copies; a null vec_id never is a component's smallest unless all are null; only vectors of one length are compared; an
empty table gives an empty result; other columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ranklake.llm.common import connected_components, hold, materialize, ship

#: Vectors in a block of an inverted list.
BLOCK = 1024
#: Bytes of pivots that are sent to each task at most.
PIVOT_BYTES = 128 << 20
#: Cosine from which a vector is no new pivot.
TOO_CLOSE = 0.8


def classes(vectors: DataFrame) -> DataFrame:
    """(label, embedding, cls, copies) of distinct valid vectors; cls is a hash of label and vector."""
    clean = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    nonzero = F.exists("embedding", lambda x: x != 0)
    valid = vectors.where(F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(clean & nonzero)
    return valid.groupBy("label", "embedding").agg(F.count(F.lit(1)).alias("copies"))


def key() -> list:
    """Two hashes of label and vector: the key of a class."""
    return [F.xxhash64("label", "embedding").alias("k1"), F.xxhash64(F.lit(1), "label", "embedding").alias("k2")]


def choose_pivots(found: DataFrame, n: int) -> dict[int, np.ndarray]:
    """For each length of vectors at most ``n`` of unit norm, from a sample of 4n with the smallest hashes.

    A vector close to a pivot that was chosen before is passed over: otherwise a large group of near copies would supply many
    pivots, and its members would differ in which of these are nearest.
    """
    rows = found.select("embedding", F.xxhash64(F.lit(7), "embedding").alias("h")).orderBy("h", "embedding").limit(4 * n).collect()
    by: dict[int, list] = {}
    for r in rows:
        by.setdefault(len(r["embedding"]), []).append(r["embedding"])
    out = {}
    for d, v in by.items():
        x = np.array(v, dtype=np.float64)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        kept, m = np.empty((min(n, len(x)), d)), 0
        for row in x:
            if m < len(kept) and (m == 0 or (kept[:m] @ row).max() < TOO_CLOSE):
                kept[m] = row
                m += 1
        out[d] = kept[:m]
    return out


def describe(x: np.ndarray, pivots: np.ndarray, nearest: int) -> np.ndarray:
    """Numbers of the nearest pivots of each vector, nearest first."""
    k = min(nearest, len(pivots))
    near = -(x / np.linalg.norm(x, axis=1, keepdims=True)) @ pivots.T
    top = np.argpartition(near, k - 1, axis=1)[:, :k]
    order = np.argsort(np.take_along_axis(near, top, axis=1), axis=1, kind="stable")
    return np.take_along_axis(top, order, axis=1)


def link_block(a: pd.DataFrame, b: pd.DataFrame, same: bool, pivot: int, threshold: float, shared: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i in a, j in b) of linked pairs whose smallest shared pivot is ``pivot``."""
    va, vb = (np.stack(x["embedding"].to_numpy()).astype(np.float64) for x in (a, b))
    da, db = (np.stack(x["near"].to_numpy()) for x in (a, b))
    na, nb = np.linalg.norm(va, axis=1), np.linalg.norm(vb, axis=1)
    used, inverse = np.unique(np.concatenate([da.ravel(), db.ravel()]), return_inverse=True)
    hot_a, hot_b = np.zeros((len(da), len(used)), np.float32), np.zeros((len(db), len(used)), np.float32)
    hot_a[np.arange(len(da))[:, None], inverse[: da.size].reshape(da.shape)] = 1
    hot_b[np.arange(len(db))[:, None], inverse[da.size :].reshape(db.shape)] = 1
    below = int(np.searchsorted(used, pivot))  # pivots before it: a pair that shares one meets elsewhere
    counts = hot_a @ hot_b.T
    candidates = counts >= min(shared, da.shape[1])
    if below:
        candidates &= hot_a[:, :below] @ hot_b[:, :below].T == 0
    if same:
        candidates &= np.tri(len(a), dtype=bool).T & ~np.eye(len(a), dtype=bool)
    i, j = np.nonzero(candidates)
    keep = []
    for at in range(0, len(i), 1 << 16):
        x, y = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
        keep.append(np.einsum("nd,nd->n", va[x], vb[y]) / (na[x] * nb[y]) >= threshold)
    ok = np.concatenate(keep) if keep else np.zeros(0, bool)
    return i[ok], j[ok]


def settle(n: int, i: np.ndarray, j: np.ndarray, keys: list) -> np.ndarray:
    """For nodes 0..n-1 with links (i, j) the position of the node with the smallest key reachable."""
    order = np.array(sorted(range(n), key=keys.__getitem__))
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    low = rank.copy()
    while True:
        was = low.copy()
        m = np.minimum(low[i], low[j])
        np.minimum.at(low, i, m)
        np.minimum.at(low, j, m)
        low = np.minimum(low, low[order[low]])
        if (low == was).all():
            return order[low]


def linked(found: DataFrame, threshold: float, n_pivots: int, nearest: int, shared: int) -> DataFrame:
    """(k1, k2, n, r1, r2): links of each class in one pair of blocks, and the smallest class it reaches there."""
    spark = found.sparkSession
    pivots = spark.sparkContext.broadcast(choose_pivots(found, n_pivots))  # n_pivots vectors at most
    lists = nearest - shared + 1

    def post(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hold("pivots")
        for b in batches:
            sizes = b["embedding"].map(len)
            for d, part in b.groupby(sizes):
                if d in pivots.value:
                    near = describe(np.stack(part["embedding"].to_numpy()).astype(np.float64), pivots.value[d], nearest)
                else:  # a rare length without a pivot: one list, in which all meet
                    near = np.zeros((len(part), 1), np.int64)
                kept = np.sort(near, axis=1)[:, : max(1, min(lists, near.shape[1]))]
                at = np.repeat(np.arange(len(part)), kept.shape[1])
                out = part.iloc[at].copy()
                out["near"] = [near[k].astype(np.int32) for k in at]
                out["dim"], out["pivot"] = np.int32(d), kept.ravel().astype(np.int32)
                yield out[["label", "dim", "pivot", "k1", "k2", "copies", "embedding", "near"]]

    label = found.schema["label"].dataType.simpleString()
    vector = found.schema["embedding"].dataType.simpleString()
    schema = f"label {label}, dim int, pivot int, k1 long, k2 long, copies long, embedding {vector}, near array<int>"
    postings, _ = materialize(found.select("label", "embedding", "k1", "k2", "copies").mapInPandas(post, schema), "postings")
    counted = postings.groupBy("label", "dim", "pivot").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    blocks, _ = materialize(counted, "blocks")  # so that the join reads two plain shuffles, and a long list can be split
    of = ["label", "dim", "pivot"]
    dealt = postings.join(blocks, of).withColumn("block", F.pmod("k1", F.col("blocks")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.struct(F.least(x, F.col("block")).alias("a"), F.greatest(x, F.col("block")).alias("b")))
    dealt = dealt.withColumn("p", F.explode(pairs)).select(*of, "p.a", "p.b", "block", "k1", "k2", "copies", "embedding", "near")

    def verify(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.iloc[0]
        same = first["a"] == first["b"]
        x = pdf[pdf["block"] == first["a"]].reset_index(drop=True)
        y = x if same else pdf[pdf["block"] == first["b"]].reset_index(drop=True)
        none = pd.DataFrame({c: np.zeros(0, np.int64) for c in ("k1", "k2", "n", "r1", "r2")})
        if not len(x) or not len(y):
            return none
        i, j = link_block(x, y, same, int(first["pivot"]), threshold, shared)
        if not len(i):
            return none
        rows = x if same else pd.concat([x, y], ignore_index=True)
        j = j if same else j + len(x)
        copies = rows["copies"].to_numpy()
        n = np.bincount(i, weights=copies[j], minlength=len(rows)) + np.bincount(j, weights=copies[i], minlength=len(rows))
        k1, k2 = rows["k1"].to_numpy(), rows["k2"].to_numpy()
        root = settle(len(rows), i, j, list(zip(k1.tolist(), k2.tolist(), strict=True)))
        at = np.flatnonzero(n > 0)
        return pd.DataFrame({"k1": k1[at], "k2": k2[at], "n": n[at].astype(np.int64), "r1": k1[root[at]], "r2": k2[root[at]]})

    return dealt.groupBy(*of, "a", "b").applyInPandas(verify, "k1 long, k2 long, n long, r1 long, r2 long")


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, n_pivots: int | None = None, nearest: int = 10, shared: int = 3) -> DataFrame:
    """(vec_id, n_links, component_id, kept, copies) for each row of ``vectors`` (vec_id, embedding, label).

    ``n_pivots`` is twice the root of the number of classes by default, 64 at least, so lists grow as that root does; but no more
    than PIVOT_BYTES hold, and from there on lists have more blocks.
    """
    ship(vectors.sparkSession)
    found, _ = materialize(classes(vectors).select("*", *key()), "classes")
    count = found.count()
    longest = found.agg(F.max(F.size("embedding"))).first()[0] or 1
    pivots = n_pivots or max(64, min(2 * isqrt(count), PIVOT_BYTES // (8 * longest)))
    links, _ = materialize(linked(found, threshold, pivots, nearest, shared), "links")
    node, root = F.struct("k1", "k2"), F.struct(F.col("r1").alias("k1"), F.col("r2").alias("k2"))
    groups, _ = connected_components(links.select(node.alias("src"), root.alias("dst")).distinct())
    total = links.groupBy("k1", "k2").agg(F.sum("n").alias("n"))
    stats = (
        found.select("k1", "k2", "copies", node.alias("node"))
        .join(total, ["k1", "k2"], "left")
        .join(groups, "node", "left")
        .select("node", F.coalesce("component", "node").alias("component"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"), "copies")
    )
    clean = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    valid = F.col("label").isNotNull() & F.col("embedding").isNotNull() & clean & F.exists("embedding", lambda x: x != 0)
    rows = vectors.select("vec_id", F.when(valid, F.struct(*key())).alias("node"))
    smallest = rows.where("node is not null").groupBy("node").agg(F.min("vec_id").alias("least"))
    ids, _ = materialize(smallest.join(stats, "node").groupBy("component").agg(F.min("least").alias("component_id")), "ids")
    of_node = stats.join(ids, "component").select("node", "n", "component_id", "copies")
    out = rows.join(of_node, "node", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select(
        "vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"), F.coalesce("copies", F.lit(1)).alias("copies")
    )
