"""Shared helpers: reading tables, shipping code, cutting lineage and connected components."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import io
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_SHIPPED: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bounds of the Arrow batches that Python workers get: rows, and bytes where long texts stand together.
ARROW_ROWS, ARROW_BYTES = 512, 16 << 20


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once an application, and bound the session's Arrow batches by rows and bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[1]
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"{root.name}/{p.relative_to(root)}")
    folder = tempfile.mkdtemp(prefix="ranklake-")  # the driver serves the file from here; no executor opens this path
    path = os.path.join(folder, "ranklake_code.zip")
    Path(path).write_bytes(buf.getvalue())
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)


_HELD: list[tuple[str, Callable[[], None] | None]] = []


def hold(owner: str, forget: Callable[[], None] | None = None) -> None:
    """Called at the start of each function in a Python worker: what another operator's tables hold there is given back.

    Workers serve one stage after the other, so tables that only grow would be held beside the next operator's.
    """
    if _HELD and _HELD[0][0] == owner:
        return
    if _HELD:
        if _HELD[0][1] is not None:
            _HELD[0][1]()
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # freed memory goes back where the C library can do that
            ctypes.CDLL(None).malloc_trim(0)
    _HELD[:] = [(owner, forget)]


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only where that is unset and all runs on this machine, as in tests."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found and sc.master.partition("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="ranklake-checkpoint-")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def materialize(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """Write to the shared folder and read back: lineage ends here, and lost executors lose nothing of it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/ranklake-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_drop_quietly, spark, path)
    return spark.read.schema(df.schema).parquet(path), path


def _drop_quietly(spark: SparkSession, path: str) -> None:
    try:
        if spark.sparkContext._jsc is not None:
            remove(spark, path)
    except Exception:  # noqa: BLE001  the application is already gone
        pass


def tokenizer_path(name: str) -> str:
    """Where the driver finds a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def tokenizer_pattern() -> str:
    """The expression that parts texts for the public rank files."""
    import public_tokenizers

    return public_tokenizers.PATTERN


def unused(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with as many underscores after it as it takes to differ from all columns of ``df`` in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def text_or_empty(c: str = "text") -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> tuple[DataFrame, list[str]]:
    """Components of undirected edges (src, dst), both of one orderable type.

    Returns (node, component) with the smallest node reachable, for nodes that have an edge to another node, and the paths
    written on the way that may be removed once the result has been used. Each round hooks every node to its smallest
    neighbour if that is smaller (partial minima are combined before the shuffle), follows the hooks to their roots, and
    contracts the edges: those inside one tree go, the rest join roots and come once. Trees at least halve in number with
    each round, and a dense group's edges go in the first. No row reaches the driver but whether any is left. Null ends and
    self-loops are ignored.
    """
    spark = edges.sparkSession
    clean = edges.where("src is not null and dst is not null and src <> dst")
    left, p_left = materialize(clean.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct(), "cc-edges")
    labels: DataFrame | None = None
    p_labels = ""
    for _ in range(max_rounds):
        both = left.select(F.col("src").alias("node"), F.col("dst").alias("near")).union(left.select("dst", "src"))
        roots, p_roots = materialize(both.groupBy("node").agg(F.min("near").alias("near")).select("node", F.least("node", "near").alias("root")), "cc-roots")
        for _ in range(max_rounds):
            above = roots.select(F.col("node").alias("root"), F.col("root").alias("higher"))
            jumped, p_jumped = materialize(roots.join(above, "root").select("node", F.col("higher").alias("root"), (F.col("higher") != F.col("root")).alias("moved")), "cc-roots")
            moved = not jumped.where("moved").isEmpty()
            remove(spark, p_roots)
            roots, p_roots = jumped.select("node", "root"), p_jumped
            if not moved:
                break
        if labels is None:
            labels, p_labels = roots.select("node", F.col("root").alias("component")), p_roots
        else:
            of = roots.select(F.col("node").alias("component"), "root")
            new, path = materialize(labels.join(of, "component", "left").select("node", F.coalesce("root", "component").alias("component")), "cc-labels")
            remove(spark, p_labels)
            labels, p_labels = new, path
        a, b = roots.select(F.col("node").alias("src"), F.col("root").alias("ra")), roots.select(F.col("node").alias("dst"), F.col("root").alias("rb"))
        apart = left.join(a, "src").join(b, "dst").where("ra <> rb").select(F.greatest("ra", "rb").alias("src"), F.least("ra", "rb").alias("dst")).distinct()
        rest, path = materialize(apart, "cc-edges")
        remove(spark, p_left)
        left, p_left = rest, path
        if left.isEmpty():
            break
    else:
        raise RuntimeError("the components did not settle")
    remove(spark, p_left)
    return labels, [p_labels]
