"""Helpers shared by the operators of this package."""

from __future__ import annotations

import ctypes
import gc
import itertools
import math
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casekit.session import checkpoint_dir, cut_lineage

#: Largest table, in bytes as estimated by ``small_enough``, that an operator
#: broadcasts. Larger ones are joined by a shuffle.
BROADCAST_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below the cluster's shared ``spark.checkpoint.dir``."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a folder or file: a URI (file, hdfs, s3, gs) or a plain path."""
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


def small_batches(df: DataFrame, rows: int = 1000) -> DataFrame:
    """``df``, after limiting its session's Arrow batches to ``rows``: whole texts go to Python, and the default of 10,000
    of them would be held several times over in each worker."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name, "10000")) <= rows:
        conf.set(name, str(rows))
    return df


#: What tasks keep in their Python worker for the next task of their own kind.
WORKER_CACHES: dict[str, dict] = {}


def release_caches(keep: str = "") -> None:
    """Called in a task: drops what tasks of other operators left in this worker, which Spark reuses."""
    dropped = [c for name, c in WORKER_CACHES.items() if name != keep and c]
    for cache in dropped:
        cache.clear()
    if dropped:
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:  # hand free pages back where the C library can
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):
            pass


def _bytes_of(col: Column, kind: T.DataType) -> Column:
    """Bytes of a value, strings and nested values measured."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(col), F.lit(0)).cast("long") + 16
    if isinstance(kind, T.StructType):
        return sum((_bytes_of(col[f.name], f.dataType) for f in kind.fields), F.lit(16).cast("long"))
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, (T.StringType, T.BinaryType, T.StructType, T.ArrayType)):
            inner = F.aggregate(col, F.lit(0).cast("long"), lambda a, x: a + _bytes_of(x, kind.elementType))
        else:
            inner = F.size(col).cast("long") * 8
        return F.coalesce(inner, F.lit(0).cast("long")) + 24
    return F.lit(8).cast("long")


def maybe_broadcast(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if its measured bytes are at most ``limit``, else ``df`` for a shuffle join.
    ``df`` should be cheap to read (a checkpointed table)."""
    most = limit // 24  # no row takes less
    width = sum((_bytes_of(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), F.lit(16).cast("long"))
    rows, size = df.limit(most + 1).agg(F.count(F.lit(1)), F.sum(width)).first()
    return F.broadcast(df) if rows <= most and (size or 0) <= limit else df


def seeded(*cols: Column | str, seed: int = 0) -> Column:
    """Order key that depends on values and seed only, so that reruns agree."""
    return F.xxhash64(F.lit(seed), *cols)


def least_equal(similarity: float, coordinates: int) -> int:
    """Equal minwise values below which a pair is not compared: five standard deviations below
    the number expected at ``similarity``."""
    return max(0, int(similarity * coordinates - 5 * math.sqrt(coordinates * similarity * (1 - similarity))))


#: Row ids from here on stand for rows without an id of their own.
NO_ID = 1 << 62


def with_row_id(docs: DataFrame, name: str = "_row") -> DataFrame:
    """``docs`` with a long that tells its rows apart: the id where no other row has it, else a number from 2^62 on
    from id and text, so that rows without an id, or different texts under one id, are rows of their own."""
    ids = F.col("doc_id").cast("long")
    twice = cut_lineage(docs.groupBy(ids.alias("_twice")).agg(F.count("*").alias("_n")).where("_n > 1 AND _twice IS NOT NULL").select("_twice"))
    d = docs.join(maybe_broadcast(twice), ids == twice["_twice"], "left")
    own = F.lit(NO_ID) + F.pmod(F.xxhash64(ids, F.coalesce("text", F.lit(""))), F.lit(NO_ID))
    return d.withColumn(name, F.when(ids.isNull() | F.col("_twice").isNotNull(), own).otherwise(ids)).drop("_twice")


# ---- connected components ------------------------------------------------------
#: Edges that a task contracts at once.
PIECE_EDGES = 1 << 18


def smallest_reachable(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ids of the edges ``a, b``, and for each the smallest id that it reaches."""
    ids, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = place[: len(a)], place[len(a):]
    root = np.arange(len(ids))
    while len(a):
        x, y = root[a], root[b]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while len(deeper := np.flatnonzero(root[root] != root)):
            root[deeper] = root[root[deeper]]
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
    return ids, ids[root]


def _contracted(e: DataFrame, pieces: int, centres: bool) -> DataFrame:
    """``e(u, v)`` in ``pieces`` tasks, the edges that a task holds at once replaced by stars around their smallest
    ids; with ``centres`` these are linked with themselves."""

    def stars(held):
        u, v = smallest_reachable(*(np.concatenate([b.column(c).to_numpy() for b in held]) for c in ("u", "v")))
        keep = np.ones(len(u), bool) if centres else u != v
        return pa.RecordBatch.from_arrays([pa.array(u[keep]), pa.array(v[keep])], names=["u", "v"])

    def task(batches):
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= 2 * PIECE_EDGES:  # above what one task of all edges holds: a single piece is never cut
                yield stars(held)
                held, n = [], 0
        if n:
            yield stars(held)

    return cut_lineage(e.coalesce(pieces).mapInArrow(task, "u long, v long"))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected ``edges(a, b)`` (longs).

    Returns ``(id, component)``, component being the smallest id reachable, for
    every id that an edge to another id names. Tasks contract pieces of ``PIECE_EDGES`` edges to stars; while there
    are several pieces, large-star and small-star steps alternate until the edges are stars. Each step is two grouped
    minimums and joins, checkpointed, so hub ids need no list in one task
    and nothing reaches the driver but whether it is done. The number of tasks and of shuffles, and so of files, follows the edges.
    """
    e = cut_lineage(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")))
    while True:
        pieces = max(1, -(-e.count() // PIECE_EDGES))
        e = _contracted(e, pieces, pieces == 1)
        if pieces == 1:
            return e.select(F.col("u").alias("id"), F.col("v").alias("component"))
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = (both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where("u <> v").distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut_lineage(small.union(low.select("u", F.col("m").alias("v"))).distinct())
        # stars: an id is a centre or has exactly one
        ends = e.select(F.col("u").alias("x"), F.lit(1).alias("out"), F.lit(0).alias("in")).union(
            e.select("v", F.lit(0), F.lit(1)))
        if ends.groupBy("x").agg(F.sum("out").alias("o"), F.max("in").alias("i")).where("o > 1 OR o = 1 AND i = 1").isEmpty():
            break
    star = e.groupBy("u").agg(F.min("v").alias("component"))
    return star.select(F.col("u").alias("id"), "component").union(
        star.select(F.col("component").alias("id"), "component").distinct())


def link_components(rows: DataFrame, branch: Callable[[DataFrame, int], DataFrame],
                    verify: Callable[[DataFrame], DataFrame], small: int = 32,
                    ratio: float = 0.0) -> DataFrame | None:
    """Components of the verified links between ids that meet in a node.

    ``rows(node, id, size)`` says which ids meet, each at most once in a node; pairs whose smaller ``size``
    is below ``ratio`` of the larger can't be links. ``verify`` takes candidate pairs ``(a, b)`` with
    a < b, each once, and returns those that are links. Per node:

    * all ids in one component already: done, links inside change nothing;
    * at most ``small`` ids outside its largest component (three times as many with each level): each
      of them is compared with every id of the node in another component, so pairs grow
      linearly with the node;
    * else: every id is compared with one pivot, and ``branch(rows, level)``
      divides the node into smaller ones, where this repeats.

    A group of near copies of any size thus ends after one round of pivot links,
    without its pairs. Returns ``(id, component)`` for linked ids, None without any.
    """
    labels, level, seen = None, 0, None

    def pair(x: str, y: str) -> list[Column]:
        return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]

    def alike(x: str, y: str) -> Column:
        return F.least(x, y) >= ratio * F.greatest(x, y)

    while True:
        if labels is None:  # every id is a component
            r = rows.withColumn("comp", F.col("id"))
            nodes = (rows.groupBy("node").agg(F.count("*").alias("n"), F.min("id").alias("main")).where("n > 1")
                     .select("node", "main", (F.col("n") - 1 <= small).alias("small")))
        else:
            r = (rows.join(maybe_broadcast(labels.withColumnRenamed("component", "c")), "id", "left")
                 .select("node", "id", "size", F.coalesce("c", "id").alias("comp")))
            parts = r.groupBy("node", "comp").agg(F.count("*").alias("n"))
            nodes = (parts.groupBy("node")
                     .agg(F.sum("n").alias("n"), F.count("*").alias("k"), F.max(F.struct("n", "comp")).alias("top"))
                     .where("k > 1").select("node", F.col("top.comp").alias("main"),
                                            (F.col("n") - F.col("top.n") <= small).alias("small")))
        r = cut_lineage(r.join(nodes, "node"))
        met, large = r.agg(F.count("*"), F.bool_or(~F.col("small"))).first()
        if not met:
            return labels
        few, many = r.where("small"), r.where("NOT small")
        out = few.where("comp <> main").select("node", F.col("id").alias("o"), F.col("comp").alias("oc"),
                                               F.col("size").alias("osize"))
        # a pair outside the main component is met from both ends; distinct() below keeps it once
        pairs = few.join(out, "node").where((F.col("comp") != F.col("oc")) & alike("size", "osize")).select(
            *pair("id", "o"))
        if large:
            pivots = many.groupBy("node").agg(
                F.min_by(F.struct("id", "comp", "size"), seeded("node", "id")).alias("p"))
            pivots = pivots.select("node", F.col("p.id").alias("o"), F.col("p.comp").alias("oc"),
                                   F.col("p.size").alias("osize"))
            pairs = pairs.union(many.join(pivots, "node").where(
                (F.col("comp") != F.col("oc")) & alike("size", "osize")).select(*pair("id", "o")))
        pairs = pairs.distinct()
        if seen is not None:
            pairs = pairs.join(seen, ["a", "b"], "left_anti")
        pairs = cut_lineage(pairs)
        if not pairs.isEmpty():
            seen = pairs if seen is None else seen.union(pairs)
            new = cut_lineage(verify(pairs).select("a", "b"))
            if not new.isEmpty():
                known = new if labels is None else new.union(labels)
                labels = cut_lineage(components(known))
        if not large:
            return labels
        level, small = level + 1, 3 * small
        rows = branch(many.select("node", "id", "size"), level)


# ---- distributed rank --------------------------------------------------------
def global_rank(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """``df`` with its 0-based position in ``order``: range partitions are ranked on
    their own and shifted by the counts of the partitions before."""
    p = cut_lineage(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    shift = p.groupBy("_p").agg(F.count("*").alias("_n")).select(
        "_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    own = F.row_number().over(Window.partitionBy("_p").orderBy(*order)) - 1
    return (p.withColumn("_own", own).join(F.broadcast(shift), "_p")
            .withColumn(name, F.col("_shift") + F.col("_own")).drop("_p", "_own", "_shift"))


# ---- files written by tasks --------------------------------------------------
def write_parts(df: DataFrame, folder: str, suffix: str, write_part: Callable, summary: str) -> DataFrame:
    """One file per partition of ``df`` in ``folder``, through Arrow's file systems.

    ``write_part(out, batches)`` writes to the stream ``out`` and returns a tuple of values for the
    columns ``summary``. A file gets its final name when it is whole, so a lost or repeated task
    leaves no half file: a second attempt writes the same bytes again. Returns the checkpointed
    ``(part, path, <summary>)``, one row per nonempty partition.
    """
    fs, base = open_fs(folder)
    fs.create_dir(base, recursive=True)
    schema = f"part int, path string, {summary}"
    names = [c.split()[0] for c in schema.split(", ")]

    def task(batches):
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        here = TaskContext.get()
        fs, base = open_fs(folder)
        name = f"part-{here.partitionId():06d}{suffix}"
        draft = f"{base}/_{name}-{here.taskAttemptId()}"
        with fs.open_output_stream(draft) as out:
            values = write_part(out, itertools.chain([first], batches))
        fs.move(draft, f"{base}/{name}")
        row = (here.partitionId(), f"{folder}/{name}", *values)
        yield pa.RecordBatch.from_pylist([dict(zip(names, row))], schema=_arrow(schema))

    return cut_lineage(df.mapInArrow(task, schema))


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}
    return pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in ddl.split(", ")])


def one_task_each(manifest: DataFrame) -> DataFrame:
    """A manifest dealt so that (nearly) every file is read by a task of its own."""
    return manifest.repartitionByRange(max(1, manifest.count()), "part")
