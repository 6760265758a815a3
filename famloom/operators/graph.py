"""Connected components and reachability as DataFrame loops."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window, functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset a local session gets a folder of its own; a cluster does
    not, as its executors could not read each other's files there.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="famloom-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def scratch_dir(spark: SparkSession) -> str:
    """Where this application's intermediate tables lie; ``clean`` removes it."""
    return f"{shared_dir(spark)}/famloom/{spark.sparkContext.applicationId}"


#: Spark's setting by which an execution's shuffle files are removed when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, what: str = "step") -> DataFrame:
    """``df`` written once to the shared folder and read back: cuts lineage, and survives lost executors.

    Shuffle files go as soon as the table is written; left alone they would pile
    up over the rounds of a loop until the driver collects garbage.
    """
    spark, path = df.sparkSession, f"{scratch_dir(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def _remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def forget(*tables: DataFrame | None) -> None:
    """Remove what ``written`` wrote, once nothing reads it any more."""
    for t in tables:
        if t is not None and getattr(t, "written_at", None):
            _remove(t.sparkSession, t.written_at)


def clean(spark: SparkSession) -> None:
    """Remove all intermediate tables of this application; results that still read them must have been saved."""
    _remove(spark, scratch_dir(spark))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def running(df: DataFrame, order: list[str], value: Column, name: str, first: int = 0) -> DataFrame:
    """``df`` with the sum of ``value`` (whole numbers) over the rows before each one as long ``name``, from ``first``; ``order`` is unique.

    Rows are sorted in range partitions, which are written, as their borders
    differ from one evaluation to the next; what precedes each partition is a
    table of one row for each.  No window runs over the whole table.
    """
    spark, at, part, one = df.sparkSession, f"__{name}_at", f"__{name}_part", f"__{name}_one"
    placed = df.withColumn(one, value.cast("long")).repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id())
    placed = written(placed, "ordered").withColumn(part, F.shiftright(at, 33))
    sums = {r[part]: r["n"] for r in placed.groupBy(part).agg(F.sum(one).alias("n")).collect()}
    before, total = [], first
    for k in sorted(sums):
        before.append((k, total))
        total += sums[k]
    base = f"__{name}_base"
    so_far = F.sum(one).over(Window.partitionBy(part).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)) - F.col(one)
    bases = spark.createDataFrame(before, f"`{part}` long, `{base}` long")
    return placed.withColumn(name, so_far).join(F.broadcast(bases), part).withColumn(name, F.col(name) + F.col(base)).drop(at, part, one, base)


def numbered(df: DataFrame, order: str | list[str], name: str, first: int = 0) -> DataFrame:
    """``df`` with a dense long ``name`` from ``first`` by ``order``, which is unique."""
    return running(df, [order] if isinstance(order, str) else order, F.lit(1), name, first)


def least_ancestors(nodes: DataFrame, edges: DataFrame, directed: bool = True) -> DataFrame:
    """(node, root): the smallest node from which each node can be reached along edges (u, v); itself included.

    Edges that run both ways join nodes that reach each other: these are contracted first, in few rounds whatever their
    paths' lengths (see components).  Only what is left of one-way edges is walked,
    in rounds that take the smallest label of a node's predecessors and then the
    label of its label.
    """
    edges = edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).where("u != v")
    nodes = nodes.select(F.col("node").cast("long").alias("node")).distinct()
    if not directed:
        return _labelled(nodes, components(edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()))
    ways = F.struct(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).alias("pair")
    pairs = edges.distinct().groupBy(ways).agg(F.count(F.lit(1)).alias("n"), F.min("u").alias("u"), F.min("v").alias("v"))
    pairs = written(pairs, "ways")
    one_way = pairs.where("n = 1").select("u", "v")
    found = _labelled(nodes, components(pairs.where("n = 2").select("pair.a", "pair.b").toDF("u", "v")))
    if not one_way.limit(1).count():
        return found
    found = written(found, "contracted")
    ends = [found.select(F.col("node").alias(c), F.col("root").alias(f"{c}2")).hint("merge") for c in ("u", "v")]
    between = written(one_way.join(ends[0], "u").join(ends[1], "v").select(F.col("u2").alias("u"), F.col("v2").alias("v")).where("u != v").distinct(), "between")
    above = _walked(between)
    out = found.join(above.select(F.col("node").alias("root"), F.col("root").alias("least")).hint("merge"), "root", "left")
    return out.select("node", F.coalesce("least", "root").alias("root"))


def _labelled(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    return nodes.join(labels.hint("merge"), "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def _walked(edges: DataFrame) -> DataFrame:
    """(node, root) of the nodes with edges (u, v), by rounds along one-way edges; only nodes whose label fell tell their followers."""
    labels = written(edges.select(F.col("u").alias("node")).union(edges.select("v")).distinct().withColumn("root", F.col("node")).withColumn("moved", F.lit(True)))
    while True:
        told = labels.where("moved").select(F.col("node").alias("u"), F.col("root").alias("r"))
        came = edges.join(told.hint("merge"), "u").groupBy(F.col("v").alias("node")).agg(F.min("r").alias("r"))
        hooked = labels.join(came.hint("merge"), "node", "left").select("node", "root", F.least("root", "r").alias("now"))
        up = hooked.select(F.col("node").alias("now"), F.col("now").alias("above"))
        after = hooked.join(up.hint("merge"), "now", "left").select("node", F.least("now", "above").alias("to"), (F.least("now", "above") != F.col("root")).alias("moved"))
        moved, old = Observation(), labels
        labels = written(after.select("node", F.col("to").alias("root"), "moved").observe(moved, F.max("moved").alias("any")))
        more = moved.get["any"]
        forget(old)
        if not more:
            return labels.select("node", "root")


#: Edges of a range partition of a local pass; as many in all are finished by one task.
RANGE = 250_000


def local_roots(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, the smallest node that each is connected with) of edges (u, v) held in memory."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b, root = at[: len(u)], at[len(u) :], np.arange(len(nodes))
    while len(a):
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := root[root], root):
            root = up
        a, b = root[a], root[b]
        a, b = a[a != b], b[a != b]
    return nodes, nodes[root]


def _range_roots(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    held = [(b.column("u").to_numpy(), b.column("v").to_numpy()) for b in batches if len(b)]
    if held:
        nodes, roots = local_roots(*(np.concatenate(x) for x in zip(*held, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(roots)], ["node", "root"])


def _contracted(edges: DataFrame, n: int) -> tuple[DataFrame, DataFrame, int]:
    """(labels, edges between labels, their number): the components inside ranges of the ``n`` edges, each range in one task.

    A node of several ranges takes the smallest of its roots, and edges between its roots are left.
    """
    ranges = -(-n // RANGE)
    dealt = edges.select("u", "v").coalesce(1) if ranges == 1 else edges.select("u", "v").repartitionByRange(ranges, "u", "v")
    found = written(dealt.mapInArrow(_range_roots, "node long, root long"), "ranges")
    if ranges == 1:
        return found, None, 0
    labels = written(found.groupBy("node").agg(F.min("root").alias("root"), F.collect_set("root").alias("roots")), "labels")
    forget(found)
    between = labels.where(F.size("roots") > 1).select(F.col("root").alias("u"), F.explode("roots").alias("v")).where("u != v").distinct()
    count = Observation()
    left = written(between.observe(count, F.count(F.lit(1)).alias("n")), "edges")
    return labels, left, count.get["n"]


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each component, for nodes with edges (u, v).

    First every range of the edges is contracted by a task of its own; what is
    left are edges between the roots of a node that lies in several ranges, and
    few enough are finished by one task.  Where ranges do not contract, a round
    of joins follows (see _hooked), so that each round halves the edges or the
    nodes that are left but for local minima.  Joins are by sort and merge, so that
    adaptive execution may split the label of a giant component, and nothing that
    grows is broadcast.  Tables of past rounds are removed.
    """
    count = Observation()
    edges = edges.where("u != v").select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"))
    edges = written(edges.observe(count, F.count(F.lit(1)).alias("n")), "edges")
    n, labels = count.get["n"], None
    while n or labels is None:
        found, left, after = _contracted(edges, max(n, 1))
        labels, old = _relabelled(labels, found), edges
        forget(old)
        if 2 * after > n:
            hooks, joined, after = _hooked(left)
            labels = _relabelled(labels, hooks)
            forget(left)
            left = joined
        edges, n = left, after
    forget(edges)
    return labels.select("node", "root")


def _relabelled(labels: DataFrame | None, step: DataFrame) -> DataFrame:
    """``labels`` followed by ``step`` (node, root), which is removed."""
    if labels is None:
        return step
    out = written(labels.join(step.select(F.col("node").alias("root"), F.col("root").alias("to")).hint("merge"), "root", "left").select("node", F.coalesce("to", "root").alias("root")), "labels")
    forget(labels, step)
    return out


def _hooked(edges: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """(labels, edges between labels, their number) of a round over all edges: every node hooks to its smallest neighbour if that is smaller, and chains are cut short by pointer jumping."""
    both = edges.union(edges.select("v", "u"))
    hooks = written(both.groupBy("u").agg(F.min("v").alias("to")).select(F.col("u").alias("node"), F.least("u", "to").alias("to")), "hooks")
    while True:
        # Twice before it is written: to the hook of a hook's hook.
        jump = hooks.select(F.col("node").alias("to"), F.col("to").alias("further")).hint("merge")
        again = jump.select(F.col("to").alias("further"), F.col("further").alias("last"))
        after = hooks.join(jump, "to", "left").join(again, "further", "left").select("node", F.coalesce("last", "further", "to").alias("to"), (F.coalesce("last", "further", "to") != F.col("to")).alias("moved"))
        moved, old = Observation(), hooks
        hooks = written(after.observe(moved, F.max("moved").alias("any")), "hooks")
        more = moved.get["any"]
        forget(old)
        if not more:
            break
    a, b = hooks.select(F.col("node").alias("u"), F.col("to").alias("u2")).hint("merge"), hooks.select(F.col("node").alias("v"), F.col("to").alias("v2")).hint("merge")
    drawn = edges.join(a, "u", "left").join(b, "v", "left").select(F.coalesce("u2", "u").alias("u"), F.coalesce("v2", "v").alias("v")).where("u != v").distinct()
    count = Observation()
    left = written(drawn.observe(count, F.count(F.lit(1)).alias("n")), "edges")
    out = hooks.withColumnRenamed("to", "root")
    out.written_at = hooks.written_at
    return out, left, count.get["n"]
