"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from famloom.operators.graph import forget, partitions, scratch_dir, written as materialise

__all__ = ["arrow_batches", "ascii_lower", "forget", "fresh", "materialise", "partitions", "ranked", "scratch_dir"]

#: Bounds of one Arrow batch handed to a Python worker: rows and bytes.
ARROW_ROWS, ARROW_BYTES = 1000, 4 << 20


def arrow_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small, so that very long texts do not pile up in a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` has not (in any case of letters)."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z alone."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def ranked(df: DataFrame, order: list[Column], group: str | None, name: str) -> DataFrame:
    """``df`` with its rank from 0 (within ``group``, a non-null column that leads ``order``) as long ``name``.

    Range partitions hold ``order``; a row's place in its partition comes from
    monotonically_increasing_id, and what precedes each (partition, group) from
    a table of one row for each of them (partitions + groups at most, as the
    partitions are ranges).  No window runs over a whole group.  Rows with equal
    ``order`` must be told apart by it, or they stay in one task.
    """
    spark = df.sparkSession
    at, part, row = f"__{name}_at", f"__{name}_part", f"__{name}_row"
    n = partitions(spark)
    placed = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id())
    placed = materialise(placed, f"rank-{name}")
    placed = placed.withColumns({part: F.shiftright(at, 33).cast("int"), row: F.col(at).bitwiseAND(F.lit((1 << 33) - 1))})
    keys = [part] + ([group] if group else [])
    count, first = f"__{name}_count", f"__{name}_first"
    counted = placed.groupBy(*keys).agg(F.count(F.lit(1)).alias(count), F.min(row).alias(first)).collect()
    counted.sort(key=lambda r: (r[part], r[first]))
    so_far: dict = {}
    bases = []
    for r in counted:
        g = r[group] if group else None
        bases.append((*(r[k] for k in keys), so_far.get(g, 0) - r[first]))
        so_far[g] = so_far.get(g, 0) + r[count]
    base = f"__{name}_base"
    types = dict(placed.dtypes)
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + f", `{base}` long"
    bases = spark.createDataFrame(bases, schema)
    return placed.join(F.broadcast(bases), keys, "inner").withColumn(name, F.col(row) + F.col(base)).drop(at, part, row, base)

