"""Pairs of intervals that overlap, without pairs of those that do not meet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from famloom.operators.graph import written

#: Rows of one key that are joined with all others of it by one task; keys of more are dealt to several.
HEAVY = 2_000


def dealt_pairs(rows: DataFrame, keys: list[str], name: str, heavy: int = HEAVY) -> DataFrame:
    """Pairs of rows equal in ``keys`` whose ids ``name`` ascend; the second one's other columns end in 2.

    Rows of a heavy key are dealt by their id to as many slices as it holds
    ``heavy`` rows, and meet copies of all rows of the key there, so no key is
    one task's; keys are counted first, and only heavy ones are copied.
    """
    counts = written(rows.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / heavy).cast("int").alias("__n")).where("__n > 1"), "heavy")
    sliced = rows.join(counts, keys, "left").withColumn("__n", F.coalesce("__n", F.lit(1)))
    one = sliced.withColumn("__s", F.pmod(F.xxhash64(name), "__n").cast("int")).drop("__n")
    two = sliced.withColumn("__s", F.explode(F.sequence(F.lit(0), F.col("__n") - 1))).drop("__n")
    two = two.select(*keys, "__s", *(F.col(c).alias(f"{c}2") for c in rows.columns if c not in keys))
    return one.join(two, [*keys, "__s"]).where(F.col(name) < F.col(f"{name}2")).drop("__s")


def overlapping(images: DataFrame, keys: list[str], name: str = "img_id", heavy: int = HEAVY) -> DataFrame:
    """Pairs of intervals [lb, rb] equal in ``keys`` that share more than a point, each once.

    Positions are cut into bins of twice the mean length; an interval goes into
    every bin that it touches (two and a half copies on average at most), and a
    pair counts in the bin where the later one begins.
    """
    c = F.col
    width = images.agg(F.ceil(2 * F.avg(c("rb") - c("lb"))).alias("w")).first()["w"] or 1
    at = lambda x: F.floor(x / F.lit(max(int(width), 1))).cast("long")
    dealt = images.where("rb > lb").withColumn("__bin", F.explode(F.sequence(at(c("lb")), at(c("rb")))))
    pairs = dealt_pairs(dealt, [*keys, "__bin"], name, heavy)
    return pairs.where((at(F.greatest("lb", "lb2")) == c("__bin")) & _meet()).drop("__bin")


def _meet() -> Column:
    return F.least("rb", "rb2") > F.greatest("lb", "lb2")
