"""Families: what can be reached along primary edges, in breadth-first order and with orientation."""

from __future__ import annotations

from collections import deque

from pyspark.sql import DataFrame, Window, functions as F, types as T

from famloom.operators.edges import is_primary
from famloom.operators.groups import map_groups
from famloom.operators.graph import least_ancestors, numbered, written


def family_roots(elements: DataFrame, owned: DataFrame) -> DataFrame:
    """(ele_id, root): the smallest element from which each can be reached.  ``owned``: edges by owner."""
    links = owned.where(is_primary()).select(F.col("owner").alias("u"), F.col("other").alias("v"))
    out = least_ancestors(elements.select(F.col("ele_id").alias("node")), links)
    return out.select(F.col("node").alias("ele_id"), "root")


def family_numbers(roots: DataFrame) -> DataFrame:
    """(root, fam, copies): families numbered from 1 by root."""
    return numbered(roots.groupBy("root").agg(F.count(F.lit(1)).alias("copies")), "root", "fam", 1)


_MEMBER = T.StructType([T.StructField("root", T.LongType()), T.StructField("ele_id", T.LongType()), T.StructField("pos", T.LongType()), T.StructField("dir", T.IntegerType())])


def _walk(rows: list[dict]) -> list[tuple]:
    """Breadth-first order and orientation of one family; rows are its edges, sorted by number."""
    root = rows[0]["root"]
    out: dict[int, list[tuple[int, int]]] = {}
    for r in rows:
        out.setdefault(r["owner"], []).append((r["other"], r["direction"]))
    seen, queue = {root: 1}, deque([root])
    while queue:
        u = queue.popleft()
        for v, d in out.get(u, ()):
            if v not in seen:
                seen[v] = seen[u] * d
                queue.append(v)
    return [(root, e, k, d) for k, (e, d) in enumerate(seen.items())]


def members(roots: DataFrame, owned: DataFrame, largest: int = 5_000) -> DataFrame:
    """(root, ele_id, pos, dir): place in the family's breadth-first queue and orientation relative to its root.

    Families of up to ``largest`` edges are walked one in a task; larger ones level by level as joins.
    """
    links = owned.where(is_primary()).join(roots.select(F.col("ele_id").alias("owner"), "root"), "owner").select("root", "owner", "other", "edge_id", "direction")
    sizes = links.groupBy("root").agg(F.count(F.lit(1)).alias("n"))
    big = sizes.where(F.col("n") > largest).select("root")
    alone = roots.where("ele_id = root").join(sizes, "root", "left_anti").select("root", "ele_id", F.lit(0).cast("long").alias("pos"), F.lit(1).alias("dir"))
    small = links.join(sizes.where(F.col("n") <= largest).select("root"), "root", "left_semi")
    out = alone.unionByName(map_groups(small, ["root"], ["edge_id"], _walk, _MEMBER))
    if big.limit(1).count():
        out = out.unionByName(_levels(written(links.join(big, "root", "left_semi")), big))
    return out


def _levels(links: DataFrame, big: DataFrame) -> DataFrame:
    front = written(big.select("root", F.col("root").alias("ele_id"), F.lit(0).cast("long").alias("pos"), F.lit(1).alias("dir")))
    done = front
    while True:
        step = front.join(links.select("root", F.col("owner").alias("ele_id"), "other", "edge_id", "direction"), ["root", "ele_id"])
        step = step.join(done.select("root", F.col("ele_id").alias("other")), ["root", "other"], "left_anti")
        best = step.groupBy("root", "other").agg(F.min(F.struct("pos", "edge_id", (F.col("dir") * F.col("direction")).alias("dir"))).alias("b"))
        start = done.groupBy("root").agg((F.max("pos") + 1).alias("next"))
        placed = best.join(start, "root").select("root", F.col("other").alias("ele_id"), (F.row_number().over(Window.partitionBy("root").orderBy("b.pos", "b.edge_id")) - 1 + F.col("next")).cast("long").alias("pos"), F.col("b.dir").cast("int").alias("dir"))
        front = written(placed)
        if not front.limit(1).count():
            return done
        done = written(done.unionByName(front))
