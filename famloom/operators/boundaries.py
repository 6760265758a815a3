"""Votes on where elements begin and end, and splitting of images there (stage 2)."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window, functions as F

from famloom.functions.segments import cut, facing, partner_ends
from famloom.operators.groups import map_rows


def votes(primary: DataFrame) -> DataFrame:
    """(ele_id, cp, contributor): each primary image pair votes its four ends, two for each element.

    ``primary``: ele_id, lb, rb, p_ele, p_lb, p_rb, a row for each pair of images.
    """
    v = lambda e, c, o: F.struct(F.col(e).alias("ele_id"), F.col(c).alias("cp"), F.col(o).alias("contributor"))
    all_four = F.array(v("ele_id", "lb", "p_ele"), v("ele_id", "rb", "p_ele"), v("p_ele", "p_lb", "ele_id"), v("p_ele", "p_rb", "ele_id"))
    return primary.select(F.explode(all_four).alias("v")).select("v.*")


def without_contributor(all_votes: DataFrame, dismissed: DataFrame) -> DataFrame:
    """Votes but those that dismissed elements gave."""
    return all_votes.join(dismissed.select(F.col("ele_id").alias("contributor")), "contributor", "left_anti").select("ele_id", "cp", "contributor")


def cluster_points(points: list[int], width: int = 20, step: int = 10, ends: bool = True) -> list[tuple[int, int]]:
    """(boundary, support) of sorted points, in the order clusters are found.

    A cluster grows while a point is within ``width`` of its first and ``step`` of
    its last.  Where width ends it, the next starts at the point that did; where a
    gap does, its tail without the first point is clustered once more, and so on;
    the last cluster of all is not.  ``ends``: whether no point follows these.
    """
    out, begin, n = [], 0, len(points)
    before = [0, *accumulate(points)]
    while begin < n:
        first = last = points[begin]
        k = begin + 1
        while k < n and points[k] - first <= width and points[k] - last <= step:
            last = points[k]
            k += 1
        whole = k == n and ends
        by_width = k < n and points[k] - last <= step
        # Its tails end where it does.
        for j in range(begin, begin + 1 if whole or by_width else k):
            many = k - j
            out.append((points[j] + (before[k] - before[j] - many * points[j]) // many, many))
        begin = k
    return out


def _runs(rows: DataFrame, at: str, step: int, value: Column) -> DataFrame:
    """ele_id, run, points (sorted array of ``value``), ends (whether it is the element's last run): an element's rows cut wherever ``at`` goes on by more than ``step``.

    Windows run inside an element, over narrow rows that spill; only a run is an array.
    """
    by = Window.partitionBy("ele_id").orderBy(at)
    marked = rows.withColumns({"__cut": F.coalesce((F.col(at) - F.lag(at).over(by) > step).cast("int"), F.lit(0)), "__end": F.lead(at).over(by).isNull()})
    marked = marked.withColumn("run", F.sum("__cut").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy("ele_id", "run").agg(F.sort_array(F.collect_list(value)).alias("points"), F.max("__end").alias("ends"))


def point_clusters(all_votes: DataFrame, width: int = 20, step: int = 10) -> DataFrame:
    """(ele_id, bd, support) from votes; no cluster reaches over a gap of more than ``step``."""
    rows = _runs(all_votes.select("ele_id", "cp"), "cp", step, F.col("cp")).select("ele_id", "points", "ends")

    def run(row: tuple) -> list[tuple]:
        return [(row[0], bd, support) for bd, support in cluster_points(row[1], width, step, row[2])]

    return map_rows(rows, run, f"ele_id {dict(rows.dtypes)['ele_id']}, bd int, support int")


def spans(bounds: DataFrame, imgs: DataFrame, factor: int = 2, margin: int = 10) -> DataFrame:
    """``bounds`` with ``span``: ``factor`` for each image of the element that reaches ``margin`` beyond the boundary on both sides.

    No boundary meets an image: of images long enough, those that begin by
    ``bd - margin`` less those that end by ``bd + margin`` reach over ``bd``, so one
    running sum over starts, ends and boundaries in order counts them all.
    """
    long = imgs.where(F.col("rb") - F.col("lb") > 2 * margin)
    turn = lambda at, by: F.struct(at.cast("long").alias("at"), F.lit(by).alias("by"))
    turns = long.select("ele_id", F.explode(F.array(turn(F.col("lb") + margin, 1), turn(F.col("rb") - margin, -1))).alias("t")).select("ele_id", "t.at", "t.by")
    turns = turns.groupBy("ele_id", "at").agg(F.sum("by").alias("by"))
    asked = bounds.select("ele_id", F.col("bd").cast("long").alias("at")).distinct().withColumn("by", F.lit(None).cast("long"))
    # Starts and ends at a boundary's own place come before it.
    so_far = Window.partitionBy("ele_id").orderBy("at", F.col("by").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    counted = turns.unionByName(asked).withColumn("n", F.coalesce(F.sum("by").over(so_far), F.lit(0))).where("by is null")
    counted = counted.select("ele_id", F.col("at").cast(dict(bounds.dtypes)["bd"]).alias("bd"), (F.col("n") * factor).alias("span"))
    return bounds.join(counted, ["ele_id", "bd"])


def promoted(spanned: DataFrame) -> DataFrame:
    """Boundaries with support enough."""
    return spanned.where("support >= span").drop("span")


def merged(bounds: DataFrame, distance: int = 10) -> DataFrame:
    """Boundaries of each element, those within ``distance`` made one; nothing is compared over a wider gap."""
    one = F.struct(F.col("bd").cast("int").alias("bd"), F.col("support").cast("int").alias("support"))
    # Ties on bd: the stronger is found last and wins, as it does in any order.
    rows = _runs(bounds.select("ele_id", "bd", "support"), "bd", distance, one).select("ele_id", "points.bd", "points.support")

    def run(row: tuple) -> list[tuple]:
        return [(row[0], bd, support) for bd, support in merge_points(list(zip(row[1], row[2], strict=True)), distance)]

    return map_rows(rows, run, f"ele_id {dict(rows.dtypes)['ele_id']}, bd int, support int")


def merge_points(bounds: list[tuple[int, int]], distance: int = 10) -> list[tuple[int, int]]:
    """``merged`` for one element's sorted (bd, support)."""
    out: list[tuple[int, int]] = []
    for b in bounds:
        if out and b[0] - out[-1][0] <= distance:
            if out[-1][1] < b[1]:
                out[-1] = b
        else:
            out.append(b)
    return out


def interior(bounds: DataFrame, extents: DataFrame, margin: int = 10) -> DataFrame:
    """Boundaries more than ``margin`` from both ends of their element."""
    return bounds.join(extents.select("ele_id", "lb", "rb"), "ele_id").where((F.col("bd") - F.col("lb") > margin) & (F.col("bd") - F.col("rb") < -margin)).select("ele_id", "bd", "support")


def snapped(extents: DataFrame, bounds: DataFrame, margin: int = 10) -> DataFrame:
    """Extents of elements without interior boundaries, ends moved to boundaries, in order, near them."""
    inner = interior(bounds, extents, margin).select("ele_id").distinct()
    rows = bounds.groupBy("ele_id").agg(F.sort_array(F.collect_list(F.col("bd").cast("int"))).alias("b"))
    start = F.struct(F.col("lb").cast("int").alias("lb"), F.col("rb").cast("int").alias("rb"))

    def step(acc: Column, x: Column) -> Column:
        left = x - acc["lb"] <= margin
        right = ~left & (x - acc["rb"] >= -margin)
        return F.struct(F.when(left, x).otherwise(acc["lb"]).alias("lb"), F.when(right, x).otherwise(acc["rb"]).alias("rb"))

    ends = extents.join(inner, "ele_id", "left_anti").join(rows, "ele_id", "left")
    now = F.when(F.col("b").isNull(), start).otherwise(F.aggregate("b", start, step))
    return ends.withColumn("__now", now).select("ele_id", "seq", F.col("__now.lb").alias("lb"), F.col("__now.rb").alias("rb"))


def split_images(bells: DataFrame, bounds: DataFrame, short: int = 30) -> DataFrame:
    """Images of elements with boundaries, split there: img_id, part (from 0, the original last), lb, rb, p_lb, p_rb, score, is_copy.

    ``bells``: img_id, ele_id, lb, rb, p_lb, p_rb, direction, score.
    """
    cuts = bounds.groupBy("ele_id").agg(F.sort_array(F.collect_list(F.col("bd").cast("int"))).alias("cuts"))
    # A cut elsewhere does nothing to an image, as it only shrinks: an image that no cut meets is one part, or too short.
    rows = bells.join(cuts, "ele_id").withColumn("cuts", F.filter("cuts", lambda x: (x > F.col("lb")) & (x < F.col("rb"))))
    rows = rows.select("img_id", "ele_id", "lb", "rb", "p_lb", "p_rb", "direction", "score", "cuts", (F.size("cuts") > 0).alias("met"))
    rows = rows.where(F.col("met") | ((F.col("rb") - F.col("lb") > short) & (F.col("p_rb") - F.col("p_lb") > short))).drop("met")

    def run(row: tuple) -> list[tuple]:
        img, ele, lb, rb, p_lb, p_rb, direction, score, at = row
        copies, rest = cut(facing(lb, rb, p_lb, p_rb, direction), score, at, short)
        parts = [*((*x, True) for x in copies), *([(*rest, False)] if rest else [])]
        return [(img, ele, k, s.x0, s.x1, *partner_ends(s, direction), n, copy) for k, (s, n, copy) in enumerate(parts)]

    types = dict(rows.dtypes)
    return map_rows(rows, run, f"img_id {types['img_id']}, ele_id {types['ele_id']}, part int, lb int, rb int, p_lb int, p_rb int, score int, is_copy boolean")
