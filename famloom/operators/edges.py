"""The element graph: edges from images, partial-length filter, and repair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from famloom.functions.intervals import f32, full_length, ratio
from famloom.operators.graph import written


def paired(bells: DataFrame, extents: DataFrame, cutoff: float = 0.9, slack: int = 10) -> DataFrame:
    """Images of different elements with both elements' extents and whether the image, or its partner, is full length (full, p_full)."""
    own = extents.select("ele_id", F.col("lb").alias("e_lb"), F.col("rb").alias("e_rb"))
    other = extents.select(F.col("ele_id").alias("p_ele"), F.col("lb").alias("pe_lb"), F.col("rb").alias("pe_rb"))
    return with_full_length(bells.where("ele_id != p_ele").join(own, "ele_id").join(other, "p_ele"), cutoff, slack)


def with_full_length(both: DataFrame, cutoff: float = 0.9, slack: int = 10) -> DataFrame:
    """Images that hold both elements' extents (e_lb, e_rb, pe_lb, pe_rb) with full and p_full."""
    return both.withColumn("full", full_length(F.col("lb"), F.col("rb"), F.col("e_lb"), F.col("e_rb"), cutoff, slack)).withColumn("p_full", full_length(F.col("p_lb"), F.col("p_rb"), F.col("pe_lb"), F.col("pe_rb"), cutoff, slack))


def _won(pairs: DataFrame) -> DataFrame:
    """(ele_id, p_ele, won) of each pair: its winner's score, direction, lb, rb and img_id, null without a full-length image.

    In order of direction, lb and rb an image replaces the winner if its identity
    is over the winner's cut to a whole number.  So with the greatest whole number
    M: the last image whose identity is over M, or else the first of exactly M.
    One aggregation finds either; no order inside a pair is kept.
    """
    whole, names = F.floor("iden").cast("int"), ("direction", "lb", "rb", "img_id")
    place = lambda sign: F.struct(whole.alias("score"), *((F.col(c) * sign).alias(c) for c in names))
    full, over = F.col("full") | F.col("p_full"), F.col("iden") > whole
    found = pairs.groupBy("ele_id", "p_ele").agg(F.max(F.when(full & over, place(1))).alias("a"), F.max(F.when(full & ~over, place(-1))).alias("b"))
    first = F.struct(F.col("b.score").alias("score"), *((-F.col(f"b.{c}")).alias(c) for c in names))
    last = F.col("a").isNotNull() & (F.col("b").isNull() | (F.col("a.score") >= F.col("b.score")))
    return found.select("ele_id", "p_ele", F.when(last, F.col("a")).when(F.col("b").isNotNull(), first).alias("won"))


def best_primary(pairs: DataFrame) -> DataFrame:
    """(ele_id, p_ele, img_id, score, direction): the winner of each pair's full-length images."""
    won = _won(pairs.where("full or p_full"))
    return won.select("ele_id", "p_ele", "won.img_id", "won.score", "won.direction")


def first_edges(pairs: DataFrame) -> DataFrame:
    """(ele1, ele2, type, score, direction) of each pair seen from its smaller element: p if an image is full length, else s with score and direction 0."""
    score, direction = F.col("won.score"), F.col("won.direction")
    return _won(pairs.where("ele_id < p_ele")).select(
        F.col("ele_id").alias("ele1"), F.col("p_ele").alias("ele2"), F.when(score.isNull(), "s").otherwise("p").alias("type"),
        F.coalesce(score, F.lit(0)).alias("score"), F.coalesce(direction, F.lit(0)).alias("direction"),
    )


def by_owner(edges: DataFrame) -> DataFrame:
    """Each edge once for either end: owner, other and the edge's columns."""
    ends = F.array(F.struct(F.col("ele1").alias("owner"), F.col("ele2").alias("other")), F.struct(F.col("ele2").alias("owner"), F.col("ele1").alias("other")))
    return edges.where("ele1 != ele2 and type != 'c'").withColumn("e", F.explode(ends)).select("e.owner", "e.other", "edge_id", "type", "score", "direction")


def tree_places(place: Column, n: Column) -> Column:
    """(pre, post): rank before (root, left, right) and after (left, right, root) its subtrees of the item at ``place`` of n in a balanced tree of midpoints."""
    number = lambda x: F.lit(x).cast("long") if isinstance(x, int) else x.cast("long")
    state = lambda lo, hi, pre, post: F.struct(number(lo).alias("lo"), number(hi).alias("hi"), number(pre).alias("pre"), number(post).alias("post"))
    mid = lambda s: F.floor((s["lo"] + s["hi"]) / 2)

    def down(s: Column, _: Column) -> Column:
        left = mid(s) - s["lo"]
        lower = state(s["lo"], mid(s) - 1, s["pre"] + 1, s["post"])
        upper = state(mid(s) + 1, s["hi"], s["pre"] + 1 + left, s["post"] + left)
        return F.when(place == mid(s), s).when(place < mid(s), lower).otherwise(upper)

    # As many steps as the tree has levels.
    levels = F.sequence(F.lit(1), F.ceil(F.log2(n.cast("double") + 1)).cast("int") + 1)
    found = F.aggregate(levels, state(0, n - 1, 0, 0), down)
    return F.transform(F.array(found), lambda s: F.struct(s["pre"].alias("pre"), (s["post"] + s["hi"] - s["lo"]).alias("post")))[0]


def partial_filter(edges: DataFrame, extents: DataFrame, limit: float = 0.7) -> DataFrame:
    """``edges`` (edge_id, ele1, ele2, type, score, direction) with types after the partial-length filter.

    An element shorter than ``limit`` of a partner keeps one of those edges, the
    best-scoring, as P; its other primary edges, whichever partner, become S.  Of
    equal scores the first in the element's edge tree is kept: the tree's first if
    it is among them, else the first after its subtrees.
    """
    size = extents.select("ele_id", "lb", "rb")
    own = by_owner(edges).join(size.select(F.col("ele_id").alias("owner"), F.col("lb").alias("a"), F.col("rb").alias("b")), "owner")
    own = own.join(size.select(F.col("ele_id").alias("other"), F.col("lb").alias("c"), F.col("rb").alias("d")), "other")
    # The threshold is a double, as opposed to the ratio.
    short = F.coalesce(ratio(f32(F.col("b")) - f32(F.col("a")), F.col("d") - F.col("c")).cast("double") < limit, F.lit(False))
    ranked = own.withColumns({"n": F.count(F.lit(1)).over(Window.partitionBy("owner")), "r": F.row_number().over(Window.partitionBy("owner").orderBy("edge_id")) - 1})
    q = ranked.where(F.col("type").isin("p", "S") & short)
    top = q.withColumn("most", F.max("score").over(Window.partitionBy("owner")))
    top = top.withColumns({"ties": F.sum((F.col("score") == F.col("most")).cast("int")).over(Window.partitionBy("owner"))})
    # Read three times.
    top = written(top.select("owner", "edge_id", "score", "most", "ties", "r", "n"), "partial")
    sure = top.where("ties = 1 and score = most").select("owner", "edge_id")
    tied = top.where("ties > 1").withColumn("t", tree_places(F.col("r"), F.col("n")))
    head = Window.partitionBy("owner").orderBy("t.pre")
    tied = tied.withColumn("is_first", F.row_number().over(head) == 1).where("score = most")
    chosen = tied.groupBy("owner").agg(F.coalesce(F.max(F.when(F.col("is_first"), F.col("edge_id"))), F.min_by("edge_id", "t.post")).alias("edge_id"))
    kept = sure.unionByName(chosen).select(F.col("edge_id").alias("__kept")).distinct()
    shorts = top.select(F.col("owner").alias("__o")).distinct()
    out = edges.join(kept, F.col("edge_id") == F.col("__kept"), "left")
    for end in ("ele1", "ele2"):
        out = out.join(shorts.withColumn(f"__{end}", F.lit(True)).withColumnRenamed("__o", f"__o_{end}"), F.col(end) == F.col(f"__o_{end}"), "left")
    demoted = F.col("__ele1").isNotNull() | F.col("__ele2").isNotNull()
    kind = F.when(F.col("__kept").isNotNull(), "P").when((F.col("type") == "p") & demoted, "S").otherwise(F.col("type"))
    return out.withColumn("type", kind).drop("__kept", "__ele1", "__ele2", "__o_ele1", "__o_ele2")


def repaired(edges: DataFrame, mode: str = "original") -> DataFrame:
    """Edges by owner after repair: an owner without ordinary primary edges whose highest edge is S takes it as P, in its own record alone.

    ``guarded``: only if the owner has no primary edge of either kind.
    """
    own = by_owner(edges)
    if mode == "original":
        return own
    per = Window.partitionBy("owner")
    top = F.max("edge_id").over(per) == F.col("edge_id")
    has = F.max(F.col("type").isin(*(("p",) if mode == "promote" else ("p", "P")))).over(per)
    return own.withColumn("type", F.when(top & ~has & (F.col("type") == "S"), "P").otherwise(F.col("type")))


def is_primary(c: str = "type") -> Column:
    return F.col(c).isin("p", "P")
