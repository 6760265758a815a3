"""Merkle manifest of a dataset that stores every few levels and works out the others when a proof asks for them.

Each group of rows (a source) is a tree whose leaves are the digests of its rows
in order, and the roots of the trees, ordered by group, are the leaves of a tree
on top.  ``ARITY`` neighbours become one node; the last ones of a level may be
fewer, even one.

``build`` cuts every tree into aligned subtrees of ``STRIDE`` levels.  A stage is a
table of such subtrees: the nodes at the foot of each, and the node at its head,
which is a node at the foot of the next stage.  The levels between are not kept.
``proofs`` goes down from the root: a subtree's missing nodes are worked out again
from the stored ones at its foot, each of these gets its siblings on the way to
the head and those that the head has above it, and the missing nodes are dropped.
A subtree is at most ARITY ** STRIDE rows, whatever the size of its group, and
what lies above its head is joined once for all of its nodes.

Defined results: rows without a group are a group of their own, the first; rows
without a key come first in their group; rows of equal key are ordered by digest,
and of rows equal in both any order gives the same digests; an empty table has no
trees, no root and no proofs.  Texts are only hashed where they are read; columns
other than those named play no part, whatever their names.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, functions as F

from famloom.llm.common import materialise, partitions
from famloom.operators.graph import numbered

ARITY, STRIDE = 3, 4
SPAN = ARITY**STRIDE
#: Rows of a table (a group's part in a partition each) that may be broadcast; more are joined by sort and merge.
BROADCAST = 50_000
#: Powers of ARITY in a long.
_POWERS = [ARITY**i for i in range(40) if ARITY**i < 1 << 63]

_PATH = "array<struct<left:string,right:string>>"


def digest(*parts: Column) -> Column:
    """Lower-case hex SHA-256 of the concatenated strings."""
    return F.sha2(F.concat(*parts), 256)


def row_digest(*values: Column) -> Column:
    """Digest of a row: ``-`` for a null, else bytes, a colon and the value."""
    texts = [v.cast("string") for v in values]
    return digest(*(F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts))


class Manifest(NamedTuple):
    #: By stage: tree, height, block, depth (levels from foot to head), nodes (kept, digest), head.
    trees: list[DataFrame]
    #: The same for the tree over the groups' roots, a node for each group by number.
    top: list[DataFrame]
    #: tree, group, leaves, height, root: a row for each group.
    groups: DataFrame
    #: The digest of everything; None for an empty table.
    root: str | None


def _height(leaves: Column) -> Column:
    """Levels from a tree's leaves to its root."""
    return F.size(F.filter(F.array(*map(F.lit, _POWERS)), lambda p: p < leaves))


def _above(nodes: Column) -> Column:
    """The level above ``nodes``."""
    runs = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / ARITY).cast("int"))
    return F.transform(runs, lambda i: F.sha2(F.array_join(F.slice(nodes, i * ARITY + 1, F.lit(ARITY)), ""), 256))


def _stage(nodes: DataFrame, k: int) -> DataFrame:
    """Subtrees over ``nodes`` (tree, height, place, kept, digest), the k-th stage of their trees."""
    depth = F.least(F.lit(STRIDE), F.col("height") - STRIDE * k)
    block = F.floor(F.col("place") / SPAN)
    grouped = nodes.groupBy("tree", block.alias("block")).agg(F.min("height").alias("height"), F.sort_array(F.collect_list(F.struct("place", "kept", "digest"))).alias("nodes"))
    out = grouped.select("tree", "height", "block", depth.alias("depth"), F.transform("nodes", lambda n: F.struct(n["kept"].alias("kept"), n["digest"].alias("digest"))).alias("nodes"))
    out = out.withColumn("level0", F.col("nodes.digest"))
    for i in range(STRIDE):
        out = out.withColumn(f"level{i + 1}", F.when(F.col("depth") > i, _above(F.col(f"level{i}"))))
    head = F.element_at(F.array(*(F.col(f"level{i}") for i in range(STRIDE + 1))), F.col("depth") + 1)[0]
    return materialise(out.select("tree", "height", "block", "depth", "nodes", head.alias("head")), f"merkle-{k}")


def _tree(nodes: DataFrame, height: int) -> list[DataFrame]:
    """All stages of trees of up to ``height`` levels."""
    out = []
    for k in range(max(1, -(-height // STRIDE))):
        if k:
            last = out[-1].where(F.col("height") > STRIDE * k)
            nodes = last.select("tree", "height", F.col("block").alias("place"), F.lit(None).cast("string").alias("kept"), F.col("head").alias("digest"))
        out.append(_stage(nodes, k))
    return out


def _ends_in(k: int) -> Column:
    """Whether the k-th stage is a tree's last."""
    return F.greatest(F.col("height"), F.lit(1)).between(STRIDE * k + 1, STRIDE * (k + 1))


def _roots(stages: list[DataFrame]) -> DataFrame:
    """tree, root of each tree: the head of its last stage."""
    done = [s.where(_ends_in(k)).select("tree", F.col("head").alias("root")) for k, s in enumerate(stages)]
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def build(rows: DataFrame, leaf: str, group: str, key: list[str], keep: list[str]) -> Manifest:
    """The manifest of ``rows``: digests ``leaf``, one tree for each value of string ``group``, its leaves in order of ``key``.

    ``keep``: columns that come back with the proofs.
    """
    n, big = partitions(rows.sparkSession), (1 << 33) - 1
    narrow = rows.select(F.col(group).alias("group"), F.struct(*(F.col(c).alias(f"k{i}") for i, c in enumerate(key))).alias("key"), F.col(leaf).alias("digest"), F.struct(*keep).alias("kept"))
    # Equal rows are told apart, so that no range is theirs alone.
    order = ["group", "key", "digest", "tie"]
    placed = narrow.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    placed = materialise(placed.drop("key", "tie"), "merkle-rows").withColumns({"part": F.shiftright("at", 33), "row": F.col("at").bitwiseAND(F.lit(big))})
    runs = materialise(placed.groupBy("part", "group").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("first")), "merkle-runs")
    groups = numbered(runs.groupBy("group").agg(F.sum("n").alias("leaves")), "group", "tree")
    groups = materialise(groups.withColumn("height", _height(F.col("leaves"))), "merkle-groups")
    before = Window.partitionBy("group").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = runs.select("part", "group", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("base"))
    base = base.join(groups.withColumnRenamed("group", "of"), F.col("group").eqNullSafe(F.col("of"))).select(F.col("part").alias("in_part"), "of", "base", "tree", "height")
    base = F.broadcast(base) if runs.count() <= BROADCAST else base.hint("merge")
    nodes = placed.join(base, (F.col("part") == F.col("in_part")) & F.col("group").eqNullSafe(F.col("of"))).select("tree", "height", (F.col("row") + F.col("base")).alias("place"), "kept", "digest")
    size = groups.agg(F.max("height").alias("height"), F.count(F.lit(1)).alias("n")).first()
    trees = _tree(nodes, size["height"] or 0)
    groups = materialise(groups.join(_roots(trees).hint("merge"), "tree"), "merkle-groups")
    height = sum(p < size["n"] for p in _POWERS)
    above = groups.select(F.lit(0).cast("long").alias("tree"), F.lit(height).alias("height"), F.col("tree").alias("place"), F.lit(None).cast("string").alias("kept"), F.col("root").alias("digest"))
    top = _tree(above, height)
    root = _roots(top).first()
    return Manifest(trees, top, groups, root["root"] if root else None)


def _open(stage: DataFrame, heads: DataFrame) -> DataFrame:
    """tree, place, kept, digest, path, above: the nodes at the foot of ``stage``, with their siblings up to the root.

    ``heads``: tree, place, path, above of the nodes at its subtrees' heads.
    """
    both = stage.join(heads.select("tree", F.col("place").alias("block"), "path", "above").hint("merge"), ["tree", "block"])
    both = both.withColumn("level0", F.col("nodes.digest"))
    for i in range(STRIDE - 1):
        both = both.withColumn(f"level{i + 1}", F.when(F.col("depth") > i + 1, _above(F.col(f"level{i}"))))
    levels = [f"level{i}" for i in range(STRIDE)]
    each = both.select("tree", "block", "depth", "path", "above", *levels, F.posexplode("nodes").alias("at", "node"))
    steps, place = [], F.col("at")
    for level in levels:
        in_run = place % ARITY
        left = F.array_join(F.slice(level, place - in_run + 1, in_run), "")
        right = F.array_join(F.slice(level, place + 2, ARITY - 1 - in_run), "")
        steps.append(F.struct(left.alias("left"), right.alias("right")))
        place = F.floor(place / ARITY).cast("int")
    path = F.concat(F.slice(F.array(*steps), F.lit(1), F.col("depth")), "path")
    return each.select("tree", (F.col("block") * SPAN + F.col("at")).alias("place"), "node.kept", "node.digest", path.alias("path"), "above")


def _walk(stages: list[DataFrame], roots: DataFrame) -> DataFrame:
    """The leaves of trees with their siblings up to the root; ``roots``: tree, height, path, above."""
    below = None
    for k in reversed(range(len(stages))):
        heads = roots.where(_ends_in(k)).select("tree", F.lit(0).cast("long").alias("place"), "path", "above")
        below = _open(stages[k], heads if below is None else heads.unionByName(below.select("tree", "place", "path", "above")))
        if k:
            below = materialise(below, "merkle-paths")
    return below


def proofs(manifest: Manifest) -> DataFrame:
    """The columns kept, and for each leaf: leaf, path (left and right siblings by level, from leaf to root), subroot, root."""
    g = manifest.groups
    start = g.agg(_height(F.count(F.lit(1))).alias("height")).select(F.lit(0).cast("long").alias("tree"), "height", F.array().cast(_PATH).alias("path"), F.lit(None).cast("string").alias("above"))
    tops = materialise(_walk(manifest.top, start).select(F.col("place").alias("tree"), "path"), "merkle-tops")
    roots = materialise(g.join(tops.hint("merge"), "tree").select("tree", "height", "path", F.col("root").alias("above")), "merkle-roots")
    out = _walk(manifest.trees, roots)
    return out.select("kept.*", F.col("digest").alias("leaf"), "path", F.col("above").alias("subroot"), F.lit(manifest.root).cast("string").alias("root"))


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(path, leaf, lambda node, s: F.sha2(F.concat(s["left"], node, s["right"]), 256))


def path_digest(path: Column) -> Column:
    """Digest of all siblings of a proof, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def audited(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, and the root that each document's leaf leads to once texts were tampered with.

    Where the CRC-32 of its decimal doc_id is even a document has lost its line
    feeds (a document without doc_id has not); ``verified`` says whether the leaf
    made anew still leads to the root.
    """
    fields = [F.col(c) for c in FIELDS]
    lost = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0) & F.contains("text", F.lit("\n"))
    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), row_digest(*fields).alias("leaf"), F.when(lost, row_digest(*fields[:-1], F.replace("text", F.lit("\n"), F.lit("")))).alias("tampered"))
    out = proofs(build(rows, "leaf", "source", ["doc_id"], ["doc_id", "tampered"]))
    out = out.select("doc_id", "leaf", "subroot", "root", path_digest(F.col("path")).alias("proof_sha256"), folded(F.coalesce("tampered", "leaf"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
