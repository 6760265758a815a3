"""Chains of partial images as a standalone operator."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Observation, functions as F, types as T

from famloom.config import Config
from famloom.functions.segments import Segment, tree
from famloom.operators.graph import written
from famloom.operators.groups import map_groups
from famloom.operators.refine import Alignment, Element, Refiner

#: Images that one task searches, on average.
SHARE = 50_000

_SCHEMA = T.StructType(
    [T.StructField("ele_id", T.LongType()), T.StructField("p_ele", T.LongType()), T.StructField("is_primary", T.BooleanType()), T.StructField("score", T.IntegerType()), T.StructField("direction", T.IntegerType()), T.StructField("n_marked", T.LongType())]
)


def _pair(config: Config):
    def run(rows: list[dict]) -> list[tuple]:
        first = rows[0]
        own, other = Element(first["ele_id"], 0, first["e_lb"], first["e_rb"]), Element(first["p_ele"], 1, first["pe_lb"], first["pe_rb"])
        group = [(Alignment(k, r["iden"], r["direction"], 0, [r["lb"], r["p_lb"]], [r["rb"], r["p_rb"]], [own, other]), 0) for k, r in enumerate(rows)]
        found, score, direction = Refiner(config).chain(group, own)
        return [(own.number, other.number, found, score, direction, sum(a.primary for a, _ in group))]

    return run


def chain_primaries(pairs: DataFrame, config: Config = Config()) -> DataFrame:  # noqa: B008
    """For pairs of elements: whether a chain of consistent images spans one of them, its score, direction and images.

    ``pairs``: images of pairs without full-length ones, with both extents (see ``paired``).
    """
    rows = pairs.select("ele_id", "p_ele", "direction", "lb", "rb", "img_id", "p_lb", "p_rb", "iden", "e_lb", "e_rb", "pe_lb", "pe_rb")
    # Written and counted, as the number of tasks follows the rows, whatever the session's partitions are.
    count = Observation()
    rows = written(rows.observe(count, F.count(F.lit(1)).alias("n")), "partial")
    return map_groups(rows, ["ele_id", "p_ele"], ["direction", "lb", "rb", "img_id"], _pair(config), _SCHEMA, -(-count.get["n"] // SHARE))


def tree_text(segments: list[Segment], config: Config = Config()) -> str:  # noqa: B008
    """An indented picture of the consistency tree of segments sorted by x0."""
    loose = np.float32(1.0 - float(np.float32(config.full_length)))
    return "\n".join(f"{'  ' * depth}{k} {segments[k].x0}-{segments[k].x1}" for depth, k in tree(segments, loose))
