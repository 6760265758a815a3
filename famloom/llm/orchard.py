"""Centroid clustering of whole-number vectors, the nearest centroid found by Orchard's search.

Every centroid has a list of all centroids, nearest first.  A vector goes through
the list of the best centroid it knows; once one in it is closer, it jumps to that
one's list.  What it has met is marked and not measured again.  It stops at the
first entry that lies strictly beyond twice its current distance: by the triangle
inequality nothing from there on is closer, nor as close.  Of equal distances the
smaller number wins.

Vectors stay where they are: a round is one pass in which tasks search for their
vectors and return one sum for each centroid; centroids (k times the dimension,
both parameters) are all that passes through the driver.  Arithmetic is on whole
numbers, so results do not depend on the order of rows.

Defined results: vectors that are null, of another length, or with a component
that is null or not finite are left out; equal vectors and repeated rows count
each for itself; rows without vec_id are drawn as centroids after all others of
equal digest; with fewer vectors than centroids there are fewer centroids; an
empty table gives no rows; other columns play no part.  Components of more than
2 ** 19 in size are refused, as squared distances would not fit a long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from famloom.llm.common import arrow_batches, forget, materialise

CENTROIDS, ROUNDS, DIMENSION, SCALE, SEED = 40, 5, 64, 256, 2
LARGEST = 1 << 19


def quantised(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", dimension: int = DIMENSION, scale: int = SCALE) -> DataFrame:
    """vec_id, v: the whole-number vectors that can be used."""
    v = F.col(vector).cast("array<double>")
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    fits = F.forall(v, lambda x: F.abs(x) <= LARGEST)
    out = vectors.where(F.col(vector).isNotNull() & (F.size(vector) == dimension) & whole)
    whole_numbers = F.transform(v, lambda x: F.floor(x * scale).cast("int"))
    return out.select(F.col(vec_id).alias("vec_id"), F.when(fits, whole_numbers).otherwise(F.raise_error(F.lit("a component of a vector is too large"))).alias("v"))


def draw_key(vec_id: Column, seed: int = SEED) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(vec_id.cast("string"), F.lit(""))), 256)


class Lists(NamedTuple):
    """Centroids, and for each the numbers and squared distances of all, nearest first."""

    centroids: np.ndarray
    near: np.ndarray
    beyond: np.ndarray


def lists(centroids: np.ndarray) -> Lists:
    apart = ((centroids[:, None, :] - centroids[None, :, :]) ** 2).sum(axis=2)
    near = np.argsort(apart, axis=1, kind="stable")
    return Lists(centroids.copy(), near, np.take_along_axis(apart, near, axis=1))


def search(vectors: np.ndarray, at: Lists) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid and squared distance of each vector, and how many distances were worked out; all vectors go through their lists side by side."""
    n, k = len(vectors), len(at.centroids)
    rows, best, place = np.arange(n), np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    nearest = ((vectors - at.centroids[0]) ** 2).sum(axis=1)
    met = np.zeros((n, k), dtype=bool)
    met[:, 0] = True
    measured = n
    while len(rows):
        # Entries met before are passed over.
        there = np.minimum(place[rows], k - 1)
        rows = rows[(place[rows] < k) & (at.beyond[best[rows], there] <= 4 * nearest[rows])]
        entry = at.near[best[rows], place[rows]]
        new = ~met[rows, entry]
        place[rows] += 1
        asked, c = rows[new], entry[new]
        if not len(asked):
            continue
        met[asked, c] = True
        d = ((vectors[asked] - at.centroids[c]) ** 2).sum(axis=1)
        measured += len(asked)
        closer = (d < nearest[asked]) | ((d == nearest[asked]) & (c < best[asked]))
        won = asked[closer]
        best[won], nearest[won], place[won] = c[closer], d[closer], 0
    return best, nearest, measured


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    v = batch.column("v")
    return v.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(v), -1)


def _sums(at: Lists):
    """Number and sum of the vectors of each centroid, one row for each and task."""
    k, dimension = at.centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(k, dtype=np.int64), np.zeros((k, dimension), dtype=np.int64)
        for b in batches:
            if len(b):
                v = _matrix(b)
                best = search(v, at)[0]
                for c in np.unique(best):
                    mine = v[best == c]
                    n[c] += len(mine)
                    total[c] += mine.sum(axis=0)
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(n[used]), pa.array(total[used].tolist(), pa.list_(pa.int64()))], ["cluster", "n", "total"])

    return run


def _assigned(at: Lists, vec_id: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                best, nearest, _ = search(_matrix(b), at)
                yield pa.RecordBatch.from_arrays([b.column("vec_id").cast(vec_id), pa.array(best.astype(np.int32)), pa.array(nearest)], ["vec_id", "cluster", "distance"])

    return run


class Clustering(NamedTuple):
    #: vec_id, cluster, distance (squared).
    assigned: DataFrame
    #: A row for each centroid.
    centroids: np.ndarray


def cluster(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED) -> Clustering:
    """``rounds`` of assignment and update over ``vectors`` (vec_id, v; see quantised), then one more assignment.

    The ``k`` vectors of the smallest digests of seed and vec_id are the first
    centroids.  A centroid becomes the floor of the mean of its vectors; one
    without any stays.
    """
    spark = vectors.sparkSession
    arrow_batches(spark)
    rows = materialise(vectors, "vectors")
    first = rows.select(draw_key(F.col("vec_id"), seed).alias("key"), F.col("vec_id").isNull().alias("none"), "v").orderBy("key", "none", "v").limit(k).collect()
    if not first:
        return Clustering(rows.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), np.zeros((0, 0), dtype=np.int64))
    centroids = np.array([r["v"] for r in first], dtype=np.int64)
    for _ in range(rounds):
        parts = rows.select("v").mapInArrow(_sums(lists(centroids)), "cluster long, n long, total array<long>")
        # Sums of tasks are added as decimals: they may be more than a long.
        each = parts.select("cluster", "n", F.posexplode("total").alias("i", "x")).groupBy("cluster", "i").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("x"))
        for r in each.collect():
            centroids[r["cluster"], r["i"]] = int(r["x"]) // int(r["n"])
    kind = rows.schema["vec_id"].dataType
    out = materialise(rows.mapInArrow(_assigned(lists(centroids), to_arrow_type(kind)), f"vec_id {kind.simpleString()}, cluster int, distance long"), "assigned")
    forget(rows)
    return Clustering(out, centroids)


def clusters(embeddings: DataFrame) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of each usable vector."""
    found = cluster(quantised(embeddings))
    sums = {r["cluster"]: r["n"] for r in found.assigned.groupBy("cluster").agg(F.sum("distance").alias("n")).collect()}
    sha = lambda c: hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()
    # A row for each centroid.
    facts = found.assigned.sparkSession.createDataFrame([(c, sums[c], sum(sums.values()), sha(found.centroids[c])) for c in sorted(sums)], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.assigned.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
