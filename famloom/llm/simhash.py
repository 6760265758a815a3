"""SimHash near-duplicates by deletion-variant signatures.

A 64-bit fingerprint is cut into two segments of 32 bits: of two fingerprints
that differ in at most two bits, one segment differs in at most one.  Each
segment is indexed under its 32 one-wildcard variants (one bit masked); an
equality join on (segment, wildcard, masked value) finds the candidates.  Only
distinct fingerprints are indexed, so copies cost nothing.

Verification makes no pairs: each candidate is sent to its meeting points, the
fingerprint itself and the 64 that differ in one bit.  Two fingerprints have a
meeting point in common if and only if they differ in at most two bits, so all
that meet there are linked, and a link from each to the smallest of them keeps
every component whole.  A bucket of m candidates costs 65 m rows, however dense.
Each link's distance is counted again before it is used.

Defined results: a null text is empty; the fingerprint of a text without words is
zero and links like any other; ties, repeated rows and copies share a
fingerprint and so a component; a null doc_id is never a component's name unless
all its documents have none (then null); very long texts are hashed whole, in
blocks; an empty table gives no rows; other columns are left out, whatever their
names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from famloom.llm.common import arrow_batches, forget, materialise, partitions
from famloom.operators.graph import components

SHINGLE, SEED, BITS, RADIUS = 3, 42, 64, 2
SEGMENT = 32
#: Shingles hashed at once: bounds the memory a long text takes.
BLOCK = 1 << 16


def simhash(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit fingerprint of the word shingles of a whole text, repeats counted; words are runs free of ASCII white space, A-Z lower-cased."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    k, digest = min(shingle, len(words)), xxhash.xxh64_intdigest
    n, counts = len(words) - k + 1, np.zeros(BITS, dtype=np.int64)
    for at in range(0, n, BLOCK):
        part = words[at : min(at + BLOCK, n) + k - 1]
        hashes = np.array([digest(b" ".join(x), SEED) for x in zip(*[part[i:] for i in range(k)], strict=False)], dtype="<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(sum(1 << i for i in np.flatnonzero(2 * counts > n).tolist()))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of each row."""
    arrow_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([simhash(x.as_py()) for x in b.column("text")], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    src = docs.select("doc_id", "text")
    return src.mapInArrow(run, f"doc_id {dict(src.dtypes)['doc_id']}, fp long")


def _mask(width: int) -> int:
    return (1 << width) - 1


def variants(fp: Column) -> Column:
    """array<long>: (segment, wildcard, value without that bit) of both segments, packed into 38 bits."""
    out = []
    for s in range(BITS // SEGMENT):
        value = F.shiftrightunsigned(fp, s * SEGMENT).bitwiseAND(F.lit(_mask(SEGMENT)))
        for j in range(SEGMENT):
            out.append(value.bitwiseAND(F.lit(_mask(SEGMENT) ^ (1 << j))).bitwiseOR(F.lit((s * SEGMENT + j) << SEGMENT)))
    return F.array(*out)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def candidates(fps: DataFrame) -> DataFrame:
    """Of the distinct fingerprints ``fp``, those with a variant in common with another."""
    # Each row becomes 64: spread first, or the few tasks that read a small table make them all.
    fps = fps.select("fp").repartition(partitions(fps.sparkSession), "fp")
    rows = fps.select("fp", F.explode(variants(F.col("fp"))).alias("key"))
    shared = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    return rows.join(shared.hint("merge"), "key", "left_semi").select("fp").distinct()


def links(found: DataFrame) -> DataFrame:
    """(u, v): each candidate and the smallest fingerprint at each of its meeting points, verified."""
    points = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(_signed(1 << i))) for i in range(BITS)])
    meet = found.select("fp", F.explode(points).alias("point"))
    # The smallest at a point is asked for where it is not alone.
    least = meet.groupBy("point").agg(F.min("fp").alias("v"), F.count(F.lit(1)).alias("n")).where("n > 1").select("point", "v")
    out = meet.join(least.hint("merge"), "point").where("fp != v").select(F.col("fp").alias("u"), "v").distinct()
    return out.where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= RADIUS)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id reachable by links of at most RADIUS bits) of each row."""
    rows = materialise(fingerprints(docs), "simhash")
    fps = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "fps")
    found = materialise(candidates(fps), "candidates")
    roots = components(links(found))
    # All of these grow with the corpus: joined by sort and merge at every size.
    named = fps.join(roots.withColumnRenamed("node", "fp").hint("merge"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    names = named.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = materialise(named.join(names.hint("merge"), "root").select("fp", "component_id"), "classes")
    forget(found, fps, roots)
    return rows.join(classes.hint("merge"), "fp").select("doc_id", "fp", "component_id")
