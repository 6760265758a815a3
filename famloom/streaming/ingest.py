"""Streaming ingestion of alignments: a demonstration, as the engine itself works on whole inputs.

New alignment files are parsed, normalised and exploded as they arrive, and the
running extent and number of images of each sequence are kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from famloom.sources.alignments import normalise, parse_lines


def stream_images(spark: SparkSession, path: str) -> DataFrame:
    """seq, lb, rb of both sides of each alignment in text files as they appear in ``path``."""
    msps = normalise(parse_lines(spark.readStream.text(path)))
    side = lambda p: F.struct(F.col(f"{p}_seq").alias("seq"), F.col(f"{p}_lb").alias("lb"), F.col(f"{p}_rb").alias("rb"))
    return msps.select(F.explode(F.array(side("q"), side("s"))).alias("i")).select("i.*")


def stream_extents(images: DataFrame) -> DataFrame:
    """Running lb, rb and number of images of each sequence; for output mode complete or update."""
    return images.groupBy("seq").agg(F.min("lb").alias("lb"), F.max("rb").alias("rb"), F.count(F.lit(1)).alias("img_no"))
