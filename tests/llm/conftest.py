import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text) or (doc_id, text, source); extra columns clash with names that operators use."""
    def build(rows, extra=False):
        rows = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1])) for r in rows]
        df = spark.createDataFrame(rows, DOCS).repartition(3)
        if extra:
            from pyspark.sql import functions as F

            for c in ("rate", "n_words", "kept", "fp", "slot", "shard", "size", "length", "bytes", "ids", "spans", "labels", "piece", "offset", "component_id", "copy", "cdf", "html", "url", "turns", "path", "__x"):
                df = df.withColumn(c, F.lit("clash"))
        return df

    return build

