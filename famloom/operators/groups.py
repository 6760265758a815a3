"""Small groups in bulk: one pass over sorted partitions instead of one call a group."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def map_groups(df: DataFrame, keys: list[str], order: list, fn: Callable[[list[dict]], Iterable[tuple]], schema: StructType, tasks: int = 1) -> DataFrame:
    """``fn`` of each group's rows, sorted by ``order``, in ``tasks`` tasks at least; a task holds one group at a time besides its batch."""
    n = max(tasks, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    arrow, names = to_arrow_schema(schema), df.columns
    at = [names.index(k) for k in keys]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        rows = (x for b in batches for x in zip(*(c.to_pylist() for c in b.columns), strict=True))
        held: list[tuple] = []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), arrow, strict=True)], schema=arrow)

        for _, group in groupby(rows, key=lambda x: tuple(x[i] for i in at)):
            held += fn([dict(zip(names, x, strict=True)) for x in group])
            if len(held) >= 5000:
                yield out()
                held.clear()
        if held:
            yield out()

    return df.repartition(n, *keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def map_rows(df: DataFrame, fn: Callable[[tuple], Iterable[tuple]], schema: str) -> DataFrame:
    """The rows that ``fn`` makes of each row, a batch at a time."""
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for b in batches:
            rows = [x for r in zip(*(c.to_pylist() for c in b.columns), strict=True) for x in fn(r)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    return df.mapInArrow(run, schema)
