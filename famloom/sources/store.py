"""A versioned keyed store: append versions, read the latest, compact."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def latest(rows: DataFrame, key: str, version: str) -> DataFrame:
    """The row of the highest version of each key; one aggregation, no order inside a key."""
    others = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*others), version).alias("__r")).select(key, "__r.*")


class Store:
    """Parquet versions in a folder, one sub-folder a write."""

    def __init__(self, spark: SparkSession, path: str, key: str):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key

    def _versions(self) -> list[int]:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        return sorted(int(s.getPath().getName().removeprefix("v")) for s in fs.listStatus(path) if s.getPath().getName().startswith("v"))

    def write(self, rows: DataFrame) -> int:
        """Append a version; keys that it has replace older ones."""
        n = max(self._versions(), default=0) + 1
        rows.write.parquet(f"{self.path}/v{n}")
        return n

    def read(self, upto: int | None = None) -> DataFrame:
        """The active row of each key (as of version ``upto``)."""
        parts = [self.spark.read.parquet(f"{self.path}/v{n}").withColumn("__version", F.lit(n)) for n in self._versions() if upto is None or n <= upto]
        if not parts:
            raise ValueError("an empty store")
        whole = parts[0]
        for p in parts[1:]:
            whole = whole.unionByName(p)
        return latest(whole, self.key, "__version").drop("__version")

    def get(self, key: object) -> DataFrame:
        """The active row of one key; the filter reaches every version's files."""
        return self.read().where(F.col(self.key) == F.lit(key))

    def compact(self) -> int:
        """Active rows as one new version, sorted by key; older ones are removed once it is there."""
        old = self._versions()
        if not old:
            raise ValueError("an empty store")
        n = max(old) + 1
        self.read().sort(self.key).write.parquet(f"{self.path}/v{n}")
        jvm = self.spark._jvm
        for v in old:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/v{v}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        return n
