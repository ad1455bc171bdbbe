"""Shared storage for intermediate tables.

Lineage is cut by writing Parquet into the folder that ``spark.checkpoint.dir``
names, or else the context's checkpoint folder; on a cluster one of them has to
be set.  What an operator has written goes when its application ends.
"""

from __future__ import annotations

import threading
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import shared_dir, ship

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_lock = threading.Lock()
_writing: dict[str, list] = {}


class _freed:
    """While any table is written, finished queries free their shuffles; after
    the last one the session has its own setting again."""

    def __init__(self, spark: SparkSession):
        self.spark, self.key = spark, str(id(spark))

    def __enter__(self) -> None:
        with _lock:
            held = _writing.setdefault(self.key, [0, self.spark.conf.get(_CLEANUP)])
            held[0] += 1
            if held[0] == 1:
                held[1] = self.spark.conf.get(_CLEANUP)
                self.spark.conf.set(_CLEANUP, "true")

    def __exit__(self, *what) -> None:
        with _lock:
            held = _writing[self.key]
            held[0] -= 1
            if not held[0]:
                self.spark.conf.set(_CLEANUP, held[1])


class Scratch:
    """Named intermediate tables of one operator call.  Those of a given ``root``
    stay when the application ends."""

    def __init__(self, spark: SparkSession, label: str, root: str | None = None):
        self.spark, lasting = spark, root is not None
        self.root = root or f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        ship(spark)
        if not lasting:
            fs, path = self._at(self.root)
            fs.mkdirs(path)
            fs.deleteOnExit(path)

    def _at(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def put(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` once and return a reader of the written table, which
        replaces the shuffles that made it."""
        path = f"{self.root}/{name}"
        with _freed(self.spark):
            df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete tables that later tables no longer need."""
        for name in names:
            fs, path = self._at(f"{self.root}/{name}")
            fs.delete(path, True)


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of ``df``; runs no job."""
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return min(int(str(size)), 1 << 60)
