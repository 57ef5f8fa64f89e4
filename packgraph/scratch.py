"""Intermediate tables in the folder that all executors share.

A written table cuts lineage and survives lost executors: a later read never recomputes what came before it, and its size is
known to the planner.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; only a local session without one gets a folder of its own."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    root = tempfile.mkdtemp(prefix="packgraph-")
    sc.setCheckpointDir(root)
    return sc.getCheckpointDir().rstrip("/")


def _delete(path: str) -> None:
    sc = SparkContext._active_spark_context
    if sc is None or sc._jsc is None:  # the session has ended
        return
    try:
        target = sc._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001  leftovers are no reason to fail a finished job
        pass


class Scratch:
    """Tables written below one fresh shared folder; what is left goes when Python ends, which alone is remembered of a Scratch
    that is no longer used."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
        self.names: dict[int, tuple[str, DataFrame]] = {}
        atexit.register(_delete, self.base)

    def put(self, name: str, df: DataFrame) -> DataFrame:
        """Write df as a table and read it again with the schema it was written with."""
        path = f"{self.base}/{name}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        found = self.spark.read.schema(df.schema).parquet(path)
        self.names[id(found)] = (name, found)
        return found

    def drop(self, *names: str) -> None:
        """Delete tables that nothing reads any more."""
        for name in names:
            _delete(f"{self.base}/{name}")
            self.names = {i: x for i, x in self.names.items() if x[0] != name}

    def drop_all(self, prefix: str) -> None:
        self.drop(*[name for name, _ in list(self.names.values()) if name.startswith(prefix)])

    def forget(self, df: DataFrame) -> None:
        """Delete the table that ``put`` gave as df."""
        if id(df) in self.names:
            self.drop(self.names[id(df)][0])

    def only(self, *kept: DataFrame) -> None:
        """Delete all tables but those that ``put`` gave as kept."""
        keep = {id(x) for x in kept}
        self.drop(*[name for i, (name, _) in self.names.items() if i not in keep])
