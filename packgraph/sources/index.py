"""A versioned index of packs: packs, documents, nodes and edges that are published together or not at all.

A publication writes its packs' rows into a folder of its own, checks what was written, and only then adds a version: a small table of
which folder holds which pack. A version is taken by creating its marker file, which fails if another publication was first; the
newest marked version is what readers open. Nothing that a version names is ever rewritten, so a reader keeps the version that it
has opened, and going back means naming an older one again.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The tables with the key of a row beside its pack.
TABLES = {"packs": (), "documents": ("path",), "nodes": ("id",), "edges": ("id",)}


def _as_text(schema: T.StructType) -> T.StructType:
    """The schema with pack ids as text: as names of folders, 007 would be read as a number."""
    return T.StructType([T.StructField(f.name, T.StringType() if f.name == "pack_id" else f.dataType) for f in schema])


class Rejected(ValueError):
    """What was published has faults; the index is as it was."""


class Conflict(RuntimeError):
    """Another publication added the version first."""


@dataclass(frozen=True)
class Version:
    """One state of the index. ``number`` is 0 for an empty one."""

    spark: SparkSession
    root: str
    number: int
    places: DataFrame | None = field(default=None, compare=False)

    def table(self, name: str) -> DataFrame | None:
        """The rows of a table, None before anything was published; packs that were replaced are pruned as partitions."""
        if self.places is None:
            return None
        batches = [r["batch"] for r in self.places.select("batch").distinct().collect()]
        out = None
        for batch in batches:
            live = self.places.filter(F.col("batch") == batch).select("pack_id")
            said = json.loads("".join(r["value"] for r in self.spark.read.text(f"{self.root}/data/{batch}/schemas.json").collect()))
            rows = self.spark.read.schema(T.StructType.fromJson(said[name])).parquet(f"{self.root}/data/{batch}/{name}").join(live, "pack_id", "left_semi")
            out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
        return out


class Index:
    """An index in a folder that the driver and all executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # --- files ---

    def _path(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _claim(self, number: int, batch: str) -> None:
        """Create the version's marker; only one publication can."""
        path, fs = self._path(f"versions/{number:09d}.json")
        try:
            out = fs.create(path, False)
        except Exception as e:  # noqa: BLE001  the file system says in its own way that the file is there
            if fs.exists(path):
                raise Conflict(f"version {number} is taken") from e
            raise
        out.write(bytearray(json.dumps({"places": batch}).encode()))
        out.close()

    def _write(self, name: str, content: dict) -> None:
        path, fs = self._path(name)
        out = fs.create(path, False)
        out.write(bytearray(json.dumps(content).encode()))
        out.close()

    def versions(self) -> list[int]:
        path, fs = self._path("versions")
        names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
        return sorted(int(n[:9]) for n in names if n.endswith(".json"))

    def open(self, number: int | None = None) -> Version:
        """The newest version, or the one of that number."""
        known = self.versions()
        number = (known[-1] if known else 0) if number is None else number
        if not number:
            return Version(self.spark, self.root, 0)
        if number not in known:
            raise KeyError(f"no version {number}")
        said = json.loads("".join(r["value"] for r in self.spark.read.text(f"{self.root}/versions/{number:09d}.json").collect()))
        return Version(self.spark, self.root, number, self.spark.read.schema("pack_id string, batch string").parquet(f"{self.root}/places/{said['places']}"))

    # --- changes ---

    def publish(self, tables: dict[str, DataFrame], check: Callable[[dict[str, DataFrame]], DataFrame] | None = None, order: str = "ord") -> Version:
        """A version in which the packs of ``tables["packs"]`` have the given rows, in place of those that they had, and all other packs stay.

        Of rows with one key in a pack the last by ``order`` (a column, if there is one) holds. ``check`` gets the written tables and
        gives a table of faults; any row of it, and any fault of ``faults``, rejects the whole publication.
        """
        before, batch = self.open(), uuid.uuid4().hex
        try:
            for name, key in TABLES.items():
                rows = tables[name]
                if order in rows.columns:
                    rest = [c for c in rows.columns if c not in ("pack_id", *key)]
                    rows = rows.groupBy("pack_id", *key).agg(F.max_by(F.struct(*rest), order).alias("m")).select("pack_id", *key, "m.*") if rest else rows.distinct()
                else:
                    rows = rows.dropDuplicates(["pack_id", *key])
                # A pack is spread over several files by its keys; a partition folder for each lets readers skip the replaced ones.
                rows.write.mode("error").partitionBy("pack_id").option("maxRecordsPerFile", 1_000_000).parquet(f"{self.root}/data/{batch}/{name}")
            self._write(f"data/{batch}/schemas.json", {n: _as_text(tables[n].schema).jsonValue() for n in TABLES})
            written = {n: self.spark.read.schema(_as_text(tables[n].schema)).parquet(f"{self.root}/data/{batch}/{n}") for n in TABLES}
            found = faults(written)
            if check is not None:
                found = found.unionByName(check(written).select("fault", "pack_id", "n"))
            first = found.limit(20).collect()
            if first:
                raise Rejected("; ".join(f"{r['fault']} in {r['pack_id']}: {r['n']}" for r in first))
            new = written["packs"].select("pack_id", F.lit(batch).alias("batch"))
            kept = before.places.join(new.select("pack_id"), "pack_id", "left_anti") if before.places is not None else None
            (new if kept is None else new.unionByName(kept)).coalesce(1).write.parquet(f"{self.root}/places/{batch}")
            self._claim(before.number + 1, batch)
        except BaseException:
            for name in ("data", "places"):
                path, fs = self._path(f"{name}/{batch}")
                fs.delete(path, True)
            raise
        return self.open(before.number + 1)

    def remove(self, pack_ids: list[str]) -> Version:
        """A version without these packs."""
        before, batch = self.open(), uuid.uuid4().hex
        if before.places is None:
            return before
        before.places.filter(~F.col("pack_id").isin(pack_ids)).coalesce(1).write.parquet(f"{self.root}/places/{batch}")
        self._claim(before.number + 1, batch)
        return self.open(before.number + 1)

    def roll_back(self, number: int) -> Version:
        """A new version that is what version ``number`` was."""
        old, batch = self.open(number), uuid.uuid4().hex
        old.places.coalesce(1).write.parquet(f"{self.root}/places/{batch}")
        newest = self.versions()[-1]
        self._claim(newest + 1, batch)
        return self.open(newest + 1)

    def vacuum(self, keep: int = 2) -> list[str]:
        """Deletes the rows that none of the last ``keep`` versions names, and says which folders."""
        live = {r["batch"] for n in self.versions()[-keep:] for r in self.open(n).places.select("batch").distinct().collect()}
        path, fs = self._path("data")
        gone = [s.getPath() for s in fs.listStatus(path) if s.getPath().getName() not in live]
        for p in gone:
            fs.delete(p, True)
        return sorted(p.getName() for p in gone)


def faults(tables: dict[str, DataFrame]) -> DataFrame:
    """fault, pack_id and n: rows of packs that are not published with them, and rows without a key."""
    out = None
    for name, key in TABLES.items():
        rows = tables[name]
        lost = rows.join(tables["packs"].select("pack_id"), "pack_id", "left_anti") if key else rows.filter("pack_id IS NULL")
        bad = [lost.groupBy("pack_id").agg(F.count(F.lit(1)).alias("n")).select(F.lit(f"{name} of an unknown pack").alias("fault"), "pack_id", "n")]
        for k in key:
            none = F.col(k).isNull() | (F.col(k).cast("string") == "")
            bad.append(rows.filter(none).groupBy("pack_id").agg(F.count(F.lit(1)).alias("n")).select(F.lit(f"{name} without {k}").alias("fault"), "pack_id", "n"))
        for b in bad:
            out = b if out is None else out.unionByName(b)
    return out
