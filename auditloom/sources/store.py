"""Tables that change together: rows replaced by key, and a manifest that makes a change visible as a whole.

A table's rows lie in folders by a hash of the key that all tables of a store share, such as a lead's number. A
commit writes the touched buckets anew, of all tables that change, and then publishes one small manifest that
names every table's folders; until then readers see the version before, and a writer that dies leaves
files that no version names. Versions are numbered without gaps, so of two writers that start from one version the
second fails and can try again.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class Conflict(Exception):
    """Another commit came first."""


class Store:
    """Tables (name: rows) below a folder of any file system, in so many buckets of the columns key."""

    def __init__(self, spark: SparkSession, root: str, key: str, buckets: int = 64):
        self.spark, self.root, self.key, self.buckets = spark, root.rstrip("/"), key, buckets
        hadoop = spark._jvm.org.apache.hadoop.fs
        self._path = hadoop.Path
        self._fs = hadoop.Path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    # --- versions

    def versions(self) -> list[int]:
        place = self._path(f"{self.root}/_versions")
        if not self._fs.exists(place):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(place)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def _manifest(self, version: int | None = None) -> dict:
        known = self.versions()
        if version is None and not known:
            return {"version": 0, "tables": {}}
        at = self._fs.open(self._path(f"{self.root}/_versions/{known[-1] if version is None else version}.json"))
        try:
            return json.loads(bytes(at.readAllBytes()).decode())
        finally:
            at.close()

    def _publish(self, manifest: dict) -> None:
        """Writes a manifest beside the others and gives it its number, which only one writer can."""
        jvm = self.spark._jvm
        draft, place = (self._path(f"{self.root}/_versions/{n}") for n in (f"_{uuid.uuid4().hex}", f"{manifest['version']}.json"))
        out = self._fs.create(draft, False)
        out.write(json.dumps(manifest).encode())
        out.close()
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(self._fs.makeQualified(draft), self._fs.makeQualified(place), none)
        except Exception as e:
            self._fs.delete(draft, False)
            if self._fs.exists(place):
                raise Conflict(f"version {manifest['version']} is there already") from e
            raise

    # --- rows

    def _rows(self, manifest: dict, name: str, buckets: set[int] | None = None) -> DataFrame:
        own = manifest["tables"][name]
        folders = [f"{self.root}/{f}" for b, f in own["folders"].items() if buckets is None or int(b) in buckets]
        schema = StructType.fromJson(own["schema"])
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """The rows of a table as of a version, the newest one if none is named."""
        return self._rows(self._manifest(version), name)

    def _bucket(self):
        return F.pmod(F.xxhash64(F.col(self.key)), F.lit(self.buckets)).cast("int")

    def _written(self, name: str, rows: DataFrame) -> dict[str, str]:
        """The new folder of each bucket of rows; large buckets are more files."""
        folder = f"{name}/{uuid.uuid4().hex}"
        rows.withColumn("_bucket", self._bucket()).hint("rebalance", "_bucket").write.partitionBy("_bucket").parquet(f"{self.root}/{folder}")
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.root}/{folder}"))]
        return {n.partition("=")[2]: f"{folder}/{n}" for n in names if n.startswith("_bucket=")}

    def commit(self, changes: dict[str, DataFrame], by: list[str] | None = None, keys: DataFrame | None = None) -> int:
        """Replaces rows of several tables at once and returns the new version.

        The rows that agree with one of keys in the columns by (the store's key among them) go from every table of
        changes, and the table's new rows come in. by is the store's key unless named, and keys are those that the
        new rows have. So a table whose change has no rows loses those of keys. A null key is a value. A table that
        the store does not have yet begins with its rows. Only buckets with a key in them are written.
        """
        by = by or [self.key]
        if self.key not in by:
            raise ValueError(f"rows are replaced by {self.key} at least")
        base = self._manifest()
        if keys is None:
            for rows in changes.values():
                keys = rows.select(*by) if keys is None else keys.union(rows.select(*by))
        keys = keys.select(*by).distinct()
        touched = {r[0] for r in keys.select(self._bucket()).distinct().collect()}  # as many as there are buckets at most
        gone = keys.select(F.struct(*by).alias("_gone"))
        tables = dict(base["tables"])
        for name, rows in changes.items():
            if name in tables:
                old = self._rows(base, name, touched)
                kept = old.withColumn("_own", F.struct(*by)).join(gone, F.col("_own") == F.col("_gone"), "left_anti").drop("_own")
                rows = kept.unionByName(rows.select(*old.columns))
                rows = rows.select([F.col(f.name).cast(f.dataType) for f in old.schema])
                kind, folders = tables[name]["schema"], {b: f for b, f in tables[name]["folders"].items() if int(b) not in touched}
            else:
                kind, folders = json.loads(rows.schema.json()), {}
            tables[name] = {"schema": kind, "folders": folders | self._written(name, rows)}
        self._publish({"version": base["version"] + 1, "tables": tables})
        return base["version"] + 1

    def delete(self, keys: DataFrame, tables: list[str] | None = None) -> int:
        """Takes the rows of keys out of all tables (or of those named) at once and returns the new version."""
        names = tables or list(self._manifest()["tables"])
        return self.commit({n: self.read(n).limit(0) for n in names}, keys=keys)

    def vacuum(self, keep: int = 2) -> int:
        """Deletes the versions but for the last keep and the folders that none of these names; returns how many folders."""
        known = self.versions()
        held = {f for v in known[-keep:] for t in self._manifest(v)["tables"].values() for f in t["folders"].values()}
        n = 0
        for name in self._manifest()["tables"]:
            for change in self._fs.listStatus(self._path(f"{self.root}/{name}")):
                folder = f"{name}/{change.getPath().getName()}"
                for b in self._fs.listStatus(change.getPath()):
                    if f"{folder}/{b.getPath().getName()}" not in held and b.isDirectory():
                        n += self._fs.delete(b.getPath(), True)
                if not any(h.startswith(f"{folder}/") for h in held):
                    self._fs.delete(change.getPath(), True)
        for v in known[:-keep]:
            self._fs.delete(self._path(f"{self.root}/_versions/{v}.json"), False)
        return n
