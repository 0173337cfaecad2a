"""Checkpoints as a log of versions: none is ever written over, and one shows only when it is whole."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.sources.tokens import plain_name


class Log:
    """A folder with a folder of tables for each version and, beside it, a manifest that names them.

    The manifest is written last, under another name, and then renamed, which the file system does in one step. A version
    without a manifest isn't there: a write that was killed leaves the one before as the latest, and the next write of the
    same number starts anew.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.root = spark, path.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _manifest(self, version: int):
        return self._path(f"{self.root}/{version:012d}.json")

    def versions(self) -> list[int]:
        """All whole versions, in order."""
        root = self._path(self.root)
        if not self._fs.exists(root):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(root)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def latest(self) -> int | None:
        return max(self.versions(), default=None)

    def write(self, version: int, tables: dict[str, DataFrame], notes: dict | None = None) -> None:
        """Write a version; one that is there already is an error."""
        if self._fs.exists(self._manifest(version)):
            raise ValueError(f"version {version} is there already")
        at = f"{self.root}/{version:012d}"
        for name, table in tables.items():
            table.write.mode("overwrite").parquet(f"{at}/{name}")
        manifest = json.dumps({"tables": {n: t.schema.json() for n, t in tables.items()}, "notes": notes or {}}, sort_keys=True)
        hidden = self._path(f"{self.root}/_{version:012d}.json")
        out = self._fs.create(hidden, True)
        out.write(manifest.encode("utf-8"))
        out.close()
        if not self._fs.rename(hidden, self._manifest(version)):
            raise ValueError(f"version {version} was written by another at the same time")

    def read(self, version: int | None = None) -> tuple[int, dict[str, DataFrame], dict] | None:
        """(version, tables, notes) of a version, the latest by default; None where there is none."""
        version = self.latest() if version is None else version
        if version is None:
            return None
        text = "\n".join(r["value"] for r in self.spark.read.text(self._manifest(version).toString()).collect())
        manifest = json.loads(text)
        from pyspark.sql.types import StructType

        read = lambda n, schema: self.spark.read.schema(StructType.fromJson(json.loads(schema))).parquet(f"{self.root}/{version:012d}/{n}")
        return version, {n: read(n, s) for n, s in manifest["tables"].items()}, manifest["notes"]

    def keep(self, most: int) -> None:
        """Delete all versions but the latest `most`: each first loses its manifest."""
        for version in self.versions()[: -most or None]:
            self._fs.delete(self._manifest(version), False)
            self._fs.delete(self._path(f"{self.root}/{version:012d}"), True)


def save_checkpoint(state: DataFrame, iteration: int, path: str) -> None:
    """A version of state (name, shape, values and what else a parameter carries), numbered by the iteration."""
    Log(state.sparkSession, path).write(iteration, {"state": state})


def load_checkpoint(spark: SparkSession, path: str, iteration: int | None = None) -> tuple[DataFrame, int]:
    """State and iteration of a version, the latest by default."""
    found = Log(spark, path).read(iteration)
    if found is None:
        raise ValueError(f"no checkpoint in {path}")
    version, tables, _ = found
    return tables["state"].withColumn("name", plain_name(F.col("name"))), version
