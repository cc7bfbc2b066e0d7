"""Text tables kept as versions with a schema log.

``<root>/v=<name>/`` holds a version's Parquet files, ``<root>/_versions/<n>.json``
its column list and folder. A version number is claimed by a rename that fails
if it is taken, after the files are there; earlier versions stay readable with
the columns they had.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratebook.operators.mapping import conform
from ratebook.sinks.store import StoreConflict, _Files


class VersionedTable:
    """A table of text columns whose schema may change from version to version."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.files = _Files(spark, self.root)

    def versions(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self.files.names(f"{self.root}/_versions") if n.endswith(".json"))

    def entry(self, version: int | None = None) -> dict:
        """Folder and columns of a version, the newest unless one is given."""
        known = self.versions()
        if not known or version is not None and version not in known:
            raise KeyError(f"{self.root}: no version {version or ''}")
        return json.loads(self.files.read(self._log(version or known[-1])))

    def _log(self, version: int) -> str:
        return f"{self.root}/_versions/{version:08d}.json"

    def read(self, version: int | None = None) -> DataFrame:
        entry = self.entry(version)
        # stored under plain names: a header may hold any character
        df = self.spark.read.schema(", ".join(f"c{i} string" for i in range(len(entry["columns"])))).parquet(f"{self.root}/{entry['folder']}")
        return df.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(entry["columns"])])

    def write(self, df: DataFrame) -> int:
        """``df`` as the next version; returns its number."""
        version = max(self.versions(), default=0) + 1
        folder = f"v={version:08d}-{uuid.uuid4().hex[:8]}"
        names = df.columns
        plain = df.toDF(*[f"c{i}" for i in range(len(names))])
        plain.select(*[F.col(c).cast("string") for c in plain.columns]).write.parquet(f"{self.root}/{folder}")
        if not self.files.claim(self._log(version), json.dumps({"folder": folder, "columns": names}, ensure_ascii=False)):
            self.files.remove(f"{self.root}/{folder}")
            raise StoreConflict(f"{self.root}: another writer has made version {version}")
        return version

    def migrate(self, columns: list[str]) -> int:
        """The newest version conformed to ``columns`` and written as the next; its number is returned
        unchanged if it has these columns already."""
        known = self.versions()
        if known and self.entry()["columns"] == list(columns):
            return known[-1]
        return self.write(conform(self.read(), list(columns)))
