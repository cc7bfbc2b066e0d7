"""Month-wise Parquet store with a manifest (K1): a write never touches what is being read.

Layout: ``<root>/v=<name>/year=YYYY/month=M/part-*.parquet`` holds what one write
has made, ``<root>/_manifests/<number>.json`` says which folder holds which month
now. A write lays its files down first and then commits: it claims the manifest
number after the one it has read, by a rename that fails if the number is taken.
Readers take the newest manifest, so they never see half a write, and a failed
job changes nothing.

A month is one folder, whole, and a merge rewrites the months it touches, so no
chain of deltas builds up: reading, and the listing of the manifests, cost the
same after 500 merges as after one. If another writer has committed meanwhile, a
merge of other months is carried over to the newer manifest; one of the same
months is done again on top of it; a full write raises ``StoreConflict``. The
``KEPT`` newest manifests stay, with all they name; older ones are removed, and
the folders that only they name (never those of a write still under way).
"""

from __future__ import annotations

import json
import re
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

from ratebook.operators.staging import written
from ratebook.operators.store import upsert
from ratebook.schemas import RATES, RATES_COLUMNS

KEY = ("base_currency", "quote_currency", "rate_date")
KEPT = 16
ATTEMPTS = 8
EPOCH = re.compile(r"(.*)e(\d+)\Z")


class StoreConflict(RuntimeError):
    """Another writer has committed since the store was read."""


class _Files:
    """The few file operations of the store, on any Hadoop file system."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self.path(root).getFileSystem(self.conf)

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def names(self, folder: str) -> list[str]:
        at = self.path(folder)
        return sorted(st.getPath().getName() for st in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def matches(self, pattern: str) -> list[str]:
        return [st.getPath().toString() for st in self.fs.globStatus(self.path(pattern)) or []]

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def claim(self, name: str, text: str) -> bool:
        """Put a whole file under ``name`` unless there is one; False if there is."""
        temp = self.path(f"{name}.{uuid.uuid4().hex}.tmp")
        out = self.fs.create(temp, False)
        out.write(bytearray(text.encode()))
        out.close()
        rename = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename")
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf)
        try:
            context.rename(temp, self.path(name), self.gateway.new_array(rename, 0))
            return True
        except Exception as error:
            self.fs.delete(temp, False)
            if "FileAlreadyExists" in str(error) or self.fs.exists(self.path(name)):
                return False
            raise

    def remove(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


class RateStore:
    """FX rate table with atomic commits and conflict checks."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")
        self.files = _Files(spark, self.root)

    # --- manifests

    def versions(self) -> list[int]:
        """Numbers of the kept manifests, ascending."""
        return sorted(int(n[:-5]) for n in self.files.names(f"{self.root}/_manifests") if re.fullmatch(r"\d+\.json", n))

    def manifest(self, number: int | None = None) -> tuple[int, dict]:
        """(number, manifest): the newest one unless a number is given; 0 and empty for a new store."""
        for _ in range(ATTEMPTS):
            numbers = self.versions()
            if not numbers:
                return 0, {"months": {}, "tags": {}}
            at = numbers[-1] if number is None else number
            try:
                return at, json.loads(self.files.read(self._manifest(at)))
            except Exception:  # removed between the listing and the read: look again
                if number is not None or self.versions()[-1:] == [at]:
                    raise
        raise StoreConflict(f"{self.root}: the manifest changes faster than it is read")

    def _manifest(self, number: int) -> str:
        return f"{self.root}/_manifests/{number:012d}.json"

    def current_path(self) -> str | None:
        """The newest manifest's path."""
        number, _ = self.manifest()
        return self._manifest(number) if number else None

    def month_folders(self) -> dict[str, str]:
        """``year=Y/month=M`` -> path of the folder that holds it now (one entry a calendar month)."""
        return {m: f"{self.root}/{v}/{m}" for m, v in self.manifest()[1]["months"].items()}

    def has_tag(self, tag: str) -> bool:
        """Whether a write with ``tag`` has been committed; of tags ``<name>e<epoch>`` the newest epoch is kept."""
        tags = self.manifest()[1]["tags"]
        epoch = EPOCH.fullmatch(tag)
        return tags.get(epoch[1], -1) >= int(epoch[2]) if epoch else tag in tags

    # --- reading

    def read(self, months: list[tuple[int, int]] | None = None, version: int | None = None) -> DataFrame:
        """The table (of a kept ``version``), or only the given (year, month) folders of it."""
        return self._read(self.manifest(version)[1], months)

    def _read(self, manifest: dict, months=None) -> DataFrame:
        held = manifest["months"]
        wanted = held if months is None else [k for k in (f"year={y}/month={m}" for y, m in months) if k in held]
        if not wanted:
            return self.spark.createDataFrame([], RATES)
        df = self.spark.read.schema(RATES).option("basePath", self.root).parquet(*[f"{self.root}/{held[m]}/{m}" for m in wanted])
        return df.select(*RATES_COLUMNS)

    # --- writing

    def write(self, df: DataFrame, tag: str | None = None) -> str:
        """K1: ``df`` replaces the table; returns the new manifest's path."""
        number, manifest = self.manifest()
        if not self._commit(number, manifest, self._lay_down(df), tag, whole=True):
            raise StoreConflict(f"{self.root}: another writer has committed")
        return self._manifest(number + 1)

    def merge(self, batch: DataFrame, now: str, ordinal: str = "_ordinal", tag: str | None = None) -> str:
        """J1 into the store: only the months of the (normalised) batch are read and written."""
        batch = written(batch, "merge-batch")
        months = [(r.year, r.month) for r in batch.select("year", "month").distinct().collect()]  # calendar months
        for _ in range(ATTEMPTS):
            number, manifest = self.manifest()
            made = self._lay_down(upsert(self._read(manifest, months), batch, now, ordinal))
            at = self._commit(number, manifest, made, tag)
            if at:
                return self._manifest(at)
            for version in set(made.values()):
                self.files.remove(f"{self.root}/{version}")
        raise StoreConflict(f"{self.root}: other writers keep changing the same months")

    def _lay_down(self, df: DataFrame) -> dict[str, str]:
        """Write the files; month -> version folder."""
        version = f"v={int(time.time() * 1000):015d}-{uuid.uuid4().hex[:8]}"
        # ranged by month and key: a month lies in one file or in few neighbouring
        # ones, and a month with very many rows is cut into several tasks
        (df.select(*RATES_COLUMNS).repartitionByRange("year", "month", *KEY).write.mode("errorifexists")
         .partitionBy("year", "month").parquet(f"{self.root}/{version}"))
        return {"/".join(p.rsplit("/", 2)[-2:]): version for p in self.files.matches(f"{self.root}/{version}/year=*/month=*")}

    def _commit(self, number: int, base: dict, made: dict[str, str], tag: str | None, whole: bool = False) -> int:
        """The number of the new manifest; 0 if another writer has changed what this write was made from."""
        newest = base
        while True:
            months = made if whole else newest["months"] | made
            tags = dict(newest["tags"])
            if tag:
                epoch = EPOCH.fullmatch(tag)
                tags[epoch[1] if epoch else tag] = int(epoch[2]) if epoch else 0
            if self.files.claim(self._manifest(number + 1), json.dumps({"months": months, "tags": tags}, sort_keys=True)):
                self._retire()
                return number + 1
            number, newest = self.manifest()
            if whole or any(newest["months"].get(m) != base["months"].get(m) for m in made):
                return 0

    def _retire(self) -> None:
        """Remove manifests beyond the ``KEPT`` newest, and the month folders that only they name."""
        numbers = self.versions()
        old, kept = numbers[:-KEPT], numbers[-KEPT:]
        if not old:
            return

        def folders(some):
            return {(m, v) for n in some for m, v in json.loads(self.files.read(self._manifest(n)))["months"].items()}
        for month, version in sorted(folders(old) - folders(kept)):
            self.files.remove(f"{self.root}/{version}/{month}")
        for n in old:
            self.files.remove(self._manifest(n))
