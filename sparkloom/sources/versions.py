"""Tables in hash buckets, with versions: a change writes only the buckets of the sources that it brings.

`data/<writing>/bucket=<b>` holds the rows of a bucket as one writing left them; `manifest/<version>.json` says which
writing each bucket is read from. A version is there once its manifest is, by one rename; until then, readers see the
one before. A writer that died leaves data that no manifest names, and the next writing of that epoch replaces it.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import shared
from .indexing import synced

FILES = 8  # of a bucket and writing, at most


class VersionedTable:
    """Rows with a key, grouped by the source they came from; buckets are by source."""

    def __init__(self, spark: SparkSession, path: str, key: str, source: str, buckets: int = 32, keep: int = 2):
        self.spark, self.path, self.key, self.source, self.buckets, self.keep = spark, path.rstrip("/"), key, source, buckets, keep

    def versions(self) -> list[str]:
        return [x for x in shared.names(self.spark, f"{self.path}/manifest") if x.endswith(".json")]

    def manifest(self, version: str | None = None) -> dict:
        """The newest one, or that of a version: schema, epoch, and the writing of each bucket that has rows."""
        found = [version] if version else self.versions()[-1:]
        return json.loads(shared.read_text(self.spark, f"{self.path}/manifest/{found[0]}")) if found else {"version": -1, "epoch": -1, "schema": None, "buckets": {}}

    def read(self, only: list[int] | None = None, manifest: dict | None = None) -> DataFrame | None:
        """The rows of a version (the newest), or of some of its buckets; None before the first change."""
        now = manifest or self.manifest()
        if now["schema"] is None:
            return None
        schema = StructType.fromJson(json.loads(now["schema"]))
        paths = [f"{self.path}/data/{writing}/bucket={b}" for b, writing in sorted(now["buckets"].items()) if only is None or int(b) in only]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col(self.source)), F.lit(self.buckets)).cast("int")

    def apply(self, new: DataFrame, epoch: int) -> list[int] | None:
        """Takes new rows as all that their sources now have, and returns the buckets that were written.

        None, and nothing changes, for an epoch that is in the table already (a replay), or where another writer was
        first. Rows that repeat a key count once. The rows that were written are read back and counted before the
        version is published. Of old versions, `keep` stay readable.
        """
        now = self.manifest()
        if epoch <= now["epoch"]:
            return None
        touched = sorted(r[0] for r in new.select(self._bucket()).distinct().collect())  # the number of buckets bounds it
        if not touched:  # an empty change: only its epoch is noted
            return [] if self._published({**now, "version": now["version"] + 1, "epoch": epoch, "schema": now["schema"] or new.schema.json()}) else None
        old = self.read(touched, now)
        merged = new.dropDuplicates([self.key]) if old is None else synced(old, new, self.key, self.source)
        writing, counted = f"e{epoch}", Observation()
        parts = merged.withColumn("bucket", self._bucket()).observe(counted, F.count("*").alias("n"))
        parts.repartition("bucket", F.pmod(F.xxhash64(self.key), F.lit(FILES))).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/{writing}")
        there = [int(x.removeprefix("bucket=")) for x in shared.names(self.spark, f"{self.path}/data/{writing}") if x.startswith("bucket=")]
        buckets = {b: w for b, w in now["buckets"].items() if int(b) not in touched} | {str(b): writing for b in there}
        after = {"version": now["version"] + 1, "epoch": epoch, "schema": merged.schema.json(), "buckets": buckets}
        if (back := self.read(there, after).count() if there else 0) != counted.get["n"]:
            raise RuntimeError(f"{counted.get['n']} rows were written to {self.path}, and {back} are there")
        return touched if self._published(after) else None

    def _published(self, manifest: dict) -> bool:
        if not shared.publish(self.spark, f"{self.path}/manifest/{manifest['version']:012d}.json", json.dumps(manifest)):
            return False
        self._cleared()
        return True

    def _cleared(self) -> None:
        """Older versions go, and then the data that no version names."""
        for old in self.versions()[: -self.keep]:
            shared.delete(self.spark, f"{self.path}/manifest/{old}")
        named = {w for v in self.versions() for w in self.manifest(v)["buckets"].values()}
        for writing in shared.names(self.spark, f"{self.path}/data"):
            if writing not in named:
                shared.delete(self.spark, f"{self.path}/data/{writing}")
