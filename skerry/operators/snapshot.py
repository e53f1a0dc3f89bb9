"""Versions of an index: publish, read, upsert, delete, sessions."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def publish_states(snapshots: DataFrame, version: int) -> DataFrame:
    """The states after version is published: the active one becomes obsolete."""
    return snapshots.select("version", F.when(F.col("version") == version, "active").when(F.col("state") == "active", "obsolete").otherwise(F.col("state")).alias("state"))


def next_version(snapshots: DataFrame) -> DataFrame:
    return snapshots.agg((F.coalesce(F.max("version"), F.lit(0)) + 1).alias("next_version"), F.max(F.when(F.col("state") == "active", F.col("version"))).alias("active_version"))


def read_version(tables: DataFrame, version: int) -> DataFrame:
    return tables.filter(F.col("index_version") == version)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return old.join(new, keys, "left_anti").unionByName(new)


def delete(old: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return old.join(gone, keys, "left_anti")


def pin_sessions(requests: DataFrame, snapshots: DataFrame) -> DataFrame:
    """requests: (session, ts, explicit, refresh). The snapshot of each request: the explicit version, else the pin, which the session's first request or a refresh sets to the version active at that time (snapshots: version, active_from)."""
    hours = snapshots.select(F.col("active_from").alias("from_ts"), "version")  # a row a published version
    seen = requests.join(F.broadcast(hours), F.col("from_ts") <= F.col("ts"), "left").groupBy("session", "ts", "explicit", "refresh").agg(F.max("version").alias("active"))
    w = Window.partitionBy("session").orderBy("ts")
    pin = F.when(F.col("refresh") | (F.row_number().over(w) == 1), F.col("active"))
    return seen.withColumn("pin", pin).withColumn("pinned", F.last("pin", ignorenulls=True).over(w)).select("session", "ts", F.coalesce("explicit", "pinned").alias("snapshot"), "active", (F.coalesce("explicit", "pinned") != F.col("active")).alias("stale"))


class SnapshotStore:
    """Tables in immutable folders index_version=N below root, and numbered manifests. A manifest is written under another name and renamed to the next free number, and readers take the greatest: nothing that a reader may need is ever deleted or replaced, and of two writers that race for a number one fails."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._fs = spark._jvm.org.apache.hadoop.fs.Path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _numbers(self) -> list[int]:
        found = self._fs.globStatus(self._path("manifest-*.json"))
        return sorted(int(f.getPath().getName()[len("manifest-") : -len(".json")]) for f in found or [])

    def manifest(self) -> dict:
        numbers = self._numbers()
        if not numbers:
            return {"active": None, "versions": {}}
        return json.loads("".join(r.value for r in self.spark.read.text(f"{self.root}/manifest-{numbers[-1]:010d}.json").collect()))

    def stage(self, tables: dict[str, DataFrame], embedder: str = "md5-hash-384") -> int:
        """Writes the tables of a new version and returns its number; no reader sees them yet."""
        m = self.manifest()
        version = max([0, *map(int, m["versions"])]) + 1
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{self.root}/{name}/index_version={version}")
        m["versions"][str(version)] = {"state": "staging", "embedder": embedder}
        self._put(m)
        return version

    def publish(self, version: int) -> None:
        m = self.manifest()
        for v in m["versions"].values():
            v["state"] = "obsolete" if v["state"] == "active" else v["state"]
        m["versions"][str(version)]["state"] = "active"
        m["active"] = version
        self._put(m)

    def _put(self, m: dict) -> None:
        number = max([0, *self._numbers()]) + 1
        temporary, name = self._path(f".manifest-{uuid.uuid4().hex}"), self._path(f"manifest-{number:010d}.json")
        out = self._fs.create(temporary, True)
        out.write(bytearray(json.dumps(m).encode()))
        out.close()
        if self._fs.exists(name) or not self._fs.rename(temporary, name):
            self._fs.delete(temporary, False)
            raise RuntimeError(f"another writer has put manifest {number}")

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """A table of a version, by default the active one, with the column index_version: only that version's folder is read."""
        wanted = version or self.manifest()["active"]
        return self.spark.read.option("basePath", f"{self.root}/{name}").parquet(f"{self.root}/{name}/index_version={wanted}").withColumn("index_version", F.col("index_version").cast("long"))
