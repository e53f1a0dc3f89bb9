"""The engine as a library: searches, maps and states over a store, for one query at a time, with pinned sessions and a result cache."""

from __future__ import annotations

from collections import OrderedDict

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .operators.rollup import dir_rollup
from .operators.snapshot import SnapshotStore
from .plans.index import publish
from .plans.search import hybrid_search


class ResultCache:
    """Answers by query, snapshot and active version. It is emptied whole when it is full and when another snapshot is asked for."""

    def __init__(self, most: int = 256):
        self.most, self.snapshot, self.hits, self.misses = most, None, 0, 0
        self._rows: dict[tuple, list[Row]] = {}

    def get(self, query: str, snapshot: int, active: int) -> list[Row] | None:
        if snapshot != self.snapshot:
            self._rows.clear()
            self.snapshot = snapshot
        found = self._rows.get((query, snapshot, active))
        self.hits, self.misses = self.hits + (found is not None), self.misses + (found is None)
        return found

    def put(self, query: str, snapshot: int, active: int, rows: list[Row]) -> None:
        if len(self._rows) >= self.most:
            self._rows.clear()
        self._rows[query, snapshot, active] = rows


class SessionPins:
    """The version that each session reads: an explicit one, else that pinned by its first request or its last refresh. Of more than `most` sessions the one that was longest idle is forgotten. In mode per_request nothing is pinned."""

    def __init__(self, most: int = 1024, pinned: bool = True):
        self.most, self.pinned = most, pinned
        self._pins: OrderedDict[str, int] = OrderedDict()

    def resolve(self, session: str | None, active: int, explicit: int | None = None, refresh: bool = False) -> int:
        if explicit is not None:
            return explicit
        if session is None or not self.pinned:
            return active
        if refresh or session not in self._pins:
            self._pins[session] = active
        self._pins.move_to_end(session)
        while len(self._pins) > self.most:
            self._pins.popitem(last=False)
        return self._pins[session]


class Service:
    def __init__(self, spark: SparkSession, root: str, allow: list[str] | None = None, deny: list[str] | None = None, allow_hidden: bool = False):
        self.spark, self.store = spark, SnapshotStore(spark, root)
        self.policy = {"allow": allow or [], "deny": deny or [], "allow_hidden": allow_hidden}
        self.cache, self.pins = ResultCache(), SessionPins()

    def build(self, files: DataFrame) -> int:
        """Indexes files (path, domain_id, trust_label, content, file_hash, modified_unix_ms) as a new version and makes it the active one."""
        return publish(self.store, files)

    def search(self, query: str, n: int = 5, session: str | None = None, snapshot: int | None = None, refresh: bool = False) -> list[Row]:
        active = self.store.manifest()["active"]
        if active is None:
            raise LookupError("no version is published")
        version = self.pins.resolve(session, active, snapshot, refresh)
        rows = self.cache.get(query, version, active) if n == 5 else None
        if rows is None:
            q = self.spark.createDataFrame([(0, query)], "query_id long, query string")
            rows = hybrid_search(self.store, q, n, version, **self.policy).drop("query_id").orderBy("rank").collect()  # n rows
            if n == 5:
                self.cache.put(query, version, active, rows)
        return rows

    def map(self, directory: str = ".", snapshot: int | None = None) -> DataFrame:
        """The files below a directory and below each of its ancestors' children, counted."""
        dirs = dir_rollup(self.store.read("files", snapshot))
        return dirs if directory == "." else dirs.filter((F.col("dir") == directory) | F.col("dir").startswith(directory + "/"))

    def health(self) -> dict:
        m = self.store.manifest()
        return {"live": True, "ready": m["active"] is not None, "active_version": m["active"], "versions": {k: v["state"] for k, v in m["versions"].items()}, "cache_hits": self.cache.hits, "cache_misses": self.cache.misses}
