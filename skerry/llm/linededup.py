"""Line deduplication over levelled sorted runs of line hashes, in DataFrame operations only.

LineRuns is the store: a batch's line hashes are counted (partially before the shuffle, so a line that a third of all documents hold is one row a task), merge-anti-joined with each run for the lines that it has settled already, and written as a new run of level 0; FANOUT runs of a level are merged into one of the next level. A run is dealt to buckets by hash and sorted within each, one file a bucket, and all runs of a store have the same buckets: so a batch is shuffled once, to those buckets, and no run that it is joined with is shuffled or sorted again. The hash is 64 bits wide and only proposes lines: every line whose hash is frequent is then counted by document under a hash of 128 bits.
"""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, drop_path, new_path, same, stage

MIN_CHARS, MIN_DOCS, BATCHES, FANOUT = 40, 5, 4, 3
SPACE = " \t\n\x0b\f\r"
#: Lets Spark rely on the order within a bucket that is one file.
SORTED_SCANS = "spark.sql.legacy.bucketedTableScan.outputOrdering"


@contextlib.contextmanager
def _sorted_scans(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(SORTED_SCANS)
    spark.conf.set(SORTED_SCANS, "true")
    try:
        yield
    finally:
        spark.conf.set(SORTED_SCANS, before)


class LineRuns:
    """Runs of (k1 long, n long): line hashes and how many rows held them, at least `settled` rows counting as settled. Each run is a bucketed table in the shared directory; a run is complete once it is in self.levels, so a batch whose job fails leaves the store as it was and can be added again."""

    def __init__(self, spark: SparkSession, settled: int = MIN_DOCS, fanout: int = FANOUT):
        self.spark, self.settled, self.fanout = spark, settled, fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        self._paths: dict[str, str] = {}

    def _write(self, run: DataFrame, level: int) -> None:
        name = f"skerry_run_{uuid.uuid4().hex}"
        path = new_path(self.spark, f"run{level}")
        with _sorted_scans(self.spark):
            run.write.bucketBy(self.buckets, "k1").sortBy("k1").option("path", path).saveAsTable(name)
        self._paths[name] = path
        self.levels += [[] for _ in range(level + 1 - len(self.levels))]
        self.levels[level].append(name)

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        drop_path(self.spark, self._paths.pop(name))

    def _merged(self, names: list[str]) -> DataFrame:
        """(k1, n) over runs, n added up. They are read as plain files: a union of bucketed tables, as Spark 4.1 plans it, claims to keep their buckets and doesn't."""
        if not names:
            return self.spark.createDataFrame([], "k1 long, n long")
        return self.spark.read.schema("k1 long, n long").parquet(*[self._paths[x] for x in names]).groupBy("k1").agg(F.sum("n").alias("n"))

    def unsettled(self, batch: DataFrame) -> DataFrame:
        """(k1, n): the counts of a batch (column k1, a row for each line) without the lines that a run has settled."""
        out = batch.groupBy("k1").agg(F.count(F.lit(1)).alias("n"))
        for name in (x for level in self.levels for x in level):
            settled = self.spark.table(name).filter(F.col("n") >= self.settled).select(F.col("k1").alias("settled"))
            out = out.join(settled.hint("merge"), (F.col("k1") == F.col("settled")) & (F.col("n") > 0), "left_anti")  # naming n keeps the join above the counting
        return out

    def add(self, batch: DataFrame) -> None:
        self._write(self.unsettled(batch), 0)
        level = 0
        while len(self.levels[level]) >= self.fanout:
            old, self.levels[level] = self.levels[level], []
            self._write(self._merged(old), level + 1)
            for name in old:
                self._drop(name)
            level += 1

    def frequent(self) -> DataFrame:
        """(k1) of the lines that at least `settled` rows of the batches so far held."""
        return self._merged([x for level in self.levels for x in level]).filter(F.col("n") >= self.settled).select("k1")

    def close(self) -> None:
        for name in [x for level in self.levels for x in level]:
            self._drop(name)
        self.levels = []


def _lines(c: Column) -> Column:
    return F.split(F.coalesce(c, F.lit("")), "\n", -1)


def dedup_lines(documents: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES) -> DataFrame:
    """Returns all columns of documents, text being what is left of it, with n_lines and n_dropped (which replace columns of these names).

    documents needs doc_id and text. A null or empty text is one empty line; the text of a row that loses nothing stays as it is, null included. A line's key has white space ([\\x20\\x09-\\x0D]) stripped at both ends and A-Z lower-cased. Keys of at least min_chars code points in at least min_docs distinct doc_ids stay in the largest doc_id that has them, every time it has them, and go elsewhere. A null doc_id counts as one document, smaller than all others. Repeated rows are treated alike, each giving a row. An empty table gives an empty table.
    """
    spark = documents.sparkSession
    key = F.btrim("line", F.lit(SPACE))
    rows = documents.select("doc_id", F.xxhash64("text").alias("th"), F.posexplode(_lines(F.col("text"))).alias("pos", "line"))
    rows = rows.select("doc_id", "th", "pos", key.alias("key")).filter(F.char_length("key") >= min_chars).withColumn("key", ascii_lower(F.col("key")))
    rows = stage(rows.select(F.xxhash64("key").alias("k1"), F.xxhash64(F.lit(1), "key").alias("k2"), "doc_id", "th", "pos", F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int").alias("batch")), "lines", ("batch",))
    store = LineRuns(spark, min_docs)
    try:
        for b in range(batches):
            store.add(rows.filter(F.col("batch") == b).select("k1"))
        often = stage(store.frequent(), "frequent")
    finally:
        store.close()
    rows = stage(rows.join(often, "k1", "left_semi").select("k1", "k2", "doc_id", "th", "pos"), "candidates")
    owners = rows.groupBy("k1", "k2", "doc_id").agg(F.lit(1).alias("one")).groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("owner")).filter(F.col("n") >= min_docs)
    owners = stage(owners.select("k1", "k2", "owner"), "owners")
    gone = rows.join(owners, ["k1", "k2"]).filter(~F.col("doc_id").eqNullSafe(F.col("owner"))).select("doc_id", "th", "pos").groupBy("doc_id", "th").agg(F.sort_array(F.collect_set("pos")).alias("gone"))

    names = [c for c in documents.columns if c not in ("n_lines", "n_dropped")]
    docs = documents.select(*names, F.xxhash64("text").alias("__th"))
    gone = stage(gone.select(F.col("doc_id").alias("__id"), F.col("th").alias("__th2"), F.col("gone").alias("__gone")), "gone")
    docs = docs.join(gone, docs["doc_id"].eqNullSafe(gone["__id"]) & (docs["__th"] == gone["__th2"]), "left")
    docs = docs.withColumn("__lines", _lines(F.col("text"))).withColumn("__bounds", F.concat(F.array(F.lit(-1)), "__gone", F.array(F.size("__lines"))))
    between = lambda i: F.slice("__lines", F.element_at("__bounds", i) + 2, F.element_at("__bounds", i + 1) - F.element_at("__bounds", i) - 1)
    left = F.array_join(F.flatten(F.transform(F.sequence(F.lit(1), F.size("__bounds") - 1), between)), "\n")
    text = F.when(F.col("__gone").isNull(), F.col("text")).otherwise(left).alias("text")
    dropped = F.when(F.col("__gone").isNull(), 0).otherwise(F.size("__gone")).cast("long")
    return docs.select(*[text if c == "text" else F.col(c) for c in names], F.size("__lines").cast("long").alias("n_lines"), dropped.alias("n_dropped"))


def op3_line_dedup(spark, sf_dir: str) -> DataFrame:
    out = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


#: Of a relation with doc_id and text: (doc_id, n_lines, n_dropped, text).
LINES_SQL = r"""
l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM {documents})),
k AS (SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
o AS (SELECT key, max(doc_id) AS owner FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
kept AS (SELECT k.doc_id, pos, line, owner IS NOT NULL AND owner <> k.doc_id AS gone FROM k LEFT JOIN o USING (key)),
deduped AS (SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS text FROM kept GROUP BY doc_id)"""
OP3_SQL = f"WITH {LINES_SQL.format(documents='documents')} SELECT doc_id, n_lines, n_dropped, sha256(text) AS kept_sha256 FROM deduped"
