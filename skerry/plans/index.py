"""What a snapshot stores for searches: files, chunks, postings, term statistics, symbols and vectors, all with index_version."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chunk, rank
from ..operators.snapshot import SnapshotStore
from ..scratch import new_path, stage
from ..sources.corpus import corpus_files

_stores: dict[tuple[str, str], SnapshotStore] = {}


def keyed(chunks: DataFrame) -> DataFrame:
    """key: one a chunk; place: path and lines, which the paragraphs of a file share, and which fusion goes by."""
    lines = F.concat_ws(":", "path", F.col("start_line").cast("string"), F.col("end_line").cast("string"))
    return chunks.withColumn("place", lines).withColumn("key", F.concat_ws(":", lines, "chunk_id"))


def tables(files: DataFrame) -> dict[str, DataFrame]:
    """The tables of a version of files (path, domain_id, trust_label, content, file_hash, modified_unix_ms). Chunks are staged, as three tables are made of them."""
    chunks = stage(keyed(chunk.chunks_all(files)).select("key", "place", "path", "start_line", "end_line", "content"), "chunks")
    postings, lengths, stats = rank.index_text(chunks)
    return {
        "files": files.select("path", "domain_id", "trust_label", "file_hash", "modified_unix_ms"),
        "chunks": chunks.select("key", "place", "path", "start_line", "end_line").join(lengths, "key"),
        "postings": postings,
        "stats": stats,
        "symbols": chunk.extract_symbols(files),
        "vectors": chunk.hash_embed_packed(chunks, "key", "content"),
    }


def publish(store: SnapshotStore, files: DataFrame) -> int:
    """Builds a version of files and makes it the active one."""
    version = store.stage(tables(files))
    store.publish(version)
    return version


def corpus_index(spark: SparkSession, sf_dir: str) -> SnapshotStore:
    """The store of the files of sf_dir, built once a session and state of the tables it comes from."""
    seen = spark.read.format("binaryFile").load([f"{sf_dir}/documents.parquet", f"{sf_dir}/labels.parquet"]).select("path", "length", "modificationTime")
    state = str(sorted(map(str, seen.collect())))  # a row a file of two tables
    key = (spark.sparkContext.applicationId + sf_dir, state)
    if key not in _stores:
        store = SnapshotStore(spark, new_path(spark, "index"))
        publish(store, corpus_files(spark, sf_dir))
        _stores[key] = store
    return _stores[key]
