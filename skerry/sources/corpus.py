"""Sources: the corpus_files adapter over documents and labels, a file tree, golden suites; lookups and listings over files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import basename, directory

#: Directory and extension of a document by doc_id over 20 modulo 10.
PLACES = (("docs", ".md"), ("src", ".rs"), ("tests", "_test.py"), ("config", ".toml"), ("scripts", ".sh"), (".github/workflows", ".yml"), ("systemd", ".service"), ("assets", ".png"), ("build", ".js"), ("notes", ".txt"))
AS_OF_MS, NEWEST_MS = 1706745600000, 1706742000000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file a document: path, domain_id, trust_label, content, file_hash, size_bytes, modified_unix_ms. Text files have their line feeds doubled, code files begin with a declaration."""
    d = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    k = F.pmod(F.floor(F.col("doc_id") / 20), F.lit(10))
    pick = lambda i: F.element_at(F.array(*[F.lit(p[i]) for p in PLACES]), (k + 1).cast("int"))
    name = F.concat(F.col("lang"), F.lit("_"), F.col("source"), F.lit("_"), F.pmod("doc_id", F.lit(7)).cast("string"))
    content = (
        F.when(k.isin(0, 9), F.replace("text", F.lit("\n"), F.lit("\n\n")))
        .when(k == 1, F.concat(F.lit("pub fn "), name, F.lit("(x: u32) {\n"), "text"))
        .when(k == 2, F.concat(F.lit("def "), name, F.lit("(x):\n"), "text"))
        .when(k == 8, F.concat(F.lit("export class_"), name, F.lit(" = {\nfunction "), name, F.lit("() {\n"), "text"))
        .when(k == 3, F.concat(F.lit("# settings\nkey_"), name, F.lit(" = 1\n\nother: 2\n"), "text"))
        .otherwise(F.col("text"))
    )
    return d.join(labels, "doc_id", "left").select(
        "doc_id",
        F.concat(F.col("source"), F.lit("/"), pick(0), F.lit("/doc_"), F.col("doc_id").cast("string"), pick(1)).alias("path"),
        F.col("source").alias("domain_id"),
        F.when(F.col("toxic") == 1, "untrusted").otherwise("trusted").alias("trust_label"),
        content.alias("content"),
        F.sha2("text", 256).alias("file_hash"),
        F.octet_length("text").cast("long").alias("size_bytes"),
        (F.lit(NEWEST_MS) - F.pmod(F.col("doc_id") * 7919, F.lit(1000)) * 360000).alias("modified_unix_ms"),
    )


def scan_tree(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, content, size_bytes, modified_unix_ms) of the files below path; malformed UTF-8 is replaced, not an error."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return raw.select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("content"), F.col("length").alias("size_bytes"), F.unix_millis("modificationTime").alias("modified_unix_ms"))


def load_config(path: str) -> dict:
    """A TOML configuration, read by the driver."""
    import tomllib

    with open(path, "rb") as f:
        return tomllib.load(f)


def history(spark: SparkSession, path: str) -> DataFrame:
    """(run_at, file, value) of JSON artifacts below path whose names have a time stamp like 20240131T120000Z; others are left out."""
    raw = spark.read.text(path, wholetext=True, pathGlobFilter="*.json", recursiveFileLookup=True).select(F.substring_index(F.input_file_name(), "/", -1).alias("file"), "value")
    stamp = F.regexp_extract("file", r"([0-9]{8}T[0-9]{6}Z)", 1)
    return raw.filter(stamp != "").select(F.try_to_timestamp(F.regexp_replace(stamp, "[TZ]", ""), F.lit("yyyyMMddHHmmss")).alias("run_at"), "file", "value")


def golden_suites(spark: SparkSession, path: str) -> DataFrame:
    """(dataset_name, id, query, expected_paths, symbol_query) of the suites below path; templates are left out, and a byte order mark is read over."""
    schema = "schema_version long, dataset_name string, queries array<struct<id: string, query: string, expected_paths: array<string>, symbol_query: boolean>>"
    raw = spark.read.text(path, wholetext=True, pathGlobFilter="*.json", recursiveFileLookup=True).filter(~F.input_file_name().endswith(".template.json"))
    suite = F.from_json(F.regexp_replace("value", "^﻿", ""), schema)
    return raw.select(suite.alias("s")).select("s.dataset_name", F.explode("s.queries").alias("q")).select("dataset_name", "q.id", "q.query", "q.expected_paths", F.coalesce("q.symbol_query", F.lit(False)).alias("symbol_query"))


def first_seen(files: DataFrame, order: str = "doc_id") -> DataFrame:
    """Of rows with one path the first in order, as overlapping scan targets need."""
    return files.groupBy("path").agg(F.min_by(F.struct(*[c for c in files.columns if c != "path"]), order).alias("r")).select("path", "r.*")


def raw_lookup(files: DataFrame, paths: list[str]) -> DataFrame:
    return files.filter(F.col("path").isin(paths))


def list_children(files: DataFrame, parent: str) -> DataFrame:
    """(name, kind, n_files): the names directly below a directory."""
    below = files if parent in ("", ".") else files.filter(F.col("path").startswith(parent + "/"))
    rest = F.col("path") if parent in ("", ".") else F.expr(f"substring(path, {len(parent) + 2})")
    kind = F.when(F.instr(rest, "/") > 0, "dir").otherwise("file")
    return below.groupBy(F.substring_index(rest, "/", 1).alias("name"), kind.alias("kind")).agg(F.count(F.lit(1)).alias("n_files"))


__all__ = ["basename", "corpus_files", "directory", "first_seen", "golden_suites", "list_children", "raw_lookup", "scan_tree", "table"]
