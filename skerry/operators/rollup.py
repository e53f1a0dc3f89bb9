"""Directory roll-ups, maps and rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import ancestors, file_type


def by_dir(files: DataFrame) -> DataFrame:
    return files.withColumn("dir", F.explode(ancestors(F.col("path"))))


def dir_rollup(files: DataFrame) -> DataFrame:
    return by_dir(files).groupBy("dir").agg(F.count(F.lit(1)).alias("n_files"))


def dir_file_types(files: DataFrame, n: int = 5) -> DataFrame:
    counts = by_dir(files).groupBy("dir", file_type(F.col("path")).alias("file_type")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy("dir").orderBy(F.desc("n"), "file_type"))).filter(F.col("rank") <= n)


def dir_top_symbols(symbols: DataFrame, n: int = 8) -> DataFrame:
    counts = by_dir(symbols).groupBy("dir", "symbol_name", "symbol_kind").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy("dir").orderBy(F.desc("n"), "symbol_name", "symbol_kind"))).filter(F.col("rank") <= n)


def dir_children(files: DataFrame, n: int = 6) -> DataFrame:
    """Immediate child directories with the files below them."""
    dirs = dir_rollup(files).filter("dir <> '.'")
    parent = F.when(F.instr("dir", "/") == 0, ".").otherwise(F.regexp_replace("dir", "/[^/]*$", ""))
    out = dirs.select(parent.alias("parent"), F.substring_index("dir", "/", -1).alias("child"), "n_files")
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("parent").orderBy(F.desc("n_files"), "child"))).filter(F.col("rank") <= n)


def trust_counts(files: DataFrame) -> DataFrame:
    return by_dir(files).groupBy("dir", "trust_label").agg(F.count(F.lit(1)).alias("n"))


def focus(dir_: Column) -> Column:
    """A hint by keyword."""
    low = F.lower(dir_)
    return F.when(F.contains(low, F.lit("test")), "tests").when(F.contains(low, F.lit("doc")), "documentation").when(F.contains(low, F.lit("service")) | F.contains(low, F.lit("api")), "services").otherwise("general")


def dir_enrichment(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """One text a directory: its types, symbols and children, most frequent first. Each list has a fixed limit, so a group is small."""
    listed = lambda df, key, text: df.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", text.alias("s")))), lambda x: x["s"]), ", ").alias("l"))
    types = listed(dir_file_types(files), "dir", F.concat("file_type", F.lit(" "), F.col("n").cast("string"))).withColumnRenamed("l", "types")
    names = listed(dir_top_symbols(symbols), "dir", F.concat("symbol_kind", F.lit(" "), "symbol_name")).withColumnRenamed("l", "symbols")
    kids = listed(dir_children(files), "parent", F.concat("child", F.lit(" "), F.col("n_files").cast("string"))).select(F.col("parent").alias("dir"), F.col("l").alias("children"))
    out = dir_rollup(files).join(types, "dir", "left").join(names, "dir", "left").join(kids, "dir", "left")
    return out.select("dir", focus(F.col("dir")).alias("focus"), *[F.coalesce(c, F.lit("none")).alias(c) for c in ("types", "symbols", "children")])


def dir_overview(summaries: DataFrame, enrichments: DataFrame) -> DataFrame:
    """A directory's summary, followed by its enrichment where one is ready."""
    ready = enrichments.filter("status = 'ready'").select("dir", "enrichment")
    return summaries.join(ready, "dir", "left").select("dir", F.concat_ws("\n\n", "summary", "enrichment").alias("overview"))


def render_hits(hits: DataFrame) -> DataFrame:
    """hits: (query_id, query, rank, path, score): a markdown text a query; a query has at most as many hits as its limit."""
    line = F.format_string("## %d. `%s`\n- score: %.4f", "rank", "path", "score")
    return hits.groupBy("query_id", "query").agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("s")))).alias("ls")).select("query_id", F.concat(F.lit("# Search: "), "query", F.lit("\n"), F.array_join(F.transform("ls", lambda x: x["s"]), "\n")).alias("markdown"))
