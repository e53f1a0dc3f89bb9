"""A corpus pipeline of five stages, each one operator over all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.llm import decontaminate, langid, linededup, nearcopies, packing, simhash
from skerry.llm.common import may_hold, same, stage

#: What the near-duplicate stage takes.
SHINGLE, SIMILARITY = 5, 0.8
#: Entries of a generation of a worker's cache of encoded words: fewer than alone, as executors have held the stages before.
CACHE = 60_000


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs without the rows that have a (doc_id, key) of gone; the null doc_id is a value like others. gone is staged, so that the join's kind follows its true size, and texts that a filter of gone tells apart from it never meet it, so that they aren't shuffled."""
    gone = stage(gone.select("doc_id", "key"), "gone")
    if gone.isEmpty():
        return docs
    keyed = docs.withColumn("key", nearcopies.text_key())
    maybe = may_hold(gone, "doc_id", "key")
    met = keyed.filter(maybe)
    left = met.join(gone, same(met, gone, "doc_id", "key"), "left_anti")
    return keyed.filter(~maybe).unionByName(left).select(*docs.columns)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go: those without a letter, and those far from every language's centroids. Rows are judged one by one, by their text."""
    judged = langid.identify(docs.withColumn("key", nearcopies.text_key()), langid.fit(docs), keep=("key",))
    return _without(docs, judged.filter("rejected").select("doc_id", "key").distinct())


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays, without its repeated lines; n_chars is counted anew."""
    out = linededup.dedup_lines(docs).withColumn("n_chars", F.char_length("text").cast("long"))
    return out.select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose five-word shingles have a Jaccard similarity of 0.8 or more are linked. Of each group one stays, that with the smallest doc_id, of texts that share it that of the smallest hash; rows that repeat it, doc_id and text, stay once. Documents without a doc_id can't be told apart and stay."""
    found = stage(simhash.near_duplicates(docs, shingle=SHINGLE, similarity=SIMILARITY).filter("doc_id is not null"), "similar")
    rows = found.groupBy("root", "doc_id", "key").agg(F.count(F.lit(1)).alias("n"))
    kept = found.groupBy("root").agg(F.min(F.struct("doc_id", "key")).alias("first")).select("root", "first.*")
    gone = rows.join(kept, same(rows, kept, "root", "doc_id", "key"), "left_anti")
    twice = stage(rows.join(kept, same(rows, kept, "root", "doc_id", "key"), "left_semi").filter("n > 1").select("doc_id", "key"), "twice")
    if twice.isEmpty():
        return _without(docs, gone)
    once = docs.withColumn("key", nearcopies.text_key()).filter(may_hold(twice, "doc_id", "key")).join(twice, ["doc_id", "key"], "left_semi").dropDuplicates(["doc_id", "key"]).select(*docs.columns)
    return _without(docs, gone.select("doc_id", "key").unionByName(twice)).unionByName(once)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go. Rows are judged one by one, by their text."""
    judged = decontaminate.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _without(docs, judged.filter("contaminated").select("doc_id", F.col("text_key").alias("key")).distinct())


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed pieces."""
    return packing.pack(docs, cache=CACHE)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing_stage),
]
#: SQL has neither the classifier nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, f in STAGES[:-1]:
        docs = stage(f(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
