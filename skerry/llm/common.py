"""Helpers shared by the training-data operators: word splitting, null-safe joins and connected components; and staged tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import drop_path, new_path, stage, stage_at

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Everything that is no digit, no letter of ASCII and no character beyond ASCII parts two words.
WORD_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z alone. Pure ASCII, the common case, takes the fast built-in."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def words(c: Column) -> Column:
    """The words of a text, A-Z lower-cased; no words for null."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(c, F.lit(""))), WORD_BREAK, -1), "")


def same(a: DataFrame, b: DataFrame, *names: str) -> Column:
    """Null-safe equality of columns that both have."""
    out = F.lit(True)
    for n in names:
        out = out & a[n].eqNullSafe(b[n])
    return out


#: 64-bit words of a filter at most; a fuller one lets more rows through, which is no error.
FILTER_WORDS = 1 << 20


def _place(a: Column, words: int) -> tuple[Column, Column]:
    """The word of a filter that the hash a belongs to, and up to four bits in it."""
    bits = F.lit(0).cast("long")
    for k in range(4):
        bits = bits.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(a, 32 + 6 * k).bitwiseAND(F.lit(63)).cast("int")))
    return a.bitwiseAND(F.lit(words - 1)).cast("int"), bits


def may_hold(rows: DataFrame, *names: str) -> Column:
    """A condition over tables that have the columns `names`: true for each row whose values, null among them, are in rows(names), and for few others. It is a Bloom filter in a scalar subquery, of 16 to 32 bits a row up to FILTER_WORDS, so large tables are split by it without a shuffle. Values are cast to the types that rows has. rows is read twice."""
    words = min(FILTER_WORDS, 1 << max(6, math.ceil(math.log2(max(1, rows.count()) / 4))))
    word, bits = _place(F.xxhash64(*[F.col(n).cast(rows.schema[n].dataType) for n in names]), words)
    marks = rows.select(word.alias("word"), bits.alias("bits")).unionByName(rows.sparkSession.range(words).select(F.col("id").cast("int").alias("word"), F.lit(0).cast("long").alias("bits")))
    filled = marks.groupBy("word").agg(F.bit_or("bits").alias("bits")).agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("all"))
    made = stage(filled.select(F.transform("all", lambda x: x["bits"]).alias("bits")), "filter")
    return F.get(made.scalar(), word).bitwiseAND(bits) == bits


def stage_into(df: DataFrame, name: str, made: list[str]) -> DataFrame:
    """stage(), whose path is added to made, so that it can be dropped before the session ends."""
    made.append(new_path(df.sparkSession, name))
    return stage_at(df, made[-1])


def _large_star(edges: DataFrame, made: list[str]) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = stage_into(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "star", made)
    return both.filter("v > u").join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame, made: list[str]) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()
    least = stage_into(down.groupBy("u").agg(F.min("v").alias("m")), "star", made)
    moved = down.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """Alternating large-star and small-star over edges (u, v): returns (u, v), one row for each node that isn't the smallest of its component, with that smallest node as v. Each step is a staged table, dropped when the round after it ends, so that no lineage grows, and each hub's rows can be split among tasks, because the table of minima that they meet holds one row a node."""
    spark, made = edges.sparkSession, []
    edges = stage_into(edges.select("u", "v").filter("u <> v"), "edges", made)
    before = None
    while True:
        old, made = made, []
        edges = stage_into(_small_star(stage_into(_large_star(edges, made), "large", made), made), "small", made)
        mark = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.hash("u", "v").cast("long")).alias("s")).first()
        for path in old:
            drop_path(spark, path)
        if (mark.n, mark.s) == before or not mark.n:
            for path in made[:-1]:
                drop_path(spark, path)
            return edges
        before = (mark.n, mark.s)


__all__ = ["ascii_lower", "components", "drop_path", "may_hold", "new_path", "same", "stage", "stage_into", "words"]
