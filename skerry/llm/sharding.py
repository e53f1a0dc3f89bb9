"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix.

Rows fall into source parts by a hash. The driver draws, with a seed, how many rows of each part go to each shard: a multivariate hypergeometric draw without replacement from the shards' free places, so every part's and every shard's total is exact. Each part permutes its rows and deals them out by those counts; after the exchange each shard permutes again. A shard is permuted in buckets of the random key whose sizes are counted first, so no task sorts a whole shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

SHARDS, PART_ROWS, MIN_PARTS, FINE = 8, 1 << 18, 16, 1 << 16
#: numpy draws hypergeometric numbers itself below this many.
NUMPY_BOUND = 10**9


def hypergeometric(rng, good: int, bad: int, drawn: int) -> int:
    """How many of `drawn` of good + bad, without replacement, are good; for numbers of any size that binomials take.

    Beyond numpy's bound every item is taken with probability drawn / total, which is two binomial draws. Given how many were taken they are a uniform choice, so what is too much or too little by chance, about the square root of drawn, is drawn in the same way from the taken or from the others.
    """
    total = good + bad
    if not good or not drawn:
        return 0
    if drawn == total or not bad:
        return good if drawn == total else drawn
    if good < NUMPY_BOUND and bad < NUMPY_BOUND:
        return int(rng.hypergeometric(good, bad, drawn))
    if 2 * drawn > total:
        return good - hypergeometric(rng, good, bad, total - drawn)
    if drawn < 64:
        hit = 0
        for k in range(drawn):
            hit += int(rng.integers(total - k)) < good - hit
        return hit
    x, y = int(rng.binomial(good, drawn / total)), int(rng.binomial(bad, drawn / total))
    if x + y >= drawn:
        return x - hypergeometric(rng, x, y, x + y - drawn)
    return x + hypergeometric(rng, good - x, bad - y, drawn - x - y)


def communication_matrix(rows: list[int], shards: int, seed: int) -> list[list[int]]:
    """[part][shard]: how many rows go where. Shards' totals differ by at most one, the first ones being larger."""
    import numpy as np

    rng, total = np.random.Generator(np.random.PCG64(seed)), sum(rows)
    free = [total // shards + (k < total % shards) for k in range(shards)]
    out = []
    for n in rows:
        line, left, pool = [], n, sum(free)
        for f in free:
            pool -= f
            x = hypergeometric(rng, f, pool, left)
            line.append(x)
            left -= x
        free = [f - x for f, x in zip(free, line, strict=True)]
        out.append(line)
    return out


def _key(names: list[str], salt: int) -> Column:
    return F.xxhash64(F.lit(salt), *names)


def shuffle_into_shards(df: DataFrame, shards: int = SHARDS, seed: int = 17, key: list[str] | None = None) -> DataFrame:
    """Adds shard (int) and slot (long, gapless from 0 in each shard); columns of these names are replaced.

    key: columns that the random order hashes, by default all but maps and variants. Which of two rows that agree in them comes first is left open, so rows that repeat are dealt out like others. Nulls hash like values. An empty table gives an empty table. The same rows and seed give the same result, however they are partitioned, so a lost task can be run again.

    The input is read twice: to count FINE groups of rows, of which neighbours make up a part, and to deal the rows out. What is dealt is a staged table, which the buckets are counted on and the result is made from.
    """
    df = df.drop("shard", "slot")
    spark = df.sparkSession
    key = key or [f.name for f in df.schema.fields if f.dataType.typeName() not in ("map", "variant")]
    keyed = df.withColumn("__a", _key(key, seed)).withColumn("__b", _key(key, seed + 1)).withColumn("__part", F.pmod(F.xxhash64(F.lit(seed + 2), "__a", "__b"), F.lit(FINE)).cast("int"))
    fine = {r["__part"]: r.n for r in keyed.groupBy("__part").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most FINE rows
    total = sum(fine.values())
    parts = min(FINE, max(MIN_PARTS, -(-total // PART_ROWS)))
    counted = [0] * parts
    for p, n in fine.items():
        counted[p * parts // FINE] += n
    bounds = []  # (part, upper ranks of the shards), a row a part
    for p, line in enumerate(communication_matrix(counted, shards, seed)):
        up, at = [], 0
        for x in line:
            at += x
            up.append(at)
        bounds.append((p, up))
    bounds = F.broadcast(spark.createDataFrame(bounds, "__part int, __up array<bigint>"))  # FINE rows at most
    keyed = keyed.withColumn("__part", F.floor(F.col("__part").cast("long") * parts / FINE).cast("int"))
    rank = F.row_number().over(Window.partitionBy("__part").orderBy("__a", "__b"))
    dealt = keyed.withColumn("__rank", rank.cast("long")).join(bounds, "__part")
    dealt = dealt.withColumn("shard", F.size(F.filter("__up", lambda u: u < F.col("__rank"))))
    buckets = max(1, -(-parts // shards))
    dealt = dealt.withColumn("__bucket", F.pmod(F.shiftright("__b", 20), F.lit(buckets)).cast("int"))
    dealt = stage(dealt.select(*df.columns, "__a", "__b", "shard", "__bucket"), "dealt")
    sizes = {(r.shard, r["__bucket"]): r.n for r in dealt.groupBy("shard", "__bucket").agg(F.count(F.lit(1)).alias("n")).collect()}  # about a row a part
    firsts = []
    for s in range(shards):
        at = 0
        for b in range(buckets):
            firsts.append((s, b, at))
            at += sizes.get((s, b), 0)
    firsts = F.broadcast(spark.createDataFrame(firsts, "shard int, __bucket int, __first long"))  # about a row a part
    slot = F.row_number().over(Window.partitionBy("shard", "__bucket").orderBy("__b", "__a")).cast("long") - 1
    out = dealt.withColumn("slot", slot).join(firsts, ["shard", "__bucket"]).withColumn("slot", F.col("slot") + F.col("__first"))
    return out.select(*df.columns, "shard", "slot")


def op5_shuffle(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    out = shuffle_into_shards(rows)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
