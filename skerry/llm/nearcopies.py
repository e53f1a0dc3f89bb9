"""Links between texts by exact Jaccard similarity of their shingle sets: verification of proposed pairs, and prefix filtering for the pairs that nothing proposes.

Fingerprints of 64 bits can't find all texts of a similarity of 0.8: their fingerprints differ in about 10 bits, and Hamming balls of that radius hold nearly everything. So SimHash proposes what is close, and this module completes it. Two sets whose similarity is s or more share one of the first n - ceil(s n) + 1 of their n shingles, in any order that holds for all sets alike. So each text puts out that prefix of its shingles, and texts that meet under a shingle are candidates. The order is rare shingles first, as counted on a sample of texts; it decides how many candidates there are, never which pairs are linked.

A candidate is dropped by bounds that no similar pair breaks: of the sizes, of the places in the prefixes, and of the Hamming distance of two parity bitmaps, which is never more than the number of shingles that only one set has. What is left is verified with the whole sets.

What is sought are components, so a group of near copies isn't compared in all pairs: the members under a shingle are compared with their most central one first, and then only pairs whose ends no link has joined yet. These are still compared one and all.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import components, drop_path, may_hold, stage, stage_into
from .shingles import fingerprint, shingle_hashes
from .tokens import release

#: One text in SAMPLE is counted for the order of shingles, all of a small table; FREQUENT are told apart. Neither changes a result.
SAMPLE, FREQUENT = 16, 200_000
#: 64-bit words of a parity bitmap: as many bits as its set has members, in a power of 2 between these.
WORDS, MOST_WORDS = 16, 1024


def text_key(c: str = "text") -> Column:
    return F.xxhash64(F.coalesce(c, F.lit("")))


def _set(text: str | None, shingle: int):
    """The distinct shingles' hashes, ascending, as signed numbers; a text without words has a shingle of its own."""
    import numpy as np

    hashes = shingle_hashes(text, shingle)
    return np.unique(hashes.view(np.int64)) if len(hashes) else np.zeros(1, np.int64)


def sketches(documents: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, key, fp, n, bits) for each row: the text's hash, its fingerprint, the size of its set and the parity, by place, of the set's hashes modulo the bits of its bitmap."""
    import pyarrow as pa

    def run(batches):
        import numpy as np

        release()
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                fps, ns, bits = [], [], []
                for t in part.column(2):
                    hashes = shingle_hashes(t.as_py(), shingle)
                    own = np.unique(hashes) if len(hashes) else np.zeros(1, np.uint64)
                    fps.append(fingerprint(hashes))
                    ns.append(len(own))
                    size = 64 * min(MOST_WORDS, max(WORDS, 1 << (len(own) - 1).bit_length() >> 6))
                    odd = np.bincount((own % np.uint64(size)).astype(np.int64), minlength=size) & 1
                    bits.append(np.packbits(odd.astype(np.uint8)).view(np.int64))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(fps, pa.int64()), pa.array(ns, pa.int32()), pa.array(bits, pa.list_(pa.int64()))], ["doc_id", "key", "fp", "n", "bits"])
        release()

    return documents.select(F.col("doc_id").cast("long"), text_key().alias("key"), "text").mapInArrow(run, "doc_id long, key long, fp long, n int, bits array<long>")


def _sets(texts: DataFrame, shingle: int) -> DataFrame:
    """(key, hs) for each row of texts(key, text)."""
    import pyarrow as pa

    def run(batches):
        release()
        for b in batches:
            for k in range(0, b.num_rows, 64):
                part = b.slice(k, 64)
                hs = [_set(t.as_py(), shingle) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(hs, pa.list_(pa.int64()))], ["key", "hs"])
        release()

    return texts.select("key", "text").mapInArrow(run, "key long, hs array<long>")


def _prefixes(texts: DataFrame, shingle: int, s: Fraction, known) -> DataFrame:
    """(h, key, n, pos, central): the shingles by which each text is looked up; central is how frequent its shingles are on average. A task puts out equal texts once."""
    import pyarrow as pa

    a, b_ = s.numerator, s.denominator

    def run(batches):
        import numpy as np

        release()
        common, times = known.value
        seen = set()  # a number a row of the task at most
        for b in batches:
            for k in range(0, b.num_rows, 64):
                cols = [[], [], [], [], []]
                for key, t in zip(b.column(0).slice(k, 64).to_pylist(), b.column(1).slice(k, 64), strict=True):
                    if key in seen:
                        continue
                    seen.add(key)
                    hs = _set(t.as_py(), shingle)
                    n = len(hs)
                    often = np.zeros(n, np.int64)
                    if len(common):
                        at = np.minimum(np.searchsorted(common, hs), len(common) - 1)
                        often = np.where(common[at] == hs, times[at], 0)
                    p = n - (a * n + b_ - 1) // b_ + 1
                    first = hs[np.lexsort((hs, often))[:p]]
                    for c, x in zip(cols, (first, np.full(p, key), np.full(p, n), np.arange(p), np.full(p, often.mean())), strict=True):
                        c.append(x)
                if cols[0]:
                    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float32())
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), t) for c, t in zip(cols, kinds, strict=True)], ["h", "key", "n", "pos", "central"])
        release()

    return texts.select("key", "text").mapInArrow(run, "h long, key long, n int, pos int, central float")


def _frequent(texts: DataFrame, shingle: int):
    import numpy as np

    part = min(SAMPLE, max(1, texts.count() // 1024))
    hs = _sets(texts.filter(F.pmod("key", F.lit(part)) == 0), shingle).select(F.explode("hs").alias("h"))
    rows = hs.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n >= 3").orderBy(F.desc("n"), "h").limit(FREQUENT).collect()
    rows.sort()
    return np.array([r.h for r in rows], np.int64), np.array([r.n for r in rows], np.int64)


def _possible(pairs: DataFrame, texts: DataFrame, s: Fraction) -> DataFrame:
    """The distinct pairs (u, v) that sizes and bitmaps, texts(key, n, bits), don't rule out."""
    for end in ("u", "v"):
        pairs = pairs.join(texts.select(F.col("key").alias(end), F.col("n").alias(f"n_{end}"), F.col("bits").alias(f"bits_{end}")), end)
    least = F.least(F.size("bits_u"), F.size("bits_v"))
    word = lambda end, k: F.aggregate(F.sequence(k, F.size(end) - 1, least), F.lit(0).cast("long"), lambda x, i: x.bitwiseXOR(F.get(end, i)))  # noqa: E731; a bitmap folds to a smaller one
    folded = F.aggregate(F.sequence(F.lit(0), least - 1), F.lit(0), lambda x, k: x + F.bit_count(word("bits_u", k).bitwiseXOR(word("bits_v", k))))
    short = sum((F.bit_count(F.get("bits_u", k).bitwiseXOR(F.get("bits_v", k))) for k in range(WORDS)), F.lit(0))
    apart = F.when(F.greatest(F.size("bits_u"), F.size("bits_v")) == WORDS, short).otherwise(folded)
    a, b = s.numerator, s.denominator
    size = b * F.least("n_u", "n_v").cast("long") >= a * F.greatest("n_u", "n_v")
    return pairs.filter(size & ((a + b) * apart <= (b - a) * (F.col("n_u").cast("long") + F.col("n_v")))).select("u", "v")


def _verified(pairs: DataFrame, documents: DataFrame, shingle: int, s: Fraction) -> DataFrame:
    """Those of pairs, a staged table, whose texts are similar. Only their texts' sets are made."""
    made: list[str] = []
    keys = stage_into(pairs.select(F.col("u").alias("key")).unionByName(pairs.select(F.col("v").alias("key"))).distinct(), "wanted", made)
    sets = stage_into(_sets(documents.filter(may_hold(keys, "key")).join(keys, "key", "left_semi").dropDuplicates(["key"]), shingle), "sets", made)
    for end in ("u", "v"):
        pairs = pairs.join(sets.select(F.col("key").alias(end), F.col("hs").alias(f"hs_{end}")), end)
    a, b = s.numerator, s.denominator
    out = stage(pairs.filter((a + b) * F.size(F.array_intersect("hs_u", "hs_v")).cast("long") >= a * (F.size("hs_u").cast("long") + F.size("hs_v"))).select("u", "v"), "links")
    for path in made:
        drop_path(out.sparkSession, path)
    return out


def links(documents: DataFrame, texts: DataFrame, proposed: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Edges (u, v) over text keys with the same components as "Jaccard similarity of the shingle sets is `similarity` or more" has; equal texts share a key. documents needs text; texts: a row a key with n and bits; proposed: pairs (u, v) of keys that are likely to be similar, in any number."""
    documents = documents.select(text_key().alias("key"), "text")
    spark, s = documents.sparkSession, Fraction(str(similarity))
    a, b = s.numerator, s.denominator
    known = spark.sparkContext.broadcast(_frequent(documents, shingle))  # FREQUENT rows at most
    under, made = Window.partitionBy("h"), []
    met = _prefixes(documents, shingle, s, known).withColumn("lead", F.max(F.struct("central", "key", "n", "pos")).over(under)).withColumn("least", F.min("key").over(under)).withColumn("most", F.max("key").over(under))
    met = met.filter("least <> most").dropDuplicates(["h", "key"])  # as it is dealt by h, that shuffles nothing
    met = stage_into(met.select("h", "key", "n", "pos", F.col("lead.key").alias("lead"), F.col("lead.n").alias("lead_n"), F.col("lead.pos").alias("lead_pos")), "met", made)

    def near(n, m, p, q):
        n, m, p, q = (F.col(x).cast("long") for x in (n, m, p, q))
        return (b * F.least(n, m) >= a * F.greatest(n, m)) & ((a + b) * F.least(n - p, m - q) >= a * (n + m))

    first = met.filter("key <> lead").filter(near("n", "lead_n", "pos", "lead_pos")).select(F.col("lead").alias("u"), F.col("key").alias("v"))
    first = first.unionByName(proposed.select("u", "v")).distinct()
    found = _verified(stage_into(_possible(first, texts, s), "first", made), documents, shingle, s)
    root = stage_into(components(found).select(F.col("u").alias("key"), F.col("v").alias("root")), "roots", made)
    own = met.select("h", "key", "n", "pos").join(root, "key", "left").withColumn("root", F.coalesce("root", "key"))
    split = own.withColumn("least", F.min("root").over(under)).withColumn("most", F.max("root").over(under)).filter("least <> most")
    open_ = stage_into(split.select("h", "key", "n", "pos", "root"), "open", made)
    one = open_.select("h", *[F.col(c).alias(f"{c}_a") for c in ("key", "n", "pos", "root")])
    two = open_.select("h", *[F.col(c).alias(f"{c}_b") for c in ("key", "n", "pos", "root")])
    rest = one.join(two, (one["h"] == two["h"]) & (F.col("key_a") < F.col("key_b")) & (F.col("root_a") != F.col("root_b")) & near("n_a", "n_b", "pos_a", "pos_b"))
    rest = rest.select(F.col("key_a").alias("u"), F.col("key_b").alias("v")).distinct()
    found = found.unionByName(_verified(stage_into(_possible(rest, texts, s), "rest", made), documents, shingle, s))
    for path in made:
        drop_path(spark, path)
    return found
