"""SimHash near-duplicates by multi-index hashing.

Fingerprints are cut into segments. If two differ in at most r bits, then by the pigeonhole principle some segment differs in few: with r = m * q + a over m segments, one of the first a + 1 in at most q, or one of the others in at most q - 1. So each segment value is looked up in that segment's table together with all values of a small Hamming ball around it, and the complete distance is verified inside the join, so that only links leave it. The number of segments follows the number of fingerprints, so that a bucket holds few by chance.

Copies are collapsed first: one row for each distinct fingerprint. A bucket with more than `cap` distinct fingerprints, which a very large group of near copies makes, isn't compared in pairs. Its members and all that look into it go another exact way: each is put under every point of the ball of r / 2 bits around it. Two fingerprints share a point exactly if they differ in at most r bits, so linking each to the smallest under the same point keeps every component, with rows in proportion to the members.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import nearcopies
from .common import components, stage
from .shingles import fingerprint, shingle_hashes
from .tokens import release

SHINGLE, MAX_BITS, BUCKET_CAP = 4, 4, 1024


def fingerprints(documents: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp long) for each row of documents: the 64 bits as a signed number."""
    import pyarrow as pa

    def run(batches):
        release()
        for b in batches:
            fps = [fingerprint(shingle_hashes(t.as_py(), shingle)) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def segments(n: int, max_bits: int) -> list[tuple[int, int, int]]:
    """(lowest bit, width, radius) of each segment for n fingerprints."""
    m = min(max_bits + 1, max(2, round(64 / max(8, math.log2(max(n, 2)) + 3))))
    q, a = divmod(max_bits, m)
    out, low = [], 0
    for k in range(m):
        width = 64 // m + (k < 64 % m)
        radius = q if k <= a else q - 1
        if radius >= 0:
            out.append((low, width, radius))
        low += width
    return out


def _masks(width: int, radius: int) -> list[int]:
    out = [sum(1 << i for i in c) for r in range(radius + 1) for c in combinations(range(width), r)]
    return [x - (1 << 64) if x >= 1 << 63 else x for x in out]


def _mask_table(spark, masks: list[tuple[int, int]]) -> DataFrame:
    """(seg, mask): as many rows as balls have points, whatever the input."""
    return F.broadcast(spark.createDataFrame(masks, "seg int, mask long"))


def links(fps: DataFrame, max_bits: int = MAX_BITS, cap: int = BUCKET_CAP) -> DataFrame:
    """Edges (u, v) with the same components as "differs in at most max_bits bits" has, over the distinct fingerprints fps(fp)."""
    spark = fps.sparkSession
    segs = segments(fps.count(), max_bits)
    parts = F.array(*[F.struct(F.lit(k).alias("seg"), F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << w) - 1)).alias("val")) for k, (low, w, _) in enumerate(segs)])
    table = fps.select("fp", F.inline(parts))
    full = stage(table.groupBy("seg", "val").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > cap).select("seg", "val"), "full")
    balls = _mask_table(spark, [(k, x) for k, (_, w, r) in enumerate(segs) for x in _masks(w, r)])
    probes = table.join(balls, "seg").select("fp", "seg", F.col("val").bitwiseXOR(F.col("mask")).alias("val"))
    crowded = full.limit(1).count() > 0
    here = table.join(full, ["seg", "val"], "left_anti") if crowded else table
    a, b = probes.select("seg", "val", F.col("fp").alias("u")), here.select("seg", "val", F.col("fp").alias("v"))
    near = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= max_bits
    found = a.join(b, (a["seg"] == b["seg"]) & (a["val"] == b["val"]) & (a["u"] < b["v"]) & near).select("u", "v")
    if crowded:
        members = stage(probes.join(full, ["seg", "val"], "left_semi").select("fp").distinct(), "members")
        ball = lambda r: members.join(_mask_table(spark, [(0, x) for x in _masks(64, r)])).select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("point"))
        points = ball(max_bits // 2)
        least = stage(points.groupBy("point").agg(F.min("fp").alias("v"), F.count(F.lit(1)).alias("n")), "least")
        found = found.unionByName(points.join(least.filter("n > 1"), "point").select(F.col("fp").alias("u"), "v"))
        if max_bits % 2:  # of two that differ in an odd number of bits one reaches the point between them with a ball a bit wider
            found = found.unionByName(ball(max_bits // 2 + 1).join(least, "point").select(F.col("fp").alias("u"), "v"))
    return found.filter("u <> v").distinct()


def near_duplicates(documents: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS, cap: int = BUCKET_CAP, similarity: float | None = None) -> DataFrame:
    """Returns one row for each row of documents: doc_id, fp (long) and component_id, the smallest doc_id that links reach.

    documents needs doc_id (integer) and text. A null, empty or blank text has fingerprint 0, which links like any other; a text of fewer words than a shingle is one shingle. Ties of a bit (half the shingles) are 0. Rows that repeat a doc_id belong to the component of their own text. A null doc_id is never the smallest, and component_id is null only where a component has no doc_id. An empty table gives an empty table; extra columns are left alone.

    With similarity, texts are linked exactly if the Jaccard similarity of their sets of shingles is at least that: what the fingerprints propose is verified with the whole sets, and pairs that no radius of 64 bits can reach are found by nearcopies. The result then has the columns key, the hash of the text, and root, which tells components apart even where rows of different texts share a doc_id; texts without words link with one another alone.
    """
    if similarity is not None:
        return _similar(documents, shingle, max_bits, cap, similarity)
    fps = stage(fingerprints(documents, shingle), "fps")
    distinct = stage(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    return _named(fps, distinct, components(links(distinct.select("fp"), max_bits, cap)), "fp").select("doc_id", "fp", "component_id")


def _named(rows: DataFrame, distinct: DataFrame, root: DataFrame, node: str) -> DataFrame:
    """rows with component_id and root; distinct: (node, least doc_id), root: (u, v) of components()."""
    own = distinct.join(root.select(F.col("u").alias(node), F.col("v").alias("root")), node, "left").withColumn("root", F.coalesce("root", node))
    least = own.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(stage(own.join(least, "root").select(node, "component_id", "root"), "components"), node)


def _similar(documents: DataFrame, shingle: int, max_bits: int, cap: int, similarity: float) -> DataFrame:
    rows = stage(nearcopies.sketches(documents, shingle), "sketches")
    texts = stage(rows.groupBy("key").agg(F.min("doc_id").alias("least"), F.first(F.struct("fp", "n", "bits")).alias("s")).select("key", "least", "s.*"), "texts")  # equal texts have equal sketches
    of = stage(texts.groupBy("fp").agg(F.min("key").alias("first")), "prints")
    ends = links(of.select("fp"), max_bits, cap)
    for end in ("u", "v"):
        ends = ends.join(of.select(F.col("fp").alias(end), F.col("first").alias(f"{end}_key")), end)
    proposed = ends.select(F.col("u_key").alias("u"), F.col("v_key").alias("v")).unionByName(texts.join(of, "fp").filter("key <> first").select(F.col("first").alias("u"), F.col("key").alias("v")))
    edges = nearcopies.links(documents, texts.select("key", "n", "bits"), proposed, shingle, similarity)
    return _named(rows.select("doc_id", "key", "fp"), texts.select("key", "least"), components(edges), "key").select("doc_id", "fp", "component_id", "key", "root")


def op8_simhash(spark, sf_dir: str) -> DataFrame:
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
