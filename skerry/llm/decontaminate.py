"""Benchmark decontamination by winnowing, in DataFrame operations only.

A document's k-gram hashes are winnowed: of every window of w neighbouring hashes the smallest is kept. A passage of g = k + w - 1 words that a document shares with an item has the same hashes in both, so both keep the same smallest one: joining what is kept finds every such passage. The hits are then extended: a window of g words around a shared fingerprint is compared as text, and the windows that agree are merged to spans of document words.

Documents are worked on in blocks of BLOCK words that overlap by g - 1 words, so neither a very long text nor one made of benchmark passages alone makes a row or a group that grows without bound before the last step, whose groups are one document each.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import same, stage, words

WINDOW, KGRAM, BLOCK = 10, 6, 2048


def _kgrams(window: int) -> tuple[int, int]:
    """k and w for a guarantee of `window` words."""
    k = min(KGRAM, window)
    return k, window - k + 1


def _rolled(df: DataFrame, name: str, width: int, f: Callable[[Column, Column], Column]) -> DataFrame:
    """Puts, in the array `name`, f over each `width` neighbours in place of the first of them, by doubling: a span of 2n, or less, is f of two spans of n that may overlap. Each step is a projection of its own, so that none is computed twice."""
    span = 1
    while span < width:
        step = min(span, width - span)
        n = F.greatest(F.size(name) - F.lit(step), F.lit(0))
        df = df.withColumn(name, F.zip_with(F.slice(name, F.lit(1), n), F.slice(name, F.lit(step + 1), n), f))
        span += step
    return df


def _winnowed(df: DataFrame, windows: list[int]) -> DataFrame:
    """Adds m{g}: the smallest hash of each window of g words, by the window's start."""
    names = df.columns
    df = df.withColumn("h", F.transform("ws", lambda w: F.xxhash64(w)))
    for k in sorted({_kgrams(g)[0] for g in windows}):
        df = _rolled(df.withColumn(f"h{k}", F.col("h")), f"h{k}", k, lambda x, y: F.xxhash64(x, y))
    for g in windows:
        k, w = _kgrams(g)
        df = _rolled(df.withColumn(f"m{g}", F.col(f"h{k}")), f"m{g}", w, lambda x, y: F.least(x, y))
    return df.select(*names, *[f"m{g}" for g in windows])


def _blocks(df: DataFrame, window: int, first: Column | None = None) -> DataFrame:
    """One row for each block of words: block, and ws as the block's words with the overlap of window - 1 words."""
    n = F.greatest(F.lit(1), F.ceil(F.size("ws") / F.lit(BLOCK)).cast("int"))
    df = df.select("*", F.explode(F.sequence(F.lit(0), n - 1)).alias("block")) if first is None else df
    return df.withColumn("ws", F.when(F.size("ws") > BLOCK, F.slice("ws", F.col("block") * BLOCK + 1, F.lit(BLOCK + window - 1))).otherwise(F.col("ws")))


def contamination(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Returns one row per document row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, item_ids (array of strings, sorted), text_key (xxhash64 of the text).

    documents needs doc_id and text, benchmark item_id and text; other columns are left alone. A null or empty text has no words and is clean; an item without words matches nothing; an item of fewer than `window` words is one window. Items that repeat an id count once, rows that repeat a document give a row each. A null doc_id is a value like any other; a null item_id is left out of n_items and item_ids, while its words still hit. Either table may be empty.
    """
    items = stage(benchmark.select("item_id", words(F.col("text")).alias("ws")).filter(F.size("ws") > 0).withColumn("g", F.least(F.size("ws"), F.lit(window))), "items")
    texts = stage(items.groupBy("g", "ws").agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("ids")).withColumn("class", F.xxhash64("ws", F.lit(1))), "item-texts")  # copies of an item are one class
    windows = sorted({window} | {r.g for r in items.select("g").distinct().collect()})  # at most `window` numbers
    known = None
    for g in windows:
        own = _winnowed(texts.filter(F.col("g") == g), [g]).select(F.explode_outer(f"m{g}").alias("fp")).filter("fp is not null")  # outer: an inner one has Spark test the array's size, computed anew, at every step before
        known = own if known is None else known.unionByName(own)
    known = stage(known.distinct().withColumn("known", F.lit(True)), "item-prints")

    docs = documents.select("doc_id", F.xxhash64("text").alias("th"), words(F.col("text")).alias("ws")).withColumn("n_words", F.size("ws").cast("long"))
    prints = _winnowed(_blocks(docs, window), windows).select("doc_id", "th", "block", "n_words", F.posexplode_outer(F.array_distinct(F.concat(*[f"m{g}" for g in windows]))).alias("at", "fp"))
    base = stage(
        prints.join(known, "fp", "left").groupBy("doc_id", "th", "block").agg(F.max("n_words").alias("n_words"), F.count(F.when(F.coalesce(F.col("at"), F.lit(0)) == 0, 1)).alias("n_rows"), F.collect_set(F.when(F.col("known"), F.col("fp"))).alias("fps")),
        "prints",
    )
    hit = stage(base.filter(F.size("fps") > 0).groupBy("doc_id", "th").agg(F.collect_list(F.struct("block", "fps")).alias("blocks")), "hits")

    near = documents.select("doc_id", F.xxhash64("text").alias("th"), "text")
    near = near.join(hit, same(near, hit, "doc_id", "th")).select(near["doc_id"], near["th"], "text", "blocks")
    near = near.select("doc_id", "th", words(F.col("text")).alias("ws"), "blocks").select("doc_id", "th", "ws", F.explode("blocks").alias("b")).select("doc_id", "th", "ws", F.col("b.block").alias("block"), F.col("b.fps").alias("fps"))
    near = _winnowed(_blocks(near, window, F.lit(0)), windows)
    placed = lambda g: F.transform(f"m{g}", lambda m, i: F.struct(F.lit(g).alias("g"), i.alias("i"), m.alias("m")))
    spans = F.concat(*[F.filter(placed(g), lambda x: F.array_contains("fps", x["m"])) for g in windows])
    near = near.select("doc_id", "th", "block", "ws", F.explode_outer(spans).alias("x")).filter("x is not null").select("doc_id", "th", (F.col("block") * BLOCK + F.col("x.i")).cast("long").alias("at"), F.col("x.g").alias("g"), F.array_join(F.slice("ws", F.col("x.i") + 1, F.col("x.g")), " ").alias("window"))
    there = texts.select("class", "g", "ws", F.explode(F.sequence(F.lit(1), F.size("ws") - F.col("g") + 1)).alias("i")).select("class", "g", F.array_join(F.slice("ws", "i", "g"), " ").alias("window")).distinct()
    found = stage(near.join(there, ["g", "window"]).groupBy("doc_id", "th").agg(F.sort_array(F.collect_set(F.struct("at", "g"))).alias("spans"), F.collect_set("class").alias("classes")), "found")
    covered = F.aggregate("spans", F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end")), lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0).cast("long"), s["at"] + s["g"] - F.greatest(s["at"], a["end"]))).alias("n"), F.greatest(a["end"], s["at"] + s["g"]).alias("end")), lambda a: a["n"])
    ids = found.select("doc_id", "th", F.explode("classes").alias("class")).join(texts.select("class", "ids"), "class").groupBy("doc_id", "th").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("item_ids"))
    found = found.select("doc_id", "th", covered.alias("n_hit"))
    found = stage(found.join(ids, same(found, ids, "doc_id", "th")).select(found["doc_id"], found["th"], "n_hit", "item_ids"), "contaminated")

    rows = base.filter("block = 0").select("doc_id", "th", "n_words", "n_rows")
    out = rows.join(found, same(rows, found, "doc_id", "th"), "left").select(rows["doc_id"], rows["th"], "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_rows"))).alias("copy"))
    return out.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "item_ids", F.col("th").alias("text_key"))


def op2_decontaminate(spark, sf_dir: str) -> DataFrame:
    out = contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.drop("item_ids", "text_key")


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
#: Of the table or relation d(doc_id, text): hits, as (doc_id, item_id, at, g).
HITS_SQL = rf"""
dw AS (SELECT doc_id, {_WORDS} AS ws FROM {{documents}}),
iw AS (SELECT item_id, ws, least(len(ws), 10) AS g FROM (SELECT item_id, {_WORDS} AS ws FROM benchmark) WHERE len(ws) > 0),
iwin AS (SELECT DISTINCT item_id, g, array_to_string(ws[i:i + g - 1], ' ') AS win FROM (SELECT *, unnest(range(1, len(ws) - g + 2)) AS i FROM iw)),
dwin AS (SELECT doc_id, i, g, array_to_string(ws[i:i + g - 1], ' ') AS win FROM (SELECT doc_id, ws, g, unnest(range(1, len(ws) - g + 2)) AS i FROM dw, (SELECT DISTINCT g FROM iw))),
hit AS (SELECT doc_id, item_id, i, g FROM dwin JOIN iwin USING (g, win))"""
OP2_SQL = f"""
WITH {HITS_SQL.format(documents="documents")},
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + g)) AS p FROM (SELECT DISTINCT doc_id, i, g FROM hit)) GROUP BY doc_id),
ids AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw d LEFT JOIN n USING (doc_id) LEFT JOIN ids USING (doc_id)"""
