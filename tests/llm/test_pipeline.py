"""The pipeline, stage by stage, against brute force over what its predecessor kept."""

import random
import string
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from skerry.llm import nearcopies
from skerry.llm.common import may_hold
from test_findings import shingles, similar
from test_operators import SF, check_packed, components, ids_of, words


@pytest.fixture(scope="module")
def kept(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs.collect()]
    for _, f in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stage(f(spark, docs, SF), "test")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        out.append(docs.collect())
    return out, docs


def test_stages(spark, kept):
    (start, known, deduped, distinct, clean), last = kept
    assert len(known) >= 0.97 * len(start)
    assert {r.doc_id for r in deduped} == {r.doc_id for r in known}
    texts = {r.doc_id: r.text or "" for r in deduped}
    of = components(list(texts), lambda a, b: similar(texts[a], texts[b]))
    assert {r.doc_id for r in distinct} == set(of.values())
    wins = {tuple(w[k : k + 10]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() for w in [words(r.text)] for k in range(len(w) - 9)}
    dirty = {r.doc_id for r in distinct for w in [words(r.text)] if any(tuple(w[k : k + 10]) in wins for k in range(len(w) - 9))}
    assert {r.doc_id for r in clean} == {r.doc_id for r in distinct} - dirty
    rows = corpus_pipeline.STAGES[-1][1](spark, last, SF).collect()
    check_packed(rows, dict(zip([r.doc_id for r in clean], ids_of([r.text for r in clean]), strict=True)), 2048)


def test_run(spark, kept):
    rows = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in kept[0][-1]}




def test_texts_that_stay_are_not_shuffled(spark):
    r = random.Random(4)
    texts = ["".join(r.choices(string.ascii_letters, k=2000)) for _ in range(2000)]
    docs = spark.createDataFrame([(None if k % 100 == 1 else k, t) for k, t in enumerate(texts)], "doc_id int, text string")
    docs = corpus_pipeline.stage(docs, "test")
    gone = docs.filter("doc_id % 100 = 0 or doc_id is null and text < 'N'").select(F.col("doc_id").cast("long").alias("doc_id"), nearcopies.text_key().alias("key"))

    def shuffled():
        spark._jsc.sc().listenerBus().waitUntilEmpty(10_000)
        return spark._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()

    before = shuffled()
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        got = corpus_pipeline._without(docs, gone).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert shuffled() - before < sum(map(len, texts)) / 10
    assert sorted(x.text for x in got) == sorted(t for k, t in enumerate(texts) if k % 100 and not (k % 100 == 1 and t < "N"))


def test_long_texts_of_frequent_passages_are_told_apart_by_their_bitmaps(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choices("abcdefghij", k=6))
    base = [word() for _ in range(4000)]
    texts = [base, base[:2000] + [word() for _ in range(2000)], [*base[:3900], *(word() for _ in range(100))], base[:2040], base[:2060], ["one"], base * 20 + [word() for _ in range(80_000)]]
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
    rows = nearcopies.sketches(docs, 5).localCheckpoint()
    of = {x.key: x.doc_id for x in rows.collect()}
    pairs = spark.createDataFrame([(u, v) for u in of for v in of if of[u] < of[v]], "u long, v long")
    assert {(of[x.u], of[x.v]) for x in nearcopies._possible(pairs, rows, Fraction(4, 5)).collect()} == {(0, 2), (3, 4)}
    assert {(of[x.u], of[x.v]) for x in nearcopies._verified(nearcopies._possible(pairs, rows, Fraction(4, 5)), docs.withColumn("key", nearcopies.text_key()), 5, Fraction(4, 5)).collect()} == {(0, 2), (3, 4)}


def test_bitmaps_of_two_lengths_never_rule_out_similar_texts(spark):
    r = random.Random(6)
    word = lambda: "".join(r.choices("abcdefghij", k=6))
    texts = []
    for size in (1000, 1030, 2000, 2060, 4090):
        base = [word() for _ in range(size)]
        texts += [" ".join(base), " ".join(base + [word() for _ in range(size // 6)]), " ".join(base[size // 5 :])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = nearcopies.sketches(docs, 5).localCheckpoint()
    of = {x.key: x.doc_id for x in rows.collect()}
    pairs = spark.createDataFrame([(u, v) for u in of for v in of if of[u] < of[v]], "u long, v long")
    for s in (Fraction(4, 5), Fraction(3, 10)):
        left = {(of[x.u], of[x.v]) for x in nearcopies._possible(pairs, rows, s).collect()}
        sets = [shingles(t) for t in texts]
        alike = {(a, b) for a in range(len(texts)) for b in range(a + 1, len(texts)) if len(sets[a] & sets[b]) >= s * len(sets[a] | sets[b])}
        assert alike and alike <= left


def test_filter(spark):
    rows = spark.createDataFrame([(k if k % 7 else None, k * k) for k in range(5000)], "a int, b long")
    other = spark.createDataFrame([(k if k % 7 else None, k * k + 1) for k in range(5000)], "a long, b long")
    assert rows.filter(~may_hold(rows, "a", "b")).count() == 0
    assert rows.select(F.col("a").cast("long"), "b").filter(~may_hold(rows, "a", "b")).count() == 0
    assert other.filter(may_hold(rows, "a", "b")).count() < 100
    assert other.filter(may_hold(rows.limit(0), "a", "b")).count() == 0
