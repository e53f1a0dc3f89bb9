"""Edges and scale of the operators: nulls, repeats, empty tables, long texts, many groups, and plans."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from test_findings import best_fit_decreasing, similar
from test_operators import SF, components, fingerprint, naive, sentence, words

import corpus_pipeline
from skerry.llm import decontaminate, gif, langid, linededup, packing, pii, sharding, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def row(d, t, lang="en"):
    return (d, t, lang, "s", len(t or ""))


# Lines


def test_line_dedup_null_ids_and_repeated_rows(spark):
    line = "a line that is long enough to be counted as one here"
    rows = [(None, f"x\n{line}"), (None, f"x\n{line}"), (None, line), (1, line), (1, line), (2, f"{line}\n{line}\ny"), (3, line), (3, f"{line} "), (4, None), (9, f"z\n{line}\n{line}")]
    got = Counter((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == Counter([(None, "x", 2, 1), (None, "x", 2, 1), (None, "", 1, 1), (1, "", 1, 1), (1, "", 1, 1), (2, "y", 3, 2), (3, "", 1, 1), (3, "", 1, 1), (4, None, 1, 0), (9, f"z\n{line}\n{line}", 3, 0)])
    four = linededup.dedup_lines(spark.createDataFrame(rows[:-1], "doc_id long, text string")).filter("n_dropped > 0")
    assert four.count() == 0  # null, 1, 2 and 3 are four documents


def test_a_batch_meets_runs_without_shuffling_them(spark):
    store = linededup.LineRuns(spark, settled=2, fanout=9)
    batch = spark.range(5000).selectExpr("id % 1000 as k1")
    store.add(batch)
    store.add(batch.filter("k1 % 2 = 0"))
    with linededup._sorted_scans(spark):
        plan = store.unsettled(batch)._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("SortMergeJoin") == 2 and plan.count("Exchange") == 1 and plan.count("Sort [") <= 1
    assert plan.index("Exchange") > plan.index("HashAggregate")  # counted before the one shuffle
    assert plan.count("partial_count") == 1 and "partial_count" in plan[plan.index("Exchange") :]
    assert store.unsettled(batch).count() == 0 and store.frequent().count() == 1000
    store.close()
    assert store.levels == [] and not [t for t in spark.catalog.listTables() if t.name.startswith("skerry_run")]


@pytest.mark.parametrize("fanout", [2, 3, 9])
def test_counts_add_up_over_runs_of_all_levels(spark, fanout):
    store, r, total = linededup.LineRuns(spark, settled=5, fanout=fanout), random.Random(fanout), Counter()
    for _ in range(5):
        lines = [r.randrange(3000) for _ in range(3000)]
        total.update(lines)
        store.add(spark.createDataFrame([(k,) for k in lines], "k1 long"))
    assert {x.k1 for x in store.frequent().collect()} == {k for k, n in total.items() if n >= 5}
    store.close()


# GIF


def test_gif_long_texts_nulls_and_the_feature(spark):
    r = random.Random(4)
    rows = [(None, "nobody"), (1, None), (1, None), (2, sentence(30_000, r)), (3, "é" * 70_000), (4, "x" * 65_536), (5, "y" * 65_537)]
    got = gif.store_as_gif(spark.createDataFrame([(*x, "m") for x in rows], "doc_id long, text string, media string")).collect()
    assert Counter(x.doc_id for x in got) == Counter(d for d, _ in rows)
    texts = defaultdict(list)
    for d, t in rows:
        texts[d].append((t or "").encode())
    for x in got:
        raw = texts[x.doc_id][0]
        payload = raw + bytes(-len(raw) % 64 or (64 if not raw else 0))
        assert (x.n_bytes, x.payload_sha256, x.tail_crc32) == (len(raw), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        frames = -(-len(payload) // (gif.WIDTH * gif.ROWS))
        levels = [sum(32 * k <= b < 32 * k + 32 for b in payload) for k in range(8)]
        assert x.feature == f"{frames}:{frames * 10 * gif.DELAY_CS}:" + ",".join(map(str, levels))
    assert max(x.n_frames for x in got) > 2
    assert gif.store_as_gif(spark.createDataFrame([], SCHEMA)).count() == 0 and gif.decode_frames(gif.store_as_gif(spark.createDataFrame([], SCHEMA))).count() == 0


# Shards


def test_hypergeometric_beyond_numpy(monkeypatch):
    import math

    rows = [10**10 // 500] * 499 + [10**10 // 500 + 7]
    m = sharding.communication_matrix(rows, 7, 5)
    totals = [sum(c) for c in zip(*m, strict=True)]
    assert [sum(x) for x in m] == rows and sum(totals) == sum(rows) and max(totals) - min(totals) <= 1
    mean, var = rows[0] / 7, rows[0] * (1 / 7) * (6 / 7)
    assert all(abs(x - mean) < 7 * var**0.5 for line in m[:-1] for x in line)
    assert 0.8 < np.var([line[0] for line in m[:-1]]) / var < 1.25
    for a, b, n in ((125 * 10**6, 10**9, 1000), (10**9, 7 * 10**9, 1000), (10**12, 1, 10**12), (0, 5, 3), (5, 0, 3), (10**11, 10**11, 0)):
        x = sharding.hypergeometric(np.random.Generator(np.random.PCG64(1)), a, b, n)
        assert max(0, n - b) <= x <= min(a, n)
    monkeypatch.setattr(sharding, "NUMPY_BOUND", 0)  # the way beyond the bound, on numbers whose law is known
    rng = np.random.Generator(np.random.PCG64(3))
    for good, bad, n in ((30, 50, 25), (300, 500, 401), (7, 3, 4)):
        seen, chi, cells = Counter(sharding.hypergeometric(rng, good, bad, n) for _ in range(20_000)), 0.0, 0
        for k in range(max(0, n - bad), min(good, n) + 1):
            want = 20_000 * math.comb(good, k) * math.comb(bad, n - k) / math.comb(good + bad, n)
            if want > 20:
                chi, cells = chi + (seen[k] - want) ** 2 / want, cells + 1
        assert chi < cells + 5 * (2 * cells) ** 0.5


def test_the_shuffle_is_uniform_and_is_what_its_draws_say(spark):
    df = spark.range(4000).selectExpr("id as doc_id")
    first, last, near = Counter(), Counter(), 0
    for seed in range(6):
        got = {r.doc_id: (r.shard, r.slot) for r in sharding.shuffle_into_shards(df, 4, seed).collect()}
        assert sorted(got.values()) == [(s, k) for s in range(4) for k in range(1000)]
        first.update(got[d][0] for d in range(1000))
        last.update(got[d][1] // 250 for d in range(4000))
        near += sum(got[d][0] == got[d + 1][0] for d in range(3999))
    assert all(abs(n - 1500) < 170 for n in first.values()) and all(n == 6000 for n in last.values())
    assert abs(near / (6 * 3999) - 0.25) < 0.02
    places = np.array([got[d][1] for d in range(4000)], float)
    assert abs(np.corrcoef(places, np.arange(4000))[0, 1]) < 0.06


# Personal data


def test_pii_table_equals_plain_patterns_and_long_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in pii.detect(docs).collect():
        base = naive(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(pii._joined(base).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for k, _, _ in base) for kind in pii.KINDS]
        spans = [tuple(s.split(":")) for s in r.spans.split(",") if s]
        assert {(k, str(a), str(b)) for k, a, b in base} <= set(spans) and len(spans) == len(base) + r.n_added
        assert spans == sorted(spans, key=lambda s: (pii.KINDS.index(s[0]), int(s[1]), int(s[2])))
    unit = "word­s and jane [at] example [dot] com, bob@example.com 10.0.0.1 "
    got = pii.detect(spark.createDataFrame([(1, unit * 30_000)], "doc_id long, text string")).first()
    assert (got.n_email, got.n_ip, got.n_added) == (30_000, 30_000, 30_000)


def test_pii_time_follows_the_text():
    from time import process_time

    def took(n):
        text = "­" + " and ".join(f"user{k}@example.com" for k in range(n))
        start = process_time()
        assert len(pii.scan(text)[0]) == n
        return process_time() - start

    took(1000)
    assert took(16_000) < 4 * took(8_000)


def test_rewrite_maps_back_like_spans_a_character():
    r = random.Random(5)
    for _ in range(500):
        text = "".join(r.choice("abcdef") for _ in range(r.randint(1, 30)))
        rewrite, plain, spans = pii.Rewrite(text), text, [(k, k + 1) for k in range(len(text))]
        for _ in range(r.randint(1, 4)):
            cuts = sorted(r.sample(range(len(plain) + 1), min(len(plain) + 1, 2 * r.randint(0, 3))))
            edits = [(a, b, "XYZ"[: r.randint(0, 3)]) for a, b in zip(cuts[::2], cuts[1::2], strict=False)]
            out, new, at = "", [], 0
            for a, b, x in edits:
                out, new = out + plain[at:a] + x, new + spans[at:a] + (spans[a:b] if len(x) == b - a else [(spans[a][0], spans[b - 1][1])] * len(x))
                at = b
            plain, spans = out + plain[at:], new + spans[at:]
            rewrite.apply(edits)
            assert rewrite.text == plain
            for k in range(len(plain)):
                assert rewrite.source(k, k + 1) == spans[k]
            if not plain:
                break


# Language


def test_langid_many_languages_and_brute_force(spark):
    r = random.Random(6)
    letters = [chr(c) for c in range(0x4E00, 0x4E00 + 600)]
    rows, own = [], {}
    for k in range(120):
        own[f"l{k:03}"] = letters[5 * k : 5 * k + 5]
        rows += [(1000 * k + i, " ".join("".join(r.choices(own[f"l{k:03}"], k=4)) for _ in range(12)), f"l{k:03}") for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df)
    assert set(model.languages) == set(own)
    got = langid.identify(df, model, keep=("lang",)).collect()
    assert all(x.lang == x.lang_pred for x in got)
    train = [langid.ngram_counts(t) for d, t, _ in rows if zlib.crc32(str(d).encode()) % 3 != 1]
    idf = np.log((1 + len(train)) / (1 + (np.array(train) > 0).sum(axis=0))) + 1  # of all training texts
    assert np.allclose(model.idf, idf, rtol=1e-5)
    by = {x.doc_id: x for x in got}
    for d, t, _ in rows[::50]:
        v = np.log1p(langid.ngram_counts(t)) * idf
        cos = np.array(model.centroids, float) @ (v / np.linalg.norm(v))
        assert by[d].lang_pred == model.languages[int(cos.argmax())] and abs(by[d].score - cos.max()) < 1e-4


def test_langid_counts_are_whole(spark):
    text = "ab " * 70_000  # more than 65,535 of an n-gram
    seen = [d for d in range(60) if zlib.crc32(str(d).encode()) % 3 != 1]  # not held out
    df = spark.createDataFrame([(seen[0], text, "x"), (seen[1], "zz yy", "y"), (seen[2], None, "y"), (seen[3], "zz yy", None)], "doc_id long, text string, lang string")
    model = langid.fit(df)
    v = np.log1p(langid.ngram_counts(text)) * model.idf
    assert max(langid.ngram_counts(text)) > 65_535
    assert max(np.array(model.centroids) @ (v / np.linalg.norm(v))) > 0.9999


# Decontamination


@pytest.mark.parametrize("window", [1, 4, 13, 25])
def test_decontamination_with_other_windows(spark, window):
    r = random.Random(7)
    base = [sentence(r.randint(1, 300), r) for _ in range(20)]
    long = words(base[3] + " " + base[4])
    items = [(1, " ".join(long[5:45])), (2, base[7]), (3, "alpha xi")]
    docs = [(k, t) for k, t in enumerate(base)] + [(50, " ".join(long[7 : 7 + window])), (51, " ".join(long[7 : 6 + window])), (52, None)]
    got = {x.doc_id: x for x in decontaminate.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), window).collect()}
    for d, t in docs:
        ws, hit = words(t), set()
        for _, x in items:
            iw = words(x)
            g = min(window, len(iw))
            for k in range(len(iw) - g + 1):
                for p in range(len(ws) - g + 1):
                    if ws[p : p + g] == iw[k : k + g]:
                        hit |= set(range(p, p + g))
        assert got[d].n_hit == len(hit), (window, d)


# SimHash


@pytest.mark.parametrize("bits", [1, 3, 5])
def test_simhash_links_of_an_odd_radius(spark, bits):
    r, mask = random.Random(bits), (1 << 64) - 1
    fps = set()
    for _ in range(20):
        c = r.getrandbits(64)
        for _ in range(10):
            x = c
            for _ in range(r.randint(0, bits + 1)):
                x ^= 1 << r.randrange(64)
            fps.add(x - (1 << 64) if x >> 63 else x)
    want = components(sorted(fps), lambda a, b: ((a ^ b) & mask).bit_count() <= bits)
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    for cap in (1024, 2):
        edges = {(e.u, e.v) for e in simhash.links(df, bits, cap).collect()}
        assert all(((a ^ b) & mask).bit_count() <= bits for a, b in edges)
        both = edges | {(b, a) for a, b in edges}
        assert components(sorted(fps), lambda a, b, both=both: (a, b) in both) == want


def test_similarity_on_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    want = components(list(texts), lambda a, b: similar(texts[a], texts[b]))
    got = simhash.near_duplicates(docs, shingle=5, similarity=0.8).collect()
    assert {r.doc_id: r.component_id for r in got} == want and len(set(want.values())) < len(want)


# Packing


@pytest.mark.parametrize("n", [60, 400, 5000])
def test_packing_is_never_worse_than_best_fit_decreasing(n):
    r = random.Random(n)
    laws = {
        "600-900": lambda: r.randint(600, 900), "512-1020": lambda: r.randint(512, 1020), "300-500": lambda: r.randint(300, 500), "log-normal": lambda: min(2048, max(1, int(r.lognormvariate(6.3, 0.9)))),
        "1-2048": lambda: r.randint(1, 2048), "1-300": lambda: r.randint(1, 300), "200-700": lambda: r.randint(200, 700), "683-1400": lambda: r.randint(683, 1400),
        "two kinds": lambda: r.choice([r.randint(30, 90), r.randint(650, 720)]), "hot": lambda: 700 if r.random() < 0.33 else r.randint(1, 400),
    }
    better = 0
    for name, law in laws.items():
        counts = Counter(law() for _ in range(n))
        worst = best_fit_decreasing(counts, 2048)
        fit = packing.best_fit_decreasing(dict(counts), 2048)
        got = packing.pack_histogram(dict(counts))
        for patterns in (fit, got):
            used = Counter()
            for p, t in patterns:
                assert sum(p) <= 2048 and t > 0
                for x in p:
                    used[x] += t
            assert used == counts, name
        assert sum(t for _, t in fit) == worst, name
        assert packing.lower_bound(counts, 2048) <= sum(t for _, t in got) <= worst, name
        better += sum(t for _, t in got) < worst
    assert better >= 4 or n < 400


def test_a_hot_length_is_numbered_in_parts(spark):
    items = spark.range(3000).selectExpr("cast(if(id % 3 = 0, 700, 1 + id % 50) as long) as length", "id as doc_id")
    got = packing.assign(items, part_rows=64).collect()
    seqs = defaultdict(list)
    for x in got:
        seqs[x.sequence_id].append((x.offset, x.length))
    for s in seqs.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= 2048
    assert len(got) == 3000 == len({(x.sequence_id, x.offset) for x in got})
    whole = packing.assign(items).collect()
    assert len({x.sequence_id for x in whole}) == len(seqs)


# The pipeline


def test_stages_with_null_and_repeated_ids(spark):
    r = random.Random(9)
    good = [sentence(80, r) for _ in range(12)]
    near = good[0].split(" ")
    near[40] = "changed"
    rows = [row(k, t) for k, t in enumerate(good)]
    rows += [row(None, good[1] + " and more of it here"), row(None, "12 34"), row(None, "12 34"), row(3, "99 99"), row(3, sentence(70, r)), row(20, " ".join(near)), row(21, good[5]), row(5, good[5]), row(30, None), row(31, "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    known = corpus_pipeline.language_id(spark, docs, SF)
    kept = Counter((x.doc_id, x.text) for x in known.collect())
    assert kept == Counter((d, t) for d, t, *_ in rows if t and not t[0].isdigit())  # the null and repeated ids of rejected rows take no other row along
    once = corpus_pipeline.near_dedup(spark, known, SF)
    got = Counter((x.doc_id, x.text) for x in once.collect())
    want = Counter({k: 1 for k in kept if k[0] not in (20, 21)})
    assert got == want
    bench = words(good[2])[:12]
    import os
    import tempfile

    with tempfile.TemporaryDirectory() as d:
        spark.createDataFrame([("i", " ".join(bench))], "item_id string, text string").write.parquet(os.path.join(d, "benchmark.parquet"))
        clean = Counter((x.doc_id, x.text) for x in corpus_pipeline.decontamination(spark, once, d).collect())
    assert clean == Counter({k: n for k, n in got.items() if k[0] != 2})
    lines = corpus_pipeline.line_dedup(spark, docs, SF)
    assert lines.count() == len(rows) and lines.columns == docs.columns


def test_stages_of_an_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for _, f in corpus_pipeline.STAGES[:-1]:
        docs = f(spark, docs, SF)
        assert docs.count() == 0 and docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == 0


def test_near_dedup_uses_five_words(spark):
    assert (corpus_pipeline.SHINGLE, corpus_pipeline.SIMILARITY) == (5, 0.8)
    texts = [sentence(60), "b"]
    fps = {k: fingerprint(t) for k, t in enumerate(texts)}
    got = {x.doc_id: x.fp & (1 << 64) - 1 for x in simhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == fps  # the operator's own default stays four words
