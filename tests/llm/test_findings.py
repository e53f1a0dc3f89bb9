"""Whole jobs that were once done in part."""

import bisect
import random
import zlib

import numpy as np

import corpus_pipeline
from skerry.llm import langid, packing, pii


def shingles(text, n=5):
    w = text.encode().lower().split()
    return {b" ".join(w[k : k + n]) for k in range(max(1, len(w) - n + 1))}


def similar(a, b):
    a, b = shingles(a), shingles(b)
    return 5 * len(a & b) >= 4 * len(a | b)


def near_copies(r):
    """Groups whose members differ in some words, chains of copies of copies, and texts that only share a passage."""
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    out, passage = ["", " \n", "one two", "ONE two", "one"], [word() for _ in range(30)]
    for size in (2, 2, 3, 60):
        base = [word() for _ in range(r.randint(60, 200))]
        for _ in range(size):
            w = list(base)
            for _ in range(r.randint(1, 4)):
                w[r.randrange(len(w))] = word()
            out.append(" ".join(w))
    chain = [word() for _ in range(100)]
    for k in range(12):
        chain[8 * k] = word()
        out.append(" ".join(chain))
    out += [" ".join([word() for _ in range(r.randint(5, 60))] + passage) for _ in range(40)]
    return out + out[:3] + out[20:25]


def test_near_dedup_links_all_pairs_of_similarity_08(spark):
    texts = near_copies(random.Random(5))
    docs = spark.createDataFrame([(i, t, "n", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    of = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if of[a] != of[b] and similar(texts[a], texts[b]):
                low, high = sorted((of[a], of[b]))
                of = [low if x == high else x for x in of]
    got = corpus_pipeline.near_dedup(spark, docs, "").collect()
    assert sorted(r.doc_id for r in got) == sorted(set(of))
    assert len(set(of)) < len(texts) - 20


def test_each_disguise_alone_is_found():
    alone = ["192 dot 168 dot 0 dot 1", "one[dot]two[dot]three[dot]four", "192[.]168[.]0[.]1", "192(dot)168(dot)0(dot)1", "192 punkt 168 punkt 0 punkt 1", "192&#46;168&#46;0&#46;1", "192 . 168 . 0 . 1", "one[.]two[.]three[.]four", "192_dot_168_dot_0_dot_1", "zero dot oh dot null dot cero", "six point sept point oh point un"]
    for t in alone:
        for text, at in ((t, 0), (f"See {t}, thanks.", 4)):
            assert pii.scan(text) == ([], [("ip", at, at + len(t))]), text
    for t in ["john@example . com", "john@example [dot] com", "john@example&#46;com", "john@example_dot_com", "john @ example.com", "john [at] example.com", "john&#64;example.com", "john_at_example.com", "john%40example.com", "john at example dot com", "john at example . com", "john at example&#46;com", "john at mail.example punkt com"]:
        assert ("email", 0, len(t)) in pii.scan(t)[1], t
    for t in ["192.168.0.1", "john@example.com"]:
        assert pii.scan(t)[1] == []


def best_fit_decreasing(counts, size):
    rooms, n = [], 0
    for x in sorted((x for x, k in counts.items() for _ in range(k)), reverse=True):
        at = bisect.bisect_left(rooms, x)
        if at < len(rooms):
            room = rooms.pop(at)
        else:
            room, n = size, n + 1
        if room > x:
            bisect.insort(rooms, room - x)
    return n


def test_fillings_cannot_be_extended():
    r = random.Random(3)
    for _ in range(300):
        counts = {r.randint(1, 700): r.choice([1, 2, 40]) for _ in range(r.randint(1, 12))}
        room = r.randint(1, 2048)
        for f in packing.fillings(sorted(counts), dict(counts), room):
            assert all(f.count(x) <= counts[x] for x in f)
            assert not any(x <= room - sum(f) and f.count(x) < counts[x] for x in counts), (counts, room, f)


def test_a_hot_length_packs_no_worse_than_best_fit_decreasing():
    for counts in ({700: 10_000, 50: 100_000}, {700: 10_000, 50: 30_000, 33: 20_000, 900: 500}, {600: 9_000, 20: 100_000}):
        patterns = packing.pack_histogram(dict(counts), 2048)
        assert all(sum(p) <= 2048 for p, _ in patterns)
        assert all(sum(p.count(x) * n for p, n in patterns) == k for x, k in counts.items())
        assert sum(n for _, n in patterns) <= best_fit_decreasing(counts, 2048)


def k_means(own, most):
    """Spherical k-means of all rows, in one place."""
    c = own[[int((own @ own.mean(axis=0)).argmax())]]
    while len(c) < most and (own @ c.T).max(axis=1).min() < 1 - 1e-6:  # farthest first, as long as there are other texts
        c = np.vstack([c, own[(own @ c.T).max(axis=1).argmin()]])
    for _ in range(12):
        to = (own @ c.T).argmax(axis=1)
        c = np.stack([own[to == k].mean(axis=0) if (to == k).any() else c[k] for k in range(len(c))])
        c /= np.linalg.norm(c, axis=1, keepdims=True)
    return c


def test_all_texts_fit_the_model_of_languages(spark):
    """2,000 training texts of a language, of four kinds, others of which there are few, and one whose texts are equal: centroids and the least cosine are those of all of them, however the rows are dealt."""
    r = random.Random(3)
    kinds = {"a": ["abcd", "efgh", "ijkl", "mnop"], "b": ["aeiou", "xyz"], "c": ["q"]}
    rows = [(k, " ".join("".join(r.choices(r.choice(kinds[x]) if r.random() < 0.1 else kinds[x][k % len(kinds[x])], k=r.randint(2, 6))) for _ in range(r.randint(1, 15))) if x != "c" else "q q", x) for k in range(3200) for x in ("c" if k > 3195 else "b" if k % 16 == 0 else "a")]
    rows += [(4000 + k, "ab " * 400, "a") for k in range(9)]  # n-grams of more than 255 places
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df.repartition(5))
    train = [(x, langid.ngram_counts(t)) for d, t, x in rows if zlib.crc32(str(d).encode()) % 3 != 1]
    assert sum(x == "a" for x, _ in train) > 1900
    v = np.log1p(np.array([c for _, c in train])) * model.idf.astype(float)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    want = {x: k_means(v[[y == x for y, _ in train]], langid.CENTROIDS) for x in kinds}
    for x in ("a", "b", "c"):
        assert np.allclose(np.array(model.centroids)[[y == x for y in model.languages]], want[x], atol=1e-5), x
    assert model.languages == [x for x in sorted(want) for _ in want[x]] and len(want["c"]) == 1
    best = (v @ np.concatenate(list(want.values())).T).max(axis=1)
    assert abs(model.least - langid.MARGIN * np.percentile(best, 0.5)) < 1e-5
    again = langid.fit(df.repartition(3, "text"))
    assert np.array_equal(model.centroids, again.centroids) and model.least == again.least
