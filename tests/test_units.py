"""Assertions on small cases of our own."""

import json

from pyspark.sql import functions as F

from skerry.functions import paths as P
from skerry.functions import text as T
from skerry.operators import chunk, evaluate, policy, rank, snapshot
from skerry.plans.search import with_intents
from skerry.sources.corpus import golden_suites, history, load_config, scan_tree
from skerry.streaming import changes


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first().y


def test_globs():
    import re

    assert re.match(P.glob_regex("**/*.rs"), "a/b/c.rs") and re.match(P.glob_regex("**/*.rs"), "c.rs")
    assert re.match(P.glob_regex("src/*"), "src/a/b") and not re.match(P.glob_regex("src/*", False), "src/a/b")
    assert re.match(P.glob_regex("*.{yml,yaml}"), "x.yaml") and not re.match(P.glob_regex("a?c"), "abbc")


def test_declarations(spark):
    lines = {
        "fn run(x)": "run", "pub(crate) async fn go() {": "go", "class A:": "A", "export default function f(": "f", "pub enum E {": "E", "const K = 1": "K", "abstract class B {": "B",
        "int add(int a) {": "add", "if (x) {": None, "return call(x);": None, "x = f(y);": None, "// int f(a) {": None, "word": None, "public interface I {": "I",
    }
    df = spark.createDataFrame([(f"{k}.rs", x) for k, x in enumerate(lines)], "path string, content string")
    got = {r.path: r.symbol_name for r in chunk.extract_symbols(df).collect()}
    assert {x: got.get(f"{k}.rs") for k, x in enumerate(lines)} == lines


def test_windows_put_the_text_together_again(spark):
    text = "\n".join(f"line {k}" for k in range(95))
    rows = chunk.chunk_lines(spark.createDataFrame([("a.rs", text)], "path string, content string"), 30).orderBy("start_line").collect()
    assert "\n".join(r.content for r in rows) == text and [(r.start_line, r.end_line) for r in rows] == [(1, 30), (31, 60), (61, 90), (91, 95)]
    assert len(chunk.chunk_lines(spark.createDataFrame([("a.rs", "a\r\nb\r\n")], "path string, content string")).first().content) == 3


def test_variants_and_queries(spark):
    assert one(spark, "_issue Token", T.symbol_variants)[:4] == ["_issue Token", "_issue_Token", "issue_token", "_issue_token"]
    assert one(spark, "a_b%20c.md.md", T.normalize_query) == "a b c"


def test_recency_and_overlap(spark):
    df = spark.createDataFrame([(0,), (10**12,), (10**12 - 86400000,)], "m long").select(F.round(rank.recency_prior(F.col("m"), 10**12), 6).alias("p"))
    assert [r.p for r in df.collect()] == [1.0, 1.2, 1.025]
    assert one(spark, "src/auth_token.rs", lambda c: rank.overlap_prior(F.lit("auth tok zebra"), c, 0.3)) == 1.2


def test_rrf_prefers_agreement(spark):
    lists = spark.createDataFrame([(1, "a", 2, 1), (1, "b", 2, 2), (1, "b", 3, 1), (1, "c", 3, 2)], "query_id int, key string, list int, rank int")
    got = {r.key: r.score_rrf for r in rank.rrf(lists).collect()}
    assert max(got, key=got.get) == "b" and abs(got["b"] - (1 / 62 + 1 / 61)) < 1e-9


def test_reindex_plan_splits_bulk(spark):
    df = spark.createDataFrame([("x", f"p{k:03}", 1) for k in range(100)] + [("y", f"p{k}", k) for k in range(5)], "batch string, path string, n long")
    got = changes.reindex_plan(df, 80, 16).groupBy("batch", "lane").count().collect()
    assert {(r.batch, r.lane): r["count"] for r in got} == {("x", "hot"): 16, ("x", "deferred"): 84, ("y", "hot"): 5}


def test_stream_equals_batch(spark, tmp_path):
    rows = [(u, f"2024-01-01 {h:02}:{m:02}:00") for u in (1, 2) for h in (1, 2, 5) for m in (0, 10, 50)] + [(9, "2024-02-01 00:00:00")]
    df = spark.createDataFrame(rows, "user_id long, ts string").withColumn("ts", F.to_timestamp("ts"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = changes.debounce_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("closed").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    got = {(r.user_id, str(r.batch_start), r.n) for r in spark.table("closed").collect()}
    want = {(r.user_id, str(r.batch_start), r.n) for r in changes.debounce(df).collect() if r.user_id != 9}
    assert got == want and len(want) >= 4


def test_percentile_gate_and_gap(spark):
    v = spark.createDataFrame([("a", k) for k in range(1, 11)], "g string, v int")
    r = evaluate.nearest_rank(v, "g", "v").first()
    assert (r.p50, r.p95, r.max_value) == (6, 10, 10)
    assert evaluate.median_int(v, "g", "v").first().median == 5
    m = spark.createDataFrame([(25, 0.95, 0.7, 1.0)], "n_queries long, recall double, mrr double, symbol_hit_rate double")
    assert {r.check: r.passed for r in evaluate.release_gate(m).collect()} == {"recall": True, "mrr": False, "symbol_hit_rate": True, "n_queries": True, "all": False}
    gap = spark.createDataFrame([(1, None, None), (2, 1, 3), (3, 2, 1)], "query_id int, ours int, theirs int")
    assert {r.gap: r.n for r in evaluate.query_gap(gap).collect()} == {"semantic_miss": 1, "baseline_miss": 1, "gain": 1, "rank_lag": 1}


def test_policy(spark):
    ok, why = policy.decide(F.col("x"), ["src/**"], ["**/secret*"])
    got = [tuple(r) for r in spark.createDataFrame([(p,) for p in ("src/a", "src/secret1", "src/.git/x", "doc/a", "src/../x")], "x string").select(ok, why).collect()]
    assert got == [(True, "allow_glob"), (False, "deny_glob"), (False, "hidden"), (False, "deny_by_default"), (False, "traversal")]


def test_intents(spark):
    q = spark.createDataFrame([(1, "a = ['x']"), (2, "Foo"), (3, "explain how the cache of the index is cleared"), (4, "two words")], "query_id int, query string")
    got = {r.query_id: r for r in with_intents(q).collect()}
    assert got[1].is_config and got[2].is_symbol and got[3].is_narrative and not any((got[4].is_symbol, got[4].is_narrative, got[4].is_literal))


def test_snapshot_store_isolates_readers(spark, tmp_path):
    store = snapshot.SnapshotStore(spark, f"file://{tmp_path}/index")
    a = store.stage({"files": spark.createDataFrame([("x",)], "path string")})
    store.publish(a)
    b = store.stage({"files": spark.createDataFrame([("y",), ("z",)], "path string")})
    assert store.read("files").count() == 1
    store.publish(b)
    assert store.read("files").count() == 2 and store.read("files", a).count() == 1
    assert store.manifest()["versions"]["1"]["state"] == "obsolete"


def test_sources(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.txt").write_bytes(b"ok \xff bytes")
    assert scan_tree(spark, str(tmp_path), "*.txt").first().content == "ok � bytes"
    suite = {"schema_version": 1, "dataset_name": "d", "queries": [{"id": "1", "query": "q", "expected_paths": ["p"]}]}
    (tmp_path / "s.json").write_text("﻿" + json.dumps(suite), encoding="utf-8")
    (tmp_path / "t.template.json").write_text(json.dumps(suite))
    assert [tuple(r) for r in golden_suites(spark, str(tmp_path)).collect()] == [("d", "1", "q", ["p"], False)]


def test_a_writer_that_stops_leaves_the_published_version(spark, tmp_path):
    store = snapshot.SnapshotStore(spark, f"file://{tmp_path}/index")
    a = store.stage({"files": spark.createDataFrame([("x",)], "path string")})
    store.publish(a)
    (tmp_path / "index" / ".manifest-broken").write_text('{"active": ')  # what a lost writer leaves
    assert store.manifest()["active"] == a and store.read("files").columns == ["path", "index_version"]
    assert len(list((tmp_path / "index").glob("manifest-*.json"))) == 2
    late = snapshot.SnapshotStore(spark, f"file://{tmp_path}/index")
    numbers = late._numbers
    late._numbers = lambda: numbers()[:-1]  # a writer that hasn't seen the last one
    try:
        late._put({"active": None, "versions": {}})
        raise AssertionError("a manifest was replaced")
    except RuntimeError:
        assert store.manifest()["active"] == a


def test_stale_and_pinned_search(spark, tmp_path):
    from skerry.plans.index import publish
    from skerry.plans.search import hybrid_search

    files = lambda *rows: spark.createDataFrame([(p, "d", "trusted", c, "h", 1) for p, c in rows], "path string, domain_id string, trust_label string, content string, file_hash string, modified_unix_ms long")
    store = snapshot.SnapshotStore(spark, f"file://{tmp_path}/index")
    publish(store, files(("a.rs", "fn make_it(x)\n"), ("b.md", "old words here\n\nmore old words")))
    publish(store, files(("a.rs", "fn other(x)\n"), ("b.md", "new words here"), (".c/d.md", "new words"), ("e.rs", "def make_it(y)\n")))
    q = spark.createDataFrame([(1, "make_it"), (2, "words here"), (3, ""), (4, "old")], "query_id long, query string")
    now = {(r.query_id, r.path): r for r in hybrid_search(store, q, allow_hidden=False).collect()}
    then = {(r.query_id, r.path): r for r in hybrid_search(store, q, version=1).collect()}
    assert {k for k in now if k[0] == 1} == {(1, "e.rs")} and {k for k in then if k[0] == 1} == {(1, "a.rs")}
    assert "exact-symbol-fast-path" in now[1, "e.rs"].why_selected and now[1, "e.rs"].score_symbol == 2.0
    assert not any(r.stale for r in now.values()) and all(r.stale and r.snapshot_version == 1 and r.active_version == 2 for r in then.values())
    assert (2, "b.md") in now and not any(p.startswith(".c") for _, p in now) and not any(i == 3 for i, _ in now)
    assert (4, "b.md") in then and then[4, "b.md"].start_line == 0


def test_redaction_keeps_ranks(spark):
    hits = spark.createDataFrame([(1, 1, "a"), (1, 2, ".git/x"), (1, 3, "b")], "query_id int, rank int, path string")
    assert [(r.rank, r.path) for r in policy.redact(hits, [], []).orderBy("rank").collect()] == [(1, "a"), (3, "b")]


def test_fnv(spark):
    known = {"": 0xCBF29CE484222325, "a": 0xAF63DC4C8601EC8C, "foobar": 0x85944171F73967E8}
    for x, h in known.items():
        assert one(spark, x, T.fnv1a64) % (1 << 64) == h

    def plain(data):
        h = 0xCBF29CE484222325
        for b in data:
            h = (h ^ b) * 0x100000001B3 % (1 << 64)
        return h

    for x in ("src/é.rs", "日本", "z" * 300):
        assert one(spark, x, T.fnv1a64) % (1 << 64) == plain(x.encode())


def test_accents_and_variants(spark):
    assert one(spark, "Őå à Ǆ ﬁ ñandú ẞ", T.search_terms)[:2] == ["oa", "a"]
    assert one(spark, "Issue_Token", T.bm25_variants) == ["Issue_Token", "Issue Token"]
    assert one(spark, "ünï x", T.term_sets) == [["uni", "x"], ["n", "x"]]
    assert one(spark, "  ", T.term_sets) == [] and one(spark, "Éa É", T.embedding_tokens) == ["Éa", "É"]
    md = "# Search: q\n## 1. `a b.md`\n- score\n##2 `no`\n## none\n## `` x\n## 2. `c`d`"
    assert one(spark, md, T.hit_paths) == ["a b.md", "c"]


def test_holding(spark):
    rows = spark.createDataFrame([("abcabc", 1), ("xx", 2), (None, 3), ("", 4), ("ABC", 5)], "text string, place int")
    needles = spark.createDataFrame([(1, "abc"), (2, "bc"), (3, None), (4, ""), (5, "abc")], "query_id int, needle string")
    plain = lambda fold: {(q, p) for t, p in [("abcabc", 1), ("xx", 2), ("", 4), ("ABC", 5)] for q, n in [(1, "abc"), (2, "bc"), (4, ""), (5, "abc")] if fold(n) in fold(t)}
    for ignore, fold in ((False, str), (True, str.lower)):
        for block in (1024, 2):
            got = rank.holding(rows, "text", needles, ignore, block).collect()
            assert len(got) == len(set(got)) and {tuple(r) for r in got} == plain(fold)
    assert rank.holding(rows, "text", needles.limit(0)).count() == 0


def test_nearest_equals_brute_force(spark):
    import random

    r = random.Random(3)
    vec = lambda: sorted(r.sample(range(20), 4))
    rows = [(f"k{k:03}", vec(), [r.choice([0.5, 0.25, -0.5]) for _ in range(4)]) for k in range(300)] + [("empty", [], [])]
    qs = [(q, vec(), [1.0, 0.5, 0.5, 0.25]) for q in range(7)]
    want = set()
    for q, b, w in qs:
        scores = sorted((-round(sum(x * dict(zip(b, w, strict=True)).get(k, 0) for k, x in zip(kb, kw, strict=True)), 6), key) for key, kb, kw in rows)
        want |= {(q, key, -s, n) for n, (s, key) in enumerate(scores[:6], 1) if s < 0}
    v = spark.createDataFrame(rows, "key string, buckets array<int>, weights array<double>").repartition(5)
    q = spark.createDataFrame(qs, "query_id long, buckets array<int>, weights array<double>")
    for block in (1024, 3):
        assert {tuple(x) for x in rank.nearest(v, q, 6, block).collect()} == want
    assert rank.nearest(v, q.limit(0), 6).count() == 0 and rank.nearest(v.limit(0), q, 6).count() == 0
    dense = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 0.0, 0.0]), ("c", [0.5, 0.5])], "key string, embedding array<float>")
    asked = spark.createDataFrame([(1, [1.0, 1.0])], "query_id long, embedding array<float>")
    assert [(x.key, x.score) for x in rank.cosine_topk(dense, asked, 5).orderBy("rank").collect()] == [("a", 1.0), ("c", 1.0)]


def test_masked_mean(spark):
    df = spark.createDataFrame([([[1.0, 2.0], [3.0, 4.0], [9.0, 9.0]], [1, 1, 0]), ([[1.0, 1.0]], [0])], "t array<array<double>>, m array<int>")
    assert [r.y for r in df.select(rank.masked_mean(F.col("t"), F.col("m")).alias("y")).collect()] == [[2.0, 3.0], [0.0, 0.0]]


def test_scan_targets():
    t = policy.scan_targets
    assert t([], "r", 1) == [("r", True, 1)]
    assert t(["**"], "r", 1, children={"b": True, "A.txt": False}) == [("r/A.txt", False, 1), ("r/b", True, 1)]
    assert t(["a/**", "a/b.md", "c/*.rs"], "r", 2) == [("r/a/b.md", False, 2), ("r/c", False, 2), ("r/a", True, 2)]
    assert t(["a/*/b", "c"], "r", 1) == [("r", True, 1)]
    targets = [("a/b", False, 1), ("a", True, 5), ("c", False, 1), ("c", True, 1), ("d", False, 0)]
    assert policy.prune_ordered(targets) == [("a", True, 5), ("c", True, 1), ("d", False, 0)] and policy.prune_ordered(targets, 2) == [("a", True, 5), ("c", False, 1)]
    assert policy.prune_ordered([("c", False, 1), ("c", False, 3)]) == [("c", False, 3)]


def test_choose_queries():
    c = [("a", "p"), ("b", "p"), ("a", "q"), ("c", "q"), ("d", "q"), ("b", "r")]
    assert evaluate.choose_queries(c, 10) == [("a", "p"), ("c", "q"), ("b", "r"), ("d", "q")]
    assert evaluate.choose_queries(c, 2) == [("a", "p"), ("c", "q")] and evaluate.choose_queries(c, 0) == []

    def plain(candidates, most):
        out, symbols, paths = [], set(), set()
        for new_path in (True, False):
            for s, p in candidates:
                if len(out) < most and s not in symbols and not (new_path and p in paths):
                    out.append((s, p))
                    symbols.add(s)
                    paths.add(p)
        return out

    import random

    r = random.Random(2)
    for _ in range(300):
        c = [(r.choice("abcdef"), r.choice("pqr")) for _ in range(r.randint(0, 14))]
        for most in range(7):
            assert evaluate.choose_queries(c, most) == plain(c, most), (c, most)


def test_config_history_and_reports(spark, tmp_path):
    (tmp_path / "c.toml").write_text("[a]\nb = [1, 2]\n")
    assert load_config(str(tmp_path / "c.toml")) == {"a": {"b": [1, 2]}}
    report = spark.createDataFrame([("recall", 0.5)], "metric string, value double")
    out = str(tmp_path / "reports")
    evaluate.write_report(report, out)
    evaluate.write_report(report, out, "20240131T120000Z")
    assert spark.read.json(f"{out}/latest").first().value == 0.5 and spark.read.json(f"{out}/history/20240131T120000Z").count() == 1
    (tmp_path / "h").mkdir()
    for name in ("run_20240131T120000Z.json", "latest.json"):
        (tmp_path / "h" / name).write_text('{"x": 1}')
    got = history(spark, str(tmp_path / "h")).collect()
    assert [(str(r.run_at), r.file, r.value) for r in got] == [("2024-01-31 12:00:00", "run_20240131T120000Z.json", '{"x": 1}')]


def test_phases_count_down(spark):
    df = spark.createDataFrame([("x", f"p{k}", 10 - k) for k in range(6)], "batch string, path string, n long")
    got = changes.phases(changes.reindex_plan(df, 3, 2)).orderBy("rank").collect()
    assert [(r.hot_left, r.phase) for r in got] == [(1, "p1_hotset")] + [(0, "p3_backfill")] * 5


def test_change_kinds(spark):
    rows = [(1, "a", "Created"), (2, "a", "modified"), (1, "b", "created"), (2, "b", "REMOVED"), (1, "c", "modified"), (2, "c", "removed"), (1, "d", "removed"), (2, "d", "created")]
    got = {r.path: r.kind for r in changes.kinds(spark.createDataFrame(rows, "ts int, path string, what string")).collect()}
    assert got == {"a": "created", "b": "none", "c": "removed", "d": "modified"}


def test_service(spark, tmp_path):
    from skerry.service import ResultCache, Service, SessionPins

    files = lambda *rows: spark.createDataFrame([(p, "d", "trusted", c, "h", 1) for p, c in rows], "path string, domain_id string, trust_label string, content string, file_hash string, modified_unix_ms long")
    s = Service(spark, f"file://{tmp_path}/store")
    assert s.health()["ready"] is False
    s.build(files(("a/x.md", "alpha words"), ("b.md", "beta words")))
    assert [r.path for r in s.search("alpha", session="one")][0] == "a/x.md" and s.cache.misses == 1
    s.build(files(("c.md", "alpha later")))
    assert s.search("alpha", session="one")[0].stale and s.search("alpha", session="two")[0].path == "c.md"
    assert not s.search("alpha", session="one", refresh=True)[0].stale
    assert {r.dir for r in s.map(snapshot=1).collect()} == {".", "a"} and s.map("a", 1).count() == 1
    assert s.health()["active_version"] == 2 and s.health()["versions"]["1"] == "obsolete"
    pins = SessionPins(2)
    assert [pins.resolve(x, v) for x, v in (("a", 1), ("b", 1), ("a", 2), ("c", 2), ("b", 3), ("a", 3))] == [1, 1, 1, 2, 3, 3]
    assert SessionPins(pinned=False).resolve("a", 4) == 4 and pins.resolve("a", 9, explicit=7) == 7
    cache = ResultCache(2)
    for q in "ab":
        cache.put(q, 1, 1, [q])
    assert cache.get("a", 1, 1) is None  # the first question after a snapshot empties it
    cache.put("a", 1, 1, ["a"])
    assert cache.get("a", 1, 1) == ["a"] and cache.get("a", 2, 2) is None and cache.get("a", 1, 1) is None


def test_command_line(spark, tmp_path, capsys):
    from skerry.__main__ import main

    (tmp_path / "tree" / "src").mkdir(parents=True)
    (tmp_path / "tree" / "src" / "a.rs").write_text("fn find_me(x) {\n}\n")
    (tmp_path / "tree" / "n.md").write_text("notes of the day")
    store = f"file://{tmp_path}/store"
    main(["--store", store, "build", str(tmp_path / "tree")])
    main(["--store", store, "search", "find_me"])
    main(["--store", store, "health"])
    built, hit, health = (json.loads(x) for x in capsys.readouterr().out.strip().splitlines())
    assert built == {"version": 1} and hit["path"] == "src/a.rs" and hit["source"] == "symbol" and health["ready"]


def test_embed(spark):
    def load():
        return lambda texts: [[3.0, 4.0, 5.0] if t == "a" else [2.0] if t == "b" else [0.0, 0.0] for t in texts]

    df = spark.createDataFrame([("k1", "a"), ("k2", "b"), ("k3", None), ("k4", "z")], "key string, text string")
    got = {r.key: [round(x, 6) for x in r.embedding] for r in chunk.embed(df, "key", "text", load, 2, 2).collect()}
    assert got == {"k1": [0.6, 0.8], "k2": [1.0, 0.0]}
    assert rank.baseline_targets([], "r") == ["r"] and rank.baseline_targets(["a"] * 33, "r") == ["r"] and rank.baseline_targets(["a"], "r") == ["a"]
