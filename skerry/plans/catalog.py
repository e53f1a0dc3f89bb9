"""Every query by name, over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import text as T
from ..operators import chunk, evaluate, policy, rank, rollup, snapshot
from ..scratch import new_path
from ..sources.corpus import AS_OF_MS, corpus_files, first_seen, list_children, raw_lookup, table
from ..streaming import changes
from .index import corpus_index, keyed
from .search import full_text, hybrid_search, with_intents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

#: Queries of every intent.
LITERALS = (
    (1, "issue_token"), (2, "EN_src4_3"), (3, "def en_src1_2("), (4, "en_src1_0"), (5, "runs-on: ubuntu-latest"), (6, "[unit] description=x"), (7, "trust_label = 'x'"),
    (8, "how does the session pin a snapshot for readers"), (9, "powershell -file run.ps1"), (10, "docs for a_b_c_d schema fields in the table"), (11, "  fr_src3_1  "), (12, "the of and"), (13, "en_src4.md.md"), (14, "a%20b_c.md"), (15, "Die"), (16, "en_src2_6"),
)
ALLOW, DENY = ["*/docs/**", "*/src/*.rs", "*/tests/**", "*/notes/*.txt", "src1/**"], ["*/build/**", "**/*_7*.txt"]
DOMAIN_ROWS = [("d0", "src0", "trusted", 10), ("d1", "src1", "untrusted", 5), ("d1docs", "src1/docs", "untrusted", 3), ("d2", "src2", "trusted", 7), ("deep", "src0/docs", "trusted", 2), ("all", "src3/notes", "untrusted", 0)]
BAD_ROWS = [*DOMAIN_ROWS, ("d0", "src9", "trusted", 1), ("", "src8", "odd", 1), ("x", "", "trusted", -1), ("y", "a/../b", "trusted", 1), ("z", "src2", "trusted", 1)]


#: Queries that full text answers from some paths alone.
PUSHED = ((20, "the of .sh"), (21, "and .sh"), (22, "that powershell"))
#: Queries beside the benchmark's items in the hybrid search: symbols, one with blanks around it, pushed-down paths.
MORE = (4, 16, 11, 2, 9, 15)


def query(f):
    QUERIES[f.__name__.removeprefix("q_")] = f
    return f


def literals(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(LITERALS), "query_id long, query string")


def passages(spark: SparkSession, sf: str, n: int = 5) -> DataFrame:
    """The first n words of each benchmark item as a query."""
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.array_join(F.slice(F.split("text", " "), 1, n), " ").alias("query"))


def expected(spark: SparkSession, sf: str) -> DataFrame:
    """(query_id, path): the files that hold a sentence of 40 characters or more of an item."""
    b = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(F.split("text", r"\. ")).alias("needle")).filter("length(needle) >= 40")
    return rank.holding(corpus_files(spark, sf).select(F.replace("content", F.lit("\n\n"), F.lit("\n")).alias("content"), "path"), "content", b)


@query
def q_scan_corpus(s, d):
    return corpus_files(s, d).select("path", "domain_id", "trust_label", "file_hash", "size_bytes", "modified_unix_ms", F.length("content").alias("chars"))


@query
def q_first_seen(s, d):
    f = corpus_files(s, d).select("doc_id", "path", "file_hash")
    return first_seen(f.unionByName(f.withColumn("doc_id", F.col("doc_id") + 1000000))).select("path", "doc_id", "file_hash")


@query
def q_raw_lookup(s, d):
    return raw_lookup(corpus_files(s, d), ["src0/docs/doc_0.md", "src1/src/doc_1.rs", "src1/src/doc_21.rs", "src2/x"]).select("path", "content")


@query
def q_list_children(s, d):
    return list_children(corpus_files(s, d), "src1")


@query
def q_file_types(s, d):
    return corpus_files(s, d).groupBy(P.file_type(F.col("path")).alias("file_type")).agg(F.count(F.lit(1)).alias("n"), F.sum("size_bytes").alias("bytes"))


@query
def q_path_classes(s, d):
    return corpus_files(s, d).select("path", *[P.in_class(F.col("path"), c).alias(c) for c in P.PATH_CLASSES])


@query
def q_size_filter(s, d):
    return corpus_files(s, d).filter(~policy.fits(F.col("size_bytes") * 500, 1)).select("path", "size_bytes")


@query
def q_content_hash(s, d):
    return corpus_files(s, d).select("path", F.sha2("content", 256).alias("hash"))


@query
def q_policy_filter(s, d):
    return corpus_files(s, d).filter(policy.decide(F.col("path"), ALLOW, DENY)[0]).select("path")


@query
def q_policy_decision(s, d):
    ok, why = policy.decide(F.col("path"), ALLOW, DENY)
    return corpus_files(s, d).select("path", ok.alias("allowed"), why.alias("reason"))


@query
def q_traverse_decision(s, d):
    dirs = corpus_files(s, d).select(F.explode(P.ancestors(F.col("path"))).alias("dir")).distinct().filter("dir <> '.'")
    return dirs.select("dir", policy.traverse(F.col("dir"), ["*.md", "src1/docs/**", "src2/src/*.rs"], DENY).alias("visit"))


@query
def q_resolve_owner(s, d):
    return policy.resolve_owner(corpus_files(s, d), policy.domains(s, DOMAIN_ROWS))


@query
def q_domain_schedule(s, d):
    return policy.schedule(policy.domains(s, DOMAIN_ROWS)).select("domain_id", "depth", "schedule_rank")


@query
def q_domain_violations(s, d):
    return policy.violations(policy.domains(s, BAD_ROWS))


@query
def q_overlap_pairs(s, d):
    return policy.overlap_pairs(policy.domains(s, DOMAIN_ROWS))


@query
def q_prune_targets(s, d):
    t = P.directory(F.col("path"))
    return policy.prune_targets(corpus_files(s, d).select(t.alias("path"), (F.pmod(F.length(t), F.lit(2)) == 0).alias("recursive"), F.lit(1).alias("priority")).unionByName(s.createDataFrame([("src1", True, 2), ("src2", False, 3)], "path string, recursive boolean, priority int")))


@query
def q_domain_budget(s, d):
    return policy.domain_budget(corpus_files(s, d).withColumn("size_bytes", F.col("size_bytes") * 500), 20, 1)


@query
def q_schedule_order(s, d):
    """Hot files first, those changed last, then by their domain's rank, the domain and path; place counts within hot or not and domain."""
    f = corpus_files(s, d).join(F.broadcast(policy.schedule(policy.domains(s, DOMAIN_ROWS)).groupBy(F.substring_index("root", "/", 1).alias("domain_id")).agg(F.min("schedule_rank").alias("r"))), "domain_id")
    f = f.withColumn("hot", F.col("modified_unix_ms") >= AS_OF_MS - 24 * 3600000)
    w = Window.partitionBy("hot", "domain_id").orderBy("path")
    return f.select("hot", "domain_id", "r", "path", F.row_number().over(w).alias("place")).orderBy(F.desc("hot"), "r", "domain_id", "path")


@query
def q_trust_counts(s, d):
    return rollup.trust_counts(corpus_files(s, d))


@query
def q_trust_levels(s, d):
    a, b = policy.trust(F.col("label"))
    return s.createDataFrame([(x,) for x in ("trusted", "Untrusted", "workspace_default", "TRUSTED")], "label string").select("label", a.alias("ranking"), b.alias("guard"))


@query
def q_secret_scan(s, d):
    return policy.secret_scan(corpus_files(s, d))


@query
def q_contains_secret(s, d):
    return policy.contains_secret(corpus_files(s, d))


@query
def q_redact_hits(s, d):
    hits = rank.literal_search(corpus_files(s, d), passages(s, d, 3), 10)
    return policy.redact(hits, [], DENY)


@query
def q_virtual_paths(s, d):
    return corpus_files(s, d).select("path", policy.virtual_path(F.col("domain_id"), F.col("path"), True).alias("virtual"), policy.virtual_path(F.col("domain_id"), F.lit(""), True).alias("top"), policy.virtual_path(F.col("domain_id"), F.col("path"), False).alias("single"))


@query
def q_resolve_virtual(s, d):
    """Files by names below d0, whose documents another domain owns, and below a domain that isn't there."""
    f = corpus_files(s, d).select(F.concat(F.when(F.col("domain_id") == "src0", "d0/").when(F.col("domain_id") == "src1", "d1docs/").otherwise("none/"), F.expr("substring(path, instr(path, '/') + 1)")).alias("path"))
    return policy.resolve_virtual(f.unionByName(s.createDataFrame([("d0/../x",), ("d2",), ("/d2/a\\b/",)], "path string")), policy.domains(s, DOMAIN_ROWS))


PLAN = [("d0", "src0", "trusted", ["docs/**"], ["*.bin"]), ("d1", "src1", "untrusted", [], None), ("d2", "src2", "odd", ["/abs/*", " ", "a/../b"], ["**/*.tmp", "C:\\x"]), ("d3", "src3", "trusted", None, [])]


@query
def q_domain_patterns(s, d):
    plan = s.createDataFrame(PLAN, "domain_id string, root string, trust_label string, allow array<string>, deny array<string>")
    e = policy.effective(plan, ["src/**"], ["**/*.tmp"], ["trusted", "untrusted"])
    return e.select("domain_id", F.array_join("allow", "|").alias("allow"), F.array_join("deny", "|").alias("deny"), "inherits_allow", "priority_class")


@query
def q_pattern_violations(s, d):
    plan = s.createDataFrame(PLAN, "domain_id string, root string, trust_label string, allow array<string>, deny array<string>")
    return policy.pattern_violations(policy.effective(plan, [], ["**/*.tmp"], ["trusted", "untrusted"]))


@query
def q_domain_counts(s, d):
    """How many domains have a budget, and how many are trusted."""
    return policy.domains(s, DOMAIN_ROWS).agg(F.count_if(F.col("budget") > 0).alias("budgeted"), F.count_if(F.col("trust_label") == "trusted").alias("trusted"), F.count(F.lit(1)).alias("domains"))


@query
def q_scan_targets(s, d):
    rows = [("d0", ["docs/**", "src/*.rs", "docs/a.md"]), ("d1", ["**/*.md"]), ("d2", ["a/**/b", "a", "x/y/z"]), ("d3", []), ("d4", ["*.md", "lib"])]
    return s.createDataFrame([(i, *t) for i, p in rows for t in policy.scan_targets(p, i, 1, {"lib"})], "domain_id string, path string, recursive boolean, priority int")


@query
def q_entropy_tokens(s, d):
    return policy.entropy_tokens(corpus_files(s, d), least=3.0)


@query
def q_fnv_hash(s, d):
    return corpus_files(s, d).select("path", T.fnv1a64(F.col("path")).alias("inode"))


@query
def q_slugs(s, d):
    return literals(s).unionByName(s.createDataFrame([(90, " -- "), (91, "Ä b__C")], "query_id long, query string")).select("query_id", T.slug(F.col("query")).alias("slug"), T.normalize_spaces(F.col("query")).alias("normal"), T.cache_key(F.col("query"), F.lit(2), F.lit(3)).alias("key"))


@query
def q_lower_distinct(s, d):
    return literals(s).select("query_id", F.array_join(T.lower_distinct(T.symbol_variants(F.col("query"))), "|").alias("variants"))


@query
def q_hit_paths(s, d):
    return q_render_hits(s, d).select("query_id", F.posexplode(T.hit_paths(F.col("markdown"))).alias("place", "path"))


@query
def q_text_samples(s, d):
    return chunk.text_samples(corpus_files(s, d), 200).select("path", "place", F.md5("sample").alias("hash"))


@query
def q_default_query(s, d):
    lines = F.slice(F.split("content", "\n"), 1, 25)
    usable = F.filter(F.transform(lines, T.trimmed), lambda x: (F.length(x) >= 5) & x.rlike("[A-Za-z0-9]"))
    return corpus_files(s, d).select("path", F.coalesce(F.get(usable, 0), P.basename(F.col("path"))).alias("query"))


@query
def q_leaf_query_text(s, d):
    f = corpus_files(s, d).select("path", F.concat(F.lit("doc_"), F.pmod("doc_id", F.lit(300)).cast("string")).alias("leaf"))
    n = f.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"))
    return f.join(n, "leaf").select("path", T.trimmed(F.regexp_replace(F.when(F.col("n") > 1, F.col("path")).otherwise(F.col("leaf")), "[/_.-]+", " ")).alias("query"))


@query
def q_path_facts(s, d):
    p = F.col("path")
    return corpus_files(s, d).select("path", P.hidden(p).alias("hidden"), P.climbs(F.concat(p, F.lit("\\..\\x"))).alias("climbs"), P.normalise(F.concat(F.lit("/\\"), p, F.lit("/"))).alias("normal"), P.directory(p).alias("dir"), P.basename(p).alias("base"), F.array_join(P.ancestors(p), "|").alias("above"))


# Generators


@query
def q_chunks_all(s, d):
    return chunk.chunks_all(corpus_files(s, d)).select("path", "chunk_id", "start_line", "end_line", F.md5("content").alias("hash"), "symbol")


@query
def q_chunk_lines(s, d):
    return chunk.chunk_lines(corpus_files(s, d)).select("path", "chunk_id", "start_line", "end_line", F.md5("content").alias("hash"))


@query
def q_chunk_paragraphs(s, d):
    return chunk.chunk_paragraphs(corpus_files(s, d)).select("path", "chunk_id", F.md5("content").alias("hash"))


@query
def q_chunk_config(s, d):
    return chunk.chunk_config(corpus_files(s, d)).select("path", "chunk_id", "symbol", F.md5("content").alias("hash"))


@query
def q_extract_symbols(s, d):
    return chunk.extract_symbols(corpus_files(s, d))


@query
def q_mine_symbols(s, d):
    """Names of the four letters or more that the languages' declarations have, once a file."""
    rows = corpus_files(s, d).filter(P.in_class(F.col("path"), "code")).select("path", F.explode(chunk.lines_of(F.col("content"))).alias("line"))
    name = F.regexp_extract("line", r"^\s*(?:pub\s+)?(?:export\s+)?(?:async\s+)?(?:def|fn|function|class|struct|enum|trait|interface)\s+([A-Za-z_][A-Za-z0-9_]*)", 1)
    return rows.select("path", name.alias("name")).filter("length(name) >= 4 and name not like '\\_\\_%' and lower(name) not in ('main', 'test', 'self', 'init')").distinct()


@query
def q_hash_embed(s, d):
    return chunk.hash_embed(corpus_files(s, d), "path", "content").select("path", "bucket", F.round("weight", 6).alias("weight"))


@query
def q_symbol_to_phrase(s, d):
    p = F.regexp_replace(F.regexp_replace("symbol_name", "^_+", ""), "([a-z0-9])([A-Z])", "$1 $2")
    return chunk.extract_symbols(corpus_files(s, d)).select("symbol_name", F.lower(T.trimmed(F.regexp_replace(p, r"[_\-\s]+", " "))).alias("phrase")).distinct()


# Queries and their intents


@query
def q_query_terms(s, d):
    return literals(s).select("query_id", F.array_join(T.query_terms(F.col("query")), "|").alias("terms"), F.array_join(T.overlap_terms(F.col("query")), "|").alias("overlap"), F.array_join(T.search_terms(F.col("query")), "|").alias("search"))


@query
def q_symbol_variants(s, d):
    return literals(s).select("query_id", F.array_join(T.symbol_variants(F.col("query")), "|").alias("variants"))


@query
def q_normalize_query(s, d):
    return literals(s).select("query_id", T.normalize_query(F.col("query")).alias("normal"))


@query
def q_classify_queries(s, d):
    return with_intents(literals(s))


@query
def q_adaptive_limits(s, d):
    flags = s.createDataFrame([(a, b, c) for a in (False, True) for b in (False, True) for c in (False, True)], "symbol_hits boolean, bm25_hits boolean, docs_hint boolean")
    q = with_intents(literals(s)).join(F.broadcast(flags))  # eight rows
    v = T.vector_limit(F.size(T.overlap_terms(F.col("query"))), F.col("symbol_hits"), F.col("bm25_hits"), F.col("docs_hint"))
    return q.select("query_id", "symbol_hits", "bm25_hits", "docs_hint", T.bm25_limit().alias("bm25_n"), v.alias("vector_n"))


def _symbols(s, d):
    return corpus_index(s, d).read("symbols").drop("index_version")


@query
def q_symbol_exact(s, d):
    return rank.symbol_exact(_symbols(s, d), literals(s))


@query
def q_symbol_prefix(s, d):
    return rank.symbol_prefix(_symbols(s, d), literals(s))


@query
def q_bm25_variants(s, d):
    return passages(s, d).unionByName(literals(s).withColumn("query_id", F.col("query_id") + 100000)).select("query_id", F.array_join(T.bm25_variants(F.col("query")), "|").alias("variants"))


@query
def q_bm25_topk(s, d):
    return full_text(corpus_index(s, d), literals(s))


@query
def q_bm25_passages(s, d):
    return full_text(corpus_index(s, d), passages(s, d))


@query
def q_bm25_path_filtered(s, d):
    return full_text(corpus_index(s, d), with_intents(literals(s).unionByName(s.createDataFrame(list(PUSHED), "query_id long, query string"))), pushdown=True)


@query
def q_literal_search(s, d):
    return rank.literal_search(corpus_files(s, d), passages(s, d, 8))


@query
def q_literal_search_any_case(s, d):
    return rank.literal_search(corpus_files(s, d), passages(s, d, 4).withColumn("query", F.translate("query", T.LOWER, T.UPPER)), ignore_case=True)


@query
def q_cosine_topk(s, d):
    e = table(s, d, "embeddings").filter("embedding is not null")
    return rank.cosine_topk(e.select(F.col("vec_id").cast("string").alias("key"), "embedding"), e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")).select("query_id", F.col("key").cast("long").alias("vec_id"), "score", "rank")


@query
def q_vec_pad_truncate(s, d):
    e = table(s, d, "embeddings").filter("embedding is not null")
    p = lambda n: F.round(F.aggregate(rank.pad_truncate(F.col("embedding"), n), F.lit(0.0), lambda a, x: a + x.cast("double")), 4)
    return e.select("vec_id", F.size(rank.pad_truncate(F.col("embedding"), 100)).alias("n_long"), p(100).alias("sum_long"), F.size(rank.pad_truncate(F.col("embedding"), 16)).alias("n_short"), p(16).alias("sum_short"))


@query
def q_vector_search(s, d):
    return rank.nearest(corpus_index(s, d).read("vectors"), chunk.hash_embed_packed(passages(s, d, 12), "query_id", "query"), 10)


@query
def q_vector_pool(s, d):
    vectors = rank.pool(corpus_index(s, d).read("vectors").select("key", "buckets", "weights"), 10)
    return rank.nearest(vectors, chunk.hash_embed_packed(passages(s, d, 12), "query_id", "query"), 10)


# Fusion and priors


def _lists(s, d):
    b = rank.literal_search(corpus_files(s, d), passages(s, d, 3), 20).select("query_id", F.col("path").alias("key"), F.lit(2).alias("list"), "rank")
    w = Window.partitionBy("query_id").orderBy(F.desc("modified_unix_ms"), "path")
    t = rank.literal_search(corpus_files(s, d), passages(s, d, 2), 100).join(corpus_files(s, d).select("path", "modified_unix_ms"), "path").withColumn("r", F.row_number().over(w)).filter("r <= 20")
    return b.unionByName(t.select("query_id", F.col("path").alias("key"), F.lit(3).alias("list"), F.col("r").alias("rank")))


@query
def q_rrf_fuse(s, d):
    return rank.rrf(_lists(s, d))


@query
def q_dedupe_by_path(s, d):
    f = rank.rrf(_lists(s, d)).withColumn("path", P.directory(F.col("key")))
    w = Window.partitionBy("query_id").orderBy(F.desc("score_rrf"), "key")
    return rank.dedupe_by_path(f.withColumn("position", F.row_number().over(w))).select("query_id", "path", "key", "rank", "score_rrf")


def _pairs(s, d):
    """Every file with every literal query: sixteen queries."""
    return corpus_files(s, d).select("path", "modified_unix_ms").join(F.broadcast(with_intents(literals(s))))


@query
def q_path_prior(s, d):
    return corpus_files(s, d).select("path", F.round(rank.path_prior(F.col("path")), 6).alias("prior"))


@query
def q_overlap_prior(s, d):
    q, p = F.col("query"), F.col("path")
    return _pairs(s, d).select("query_id", "path", F.round(rank.overlap_prior(q, p, 0.35), 6).alias("path_overlap"), F.round(rank.overlap_prior(q, P.basename(p), 0.55), 6).alias("name_overlap"))


@query
def q_recency_prior(s, d):
    return corpus_files(s, d).select("path", F.round(rank.recency_prior(F.col("modified_unix_ms"), AS_OF_MS), 6).alias("prior"))


@query
def q_intent_priors(s, d):
    return _pairs(s, d).select("query_id", "path", *[F.round(rank.intent_prior(F.col("path"), n), 6).alias(n) for n in rank.INTENT_FACTORS])


@query
def q_priors(s, d):
    return _pairs(s, d).select("query_id", "path", F.round(rank.prior(F.col("query"), F.col("path"), F.col("modified_unix_ms"), AS_OF_MS), 10).alias("prior"))


@query
def q_symbol_fast_path(s, d):
    q = with_intents(literals(s)).filter("is_symbol")
    hits = rank.symbol_exact(_symbols(s, d), q, 50).withColumnRenamed("rank", "nth").join(q.select("query_id", "query"), "query_id")
    hits = hits.withColumn("score", F.round(rank.EXACT_BOOST * rank.path_prior(F.col("path")), 6))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "nth")
    return rank.dedupe_by_path(hits.withColumn("position", F.row_number().over(w))).select("query_id", "path", "rank", "score")


def _both(s, d):
    more = literals(s).filter(F.col("query_id").isin(*MORE)).unionByName(s.createDataFrame(list(PUSHED), "query_id long, query string"))
    return passages(s, d).unionByName(more.withColumn("query_id", F.col("query_id") + 100000))


@query
def q_hybrid_search(s, d):
    return hybrid_search(corpus_index(s, d), _both(s, d), deny=DENY, allow_hidden=False)


def _first(s, d, hits):
    return evaluate.first_relevant_rank(hits, expected(s, d)).withColumn("is_symbol", F.pmod("query_id", F.lit(4)) == 0)


@query
def q_first_relevant_rank(s, d):
    return _first(s, d, rank.literal_search(corpus_files(s, d), passages(s, d, 3), 10)).select("query_id", "first_rank")


@query
def q_eval_metrics(s, d):
    r = _first(s, d, rank.literal_search(corpus_files(s, d), passages(s, d, 3), 10)).withColumn("dataset", F.concat(F.lit("set"), F.pmod("query_id", F.lit(3)).cast("string")))
    return evaluate.metrics(r, "dataset")


@query
def q_eval_metrics_micro(s, d):
    return evaluate.metrics(_first(s, d, rank.literal_search(corpus_files(s, d), passages(s, d, 3), 10)))


def _two(s, d, most=3):
    store = corpus_index(s, d)
    ours = _first(s, d, full_text(store, passages(s, d)).join(store.read("chunks").select("key", "path"), "key").select("query_id", "path", "rank"))
    theirs = _first(s, d, rank.literal_search(corpus_files(s, d), passages(s, d, 3), most))
    return ours, theirs


@query
def q_head_to_head(s, d):
    ours, theirs = (evaluate.metrics(x) for x in _two(s, d))
    t = theirs.select(F.col("recall").alias("their_recall"), F.col("mrr").alias("their_mrr"))
    return ours.join(F.broadcast(t)).select("n_queries", "recall", "mrr", "their_recall", "their_mrr", F.round(F.col("recall") - F.col("their_recall"), 6).alias("delta_recall"), F.round(F.col("mrr") - F.col("their_mrr"), 6).alias("delta_mrr"))  # one row each


@query
def q_query_gap(s, d):
    ours, theirs = _two(s, d)
    return evaluate.query_gap(ours.select("query_id", F.col("first_rank").alias("ours")).join(theirs.select("query_id", F.col("first_rank").alias("theirs")), "query_id"))


@query
def q_release_gate(s, d):
    return evaluate.release_gate(q_eval_metrics_micro(s, d))


# Roll-ups


@query
def q_dir_rollup(s, d):
    return rollup.dir_rollup(corpus_files(s, d))


@query
def q_dir_file_types(s, d):
    return rollup.dir_file_types(corpus_files(s, d))


@query
def q_dir_top_symbols(s, d):
    return rollup.dir_top_symbols(chunk.extract_symbols(corpus_files(s, d)))


@query
def q_dir_children(s, d):
    return rollup.dir_children(corpus_files(s, d))


@query
def q_dir_enrichment(s, d):
    f = corpus_files(s, d)
    return rollup.dir_enrichment(f, chunk.extract_symbols(f))


@query
def q_dir_overview(s, d):
    f = rollup.dir_rollup(corpus_files(s, d))
    return rollup.dir_overview(f.select("dir", F.format_string("# %s: %d files", "dir", "n_files").alias("summary")), f.select("dir", F.when(F.col("n_files") % 2 == 0, "ready").otherwise("failed").alias("status"), F.concat(F.lit("about "), "dir").alias("enrichment")))


@query
def q_render_hits(s, d):
    h = rank.literal_search(corpus_files(s, d), passages(s, d, 3), 5).join(passages(s, d, 3), "query_id").withColumn("score", 1.0 / F.col("rank"))
    return rollup.render_hits(h)


# Snapshots


def _versions(s, d):
    f = corpus_files(s, d).select("doc_id", "path", "file_hash")
    return f.filter("doc_id % 3 <> 0").withColumn("index_version", F.lit(1).cast("long")), f.filter("doc_id % 2 = 0").select("doc_id", "path", F.sha2(F.concat("file_hash", F.lit("v2")), 256).alias("file_hash"), F.lit(2).cast("long").alias("index_version"))


def _snapshots(s):
    return s.createDataFrame([(1, "obsolete"), (2, "active"), (3, "staging"), (4, "staging")], "version long, state string")


@query
def q_active_version(s, d):
    return snapshot.next_version(_snapshots(s))


@query
def q_publish_snapshot(s, d):
    return snapshot.publish_states(_snapshots(s), 3)


@query
def q_snapshot_read(s, d):
    """Two published versions; the read of the first prunes the second."""
    store = snapshot.SnapshotStore(s, new_path(s, "versions"))
    for version in _versions(s, d):
        store.publish(store.stage({"files": version.drop("index_version")}))
    return store.read("files", 2).select("path", "file_hash", "index_version")


@query
def q_upsert_latest(s, d):
    a, b = _versions(s, d)
    return snapshot.upsert(a, b, ["path"]).select("path", "file_hash", "index_version")


@query
def q_delete_paths(s, d):
    a, b = _versions(s, d)
    return snapshot.delete(a, b, ["path"]).select("path", "file_hash")


@query
def q_session_snapshots(s, d):
    e = table(s, d, "events")
    r = e.select(F.col("user_id").cast("string").alias("session"), F.col("ts").cast("timestamp").alias("ts"), F.when(F.col("event_id") % 50 == 0, F.lit(1).cast("long")).alias("explicit"), (F.col("event_type") == "signup").alias("refresh"), "event_id")
    r = r.groupBy("session", "ts").agg(F.max("explicit").alias("explicit"), F.bool_or("refresh").alias("refresh"))
    v = s.createDataFrame([(1, "2023-12-31"), (2, "2024-01-10"), (3, "2024-01-20")], "version long, day string").select("version", F.to_timestamp("day").alias("active_from"))
    return snapshot.pin_sessions(r, v).select("session", F.unix_micros("ts").alias("ts_us"), "snapshot", "active", "stale")


@query
def q_session_status(s, d):
    """The last state of each session as a JSON text."""
    last = q_session_snapshots(s, d).groupBy("session").agg(F.max_by(F.struct("snapshot", "active", "stale", "ts_us"), "ts_us").alias("x")).select("session", "x.*")
    return last.select("session", F.to_json(F.struct(F.lit("pinned").alias("mode"), "session", F.col("snapshot").alias("snapshot_version"), F.col("active").alias("active_version"), "stale", F.floor(F.col("ts_us") / 1000).alias("last_access_unix_ms"))).alias("status"))


# Change streams


@query
def q_debounce_sessions(s, d):
    out = changes.debounce(table(s, d, "events"))
    return out.select("user_id", F.unix_micros(F.col("batch_start").cast("timestamp")).alias("start_us"), F.unix_micros(F.col("batch_end").cast("timestamp")).alias("end_us"), "n")


def _counts(s, d):
    e = table(s, d, "events")
    return changes.change_counts(e.select(F.date_format("ts", "yyyy-MM-dd").alias("batch"), F.concat(F.lit("src"), F.pmod("user_id", F.lit(20)).cast("string"), F.lit("/f"), F.col("user_id").cast("string")).alias("path")), deny=["src7/**", "**/f*13"])


@query
def q_change_counts(s, d):
    return _counts(s, d)


@query
def q_change_kinds(s, d):
    e = table(s, d, "events").select("ts", "event_id", F.concat(F.lit("src"), F.pmod("user_id", F.lit(20)).cast("string"), F.lit("/f"), F.col("user_id").cast("string")).alias("path"), F.when(F.col("event_type") == "signup", "Created").when(F.col("event_type") == "error", "removed").otherwise("modified").alias("what"))
    return changes.kinds(e.withColumn("ts", F.col("event_id"))).select("path", "kind", "n")


@query
def q_reindex_plan(s, d):
    return changes.reindex_plan(_counts(s, d))


@query
def q_phase_progress(s, d):
    return changes.phases(changes.reindex_plan(_counts(s, d))).select("batch", "path", "rank", "hot_left", "phase")


@query
def q_pending_status(s, d):
    return changes.pending(changes.reindex_plan(_counts(s, d)))


# Reports


def _ms(s, d):
    return table(s, d, "events").select("event_type", F.floor(F.col("value") * 10).cast("long").alias("ms"))


@query
def q_latency_percentiles(s, d):
    return evaluate.nearest_rank(_ms(s, d), "event_type", "ms")


@query
def q_median_latency(s, d):
    return evaluate.median_int(_ms(s, d), "event_type", "ms")


@query
def q_latency_histogram(s, d):
    return evaluate.histogram(_ms(s, d), "event_type", "ms")


@query
def q_latency_sample(s, d):
    e = table(s, d, "events").select("event_type", "event_id", F.floor(F.col("value") * 10).cast("long").alias("ms"))
    return evaluate.nearest_rank(evaluate.bounded_sample(e, 50, "event_type", "event_id", "ms"), "event_type", "ms")


@query
def q_soak_gate(s, d):
    ms = evaluate.nearest_rank(_ms(s, d).withColumn("all", F.lit("all")), "all", "ms")
    errors = table(s, d, "events").agg(F.count_if(F.col("event_type") == "error").cast("double").alias("value")).select(F.lit("errors").alias("metric"), "value")
    values = ms.select(F.lit("p95").alias("metric"), F.col("p95").cast("double").alias("value")).unionByName(errors)
    return evaluate.checked(values, {"p95": 1500.0, "errors": 100.0, "rss_mb": 512.0})


@query
def q_metrics_text(s, d):
    return evaluate.exposition(evaluate.histogram(_ms(s, d), "event_type", "ms"), "skerry_latency_ms", "event_type")


@query
def q_hit_ratio(s, d):
    e = table(s, d, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "view").alias("hits"), F.count_if(F.col("event_type") == "click").alias("misses"))
    return e.select("user_id", evaluate.hit_ratio(F.col("hits"), F.col("misses")).alias("ratio"))


@query
def q_sweep_grid(s, d):
    """The full-text and the literal backend with three limits each: recall and reciprocal rank."""
    grid = evaluate.sweep(s, ["bm25", "literal"], [5, 10, 20])
    ours, theirs = _two(s, d, 20)
    found = ours.select(F.lit("bm25").alias("backend"), "query_id", "first_rank").unionByName(theirs.select(F.lit("literal").alias("backend"), "query_id", "first_rank"))
    cut = grid.join(found, "backend").withColumn("first_rank", F.when(F.col("first_rank") <= F.col("top"), F.col("first_rank"))).withColumn("is_symbol", F.lit(False))
    return evaluate.metrics(cut, "backend", "top").drop("symbol_hit_rate")


@query
def q_sweep_best(s, d):
    """Of each event type the day and group of users with the most events a user."""
    e = table(s, d, "events").groupBy("event_type", F.date_format("ts", "yyyy-MM-dd").alias("day"), F.pmod("user_id", F.lit(4)).alias("part")).agg(F.round(F.count(F.lit(1)) / F.count_distinct("user_id"), 6).alias("throughput"))
    return evaluate.best_setting(e, ["event_type"], ["day", "part"], "throughput")


@query
def q_promotion_states(s, d):
    k = F.pmod("doc_id", F.lit(7))
    names = [*evaluate.PROMOTION, "other", "odd"]
    rows = table(s, d, "documents").select(F.element_at(F.array(*map(F.lit, names)), (k + 1).cast("int")).alias("status"), F.when(k == 6, "query_level_triage").otherwise("none").alias("next_action"))
    return evaluate.promotion_counts(rows)


@query
def q_presets(s, d):
    return evaluate.presets(s)


@query
def q_query_chooser(s, d):
    """Forty symbols to ask for, of different files where there are enough, with sequential ids."""
    mined = q_mine_symbols(s, d).orderBy("path", "name").select("name", "path")
    chosen = evaluate.choose_queries(((r.name, r.path) for r in mined.toLocalIterator()), 40)
    return s.createDataFrame([(f"b{k:02d}", n, p) for k, (n, p) in enumerate(chosen, 1)], "id string, query string, expected_path string")


@query
def q_profile_matrix(s, d):
    ours, theirs = (evaluate.metrics(x) for x in _two(s, d))
    return evaluate.profile_matrix({"full_text": ours, "literal": theirs})


@query
def q_slowest_topk(s, d):
    return table(s, d, "events").orderBy(F.desc("value"), "event_id").limit(5).select("event_id", "event_type", "value")


def _runs(s, d):
    return table(s, d, "events").groupBy(F.col("event_type").alias("dataset"), F.date_format("ts", "yyyyMMdd").alias("run")).agg(F.round(F.avg("value"), 6).alias("delta"))


@query
def q_drift_summary(s, d):
    return evaluate.drift(_runs(s, d))


@query
def q_complete_nights(s, d):
    e = table(s, d, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("night"), F.col("event_type").alias("dataset"))
    return evaluate.complete_nights(e, ["click", "view", "signup", "error", "purchase"])


@query
def q_latest_per_key(s, d):
    return table(s, d, "events").groupBy("user_id").agg(F.max_by(F.struct("event_id", "event_type"), F.struct("ts", "event_id")).alias("e")).select("user_id", "e.event_id", "e.event_type")


@query
def q_coverage_status(s, d):
    f = corpus_files(s, d).select(P.directory(F.col("path")).alias("key"), F.pmod("doc_id", F.lit(4)).alias("priority")).groupBy("key").agg(F.max("priority").alias("priority"))
    seen = s.createDataFrame([("src1/src", 5), ("src1/src", 7), ("src3", 2), ("src5/src", 1), ("src2/.github", 3)], "key string, ts int")
    return evaluate.coverage(f, seen)


@query
def q_coverage_counts(s, d):
    return evaluate.coverage_counts(q_coverage_status(s, d))


@query
def q_identity_dedupe(s, d):
    c = table(s, d, "documents").select(F.sha2("text", 256).alias("identity"), F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("path"), (F.pmod("doc_id", F.lit(2)) == 1).alias("is_mirror"), F.pmod("doc_id", F.lit(3)).alias("n_files"), F.pmod("doc_id", F.lit(5)).alias("n_code"))
    return evaluate.identity_dedupe(c)


@query
def q_candidate_select(s, d):
    r = _runs(s, d).groupBy("dataset").agg(F.avg("delta").alias("a"), F.max("delta").alias("b"))
    return evaluate.candidate_select(r.select(F.col("dataset").alias("name"), F.round(F.col("a") / 1000, 4).alias("mrr"), F.round(F.col("b") / 1000, 4).alias("recall"), F.lit(1.0).alias("symbol"), F.round("b", 3).alias("p95")))


def _suite(s, d):
    w = Window.partitionBy("lang").orderBy("doc_id")
    return table(s, d, "documents").select(F.col("lang").alias("dataset"), "doc_id", (F.row_number().over(w) - 1).alias("position"))


@query
def q_split_suite(s, d):
    return evaluate.split_suite(_suite(s, d), 8).select("dataset", "doc_id", "split")


@query
def q_curated_split(s, d):
    """Symbols of one file alone, numbered, dealt alternately to tune and holdout, each with its phrase."""
    sym = chunk.extract_symbols(corpus_files(s, d)).groupBy(F.lower("symbol_name").alias("name")).agg(F.count_distinct("path").alias("n_paths"), F.min("path").alias("path"))
    easy = sym.filter("n_paths <= 3 and length(name) >= 4")
    w = Window.partitionBy(F.substring_index("path", "/", 1)).orderBy("name")
    out = easy.withColumn("rn", F.row_number().over(w))
    return out.select("name", "path", F.format_string("b%02d", "rn").alias("id"), F.when(F.col("rn") % 2 == 1, "tune").otherwise("holdout").alias("split"), F.regexp_replace("name", "_+", " ").alias("phrase"))
