"""The hybrid search of a batch of queries over a version of an index."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import in_class
from ..functions.text import bm25_limit, intents, overlap_terms, vector_limit
from ..operators import chunk, policy, rank
from ..operators.snapshot import SnapshotStore
from ..scratch import stage
from ..sources.corpus import AS_OF_MS
from .index import keyed

LISTS = ("exact", "prefix", "bm25", "vector")
SOURCES = {"exact": "symbol", "prefix": "symbol", "bm25": "bm25", "vector": "vector"}
WHY = {"exact": "exact symbol match", "prefix": "prefix symbol match", "bm25": "bm25 keyword match", "vector": "vector semantic similarity"}


def with_intents(queries: DataFrame) -> DataFrame:
    return queries.select("*", *[c.alias(n) for n, c in intents(F.col("query")).items()])


def pushed_paths(path: Column) -> Column:
    """Whether BM25 may look at a path, by the query's intents, the first of which counts: workflow, unit, command."""
    like = lambda *patterns: reduce(or_, [path.ilike(p) for p in patterns])
    workflow = like("github/workflows/%", ".github/workflows/%", "%/workflows/%.yml", "%/workflows/%.yaml")
    unit = like("systemd/%", "%/systemd/%", "%.service", "%.socket", "%.timer", "%.mount", "%.target")
    command = like("scripts/%", "%/scripts/%", "%.ps1", "%.sh", "%.bat")
    return F.when(F.col("is_workflow"), workflow).when(F.col("is_unit"), unit).when(F.col("is_command"), command).otherwise(True)


def full_text(store: SnapshotStore, queries: DataFrame, n: int | str = 20, version: int | None = None, pushdown: bool = False, place: str = "key") -> DataFrame:
    """BM25 of queries over a stored version: (query_id, key, score, rank)."""
    flags = ["is_workflow", "is_unit", "is_command"] if pushdown else []
    tiers = rank.query_tiers(queries, *([n] if isinstance(n, str) else []), *flags)
    read = lambda name: store.read(name, version)
    # Postings and chunks meet in one version, which the folder read says; stats is a row of it.
    return rank.score_terms(read("postings").drop("index_version"), read("chunks"), read("stats").drop("index_version"), tiers, n, pushed_paths(F.col("path")) if pushdown else None, place).drop("tier")


def candidates(store: SnapshotStore, queries: DataFrame, version: int) -> DataFrame:
    """(query_id, list, rank, path, start_line, end_line, score, symbol_kind) of the four generators, their limits and gates by query. queries: with_intents(), staged."""
    q = queries.withColumn("bm25_n", bm25_limit())
    symbols, chunks = store.read("symbols", version), store.read("chunks", version).select("key", "path", "start_line", "end_line")
    line = F.col("line_start").alias("start_line"), F.col("line_start").alias("end_line")
    none = F.lit(None).cast("string").alias("symbol_kind")
    exact = rank.symbol_exact(symbols, q).select("query_id", F.lit(0).alias("list"), "rank", "path", *line, F.lit(rank.EXACT_BOOST).alias("score"), "symbol_kind")
    prefix = rank.symbol_prefix(symbols, q).select("query_id", F.lit(1).alias("list"), "rank", "path", *line, F.lit(rank.PREFIX_BOOST).alias("score"), "symbol_kind")
    text = full_text(store, q, "bm25_n", version, True, "place").join(chunks, "key").select("query_id", F.lit(2).alias("list"), "rank", "path", "start_line", "end_line", F.lit(1.0).alias("score"), none)
    found = stage(exact.unionByName(prefix).unionByName(text), "candidates")
    facts = found.groupBy("query_id").agg(
        F.bool_or(F.col("list") < 2).alias("symbol_hits"), F.bool_or(F.col("list") == 2).alias("bm25_hits"), F.bool_or((F.col("list") == 2) & (F.col("rank") <= 3) & in_class(F.col("path"), "docs")).alias("docs_hint")
    )
    flag = lambda c: F.coalesce(c, F.lit(False))
    limit = vector_limit(F.size(overlap_terms(F.col("query"))), flag(F.col("symbol_hits")), flag(F.col("bm25_hits")), flag(F.col("docs_hint")))
    open_ = stage(q.join(facts, "query_id", "left").select("query_id", "query", limit.alias("vector_n")).filter("vector_n is not null"), "open")
    asked = chunk.hash_embed_packed(open_, "query_id", "query")
    near = rank.nearest(store.read("vectors", version), asked, rank.MOST).join(open_.select("query_id", "vector_n"), "query_id").filter("rank <= vector_n")
    vector = near.join(chunks, "key").select("query_id", F.lit(3).alias("list"), "rank", "path", "start_line", "end_line", "score", none)
    return found.unionByName(vector)


def _grounded(hits: DataFrame, store: SnapshotStore, version: int) -> DataFrame:
    """Hits (query_id, rank, path, start_line, end_line, score_rrf, list, score, symbol_kind, why, path_prior, recency_prior) with all columns of an answer."""
    active = store.manifest()["active"]
    pick = lambda table: F.element_at(F.array(*[F.lit(table[x]) for x in LISTS]), F.col("list") + 1)
    by = lambda *lists: F.when(F.col("list").isin(*lists), F.col("score"))
    label = policy.trust(F.col("trust_label"))[0]
    two = lambda c: F.floor(F.col(c) * 100 + 0.5) / 100
    why = F.concat(pick(WHY), "why", F.format_string("; prior(path=%.2f, recency=%.2f)", two("path_prior"), two("recency_prior")))
    return hits.select(
        "query_id", "rank", "path", "domain_id", "start_line", "end_line", "file_hash", F.lit(version).cast("long").alias("snapshot_version"), F.lit(active).cast("long").alias("active_version"), "score_rrf",
        by(0, 1).alias("score_symbol"), by(2).alias("score_bm25"), by(3).alias("score_vector"), pick(SOURCES).alias("source"), "symbol_kind", F.lit(version != active).alias("stale"), "trust_label", label.alias("trust_level"), why.alias("why_selected"),
    )


def hybrid_search(store: SnapshotStore, queries: DataFrame, n: int = 5, version: int | None = None, as_of_ms: int = AS_OF_MS, allow: list[str] | None = None, deny: list[str] | None = None, allow_hidden: bool = True) -> DataFrame:
    """A row a hit of each of queries (query_id, query), over a version, by default the active one.

    A symbol-like query that names a symbol is answered by the exact hits alone, their boost times the prior, by that score and their order. Other queries' lists are fused by reciprocal ranks over path and lines, weighted by priors, exact hits pinned first, or prefix hits where there are none and the query is a symbol's characters. One hit a path stays, n a query; what the policy denies is taken out after that, and ranks stay as they were.
    """
    version = version or store.manifest()["active"]
    q = stage(with_intents(queries), "queries")
    files = store.read("files", version).drop("index_version")
    lists = candidates(store, q, version).join(files, "path").join(q, "query_id")
    prior = rank.prior(F.col("query"), F.col("path"), F.col("modified_unix_ms"), as_of_ms)
    lists = lists.withColumn("prior", prior).withColumn("path_prior", rank.path_prior(F.col("path"))).withColumn("recency_prior", rank.recency_prior(F.col("modified_unix_ms"), as_of_ms))
    lists = stage(lists.withColumn("has_exact", F.max(F.col("list") == 0).over(Window.partitionBy("query_id"))).withColumn("fast", F.col("is_symbol") & F.col("has_exact")), "lists")

    direct = lists.filter("fast and list = 0").withColumn("score_rrf", F.round(F.col("score") * F.col("prior"), 8)).withColumn("why", F.lit("; exact-symbol-fast-path"))
    direct = direct.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score_rrf"), "rank")))

    place = ("query_id", "path", "start_line", "end_line")
    row = F.struct(F.col("list"), F.col("rank"), *[F.col(c) for c in ("score", "symbol_kind", "domain_id", "trust_label", "file_hash", "prior", "path_prior", "recency_prior", "has_exact", "query")])
    fused = lists.filter("not fast").groupBy(*place).agg(F.round(F.sum(1.0 / (F.lit(rank.RRF_K) + F.col("rank"))), 9).alias("base"), F.min(row).alias("f"), F.min(F.when(F.col("list") == 0, F.col("rank"))).alias("exact"), F.min(F.when(F.col("list") == 1, F.col("rank"))).alias("prefix")).select(*place, "base", "exact", "prefix", "f.*")
    symbol_hint = F.col("query").rlike("^[A-Za-z0-9_:]*$")
    pin = F.when(F.col("has_exact"), F.col("exact")).when(symbol_hint, F.col("prefix"))
    fused = fused.withColumn("score_rrf", F.round(F.col("base") * F.col("prior"), 8)).withColumn("pin", F.coalesce(pin, F.lit(1 << 30))).withColumn("place", F.concat_ws(":", "path", F.col("start_line").cast("string"), F.col("end_line").cast("string")))
    order = Window.partitionBy("query_id").orderBy("pin", F.desc("score_rrf"), F.desc(F.floor(F.col("base") * 1000000)), "place")
    fused = fused.withColumn("position", F.row_number().over(order)).withColumn("why", F.lit(""))

    shape = ("query_id", "position", "path", "start_line", "end_line", "score_rrf", "list", "score", "symbol_kind", "domain_id", "trust_label", "file_hash", "why", "path_prior", "recency_prior")
    hits = rank.dedupe_by_path(direct.select(*shape).unionByName(fused.select(*shape)), n)
    return policy.redact(_grounded(hits, store, version), allow or [], deny or [], allow_hidden)


__all__ = ["candidates", "full_text", "hybrid_search", "keyed", "with_intents"]
