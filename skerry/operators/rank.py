"""Candidate generators for a batch of queries, fusion and priors.

Everything carries query_id, so a batch is one job: term filters come before the shuffle, per-query limits are window ranks, and no join is told to broadcast a side that may grow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..functions.paths import basename, in_class
from ..functions.text import overlap_terms, query_terms, search_terms, symbol_variants, term_sets

K1, B, RRF_K = 1.2, 0.75, 60
#: The most that a limit by column may ask for; characters that a prefix search meets under.
MOST, HEAD = 20, 3
EXACT_BOOST, PREFIX_BOOST = 2.0, 1.2


def _top(df: DataFrame, n: int | str, *order: Column, name: str = "rank") -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(*order)
    ranked = df.withColumn(name, F.row_number().over(w))
    return ranked.filter(F.col(name) <= MOST).filter(F.col(name) <= F.col(n)) if isinstance(n, str) else ranked.filter(F.col(name) <= n)


def index_text(chunks: DataFrame, wanted: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(postings, lengths, stats) of chunks (key, content): what a snapshot stores, so that a search scans no text. wanted (term): the only terms to make postings of; all others are dropped before anything is shuffled."""
    terms = chunks.select("key", search_terms(F.col("content")).alias("ts"))
    lengths = terms.select("key", F.size("ts").alias("len"))
    each = terms.select("key", F.explode("ts").alias("term"))
    if wanted is not None:
        each = each.join(wanted, "term", "left_semi")
    return each.groupBy("term", "key").agg(F.count(F.lit(1)).alias("tf")), lengths, lengths.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("len").alias("avg_len"))


def query_tiers(queries: DataFrame, *keep: str) -> DataFrame:
    """(query_id, tier, term, need) and the columns `keep`: the distinct terms of each spelling of a query, tiers in the order in which they are tried."""
    sets = queries.select("query_id", *keep, F.posexplode(term_sets(F.col("query"))).alias("tier", "terms"))
    return sets.select("query_id", *keep, "tier", F.size("terms").alias("need"), F.explode("terms").alias("term"))


def score_terms(postings: DataFrame, lengths: DataFrame, stats: DataFrame, tiers: DataFrame, n: int | str = 20, allowed: Column | None = None, place: str = "key") -> DataFrame:
    """The best n keys of each query (query_id, tier, key, score, rank): those that hold all terms of a spelling, by BM25, best first; n of each spelling, of which a later one only adds places that no earlier one has. tiers: of query_tiers(); place: a column of lengths that keys may share, of which the best stands. `allowed` may use the columns of lengths and tiers; what it excludes is dropped before the ranking, not from the term statistics."""
    some = postings.join(tiers.select("term").distinct(), "term")  # the batch's terms
    df = some.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.greatest(F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    scored = some.join(df, "term").join(lengths, "key").join(F.broadcast(stats)).withColumn("part", part)  # stats is one row
    hits = scored.join(tiers, "term").filter(allowed if allowed is not None else F.lit(True))
    limit = [n] if isinstance(n, str) else []
    spots = sorted({"key", place})
    hits = hits.groupBy("query_id", *limit, "tier", *spots, "need").agg(F.sum("part").alias("score"), F.count(F.lit(1)).alias("matched")).filter("matched = need").withColumn("score", F.round("score", 6))
    tier = Window.partitionBy("query_id", "tier").orderBy(F.desc("score"), "key")
    best = hits.withColumn("nth", F.row_number().over(tier)).filter(F.col("nth") <= (MOST if limit else n))
    if limit:
        best = best.filter(F.col("nth") <= F.col(n))
    first = best.groupBy("query_id", *limit, place).agg(F.min(F.struct("tier", "nth", "score", F.col("key").alias("at"))).alias("b")).select("query_id", *limit, "b.tier", "b.nth", "b.score", F.col("b.at").alias("key"))
    return _top(first, n, F.asc("tier"), F.asc("nth")).select("query_id", "tier", "key", "score", "rank")


def bm25(chunks: DataFrame, queries: DataFrame, n: int | str = 20) -> DataFrame:
    """Chunks (key, content, ...) that hold all terms of a spelling of a query (query_id, query), the best n: (query_id, key, score, rank). Only the queries' terms are counted and shuffled."""
    tiers = query_tiers(queries, *([n] if isinstance(n, str) else []))
    return score_terms(*index_text(chunks, tiers.select("term").distinct()), tiers, n).drop("tier")


def symbol_exact(symbols: DataFrame, queries: DataFrame, n: int = 10) -> DataFrame:
    """Symbols named like a variant of the query; lower-cased names only for queries without such. Exported ones first."""
    variants = queries.select("query_id", F.explode(symbol_variants(F.col("query"))).alias("v"))
    near = symbols.join(variants.select("query_id", "v", F.lower("v").alias("low")), F.lower("symbol_name") == F.col("low")).withColumn("tier", F.when(F.col("symbol_name") == F.col("v"), 0).otherwise(1))
    near = near.groupBy("query_id", "path", "symbol_name", "symbol_kind", "line_start", "exported").agg(F.min("tier").alias("tier"))
    near = near.withColumn("best", F.min("tier").over(Window.partitionBy("query_id"))).filter("tier = best")
    return _top(near, n, F.desc("exported"), F.asc("path"), F.asc("line_start"), F.asc("symbol_name")).select("query_id", "path", "symbol_name", "symbol_kind", "line_start", "exported", "tier", "rank")


def symbol_prefix(symbols: DataFrame, queries: DataFrame, n: int = 10) -> DataFrame:
    """Symbols whose lower-cased names begin with a variant of the query. Both sides meet under the variant's first HEAD characters, or as many as it has."""
    low = F.lower("symbol_name")
    variants = queries.select("query_id", F.explode(F.array_distinct(F.transform(symbol_variants(F.col("query")), F.lower))).alias("v")).withColumn("head", F.substring("v", 1, HEAD))
    heads = symbols.withColumn("head", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.lit(HEAD)), lambda k: F.substring(low, F.lit(1), k)))))
    near = heads.join(variants, "head").filter(low.startswith(F.col("v"))).select("query_id", "path", "symbol_name", "symbol_kind", "line_start", "exported").distinct()
    return _top(near, n, F.desc("exported"), F.asc("path"), F.asc("line_start"), F.asc("symbol_name"))


def packed(vectors: DataFrame, key: str) -> DataFrame:
    """Sparse vectors (key, bucket, weight) as a row each: (key, buckets, weights)."""
    rows = vectors.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("bucket", "weight"))).alias("v"))  # a bucket at most once
    return rows.select(key, F.col("v.bucket").alias("buckets"), F.col("v.weight").alias("weights"))


def nearest(vectors: DataFrame, queries: DataFrame, n: int = 20, block: int = 1024) -> DataFrame:
    """Exact vector search: the n rows of vectors (key, buckets, weights) of greatest dot product, rounded to 6 digits, if positive, with each of queries (query_id, buckets, weights), best first: (query_id, key, score, rank).

    Queries go to the tasks in blocks. A task multiplies its rows with a block as matrices and keeps n of each query, so what is shuffled doesn't grow with the pairs.
    """
    import pyarrow as pa

    asked = sorted((r.query_id, r.buckets, r.weights) for r in queries.collect())  # a batch of queries
    if not asked:
        return vectors.limit(0).select(F.lit(0).cast("long").alias("query_id"), "key", F.lit(0.0).alias("score"), F.lit(0).alias("rank"))
    spark, found = vectors.sparkSession, None
    for k in range(0, len(asked), block):
        shared = spark.sparkContext.broadcast(asked[k : k + block])

        def run(batches, shared=shared):
            import numpy as np

            def dense(rows, dim):
                out = np.zeros((len(rows), dim))
                for row, (at, w) in zip(out, rows, strict=True):
                    row[at] = w
                return out

            ids, dim = [q[0] for q in shared.value], 1 + max(max(q[1], default=0) for q in shared.value)
            matrix = dense([q[1:] for q in shared.value], dim).T
            best: list[list[tuple[float, str]]] = [[] for _ in ids]
            for b in batches:
                for at in range(0, b.num_rows, 4096):
                    part = b.slice(at, 4096)
                    keys, width = part.column(0).to_pylist(), [len(x) for x in part.column(1)]
                    buckets, weights = part.column(1).flatten().to_numpy(), part.column(2).flatten().to_numpy()
                    rows, inside = np.repeat(np.arange(len(keys)), width), buckets < dim
                    left = np.zeros((len(keys), dim))
                    left[rows[inside], buckets[inside]] = weights[inside]
                    scores = np.round(left @ matrix, 6)
                    least = np.partition(scores, -n, axis=0)[-n] if len(keys) > n else np.zeros(len(ids))
                    for q, kept in enumerate(best):
                        hits = np.flatnonzero((scores[:, q] > 0) & (scores[:, q] >= least[q]))
                        kept += [(-float(scores[i, q]), keys[i]) for i in hits]
                        kept.sort()
                        del kept[n:]
            rows = [(ids[q], key, -s) for q, kept in enumerate(best) for s, key in kept]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.float64())], ["query_id", "key", "score"])

        part = vectors.select("key", "buckets", "weights").mapInArrow(run, "query_id long, key string, score double")
        found = part if found is None else found.unionByName(part)
    return _top(found, n, F.desc("score"), F.asc("key"))


def pool(vectors: DataFrame, n: int) -> DataFrame:
    """The candidates that a bounded search scores: the first max(50 n, 500) by key. nearest() over all vectors is exact."""
    return vectors.orderBy("key").limit(max(50 * n, 500))


def baseline_targets(targets: list[str], root: str) -> list[str]:
    """Where the literal search looks: the domains' targets if there are 1 to 32, else the root."""
    return targets if 1 <= len(targets) <= 32 else [root]


def vector_search(vectors: DataFrame, queries: DataFrame, n: int = 20) -> DataFrame:
    """nearest() over sparse vectors (key, bucket, weight) and (query_id, bucket, weight)."""
    return nearest(packed(vectors, "key"), packed(queries, "query_id"), n)


def cosine_topk(vectors: DataFrame, queries: DataFrame, n: int = 20) -> DataFrame:
    """nearest() over dense vectors (key, embedding) and (query_id, embedding): only vectors of the query's length count."""
    found = None
    for r in sorted(queries.select(F.size("embedding").alias("dim")).distinct().collect()):  # a batch's lengths
        sparse = lambda df, key, dim=r.dim: df.filter(F.size("embedding") == dim).select(key, F.sequence(F.lit(0), F.lit(dim - 1)).alias("buckets"), F.col("embedding").cast("array<double>").alias("weights"))
        part = nearest(sparse(vectors, "key"), sparse(queries, "query_id"), n)
        found = part if found is None else found.unionByName(part)
    return found if found is not None else nearest(vectors.select("key", F.array().cast("array<int>").alias("buckets"), F.array().cast("array<double>").alias("weights")), queries.select("query_id", F.lit(None).alias("buckets"), F.lit(None).alias("weights")), n)


def masked_mean(tokens: Column, mask: Column) -> Column:
    """The mean of the token vectors (arrays of double) whose mask isn't 0, per dimension, and zeros if there is none."""
    kept = F.filter(F.zip_with(tokens, mask, lambda t, m: F.struct(t.alias("t"), m.alias("m"))), lambda x: x["m"] != 0)
    zero = F.transform(F.get(tokens, 0), lambda _: F.lit(0.0))
    total = F.aggregate(kept, zero, lambda s, x: F.zip_with(s, x["t"], lambda a, b: a + b.cast("double")))
    return F.transform(total, lambda x: x / F.greatest(F.size(kept), F.lit(1)))


def dot(a: Column, b: Column) -> Column:
    """Zero where lengths differ."""
    return F.when(F.size(a) == F.size(b), F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)).otherwise(0.0)


def pad_truncate(v: Column, dim: int) -> Column:
    return F.slice(F.concat(v, F.array_repeat(F.lit(0.0).cast("float"), dim)), 1, dim)


def holding(rows: DataFrame, text: str, needles: DataFrame, ignore_case: bool = False, block: int = 1024) -> DataFrame:
    """(id, place...) pairs: each id of needles (id, needle) with the other columns of each row whose text holds the needle, once. A null needle or text matches nothing, an empty needle every text.

    Needles go to the tasks in blocks, as automata, so a text is read once a block, however many needles that has.
    """
    import pyarrow as pa

    fold = (lambda t: t.lower()) if ignore_case else (lambda t: t)
    asked = sorted((r[0], fold(r[1])) for r in needles.collect() if r[1] is not None)  # a batch of queries
    places = [f for f in rows.schema.fields if f.name != text]
    name = needles.columns[0]
    schema = StructType([StructField(name, needles.schema.fields[0].dataType), *places])
    spark, found = rows.sparkSession, None
    for k in range(0, max(len(asked), 1), block):
        shared = spark.sparkContext.broadcast(asked[k : k + block])

        def run(batches, shared=shared):
            import ahocorasick

            automaton, always = ahocorasick.Automaton(), [i for i, x in shared.value if not x]
            ids: dict[str, list] = {}
            for i, x in shared.value:
                if x:
                    ids.setdefault(x, []).append(i)
            for x, own in ids.items():
                automaton.add_word(x, own)
            automaton.make_automaton()
            for b in batches:
                for at in range(0, b.num_rows, 256):
                    part, left, right = b.slice(at, 256), [], []
                    for row, t in enumerate(part.column(0)):
                        t = t.as_py()
                        if t is not None:
                            hits = set(always)
                            if ids:
                                for _, own in automaton.iter(fold(t)):
                                    hits.update(own)
                            left += hits
                            right += [row] * len(hits)
                    yield pa.RecordBatch.from_arrays([pa.array(left, names[0].type), *[c.take(pa.array(right, pa.int64())) for c in part.columns[1:]]], schema=pa.schema(names))

        from pyspark.sql.pandas.types import to_arrow_type

        names = [pa.field(f.name, to_arrow_type(f.dataType)) for f in schema.fields]
        part = rows.select(text, *[f.name for f in places]).mapInArrow(run, schema)
        found = part if found is None else found.unionByName(part)
    return found.distinct()


def literal_search(files: DataFrame, queries: DataFrame, n: int = 20, ignore_case: bool = False) -> DataFrame:
    """The fixed-string baseline: the first n paths that hold the query."""
    return _top(holding(files.select("content", "path"), "content", queries.select("query_id", "query"), ignore_case), n, F.asc("path"))


def rrf(lists: DataFrame, k: int = RRF_K) -> DataFrame:
    """lists: (query_id, key, list, rank). Fused: (query_id, key, score_rrf, first_list), the metadata being that of the earliest list."""
    return lists.groupBy("query_id", "key").agg(F.sum(1.0 / (F.lit(k) + F.col("rank"))).alias("score_rrf"), F.min(F.struct("list", "rank")).alias("f")).select("query_id", "key", F.round("score_rrf", 9).alias("score_rrf"), F.col("f.list").alias("first_list"))


def path_prior(path: Column) -> Column:
    code, asset = in_class(path, "code"), in_class(path, "asset")
    out = F.lit(1.0)
    for hit, factor in ((code, 1.15), (in_class(path, "docs"), 0.85), (in_class(path, "test"), 0.95), (asset & ~code, 0.45), (in_class(path, "generated"), 0.30)):
        out = out * F.when(hit, factor).otherwise(1.0)
    return out


def overlap_prior(query: Column, path: Column, weight: float) -> Column:
    q, p = overlap_terms(query), overlap_terms(path)
    matched = F.size(F.filter(q, lambda t: F.exists(p, lambda s: s.startswith(t) | t.startswith(s))))
    return F.when((F.size(q) == 0) | (F.size(p) == 0), 1.0).otherwise(1.0 + weight * matched / F.size(q))


def recency_prior(modified_ms: Column, as_of_ms: int, half_life_h: float = 24.0, least: float = 0.85, most: float = 1.20) -> Column:
    age = (F.lit(as_of_ms) - modified_ms) / F.lit(3600000.0)
    return F.when(modified_ms <= 0, 1.0).when(age <= 0, most).otherwise(least + (most - least) * F.pow(F.lit(0.5), age / half_life_h))


#: For each intent: (path class, factor), the first that holds counts.
INTENT_FACTORS = {
    "is_config": (("config", 1.30), ("docs", 0.95), ("code", 0.88)),
    "is_schema": (("docs", 2.80), ("config", 0.65), ("script", 0.80), ("code", 0.35)),
    "is_narrative": (("docs", 1.28), ("script", 0.86), ("code", 0.92)),
    "is_command": (("script", 2.10), ("docs", 0.68), ("config", 0.68), ("code", 0.72)),
    "is_workflow": (("workflow", 1.90), ("docs", 0.82), ("config", 0.86), ("code", 0.72)),
    "is_unit": (("unit", 1.40), ("docs", 0.92), ("config", 0.95), ("code", 0.88)),
}


def intent_prior(path: Column, name: str) -> Column:
    out = None
    for cls, factor in INTENT_FACTORS[name]:
        out = F.when(in_class(path, cls), factor) if out is None else out.when(in_class(path, cls), factor)
    on = F.col(name) & ~F.col("is_schema") if name == "is_narrative" else F.col(name)
    return F.when(on, out.otherwise(1.0)).otherwise(1.0)


def prior(query: Column, path: Column, modified_ms: Column, as_of_ms: int) -> Column:
    """The product of all nine factors; the query's intents are columns."""
    out = path_prior(path) * overlap_prior(query, path, 0.35) * overlap_prior(query, basename(path), 0.55) * recency_prior(modified_ms, as_of_ms)
    for name in INTENT_FACTORS:
        out = out * intent_prior(path, name)
    return out


def dedupe_by_path(hits: DataFrame, n: int = 5) -> DataFrame:
    """hits: (query_id, path, position, ...): the best of each path, then the first n, ranked anew."""
    w = Window.partitionBy("query_id", "path").orderBy("position")
    best = hits.withColumn("nth", F.row_number().over(w)).filter("nth = 1").drop("nth")
    return _top(best, n, F.asc("position"), F.asc("path"))


def query_terms_of(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", F.explode(query_terms(F.col("query"))).alias("term"))
