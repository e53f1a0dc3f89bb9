"""Relevance metrics, comparisons, gates, drift and reports."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def first_relevant_rank(hits: DataFrame, expected: DataFrame) -> DataFrame:
    """hits (query_id, path, rank), expected (query_id, path): the least rank of an expected path, for every query of expected."""
    found = hits.join(expected, ["query_id", "path"]).groupBy("query_id").agg(F.min("rank").alias("first_rank"))
    return expected.select("query_id").distinct().join(found, "query_id", "left")


def metrics(ranks: DataFrame, *by: str) -> DataFrame:
    """ranks: (query_id, first_rank, is_symbol, ...): recall (any hit), MRR, and the share of symbol queries of rank 1, which is 1 if there are none."""
    return ranks.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_queries"),
        F.round(F.avg(F.col("first_rank").isNotNull().cast("double")), 6).alias("recall"),
        F.round(F.avg(F.coalesce(1.0 / F.col("first_rank"), F.lit(0.0))), 6).alias("mrr"),
        F.round(F.coalesce(F.avg(F.when(F.col("is_symbol"), (F.coalesce("first_rank", F.lit(0)) == 1).cast("double"))), F.lit(1.0)), 6).alias("symbol_hit_rate"),
    )


def query_gap(ranks: DataFrame) -> DataFrame:
    """ranks: (query_id, ours, theirs): counts of gap classes; a query that both miss counts as both."""
    ours, theirs = F.col("ours"), F.col("theirs")
    classes = F.array_compact(F.array(F.when(ours.isNull(), F.lit("semantic_miss")), F.when(theirs.isNull(), F.lit("baseline_miss")), F.when(ours > theirs, F.lit("rank_lag")), F.when(ours < theirs, F.lit("gain")), F.when(ours == theirs, F.lit("equal"))))
    return ranks.select(F.explode(classes).alias("gap")).groupBy("gap").agg(F.count(F.lit(1)).alias("n"))


def release_gate(m: DataFrame, recall: float = 0.90, mrr: float = 0.80, symbol: float = 0.99, queries: int = 20) -> DataFrame:
    """(check, value, threshold, passed) and the verdict over all."""
    checks = F.array(*[F.struct(F.lit(n).alias("check"), F.col(c).cast("double").alias("value"), F.lit(float(t)).alias("threshold")) for n, c, t in (("recall", "recall", recall), ("mrr", "mrr", mrr), ("symbol_hit_rate", "symbol_hit_rate", symbol), ("n_queries", "n_queries", queries))])
    rows = m.select(F.inline(checks)).withColumn("passed", F.col("value") >= F.col("threshold"))
    return rows.unionByName(rows.agg(F.lit("all").alias("check"), F.lit(None).cast("double").alias("value"), F.lit(None).cast("double").alias("threshold"), F.bool_and("passed").alias("passed")))


def checked(values: DataFrame, limits: dict[str, float]) -> DataFrame:
    """values (metric, value): (check, value, threshold, passed) of the metrics that have an upper limit, and the verdict over all; a metric that is missing fails."""
    spark = values.sparkSession
    wanted = spark.createDataFrame(sorted(limits.items()), "check string, threshold double")
    rows = wanted.join(values.select(F.col("metric").alias("check"), F.col("value").cast("double")), "check", "left").select("check", "value", "threshold", F.coalesce(F.col("value") <= F.col("threshold"), F.lit(False)).alias("passed"))
    return rows.unionByName(rows.agg(F.lit("all").alias("check"), F.lit(None).cast("double").alias("value"), F.lit(None).cast("double").alias("threshold"), F.bool_and("passed").alias("passed")))


def bounded_sample(samples: DataFrame, cap: int, by: str, order: str, value: str) -> DataFrame:
    """What a ring of `cap` places keeps of samples that come in order: the last of each place, places being the running number modulo cap."""
    n = F.row_number().over(Window.partitionBy(by).orderBy(order))
    placed = samples.withColumn("nth", n).withColumn("place", F.pmod(F.col("nth") - 1, F.lit(cap)))
    return placed.groupBy(by, "place").agg(F.max_by(value, "nth").alias(value))


def sweep(spark: SparkSession, backends: list[str], tops: list[int]) -> DataFrame:
    """The grid of settings: (backend, top), a configuration's size."""
    return spark.createDataFrame([(b, t) for b in backends for t in tops], "backend string, top int")


def best_setting(runs: DataFrame, by: list[str], setting: list[str], measure: str) -> DataFrame:
    """Of each group the setting of the greatest measure, of equal ones the first by its columns."""
    w = Window.partitionBy(*by).orderBy(F.desc(measure), *setting)
    return runs.withColumn("nth", F.row_number().over(w)).filter("nth = 1").select(*by, *setting, measure)


#: Status of a candidate domain: what is to be done with it.
PROMOTION = {"uncovered": "promote_candidate", "covered_gap": "harden_existing", "covered_partial": "expand_parent_root", "covered_representative": "add_strict_holdout", "covered_ok": "monitor"}


def promotion(status: Column, next_action: Column) -> Column:
    out = None
    for known, state in PROMOTION.items():
        out = F.when(status == known, state) if out is None else out.when(status == known, state)
    return out.when(next_action == "query_level_triage", "harden_existing").otherwise("review")


def promotion_counts(rows: DataFrame) -> DataFrame:
    """rows (status, next_action): a count of every state, those without a row included."""
    state = promotion(F.col("status"), F.col("next_action")).alias("state")
    names = [*PROMOTION.values(), "review"]
    counts = rows.select(state).agg(*[F.count_if(F.col("state") == n).alias(n) for n in names])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(n).alias("state"), F.col(n).alias("n")) for n in names])))


def choose_queries(candidates: Iterable[tuple[str, str]], most: int) -> list[tuple[str, str]]:
    """Of (symbol, path) in order at most `most`: first those whose symbol and path are both new, then, if that is too few, those whose symbol is. Holds what it chooses and as many candidates for the second pass."""
    chosen: list[tuple[str, str]] = []
    later: list[tuple[str, str]] = []
    symbols, paths, kept = set(), set(), set()
    for symbol, path in candidates:
        if len(chosen) >= most:
            break
        if symbol in symbols:
            continue
        if path in paths:
            if symbol not in kept and len(later) < most:
                later.append((symbol, path))
                kept.add(symbol)
            continue
        chosen.append((symbol, path))
        symbols.add(symbol)
        paths.add(path)
    for symbol, path in later:
        if len(chosen) < most and symbol not in symbols:
            chosen.append((symbol, path))
            symbols.add(symbol)
    return chosen


def profile_matrix(profiles: dict[str, DataFrame]) -> DataFrame:
    """A row of metrics a profile."""
    out = None
    for name, m in profiles.items():
        row = m.select(F.lit(name).alias("profile"), *m.columns)
        out = row if out is None else out.unionByName(row)
    return out


#: Settings of ranking that a tuning run tries.
PRESETS = {
    "base": {},
    "symbol_focus": {"symbol_exact_boost": 3.0, "symbol_prefix_boost": 1.5, "code_path_boost": 1.30, "docs_path_penalty": 0.80, "test_path_penalty": 0.90},
    "code_focus": {"symbol_exact_boost": 2.8, "symbol_prefix_boost": 1.4, "code_path_boost": 1.40, "docs_path_penalty": 0.70, "test_path_penalty": 0.85, "topn_bm25": 30.0, "topn_vector": 30.0},
}


def presets(spark: SparkSession) -> DataFrame:
    """(preset, setting, value); base has none."""
    return spark.createDataFrame([(p, k, float(v)) for p, own in PRESETS.items() for k, v in own.items()], "preset string, setting string, value double")


def exposition(histograms: DataFrame, name: str, by: str) -> DataFrame:
    """(by, text): a histogram as metrics text, from (by, le, cumulative) of histogram(): a line a bucket, then that without a bound and the count."""
    tag = F.concat(F.lit(f'{name}_bucket{{{by}="'), F.col(by), F.lit('",le="'))
    line = F.concat(tag, F.col("le").cast("string"), F.lit('"} '), F.col("cumulative").cast("string"))
    rows = histograms.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("le", line.alias("s")))).alias("rows"), F.max("cumulative").cast("string").alias("total"))  # a row a bucket
    last = F.concat(tag, F.lit('+Inf"} '), F.col("total"), F.lit(f'\n{name}_count{{{by}="'), F.col(by), F.lit('"} '), F.col("total"))
    return rows.select(by, F.concat(F.lit(f"# TYPE {name} histogram\n"), F.array_join(F.transform("rows", lambda r: r["s"]), "\n"), F.lit("\n"), last).alias("text"))


def hit_ratio(hits: Column, misses: Column) -> Column:
    """0 where there was no request."""
    return F.when(hits + misses == 0, 0.0).otherwise(F.round(hits / (hits + misses), 6))


def write_report(report: DataFrame, path: str, stamp: str | None = None) -> None:
    """One JSON file under path, the latest, and a copy under history/<stamp> if asked for."""
    report.coalesce(1).write.mode("overwrite").json(f"{path}/latest")  # a report is a few rows
    if stamp:
        report.coalesce(1).write.mode("errorifexists").json(f"{path}/history/{stamp}")


def nearest_rank(values: DataFrame, by: str, value: str, ps: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    """The values at places round((n - 1) * p) and the maximum. Distinct values are counted first, so a common one is one row."""
    counts = values.groupBy(by, value).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(by).orderBy(value)
    placed = counts.withColumn("upto", F.sum("n").over(w)).withColumn("total", F.sum("n").over(Window.partitionBy(by)))
    at = lambda p: F.min(F.when(F.col("upto") > F.floor((F.col("total") - 1) * p + 0.5), F.col(value)))
    return placed.groupBy(by).agg(*[at(p).alias(f"p{round(100 * p)}") for p in ps], F.max(value).alias("max_value"), F.max("total").alias("n"))


def median_int(values: DataFrame, by: str, value: str) -> DataFrame:
    """The median; of an even number the integer mean of the middle two."""
    w = Window.partitionBy(by).orderBy(value)
    rows = values.withColumn("rn", F.row_number().over(w)).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(by)))
    return rows.filter((F.col("rn") == F.expr("(n + 1) div 2")) | (F.col("rn") == F.expr("n div 2 + 1"))).groupBy(by).agg(F.expr(f"sum({value}) div count(1)").alias("median"))


BUCKETS = (1, 5, 10, 25, 50, 100, 250, 500, 1000, 2000)


def histogram(values: DataFrame, by: str, value: str) -> DataFrame:
    """(by, le, n, cumulative) over BUCKETS; what exceeds the last bound counts in it."""
    le = F.coalesce(*[F.when(F.col(value) <= b, b) for b in BUCKETS], F.lit(BUCKETS[-1]))
    counts = values.groupBy(by, le.alias("le")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("cumulative", F.sum("n").over(Window.partitionBy(by).orderBy("le")))


def drift(runs: DataFrame, last: int = 7) -> DataFrame:
    """runs: (dataset, run, delta): of each dataset the last runs' least, mean and greatest delta, and the latest."""
    rn = F.row_number().over(Window.partitionBy("dataset").orderBy(F.desc("run")))
    recent = runs.withColumn("rn", rn).filter(F.col("rn") <= last)
    return recent.groupBy("dataset").agg(F.count(F.lit(1)).alias("n_runs"), F.round(F.min("delta"), 6).alias("min_delta"), F.round(F.avg("delta"), 6).alias("avg_delta"), F.round(F.max("delta"), 6).alias("max_delta"), F.max("run").alias("latest"))


def complete_nights(runs: DataFrame, required: list[str]) -> DataFrame:
    """Nights whose datasets include all required ones."""
    have = runs.groupBy("night").agg(F.collect_set("dataset").alias("have"))
    return have.filter(F.size(F.array_except(F.array(*map(F.lit, required)), "have")) == 0).select("night")


def coverage(candidates: DataFrame, seen: DataFrame) -> DataFrame:
    """candidates (key, priority), seen (key, ts): status, representative and bucket. A key covers itself, else the deepest key above it covers it, and that is its representative."""
    known = seen.groupBy(F.col("key").alias("at")).agg(F.max("ts").alias("ts"))
    parts = F.split("key", "/")
    up = candidates.select("key", F.posexplode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))).alias("depth", "at"))
    cover = up.join(known, "at").groupBy("key").agg(F.max_by("at", "depth").alias("representative"))
    out = candidates.join(cover, "key", "left")
    status = F.when(F.col("representative") == F.col("key"), "covered").when(F.col("representative").isNotNull(), "covered_by_parent").otherwise("uncovered")
    return out.select("key", status.alias("status"), "representative", F.when(F.col("priority") >= 3, "high").when(F.col("priority") == 2, "medium").otherwise("low").alias("bucket"))


def coverage_counts(covered: DataFrame) -> DataFrame:
    return covered.groupBy("status", "bucket").agg(F.count(F.lit(1)).alias("n"))


def identity_dedupe(rows: DataFrame) -> DataFrame:
    """rows (identity, path, is_mirror, n_files, n_code): of each identity the one that isn't a mirror, then of more files, more code, shorter path."""
    w = Window.partitionBy("identity").orderBy("is_mirror", F.desc("n_files"), F.desc("n_code"), F.length("path"), "path")
    return rows.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")


def candidate_select(rows: DataFrame) -> DataFrame:
    score = 1000 * F.col("mrr") + 100 * F.col("recall") + 100 * F.col("symbol") - 0.01 * F.col("p95")
    return rows.withColumn("score", F.round(score, 6)).orderBy(F.desc("score"), F.desc("mrr"), F.desc("recall"), F.asc("p95"), F.asc("name")).limit(1)


def split_suite(rows: DataFrame, tune: int) -> DataFrame:
    """rows (dataset, position, id): even positions, then odd ones; the first `tune` of a dataset tune, the others are held out."""
    rn = F.row_number().over(Window.partitionBy("dataset").orderBy(F.col("position") % 2, "position"))
    return rows.withColumn("split", F.when(rn <= tune, "tune").otherwise("holdout"))
