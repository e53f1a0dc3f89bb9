"""Change streams: debounced batches, change counts, reindex plans, phases; batch and Structured Streaming forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.policy import decide

GAP, BULK, CAP, PENDING = "30 minutes", 80, 32, 20


def debounce(events: DataFrame, key: str = "user_id", gap: str = GAP) -> DataFrame:
    """A batch of a key closes after `gap` of silence: (key, batch_start, batch_end, n)."""
    return events.groupBy(key, F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("batch_start"), F.col("w.end").alias("batch_end"), "n")


def debounce_stream(events: DataFrame, key: str = "user_id", gap: str = GAP, late: str = "1 hour") -> DataFrame:
    """The same over a stream: by event time, so a watermark says how late an event may be."""
    return debounce(events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late), key, gap)


def change_counts(events: DataFrame, allow: list[str] | None = None, deny: list[str] | None = None, allow_hidden: bool = False) -> DataFrame:
    """events: (batch, path): changes of each path that the policy allows in each batch."""
    return events.filter(decide(F.col("path"), allow or [], deny or [], allow_hidden)[0]).groupBy("batch", "path").agg(F.count(F.lit(1)).alias("n"))


def kinds(events: DataFrame) -> DataFrame:
    """events: (ts, path, what) with what in created, modified, removed, in any spelling of case. (path, kind, n, last): what a batch leaves to do for each path: nothing for one that was created and removed in it, else its last event; one that was removed and created again is modified."""
    seen = events.withColumn("what", F.lower("what")).groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last"), F.min_by("what", F.struct("ts", "what")).alias("first"), F.max_by("what", F.struct("ts", "what")).alias("end"))
    kind = F.when((F.col("first") == "created") & (F.col("end") == "removed"), "none").when(F.col("end") == "removed", "removed").when(F.col("first") == "created", "created").otherwise("modified")
    return seen.select("path", kind.alias("kind"), "n", "last")


def reindex_plan(counts: DataFrame, threshold: int = BULK, cap: int = CAP) -> DataFrame:
    """Of each batch the paths, most changed first: a batch of at least threshold paths is bulk and only its first cap are hot; others are hot whole."""
    rank = F.row_number().over(Window.partitionBy("batch").orderBy(F.desc("n"), "path"))
    total = F.count(F.lit(1)).over(Window.partitionBy("batch"))
    return counts.withColumn("rank", rank).withColumn("total", total).select("batch", "path", "n", "rank", (F.col("total") >= threshold).alias("bulk"), F.when((F.col("total") < threshold) | (F.col("rank") <= cap), "hot").otherwise("deferred").alias("lane"))


def phases(plan: DataFrame) -> DataFrame:
    """The phase after each path of a plan is done: hot set while hot paths remain, then backfill."""
    hot, batch = (F.col("lane") == "hot").cast("int"), Window.partitionBy("batch")
    left = F.sum(hot).over(batch) - F.sum(hot).over(batch.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    return plan.withColumn("hot_left", left).withColumn("phase", F.when(F.col("hot_left") > 0, "p1_hotset").otherwise("p3_backfill"))


def pending(plan: DataFrame, limit: int = PENDING) -> DataFrame:
    """(batch, n_deferred, pending): the first deferred paths by name."""
    rn = F.row_number().over(Window.partitionBy("batch").orderBy("path"))
    rows = plan.filter("lane = 'deferred'").withColumn("rn", rn)
    return rows.groupBy("batch").agg(F.count(F.lit(1)).alias("n_deferred"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("rn") <= limit, F.col("path")))), ",").alias("pending"))
