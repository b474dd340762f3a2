"""Error statistics and progress over an event log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.plans.store import small, stored


def error_frequency(log: DataFrame, by: str, ts: str, since: Column) -> DataFrame:
    """Errors an hour over the span of a key; 0 for a single moment or for keys last seen before ``since``."""
    g = log.groupBy(by).agg(F.count("*").alias("n"), F.min(ts).alias("first"), F.max(ts).alias("last"))
    span = F.unix_timestamp(F.col("last").cast("timestamp")) - F.unix_timestamp(F.col("first").cast("timestamp"))
    return g.select(by, "n", F.when((F.col("last") < since) | (span <= 0), 0.0).otherwise(F.col("n") / span * 3600).alias("per_hour"))


def recent_errors(log: DataFrame, by: str, ts: str, since: Column) -> DataFrame:
    """Keys seen since a moment, with their count over all time."""
    return log.groupBy(by).agg(F.count("*").alias("n"), F.max(ts).alias("last")).where(F.col("last") >= since)


def affected(log: DataFrame, by: str, entity: str) -> DataFrame:
    """The distinct entities of each key, sorted."""
    return log.groupBy(by).agg(F.sort_array(F.collect_set(entity)).alias("entities"))


def progress(log: DataFrame, by: str, order: str, done: str, total: str, gap: str | None = None) -> DataFrame:
    """Running count of work done and its percentage, at most 100. What a ``gap`` says is missing at the source goes off the total from there on."""
    frame = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    left = F.col(total) - F.sum(F.greatest(F.coalesce(gap, F.lit(0)), F.lit(0))).over(frame) if gap else F.col(total)
    rows = log.select(by, order, F.sum(done).over(frame).alias("done"), left.alias("total"))
    return rows.withColumn("percent", F.least(F.lit(100.0), F.coalesce(F.try_divide(F.col("done") * 100.0, F.greatest("total", F.lit(0))), F.lit(0.0))))


#: Seconds of a block that sliding counts are made in.
BLOCK = 3600


def recent_counts(calls: DataFrame, key: str, ts: str, seconds: int = 60) -> DataFrame:
    """For every second in which a key has calls: ``key``, ``second`` (epoch), ``n`` (its calls) and ``recent`` (calls of the last ``seconds`` seconds, its own included).

    Calls are first counted in panes of one second, so what is dealt out is at most a row a key and second for each task. Panes go into blocks of time, and those at the end of a block into the next one
    too, so that a key of a third of all calls takes many tasks. Calls without a key or a time are left out.
    """
    block = max(BLOCK, seconds)
    second = F.unix_seconds(F.col(ts).cast("timestamp"))
    panes = calls.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).groupBy(F.col(key).alias("key"), second.alias("second")).agg(F.count("*").alias("n"))
    at = F.floor(F.col("second") / block)
    also = F.filter(F.array(at, at + 1), lambda b: (b == at) | (b * block - F.col("second") < seconds))
    blocks = panes.select("key", "second", "n", F.explode(also).alias("block"))
    frame = Window.partitionBy("key", "block").orderBy("second").rangeBetween(1 - seconds, 0)
    out = blocks.select("key", "second", "n", "block", F.sum("n").over(frame).alias("recent"))
    return out.where(F.floor(F.col("second") / block) == F.col("block")).drop("block")


def with_recent(calls: DataFrame, key: str, ts: str, seconds: int = 60) -> DataFrame:
    """Every call with ``recent``, the calls of its key in the seconds up to its own."""
    counts = stored(recent_counts(calls, key, ts, seconds).drop("n"), "counts")
    second = F.unix_seconds(F.col(ts).cast("timestamp"))
    return calls.withColumn("second", second).join(small(counts.withColumnRenamed("key", key)), [key, "second"]).drop("second")
