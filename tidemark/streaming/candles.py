"""Streams of candles: confirmed rows merged by key, and rollups kept up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.functions.intervals import INTERVALS, width
from tidemark.operators.merge import last_wins, upsert
from tidemark.plans import coverage
from tidemark.plans.store import stored, work_dir  # noqa: F401  for those that start streams
from tidemark.sources.feeds import merge_candles
from tidemark.streaming.confirmed import CONFIRMED, settled, started

#: How far back each stored rollup takes late candles in.
LATE = {"60": "3 hours", "240": "12 hours", "D": "3 days"}
KEYS = ["symbol", "interval", "ts"]


def finished(stream: DataFrame, keys: list[str], work: str) -> DataFrame:
    """Runs an aggregation over what is there now, in update mode; the last row of each key."""
    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{work}/out/{number}")

    q = stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{work}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    rows = stream.sparkSession.read.parquet(f"{work}/out/*")
    return last_wins(rows, keys, ["batch"]).drop("batch")


def merge_into(stream: DataFrame, path: str, checkpoint: str, order: str = "arrived") -> StreamingQuery:
    """Merges every micro-batch into a table by interval and week; a batch that runs again changes nothing.

    A batch rewrites the partitions that it touches, which are replaced when all of its files are written.
    """

    def merge(batch: DataFrame, number: int) -> None:
        merge_candles(batch.sparkSession, path, batch, KEYS, [order])

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def settle_into(messages: DataFrame, values: list[str], path: str, reports: str, checkpoint: str, grace: str = "10 minutes", grace_ms: int = 600_000) -> StreamingQuery:
    """Merges the confirmed candles of a message stream into a table, and writes what was never confirmed and who fell silent to ``reports``."""

    def merge(batch: DataFrame, number: int) -> None:
        rows = stored(batch, "settled")
        merge_candles(rows.sparkSession, path, rows.where(F.col("status") == CONFIRMED).drop("status"), KEYS, ["ts"])
        rows.where(F.col("status") != CONFIRMED).write.mode("overwrite").parquet(f"{reports}/batch={number}")

    writer = settled(messages, values, grace, grace_ms).writeStream.foreachBatch(merge).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return started(messages.sparkSession, writer)


def rollup_stream(ticks: DataFrame, code: str, symbol: str, ts: str, price: str, tie: str, late: str | None = None) -> DataFrame:
    """Bars of a stream of trades, by event time; late trades are taken in as far as the watermark allows."""
    at, p = F.struct(ts, tie), F.col(price)
    marked = ticks.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late or LATE.get(code, "1 hour"))
    return marked.groupBy(F.col(symbol).alias("symbol"), F.window(ts, width(code))).agg(
        F.min_by(p, at).alias("open"), F.max(p).alias("high"), F.min(p).alias("low"), F.max_by(p, at).alias("close"), F.count("*").alias("n")
    ).select("symbol", F.col("window.start").alias("ts"), "open", "high", "low", "close", "n")


def repaired(stored: DataFrame, fresh: DataFrame, code: str, now, last: int = 5) -> DataFrame:
    """After an error in a stream: the last candles are collected anew and merged."""
    again = fresh.where((F.col("ts") >= now - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(last * INTERVALS[code] // 1000))) & (F.col("ts") <= now))
    return upsert(stored, again, ["symbol", "ts"])


def backfill(covered: DataFrame, fetch, write, code: str, rounds: int = 10) -> tuple[DataFrame, int]:
    """Fills gaps until none is left or a round brings nothing new; what is covered then, and the rounds run.

    ``fetch(gaps)`` gives candles for a table of gaps, ``write(candles)`` stores them. A round reads the covered intervals and the candles
    that it fetched; stored candles aren't read.
    """
    for k in range(rounds):
        found = stored(coverage.gaps(covered, code), "gaps")
        if found.isEmpty():
            return covered, k
        rows = stored(fetch(found), "fetched")
        write(rows)
        after = stored(coverage.added(covered, rows, code), "covered")
        if coverage.total(after) == coverage.total(covered):
            return after, k
        covered = after
    return covered, rounds


def resume_side(first_ms, last_ms, launch_ms, now_ms):
    """Where collecting goes on: the older history if the launch is before the first candle, else from the last one."""
    older = launch_ms < first_ms
    start = F.when(first_ms.isNull() | older, launch_ms).otherwise(last_ms)
    return start.alias("start_ms"), F.when(older, first_ms).otherwise(now_ms).alias("end_ms")
