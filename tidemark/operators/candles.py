"""Candles: ticks to bars, resampling, rollups, ranges, gaps and statistics.

A candle has ``symbol``, ``ts`` (start of its bar), ``open``, ``high``, ``low``, ``close``, ``volume`` and ``turnover``. All
operators work on any number of symbols in one plan and shuffle on (symbol, bucket) at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.intervals import INTERVALS, bucket, to_ms
from tidemark.plans.series import cut

MAX_LIMIT = 1000
VALUES = ["open", "high", "low", "close", "volume", "turnover"]


def bars(ticks: DataFrame, code: str, symbol: str, ts: str, price: str, tie: str) -> DataFrame:
    """Bars of an interval from single trades; ``tie`` orders trades of one moment. Volume sums prices, turnover their squares."""
    at, p = F.struct(ts, tie), F.col(price)
    return ticks.groupBy(F.col(symbol).alias("symbol"), bucket(ts, code).alias("ts")).agg(
        F.min_by(p, at).alias("open"), F.max(p).alias("high"), F.min(p).alias("low"), F.max_by(p, at).alias("close"),
        F.sum(p).alias("volume"), F.sum(p * p).alias("turnover"), F.count("*").alias("n"),
    )


def rollup(candles: DataFrame, code: str) -> DataFrame:
    """Coarser candles, buckets that lack candles included; ``n`` counts what each is made of."""
    return candles.groupBy("symbol", bucket("ts", code).alias("bucket")).agg(
        F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"),
        F.sum("volume").alias("volume"), F.sum("turnover").alias("turnover"), F.count("*").alias("n"),
    ).withColumnRenamed("bucket", "ts")


def resample(candles: DataFrame, base: str, target: str) -> DataFrame:
    """Coarser candles of complete buckets only."""
    if INTERVALS[target] % INTERVALS[base]:
        raise ValueError(f"{target} isn't a multiple of {base}")
    return rollup(candles, target).where(F.col("n") >= INTERVALS[target] // INTERVALS[base])


def capped(limit: int | None) -> int | None:
    """A limit as callers may ask for it: at most ``MAX_LIMIT``; null and 0 mean none."""
    return min(limit, MAX_LIMIT) if limit else None


def newest(candles: DataFrame, limit: int | None = None) -> DataFrame:
    """Newest first; sort and limit run as one top-k."""
    out = candles.orderBy(F.desc("ts"), "symbol")
    return out if not limit else out.limit(limit)


def in_range(candles: DataFrame, start: str, end: str) -> DataFrame:
    """Candles between two times, both included."""
    return candles.where(F.col("ts").between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")))


def gaps(candles: DataFrame, code: str, by: list[str] | None = None, segments: int | None = None) -> DataFrame:
    """``gap_start`` (ms, included) and ``gap_end`` (ms, not included) of holes of two candles or more.

    One missing candle is no gap, and neither is what lacks before the first or after the last candle. Series are cut by key and time
    (``plans/series``), and the first candle of a segment is handed to the segment before it. Rows without a key or a time are left out.
    """
    keys, w = by or ["symbol"], INTERVALS[code]
    s = cut(candles.select(*keys, to_ms(F.col("ts")).alias("ms")), keys, "ms", segments)
    kinds = "next long"
    heads = s.rows.groupBy(*s.key).agg(F.min("ms").alias("head"))
    rows = s.with_carried(s.rows, s.carried(heads, lambda chain: [(r["head"],) for r in chain[1:]] + [(None,)], kinds), kinds)
    found = rows.withColumn("gap_end", F.coalesce(F.lead("ms").over(s.within()), "next")).where(F.col("gap_end") - F.col("ms") > 2 * w)
    return found.select(*keys, (F.col("ms") + w).alias("gap_start"), "gap_end")


def first_gap(candles: DataFrame, code: str, last_complete_ms: int, segments: int | None = None) -> DataFrame:
    """Each symbol's earliest gap, if it ends before the last complete candle."""
    first = gaps(candles, code, segments=segments).groupBy("symbol").agg(F.min(F.struct("gap_start", "gap_end")).alias("gap"))
    return first.select("symbol", "gap.gap_start", "gap.gap_end").where(F.col("gap_end") < last_complete_ms)


def page_gap(candles: DataFrame, code: str, cursor_ms: int) -> DataFrame:
    """Candles missing between a page's cursor and its first candle."""
    first = candles.groupBy("symbol").agg(F.min(to_ms(F.col("ts"))).alias("first_ms"))
    return first.select("symbol", F.greatest(F.lit(0), F.floor((F.col("first_ms") - cursor_ms) / INTERVALS[code])).cast("long").alias("missing"))


def time_range(candles: DataFrame) -> DataFrame:
    ms = to_ms(F.col("ts"))
    return candles.groupBy("symbol").agg(F.min(ms).alias("first_ms"), F.max(ms).alias("last_ms"))


def stats_by_interval(candles: DataFrame) -> DataFrame:
    ms = to_ms(F.col("ts"))
    return candles.groupBy("symbol", "interval").agg(F.count("*").alias("n"), F.min(ms).alias("first_ms"), F.max(ms).alias("last_ms"))


def nested_stats(symbols: DataFrame, candles: DataFrame) -> DataFrame:
    """Each symbol with its statistics as JSON; one without candles has one object of nulls. Aggregates before it joins."""
    stats = stats_by_interval(candles)
    listed = symbols.join(stats, "symbol", "left").groupBy("symbol").agg(F.sort_array(F.collect_list(F.struct("interval", "n", "first_ms", "last_ms"))).alias("stats"))
    return listed.select("symbol", F.to_json("stats", {"ignoreNullFields": "false"}).alias("stats"))


def as_arrays(candles: DataFrame) -> DataFrame:
    """Candles as JSON arrays: time, open, high, low, close, volume, turnover."""
    return candles.select("symbol", F.to_json(F.array(to_ms(F.col("ts")).cast("double"), *[F.col(c).cast("double") for c in VALUES])).alias("row"))
