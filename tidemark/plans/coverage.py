"""Covered time as disjoint intervals per symbol, which say where candles lack without reading the candles.

An interval is [start_ms, end_ms): from the first of a run of candles without a hole to the end of its last one. There are as many as there are holes, so
gaps, resume points and progress come from a small table, and a batch of candles is taken in by the union with its own intervals. Symbols are cut into segments
(``plans/series``), so a batch of one symbol takes many tasks. Rows without a symbol or a time are left out; repeated candles cover once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from tidemark.functions.intervals import INTERVALS, to_ms
from tidemark.plans.series import cut


def union(intervals: DataFrame, segments: int | None = None) -> DataFrame:
    """Intervals that overlap or touch as one, of ``symbol``, ``start_ms``, ``end_ms``."""
    s = cut(intervals.select("symbol", "start_ms", "end_ms"), ["symbol"], "start_ms", segments)
    kinds = "reach long"
    last = s.rows.groupBy(*s.key).agg(F.max("end_ms").alias("most"))

    def hand(chain: list[Row]) -> list[tuple]:
        """How far what comes before each segment reaches."""
        return [(max((r["most"] for r in chain[:i]), default=None),) for i in range(len(chain))]

    rows = s.with_carried(s.rows, s.carried(last, hand, kinds), kinds)
    order = Window.partitionBy(*s.key).orderBy("start_ms", "end_ms")
    before = F.greatest(F.max("end_ms").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.col("reach"))
    run = F.sum(F.when(before >= F.col("start_ms"), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    parts = rows.select(*s.key, "start_ms", "end_ms", run.alias("run")).groupBy(*s.key, "run").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"))
    if not s.spans:
        return parts.select("symbol", "start_ms", "end_ms")
    # run 0 of a segment goes on from the segment before; there is a row a run now, so this ends where a table is one range
    return union(parts.select("symbol", "start_ms", "end_ms"), max(1, s.rows.select("segment").distinct().count() // 8))


def of_candles(candles: DataFrame, code: str, segments: int | None = None) -> DataFrame:
    """The time that candles cover."""
    ms = to_ms(F.col("ts"))
    return union(candles.select("symbol", ms.alias("start_ms"), (ms + INTERVALS[code]).alias("end_ms")), segments)


def added(covered: DataFrame, batch: DataFrame, code: str) -> DataFrame:
    """What is covered after a batch of candles."""
    return union(covered.unionByName(of_candles(batch, code)))


def gaps(covered: DataFrame, code: str) -> DataFrame:
    """``gap_start`` and ``gap_end`` of holes of two candles or more between a symbol's intervals."""
    following = F.lead("start_ms").over(Window.partitionBy("symbol").orderBy("start_ms"))
    found = covered.select("symbol", F.col("end_ms").alias("gap_start"), following.alias("gap_end"))
    return found.where(F.col("gap_end") - F.col("gap_start") > INTERVALS[code])


def ends(covered: DataFrame, code: str) -> DataFrame:
    """The first and the last candle of each symbol."""
    return covered.groupBy("symbol").agg(F.min("start_ms").alias("first_ms"), (F.max("end_ms") - INTERVALS[code]).alias("last_ms"))


def total(covered: DataFrame) -> int:
    """Covered milliseconds of all symbols."""
    return covered.agg(F.sum(F.col("end_ms") - F.col("start_ms"))).first()[0] or 0
