"""Candles of a message stream, each passed on once it is confirmed; with a report of those that never are, and of symbols that fall silent.

State is kept by symbol and interval and only for candles that may still change: a candle goes when the watermark is ``grace`` behind its end, for which each symbol has one timer. A candle that is open then was
never confirmed; if no later candle of the symbol has been seen by then, the symbol is silent. Messages in disorder and repeats make no difference; of several confirmed messages of a candle the
first by ``arrived`` counts. What comes after that is late and is dropped. Messages without a symbol, an interval or a time are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tidemark.functions.intervals import INTERVALS

ROCKS = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
CONFIRMED, NEVER, SILENT = "confirmed", "never confirmed", "silent"


class Candles(StatefulProcessor):
    """Rows of one symbol and interval, with ``ms`` and the columns ``values``."""

    def __init__(self, values: list[str], grace_ms: int):
        self.values, self.grace = values, grace_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        # candles whose time isn't over: whether each was passed on, and else its last values; and the symbol's last candle
        self.handle, self.live = handle, handle.getValueState("live", "ms array<long>, done array<boolean>, held array<array<double>>, last long")

    def read(self) -> tuple[dict[int, tuple[bool, list]], int | None]:
        if not self.live.exists():
            return {}, None
        ms, done, held, last = self.live.get()
        return {m: (d, list(h)) for m, d, h in zip(ms, done, held, strict=True)}, last

    def write(self, key: tuple, live: dict[int, tuple[bool, list]], last: int | None) -> None:
        """One state and one timer for a symbol, for the candle that is over first."""
        order = sorted(live)
        self.live.update((order, [live[m][0] for m in order], [live[m][1] for m in order], last))
        if order:
            self.handle.registerTimer(self.ends(key, order[0]))

    def ends(self, key: tuple, ms: int) -> int:
        """When a candle's time is over."""
        return ms + INTERVALS[key[1]] + self.grace

    def rows(self, key: tuple, found: list[tuple]) -> Iterator[pd.DataFrame]:
        if found:
            yield pd.DataFrame([(*key, *r) for r in found], columns=["symbol", "interval", "ms", "status", *self.values])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  named by the interface
        now = timerValues.getCurrentWatermarkInMs()
        # one decision a candle, whatever the number of its messages
        best: dict[int, tuple] = {}
        for frame in rows:
            for ms, confirm, arrived, *values in frame[["ms", "confirm", "arrived", *self.values]].itertuples(index=False, name=None):
                # a confirmed message is better than an open one; of confirmed ones the first counts, of open ones the last
                rank = (not confirm, arrived if confirm else -arrived)
                if ms not in best or rank < best[ms][0]:
                    best[ms] = (rank, bool(confirm), values)
        live, last = self.read()
        found = []
        for ms, (_, confirm, values) in sorted(best.items()):
            if self.ends(key, ms) <= now or live.get(ms, (False,))[0]:
                continue
            if confirm:
                found.append((ms, CONFIRMED, *values))
            live[ms] = (confirm, values)
            last = ms if last is None else max(last, ms)
        self.write(key, live, last)
        yield from self.rows(key, found)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs()
        live, last = self.read()
        over = [m for m in sorted(live) if self.ends(key, m) <= now]
        found = [(m, NEVER, *live[m][1]) for m in over if not live[m][0]]
        found += [(m, SILENT, *[float("nan")] * len(self.values)) for m in over if m == last]
        self.write(key, {m: x for m, x in live.items() if m not in set(over)}, last)
        yield from self.rows(key, found)

    def close(self) -> None:
        pass


def settled(messages: DataFrame, values: list[str], grace: str = "10 minutes", grace_ms: int = 600_000) -> DataFrame:
    """Candles and reports: ``symbol``, ``interval``, ``ts``, ``status`` and the values (null for a silent symbol, where ``ts`` is its last candle).

    ``messages`` are a stream with ``symbol``, ``interval``, ``ts`` (timestamp), ``confirm``, ``arrived`` (a number that grows) and the values, which are doubles. ``grace`` is how far messages may come in
    disorder, for the watermark and, in ms, for the timers.
    """
    known = messages.where(F.col("symbol").isNotNull() & F.col("interval").isin(*INTERVALS) & F.col("ts").isNotNull()).withWatermark("ts", grace)
    rows = known.select("symbol", "interval", "ts", F.unix_millis("ts").alias("ms"), F.coalesce("confirm", F.lit(False)).alias("confirm"), F.coalesce("arrived", F.lit(0)).cast("long").alias("arrived"), *values)
    schema = "symbol string, interval string, ms long, status string, " + ", ".join(f"{v} double" for v in values)
    out = rows.groupBy("symbol", "interval").transformWithStateInPandas(statefulProcessor=Candles(values, grace_ms), outputStructType=schema, outputMode="append", timeMode="eventTime")
    null = lambda v: F.when(~F.isnan(v), F.col(v)).alias(v)
    return out.select("symbol", "interval", F.timestamp_millis("ms").alias("ts"), "status", *[null(v) for v in values])


def started(spark: SparkSession, writer) -> StreamingQuery:
    """Starts a stream with the state store that timers need; other streams of the session keep theirs."""
    before = spark.conf.get(ROCKS[0], None)
    spark.conf.set(*ROCKS)
    try:
        return writer.start()
    finally:
        spark.conf.unset(ROCKS[0]) if before is None else spark.conf.set(ROCKS[0], before)
