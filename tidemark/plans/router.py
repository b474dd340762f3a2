"""Which operator answers a candle query: base candles, a stored rollup, or resampling on demand."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from tidemark.functions.intervals import STORED_VIEWS
from tidemark.operators.candles import capped, newest, resample


def route(interval: str, base: str) -> str:
    return "base" if interval == base else "stored" if interval in STORED_VIEWS else "resample"


def candles(interval: str, base: str, base_table: DataFrame, stored: Callable[[str], DataFrame], limit: int | None = None) -> DataFrame:
    """Candles of an interval, newest first. Stored rollups keep incomplete buckets; resampling drops them."""
    way = route(interval, base)
    rows = base_table if way == "base" else stored(STORED_VIEWS[interval]) if way == "stored" else resample(base_table, base, interval)
    return newest(rows, capped(limit))
