"""Row validation: rules give an array of error codes, and rows are split by it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.intervals import DAY, INTERVALS

#: 2019-11-01 and 2009-01-03 UTC, the earliest times of candles and launches.
FIRST_CANDLE, FIRST_LAUNCH = 1_572_566_400_000, 1_230_940_800_000


def errors(rules: dict[str, Column]) -> Column:
    """Codes of the rules that don't hold; a rule that is null doesn't hold."""
    return F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(code)) for code, ok in rules.items()]), lambda x: x.isNotNull())


def candle_rules(now_ms: Column) -> dict[str, Column]:
    """Rules over ``ts_ms``, ``interval`` and the six values."""
    ms = F.col("ts_ms")
    value = lambda c: F.col(c).try_cast("decimal(38,8)")
    o, h, low, c = (value(x) for x in ("open", "high", "low", "close"))
    out = {
        "ts_digits": F.length(F.abs(ms).cast("string")) == 13,
        "ts_early": ms >= FIRST_CANDLE,
        "ts_future": ms <= now_ms + 60_000,
        "interval": F.col("interval").isin(*INTERVALS),
    }
    out |= {f"{x}_value": value(x) >= 0 for x in ("open", "high", "low", "close", "volume", "turnover")}
    return out | {"ohlc_order": (low <= F.least(o, c)) & (F.greatest(o, c) <= h)}


def symbol_rules(now_ms: Column) -> dict[str, Column]:
    name = F.col("name")
    return {
        "name": name.rlike("^[A-Z0-9]+$") & F.length(name).between(5, 50),
        "exchange": F.col("exchange").rlike("^[a-z0-9_]+$") & F.length("exchange").between(1, 20),
        "base_asset": F.col("base_asset").rlike("^[A-Z0-9]+$") & F.length("base_asset").between(1, 20),
        "quote_asset": F.col("quote_asset").rlike("^[A-Z0-9]+$") & F.length("quote_asset").between(1, 10),
        "price_scale": F.col("price_scale").between(0, 18),
        "launch_time": F.col("launch_time").between(F.lit(FIRST_LAUNCH), now_ms + DAY),
    }


def split(rows: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Valid rows, and the others with their ``errors``."""
    checked = rows.withColumn("errors", errors(rules))
    return checked.where(F.size("errors") == 0).drop("errors"), checked.where(F.size("errors") > 0)
