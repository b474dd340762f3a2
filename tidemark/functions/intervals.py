"""Interval codes and time alignment, as column expressions over epoch milliseconds or timestamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MINUTE, DAY, WEEK = 60_000, 86_400_000, 604_800_000
#: Interval codes (minutes, D, W) and their milliseconds.
INTERVALS = {"1": MINUTE, "3": 3 * MINUTE, "5": 5 * MINUTE, "15": 15 * MINUTE, "30": 30 * MINUTE, "60": 60 * MINUTE, "120": 120 * MINUTE, "240": 240 * MINUTE, "360": 360 * MINUTE, "720": 720 * MINUTE, "D": DAY, "W": WEEK}
#: Intervals with a stored rollup.
STORED_VIEWS = {"60": "kline_1h", "240": "kline_4h", "D": "kline_1d"}
#: The epoch was a Thursday; weeks start on Monday.
MONDAY = 4 * DAY


def interval_ms(code: Column) -> Column:
    """Milliseconds of a code; null for an unknown one."""
    table = F.create_map(*[F.lit(x) for pair in INTERVALS.items() for x in pair])
    return F.try_element_at(table, code)


def valid_target(base: Column, target: Column) -> Column:
    """Whether candles of ``base`` can be put together to ``target``."""
    b, t = interval_ms(base), interval_ms(target)
    return F.coalesce((t >= b) & (t % b == 0), F.lit(False))


def valid_targets(base: Column) -> Column:
    """The codes that candles of ``base`` can be put together to, in order."""
    return F.filter(F.array(*[F.lit(c) for c in INTERVALS]), lambda c: valid_target(base, c))


def width(code: str) -> str:
    """The code as a Spark interval."""
    return {"D": "1 day", "W": "7 days"}.get(code) or f"{code} minutes"


def bucket(ts: Column | str, code: str) -> Column:
    """Start of the bucket that holds a timestamp; weeks start on Monday, all else at multiples from the epoch."""
    w = width(code)
    return (F.window(ts, w, w, "4 days") if code == "W" else F.window(ts, w))["start"]


def floor_ms(ms: Column, code: Column) -> Column:
    w, o = interval_ms(code), F.when(code == "W", MONDAY).otherwise(0)
    return ms - F.pmod(ms - o, w)


def ceil_ms(ms: Column, code: Column) -> Column:
    low = floor_ms(ms, code)
    return F.when(low == ms, ms).otherwise(low + interval_ms(code))


def align_range(start: Column, end: Column, code: Column, now: Column) -> tuple[Column, Column]:
    """Both ends floored by plain multiples of the width; the end is no later than the last complete interval."""
    w = interval_ms(code)
    cut = lambda x: x - F.pmod(x, w)
    return cut(start), F.least(cut(end), cut(now) - w)


def total_candles(start: Column, end: Column, code: Column) -> Column:
    return F.floor((end - start) / interval_ms(code)).cast("long") + 1


def to_ms(ts: Column) -> Column:
    """Epoch milliseconds, truncated; timestamps without a zone count as UTC."""
    return F.unix_millis(ts.cast("timestamp"))


def from_ms(ms: Column) -> Column:
    return F.timestamp_millis(ms)


def now_ms(now: Column | None = None) -> Column:
    """Epoch milliseconds of a given moment, or of the clock when the query starts."""
    return F.unix_millis(F.current_timestamp() if now is None else now)


def format_time(ts: Column) -> Column:
    return F.date_format(ts, "dd-MM-yyyy HH:mm")


def format_span(seconds: Column) -> Column:
    """The two largest units of a span: 1d 2h, 2h 3m, 3m 4s or 4s."""
    s = seconds.cast("long")
    part = lambda unit, size, within: F.concat(F.floor(F.pmod(s, within) / size).cast("string") if within else F.floor(s / size).cast("string"), F.lit(unit))
    return (
        F.when(s >= 86400, F.concat_ws(" ", part("d", 86400, 0), part("h", 3600, 86400)))
        .when(s >= 3600, F.concat_ws(" ", part("h", 3600, 0), part("m", 60, 3600)))
        .when(s >= 60, F.concat_ws(" ", part("m", 60, 0), part("s", 1, 60)))
        .otherwise(part("s", 1, 0))
    )


def clip_launch(launch: Column, now: Column, retention_days: int) -> Column:
    """The launch time, or the start of retention if that is later; no retention for zero days or fewer."""
    return launch if retention_days <= 0 else F.greatest(launch, now - retention_days * DAY)
