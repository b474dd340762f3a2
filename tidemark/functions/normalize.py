"""Normalisers for numbers and dates as sources send them, and small text functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-10
#: Digits that a value may have in all before it counts as invalid.
MOST_DIGITS = 28
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once, however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def number(raw: Column) -> Column:
    """A double from text such as ``1,234.5`` or ``3.2%``; null for null, invalid or non-finite input."""
    text = F.trim(F.regexp_replace(F.trim(F.replace(raw.cast("string"), F.lit(","), F.lit(""))), "%$", ""))
    read = let(text, lambda t: F.when(t.rlike(NUMBER), t.try_cast("double")))
    return let(read, lambda x: F.when(F.abs(x) < float("inf"), x))


def decimal(raw: Column, scale: int, digits: int, default: str = "0") -> Column:
    """A decimal of ``scale`` places, rounded half up; the default for null, invalid or non-finite input.

    Values below 1e-10 are 0, those of more than ``digits`` digits are clamped. Where whole digits leave less room than
    ``scale`` within ``digits``, the value is rounded to the places that are left. What would take more than
    ``MOST_DIGITS`` digits at the full scale is invalid. Text, number and value are each evaluated once.
    """
    kind = f"decimal(38,{scale})"
    most = F.lit("9" * digits).cast("decimal(38,0)")
    whole = lambda n: F.lit("1" + "0" * n).cast("decimal(38,0)")

    def value(x: Column) -> Column:
        clamped = F.when(x >= float(f"1e{digits}"), most.try_cast(kind)).when(x <= -float(f"1e{digits}"), (-most).try_cast(kind)).otherwise(x.try_cast(kind))
        return F.when(F.abs(x) < TINY, F.lit(0).cast(kind)).otherwise(clamped)

    def shed(v: Column) -> Column:
        out = F.when(F.abs(v) >= whole(MOST_DIGITS - scale), F.lit(None).cast(kind))
        for places in range(scale):  # the widest values first
            out = out.when(F.abs(v) >= whole(digits - places - 1), F.round(v, places).cast(kind))
        return out.otherwise(v)

    return F.coalesce(let(let(number(raw), value), shed), F.lit(default).cast(kind))


def percent(raw: Column, default: str = "0") -> Column:
    most = F.lit("999999.9999").cast("decimal(38,4)")
    return F.greatest(-most, F.least(most, decimal(raw, 4, 16, default)))


def price(raw: Column, default: str = "0.0000000001") -> Column:
    """A price, at least 1e-10. Applied to a change it makes every fall 1e-10; ``price_change`` keeps the sign."""
    return F.greatest(F.lit("0.0000000001").cast("decimal(38,10)"), decimal(raw, 10, 20, default))


def price_change(raw: Column, default: str = "0") -> Column:
    return decimal(raw, 10, 20, default)


def supply(raw: Column, default: str = "0") -> Column:
    return decimal(raw, 8, 30, default)


def money(raw: Column, default: str = "0") -> Column:
    return decimal(raw, 2, 30, default)


def iso_time(raw: Column, now: Column) -> Column:
    """An ISO date and time; a missing zone is UTC; what can't be read becomes ``now``."""
    return F.coalesce(F.try_to_timestamp(raw), now)


def genesis_date(raw: Column) -> Column:
    return F.try_to_timestamp(raw, F.lit("yyyy-MM-dd"))


def rank_or_none(rank: Column) -> Column:
    return F.coalesce(rank, F.lit(-1))


def subreddit(url: Column) -> Column:
    return F.regexp_extract(F.rtrim(url, F.lit("/")), r"/r/([^/]*)", 1)


def telegram_user(url: Column) -> Column:
    found = F.regexp_extract(url, r"(?:t|telegram)\.me/([^/]*)", 1)
    return F.when(url.rlike(r"(t|telegram)\.me/"), found).otherwise(F.ltrim(url, F.lit("@")))


def twitter_user(url: Column) -> Column:
    return F.ltrim(F.element_at(F.split(url, "/"), -1), F.lit("@"))


def without_digits(ticker: Column) -> Column:
    """The ticker without leading digits, for a second look-up."""
    return F.ltrim(ticker, F.lit("0123456789"))


def share(part: Column, whole: Column, scale: float = 1.0) -> Column:
    """A ratio that is 0 where the whole is 0 or missing."""
    return F.coalesce(F.try_divide(part, whole) * scale, F.lit(0.0))


def symbol_label(name: Column, exchange: Column) -> Column:
    return F.format_string("%s (%s)", name, exchange)


def pair_label(base: Column, quote: Column) -> Column:
    return F.concat_ws("/", base, quote)


def done_percent(processed: Column, total: Column) -> Column:
    """Percent of a collector's work that is done; a total that is missing counts as 1."""
    return share(processed, F.coalesce(total, F.lit(1)), 100.0)


def rate(processed: Column, first: Column, last: Column) -> Column:
    """What was processed per second between two times; 0 if no time passed."""
    micros = F.unix_micros(last.cast("timestamp")) - F.unix_micros(first.cast("timestamp"))
    return share(processed, F.greatest(micros, F.lit(0)) / 1_000_000)


def one_of(raw: Column, known: dict[str, str]) -> Column:
    """The name that stands for a value; null for null, an error for any other that isn't known."""
    table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    wrong = F.raise_error(F.concat(F.lit("unknown value "), raw)).cast("string")
    return F.when(raw.isNull(), F.lit(None).cast("string")).when(raw.isin(*known), F.try_element_at(table, raw)).otherwise(wrong)
