from __future__ import annotations

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import intervals as iv
from tidemark.operators import candles as cd
from tidemark.operators import indicators as ind

BEGIN = datetime(2023, 1, 1)


def candles(spark, minutes, symbol="a", closes=None):
    rows = [(symbol, BEGIN + timedelta(minutes=m), 100.0 + k, 105.0 + k, 95.0 + k, closes[k] if closes else 102.0 + k, 1000.0, 1e5) for k, m in enumerate(minutes)]
    return spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double, turnover double")


@pytest.fixture(scope="module")
def ramp(spark):
    return candles(spark, range(50))


def test_one_missing_candle_is_no_gap(spark):
    assert cd.gaps(candles(spark, [0, 5, 15, 20]), "5").count() == 0


def test_two_missing_candles_are_a_gap(spark):
    ms = int((BEGIN - datetime(1970, 1, 1)).total_seconds() * 1000)
    found = cd.gaps(candles(spark, [0, 5, 20]), "5").collect()
    assert [(r.gap_start - ms, r.gap_end - ms) for r in found] == [(600_000, 1_200_000)]


def test_incomplete_buckets(spark):
    eleven = candles(spark, [5 * k for k in range(11)])
    assert cd.resample(eleven, "5", "60").count() == 0
    assert cd.rollup(eleven, "60").count() == 1


def test_weeks_start_on_monday(spark):
    day = candles(spark, [9 * 1440]).withColumn("ts", F.lit("2024-01-09").cast("timestamp_ntz"))
    assert cd.rollup(day, "W").first().ts == datetime(2024, 1, 8)
    ms = iv.to_ms(F.col("ts"))
    up = day.select(iv.from_ms(iv.ceil_ms(ms, F.lit("W"))).alias("x")).first().x
    assert up == datetime(2024, 1, 15)


def test_limits():
    assert [cd.capped(x) for x in (0, None, 5000, 7)] == [None, None, 1000, 7]


def test_ramp_closed_forms(ramp):
    closes = {r.ts: r.close for r in ramp.collect()}
    assert all(abs(r.sma - (closes[r.ts] - 9.5)) < 1e-9 for r in ind.sma(ramp).collect())
    ema = ind.ema(ramp).collect()
    assert len(ema) == 31 and all(abs(r.ema - (closes[r.ts] - 9.5)) < 1e-9 for r in ema)
    bands = ind.bollinger(ramp).collect()
    assert all(r.lower <= r.middle <= r.upper and abs((r.upper - r.middle) ** 2 - 4 * 33.25) < 1e-6 for r in bands)
    macd = ind.macd(ramp).collect()
    assert len(macd) == 17 and all(abs(r.macd - 7) < 1e-9 and abs(r.signal - 7) < 1e-9 and abs(r.histogram) < 1e-9 for r in macd)
    assert [r.rsi for r in ind.rsi(ramp).collect()] == [100.0] * 36
    assert sorted(r.obv for r in ind.obv(ramp).collect()) == [1000.0 * (k + 1) for k in range(50)]


def test_folds_against_loops_and_order(spark):
    closes = [100 + ((k * 37) % 23) - ((k * 11) % 7) * 1.5 for k in range(80)]
    rows = candles(spark, range(80), closes=closes)
    e = sum(closes[:20]) / 20
    expect = [e]
    for x in closes[20:]:
        e += (x - e) * 2 / 21
        expect.append(e)
    mixed = rows.orderBy(F.xxhash64("ts"))
    assert [r.ema for r in ind.ema(mixed).orderBy("ts").collect()] == pytest.approx(expect)
    d = [b - a for a, b in zip(closes, closes[1:], strict=False)]
    g, low = sum(max(x, 0) for x in d[:14]) / 14, sum(max(-x, 0) for x in d[:14]) / 14
    expect = [100 * g / (g + low)]
    for x in d[14:]:
        g, low = (g * 13 + max(x, 0)) / 14, (low * 13 + max(-x, 0)) / 14
        expect.append(100 * g / (g + low))
    found = [r.rsi for r in ind.rsi(mixed).orderBy("ts").collect()]
    assert found == pytest.approx(expect) and all(0 <= x <= 100 for x in found)
    assert all(abs(r.histogram - (r.macd - r.signal)) < 1e-12 for r in ind.macd(mixed).collect())


def test_segments_make_no_difference(spark):
    closes = [100 + ((k * 37) % 23) - ((k * 11) % 7) * 1.5 for k in range(300)]
    rows = candles(spark, range(300), closes=closes).unionByName(candles(spark, range(45), "b", closes[100:]))
    for fold, names in ((ind.Ema(20), ["ema"]), (ind.Macd(12, 26, 9), ["macd", "signal", "histogram"]), (ind.Rsi(14), ["rsi"])):
        one, many = ({(r.symbol, r.ts): [r[n] for n in names] for r in ind.folded(rows, [fold], names, parts).dropna().collect()} for parts in (1, 40))
        assert one.keys() == many.keys() and all(many[k] == pytest.approx(v) for k, v in one.items())


def test_recurrence_by_blocks():
    z = [((k * 7919) % 101) / 7 - 5 for k in range(5000)]
    y, expect = 3.0, []
    for x in z:
        y = 0.9 * y + x
        expect.append(y)
    assert ind.recur(np.array(z), 0.9, 3.0) == pytest.approx(expect)


def test_too_few_rows(spark):
    few = candles(spark, range(20))
    assert ind.sma(few).count() == 0 and ind.rsi(few).count() == 0
    assert ind.too_short(few).first().n_rows == 20
    assert ind.ema(few.limit(0)).count() == 0
