"""Long series over many tasks: every operator gives the rows of one segment, and deals nothing out by the symbol alone."""

from __future__ import annotations

import re
from datetime import datetime, timedelta
from statistics import fmean, pstdev

import numpy as np
import pytest

from tidemark.operators import candles as cd
from tidemark.operators import indicators as ind
from tidemark.plans import series

BEGIN = datetime(2023, 1, 1)
KIND = "symbol string, ts timestamp_ntz, close double, volume double"
ALL_SIX = {"obv": {}, "sma": {"length": 20}, "ema": {}, "rsi": {}, "macd": {}, "bb": {"width": 2.0}}
PLANS = {
    "gaps": lambda c, n: cd.gaps(c, "1", segments=n), "first_gap": lambda c, n: cd.first_gap(c, "1", 10**15, n), "sma": lambda c, n: ind.sma(c, segments=n),
    "bollinger": lambda c, n: ind.bollinger(c, segments=n), "obv": lambda c, n: ind.obv(c, n), "ema": lambda c, n: ind.ema(c, segments=n), "macd": lambda c, n: ind.macd(c, segments=n),
    "rsi": lambda c, n: ind.rsi(c, segments=n), "indicators": lambda c, n: ind.indicators(c, ALL_SIX, n),
}


def rows_of(symbol, n, level=100.0, seed=3):
    draw = np.random.default_rng(seed)
    minutes = np.cumsum(draw.choice([1, 1, 1, 2, 3, 7], n))
    return [(symbol, BEGIN + timedelta(minutes=int(m)), float(level + draw.integers(-40, 40) / 4), float(draw.integers(1, 50))) for m in minutes]


@pytest.fixture(scope="module")
def mixed(spark):
    """One symbol of 400 candles, one of 45, one of 29, one of 30, and rows that are no candles."""
    rows = rows_of("one", 400) + rows_of("two", 45, seed=4) + rows_of("few", 29, seed=5) + rows_of("zz", 30, seed=6)
    return spark.createDataFrame([*rows, (None, BEGIN, 1.0, 1.0), ("one", None, 1.0, 1.0), ("one", BEGIN, float("nan"), 1.0), ("one", BEGIN, None, 1.0)], KIND)


def values(frame):
    return {tuple(v for v in r if not isinstance(v, float)): [v for v in r if isinstance(v, float)] for r in frame.collect()}


@pytest.mark.parametrize("name", PLANS)
def test_segments_make_no_difference(mixed, name):
    rows = mixed.where("close > 0 AND NOT isnan(close)") if name in ("gaps", "first_gap") else mixed
    one, *many = (values(PLANS[name](rows, n)) for n in (1, 8, 60))
    assert one and all(m.keys() == one.keys() for m in many)
    assert all(m[k] == pytest.approx(v, abs=1e-9) for m in many for k, v in one.items())


@pytest.mark.parametrize("name", PLANS)
def test_one_symbol_takes_eight_tasks(spark, name):
    rows = spark.createDataFrame(rows_of("one", 800), KIND)
    plan = PLANS[name](rows, 8)._jdf.queryExecution().toString()
    alone = re.findall(r"hashpartitioning\(symbol#\d+, \d+", plan)
    assert "hashpartitioning(symbol#" in plan and (name == "first_gap" or not alone), alone  # the first of the gaps is a minimum of partial ones
    s = series.cut(rows, ["symbol"], "ts", 8)
    assert s.rows.select("segment").distinct().count() == 8 and [len(c) for c in s.spans] == [8]


def test_tables_without_candles(mixed):
    for n in (1, 8):
        assert all(make(mixed.limit(0), n).count() == 0 for make in PLANS.values())


def test_bands_at_large_prices(spark):
    """Deviations of some units at prices of 1e9: squares of prices would lose them."""
    rows = rows_of("one", 300, 1e9)
    closes = [r[2] for r in rows]
    found = {r.ts: r for r in ind.bollinger(spark.createDataFrame(rows, KIND), segments=8).collect()}
    fused = {r.ts: r for r in ind.indicators(spark.createDataFrame(rows, KIND), {"bb": {}}, 8).collect()}
    assert len(found) == len(fused) == 281
    for k in range(19, 300):
        frame = closes[k - 19 : k + 1]
        mean, s = fmean(frame), pstdev([x - 1e9 for x in frame])
        for r in (found[rows[k][1]], fused[rows[k][1]]):
            assert r.middle == pytest.approx(mean, rel=1e-12) and (r.upper - r.lower) / 4 == pytest.approx(s, rel=1e-6)


def test_fused_indicators_are_the_single_ones(mixed):
    fused = {(r.symbol, r.ts): r for r in ind.indicators(mixed, ALL_SIX, 8).collect()}
    singles = {"obv": (ind.obv(mixed), ["obv"]), "sma": (ind.sma(mixed), ["sma"]), "ema": (ind.ema(mixed), ["ema"]), "rsi": (ind.rsi(mixed), ["rsi"]), "macd": (ind.macd(mixed), ["macd", "signal", "histogram"]), "bb": (ind.bollinger(mixed), ["upper", "middle", "lower", "bandwidth"])}
    for frame, names in singles.values():
        there = {(r.symbol, r.ts): [r[n] for n in names] for r in frame.collect()}
        assert {k for k, r in fused.items() if r[names[0]] is not None} == there.keys()
        assert all([fused[k][n] for n in names] == pytest.approx(v) for k, v in there.items())


def test_candles_without_volume_have_no_obv_but_the_others(spark):
    rows = spark.createDataFrame(rows_of("one", 60), KIND).drop("volume")
    assert ind.ema(rows, segments=4).count() == 41
