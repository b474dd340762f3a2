"""Candle tables: what is read and replaced, what a refresh computes anew, and what is covered."""

from __future__ import annotations

from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidemark.operators import candles as cd
from tidemark.plans import coverage, rollups
from tidemark.sources import feeds
from tidemark.streaming import candles as st

KIND = "symbol string, interval string, ts timestamp_ntz, open double, high double, low double, close double, volume double, turnover double, n bigint"
MONDAY = datetime(2024, 1, 1)


def candles(spark, rows, interval="5"):
    """Rows of (symbol, minutes from Monday, close)."""
    return spark.createDataFrame([(s, interval, MONDAY + timedelta(minutes=m), c, c + 1, c - 1, c, 1.0, 1.0, 1) for s, m, c in rows], KIND)


@pytest.fixture
def weeks(spark, tmp_path):
    """Three weeks of two symbols, a candle in six hours; and a function that makes a week's files unreadable."""
    rows = candles(spark, [(s, 360 * k, float(k)) for s in "AB" for k in range(84)], "360")
    path = f"{tmp_path}/candles"
    feeds.write_candles(rows, path)

    def spoil(*days):
        for day in days:
            for f in (tmp_path / f"candles/interval=360/week={day}").glob("*.parquet"):
                f.write_bytes(b"no parquet")
                (f.parent / f".{f.name}.crc").unlink()

    return rows, path, spoil


def there(spark, path, rows, where="true"):
    return {(r.symbol, r.ts, r.close) for r in feeds.stored_candles(spark, path, rows.schema).where(where).collect()}


def test_merge_reads_the_weeks_of_its_batch_only(spark, weeks):
    rows, path, spoil = weeks
    spoil("2024-01-01", "2024-01-15")
    batch = rows.where("ts BETWEEN '2024-01-09' AND '2024-01-10'").withColumn("close", F.lit(-5.0))
    extra = candles(spark, [("C", 1440 * 8, 1.0)], "360")
    no_time = extra.withColumn("ts", F.lit(None).cast("timestamp_ntz"))
    for _ in range(2):
        feeds.merge_candles(spark, path, batch.unionByName(extra).unionByName(no_time), ["symbol", "interval", "ts"], ["ts"])
    week = there(spark, path, rows, "week = '2024-01-08'")
    assert len(week) == 57 and sum(c == -5.0 for *_, c in week) == batch.count()
    feeds.merge_candles(spark, path, rows.limit(0), ["symbol", "interval", "ts"], ["ts"])


def test_retention_drops_weeks_and_cuts_one(spark, weeks):
    rows, path, spoil = weeks
    oldest = datetime(2024, 1, 10, 3)
    spoil("2024-01-15")  # isn't read
    feeds.retain_candles(spark, path, rows.schema, oldest)
    found = there(spark, path, rows, "week <= '2024-01-08'")
    assert found == {(r.symbol, r.ts, r.close) for r in rows.collect() if oldest <= r.ts < datetime(2024, 1, 15)}
    assert {p.name for p in Path(path).glob("*/week=*")} == {"week=2024-01-08", "week=2024-01-15"}


@pytest.mark.parametrize("named", [1000, 0])
def test_delete_leaves_other_weeks_alone(spark, weeks, monkeypatch, named):
    monkeypatch.setattr(feeds, "NAMED", named)
    rows, path, _ = weeks
    extra = candles(spark, [("C", 1440 * 8, 1.0), ("C", 1440 * 30, 1.0)], "360")
    feeds.merge_candles(spark, path, extra, ["symbol", "interval", "ts"], ["ts"])
    before = set(feeds.stored_candles(spark, path, rows.schema).where("week IN ('2024-01-01', '2024-01-15')").inputFiles())
    feeds.delete_symbols(spark, path, rows.schema, spark.createDataFrame([("C",), ("none",), (None,)], "symbol string"))
    after = set(feeds.stored_candles(spark, path, rows.schema).inputFiles())
    assert there(spark, path, rows) == {(r.symbol, r.ts, r.close) for r in rows.collect()}
    assert {f for f in before if "2024-01-08" not in f and "2024-01-29" not in f} <= after and not any("2024-01-29" in f for f in after)


def test_refresh_computes_what_changed(spark, tmp_path, monkeypatch):
    r = rollups.Rollups(spark, str(tmp_path), "5", candles(spark, []).schema)
    now = MONDAY + timedelta(days=10)
    minutes = [5 * k for k in range(12 * 24 * 10)]
    r.ingest(candles(spark, [("A", m, float(m)) for m in minutes]))
    for code in rollups.HOURS:
        assert r.refresh(code, now) > 0
        assert r.refresh(code, now) == 0  # nothing has changed since
    stored = {code: {x.ts: x for x in r.table(code).collect()} for code in rollups.HOURS}
    assert [len(stored[code]) for code in ("60", "240", "D")] == [2, 2, 2]
    # late candles: one within the offsets of the daily view, one long before
    late = candles(spark, [("A", 5 * 12 * 24 * 8, -7.0), ("A", 0, -9.0), ("B", 60 * 24 * 8 + 5, 3.0)])
    read = []
    among = rollups.Rollups.among
    monkeypatch.setattr(rollups.Rollups, "among", lambda self, i, b, c: read.append((i, among(self, i, b, c))) or read[-1][1])
    r.ingest(late)
    assert r.refresh("D", now) == 2
    fresh = {(x.symbol, x.ts): x for x in r.table("D").collect()}
    day = MONDAY + timedelta(days=8)
    assert fresh["A", day].open == -7.0 and fresh["A", day].n == 288 and fresh["B", day].n == 1 and len(fresh) == 3
    base = next(f for i, f in read if i == "5")._jdf.queryExecution().toString()
    assert "PartitionFilters" in base and "2024-01-08" in base and "2024-01-01" not in base.split("PartitionFilters")[-1]
    # what lies outside stays logged, until a refresh reaches it
    assert r.refresh("D", MONDAY + timedelta(days=3)) == 2
    assert {x.ts: x.open for x in r.table("D").where("symbol = 'A'").collect()}[MONDAY] == -9.0


def test_partials_merge_to_what_candles_give(spark):
    rows = candles(spark, [(s, 5 * k, float((k * 37) % 91)) for s in "AB" for k in range(600) if k % 7])
    hours = rollups.merge_partials(rows, "60")
    for code in ("240", "D", "W"):
        one = {tuple(r) for r in rollups.merge_partials(hours, code).select("symbol", "ts", "open", "high", "low", "close", "volume", "n").collect()}
        assert one == {tuple(r) for r in cd.rollup(rows.drop("n"), code).select("symbol", "ts", "open", "high", "low", "close", "volume", "n").collect()}


def islands(times):
    out = []
    for a, b in sorted(times):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


@pytest.mark.parametrize("segments", [1, 8, 40])
def test_union_of_intervals(spark, segments):
    rows = [("A", (k * 7919) % 3000, (k * 7919) % 3000 + 1 + (k * 13) % 9) for k in range(300)] + [("B", 5, 7), ("B", 7, 9), ("B", 1, 100), (None, 1, 2)]
    found = coverage.union(spark.createDataFrame(rows, "symbol string, start_ms long, end_ms long"), segments).collect()
    for s in "AB":
        assert sorted((r.start_ms, r.end_ms) for r in found if r.symbol == s) == islands([(a, b) for x, a, b in rows if x == s])
    assert not [r for r in found if r.symbol is None]


def test_backfill_reads_intervals_and_what_it_fetched(spark):
    minute = lambda frame: {int((r.ts - MONDAY).total_seconds()) // 300 for r in frame.collect()}
    have, gone = [k for k in range(200) if not 20 <= k < 60 and not 100 <= k < 102 and not 150 <= k < 160], range(150, 160)
    written, asked = [], []

    def fetch(found):
        asked.append(sorted((r.gap_start, r.gap_end) for r in found.collect()))
        ms = [(a // 300_000, b // 300_000) for a, b in asked[-1]]
        zero = int((MONDAY - datetime(1970, 1, 1)).total_seconds()) // 300
        return candles(spark, [("A", 5 * k, 1.0) for a, b in ms for k in range(a - zero, b - zero) if k not in gone])

    covered, rounds = st.backfill(coverage.of_candles(candles(spark, [("A", 5 * k, 1.0) for k in have]), "5"), fetch, written.append, "5")
    assert rounds == 1 and len(asked) == 2 and len(asked[0]) == 3 and len(asked[1]) == 1  # the last gap can't be filled
    assert set(have) | set().union(*map(minute, written)) == set(range(200)) - set(gone)
    assert covered.count() == 2 and coverage.ends(covered, "5").first().last_ms - coverage.ends(covered, "5").first().first_ms == 199 * 300_000
    assert coverage.of_candles(candles(spark, []), "5").count() == 0
