from __future__ import annotations

import sys

import pytest
from pyspark.sql import functions as F

from tidemark.operators import candles as cd
from tidemark.sources import feeds
from tidemark.sources.pages import PagedCandles, pages
from tidemark.streaming import candles as st

DATA = "/root/testdata/sf0.001"


def test_rollup_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet(f"{DATA}/events.parquet")
    events.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    rolled = st.rollup_stream(stream, "60", "event_type", "ts", "value", "event_id")
    q = rolled.writeStream.outputMode("update").format("memory").queryName("rolled").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/ck").start()
    q.awaitTermination()
    batch = cd.bars(events, "60", "event_type", "ts", "value", "event_id").select("symbol", F.col("ts").cast("timestamp"), "open", "high", "low", "close", "n")
    assert sorted(map(tuple, spark.table("rolled").collect())) == sorted(map(tuple, batch.collect()))


def test_confirmed_candles_and_reports(spark, tmp_path):
    """Duplicates, disorder, a candle that is never confirmed, late messages, and a symbol that falls silent; in four batches."""
    message = '{{"topic": "kline.5.{}", "data": [{{"start": {}, "open": "1", "high": "2", "low": "1", "close": "{}", "volume": "1", "turnover": "1", "confirm": {}}}]}}'
    batches = [
        [("A", 0, 1, True), ("A", 0, 9, True), ("A", 2, 3, False), ("A", 1, 2, False), ("B", 0, 5, True), (None, 0, 1, True)],
        [("A", 1, 4, True), ("A", 0, 7, True), ("A", 2, 6, False), ("B", 1, 5, True), ("A", 3, 8, True)],
        [("A", 40, 1, True), ("A", 2, 7, False)],
        [("A", 2, 7, True), ("A", 0, 7, True), ("A", 80, 1, False)],
    ]
    zero = 1_705_000_000_000 - 1_705_000_000_000 % 300_000
    arrived = 0
    for rows in batches:
        lines = [f"{(arrived := arrived + 1)} " + (message.format(s, zero + 300_000 * k, c, str(ok).lower()) if s else "no json") for s, k, c, ok in rows]
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / f"in/{arrived}.txt").write_text("\n".join(lines))
        text = spark.readStream.text(f"{tmp_path}/in").select(F.split("value", " ", 2).alias("v"))
        stream = feeds.stream_messages(text.select(F.col("v")[0].cast("long").alias("arrived"), F.col("v")[1].alias("value")), keep=["arrived"])
        st.settle_into(stream, ["close"], f"{tmp_path}/table", f"{tmp_path}/reports", f"{tmp_path}/ck").awaitTermination()
    at = lambda r: (r.symbol, (int(r.ts.timestamp()) * 1000 - zero) // 300_000)
    kind = spark.createDataFrame([], "symbol string, interval string, ts timestamp, close double").schema
    assert {at(r): r.close for r in feeds.stored_candles(spark, f"{tmp_path}/table", kind).collect()} == {("A", 0): 1.0, ("A", 1): 4.0, ("B", 0): 5.0, ("B", 1): 5.0, ("A", 3): 8.0, ("A", 40): 1.0}
    reports = sorted((*at(r), r.status, r.close) for r in spark.read.parquet(f"{tmp_path}/reports").collect())
    assert reports == [("A", 2, "never confirmed", 7.0), ("B", 1, "silent", None)]


def test_stream_rows_take_confirmed_messages(spark):
    row = '{"topic": "kline.5.AB", "data": [{"start": 1705000000000, "open": "1", "high": "2", "low": "1", "close": "3", "volume": "1", "turnover": "1", "confirm": %s}]}'
    found = feeds.stream_rows(spark.createDataFrame([(row % "true",), (row % "false",), ("{}",), (None,)], "value string")).collect()
    assert [(r.symbol, r.interval, r.close) for r in found] == [("AB", "5", 3.0)]


class Pages(PagedCandles):
    """An interface of one candle in 5 minutes with a hole of many pages; it counts what it is asked."""

    page, chain = 3, 4

    @classmethod
    def name(cls):
        return "test_pages"

    @staticmethod
    def fetch(options, symbol, interval, start, limit):
        every = [x for x in range(0, 300_000 * 200, 300_000) if not 300_000 * 20 <= x < 300_000 * 150]
        return [[str(x), "1", "2", "1", "1", "1", "1"] for x in every if x >= start][:limit][::-1]

    @staticmethod
    def newest(options, symbol, interval, end):
        every = [x for x in range(0, 300_000 * 200, 300_000) if not 300_000 * 20 <= x < 300_000 * 150]
        return max((x for x in every if x <= end), default=None)


def test_pages_stop_at_the_end_and_at_an_empty_page():
    asked = []

    def fetch(symbol, interval, start, limit):
        asked.append(start)
        return Pages.fetch({}, symbol, interval, start, limit)

    found = [int(r[0]) // 300_000 for page in pages(fetch, "A", "5", 0, 300_000 * 151, 3) for r in page]
    assert found == [*range(20), 150, 151] and len(asked) == 8  # the hole costs no page of its own
    asked.clear()
    assert not list(pages(fetch, "A", "5", 300_000 * 200, 300_000 * 999, 3)) and len(asked) == 1


def test_paged_source_gives_each_candle_once(spark):
    pickled(Pages)
    spark.dataSource.register(Pages)
    rows = spark.read.format("test_pages").options(symbols="A,B", interval="5", start="0", end=str(300_000 * 160)).load()
    assert rows.count() == rows.distinct().count() == 2 * 31


def test_paged_stream_goes_on_from_its_checkpoint(spark, tmp_path):
    pickled(Pages)
    spark.dataSource.register(Pages)
    out = lambda: spark.read.parquet(f"{tmp_path}/out").select("symbol", "ts_ms")
    seen = []
    for symbols, end in (("A", 10), ("A,B", 155), ("A,B", 155), ("A,B", 400)):
        stream = spark.readStream.format("test_pages").options(symbols=symbols, interval="5", start="0", end=str(300_000 * end)).load()
        stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start().awaitTermination()
        seen.append(out().count())
    assert seen == [11, 52, 52, 140] and out().distinct().count() == 140


def pickled(kind):
    """Sends a class of this file to workers by value."""
    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[kind.__module__])


def test_metric_text(spark):
    lines = spark.createDataFrame([(0, "# HELP x"), (1, 'x{a="b"} 1'), (2, "x 2.5"), (3, ""), (4, "y nope")], "position int, value string")
    assert [tuple(r) for r in feeds.metric_text(lines).collect()] == [("x", 2.5)]


def test_candle_table_merges_by_partition(spark, tmp_path):
    rows = spark.sql("SELECT 'A' AS symbol, '60' AS interval, TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(id * 10) AS ts, 1.0D AS close FROM range(10)").withColumn("ts", F.col("ts"))
    path = f"{tmp_path}/candles"
    symbols = spark.createDataFrame([("A",)], "symbol string")
    feeds.merge_candles(spark, path, rows, ["symbol", "interval", "ts"], ["ts"], symbols)
    files = lambda: {str(p): p.stat().st_mtime_ns for p in (tmp_path / "candles").rglob("*.parquet")}
    before = files()
    late = rows.where("ts >= '2024-03-01'").withColumn("close", F.lit(2.0))
    for _ in range(2):
        feeds.merge_candles(spark, path, late, ["symbol", "interval", "ts"], ["ts"], symbols)
    stored = feeds.stored_candles(spark, path, rows.schema)
    assert stored.count() == 10 and stored.where("close = 2").count() == late.count() > 0
    assert sum(before.get(k) == v for k, v in files().items()) == 10 - late.count()  # each candle has a week of its own
    plan = feeds.read_candles(spark, path, rows.schema, "60", "2024-01-08", "2024-01-20")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(interval" in plan and plan.count("week") > 3
    with pytest.raises(Exception, match="unknown symbol B"):
        feeds.merge_candles(spark, path, rows.withColumn("symbol", F.lit("B")), ["symbol", "interval", "ts"], ["ts"], symbols)
    feeds.delete_symbols(spark, path, rows.schema, symbols)
    assert feeds.stored_candles(spark, path, rows.schema).count() == 0
