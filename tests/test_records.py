from __future__ import annotations

import random
import re
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidemark.functions import normalize as nm
from tidemark.operators import fundamentals as fd
from tidemark.operators import merge as mg
from tidemark.operators import monitoring as mon
from tidemark.operators import records as rec
from tidemark.sources import feeds

NOW = 1_705_754_096_000


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_candle_rules(spark):
    base = dict(ts_ms=NOW, interval="5", open="10", high="12", low="9", close="11", volume="1", turnover="1")
    cases = {
        "": {}, "ts_digits": {"ts_ms": 170_575_409_600}, "ts_early": {"ts_ms": 1_572_566_399_999}, "ts_future": {"ts_ms": NOW + 61_000},
        "interval": {"interval": "7"}, "volume_value": {"volume": "-1"}, "ohlc_order": {"high": "9.5"}, "turnover_value": {"turnover": "x"},
    }
    rows = spark.createDataFrame([{**base, **change, "case": k} for k, change in cases.items()])
    good, bad = rec.split(rows, rec.candle_rules(F.lit(NOW)))
    assert [r.case for r in good.collect()] == [""]
    assert all(r.case in r.errors for r in bad.collect()) and bad.count() == 7


def test_normalisers(spark):
    found = {
        "1,234.5": "1234.5", " 3.2% ": "3.2", "": "-1", "abc": "-1", "inf": "-1", "nan": "-1", "1e-11": "0", "3%5": "-1", "1d": "-1", "0.00005": "0.0001", "-0.00005": "-0.0001",
        "12345678.123456": "12345678.12", "12345678901": "9999999999", "-1e30": "-9999999999",
    }
    for raw, value in found.items():
        assert one(spark, nm.decimal(F.lit(raw), 4, 10, "-1")) == Decimal(value), raw
    null = F.lit(None).cast("string")
    assert one(spark, nm.decimal(null, 4, 10, "-1")) == -1 and one(spark, nm.money(null)) == 0 and one(spark, nm.price(null)) == Decimal("1e-10")
    assert one(spark, nm.price(F.lit("-1.5"))) == Decimal("1e-10") and one(spark, nm.price_change(F.lit("-1.5"))) == Decimal("-1.5")
    assert one(spark, nm.percent(F.lit("-1e300"))) == Decimal("-999999.9999") and one(spark, nm.supply(F.lit("1e25"))) == 0 and one(spark, nm.money(F.lit("inf"))) == 0
    assert one(spark, nm.price(F.lit("123456789012.123456"))) == Decimal("123456789012.12346")


def test_handles(spark):
    assert one(spark, nm.subreddit(F.lit("https://reddit.com/r/coin/"))) == "coin"
    assert one(spark, nm.telegram_user(F.lit("https://telegram.me/chan/x"))) == "chan"
    assert one(spark, nm.telegram_user(F.lit("@me"))) == "me"
    assert one(spark, nm.without_digits(F.lit("1000bonk"))) == "bonk"


def test_present_mean(spark):
    none = F.lit(None).cast("double")
    assert one(spark, fd.present_mean(none, none)) == 0 and one(spark, fd.present_mean(F.lit(0.5), none)) == 0.5


def test_instrument_choice(spark):
    rows = spark.createDataFrame([("BTC", "USDT", 1), ("BTC", "USDC", 2), ("ETH", "USDT", 3)], "base string, quote string, pos int")
    assert {(r.base, r.quote) for r in fd.one_instrument(rows, "base", "quote", "pos").collect()} == {("BTC", "USDC"), ("ETH", "USDT")}


def test_merge_twice_is_merge_once(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    batch = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1)], "k int, v string, o int")
    once = mg.upsert(old, batch, ["k"], ["o"])
    twice = mg.upsert(once, batch, ["k"], ["o"])
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect())) == [(1, "a"), (2, "d"), (3, "e")]


def test_tickers_resolve_in_two_steps(spark):
    coins = spark.createDataFrame(
        [("wrapped-bonk", "bonk", "Wrapped Bonk", 0), ("bonk", "BONK", "Bonk", 1), ("bonk", "bonk", "Bonk", 2), ("7eleven", "7eleven", "Seven", 3), ("x", None, "x", 4), ("a-b", "ab", None, 5)],
        "id string, symbol string, name string, position int",
    )
    asked = spark.createDataFrame([("BONK",), ("1000bonk",), ("7ELEVEN",), ("none",), ("9",), ("",), (None,), ("ab",)], "ticker string")
    found = {r.ticker: (r.id, r.step) for r in fd.resolve(asked, coins).collect()}
    assert found == {"BONK": ("bonk", 1), "1000bonk": ("bonk", 2), "7ELEVEN": ("7eleven", 1), "none": (None, None), "9": (None, None), "": (None, None), "ab": ("a-b", 1)}
    assert fd.resolve(asked.limit(0), coins).count() == 0 and fd.resolve(asked, coins.limit(0)).where("id IS NOT NULL").count() == 0


def test_market_pages_by_chunk(spark):
    ids = spark.createDataFrame([(f"c{k:03}",) for k in range(35)] * 2 + [(None,)], "id string")
    one, many = ({(r.id, r.chunk) for r in feeds.id_chunks(ids, 10, n).collect()} for n in (1, 6))
    assert one == many == {(f"c{k:03}", k // 10) for k in range(35)}
    page = lambda ks: "[" + ", ".join(f'{{"id": "c{k:03}", "current_price": 1.0}}' for k in ks) + "]"
    pages = [(0, 1, page(range(10))), (0, 2, "[]"), (1, 1, page(range(10, 17))), (1, 2, page([18])), (2, 1, "[]"), (2, 2, page(range(20, 30))), (3, 1, page([30, 31, 31, 33, 34])), (4, 1, None)]
    read = feeds.read_pages(spark.createDataFrame(pages, "chunk long, page int, value string"), 10)
    chunks = feeds.id_chunks(ids, 10)
    lacking = {r.id: r.why for r in feeds.market_missing(chunks, read, 10).collect()}
    assert lacking == {"c017": "short page", "c018": "short page", "c019": "short page", **{f"c{k:03}": "no page" for k in range(20, 30)}, "c032": "missing id"}


def test_recent_calls_equal_a_range(spark):
    rows = [("hot" if k % 3 else "b", 1_700_000_000 + (k * 7919) % 9000) for k in range(2000)] + [(None, 1), ("b", None)]
    calls = spark.createDataFrame(rows, "key string, at long").select("key", F.timestamp_seconds("at").alias("ts"), "at")
    found = sorted((r.key, r["at"], r.recent) for r in mon.with_recent(calls, "key", "ts", 60).collect())
    known = [r for r in rows if None not in r]
    assert found == sorted((k, t, sum(x == k and t - 60 < u <= t for x, u in known)) for k, t in known)
    parts = {r.block for r in calls.select((F.col("at") / mon.BLOCK).cast("long").alias("block")).distinct().collect()}
    assert len(parts) > 2  # the hot key is in several blocks


def fold(text):
    total, n, carry = 0.0, 0, 1.0
    for w in re.split("[^a-z]+", text.lower()):
        if w in fd.LEXICON:
            total, n = total + max(-1.0, min(1.0, fd.LEXICON[w] * carry)), n + 1
        carry = carry * fd.MODIFIERS[w] if w in fd.MODIFIERS else 1.0
    return total / n if n else 0.0


def test_polarity_carries_negation_and_strength(spark):
    assert one(spark, fd.polarity(F.lit("It is not very good."))) == pytest.approx(-0.5 * 1.3 * 0.7)
    draw = random.Random(5)
    texts = ["", "not", " ".join(draw.choice([*fd.LEXICON, *fd.MODIFIERS, "word", "Very", "NOT"]) for _ in range(3000))] + [" ".join(draw.choice([*fd.LEXICON, *fd.MODIFIERS, "word."]) for _ in range(9)) for _ in range(60)]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate([*texts, None])], "k int, text string")
    found = {r.k: r.p for r in rows.select("k", fd.polarity(F.col("text")).alias("p")).collect()}
    assert found == {k: pytest.approx(fold(t or "")) for k, t in enumerate([*texts, None])}
    groups = spark.createDataFrame([("a", "good"), ("a", ""), ("b", None), ("b", "")], "g string, text string")
    assert {r.g: r.score for r in fd.mean_polarity(groups, "g", "text").collect()} == {"a": 0.7, "b": None}


def test_unknown_values_are_errors(spark):
    assert one(spark, nm.one_of(F.lit("a"), {"a": "x"})) == "x" and one(spark, nm.one_of(F.lit(None).cast("string"), {"a": "x"})) is None
    with pytest.raises(Exception, match="unknown value b"):
        one(spark, nm.one_of(F.lit("b"), {"a": "x"}))
    assert one(spark, nm.done_percent(F.lit(3), F.lit(None).cast("int"))) == 300.0 and one(spark, nm.rate(F.lit(3), F.lit("2024-01-01"), F.lit("2024-01-01"))) == 0


def test_parents_and_children_merge_together(spark):
    parents = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    children = spark.createDataFrame([(1, "x"), (1, "y"), (2, "z")], "parent int, c string")
    batch = spark.createDataFrame([(1, "n"), (3, "m")], "id int, v string")
    mine = spark.createDataFrame([(3, "w"), (2, "stray")], "parent int, c string")
    merged, kept = mg.upsert_with_children(parents, children, batch, mine, "id", "parent")
    assert sorted(map(tuple, merged.collect())) == [(1, "n"), (2, "b"), (3, "m")] and sorted(map(tuple, kept.collect())) == [(2, "z"), (3, "w")]


def test_tasks_of_a_merge_stay_small(spark, monkeypatch):
    """Sessions here have four partitions, which would each take a fourth of the table."""
    monkeypatch.setattr(mg, "TASK_ROWS", 500, raising=False)
    monkeypatch.setattr(mg, "FEW_ROWS", 100, raising=False)
    parents = spark.range(6000).select("id", F.lit("old").alias("v"))
    children = spark.range(12_000).select((F.col("id") % 6000).alias("parent"), F.col("id").alias("c"))
    batch = parents.where("id % 3 = 0").unionByName(spark.range(6000, 7000).select("id", F.lit("").alias("v"))).withColumn("v", F.lit("new"))
    mine = children.where("c < 6000").withColumn("c", F.lit(-1).cast("long"))
    merged, kept = mg.upsert_with_children(parents, children, batch, mine, "id", "parent")
    assert sorted(map(tuple, merged.collect())) == [(k, "new" if k % 3 == 0 or k >= 6000 else "old") for k in range(7000)]
    wanted = [(k % 6000, k) for k in range(12_000) if k % 3] + [(k, -1) for k in range(0, 6000, 3)]
    assert sorted(map(tuple, kept.collect())) == sorted(wanted)
    absent = mg.insert_absent(parents, batch, ["id"])
    assert sorted(map(tuple, absent.collect())) == [(k, "old" if k < 6000 else "new") for k in range(7000)]
    left = mg.delete(children, batch.withColumnRenamed("id", "parent"), ["parent"])
    assert sorted(map(tuple, left.collect())) == sorted((k % 6000, k) for k in range(12_000) if k % 3)
    for table in (merged, kept, left):
        assert table.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < 1000
    swapped = mg.replace_children(children, mine, "parent", batch.select(F.col("id").alias("parent")))
    assert sorted(map(tuple, swapped.collect())) == [(k, -1) for k in range(6000)]


def test_symbol_rules(spark):
    good = dict(name="BTCUSDT", exchange="sim_1", base_asset="BTC", quote_asset="USDT", price_scale=2, launch_time=NOW)
    cases = {"": {}, "name": {"name": "BTC"}, "exchange": {"exchange": "Sim"}, "base_asset": {"base_asset": ""}, "quote_asset": {"quote_asset": "usdt"}, "price_scale": {"price_scale": 19}, "launch_time": {"launch_time": 5}}
    rows = spark.createDataFrame([{**good, **change, "case": k} for k, change in cases.items()])
    assert {r.case: r.errors for r in rows.select("case", F.array_join(rec.errors(rec.symbol_rules(F.lit(NOW))), ",").alias("errors")).collect()} == {k: k for k in cases}


def test_normalisers_evaluate_a_value_once(spark):
    plan = spark.range(1).select(nm.supply(F.col("id"))).select("*")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("id#") < 8 and len(plan) < 6000


def test_messages_are_counted_and_listed_whole(spark):
    draw = random.Random(3)
    rows = [(draw.choice(["user", "user", "bot", None, ""]), k, 0, draw.choice(["hi", "hi", "b|c", None, "", f"t{k}", "ü" * (k % 5)])) for k in range(700)]
    messages = spark.createDataFrame(rows, "role string, conv_id long, turn int, text string")
    there = [(r, t) for r, _, _, t in rows if t]
    expected = []
    for role in {r for r, _ in there}:
        texts = sorted((t for r, t in there if r == role), key=lambda t: t.encode())
        expected += [(role, len(texts), sum(map(len, texts)), k + 1, t) for k, t in enumerate(texts)]
    for segments in (None, 7):  # in ranges that cut groups, and the copies of one text
        found = fd.message_list(messages, "role", "text", ["conv_id", "turn"], segments)
        assert found.columns == ["role", "n", "n_chars", "place", "text"]
        assert sorted(map(tuple, found.collect()), key=repr) == sorted(expected, key=repr)
    assert fd.message_list(messages.limit(0), "role", "text", ["conv_id"]).count() == 0
