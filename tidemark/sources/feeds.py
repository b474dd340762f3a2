"""Sources and sinks: candle pages and stream messages as JSON, metric text, and candle tables as Parquet."""

from __future__ import annotations

from datetime import datetime, time, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.operators.candles import in_range
from tidemark.operators.merge import delete, upsert
from tidemark.plans.series import cut
from tidemark.schemas import STREAM_MESSAGE

#: Quote assets of the instruments that are collected.
QUOTES = ("USDT", "USDC")


def candle_pages(spark: SparkSession, path: str) -> DataFrame:
    """Pages of candles, each a JSON line with ``symbol``, ``interval`` and ``list`` of arrays of strings, newest first."""
    pages = spark.read.schema("symbol string, interval string, list array<array<string>>").json(path)
    names = ["open", "high", "low", "close", "volume", "turnover"]
    rows = pages.select("symbol", "interval", F.explode("list").alias("r"))
    return rows.select("symbol", "interval", F.col("r")[0].cast("long").alias("ts_ms"), *[F.col("r")[k + 1].cast("double").alias(n) for k, n in enumerate(names)])


def stream_messages(messages: DataFrame, column: str = "value", keep: list[str] | None = None) -> DataFrame:
    """Candles of stream messages, the first entry of each, confirmed or not; with the columns ``keep`` of the messages."""
    m = messages.select(*(keep or []), F.from_json(column, STREAM_MESSAGE).alias("m")).select(*(keep or []), "m.topic", F.col("m.data")[0].alias("d"))
    topic = F.split("topic", r"\.")
    values = [F.col(f"d.{n}").cast("double").alias(n) for n in ("open", "high", "low", "close", "volume", "turnover")]
    return m.select(*(keep or []), topic[2].alias("symbol"), topic[1].alias("interval"), F.timestamp_millis("d.start").alias("ts"), *values, F.col("d.confirm").alias("confirm"))


def stream_rows(messages: DataFrame, column: str = "value") -> DataFrame:
    """Candles of stream messages, confirmed ones only."""
    return stream_messages(messages, column).where("confirm").drop("confirm")


def metric_text(lines: DataFrame, column: str = "value", position: str = "position") -> DataFrame:
    """Samples of metric text: comments and labels dropped, the last sample of a name wins."""
    line = F.trim(F.col(column))
    name = F.regexp_extract(line, r"^([^{\s]+)", 1)
    value = F.element_at(F.split(line, r"\s+"), -1).try_cast("double")
    rows = lines.where((F.length(line) > 0) & ~line.startswith("#")).select(name.alias("name"), value.alias("value"), position)
    return rows.where(F.col("value").isNotNull()).groupBy("name").agg(F.max_by("value", position).alias("value"))


def instruments(pages: DataFrame, column: str = "value") -> DataFrame:
    """Instruments of JSON pages that are traded against one of ``QUOTES``; ``position`` is their place in the page."""
    kind = "list array<struct<symbol: string, baseCoin: string, quoteCoin: string, status: string, launchTime: string>>"
    rows = pages.select(F.posexplode(F.from_json(column, kind)["list"]).alias("position", "i"))
    traded = rows.where((F.col("i.status") == "Trading") & F.col("i.quoteCoin").isin(*QUOTES))
    launch = F.coalesce(F.col("i.launchTime").try_cast("long"), F.lit(0))
    return traded.select(F.col("i.symbol").alias("symbol"), F.col("i.baseCoin").alias("base"), F.col("i.quoteCoin").alias("quote"), launch.alias("launch_ms"), "position")


#: Fixed value: ids that a market source takes at once, and coins that a page of its answer holds.
PER_PAGE = 250
COIN = "array<struct<id: string, current_price: double, market_cap: double>>"


def market_rows(pages: DataFrame, column: str = "value") -> DataFrame:
    """Coins of JSON pages, each page an array; an empty page has none."""
    rows = pages.select(F.explode(F.from_json(column, COIN)).alias("c"))
    return rows.select("c.id", F.col("c.current_price").alias("price"), F.col("c.market_cap").alias("cap"))


def id_chunks(ids: DataFrame, size: int = PER_PAGE, segments: int | None = None) -> DataFrame:
    """Distinct ids in order, in chunks of ``size``: ``id``, ``chunk`` from 0. Ranks are counted in ranges of ids (``plans/series``), not in one task."""
    s = cut(ids.select("id").distinct(), [], "id", segments)
    starts = s.handed(s.spans, lambda chain: [(sum(r["n"] for r in chain[:i]),) for i in range(len(chain))], "before long")
    rank = F.row_number().over(s.within()) + F.coalesce("before", F.lit(0)) - 1
    return s.with_carried(s.rows, starts, "before long").select("id", F.floor(rank / size).cast("long").alias("chunk"))


def read_pages(pages: DataFrame, size: int = PER_PAGE) -> DataFrame:
    """Pages (``chunk``, ``page`` from 1, ``value``) as a reader takes them, with the coins ``c`` of each: up to a chunk's first page that is short of ``size`` coins."""
    parsed = pages.select("chunk", "page", F.coalesce(F.from_json("value", COIN), F.array().cast(COIN)).alias("c"))
    last = parsed.where(F.size("c") < size).groupBy("chunk").agg(F.min("page").alias("last"))
    return parsed.join(last, "chunk", "left").where(F.col("page") <= F.coalesce("last", F.col("page"))).drop("last")


def market_missing(chunks: DataFrame, read: DataFrame, size: int = PER_PAGE) -> DataFrame:
    """Ids that no page has: ``id``, ``chunk`` and ``why``: ``no page`` (the chunk has none, or an empty first one), ``short page`` (a page of the chunk
    has fewer coins than were still to come) or ``missing id`` (pages are full, of other coins or of repeated ones)."""
    received = read.select(F.explode("c.id").alias("id")).distinct()
    got = read.groupBy("chunk").agg(F.sum(F.size("c")).alias("coins"))
    asked = chunks.groupBy("chunk").agg(F.count("*").alias("asked"))
    state = asked.join(got, "chunk", "left").select("chunk", F.when(F.coalesce("coins", F.lit(0)) == 0, "no page").when(F.col("coins") < F.col("asked"), "short page").otherwise("missing id").alias("why"))
    return chunks.join(received, "id", "left_anti").join(state, "chunk").select("id", "chunk", "why")


def by_week(candles: DataFrame) -> DataFrame:
    return candles.withColumn("week", F.date_trunc("week", "ts").cast("date"))


def write_candles(candles: DataFrame, path: str) -> None:
    """Parquet by interval and week, sorted for range reads; weeks take the place of hypertable chunks. Partitions that have rows are replaced."""
    out = by_week(candles).repartition("interval", "week").sortWithinPartitions("symbol", "ts")
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("interval", "week").parquet(path)


def stored_candles(spark: SparkSession, path: str, columns: StructType) -> DataFrame:
    """All of a candle table, with its partition column ``week``; ``columns`` are those of a candle."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in columns.fields if f.name != "week")
    return spark.read.schema(f"{kinds}, week date").parquet(path)


def read_candles(spark: SparkSession, path: str, columns: StructType, interval: str, start: str, end: str) -> DataFrame:
    """Stored candles of an interval between two times; partitions of other intervals and weeks aren't read."""
    first, last = (F.date_trunc("week", F.lit(x).cast("timestamp")).cast("date") for x in (start, end))
    rows = stored_candles(spark, path, columns).where((F.col("interval") == interval) & F.col("week").between(first, last))
    return in_range(rows, start, end).drop("week")


def partitions_of(rows: DataFrame) -> list[tuple]:
    """The intervals and weeks of rows; there are as many as the table has partitions, at most."""
    return [(r["interval"], r["week"]) for r in rows.select("interval", "week").distinct().collect()]


def within(parts: list[tuple]) -> Column:
    """A filter by literals, so that other partitions aren't even listed for the scan."""
    weeks: dict[str, list] = {}
    for interval, week in parts:
        weeks.setdefault(interval, []).append(week)
    out = F.lit(False)
    for interval, some in weeks.items():
        out = out | ((F.col("interval") == interval) & F.col("week").isin(sorted(some)))
    return out


def folder(spark: SparkSession, path: str):
    """A path as the file system knows it, and the file system."""
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return jpath, jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def drop_partitions(spark: SparkSession, path: str, parts: list[tuple]) -> None:
    for interval, week in parts:
        gone, files = folder(spark, f"{path}/interval={interval}/week={week}")
        files.delete(gone, True)


def merge_candles(spark: SparkSession, path: str, batch: DataFrame, keys: list[str], order: list[str], symbols: DataFrame | None = None) -> None:
    """Merges a batch into a candle table: partitions that it touches are read, merged and replaced, the others stay as they are and aren't read.

    A batch that runs again changes nothing. With ``symbols``, a row of an unknown symbol is an error. Rows without interval or time are no candles and are left out.
    """
    batch = batch.where("interval IS NOT NULL AND ts IS NOT NULL")
    if symbols is not None:
        known = symbols.select("symbol").distinct().withColumn("_known", F.lit(True))
        wrong = F.raise_error(F.concat(F.lit("unknown symbol "), F.coalesce("symbol", F.lit("null"))))
        batch = batch.join(known, "symbol", "left").withColumn("symbol", F.when(F.col("_known"), F.col("symbol")).otherwise(wrong)).select(batch.columns)
    new = by_week(batch)
    touched = partitions_of(new)
    if not touched:
        return
    jpath, files = folder(spark, path)
    old = stored_candles(spark, path, batch.schema).where(within(touched)) if files.exists(jpath) else new.limit(0)
    write_candles(upsert(old.select(new.columns), new, keys, order).drop("week"), path)


def rewrite(spark: SparkSession, path: str, kept: DataFrame) -> None:
    """Replaces the partitions that ``kept`` has rows of."""
    out = kept.repartition("interval", "week").sortWithinPartitions("symbol", "ts")
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("interval", "week").parquet(path)


#: Symbols up to which a delete looks for them by a filter that reaches the files, which are sorted by symbol.
NAMED = 1000


def delete_symbols(spark: SparkSession, path: str, columns: StructType, gone: DataFrame) -> None:
    """Takes symbols out of a candle table; partitions without them stay as they are, those that hold nothing else go.

    To find the partitions, only the column of symbols is read, and of it, for few symbols, only the row groups that may hold them.
    """
    rows, names = stored_candles(spark, path, columns), gone.select("symbol").where("symbol IS NOT NULL").distinct()
    listed = [r["symbol"] for r in names.limit(NAMED + 1).collect()]
    found = rows.where(F.col("symbol").isin(listed)) if len(listed) <= NAMED else rows.join(names, "symbol", "left_semi")
    hits = {(r["interval"], r["week"]): r["n"] for r in found.groupBy("interval", "week").agg(F.count("*").alias("n")).collect()}
    if not hits:
        return
    touched = rows.where(within(list(hits)))
    all_rows = {(r["interval"], r["week"]): r["n"] for r in touched.groupBy("interval", "week").agg(F.count("*").alias("n")).collect()}
    left = [k for k, n in hits.items() if n < all_rows[k]]
    if left:
        some = rows.where(within(left))
        rewrite(spark, path, some.where(~F.col("symbol").isin(listed) | F.col("symbol").isNull()) if len(listed) <= NAMED else delete(some, names, ["symbol"]))
    drop_partitions(spark, path, [k for k in hits if k not in left])


def retain_candles(spark: SparkSession, path: str, columns: StructType, oldest: datetime) -> None:
    """Takes candles before a moment out of a table: whole weeks are dropped, and only the week that holds the moment is read and rewritten."""
    rows = stored_candles(spark, path, columns)
    old = [(i, w) for i, w in partitions_of(rows.where(F.col("week") <= F.lit(oldest.date()))) if w is not None]
    ends = lambda w: datetime.combine(w, time()) + timedelta(days=7)
    cut = [(i, w) for i, w in old if ends(w) > oldest]
    kept = rows.where(within(cut) & (F.col("ts") >= F.lit(oldest).cast(rows.schema["ts"].dataType)))
    there = partitions_of(kept) if cut else []
    if there:
        rewrite(spark, path, kept)
    drop_partitions(spark, path, [k for k in old if k not in there])
