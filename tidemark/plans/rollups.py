"""Stored rollups that are refreshed from what changed: an invalidation log, and partial candles that merge.

Candles of the base interval, partial candles of one hour and the stored rollups are kept in one candle table, by interval and week. Each
batch that is merged into the base logs the hours and the buckets that it touches. A refresh takes, of a view's log, the buckets between its offsets; it
computes anew the hours among them that are logged as touched, from the base candles of these weeks alone, and puts the buckets together from hours. What lies
outside the offsets stays in the log until a refresh reaches it.

The log is a folder of batches: a batch is written once, and taken out when what it says has been done and the rest has been logged anew. So
batches that arrive during a refresh stay, and a refresh that broke off is done again by the next one; doing it twice changes nothing.
"""

from __future__ import annotations

import uuid
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.functions.intervals import bucket
from tidemark.plans.store import small, stored
from tidemark.sources.feeds import by_week, folder, merge_candles, partitions_of, stored_candles, within

#: How many hours before now a refresh of each stored rollup starts, and how many before now it ends.
START_HOURS = {"60": 3, "240": 12, "D": 72}
END_HOURS = {"60": 1, "240": 4, "D": 24}
HOURS = {"60": 1, "240": 4, "D": 24}
#: The interval under which partial candles are kept, and their log.
PARTIAL = "partial"
KEYS = ["symbol", "interval", "ts"]


def merge_partials(partials: DataFrame, code: str) -> DataFrame:
    """Candles of a coarser interval from partial ones; ``n`` counts the base candles."""
    return partials.groupBy("symbol", bucket("ts", code).alias("bucket")).agg(
        F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"),
        F.sum("volume").alias("volume"), F.sum("turnover").alias("turnover"), F.sum("n").alias("n"),
    ).withColumnRenamed("bucket", "ts")


class Rollups:
    """A candle table of base candles (of interval ``base``, with ``n``) with its rollups and their log."""

    def __init__(self, spark: SparkSession, path: str, base: str, columns: StructType):
        self.spark, self.path, self.base, self.columns = spark, path, base, columns

    def table(self, interval: str) -> DataFrame:
        return stored_candles(self.spark, f"{self.path}/candles", self.columns).where(F.col("interval") == interval)

    def ingest(self, batch: DataFrame) -> None:
        """Merges base candles, and logs what they touch: after the merge, as what is logged twice is only computed twice."""
        rows = stored(batch.select(self.columns.names), "batch")
        merge_candles(self.spark, f"{self.path}/candles", rows, KEYS, ["ts"])
        hours = stored(rows.select("symbol", bucket("ts", "60").alias("ts")).distinct(), "hours")
        for view, code in ((PARTIAL, "60"), *zip(HOURS, HOURS, strict=True)):
            self.log(view, hours if code == "60" else hours.select("symbol", bucket("ts", code).alias("ts")).distinct())

    def log(self, view: str, touched: DataFrame) -> None:
        touched.write.parquet(f"{self.path}/log/{view}/{uuid.uuid4().hex}")

    def logged(self, view: str) -> tuple[DataFrame | None, list]:
        """What the log of a view says, without repeats, and the batches that say it."""
        at, files = folder(self.spark, f"{self.path}/log/{view}")
        batches = [s.getPath() for s in files.listStatus(at)] if files.exists(at) else []
        whole = [b for b in batches if files.exists(b.suffix("/_SUCCESS"))]
        kind = self.columns["symbol"].dataType.simpleString()
        return (self.spark.read.schema(f"symbol {kind}, ts timestamp_ntz").parquet(*[b.toString() for b in whole]).distinct() if whole else None), whole

    def done(self, view: str, batches: list, rest: DataFrame) -> None:
        if not rest.isEmpty():
            self.log(view, rest)
        for b in batches:
            b.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(b, True)

    def refresh(self, code: str, now: datetime) -> int:
        """Brings a view's buckets between its offsets up to date; how many buckets were touched there."""
        first, last = now - timedelta(hours=START_HOURS[code]), now - timedelta(hours=END_HOURS[code])
        logged, batches = self.logged(code)
        if logged is None:
            return 0
        inside = lambda size: (F.col("ts") >= moment(first)) & (F.col("ts") + F.make_dt_interval(F.lit(0), F.lit(size)) <= moment(last))
        mine = stored(logged.where(inside(HOURS[code])), "touched")
        found = mine.count()
        if found:
            self.refresh_hours(mine, code)
            hours = self.among(PARTIAL, mine, code)
            fresh = merge_partials(hours, code).withColumn("interval", F.lit(code))
            merge_candles(self.spark, f"{self.path}/candles", fresh.select(self.columns.names), KEYS, ["ts"])
        self.done(code, batches, logged.where(~inside(HOURS[code])))
        return found

    def refresh_hours(self, buckets: DataFrame, code: str) -> None:
        """Partial candles of the logged hours in some buckets, from the base."""
        logged, batches = self.logged(PARTIAL)
        if logged is None:
            return
        marked = logged.select("symbol", "ts", bucket("ts", code).alias("bucket")).join(small(buckets.select("symbol", F.col("ts").alias("bucket"), F.lit(True).alias("mine"))), ["symbol", "bucket"], "left")
        marked = stored(marked, "hours")
        hours = marked.where("mine").select("symbol", "ts")
        candles = self.among(self.base, hours, "60")
        fresh = merge_partials(candles, "60").withColumn("interval", F.lit(PARTIAL))
        merge_candles(self.spark, f"{self.path}/candles", fresh.select(self.columns.names), KEYS, ["ts"])
        self.done(PARTIAL, batches, marked.where("mine IS NULL").select("symbol", "ts"))

    def among(self, interval: str, buckets: DataFrame, code: str) -> DataFrame:
        """Stored candles of an interval that lie in some buckets; other weeks aren't read. A bucket never goes beyond its week."""
        weeks = partitions_of(by_week(buckets).withColumn("interval", F.lit(interval)))
        rows = self.table(interval).where(within(weeks)).drop("week")
        wanted = small(buckets.select("symbol", F.col("ts").alias("bucket")))
        return rows.withColumn("bucket", bucket("ts", code)).join(wanted, ["symbol", "bucket"], "left_semi").drop("bucket")


def moment(at: datetime) -> Column:
    return F.lit(at).cast("timestamp_ntz")
