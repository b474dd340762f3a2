"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as a regular expression class body.
SPACE = r"\x20\x09-\x0D"
#: Rows of a batch that a Python worker gets in jobs that ``stored`` runs.
ROWS_AT_ONCE, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000
#: Bytes up to which a side of a join counts as small enough to broadcast.
BROADCAST_BYTES = 48 << 20
#: Folders that ``stored`` has written within ``scratch``.
SCRATCH: ContextVar[list[str] | None] = ContextVar("scratch", default=None)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``, or the warehouse where that is unset."""
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    return found or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_tidemark"


def written(df: DataFrame, path: str) -> None:
    """Writes ``df``; Python workers get ``BATCH_ROWS`` rows at once while that runs, as texts may be long."""
    spark = df.sparkSession
    before = spark.conf.get(ROWS_AT_ONCE)
    spark.conf.set(ROWS_AT_ONCE, str(min(BATCH_ROWS, int(before)) if int(before) > 0 else BATCH_ROWS))
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(ROWS_AT_ONCE, before)


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors. Inside ``scratch`` the folder goes at its end."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    if (held := SCRATCH.get()) is not None:
        held.append(path)
    written(df, path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes what ``stored`` writes within, at the end: for callers that write a result themselves. Frames made within can't be read after it."""
    mark = SCRATCH.set([])
    try:
        yield
    finally:
        paths = SCRATCH.get()
        SCRATCH.reset(mark)
        for path in paths:
            delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if its values take ``limit`` bytes at most, as counted over all rows; ``df`` itself otherwise."""
    held = F.lit(16)
    for f in df.schema.fields:
        kind, c = f.dataType.typeName(), F.col(f"`{f.name}`")
        held = held + (16 + 8 * F.coalesce(F.size(c), F.lit(0)) if kind == "array" else F.coalesce(F.octet_length(c), F.lit(0)) if kind in ("string", "binary") else F.lit(8))
    most = df.agg(F.sum(held.cast("long"))).first()[0]
    return F.broadcast(df) if (most or 0) <= limit else df


def partitions(df: DataFrame) -> int:
    """The number of partitions that a shuffle has, as set in the session."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it any number of times in ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def parts_of(text: Column) -> Column:
    """What stands between ASCII white space, empty parts too; null text is one empty part. Splits at one character, which needs no pattern."""
    t = F.coalesce(text, F.lit(""))
    for c in "\t\n\x0b\x0c\r":
        t = F.replace(t, F.lit(c), F.lit(" "))
    return F.split(t, " ")


def words_of(text: Column) -> Column:
    """Words between ASCII white space, in order; null text has none."""
    return F.array_remove(parts_of(text), "")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """Connected components of an undirected edge list: columns ``node``, ``component`` (the smallest node reachable).

    Alternates large-star and small-star steps, so the edge list never grows beyond its first size and no list of
    neighbours is gathered. Each step is written to the shared folder. Nodes without edges are absent; self loops and
    repeated edges are harmless; an empty edge list gives an empty result. Steps go on until nothing changes, about as many
    as the logarithm of the longest path.
    """
    a, b = F.col(left).cast("long"), F.col(right).cast("long")
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    now = stored(now, "star")
    state = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: larger neighbours of u hang on the least of u's neighbourhood
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: u and its smaller neighbours hang on the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small_star = large.join(least, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        now = stored(small_star, "star")
        # done when every u has one v and no v is a u
        after = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if after == state:
            break
        state = after
    return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
