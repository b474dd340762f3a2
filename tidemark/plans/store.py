"""Tables that a plan writes on its way: below ``spark.checkpoint.dir``, which driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes up to which a side of a join counts as small enough to broadcast.
BROADCAST_BYTES = 48 << 20


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, or below the warehouse where that is unset (on a cluster, one that all machines share)."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written and read back: what is read more than once is computed once, and survives lost executors."""
    path = work_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if its values, of flat columns, take ``limit`` bytes at most, as counted over all rows; ``df`` itself otherwise."""
    held = F.lit(16)
    for f in df.schema.fields:
        held = held + (F.coalesce(F.octet_length(f"`{f.name}`"), F.lit(0)) if f.dataType.typeName() in ("string", "binary") else F.lit(8))
    return F.broadcast(df) if (df.agg(F.sum(held.cast("long"))).first()[0] or 0) <= limit else df
