"""Keyed writes over plain tables: merges by rewrite, deletes as anti-joins, set differences.

Tables without row-level operations can't be updated in place, so each operator gives the whole new table; applying one
batch twice changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a task where tables are dealt out by keys, and rows up to which one side of a join is broadcast.
TASK_ROWS, FEW_ROWS = 1_250_000, 100_000


def dealt(rows: DataFrame, keys: list[str], n: int) -> DataFrame:
    """``rows`` dealt out by keys, so that of ``n`` rows in all a task has some ``TASK_ROWS`` at most: what it sorts or hashes doesn't grow with the table, however few partitions the session has.

    There are no fewer parts than the session's, as Spark deals a join's sides out once more then.
    """
    if n <= TASK_ROWS:
        return rows
    return rows.repartition(max(-(-n // TASK_ROWS), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *keys)


def matched(rows: DataFrame, others: DataFrame, keys: list[str], how: str, known: int | None = None, asked: int | None = None) -> DataFrame:
    """``rows`` with (``left_semi``) or without (``left_anti``) a row of equal keys in ``others``; ``known`` and ``asked`` are the numbers of both (or more), where a caller has them."""
    others = others.select(*keys)
    asked = others.count() if asked is None else asked
    if asked <= FEW_ROWS:
        return rows.join(F.broadcast(others), keys, how)
    n = asked + (rows.count() if known is None else known)
    kept = dealt(others, keys, n)
    return dealt(rows, keys, n).join(kept.hint("merge") if n > TASK_ROWS else kept, keys, how)


def last_wins(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The last row of each key by ``order``."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.desc(c) if isinstance(c, str) else c for c in order]))
    return rows.withColumn("_place", place).where("_place = 1").drop("_place")


def upsert(old: DataFrame, batch: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """``old`` with the batch's rows in place of those of equal key; in a batch the last by ``order`` wins.

    Only the batch is ranked: the old table is read once and joined, without a window over it.
    """
    n = batch.count()
    mine = dealt(batch, keys, n)
    new = last_wins(mine, keys, order) if order else mine.dropDuplicates(keys)
    return matched(old, batch, keys, "left_anti", asked=n).unionByName(new.select(old.columns))


def insert_absent(old: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` with the batch's rows whose key it doesn't have."""
    n, there = batch.count(), old.count()
    new = matched(batch, old, keys, "left_anti", n, there)  # dealt out by keys already, unless the old table is broadcast
    return old.unionByName((dealt(new, keys, n) if there <= FEW_ROWS else new).dropDuplicates(keys).select(old.columns))


def replace_children(children: DataFrame, batch: DataFrame, parent: str, gone: DataFrame | None = None) -> DataFrame:
    """Children of every parent in the batch, and of every one in ``gone``, are dropped, and those of the batch take their place."""
    parents = batch.select(parent) if gone is None else batch.select(parent).unionByName(gone.select(parent))
    return matched(children, parents, [parent], "left_anti").unionByName(batch.select(children.columns))


def upsert_with_children(parents: DataFrame, children: DataFrame, batch: DataFrame, batch_children: DataFrame, key: str, child_key: str) -> tuple[DataFrame, DataFrame]:
    """Parents merged by ``key``; the children of every parent in the batch, also of one that comes without any, are replaced by the batch's."""
    gone = batch.select(F.col(key).alias(child_key))
    n = gone.count()
    mine = matched(batch_children, gone, [child_key], "left_semi", asked=n)  # those of other parents aren't the batch's to write
    return upsert(parents, batch, [key]), matched(children, gone, [child_key], "left_anti", asked=n).unionByName(mine.select(children.columns))


def missing(wanted: DataFrame, received: DataFrame, key: str) -> DataFrame:
    """What was asked for and isn't there, once each."""
    return wanted.select(key).distinct().join(received.select(key), key, "left_anti")


def delete_everywhere(tables: dict[str, DataFrame], gone: DataFrame, keys: list[str]) -> dict[str, DataFrame]:
    """Every table without the rows of keys that go."""
    return {name: delete(rows, gone, keys) for name, rows in tables.items()}


def delete(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return matched(rows, gone, keys, "left_anti")


def delete_cascade(parents: DataFrame, children: DataFrame, gone: DataFrame, key: str, child_key: str) -> tuple[DataFrame, DataFrame]:
    """Parents without those of ``gone``, and children without theirs."""
    ids = gone.select(F.col(key).alias(child_key))
    n = ids.count()
    return matched(parents, gone, [key], "left_anti", asked=n), matched(children, ids, [child_key], "left_anti", asked=n)


def retain(rows: DataFrame, ts: str, now, days: int) -> DataFrame:
    """Rows of the last ``days`` days before ``now``."""
    return rows.where(F.col(ts) >= now - F.make_dt_interval(F.lit(days)))


def stale(entities: DataFrame, stored: DataFrame, key: str, now, max_age_s: int) -> DataFrame:
    """Entities to collect: those never stored, or stored ``max_age_s`` seconds ago or earlier."""
    age = F.unix_timestamp(now) - F.unix_timestamp(F.col("updated_at").cast("timestamp"))
    joined = entities.join(stored.select(key, "updated_at"), key, "left")
    return joined.where(F.coalesce(age >= max_age_s, F.lit(True))).select(entities.columns)
