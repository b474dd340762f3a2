"""Long series in segments: range partitions of (series, time), with what passes from one segment to the next.

A series may be far longer than a task can hold, so nothing is ever dealt out by the series alone. Rows are put in ranges of the series and its time;
a segment is what one range holds of one series. Only the first and the last series of a range can go on beyond it, so what segments hand
over (a row, a count, a sum, a state) is two values a range at most: these are gathered on the driver, chained there, and broadcast. Rows without a series or a time are
left out. Up to ``SEGMENT_ROWS`` rows in all are one range, which needs no cut.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import groupby

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from tidemark.plans.store import stored

SEGMENT_ROWS = 1_000_000


@dataclass
class Series:
    """``rows`` have the columns of ``by``, ``ts`` and a ``segment``; ``cut`` says whether there is more than one range."""

    rows: DataFrame
    by: list[str]
    ts: str
    cut: bool

    @property
    def key(self) -> list[str]:
        return [*self.by, "segment"]

    def within(self) -> Window:
        return Window.partitionBy(*self.key).orderBy(self.ts)

    def chains(self, summary: DataFrame) -> Iterator[list[Row]]:
        """Of a summary with one row a segment, the rows of each series that goes over several segments, in order."""
        if not self.cut:
            return
        at = F.struct(*self.by, *[c for c in summary.columns if c not in self.by])
        ends = summary.groupBy("segment").agg(F.min(at).alias("first"), F.max(at).alias("last")).orderBy("segment").collect()  # a row a range
        rows = [r for e in ends for r in ([e["first"]] if self.of(e["first"]) == self.of(e["last"]) else [e["first"], e["last"]])]
        for _, chain in groupby(rows, self.of):
            found = list(chain)
            if len(found) > 1:
                yield found

    @cached_property
    def spans(self) -> list[list[Row]]:
        """The chains, with the rows ``n`` that each segment has."""
        return list(self.chains(self.rows.groupBy(*self.key).agg(F.count("*").alias("n"))))

    def of(self, row: Row) -> tuple:
        return tuple(row[c] for c in self.by)

    def carried(self, summary: DataFrame, hand: Callable[[list[Row]], list[tuple]], kinds: str) -> DataFrame | None:
        """For each row of a chain what ``hand`` gives for it, as a table by segment to broadcast; None if no series goes on."""
        return self.handed(self.chains(summary), hand, kinds)

    def handed(self, chains: Iterable[list[Row]], hand: Callable[[list[Row]], list[tuple]], kinds: str) -> DataFrame | None:
        found = [(*self.of(r), r["segment"], *x) for chain in chains for r, x in zip(chain, hand(chain), strict=True)]
        return self.table(found, kinds) if found else None

    def table(self, found: list[tuple], kinds: str) -> DataFrame:
        own = [f"`{c}` {self.rows.schema[c].dataType.simpleString()}" for c in self.by]
        return self.rows.sparkSession.createDataFrame(found, ", ".join([*own, "segment int", kinds]))

    def with_carried(self, rows: DataFrame, carried: DataFrame | None, kinds: str) -> DataFrame:
        """Rows with the columns of ``carried``, null where nothing is handed over."""
        if carried is None:
            return rows.select("*", *[F.lit(None).cast(k.split()[1]).alias(k.split()[0]) for k in kinds.split(", ")])
        return rows.join(F.broadcast(carried), self.key, "left")

    def with_halo(self, length: int) -> DataFrame:
        """Rows with ``own``; where a series goes on, the ``length`` rows before a segment come with it as well, not its own."""
        rows = self.rows.withColumn("own", F.lit(True))
        wants: list[tuple] = []
        for chain in self.spans if length else ():
            for i, r in enumerate(chain):
                need = length
                for before in reversed(chain[:i]):
                    if need <= 0:
                        break
                    wants.append((*self.of(r), before["segment"], r["segment"], min(need, before["n"])))
                    need -= before["n"]
        if not wants:
            return rows
        asked = rows.join(F.broadcast(self.table(wants, "goes_to int, asked long")), self.key)
        from_end = F.row_number().over(Window.partitionBy(*self.key, "goes_to").orderBy(F.desc(self.ts)))
        halo = asked.withColumn("_k", from_end).where(F.col("_k") <= F.col("asked")).withColumn("segment", F.col("goes_to")).withColumn("own", F.lit(False))
        return rows.unionByName(halo.select(rows.columns))


def cut(rows: DataFrame, by: list[str], ts: str, segments: int | None = None, known: int | None = None) -> Series:
    """A table in ranges; as many as its rows ask for (``known``: their number), or ``segments``."""
    there = rows.where(" AND ".join(f"`{c}` IS NOT NULL" for c in [*by, ts]))
    if segments is None:
        segments = -(-(there.count() if known is None else known) // SEGMENT_ROWS)
    if segments <= 1:
        return Series(there.withColumn("segment", F.lit(0)), by, ts, False)
    dealt = there.repartitionByRange(segments, *by, ts)
    return Series(stored(dealt.withColumn("segment", F.spark_partition_id()), "segments"), by, ts, True)
