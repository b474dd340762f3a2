"""Mixing sources to target weights by temperature.

A source's weight is its share of the words raised to an exponent, normalised. The exponent is bisected between 0 (all
alike) and 1 (natural shares) so that the weights' entropy reaches a target, or further up until no source is repeated
more often than a limit. Weights are realised as a budget of words for each source: as many whole passes over its rows as
the budget holds, and a last pass in which rows come in the order of a hash (a permutation) until the rest of the budget
is used up. Hashes are cut into blocks whose words are summed first, so that only the one block in
which a budget ends is looked at row by row, and no source lands in one task.

A null source counts as the empty one. Null and empty texts have no words; such rows follow the passes of their source.
Rows of one id that repeat are dealt alike. Equal hashes are ordered by id. A table without rows gives an empty result; extra
columns stay, whatever their names; those called ``n_words``, ``copy`` or ``order_key`` are replaced.
"""

from __future__ import annotations

from collections.abc import Callable
from math import log

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small, stored, words_of

SEED, BITS = 17, 12
ON_DRIVER = 100_000


def bisect(reached: Callable[[float], bool], steps: int = 50) -> float:
    """The largest exponent in [0, 1] for which ``reached`` still holds; it must hold at 0 if anywhere."""
    if reached(1.0):
        return 1.0
    low, high = 0.0, 1.0
    for _ in range(steps):
        middle = (low + high) / 2
        low, high = (middle, high) if reached(middle) else (low, middle)
    return low


class Shares:
    """Sums over the sources' shares: on the driver for up to ``ON_DRIVER`` sources, else by Spark."""

    def __init__(self, totals: DataFrame, n: int):
        self.words = [r["words"] for r in totals.where("words > 0").select("words").collect()] if n <= ON_DRIVER else None
        self.totals = totals.where("words > 0")

    def sums(self, power: float) -> tuple[float, float, float, float]:
        """Sum of t^power, sum of t^power * log(t^power), least and largest t, over word totals t."""
        if self.words is not None:
            p = [t**power for t in self.words]
            return sum(p), sum(x * log(x) for x in p), min(self.words), max(self.words)
        p = F.pow(F.col("words"), F.lit(power))
        return tuple(self.totals.agg(F.sum(p), F.sum(p * F.log(p)), F.min("words"), F.max("words")).first())

    def entropy(self, power: float) -> float:
        total, weighted, *_ = self.sums(power)
        return log(total) - weighted / total


def exponent(shares: Shares, n: int, entropy_share: float | None, limit: float | None, budget: float | None) -> float:
    """The exponent that meets the entropy target, raised as far as the repetition limit asks."""
    if n < 2:
        return 1.0
    found = 1.0 if entropy_share is None else bisect(lambda a: shares.entropy(a) >= entropy_share * log(n))
    if limit is None:
        return found

    def repeats(a: float) -> float:
        total, _, least, most = shares.sums(a)
        size = most ** (1 - a) * total if budget is None else budget
        return size * least ** (a - 1) / total

    if entropy_share is None:  # the limit alone decides: as even as it allows
        found = 0.0
    return found if repeats(found) <= limit else 1 - bisect(lambda b: repeats(1 - b) <= limit)


def mix(
    docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", entropy_share: float | None = 0.95, limit: float | None = 4.0, budget_share: float | None = 1.0
) -> DataFrame:
    """``docs`` with each row as often as its source's budget asks, and ``n_words``, ``copy`` (from 0), ``order_key``.

    ``budget_share``: the budget against all words; None: the least budget at which every row comes once at least.
    Sorting by ``copy`` and ``order_key`` gives the permutation of each pass.
    """
    hashed = F.xxhash64(F.lit(SEED), F.col(f"`{key}`"))
    # a row's own columns stay in one, so that their names can't clash with those in here
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    rows = docs.select(own, F.col(f"`{key}`").alias("_key"), F.size(words_of(F.col(f"`{text}`"))).cast("long").alias("n_words"), F.coalesce(F.col(f"`{source}`"), F.lit("")).alias("_source"), hashed.alias("_hash"))
    bits = BITS  # 2 ** BITS blocks of a source, and as many cells of the block in which its budget ends
    fine = stored(rows.groupBy("_source", F.shiftrightunsigned("_hash", 64 - bits).alias("fine")).agg(F.sum("n_words").alias("words"), F.count("*").alias("rows")), "blocks")
    totals = fine.groupBy("_source").agg(F.sum("words").alias("words"), F.sum("rows").alias("rows"))
    n = totals.where("words > 0").count()
    shares = Shares(totals, n)
    all_words = totals.agg(F.sum("words")).first()[0] or 0
    budget = None if budget_share is None else budget_share * all_words
    power = exponent(shares, n, entropy_share, limit, budget)
    total, _, _, most = shares.sums(power) if n else (1.0, 0.0, 1.0, 1.0)
    size = budget if budget is not None else most ** (1 - power) * total
    aim = F.when(F.col("words") > 0, size * F.pow("words", F.lit(power - 1.0)) / total).otherwise(1.0)
    # a hair is added so that a whole number of passes isn't missed by rounding
    plan = totals.select("_source", F.floor(aim + 1e-9).cast("int").alias("passes"), (F.greatest(F.lit(0.0), aim - F.floor(aim + 1e-9)) * F.col("words")).alias("rest")).withColumn("open", F.col("rest") > 0)
    running = F.sum("words").over(Window.partitionBy("_source").orderBy("fine"))
    ends = fine.withColumn("until", running).join(plan, "_source").where(F.col("until") > F.col("rest"))
    end = ends.groupBy("_source").agg(F.min(F.struct("fine", (F.col("rest") - F.col("until") + F.col("words")).alias("left"))).alias("end"))
    plan = stored(plan.join(end, "_source", "left").select("_source", "passes", "open", F.coalesce("end.fine", F.lit(1 << bits)).alias("end"), F.coalesce("end.left", F.lit(0.0)).alias("left")), "plan")

    dealt = rows.join(small(plan), "_source").withColumn("fine", F.shiftrightunsigned("_hash", 64 - bits))
    edge = dealt.where("fine = end").select("_source", "_key", "_hash", "n_words", "left")
    low = F.shiftrightunsigned(F.shiftleft("_hash", bits), 64 - bits)
    inner = edge.groupBy("_source", low.alias("low")).agg(F.sum("n_words").alias("words"), F.first("left").alias("left"))
    inner = inner.withColumn("until", F.sum("words").over(Window.partitionBy("_source").orderBy("low")))
    last = inner.where(F.col("until") > F.col("left")).groupBy("_source").agg(F.min(F.struct("low", (F.col("left") - F.col("until") + F.col("words")).alias("left"))).alias("last"))
    last = stored(last.select("_source", F.col("last.low").alias("low_end"), F.col("last.left").alias("low_left")), "last")
    cell = edge.withColumn("low", low).join(small(last), "_source").where("low = low_end")
    cell = cell.withColumn("until", F.sum("n_words").over(Window.partitionBy("_source").orderBy("_hash", "_key").rowsBetween(Window.unboundedPreceding, 0)))
    taken = stored(cell.where(F.col("until") <= F.col("low_left")).select("_source", "_key").distinct().withColumn("_taken", F.lit(True)), "taken")

    out = dealt.join(small(last), "_source", "left").withColumn("low", low)
    out = out.join(small(taken), ["_key", "_source"], "left")
    inside = (F.col("fine") < F.col("end")) | ((F.col("fine") == F.col("end")) & (F.col("low") < F.coalesce("low_end", F.lit(1 << bits)))) | F.coalesce("_taken", F.lit(False))
    copies = F.col("passes") + F.when(F.col("open") & inside, 1).otherwise(0)
    several = out.withColumn("_copies", copies).where("_copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("_copies") - 1)))
    added = {"n_words": F.col("n_words"), "copy": F.col("copy"), "order_key": F.xxhash64("_hash", "copy")}
    return several.select(*[F.col("_row").getField(c).alias(c) for c in docs.columns if c not in added], *[v.alias(c) for c, v in added.items()])
