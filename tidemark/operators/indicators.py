"""Technical indicators over candles, all symbols in one plan.

Series are cut into segments by symbol and time (``plans/series``), so one symbol runs in many tasks. SMA and Bollinger bands are window
frames over segments that come with the rows before them; OBV is a running sum within segments on top of what came before. EMA, MACD and
RSI carry a state from candle to candle: a segment maps it linearly, and these maps are chained. Rows are put in order of time first,
whatever the order of the input. Symbols with fewer than ``MIN_ROWS`` candles have no rows; neither have warm-up candles. Rows without
a symbol, a time or a finite close are no candles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from tidemark.plans.series import Series, cut
from tidemark.plans.store import small

MIN_ROWS = 30


def eligible(candles: DataFrame) -> tuple[DataFrame, int]:
    """Candles of the symbols that have enough of them, and how many candles there are in all."""
    rows = candles.where(F.col("symbol").isNotNull() & F.col("ts").isNotNull() & finite("close"))
    counts = rows.groupBy("symbol").agg(F.count("*").alias("n"))
    found = counts.agg(F.sum("n").alias("n"), F.count_if(F.col("n") < MIN_ROWS).alias("short")).first()
    if found["short"]:
        rows = rows.join(small(counts.where(F.col("n") >= MIN_ROWS).select("symbol")), "symbol", "left_semi")
    return rows, found["n"] or 0


def too_short(candles: DataFrame) -> DataFrame:
    """Symbols that have too few candles, with their count."""
    return candles.groupBy("symbol").agg(F.count("*").alias("n_rows")).where(F.col("n_rows") < MIN_ROWS)


def finite(*columns: str) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
    return out


def series(candles: DataFrame, values: list[str], segments: int | None) -> Series:
    rows, n = eligible(candles)
    return cut(rows.select("symbol", "ts", *[F.col(c).cast("double").alias(c) for c in values]), ["symbol"], "ts", segments, n)


def framed(candles: DataFrame, length: int, values: dict, segments: int | None) -> DataFrame:
    """Aggregates over each candle and the ``length - 1`` before it, of candles that have as many before them."""
    s = series(candles, ["close"], segments)
    frame = s.within().rowsBetween(1 - length, 0)
    rows = s.with_halo(length - 1).select("symbol", "ts", "own", F.count("*").over(frame).alias("_n"), *[x.over(frame).alias(c) for c, x in values.items()])
    return rows.where(F.col("own") & (F.col("_n") == length)).drop("own", "_n")


def sma(candles: DataFrame, length: int = 20, segments: int | None = None) -> DataFrame:
    return framed(candles, length, {"sma": F.avg("close")}, segments).where(finite("sma"))


def bollinger(candles: DataFrame, length: int = 20, width: float = 2.0, segments: int | None = None) -> DataFrame:
    """Upper, middle and lower band, from the population deviation, and the bandwidth (null for a middle of 0)."""
    rows = framed(candles, length, {"middle": F.avg("close"), "s": F.stddev_pop("close")}, segments)
    out = rows.select("symbol", "ts", (F.col("middle") + width * F.col("s")).alias("upper"), "middle", (F.col("middle") - width * F.col("s")).alias("lower"))
    return out.where(finite("upper", "middle", "lower")).withColumn("bandwidth", F.try_divide(F.col("upper") - F.col("lower"), F.col("middle")))


def obv(candles: DataFrame, segments: int | None = None) -> DataFrame:
    """Starts at the first volume; adds the volume when the close rises, takes it off when it falls. A scan of two levels: the sums of segments, and sums within."""
    s = series(candles, ["close", "volume"], segments)

    def signed(before: Column) -> Column:
        return F.when(before.isNull() | (F.col("close") > before), F.col("volume")).when(F.col("close") < before, -F.col("volume")).otherwise(F.lit(0.0))

    rows = s.rows.select(*s.key, "ts", "close", "volume", F.lag("close").over(s.within()).alias("before"))
    later = F.sum(F.when(F.col("before").isNotNull(), signed(F.col("before"))))
    summary = rows.groupBy(*s.key).agg(F.min_by("close", "ts").alias("first"), F.min_by("volume", "ts").alias("volume"), F.max_by("close", "ts").alias("last"), later.alias("later"))

    def hand(chain: list[Row]) -> list[tuple]:
        total, before, out = 0.0, None, []
        for r in chain:
            out.append((total, before))
            sign = 1 if before is None else (r["first"] > before) - (r["first"] < before)
            total += sign * (r["volume"] or 0.0) + (r["later"] or 0.0)
            before = r["last"]
        return out

    kinds = "total double, last double"
    rows = s.with_carried(rows, s.carried(summary, hand, kinds), kinds)
    # a segment's first candle follows the last one of the segment before
    rows = rows.select(*s.key, "ts", "total", signed(F.coalesce("before", "last")).alias("signed"))
    run = F.sum("signed").over(s.within().rowsBetween(Window.unboundedPreceding, 0))
    return rows.select("symbol", "ts", (F.coalesce("total", F.lit(0.0)) + run).alias("obv")).where(finite("obv"))


def recur(z: np.ndarray, r: float, start: float, block: int = 64) -> np.ndarray:
    """``y[k] = r * y[k - 1] + z[k]`` with ``y[-1] = start``, by blocks: within them as a matrix, between them by itself."""
    n = len(z)
    if n <= block:
        out = np.empty(n)
        for k in range(n):
            out[k] = start = r * start + z[k]
        return out
    rows = -(-n // block)
    padded = np.zeros(rows * block)
    padded[:n] = z
    at = np.arange(block)
    weights = np.where(at[:, None] >= at[None], r ** np.maximum(at[:, None] - at[None], 0), 0.0)
    own = np.einsum("kj,ij->ki", padded.reshape(rows, block), weights)
    ends = recur(own[:, -1], r**block, start, block)
    before = np.concatenate(([start], ends[:-1]))
    return (own + before[:, None] * r ** (at + 1)).ravel()[:n]


def seeded(x: np.ndarray, first: int, n: int, alpha: float, state: float) -> tuple[np.ndarray, float]:
    """An average that starts ``first`` rows into ``x`` (fewer than none: before it) as the mean of ``n`` values and then moves by ``alpha``; NaN before.

    The state is the sum of the values so far until there are ``n``, and the average from then on, so that it maps linearly.
    """
    out = np.full(len(x), np.nan)
    begin, end = (min(max(0, k), len(x)) for k in (first, first + n))
    if end > begin:
        sums = state + np.cumsum(x[begin:end])
        state = float(sums[-1])
        if first + n <= len(x):
            state /= n
            out[end - 1] = state
    if first + n < len(x):
        out[end:] = recur(alpha * x[end:], 1 - alpha, state)
        state = float(out[-1])
    return out, state


class Ema:
    """Seeded by the mean of the first ``n`` values."""

    size, halo = 1, 0

    def __init__(self, n: int):
        self.n = n

    def run(self, x: np.ndarray, volume: np.ndarray, k: int, before: np.ndarray, state: list[float]) -> tuple[list[np.ndarray], list[float]]:
        """Values over closes ``x`` and volumes, of which the first is the symbol's ``k``-th and follows the closes ``before``; and the state behind them."""
        out, end = seeded(x, -k, self.n, 2 / (self.n + 1), state[0])
        return [out], [end]


class Macd:
    """The fast average starts with the slow one: it is seeded by the last values of the slow one's seed."""

    size, halo = 3, 0

    def __init__(self, fast: int, slow: int, signal: int):
        self.fast, self.slow, self.signal = min(fast, slow), max(fast, slow), signal

    def run(self, x: np.ndarray, volume: np.ndarray, k: int, before: np.ndarray, state: list[float]) -> tuple[list[np.ndarray], list[float]]:
        fast, a = seeded(x, self.slow - self.fast - k, self.fast, 2 / (self.fast + 1), state[0])
        slow, b = seeded(x, -k, self.slow, 2 / (self.slow + 1), state[1])
        line = fast - slow
        there = np.nan_to_num(line)
        signal, c = seeded(there, self.slow - 1 - k, self.signal, 2 / (self.signal + 1), state[2])
        return [line, signal, line - signal], [a, b, c]


class Rsi:
    """Wilder's averages of gains and losses, seeded by the means of the first ``n`` changes."""

    size, halo = 2, 1

    def __init__(self, n: int):
        self.n = n

    def run(self, x: np.ndarray, volume: np.ndarray, k: int, before: np.ndarray, state: list[float]) -> tuple[list[np.ndarray], list[float]]:
        change = np.diff(x, prepend=before[-1:] if k else x[:1])
        gain, a = seeded(np.maximum(change, 0), 1 - k, self.n, 1 / self.n, state[0])
        loss, b = seeded(np.maximum(-change, 0), 1 - k, self.n, 1 / self.n, state[1])
        total = gain + loss
        return [np.where(total == 0, 0.0, 100 * gain / np.where(total == 0, 1.0, total))], [a, b]


class Obv:
    """The volume with the sign of the change, summed; the first one counts."""

    size, halo = 1, 1

    def run(self, x: np.ndarray, volume: np.ndarray, k: int, before: np.ndarray, state: list[float]) -> tuple[list[np.ndarray], list[float]]:
        sign = np.sign(np.diff(x, prepend=before[-1:] if k else x[:1] - 1))
        out = state[0] + np.cumsum(sign * volume)
        return [out], [float(out[-1])]


class Bands:
    """Mean, and bands about it, of each value and the ``n - 1`` before it. Carries no state but these."""

    size = 0

    def __init__(self, n: int, width: float | None = None):
        self.n, self.width, self.halo = n, width, n - 1

    def run(self, x: np.ndarray, volume: np.ndarray, k: int, before: np.ndarray, state: list[float]) -> tuple[list[np.ndarray], list[float]]:
        every = np.concatenate((before[len(before) - min(self.halo, len(before)) :], x))
        mean, spread = np.full((2, len(x)), np.nan)
        if len(every) >= self.n:
            frames = np.lib.stride_tricks.sliding_window_view(every, self.n)
            mean[len(x) - len(frames) :] = frames.mean(axis=1)
            if self.width is not None:
                spread[len(x) - len(frames) :] = self.width * frames.std(axis=1)
        if self.width is None:
            return [mean], []
        return [mean + spread, mean, mean - spread, np.divide(2 * spread, mean, out=np.full(len(x), np.nan), where=mean != 0)], []


Fold = Ema | Macd | Rsi | Obv | Bands


def runs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.Table]]:
    """Rows of each symbol and segment, of sorted batches; a segment is bounded by its range partition."""
    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        if not batch.num_rows:
            continue
        symbol, segment = batch.column(0), batch.column(1)
        codes = symbol.dictionary_encode().indices.to_numpy()
        cuts = np.flatnonzero((np.diff(codes) != 0) | (np.diff(segment.to_numpy()) != 0)) + 1
        ends = [0, *cuts.tolist(), batch.num_rows]
        for a, b in zip(ends[:-1], ends[1:], strict=True):
            key = (symbol[a].as_py(), segment[a].as_py())
            if key != now:
                if held:
                    yield now, pa.Table.from_batches(held)
                now, held = key, []
            held.append(batch.slice(a, b - a))
    if held:
        yield now, pa.Table.from_batches(held)


def opened(t: pa.Table) -> tuple[np.ndarray, np.ndarray, int, np.ndarray]:
    """Closes and volumes of a segment, how many candles come before it, and the closes of the halo."""
    own = t.column("own").to_numpy()
    close, volume = (t.column(c).to_numpy().astype(float) for c in ("close", "volume"))
    return close[own], np.nan_to_num(volume[own]), t.column("k")[0].as_py() or 0, close[~own]


def chained(folds: list[Fold], maps: list[list[float]]) -> Iterator[list[float]]:
    """The state before each segment of a series, of the segments' maps in order."""
    state = np.zeros(sum(f.size for f in folds))
    for m in maps:
        yield state.tolist()
        m = np.asarray(m)
        state = m[: len(state)] + state @ m[len(state) :].reshape(len(state), len(state))


def folded(candles: DataFrame, folds: list[Fold], names: list[str], segments: int | None = None) -> DataFrame:
    """Folds over each symbol's closes and volumes in order of time, all from one cut of the series; null where a fold has no value yet, and no row where none has.

    A segment maps the state before it linearly to the state behind it; these maps, one row a segment, are chained per symbol on the driver, for
    those symbols that go over several segments, and each segment runs from its state.
    """
    s = series(candles, ["close", "volume"] if "volume" in candles.columns else ["close"], segments)
    if "volume" not in candles.columns:
        s.rows = s.rows.withColumn("volume", F.lit(0.0))
    size, kind, ts = sum(f.size for f in folds), s.rows.schema["symbol"].dataType.simpleString(), s.rows.schema["ts"].dataType.simpleString()
    rows = s.with_halo(max(f.halo for f in folds)).select("symbol", "segment", "ts", "close", "volume", "own")
    starts = s.handed(s.spans, lambda chain: [(sum(r["n"] for r in chain[:i]),) for i in range(len(chain))], "k long")

    def dealt(extra: DataFrame | None, kinds: str, how: str) -> DataFrame:
        joined = s.with_carried(rows, extra, kinds) if how == "left" else rows.join(F.broadcast(extra), s.key)
        return joined.repartition("symbol", "segment").sortWithinPartitions("symbol", "segment", "ts")

    def ends(x: np.ndarray, volume: np.ndarray, k: int, before: np.ndarray, state: list[float]) -> list[float]:
        out, at = [], 0
        for f in folds:
            out += f.run(x, volume, k, before, state[at : at + f.size])[1]
            at += f.size
        return out

    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (symbol, segment), t in runs_of(batches):
            x = opened(t)
            zero = ends(*x, [0.0] * size)
            rest = [[e - z for e, z in zip(ends(*x, [float(i == j) for j in range(size)]), zero, strict=True)] for i in range(size)]
            columns = [pa.array([symbol], t.schema.field(0).type), pa.array([segment], pa.int32()), pa.array([[*zero, *(v for row in rest for v in row)]], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, ["symbol", "segment", "map"])

    entries, kinds = starts, "k long"
    if starts is not None and size:
        kinds = "k long, state array<double>"
        linear = dealt(starts, "k long", "inner").mapInArrow(maps, f"symbol {kind}, segment int, map array<double>")
        before = {(*s.of(r), r["segment"]): r["k"] for r in starts.collect()}
        entries = s.carried(linear, lambda chain: [(before[*s.of(r), r["segment"]], state) for r, state in zip(chain, chained(folds, [r["map"] for r in chain]), strict=True)], kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, t in runs_of(batches):
            x, volume, k, before = opened(t)
            state = (t.column("state")[0].as_py() if "state" in t.column_names else None) or [0.0] * size
            values, at = [], 0
            for f in folds:
                values += f.run(x, volume, k, before, state[at : at + f.size])[0]
                at += f.size
            there = np.isfinite(values)
            keep = np.flatnonzero(there.any(axis=0))
            kept = t.filter(t.column("own")).take(pa.array(keep)).combine_chunks()
            for part in pa.table([kept.column(0), kept.column(2), *(pa.array(v[keep], mask=~ok[keep]) for v, ok in zip(values, there, strict=True))], ["symbol", "ts", *names]).to_batches():
                yield part

    return dealt(entries, kinds, "left").mapInArrow(run, f"symbol {kind}, ts {ts}, " + ", ".join(f"{n} double" for n in names))


def ema(candles: DataFrame, length: int = 20, segments: int | None = None) -> DataFrame:
    return folded(candles, [Ema(length)], ["ema"], segments)


def macd(candles: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9, segments: int | None = None) -> DataFrame:
    return folded(candles, [Macd(fast, slow, signal)], ["macd", "signal", "histogram"], segments).where("signal IS NOT NULL")


def rsi(candles: DataFrame, length: int = 14, segments: int | None = None) -> DataFrame:
    return folded(candles, [Rsi(length)], ["rsi"], segments)


def indicator(candles: DataFrame, name: str, **given: float | None) -> DataFrame:
    """An indicator by name; parameters that are missing or 0 take their default."""
    p = {k: v for k, v in given.items() if v}
    return {"sma": sma, "ema": ema, "rsi": rsi, "macd": macd, "bb": bollinger, "obv": obv}[name](candles, **p)


def indicators(candles: DataFrame, wanted: dict[str, dict[str, float | None]], segments: int | None = None) -> DataFrame:
    """Several indicators by name, each with its parameters, as columns of one table from one cut of the series; null where one has no value yet."""
    kinds = {
        "sma": (lambda length=20: Bands(length), ["sma"]), "ema": (lambda length=20: Ema(length), ["ema"]), "rsi": (lambda length=14: Rsi(length), ["rsi"]),
        "macd": (lambda fast=12, slow=26, signal=9: Macd(fast, slow, signal), ["macd", "signal", "histogram"]),
        "bb": (lambda length=20, width=2.0: Bands(length, width), ["upper", "middle", "lower", "bandwidth"]), "obv": (lambda: Obv(), ["obv"]),
    }
    folds = [kinds[name][0](**{k: v for k, v in given.items() if v}) for name, given in wanted.items()]
    out = folded(candles, folds, [c for name in wanted for c in kinds[name][1]], segments)
    if "macd" in wanted:  # the line alone comes before its signal
        out = out.withColumn("macd", F.when(F.col("signal").isNotNull(), F.col("macd")))
    return out
