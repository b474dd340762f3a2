"""Parts of the exact set-similarity joins: hashed sets, frequency levels, inverted lists and verification.

Sets are of 64-bit hashes. Two sets are similar when 100 * |A and B| >= PERCENT * |A or B|. If their elements are put in
one order, similar sets share one of the first ``size - ceil(PERCENT% of size) + 1`` elements of each (the prefix). Any
order gives exact results; a rare-first order gives short lists. Frequencies are counted over all rows in a table of fixed
size, so elements share counts with those that fall into the same bucket, which can only move an element in the order.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import let, small, stored

PERCENT = 80
SLICE_BITS = 16
#: Members of one owner that are verified together.
MEMBERS = 256
#: Words hashed at once, which bounds memory for very long texts.
BLOCK = 100_000


class Hasher:
    """64-bit hashes of spans of a byte string, by one running polynomial for all spans."""

    def __init__(self, seed: int = 7):
        draw = np.random.default_rng(seed)
        self.values = draw.integers(1, 2**63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
        self.base = 0x9E3779B97F4A7C15
        self.up = self.down = np.ones(1, np.uint64)

    def powers(self, n: int) -> None:
        if len(self.up) < n:
            step = np.full(2 * n, self.base, np.uint64)
            step[0] = 1
            self.up = np.multiply.accumulate(step)
            step[1:] = pow(self.base, -1, 2**64)
            self.down = np.multiply.accumulate(step)

    def spans(self, data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        self.powers(len(data) + 1)
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.values[np.frombuffer(data, np.uint8)] * self.up[: len(data)], out=total[1:])
        h = (total[ends] - total[starts]) * self.down[starts]
        h ^= h >> np.uint64(30)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(27)
        h *= np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))

    def windows(self, words: list[bytes], width: int) -> np.ndarray:
        """A hash for each window of ``width`` words (one for all words if there are fewer), in order."""
        if not words:
            return np.zeros(0, np.uint64)
        width, out = min(width, len(words)), []
        for at in range(0, len(words) - width + 1, BLOCK):
            data = b" ".join(words[at : at + BLOCK + width - 1])
            gaps = np.flatnonzero(np.frombuffer(data, np.uint8) == 32)
            starts, ends = np.concatenate(([0], gaps + 1)), np.concatenate((gaps, [len(data)]))
            out.append(self.spans(data, starts[: len(starts) - width + 1], ends[width - 1 :]))
        return np.concatenate(out)


def lower_words(text: str | None) -> list[bytes]:
    """Words between ASCII white space with A-Z in lower case."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def prefix_size(n: int, percent: int = PERCENT) -> int:
    return n - -(-percent * n // 100) + 1


def overlap(a: np.ndarray | frozenset, b: np.ndarray | frozenset) -> int:
    return len(a & b) if isinstance(a, frozenset) else len(np.intersect1d(a, b, assume_unique=True))


def similar(shared: int, n: int, m: int, percent: int = PERCENT) -> bool:
    return 100 * shared >= percent * (n + m - shared)


def slices(table: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """A task's counts as compressed slices; empty ones are left out."""
    width = 1 << SLICE_BITS
    for k in range(0, len(table), width):
        part = table[k : k + width]
        if part.any():
            yield k >> SLICE_BITS, zlib.compress(np.minimum(part, 65535).astype("<u2").tobytes(), 1)


def summed_levels(parts: DataFrame, bits: int) -> np.ndarray:
    """The levels of all tasks' slices together; the driver gets ``2 ** bits`` bytes."""
    width = 1 << SLICE_BITS

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = np.frombuffer(zlib.decompress(data), "<u2")
                sums[k] = sums[k] + part if k in sums else part.astype(np.uint64)
        for k, total in sums.items():
            level = np.where(total > 0, 1 + np.rint(4 * np.log2(np.maximum(total, 1))), 0).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([zlib.compress(level.tobytes(), 1)], pa.binary())], ["slice", "data"])

    summed = parts.repartition(1 << max(0, bits - SLICE_BITS), "slice").mapInArrow(add, "slice int, data binary")
    out = np.zeros(1 << bits, np.uint8)
    for row in summed.collect():
        out[row["slice"] * width : (row["slice"] + 1) * width] = np.frombuffer(zlib.decompress(row["data"]), np.uint8)
    return out


def rarest_first(found: np.ndarray, levels: np.ndarray, bits: int) -> np.ndarray:
    """A set's elements in the common order: by level, then by hash."""
    level = levels[found >> np.uint64(64 - bits)].astype(np.uint64)
    return found[np.argsort((level << np.uint64(56)) | (found >> np.uint64(8)), kind="stable")]


def dealt(kind: int, by: np.ndarray, columns: dict[str, np.ndarray], buckets: int) -> pa.RecordBatch:
    """Rows as one binary for each bucket that ``by`` (64-bit hashes) deals them to: ``kind``, ``bucket``, ``data``."""
    bucket = ((by >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    order = np.argsort(bucket, kind="stable")
    found, starts = np.unique(bucket[order], return_index=True)
    ends, columns = [*starts[1:], len(order)][: len(starts)], [v[order] for v in columns.values()]
    data = [b"".join([c[a:b].tobytes() for c in columns]) for a, b in zip(starts, ends, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(found), kind, np.int32)), pa.array(found.astype(np.int32)), pa.array(data, pa.binary())], ["kind", "bucket", "data"])


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes]]]:
    """The binaries of each bucket and kind, of rows ``kind``, ``bucket``, ``data`` in the order of these."""
    now, held = None, []
    for batch in batches:
        for kind, bucket, data in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if (kind, bucket) != now:
                if held:
                    yield now[0], held
                now, held = (kind, bucket), []
            held.append(data)
    if held:
        yield now[0], held


def together(data: list[bytes], kinds: dict[str, type]) -> dict[str, np.ndarray]:
    """Columns of the binaries of ``dealt``."""
    width, parts = sum(np.dtype(t).itemsize for t in kinds.values()), {c: [] for c in kinds}
    for x in data:
        n, at = len(x) // width, 0
        for c, t in kinds.items():
            parts[c].append(np.frombuffer(x, t, n, at))
            at += n * np.dtype(t).itemsize
    return {c: np.concatenate(v) for c, v in parts.items()}


def packed(columns: list[np.ndarray]) -> bytes:
    """Integer columns of one length in fewer bytes: steps from value to value, first bytes of all, then second ones, and so on, compressed."""
    steps = (np.diff(c, prepend=c.dtype.type(0)) for c in columns)
    return zlib.compress(b"".join([d.view(np.uint8).reshape(-1, d.itemsize).T.tobytes() for d in steps]), 1, -15)


def unpacked(data: bytes, rows: int, kinds: list[type]) -> list[np.ndarray]:
    """The columns that ``packed`` was given."""
    planes, at, out = np.frombuffer(zlib.decompress(data, -15), np.uint8), 0, []
    for kind in kinds:
        width = np.dtype(kind).itemsize
        steps = np.ascontiguousarray(planes[at : at + width * rows].reshape(width, rows).T).view(kind).ravel()
        out.append(np.cumsum(steps, dtype=kind))
        at += width * rows
    return out


#: Flags of a posting: its line asks for earlier ones; it stands for others that were left out of the list.
ASKS, CROWDED = 1, 2


def offsets(token: np.ndarray, n: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of each list, of rows in the order of ``token`` and ``n``, as long as the sizes allow."""
    start = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
    length = np.diff(np.concatenate((start, [len(token)])))
    last = np.repeat(start + length - 1, length)
    i, d = np.flatnonzero(last > np.arange(len(token))), 1
    while len(i):
        i = i[100 * n[i] >= percent * n[i + d]]
        yield i, i + d
        d += 1
        i = i[last[i] >= i + d]


def asked_pairs(token: np.ndarray, asks: np.ndarray, most: int = 300_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of each row that asks with all rows of its list, of rows in the order of ``token``."""
    start = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
    length = np.diff(np.concatenate((start, [len(token)])))
    at = np.repeat(np.arange(len(start)), length)
    rows = np.flatnonzero(asks)
    done = 0
    while done < len(rows):
        many = length[at[rows[done:]]]
        take = max(1, int(np.searchsorted(np.cumsum(many), most)))
        mine = rows[done : done + take]
        many = many[:take]
        yield np.repeat(mine, many), np.repeat(start[at[mine]] - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(many.sum())
        done += take


def closest(x: dict[str, np.ndarray], room: tuple[int, int, int], percent: int, huge: int | None, every: bool = False) -> dict[str, np.ndarray]:
    """Of postings of sets that all differ, for each item (``key``, ``line``) that asks, the earlier items of its lists that pass all filters and whose bitmaps are closest: as many as
    ``room`` says first; as it says last for sets larger than its second number, and where even the closest bitmap is far.

    Pairs as ``a``, ``a_line``, ``b``, ``b_line``, with differing bits (``far``) and room of b (``most``); ``a_line`` is -1 for items that have to ask again: they had more,
    or stood in a list that was cut (``huge``; None: lists of any length are read by those that ask) or crowded.
    """
    rows = len(x["token"])
    by = np.lexsort((x["line"], x["key"]))
    key, line = x["key"][by], x["line"][by]
    new = np.ones(rows, bool)
    new[1:] = (key[1:] != key[:-1]) | (line[1:] != line[:-1])
    key, line = key[new], line[new]
    item = np.empty(rows, np.int64)
    item[by] = np.cumsum(new) - 1
    asks, token = (x["flags"] & ASKS) > 0, x["token"].astype(np.uint64)
    over = np.full(len(key), every)
    _, which, members = np.unique(token, return_inverse=True, return_counts=True)
    if huge is not None and (members > huge).any():
        long = members[which] > huge
        over[item[long]] = True
        parts = -(-members[which[long]] // huge)
        token[long] += (((item[long].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % parts.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD1342543DE82EF95)
    crowded = np.zeros(len(members), bool)
    crowded[which[(x["flags"] & CROWDED) > 0]] = True
    over[item[crowded[which]]] = True
    order = np.lexsort((x["n"], token))
    token, n, place, bits, item, asks = token[order], x["n"][order].astype(np.int64), x["place"][order].astype(np.int64), x["bits"][order], item[order], asks[order]
    asker, most = np.zeros(len(key), bool), np.full(len(key), room[0])
    asker[item[asks]] = True
    most[item[n > room[1]]] = room[2]
    found: list[tuple[np.ndarray, ...]] = []
    size = 0

    def best() -> tuple[np.ndarray, ...]:
        later, earlier, far, spare = (np.concatenate(c) for c in zip(*found, strict=True))
        o = np.lexsort((earlier, far, later))
        later, earlier, far, spare = later[o], earlier[o], far[o], spare[o]
        once = np.ones(len(o), bool)
        once[1:] = (later[1:] != later[:-1]) | (earlier[1:] != earlier[:-1])
        later, earlier, far, spare = later[once], earlier[once], far[once], spare[once]
        first = np.maximum.accumulate(np.where(np.concatenate(([True], later[1:] != later[:-1])), np.arange(len(later)), 0)) if len(later) else np.zeros(0, int)
        most[later[first]] = np.where(2 * far > spare, room[2], most[later])[first]
        keep = np.arange(len(later)) - first < most[later]
        over[later[~keep]] = True
        return later[keep], earlier[keep], far[keep], spare[keep]

    for i, j in asked_pairs(token, asks) if huge is None else offsets(token, n, percent):
        both = n[i] + n[j]
        needed = -(-percent * both // (100 + percent))
        ok = (np.minimum(n[i] - place[i], n[j] - place[j]) >= needed) & (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j]))
        i, j, spare = i[ok], j[ok], (both - 2 * needed)[ok]
        far = np.bitwise_count(bits[i] ^ bits[j]).sum(axis=1, dtype=np.int32)
        earlier, later = np.minimum(item[i], item[j]), np.maximum(item[i], item[j])
        ok = (far <= spare) & (spare > 0) & (earlier != later) & asker[later]  # sets listed are unlike, so a pair that leaves no room fails
        if ok.any():
            found.append((later[ok], earlier[ok], far[ok], spare[ok]))
            size += int(ok.sum())
            if size > 500_000:
                found[:] = [best()]
                size = len(found[0][0])
    later, earlier, far = best()[:3] if found else (np.zeros(0, np.int64),) * 3
    again = np.flatnonzero(over & asker)
    return {
        "a": np.concatenate((key[earlier], np.zeros(len(again), np.int64))), "a_line": np.concatenate((line[earlier], np.full(len(again), -1, np.int32))).astype(np.int32),
        "b": np.concatenate((key[later], key[again])), "b_line": np.concatenate((line[later], line[again])).astype(np.int32),
        "far": np.concatenate((far, np.zeros(len(again)))).astype(np.int16), "most": most[np.concatenate((later, again))].astype(np.int32),
    }


def verify(pairs: DataFrame, docs: DataFrame, elements: Callable[[], Callable[[str | None], np.ndarray | frozenset]], percent: int = PERCENT, whole: bool = False) -> DataFrame:
    """The pairs whose sets are similar: ``a``, ``a_line``, ``b``, ``b_line`` (document and line; line -1: the whole text).

    Documents send only what the pairs ask for, lines once; if all pairs are of ``whole`` texts, a text goes to those that ask for it from where it is read. What belongs to one ``a`` is verified in groups of ``MEMBERS``, each
    of which gets a copy of a's text, so an owner of many pairs is spread over tasks.
    """
    pairs = stored(pairs, "pairs")
    owners = pairs.groupBy("a", "a_line").agg(F.count("*").alias("members"))
    crowded = owners.where(F.col("members") > MEMBERS)
    salted = pairs.join(small(crowded), ["a", "a_line"], "left").select(
        "a", "a_line", "b", "b_line", F.pmod(F.xxhash64("b", "b_line"), F.ceil(F.coalesce("members", F.lit(1)) / MEMBERS)).alias("salt")
    )
    part = lambda doc, line, own: (F.col(doc).alias("doc"), F.col(line).alias("at"), "a", "a_line", "salt", F.lit(own).alias("own"), F.col(doc).alias("b"), F.col(line).alias("b_line"))
    asks = salted.select(*part("b", "b_line", 1)).unionByName(salted.select("a", "a_line", "salt").distinct().select(*part("a", "a_line", 0)))
    texts = docs.select(F.col("key").alias("doc"), F.coalesce("text", F.lit("")).alias("text"))
    if whole:
        # texts that nothing asks for go before the others are joined, which deals them out where the asks are too many to broadcast
        asks = stored(asks.select("doc", "a", "salt", "own"), "asked")
        rows = texts.join(small(asks.select("doc").distinct()), "doc", "left_semi").join(small(asks), "doc")
        rows = rows.withColumnRenamed("doc", "b").withColumns({"a_line": F.lit(-1), "b_line": F.lit(-1)})
    else:
        # each text gives what is asked of it once; it goes on to those that ask from there
        asked = stored(asks.select("doc", "at").distinct().groupBy("doc").agg(F.collect_list("at").alias("ats")), "asked")
        given = texts.join(small(asked), "doc").select("doc", F.explode(let(
            F.when(F.exists("ats", lambda i: i >= 0), F.split("text", "\n")),
            lambda lines: F.transform("ats", lambda i: F.struct(i.alias("at"), F.when(i < 0, F.col("text")).otherwise(F.get(lines, i)).alias("text"))),
        )).alias("r"))
        rows = asks.join(given.select("doc", "r.at", "r.text"), ["doc", "at"]).drop("doc", "at")
    rows = rows.select("a", "a_line", "salt", "own", "b", "b_line", "text").repartition("a", "a_line", "salt").sortWithinPartitions("a", "a_line", "salt", "own", "b", "b_line")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, now, mine = elements(), None, []
        for batch in batches:
            found: list[tuple] = []
            a, al, s, o, b, bl, t = (batch.column(i).to_pylist() for i in range(7))
            for i in range(len(a)):
                if now != (a[i], al[i], s[i]):
                    now, mine = (a[i], al[i], s[i]), []
                other = own(t[i])
                if o[i] == 0:
                    mine.append(other)  # more than one where rows repeat an id
                elif any(similar(overlap(m, other), len(m), len(other), percent) for m in mine):
                    found.append((a[i], al[i], b[i], bl[i]))
            if found:
                columns = list(zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(columns[k], (pa.int64(), pa.int32())[k % 2]) for k in range(4)], ["a", "a_line", "b", "b_line"])

    return rows.mapInArrow(read, "a long, a_line int, b long, b_line int")
