"""N-gram Jaccard join: a size-aware heavy-light join of documents on sets of word shingles.

A document's set holds its distinct windows of ``WIDTH`` lower-cased words (all its words as one, if there are fewer). Two
documents link when 100 * |A and B| >= PERCENT * |A or B|; the result is the connected components over links.

Documents with one and the same set form a class, so copies never pair up. Small sets enumerate their subsets of each
fixed size that a link can ask for; two small sets link through an equal subset. Large sets scan inverted lists of the
rarest elements of each set. The boundary is the size up to which enumeration costs less than scanning lists of the
average length found in the data; sets just below it are in the lists as well, for links across it.

Lists are read in tasks, each list in the order of sizes. Pairs within it pass the length and positional filters; each
member takes up to ``OFFERS`` of those before it, in the first place those that it meets in most lists. Of these pairs, those
whose parity bitmaps differ in more bits than linked sets have elements that differ are dropped, and the others are verified on
whole texts. Lists of which pairs were left out stay open: after the components of the links found so far are known, only
pairs across components count in them, and more of these pass in each further round, until no list is open. So no
link between different components is lost, and a group of near copies isn't expanded into all its pairs. Of a list that
is crowded within a batch, ``FEW`` members stay where the list is read; the others are read by batch, and the list is open.

Null and empty texts, and texts without words, have an empty set and link with nothing. Rows without an id get no
component. Repeated rows are copies. A table without rows gives an empty result; extra columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, partitions, small, stored
from .similarity import PERCENT, Hasher, asked_pairs, dealt, gathered, lower_words, offsets, packed, prefix_size, rarest_first, slices, summed_levels, together, unpacked, verify

WIDTH, BITS, MOST_SMALL, OFFERS, FEW, CROWD, HUGE = 5, 22, 24, 4, 16, 1024, 4096
#: Longs of a set's parity bitmap.
PARITY = 16
#: What it takes to verify a pair, in rows of a list.
VERIFY = 8
#: Postings that a task holds before it deals them out, and that a bucket holds, about.
HELD = 250_000
#: ``place`` stops at 65535, which makes the positional filter of larger places weaker; ``token`` holds 32 bits of those that don't tell the bucket.
POSTING = {"token": np.uint32, "key": np.int64, "n": np.int32, "place": np.uint16, "crowded": np.bool_}
#: Columns that hardly change from one posting of a bucket to the next.
CLOSE = {"key": np.int64, "n": np.int32, "place": np.uint16, "crowded": np.uint8}


def shingler(width: int = WIDTH):
    own = Hasher()
    return lambda text: np.unique(own.windows(lower_words(text), width))


def subset_sizes(n: int, percent: int = PERCENT) -> set[int]:
    """Overlaps that a link between a set of n elements and another asks for."""
    sizes = range(-(-percent * n // 100), 100 * n // percent + 1)
    return {-(-percent * (n + m) // (100 + percent)) for m in sizes if m > 0} if n else set()


def boundary(levels: np.ndarray, percent: int = PERCENT) -> int:
    """The largest size up to which enumerating subsets costs no more rows than listing the prefix and verifying what lists of the average length pair up."""
    counts = np.where(levels > 0, 2.0 ** ((levels.astype(float) - 1) / 4), 0)
    total = counts.sum()
    others = max(0.0, (counts**2).sum() / total - 1 - total / len(counts)) if total else 0.0
    best = 0
    for n in range(1, MOST_SMALL + 1):
        if sum(comb(n, c) for c in subset_sizes(n, percent) if c <= n) <= prefix_size(n, percent) * (1 + VERIFY * others):
            best = n
        else:
            break
    return best


def small_signatures(found: np.ndarray, percent: int = PERCENT) -> list[int]:
    """One hash for each subset of each size asked for."""
    n, out, mask = len(found), [], 2**64 - 1
    values = [int(x) for x in found]
    total = sum(values)
    for size in subset_sizes(n, percent):
        for missing in combinations(values, n - size) if size <= n else ():
            h = (total - sum(missing) + size * 0xD1342543DE82EF95) & mask
            h = ((h ^ (h >> 32)) * 0xDA942042E4DD58B5) & mask
            out.append(h ^ (h >> 29))
    return out


def parity(found: np.ndarray) -> np.ndarray:
    """A bitmap: whether the elements of a bit are odd in number. So two sets differ in at least as many elements as their bitmaps do in bits."""
    many = np.bincount((found % np.uint64(64 * PARITY)).astype(np.int64), minlength=64 * PARITY)
    return np.packbits(many % 2 == 1).view(np.int64)


def sets(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``key``, ``n``, a 128-bit digest ``k1``, ``k2`` and the ``parity`` of each row's set; and, in rows of their own, slices of the tasks' counts of shingles."""
    names, none = ["key", "n", "k1", "k2", "parity", "slice", "data"], pa.null()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, table = shingler(width), np.zeros(1 << BITS, np.uint32)
        for batch in batches:
            n, digests, bitmaps = [], [], []
            for text in batch.column(1).to_pylist():
                found = own(text)
                cells, many = np.unique(found >> np.uint64(64 - BITS), return_counts=True)
                table[cells] += many.astype(np.uint32)
                n.append(len(found))
                digests.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                bitmaps.append(parity(found))
            k = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            bits = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * PARITY, pa.int32()), pa.array(np.array(bitmaps, np.int64).ravel()))
            nothing = [pa.nulls(len(n), none).cast(pa.int32()), pa.nulls(len(n), none).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(k[:, 0]), pa.array(k[:, 1]), bits, *nothing], names)
        for at, data in slices(table):
            yield pa.RecordBatch.from_arrays([*[pa.nulls(1, none).cast(pa.int64())] * 4, pa.nulls(1, pa.list_(pa.int64())), pa.array([at], pa.int32()), pa.array([data], pa.binary())], names)

    return docs.mapInArrow(read, "key long, n long, k1 long, k2 long, parity array<long>, slice int, data binary")


def squeezed(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The binaries of ``dealt`` with their other columns ``packed`` behind the hashes, and the number of rows before both."""
    out = []
    for data in batch.column(2).to_pylist():
        x = together([data], POSTING)
        out.append(len(x["token"]).to_bytes(4, "little") + x["token"].tobytes() + packed([x[c].astype(kind) for c, kind in CLOSE.items()]))
    return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], batch.schema.names)


def restored(data: list[bytes]) -> dict[str, np.ndarray]:
    """Columns of the binaries of ``squeezed``."""
    found: dict[str, list[np.ndarray]] = {c: [] for c in POSTING}
    for x in data:
        rows = int.from_bytes(x[:4], "little")
        found["token"].append(np.frombuffer(x, np.uint32, rows, 4))
        for c, column in zip(CLOSE, unpacked(x[4 + 4 * rows :], rows, list(CLOSE.values())), strict=True):
            found[c].append(column)
    return {c: np.concatenate(v).astype(POSTING[c], copy=False) for c, v in found.items()}


def postings(docs: DataFrame, levels: np.ndarray, edge: int, buckets: int, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """What each set puts into the lists, by ``bucket``."""
    sent = docs.sparkSession.sparkContext.broadcast(levels.tobytes())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, known = shingler(width), np.frombuffer(sent.value, np.uint8)
        tokens: list[np.ndarray] = []
        keys: list[int] = []
        sizes: list[int] = []
        places: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            lengths = [len(t) for t in tokens]
            token = np.concatenate(tokens)
            x = {"token": token.astype(np.uint32), "key": np.repeat(np.array(keys, np.int64), lengths), "n": np.repeat(np.array(sizes, np.int32), lengths), "place": np.concatenate(places)}
            _, which, members = np.unique(token, return_inverse=True, return_counts=True)
            x["crowded"] = members[which] > CROWD
            if x["crowded"].any():  # the others are read in a bucket that the batch has for the list
                by = np.argsort(which, kind="stable")
                start = np.repeat(np.cumsum(members) - members, members)
                rest = np.zeros(len(token), bool)
                rest[by[np.arange(len(by)) - start >= FEW]] = True
                token = np.where(x["crowded"] & rest, (token ^ np.uint64(keys[0] & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0x9E3779B97F4A7C15), token)
            for held in (tokens, keys, sizes, places):
                held.clear()
            return squeezed(dealt(0, token, x, buckets))

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = own(text)
                n = len(found)
                if key is None or not n:
                    continue
                if n <= edge:
                    mine = np.array(small_signatures(found, percent), np.uint64)
                    tokens.append(mine)
                    places.append(np.zeros(len(mine), np.uint16))
                    keys.append(key)
                    sizes.append(n)
                if n > edge or 100 * n >= percent * (edge + 1):
                    mine = rarest_first(found, known, BITS)[: prefix_size(n, percent)]
                    tokens.append(mine)
                    places.append(np.minimum(np.arange(len(mine)), 65535).astype(np.uint16))
                    keys.append(key)
                    sizes.append(n)
                if len(tokens) >= 2048 or sum(map(len, tokens[-1:])) > HELD:
                    yield flush()
        if tokens:
            yield flush()

    return docs.mapInArrow(read, "kind int, bucket int, data binary")


def offers(x: dict[str, np.ndarray], label: np.ndarray, room: int, percent: int, huge: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of keys across labels in common lists (two arrays), and the rows of lists of which pairs were left out."""
    key, item = np.unique(x["key"], return_inverse=True)
    token, which, members = np.unique(x["token"], return_inverse=True, return_counts=True)
    opened = np.zeros(len(token), bool)
    opened[which[x["crowded"]]] = True
    listed = which.astype(np.int64)
    if huge is not None and (members > huge).any():
        opened |= members > huge
        long = opened[which] & (members[which] > huge)
        listed[long] += len(token) * (1 + ((item[long].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % -(-members[which[long]] // huge))
    order = np.lexsort((x["n"], listed))
    listed, n, place, who, label = listed[order], x["n"][order].astype(np.int64), x["place"][order].astype(np.int64), item[order], label[order]
    if huge is None:  # all but the members of a list's most frequent label ask the whole list
        by = np.lexsort((label, listed))
        new = np.concatenate(([True], (listed[by][1:] != listed[by][:-1]) | (label[by][1:] != label[by][:-1]))) if len(by) else np.zeros(0, bool)
        run = np.cumsum(new) - 1
        size = np.bincount(run)
        first = np.flatnonzero(new)
        best = np.lexsort((-size, listed[by][first]))
        top = np.zeros(len(first), bool)
        top[best[np.concatenate(([True], listed[by][first][best][1:] != listed[by][first][best][:-1]))]] = True
        asks = np.zeros(len(by), bool)
        asks[by] = ~top[run]
    found: list[tuple[np.ndarray, ...]] = []
    held = 0

    def best_of() -> tuple[np.ndarray, ...]:
        later, earlier, far, times, lists = (np.concatenate(c) for c in zip(*found, strict=True))
        o = np.lexsort((earlier, later))
        later, earlier, far, times, lists = later[o], earlier[o], far[o], times[o], lists[o]
        new = np.flatnonzero(np.concatenate(([True], (later[1:] != later[:-1]) | (earlier[1:] != earlier[:-1]))))
        times = np.add.reduceat(times, new)
        o2 = np.lexsort((earlier[new], far[new], -times, later[new]))
        group = later[new][o2]
        first = np.maximum.accumulate(np.where(np.concatenate(([True], group[1:] != group[:-1])), np.arange(len(group)), 0))
        keep = np.zeros(len(new), bool)
        keep[o2] = np.arange(len(group)) - first < room
        opened[lists[new][~keep]] = True  # one list of a pair is enough to find it again
        return later[new][keep], earlier[new][keep], far[new][keep], times[keep], lists[new][keep]

    for i, j in asked_pairs(listed, asks) if huge is None else offsets(listed, n, percent):
        ok = (label[i] != label[j]) & (who[i] != who[j])
        i, j = i[ok], j[ok]
        needed = -(-percent * (n[i] + n[j]) // (100 + percent))
        ok = (np.minimum(n[i] - place[i], n[j] - place[j]) >= needed) & (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j]))
        i, j = i[ok], j[ok]
        if len(i):
            found.append((np.maximum(who[i], who[j]), np.minimum(who[i], who[j]), np.abs(n[i] - n[j]), np.ones(len(i), np.int64), listed[i] % len(token)))
            held += len(i)
            if held > 500_000:
                found[:] = [best_of()]
                held = len(found[0][0])
    later, earlier = best_of()[:2] if found else (np.zeros(0, np.int64),) * 2
    return key[earlier], key[later], np.flatnonzero(opened[which])


OFFERED = "a long, b long, token long, n int, place int"


def batch_of(x: dict[str, np.ndarray], a: np.ndarray, b: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
    """Pairs (``a``, ``b``), and postings of open lists (``a``: the key; ``token``, ``n``, ``place``)."""
    none = lambda n, kind: pa.nulls(n).cast(kind)
    columns = [
        pa.concat_arrays([pa.array(a, pa.int64()), pa.array(x["key"][rows], pa.int64())]), pa.concat_arrays([pa.array(b, pa.int64()), none(len(rows), pa.int64())]),
        *(pa.concat_arrays([none(len(a), kind), pa.array(x[c][rows].astype(t))]) for c, t, kind in (("token", np.int64, pa.int64()), ("n", np.int32, pa.int32()), ("place", np.int32, pa.int32()))),
    ]
    return pa.RecordBatch.from_arrays(columns, ["a", "b", "token", "n", "place"])


def first_offers(posted: DataFrame, percent: int) -> DataFrame:
    room, huge = OFFERS, HUGE

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, data in gathered(batches):
            x = restored(data)
            yield batch_of(x, *offers(x, x["key"], room, percent, huge))

    return posted.repartition("bucket").sortWithinPartitions("bucket", "kind").mapInArrow(read, OFFERED)


def more_offers(held: DataFrame, room: int, percent: int) -> DataFrame:
    """``held``: ``token``, ``key``, ``n``, ``place``, ``component`` of open lists."""
    most = HELD

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[dict[str, np.ndarray]] = []

        def settle(x: dict[str, np.ndarray]) -> pa.RecordBatch:
            return batch_of(x, *offers(x | {"crowded": np.zeros(len(x["key"]), bool)}, x["component"], room, percent, None))

        for batch in batches:
            parts.append({c: batch.column(k).to_numpy() for k, c in enumerate(("token", "key", "n", "place", "component"))})
            if sum(len(p["key"]) for p in parts) > most:
                x = {c: np.concatenate([p[c] for p in parts]) for c in parts[0]}
                last = int(np.searchsorted(x["token"], x["token"][-1]))  # the list that may go on
                if last:
                    yield settle({c: v[:last] for c, v in x.items()})
                parts = [{c: v[last:] for c, v in x.items()}]
        if parts:
            yield settle({c: np.concatenate([p[c] for p in parts]) for c in parts[0]})

    rows = held.select("token", "key", "n", "place", "component").repartition("token").sortWithinPartitions("token")
    return rows.mapInArrow(read, OFFERED)


def near(pairs: DataFrame, bitmaps: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs ``a``, ``b`` that may link, by the ``n`` and ``parity`` of ``key`` in ``bitmaps``; any row of a key that is repeated will do."""
    asked = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    held = bitmaps.join(small(asked), "key", "left_semi")
    side = lambda c: held.select(F.col("key").alias(c), F.col("n").alias(f"{c}_n"), F.col("parity").alias(f"{c}_parity"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    far = F.aggregate(F.zip_with("a_parity", "b_parity", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda bits, x: bits + x)
    elements = F.col("a_n") + F.col("b_n")
    return both.where(far <= elements - 2 * F.ceil(percent * elements / (100 + percent))).select("a", "b").distinct()


def link(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """``key``, ``n_shingles`` and ``component_id`` (the smallest key reachable over links) of every row."""
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{text}`").alias("text"))
    both = stored(sets(rows, width), "sets")
    own = both.where("slice is null").select("key", "n", "k1", "k2")
    bitmaps = both.where("slice is null").select("key", "n", "parity")
    levels = summed_levels(both.where("slice is not null").select("slice", "data"), BITS)
    reps = own.where("n > 0 and key is not null").groupBy("k1", "k2").agg(F.min("key").alias("class"))
    classes = stored(own.join(reps, ["k1", "k2"], "left").select("key", "n", "class"), "classes")
    # what stands for a class is listed; a row that repeats an id is left out only if all rows of this id are copies
    copies = stored(classes.where("class is not null").groupBy("key").agg(F.bool_and(F.col("class") != F.col("key")).alias("copy")).where("copy").select("key"), "copies")
    total = float(np.where(levels > 0, 2.0 ** ((levels - 1.0) / 4), 0).sum())
    buckets = max(2 * partitions(docs), int(total / 5 / HELD) + 1)
    single = rows.where("key is not null").join(small(copies), "key", "left_anti")
    found = stored(first_offers(postings(single, levels, boundary(levels, percent), buckets, width, percent), percent), "offers")
    edges, room = None, OFFERS
    minus = F.lit(-1)
    while True:
        offered = stored(found.where("b is not null").select("a", "b").distinct(), "offered")
        pairs = near(offered, bitmaps, percent).select("a", minus.alias("a_line"), "b", minus.alias("b_line"))
        links = stored(verify(pairs, rows, lambda: shingler(width), percent, whole=True).select("a", "b"), "links")
        edges = links if edges is None else edges.unionByName(links)
        joined = components(edges, "a", "b")
        left = found.where("b is null").select(F.col("a").alias("key"), "token", "n", "place")
        if left.isEmpty():
            break
        labels = joined.select(F.col("node").alias("key"), "component")
        held = stored(left.distinct().join(small(labels), "key", "left").withColumn("component", F.coalesce("component", "key")), "held")
        apart = held.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("token")
        room *= 32
        found = stored(more_offers(held.join(apart, "token", "left_semi"), room, percent), "offers")
    final = joined.select(F.col("node").alias("class"), "component")
    return classes.join(small(final), "class", "left").select(
        F.col("key").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component", "class", "key").alias("component_id")
    )


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each component: that of the smallest key (all rows of that key, if it is repeated)."""
    gone = stored(link(docs, key, text).where(F.col(key) != F.col("component_id")).select(key).distinct(), "gone")
    return docs.join(small(gone), key, "left_anti").select(docs.columns)
