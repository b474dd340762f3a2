"""Benchmark decontamination: a prefix-filtered join of documents with item-sized windows, each verified on its words.

A window is ``WIDTH`` consecutive words of an item, or all of its words if it has fewer. Its shingles are runs of
``SHINGLE`` words (all of a window of fewer). A document holds a window only if it holds all of its shingles, so the rarest
of them is the necessary prefix; rarity is counted over all documents, for the shingles that items have. Where a document
has that shingle, its place in the window tells where the window would start (position); the window must lie within the
document (length), must have the same hash, and is verified on the words themselves.

Texts are read twice: for the counts and for the search. A document is handled where it is read, so no row is shuffled
and a passage that many documents share is no hot key. The index of windows is broadcast in blocks of at most ``INDEX_BYTES``
by a count of its size; with more than one block, documents go through them one after another.

Null and empty texts have no words. A benchmark row without words has no window; rows that share an id are one item; words
found through rows without an id are hit, but these rows aren't listed. Repeated documents give repeated results. Ties in rarity
are broken by the hash. An empty benchmark hits nothing, an empty table gives an empty result; extra columns play no part.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored
from .similarity import Hasher
from .tokens import NOT_ALNUM, Grams, parts, row_of, runs

WIDTH, SHINGLE = 10, 3
#: Bytes of windows that are broadcast at once.
INDEX_BYTES = 16 << 20
SPACES = bytes.maketrans(bytes(np.flatnonzero(NOT_ALNUM).astype(np.uint8)), b" " * int(NOT_ALNUM.sum()))


def words(text: bytes) -> list[bytes]:
    """Words of lower-cased text."""
    return text.translate(SPACES).split()


def windows(items: DataFrame, key: str = "item_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """Every distinct ``window`` (its words, joined by spaces) of each ``item`` (its id as text)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.binary()))], ["item", "window"])
        for batch in batches:
            held: list[tuple] = []
            for item, raw in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                w = words((raw or b"").lower())
                for g in dict.fromkeys(b" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1)) if w):
                    held.append((item, g))
                    if len(held) == 10_000:
                        yield made(held)
                        held = []
            yield made(held)

    return items.select(F.col(f"`{key}`").cast("string").alias("item"), F.col(f"`{text}`").alias("text")).mapInArrow(cut, "item string, window binary")


class Index:
    """Windows with their items, for the search in one part of a text after another."""

    def __init__(self, rows: list[tuple[str | None, bytes]], shingle: int = SHINGLE):
        self.shingle, found = shingle, defaultdict(set)
        for item, window in rows:
            found[window].add(item)
        self.windows = sorted(found)
        self.items = [sorted(x for x in found[w] if x is not None) for w in self.windows]
        self.width = np.array([w.count(b" ") + 1 for w in self.windows], np.int64)
        own = Hasher()
        hashed = [own.spans(w, *runs(~NOT_ALNUM[np.frombuffer(w, np.uint8)])) for w in self.windows]
        self.whole = np.array([self.grams(h, [len(h)])[len(h)][0] for h in hashed], np.uint64)
        self.shingles = [self.grams(h, [min(shingle, len(h))])[min(shingle, len(h))] for h in hashed]
        self.all = np.unique(np.concatenate([np.zeros(0, np.uint64), *self.shingles]))

    @staticmethod
    def grams(h: np.ndarray, sizes: list[int]) -> dict[int, np.ndarray]:
        g, out = Grams(h), {}
        for k in range(1, max(sizes, default=0) + 1):
            x = g.next()
            if k in sizes:
                out[k] = x
        return out

    def sizes(self) -> list[int]:
        """How many words the shingles have."""
        return sorted({int(min(self.shingle, w)) for w in self.width})

    def choose(self, counts: dict[int, int]) -> None:
        """Keeps each window's rarest shingle, with its place in the window, as the prefix."""
        rare, place = [], []
        for x in self.shingles:
            k = min(range(len(x)), key=lambda i: (counts.get(int(x[i]), 0), int(x[i]), i))
            rare.append(x[k])
            place.append(k)
        prefix, place = np.array(rare, np.uint64), np.array(place, np.int64)
        self.order = np.argsort(prefix, kind="stable")
        self.prefix, self.first, self.many = np.unique(prefix[self.order], return_index=True, return_counts=True)
        self.place = place
        self.shingles = []


def met(h: np.ndarray, known: np.ndarray, filter_bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places whose hash is among the sorted known ones, and which of them it is."""
    at = np.flatnonzero(filter_bits[(h >> np.uint64(44)).astype(np.int64)])
    k = np.searchsorted(known, h[at])
    ok = known[np.minimum(k, len(known) - 1)] == h[at]
    return at[ok], k[ok]


def filter_of(known: np.ndarray) -> np.ndarray:
    out = np.zeros(1 << 20, bool)
    out[(known >> np.uint64(44)).astype(np.int64)] = True
    return out


def cut_words(column: pa.Array, own: Hasher, keep: int) -> Iterator[tuple]:
    """Words of each part: hashes, rows in the batch, and the bytes with the words' starts and ends; ``words before`` of rows that go on, whose last ``keep`` words come again."""
    tail, before = b"", 0
    for part in parts(column, NOT_ALNUM):
        if part.goes_on:
            part.data = tail + b" " + part.data
        else:
            before = 0
        starts, ends = runs(~NOT_ALNUM[np.frombuffer(part.data, np.uint8)])
        at = row_of(part, starts)
        yield own.spans(part.data, starts, ends), part, at, starts, ends, before
        if len(part.rows) == 1:  # may go on
            from_word = max(0, len(starts) - keep)
            tail = part.data[starts[from_word] :] if from_word < len(starts) else b""
            before += from_word


def counted(docs: DataFrame, index: Index) -> dict[int, int]:
    """How often each shingle of the index comes in all documents."""
    sent = docs.sparkSession.sparkContext.broadcast((index.all, index.sizes()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (known, sizes), own = sent.value, Hasher()
        total, bits, keep = np.zeros(len(known), np.int64), filter_of(known), max(sizes) - 1
        for batch in batches:
            for h, _, at, _, _, before in cut_words(batch.column(0), own, keep):
                for k, x in Index.grams(h, sizes).items():
                    place, which = met(x, known, bits)
                    again = place + k <= keep if before else np.zeros(len(place), bool)  # counted in the part before
                    ok = (at[place] == at[place + k - 1]) & ~again
                    total += np.bincount(which[ok], minlength=len(known))
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(known[there].view(np.int64)), pa.array(total[there])], ["shingle", "n"])

    if not len(index.all):
        return {}
    summed = docs.select("text").mapInArrow(count, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    return {r["shingle"] & (2**64 - 1): r["n"] for r in summed.collect()}  # at most as many as the index has


def united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans (start, end) as disjoint ones in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def searched(docs: DataFrame, index: Index, last: bool) -> DataFrame:
    """Documents with what the index finds in them added to ``n_words``, ``spans`` and ``items``; the last search drops the texts."""
    sent = docs.sparkSession.sparkContext.broadcast(index)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, own, known_raw = sent.value, Hasher(), {}
        sizes, bits = x.sizes(), filter_of(x.prefix)
        widest = int(x.width.max(initial=1))
        for batch in batches:
            rows = batch.num_rows
            n_words, spans, found = np.zeros(rows, np.int64), defaultdict(list), defaultdict(set)
            for h, part, at, starts, ends, before in cut_words(batch.column(1), own, widest - 1):
                if before == 0:
                    n_words[part.rows] = np.bincount(at, minlength=len(part.rows))
                else:
                    n_words[part.rows[0]] = before + len(starts)
                if not len(x.prefix) or not len(h):
                    continue
                first = np.searchsorted(at, np.arange(len(part.rows)))
                end = np.append(first[1:], len(h))
                whole = Index.grams(h, sorted(set(x.width.tolist())))
                for _, grams in Index.grams(h, sizes).items():
                    place, which = met(grams, x.prefix, bits)
                    many = x.many[which]
                    window = x.order[np.repeat(x.first[which] - np.cumsum(many) + many, many) + np.arange(many.sum())]
                    place = np.repeat(place, many)
                    row, start = at[place], place - x.place[window]
                    ok = (start >= first[row]) & (start + x.width[window] <= end[row])
                    window, start, row = window[ok], start[ok], row[ok]
                    for w in np.unique(x.width[window]).tolist():
                        same = np.flatnonzero(x.width[window] == w)
                        same = same[whole[w][start[same]] == x.whole[window[same]]]
                        a, b = starts[start[same]].tolist(), ends[start[same] + w - 1].tolist()
                        for k, i, j, r, s in zip(window[same].tolist(), a, b, part.rows[row[same]].tolist(), (start[same] - first[row[same]]).tolist(), strict=True):
                            raw = part.data[i:j]
                            own_words = known_raw.get(raw)
                            if own_words is None:
                                if len(known_raw) > 100_000:
                                    known_raw.clear()
                                own_words = known_raw[raw] = b" ".join(words(raw))
                            if own_words == x.windows[k]:
                                spans[r].append((before + s, before + s + w))
                                found[r].add(k)
            old_spans, old_items = batch.column(3), batch.column(4)
            for r in range(rows):
                spans[r] += [tuple(v) for v in old_spans[r].as_py()]
            spans_out = [united(spans[r]) for r in range(rows)]
            items_out = [sorted({i for k in found.get(r, ()) for i in x.items[k]} | set(old_items[r].as_py())) for r in range(rows)]
            text = pa.nulls(rows, pa.string()) if last else batch.column(1)
            columns = [batch.column(0), text, pa.array(n_words), pa.array(spans_out, pa.list_(pa.list_(pa.int64()))), pa.array(items_out, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, ["key", "text", "n_words", "spans", "items"])

    return docs.mapInArrow(search, docs.schema)


def indexes(items: DataFrame, key: str, text: str, width: int, shingle: int, most: int = INDEX_BYTES) -> Iterator[tuple[Index, bool]]:
    """The windows of all items, in blocks that take ``most`` bytes at most, about; with each, whether it is the last."""
    every = stored(windows(items, key, text, width), "windows")
    size = every.agg(F.sum(F.octet_length("window") + F.coalesce(F.octet_length("item"), F.lit(0)) + 100)).first()[0] or 0
    blocks = max(1, -(-size // most))
    dealt = lambda k: every.where(F.pmod(F.xxhash64("window"), F.lit(blocks)) == k) if blocks > 1 else every
    for k in range(blocks):
        yield Index([(r["item"], bytes(r["window"])) for r in dealt(k).collect()], shingle), k == blocks - 1


def scan(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", width: int = WIDTH, shingle: int = SHINGLE, most: int = INDEX_BYTES
) -> DataFrame:
    """One row per document: ``key``, ``n_words``, ``spans`` (disjoint [start, end) of words hit, in order) and ``items`` (ids as text, sorted)."""
    nothing = [F.lit(0).cast("long").alias("n_words"), F.array().cast("array<array<bigint>>").alias("spans"), F.array().cast("array<string>").alias("items")]
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"), *nothing)
    texts = rows.select("text")
    for index, last in indexes(items, item_key, item_text, width, shingle, most):
        index.choose(counted(texts, index))
        rows = searched(rows, index, last)
        if not last:
            rows = stored(rows, "searched")
    return rows.select(F.col("key").alias(key), "n_words", "spans", "items")


def hit_words(spans: Column) -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])


def clean(docs: DataFrame, items: DataFrame, text: str = "text", percent: float = 0.0) -> DataFrame:
    """``docs`` without those of whose words more than ``percent`` percent are hit; their columns stay, whatever their names. Texts without words stay."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{text}`").alias("text"))
    found = scan(rows, items, key="row")
    return found.where(100 * hit_words(F.col("spans")) <= percent * F.col("n_words")).select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def digest(docs: DataFrame, items: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per document: how many words are hit, and which items occur, as a count and a hash."""
    found = scan(docs, items, key)
    return found.select(
        key, "n_words", hit_words(F.col("spans")).alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )
