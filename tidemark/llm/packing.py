"""Packing by cutting-stock column generation.

A row's ids are cut into pieces of ``CAPACITY`` tokens and a remainder. Lengths, rounded up to ``UNIT`` tokens, form a
histogram of at most ``CAPACITY // UNIT`` classes, whatever the size of the data; the rounding leaves up to ``UNIT - 1``
tokens of padding behind a piece's share of a sequence. Over it a linear program chooses how
often to use each pattern (a multiset of classes that fits one sequence); a knapsack by dynamic programming over its
duals prices new patterns until none improves the bound. Pattern counts are rounded down, the few pieces left over are
packed largest first, and pieces take the slots of the patterns by their rank in their class. Ranks are counted in salted
groups and shifted by prefix sums, so no class lands in one task. Only the histogram and the patterns pass the driver.

Null texts are empty; an empty text still has its end token. Repeated rows are packed each on its own; a table without
rows gives an empty result; extra columns play no part.
"""

from __future__ import annotations

import functools
import os
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

CAPACITY, UNIT, END_ID = 4096, 16, 2
#: Chunks and words whose ids a worker remembers, of those met in two groups of texts; the others are encoded again. Bits of the table that tells what was met.
REMEMBERED, MET_BITS = 300_000, 20
#: What the tokenizer gets at once (chunks), and texts that are split together: so many, and characters in all.
AT_ONCE, GROUPED, CHARACTERS = 2000, 256, 1 << 20
#: What may follow a word of letters in its chunk; such marks are one run to the tokenizer.
MARKS = ".,;:!?#$%&*()[]{}+-/=@^_~"
#: A character that is a token of its own between white space; it parts chunks that are encoded together.
BETWEEN = "\x01"
#: Pieces ranked together in one salted group, about.
GROUP = 200_000
#: Letters that lower-casing and composition leave letters, each for itself.
LETTERS = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u0148\u014a-\u017e]+")
#: White space to Python's split() that the tokenizer takes as ordinary characters.
ODD_SPACE = re.compile("[\x1c-\x1f]")


class ChunkEncoder:
    """Ids of whole texts, put together from the ids of their chunks between white space.

    The tokenizer drops white space and no token crosses it, so this equals encoding the text at once. Of chunks not met
    before, most are letters with or without marks behind them, each one run to the tokenizer, whose last token ends a
    word. Such runs are encoded in one go and parted at these tokens, other chunks in one go with ``BETWEEN`` among them,
    and those that hold it, or might hold a special token's text, singly.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.chunks = Tokenizer.from_file(path), {}
        self.met, self.many = bytearray(1 << MET_BITS), 0
        (self.between,) = self.tokenizer.encode(BETWEEN, add_special_tokens=False).ids
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[k for token, k in vocabulary.items() if token.endswith("</w>")]] = True

    def together(self, parts: list[str], between: str) -> np.ndarray:
        return np.asarray(self.tokenizer.encode_batch_fast([between.join(parts)], add_special_tokens=False)[0].ids, "<u4")

    def in_blocks(self, parts: list[str], of: Callable[[list[str]], dict[str, bytes]]) -> dict[str, bytes]:
        out: dict[str, bytes] = {}
        for at in range(0, len(parts), AT_ONCE):
            out |= of(parts[at : at + AT_ONCE])
        return out

    @staticmethod
    def cut(ids: np.ndarray, starts: list[int], ends: list[int]) -> list[bytes]:
        data = ids.tobytes()
        return [data[4 * a : 4 * b] for a, b in zip(starts, ends, strict=True)]

    def of_runs(self, runs: list[str]) -> dict[str, bytes]:
        ids = self.together(runs, " ")
        ends = (np.flatnonzero(self.ends[ids]) + 1).tolist()
        return dict(zip(runs, self.cut(ids, [0, *ends[:-1]], ends), strict=True)) if runs else {}

    def of_chunks(self, chunks: list[str]) -> dict[str, bytes]:
        ids = self.together(chunks, f" {BETWEEN} ")
        gaps = np.flatnonzero(ids == self.between).tolist()
        return dict(zip(chunks, self.cut(ids, [0, *(k + 1 for k in gaps)], [*gaps, len(ids)]), strict=True)) if chunks else {}

    def learn(self, chunks: list[str]) -> dict[str, bytes]:
        """Ids of chunks that aren't remembered, and of words and marks in them."""
        words, plain, odd, known = [], [], [], self.chunks
        for c in chunks:
            word = c.rstrip(MARKS)
            if LETTERS.fullmatch(word):
                words.append((c, word.lower(), c[len(word) :]))
            elif BETWEEN in c or "<|" in c or ODD_SPACE.search(c):
                odd.append(c)
            else:
                plain.append(c)
        runs = self.in_blocks(list({r for _, *both in words for r in both if r and r not in known}), self.of_runs)
        of = lambda r: runs[r] if r in runs else known[r]
        out = runs | {c: of(word) + of(marks) if marks else of(word) for c, word, marks in words}
        out |= self.in_blocks(plain, self.of_chunks)
        single = self.tokenizer.encode_batch_fast(odd, add_special_tokens=False)
        out |= {c: np.asarray(e.ids, "<u4").tobytes() for c, e in zip(odd, single, strict=True)}
        return out

    def again(self, chunk: str) -> bool:
        """Whether a chunk was met before, or one of its bits was."""
        at = hash(chunk) & (1 << MET_BITS) - 1
        if self.met[at]:
            return True
        self.met[at] = 1
        self.many += 1
        if 2 * self.many > len(self.met):
            self.met, self.many = bytearray(len(self.met)), 0
        return False

    @staticmethod
    def groups(texts: list[str | None]) -> Iterator[list[str]]:
        group, held = [], 0
        for t in texts:
            group.append(t or "")
            held += len(group[-1])
            if len(group) >= GROUPED or held > CHARACTERS:
                yield group
                group, held = [], 0
        if group:
            yield group

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of each text, the end token included."""
        end, known = np.asarray([END_ID], "<u4").tobytes(), self.chunks
        for group in self.groups(texts):
            parts = [[t] if ODD_SPACE.search(t) else t.split() for t in group]
            new = list(set().union(*parts).difference(known))
            extra = self.learn(new) if new else {}
            known.update(extra)
            for part in parts:
                yield b"".join(map(known.__getitem__, part)) + end
            for c in extra:
                if len(c) > 24 or len(known) > REMEMBERED or not self.again(c):
                    del known[c]


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> ChunkEncoder:
    return ChunkEncoder(path)


def pieces(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """``key``, ``start``, ``length``, ``ids_crc32`` and ``doc_tokens`` of every piece."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer)
        for batch in batches:
            out: list[tuple] = []
            for k, ids in zip(batch.column(0).to_pylist(), own.encode(batch.column(1).to_pylist()), strict=True):
                view, n = memoryview(ids), len(ids) // 4
                out.extend((k, s, min(capacity, n - s), zlib.crc32(view[4 * s : 4 * min(n, s + capacity)]), n) for s in range(0, n, capacity))
            columns = zip(*out, strict=True) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], ["key", "start", "length", "ids_crc32", "doc_tokens"])

    rows = docs.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(cut, "key long, start long, length long, ids_crc32 long, doc_tokens long")


def knapsack(sizes: np.ndarray, values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of sizes that fits: its value and how often it holds each size."""
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for room in range(1, capacity + 1):
        best[room] = best[room - 1]
        fits = np.flatnonzero(sizes <= room)
        if len(fits):
            gains = best[room - sizes[fits]] + values[fits]
            k = int(gains.argmax())
            if gains[k] > best[room] + 1e-12:
                best[room], last[room] = gains[k], fits[k]
    counts, room = np.zeros(len(sizes)), capacity
    while room > 0:
        if last[room] < 0:
            room -= 1
        else:
            counts[last[room]] += 1
            room -= sizes[last[room]]
    return float(best[capacity]), counts


def inverted(basis: np.ndarray) -> np.ndarray:
    """The inverse by elimination with pivots, in plain array operations: a library's threads may hang where few are allowed."""
    n = len(basis)
    both = np.hstack((basis, np.eye(n)))
    for k in range(n):
        p = k + int(np.abs(both[k:, k]).argmax())
        if p != k:
            both[[k, p]] = both[[p, k]]
        both[k] /= both[k, k]
        column = both[:, k].copy()
        column[k] = 0
        rows = np.flatnonzero(column)
        both[rows] -= column[rows, None] * both[k]
    return both[:, n:]


def plan(histogram: dict[int, int], capacity: int, gap: float = 2e-4, rounds: int = 4000) -> list[tuple[dict[int, int], int]]:
    """Patterns ``({size: times}, copies)`` that use each size exactly as often as the histogram has it."""
    sizes = np.array(sorted(k for k, v in histogram.items() if v > 0), int)
    if not len(sizes):
        return []
    demand = np.array([histogram[k] for k in sizes], float)
    basis = np.diag(np.maximum(1, capacity // sizes).astype(float))
    inverse = np.diag(1 / np.diag(basis))
    bound = 0.0
    for step in range(rounds):  # einsum, as threads of a linear algebra library cost more than they bring at this size
        if step % 512 == 511:
            inverse = inverted(basis)
        use, duals = np.einsum("ij,j->i", inverse, demand), inverse.sum(axis=0)
        value, column = knapsack(sizes, np.maximum(duals, 0), capacity)
        bound = max(bound, use.sum() / value)  # no plan takes fewer sequences
        if use.sum() <= bound * (1 + gap):
            break
        change = np.einsum("ij,j->i", inverse, column)
        ratio = np.full(len(sizes), np.inf)
        np.divide(use, change, out=ratio, where=change > 1e-9)
        leave = int(ratio.argmin())
        if not np.isfinite(ratio[leave]):
            break
        basis[:, leave] = column
        row = inverse[leave] / change[leave]
        inverse = inverse - np.outer(change, row)
        inverse[leave] = row
    use = np.maximum(np.einsum("ij,j->i", inverted(basis), demand), 0)
    out, left = [], demand.astype(int)
    for k in np.argsort(-use):
        pattern = basis[:, k].astype(int)
        held = pattern > 0
        copies = min(int(use[k] + 1e-6), int((left[held] // pattern[held]).min()))
        if copies > 0:
            out.append(({int(sizes[i]): int(pattern[i]) for i in np.flatnonzero(held)}, copies))
            left = left - copies * pattern
    while left.any():  # largest first, each pattern as often as what is left allows
        pattern, room = Counter(), capacity
        for i in np.flatnonzero(left)[::-1]:
            take = min(int(left[i]), room // int(sizes[i]))
            if take:
                pattern[int(i)] = take
                room -= take * int(sizes[i])
        copies = min(int(left[i]) // n for i, n in pattern.items())
        for i, n in pattern.items():
            left[i] -= copies * n
        out.append(({int(sizes[i]): n for i, n in pattern.items()}, copies))
    return out


def slots(patterns: list[tuple[dict[int, int], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each size: first ranks, pieces in a sequence, and first sequences of the patterns that hold it."""
    found: dict[int, list[list[int]]] = {}
    base, ranks = 0, Counter()
    for pattern, copies in patterns:
        for size, times in pattern.items():
            found.setdefault(size, []).append([ranks[size], times, base])
            ranks[size] += times * copies
        base += copies
    return {k: tuple(np.array(v, np.int64).T) for k, v in found.items()}


def pack(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, unit: int = UNIT) -> DataFrame:
    """One row per piece: ``key``, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset``."""
    cut = stored(pieces(docs, tokenizer, key, text, capacity), "pieces")
    sized = cut.withColumn("size", F.ceil(F.col("length") / unit).cast("int"))
    counts = {r["size"]: r["n"] for r in sized.groupBy("size").agg(F.count("*").alias("n")).collect()}  # capacity / unit rows at most
    places = slots(plan(counts, capacity // unit))
    salts = max(16, sum(counts.values()) // GROUP)
    salted = sized.withColumn("salt", F.pmod(F.xxhash64("key", "start", "ids_crc32"), F.lit(salts)))
    before = Window.partitionBy("size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    shift = salted.groupBy("size", "salt").agg(F.count("*").alias("n")).select("size", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    within = Window.partitionBy("size", "salt").orderBy("key", "start", "ids_crc32")
    ranked = salted.withColumn("rank", F.row_number().over(within) - 1).join(shift, ["size", "salt"])

    @F.pandas_udf("long")
    def sequence(size, rank):
        out = np.zeros(len(size), np.int64)
        for s in np.unique(size):
            first, times, base = places[int(s)]
            mine = np.flatnonzero(size == s)
            r = rank.to_numpy()[mine]
            k = np.searchsorted(first, r, "right") - 1
            out[mine] = base[k] + (r - first[k]) // times[k]
        import pandas as pd

        return pd.Series(out)

    dealt = ranked.withColumn("sequence_id", sequence("size", F.col("rank") + F.col("shift")))
    ahead = Window.partitionBy("sequence_id").orderBy(F.desc("size"), "key", "start", "ids_crc32").rowsBetween(Window.unboundedPreceding, -1)
    return dealt.select(
        F.col("key").alias(key), "start", "length", "ids_crc32", "doc_tokens", "sequence_id",
        F.coalesce(F.sum("length").over(ahead), F.lit(0)).cast("long").alias("offset"),
    )
