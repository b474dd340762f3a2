"""Phrase collocations: count-min sketches find what may be frequent, a second pass counts that exactly.

A phrase is a run of 1 to ``LONGEST`` words within a piece of text, counted per language with overlaps. In the first pass
each task adds its words and pairs of words up in a count-min sketch of two rows of cells; a cell stops at ``least``, as all that is asked
of the merged sketch is whether both cells of a phrase reach it. Cells only overestimate, so no frequent phrase is lost. In the second
pass longer phrases are added up in a sketch of their own, but only those whose pairs of words all reached ``least``, as no phrase
comes more often than a part of it. In the third pass phrases whose cells reach ``least``, and those of their parts, are
counted exactly, by their words; all that are rarer after that go.

A sketch grows with the text and shrinks with ``least``: both have a cell for ``BYTES_A_CELL`` bytes of text at a threshold of 100, dealt by
the number of their lengths. Beyond ``MOST_BITS``, which bounds a task's memory and the broadcast, the phrases are dealt to rounds by
their hash, and each round reads the texts for its own share; a part that belongs to another round counts as frequent.

A phrase of two words or more is scored by how much more often it comes than its parts would let expect, at the cut that explains it best:
``floor(1000 * count * words / (count of first part * count of rest))``, in exact decimals; of equal scores the first cut counts. A phrase whose
words stand in a longer one of the same count is dropped. As counts only fall with more words, it is enough to compare with
phrases that are one word longer.

Null and empty texts have no words; a null language is ``und``. Repeated rows count as often as they come. Ties in rank are
broken by the count and then by the phrase. A table without rows gives an empty result; extra columns play no part.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, small, stored
from .similarity import Hasher
from .tokens import MIX, Grams, Part, between, byte_class, distinct, parts, row_of, runs, stirred

LONGEST, LEAST, TOP = 5, 100, 2000
#: Lengths of the phrases of each sketch.
SKETCHES = (range(1, 3), range(3, LONGEST + 1))
#: Fixed values: ``[.,;:!?\\x0A-\\x0D]`` ends a piece, blanks and tabs end a word.
ENDS = byte_class(".,;:!?" + between((0x0A, 0x0D)))
BLANK = byte_class(" \t")
BYTES_A_CELL, LEAST_BITS, MOST_BITS, SLICE = 128, 16, 26, 1 << 16
#: Cells that a task holds before it adds them to its sketch.
WAITING = 2_000_000
#: Phrases that a task holds before it gives them out, and that a bucket holds, about.
HELD = 300_000


def cells(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A cell of each row of the sketch."""
    shift = np.uint64(64 - bits)
    return (h >> shift).astype(np.uint32), ((h * MIX) >> shift).astype(np.uint32)


def mine(h: np.ndarray, number: int, rounds: int) -> np.ndarray:
    return (h & np.uint64(0xFFFFFF)) % np.uint64(rounds) == np.uint64(number)


@dataclass
class Sieve:
    """Which cells of a merged sketch of phrases of ``lengths`` reach the threshold, as bits: two rows of ``2 ** bits``."""

    lengths: range
    bits: int
    reached: np.ndarray

    def passes(self, h: np.ndarray) -> np.ndarray:
        first, last = (row[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8) & 1 > 0 for row, cell in zip(self.reached, cells(h, self.bits), strict=True))
        return first & last


class Phrases:
    """The phrases of one part of a batch: hashes by length, and the words' places."""

    def __init__(self, part: Part, langs: np.ndarray, own: Hasher):
        x = np.frombuffer(part.data, np.uint8)
        ends = ENDS[x]
        self.starts, self.ends = runs(~(ends | BLANK[x]))
        self.rows = part.rows[row_of(part, self.starts)] if len(part.rows) else np.zeros(0, np.int64)
        self.piece = np.cumsum(ends, dtype=np.int32)[self.starts]
        self.langs, self.data = langs[self.rows], part.data
        self.seeded = stirred(own.spans(part.data, self.starts, self.ends) + self.langs)

    def grams(self, words: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """``(k, hashes)`` for k from 1, one hash for each word."""
        g = Grams(words)
        for k in range(1, LONGEST + 1):
            yield k, g.next()

    def within(self, k: int) -> np.ndarray:
        """Which words start k words of one piece."""
        n = max(0, len(self.starts) - k + 1)
        return self.piece[:n] == self.piece[k - 1 :][:n]

    def open(self, sieves: list[Sieve], most: int, number: int, rounds: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """``(k, hashes, which)`` for k from 1 to ``most``: the phrases of the round that may be frequent, as far as the sieves tell of them and their parts."""
        may = np.ones(len(self.starts), bool)
        for k, h in self.grams(self.seeded):
            if k > most:
                break
            if k > 1:
                may = may[:-1] & may[1:]
            if k == 2:
                may &= self.within(2)
            which = np.flatnonzero(may if rounds == 1 else may & mine(h, number, rounds))
            for sieve in sieves:
                if k in sieve.lengths:
                    passed = sieve.passes(h[which])
                    may[which[~passed]] = False
                    which = which[passed]
            yield k, h, which

    def phrase(self, i: int, k: int) -> bytes:
        return b" ".join(self.data[self.starts[i] : self.ends[i + k - 1]].split())


class Tally:
    """Counts of phrases, found by their hashes, which are kept in the order of the first; each phrase is read from a text once."""

    def __init__(self):
        self.first = self.second = np.zeros(0, np.uint64)
        self.place = self.counts = np.zeros(0, np.int64)
        self.langs: list[str] = []
        self.phrases: list[bytes] = []

    def add(self, first: np.ndarray, second: np.ndarray, many: np.ndarray) -> np.ndarray:
        """Adds counts of pairs of hashes, in the order of the first. Returns which are new: the caller appends their ``langs`` and ``phrases``."""
        at = np.searchsorted(self.first, first)
        known = np.zeros(len(first), bool)
        inside = np.flatnonzero(at < len(self.first))
        known[inside] = (self.first[at[inside]] == first[inside]) & (self.second[at[inside]] == second[inside])
        np.add.at(self.counts, self.place[at[known]], many[known])
        new = np.flatnonzero(~known)
        self.first, self.second = np.insert(self.first, at[new], first[new]), np.insert(self.second, at[new], second[new])
        self.place = np.insert(self.place, at[new], len(self.counts) + np.arange(len(new)))
        self.counts = np.concatenate((self.counts, many[new]))
        return new


def language_hashes(column: pa.Array) -> tuple[list[str], np.ndarray]:
    langs = ["und" if v is None else v for v in column.to_pylist()]
    known = {v: int.from_bytes(blake2b(v.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big") for v in set(langs)}
    return langs, np.array([known[v] for v in langs], np.uint64)


def sketched(docs: DataFrame, lengths: range, bits: int, sieves: list[Sieve], number: int, rounds: int, least: int) -> DataFrame:
    """Slices of every task's sketch of phrases of ``lengths`` that pass the ``sieves`` (``slice``, ``data``), and its words by language (``lang``, ``n``)."""
    kind = np.uint8 if least < 256 else np.uint32
    sent = docs.sparkSession.sparkContext.broadcast(sieves)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, tables, words = Hasher(), np.zeros((2, 1 << bits), kind), defaultdict(int)
        waiting: list[tuple[np.ndarray, np.ndarray]] = []

        def add() -> None:
            for row in range(2):
                found = np.sort(np.concatenate([w[row] for w in waiting])) if waiting else np.zeros(0, np.uint32)
                new = np.flatnonzero(np.concatenate(([True], found[1:] != found[:-1]))) if len(found) else np.zeros(0, np.int64)
                cell, many = found[new], np.diff(np.append(new, len(found)))
                tables[row, cell] = np.minimum(tables[row, cell].astype(np.int64) + many, least)
            waiting.clear()

        for batch in batches:
            langs, hashed = language_hashes(batch.column(0))
            for part in parts(batch.column(1), ENDS):
                x = Phrases(part, hashed, own)
                for k, h, which in x.open(sent.value, lengths[-1], number, rounds):
                    if k in lengths:
                        waiting.append(cells(h[which], bits))
                many = np.bincount(x.rows, minlength=batch.num_rows)
                for r in np.flatnonzero(many).tolist():
                    words[langs[r]] += int(many[r])
                if sum(len(w[0]) for w in waiting) > WAITING:
                    add()
        add()
        per_row = max(1, (1 << bits) // SLICE)
        made = lambda k, d, lang, n: pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(d, pa.binary()), pa.array(lang, pa.string()), pa.array(n, pa.int64())], ["slice", "data", "lang", "n"])
        for row in range(2):
            for k in range(per_row):
                part = tables[row, k * SLICE : (k + 1) * SLICE]
                if part.any():
                    pack = zlib.compressobj(1, strategy=zlib.Z_RLE)  # counts have no longer repeats worth a search
                    yield made([row * per_row + k], [pack.compress(part.tobytes()) + pack.flush()], [None], [None])
        yield made([-1] * len(words), [None] * len(words), list(words), list(words.values()))

    return docs.mapInArrow(read, "slice int, data binary, lang string, n long")


def merged(sketches: DataFrame, bits: int, least: int) -> tuple[np.ndarray, DataFrame]:
    """Which cells reach ``least`` in all tasks' sketches together, as bits: two rows of ``2 ** bits``; and the words by language, ``lang`` and ``n``."""
    kind, per_row, width = np.uint8 if least < 256 else np.uint32, max(1, (1 << bits) // SLICE), min(SLICE, 1 << bits)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        words: dict[str, int] = defaultdict(int)
        for batch in batches:
            for k, data, lang, n in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                if lang is not None:
                    words[lang] += n
                    continue
                part = np.frombuffer(zlib.decompress(data), kind).astype(np.int64)
                sums[k] = np.minimum(sums[k] + part, least) if k in sums else part
        for k, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([np.packbits(total >= least).tobytes()], pa.binary()), pa.nulls(1, pa.string()), pa.nulls(1, pa.int64())], ["slice", "data", "lang", "n"])
        yield pa.RecordBatch.from_arrays([pa.nulls(len(words), pa.int32()), pa.nulls(len(words), pa.binary()), pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())], ["slice", "data", "lang", "n"])

    dealt = sketches.repartition(min(2 * per_row, 4 * partitions(sketches)), "slice", "lang")
    found = stored(dealt.mapInArrow(add, "slice int, data binary, lang string, n long"), "sketch")
    out = np.zeros((2, (1 << bits) // 8), np.uint8)
    for row in found.where("slice IS NOT NULL").select("slice", "data").collect():
        at = row["slice"] % per_row * (width // 8)
        out[row["slice"] // per_row, at : at + width // 8] = np.frombuffer(row["data"], np.uint8)
    return out, found.where("lang IS NOT NULL").select("lang", "n")


def survivors(docs: DataFrame, sieves: list[Sieve], number: int, rounds: int, least: int, buckets: int) -> DataFrame:
    """Exact counts of the phrases that pass the sieves with all their parts, and that reach the threshold themselves: ``lang``, ``phrase``, ``a``.

    A task sends its phrases as packed lists, one for each bucket and language, and a bucket adds up those of all tasks.
    """
    sent = docs.sparkSession.sparkContext.broadcast(sieves)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, other = Hasher(), Hasher(11)
        held = Tally()

        def given() -> pa.RecordBatch:
            nonlocal held
            lists: dict[tuple[int, str], tuple[list, list]] = defaultdict(lambda: ([], []))
            for lang, phrase, n in zip(held.langs, held.phrases, held.counts.tolist(), strict=True):
                phrases, counts = lists[zlib.crc32(phrase) % buckets, lang]
                phrases.append(phrase)
                counts.append(n)
            held = Tally()
            columns = [pa.array([k[0] for k in lists], pa.int32()), pa.array([k[1] for k in lists], pa.string())]
            columns.append(pa.array([zlib.compress(b"\n".join(v[0]), 1) for v in lists.values()], pa.binary()))
            columns.append(pa.array([zlib.compress(np.array(v[1], "<i8").tobytes(), 1) for v in lists.values()], pa.binary()))
            return pa.RecordBatch.from_arrays(columns, ["bucket", "lang", "phrases", "counts"])

        for batch in batches:
            langs, hashed = language_hashes(batch.column(0))
            for part in parts(batch.column(1), ENDS):
                x = Phrases(part, hashed, own)
                second = stirred(other.spans(part.data, x.starts, x.ends) + x.langs)
                for (k, h, at), (_, h2) in zip(x.open(sent.value, LONGEST, number, rounds), x.grams(second), strict=True):
                    one, many, _ = distinct(h[at], h2[at])
                    one = at[one]
                    for i in one[held.add(h[one], h2[one], many)].tolist():
                        held.langs.append(langs[x.rows[i]])
                        held.phrases.append(x.phrase(i, k))
                if len(held.phrases) > HELD:
                    yield given()
        yield given()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sums = None, defaultdict(int)

        def given() -> pa.RecordBatch:
            found = [(p, n) for p, n in sums.items() if n >= least]
            sums.clear()
            columns = [pa.array([now[1]] * len(found) if now else [], pa.string()), pa.array([p for p, _ in found], pa.binary()).cast(pa.string()), pa.array([n for _, n in found], pa.int64())]
            return pa.RecordBatch.from_arrays(columns, ["lang", "phrase", "a"])

        for batch in batches:
            for bucket, lang, phrases, counts in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                if (bucket, lang) != now:
                    yield given()
                    now = (bucket, lang)
                for p, n in zip(zlib.decompress(phrases).split(b"\n"), np.frombuffer(zlib.decompress(counts), "<i8").tolist(), strict=True):
                    sums[p] += n
        yield given()

    lists = docs.mapInArrow(read, "bucket int, lang string, phrases binary, counts binary")
    return lists.repartition(buckets, "bucket", "lang").sortWithinPartitions("bucket", "lang").mapInArrow(add, "lang string, phrase string, a long")


def frequent(docs: DataFrame, lang: str = "lang", text: str = "text", least: int = LEAST, most_bits: int = MOST_BITS) -> tuple[DataFrame, DataFrame]:
    """Exact counts of all phrases of 1 to ``LONGEST`` words that come ``least`` times or more (``lang``, ``phrase``, ``a``), and ``lang``, ``n`` (all words)."""
    rows = docs.select(F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{text}`").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    wanted = size * 100 // (least * BYTES_A_CELL)
    shares = [wanted * len(lengths) // LONGEST for lengths in SKETCHES]
    bits = [min(most_bits, max(LEAST_BITS, int(share).bit_length())) for share in shares]
    rounds = max(1, *(-(-share >> b) for share, b in zip(shares, bits, strict=True)))
    # no more than size / 2 phrases of a length can stand in a text, of which one in ``least`` comes so often
    buckets = max(partitions(rows), LONGEST * size // (2 * least * HELD))
    totals = counts = None
    for number in range(rounds):
        sieves: list[Sieve] = []
        for lengths, b in zip(SKETCHES, bits, strict=True):
            reached, words = merged(sketched(rows, lengths, b, sieves, number, rounds, least), b, least)
            sieves.append(Sieve(lengths, b, reached))
            totals = words if totals is None else totals
        found = stored(survivors(rows, sieves, number, rounds, least, buckets), "phrases")
        counts = found if counts is None else counts.unionByName(found)
    return counts, totals


def part(first: int | F.Column, length) -> F.Column:
    return F.array_join(F.slice("w", first, length), " ")


def with_score(cuts: DataFrame) -> DataFrame:
    """``score`` from ``a``, ``l``, ``r`` and ``n``: exact, as products of decimals and an integer division."""
    exact = lambda c: F.col(c).cast("decimal(19,0)")
    above, below = F.lit(1000).cast("decimal(4,0)") * exact("a") * exact("n"), exact("l") * exact("r")
    return cuts.withColumn("_above", above).withColumn("_below", below).withColumn("score", F.expr("_above div _below")).drop("_above", "_below")


def collocations(docs: DataFrame, lang: str = "lang", text: str = "text", least: int = LEAST, top: int | None = TOP) -> DataFrame:
    """``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r`` (counts of the phrase, and of its parts at the cut that counts), ``n``, ``score``: the first ``top`` of each language."""
    counts, totals = frequent(docs, lang, text, least)
    candidates = counts.where(F.contains("phrase", F.lit(" "))).withColumn("w", F.split("phrase", " "))
    # what stands in a phrase that is one word longer and as frequent goes
    longer = candidates.where(F.size("w") > 2).select("lang", F.explode(F.array(part(1, F.size("w") - 1), part(2, F.size("w") - 1))).alias("phrase"), "a").distinct()
    kept = candidates.join(longer, ["lang", "phrase", "a"], "left_anti")
    cuts = kept.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", part(1, F.col("k")).alias("first"), part(F.col("k") + 1, F.size("w")).alias("rest"))
    known = small(counts)
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("first"), F.col("a").alias("l")), ["lang", "first"])
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("rest"), F.col("a").alias("r")), ["lang", "rest"])
    cuts = cuts.join(small(totals), "lang")
    scored = with_score(cuts)
    best = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("b")).select("lang", "phrase", "b.*")
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")).cast("long"))
    out = ranked if top is None else ranked.where(F.col("rank") <= top)
    return out.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
