"""Spelling variants: words that differ by one code point, found through automata of the vocabulary read forwards and backwards.

Two words are near if one inserted, deleted or replaced code point makes one of the other. Then the first half of a word stands
unchanged at the start of the near word, or the second half at its end. So the words are held twice, as they are and reversed,
in minimal acyclic automata whose edges count the words that they skip (which numbers the words, so that nothing else is stored with
a state). A word follows its half exactly, completes the rest with one error, and reads off the numbers of what it meets. What is met
in both directions counts in the forward one alone.

The vocabulary is cut into ranges of about ``SHARD`` words in the order of code points, each with an automaton of its own. What starts with
a half stands in one stretch of that order, so a word asks the ranges that this stretch touches, and a beginning that
a third of all words share is many ranges and no hot key.

A word's form is its most frequent near word, if that comes ``RATIO`` times as often or more; forms lead from word to word up to a root,
and are followed by doubling: as each step makes a word at least ``RATIO`` times as frequent, few rounds do.

Null and empty texts have no words. Repeated rows count as often as they come. Of near words of one count the smallest in the order of code points is the form.
A table without rows gives an empty result; extra columns play no part.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small, stored
from .similarity import Hasher
from .tokens import Part, distinct, parts, row_of, runs, stirred

LENGTH, LEAST, RATIO = 6, 5, 5
#: Words of a range, about.
SHARD = 20_000
#: Words that a task holds before it gives them out.
HELD = 300_000
#: A-Z and a-z, and the lead byte of U+00C0 to U+00FF, each of which is that byte and one more.
ASCII_LETTERS = np.array([chr(c).isascii() and chr(c).isalpha() for c in range(256)])
LEAD = 0xC3
NOT_LETTER = ~ASCII_LETTERS & (np.arange(256) < 0x80)
LAST = "\U0010ffff"


def letter_runs(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of letters, and their lengths in code points."""
    x = np.frombuffer(data, np.uint8)
    lead = x == LEAD
    follows = np.zeros(len(x), bool)
    follows[1:] = lead[:-1]
    starts, ends = runs(ASCII_LETTERS[x] | lead | follows)
    before = np.concatenate(([0], np.cumsum(lead)))
    return starts, ends, ends - starts - (before[ends] - before[starts])


def crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1)
    return c.astype(np.uint32)


def crc_after(state: np.ndarray, data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """crc32 of bytes that follow on what ``state`` is the crc32 of, for many spans at once."""
    table, x, out = crc_table(), np.frombuffer(data, np.uint8), ~state.astype(np.uint32)
    order = np.argsort(starts - ends, kind="stable")  # longest first
    long = (ends - starts)[order]
    for k in range(int(long[0]) if len(long) else 0):
        now = order[: int(np.searchsorted(-long, -k))]
        c = out[now]
        out[now] = table[(c ^ x[starts[now] + k]) & 0xFF] ^ (c >> np.uint32(8))
    return ~out


def vocabulary(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, least: int = LEAST, slip_every: int | None = None) -> DataFrame:
    """``word``, ``n``: lower-cased runs of letters of ``length`` code points or more that come ``least`` times or more.

    With ``slip_every``, a run loses a code point in the documents in which that number divides the crc32 ``h`` of
    ``<key>:<run>`` (a null key is an empty one): the one at place ``h`` modulo its length.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, other = Hasher(), Hasher(11)
        held: dict[bytes, int] = defaultdict(int)

        def given() -> pa.RecordBatch:
            out = [pa.array(list(held), pa.binary()).cast(pa.string()), pa.array(list(held.values()), pa.int64())]
            held.clear()
            return pa.RecordBatch.from_arrays(out, ["word", "n"])

        def slip(part: Part, keys: list[str], starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
            seeds = np.array([zlib.crc32(f"{keys[r]}:".encode()) for r in part.rows.tolist()], np.uint32)
            h = crc_after(seeds[row_of(part, starts)], part.data, starts, ends)
            slips = h % np.uint32(slip_every) == 0
            for i in np.flatnonzero(slips).tolist():
                run = part.data[starts[i] : ends[i]].decode()
                at = int(h[i]) % len(run)
                word = run[:at] + run[at + 1 :]
                if len(word) >= length:
                    held[word.encode()] += 1
            return slips

        for batch in batches:
            keys = ["" if v is None else v for v in batch.column(0).to_pylist()]
            for part in parts(batch.column(1), NOT_LETTER):
                starts, ends, many = letter_runs(part.data)
                ok = many >= length
                starts, ends = starts[ok], ends[ok]
                if slip_every and len(starts):
                    slips = slip(part, keys, starts, ends)
                    starts, ends = starts[~slips], ends[~slips]
                one, n, _ = distinct(own.spans(part.data, starts, ends), stirred(other.spans(part.data, starts, ends)))
                for i, j, m in zip(starts[one].tolist(), ends[one].tolist(), n.tolist(), strict=True):
                    held[part.data[i:j]] += m
                if len(held) > HELD:
                    yield given()
        yield given()

    rows = docs.select(F.col(f"`{key}`").cast("string").alias("key"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(read, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


class Automaton:
    """A minimal acyclic automaton of sorted, distinct words that numbers them in their order."""

    def __init__(self, words: list[str]):
        # a state is its edges by code point, in order; a final one has the edge ""
        known: dict[tuple, int] = {}
        self.edges: list[dict[str, tuple[int, int]]] = []
        self.count: list[int] = []

        def state(edges: list[tuple[str, int]], final: bool) -> int:
            mark = (final, *edges)
            at = known.get(mark)
            if at is None:
                at = known[mark] = len(self.edges)
                skipped, own = int(final), {}
                for c, to in edges:
                    own[c] = (to, skipped)
                    skipped += self.count[to]
                if final:
                    own[""] = (at, 0)
                self.edges.append(own)
                self.count.append(skipped)
            return at

        path: list[tuple[list, bool]] = [([], False)]  # edges that are done, and whether a word ends there
        before = ""

        def close(down_to: int) -> None:
            while len(path) - 1 > down_to:
                done, final = path.pop()
                path[-1][0].append((before[len(path) - 1], state(done, final)))

        for w in words:
            shared = 0
            while shared < min(len(w), len(before)) and w[shared] == before[shared]:
                shared += 1
            close(shared)
            path += [([], False) for _ in w[shared:]]
            path[-1] = (path[-1][0], True)
            before = w
        close(0)
        self.root = state(*path[0])

    def follow(self, at: int, number: int, rest: str) -> tuple[int, int] | None:
        edges = self.edges
        for c in rest:
            step = edges[at].get(c)
            if step is None:
                return None
            at, number = step[0], number + step[1]
        return at, number

    def number(self, word: str) -> int | None:
        end = self.follow(self.root, 0, word)
        return end[1] if end and "" in self.edges[end[0]] else None

    def near(self, word: str, half: int) -> set[int]:
        """Numbers of the words that begin with the first ``half`` code points of ``word`` and go on as it does but for one error."""
        out: set[int] = set()
        here = self.follow(self.root, 0, word[:half])
        edges, follow = self.edges, self.follow

        def ends(at: int, number: int, rest: str) -> None:
            last = follow(at, number, rest)
            if last is not None and "" in edges[last[0]]:
                out.add(last[1])

        for i in range(half, len(word) + 1):
            if here is None:
                break
            at, number = here
            rest = word[i + 1 :]
            if i < len(word):
                ends(at, number, rest)  # without word[i]
            for c, (to, skipped) in edges[at].items():
                if c:
                    ends(to, number + skipped, word[i:])  # with c before it
                    if i < len(word) and c != word[i]:
                        ends(to, number + skipped, rest)  # with c for it
            here = follow(at, number, word[i]) if i < len(word) else None
        return out


def met(rows: Iterator[tuple[int, int, bool, str, int]]) -> Iterator[tuple[str, int, int, int | None, str | None]]:
    """Of rows ``(range, direction, asks, word, n)``, those of a range in one stretch and its words first: each word that asks, with how many near words it meets there, and the best of them."""
    now, words, counts, own = None, [], [], None
    for shard, way, asks, word, n in rows:
        if shard != now:
            now, words, counts, own = shard, [], [], None
        if not asks:
            words.append(word)
            counts.append(n)
            continue
        if own is None:
            own = Automaton(words)
        half = len(word) - len(word) // 2 if way else len(word) // 2
        found = own.near(word, half)
        if way and found:  # what begins alike is found forwards
            found = {k for k in found if not words[k].endswith(word[half:])}
        best = min(((-counts[k], words[k][::-1] if way else words[k]) for k in found), default=(None, None))
        yield word[::-1] if way else word, n, len(found), None if best[0] is None else -best[0], best[1]


def near_words(words: DataFrame, shard: int = SHARD) -> DataFrame:
    """``word``, ``n``, ``n_near``, and the count and spelling of its best near word: ``near_n``, ``near``. ``words`` has each word once."""
    both = words.select(F.lit(0).alias("way"), F.col("word").alias("w"), "n").unionByName(words.select(F.lit(1).alias("way"), F.reverse("word").alias("w"), "n"))
    ranges = max(1, -(-2 * words.count() // shard))
    held = stored(both.repartitionByRange(ranges, "way", "w").select(F.spark_partition_id().alias("shard"), "way", "w", "n"), "ranges")
    bounds = held.groupBy("shard", "way").agg(F.min("w").alias("least"), F.max("w").alias("most")).orderBy("way", "least").collect()  # a row a range

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = [[b for b in bounds if b["way"] == way] for way in (0, 1)]
        first, last = ([[b[c] for b in s] for s in sides] for c in ("least", "most"))
        for batch in batches:
            out: list[tuple] = []
            for way, w, n in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                begin = w[: len(w) - len(w) // 2 if way else len(w) // 2]
                i = bisect_left(last[way], begin)
                beyond = bisect_left(first[way], begin + LAST)
                out += [(sides[way][k]["shard"], way, True, w, n) for k in range(i, beyond)]
            kinds = (pa.int32(), pa.int32(), pa.bool_(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], ["shard", "way", "asks", "w", "n"])

    kind = "shard int, way int, asks boolean, w string, n long"
    rows = held.select("shard", "way", F.lit(False).alias("asks"), "w", "n").unionByName(held.mapInArrow(ask, kind))
    dealt = rows.repartition(ranges, "shard", "way").sortWithinPartitions("shard", "way", "asks", "w")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = (r for batch in batches for r in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True))
        # a range that holds the end of one direction and the begin of the other is two
        found = met(((2 * s + way, way, asks, w, n) for s, way, asks, w, n in every))
        held: list[tuple] = []
        made = lambda: pa.RecordBatch.from_arrays([pa.array([r[k] for r in held], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()))], ["word", "n", "n_near", "near_n", "near"])
        for r in found:
            held.append(r)
            if len(held) == 10_000:
                yield made()
                held.clear()
        yield made()

    by_range = dealt.mapInArrow(search, "word string, n long, n_near long, near_n long, near string")
    best = F.min(F.when(F.col("near").isNotNull(), F.struct((-F.col("near_n")).alias("m"), "near")))
    out = by_range.groupBy("word", "n").agg(F.sum("n_near").alias("n_near"), best.alias("b"))
    return out.select("word", "n", "n_near", (-F.col("b.m")).alias("near_n"), F.col("b.near").alias("near"))


def roots(links: DataFrame, most: int, ratio: int = RATIO) -> DataFrame:
    """``word``, ``root`` for rows ``word``, ``up``, where each step up makes counts (``most`` at most) ``ratio`` times as large or larger."""
    depth = max(1, ceil(log(max(most, ratio), ratio)))
    now = links.select("word", F.col("up").alias("root"))
    for _ in range(ceil(log(depth + 1, 2))):
        above = small(now.select(F.col("word").alias("root"), F.col("root").alias("further")))
        now = stored(now.join(above, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "roots")
    return now


def variants(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, least: int = LEAST, ratio: int = RATIO, slip_every: int | None = None, shard: int = SHARD) -> DataFrame:
    """One row per word: ``word``, ``n``, ``n_near``, ``form`` with ``form_n`` (null if it has none), and ``root`` (the word itself if it has no form)."""
    words = stored(vocabulary(docs, key, text, length, least, slip_every), "words")
    found = near_words(words, shard)
    is_form = F.col("near_n") >= ratio * F.col("n")
    all_words = stored(found.select("word", "n", "n_near", F.when(is_form, F.col("near")).alias("form"), F.when(is_form, F.col("near_n")).alias("form_n")), "near")
    most = all_words.agg(F.max("n")).first()[0] or 0
    up = roots(all_words.where("form IS NOT NULL").select("word", F.col("form").alias("up")), most, ratio)
    return all_words.join(small(up), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
