"""Line dedup: an exact set-similarity join of lines, which removes later matches.

A line's set holds its distinct lower-cased words; lines of fewer than ``min_words`` words are left alone (1 where none is
given: every line with a word takes part). A line goes if a line before it (in an earlier document by id, or earlier in
the same one) is similar: 100 * |A and B| >= PERCENT * |A or B|. Whether the earlier line itself stays plays no part.

Lines with one and the same set form a class, of which the first line alone takes part in the join. Words are put in order
by their frequency over all lines, rarest first; each line is listed under its prefix, with its size, the place of the word
and a parity bitmap of the set. A frequent word is listed together with each word after it, as similar sets share two
words or more, so its lists stay short; lines of more than ``LONG`` words are listed by single words, and those near
that size both ways. Pairs within a list pass the length, positional and bitmap filters (bits that differ are words that
differ). Of the earlier lines that pass, a line takes the ``CLOSEST`` by bitmap to be verified on the whole lines; if it has
more and none proves similar, it asks again, against all lines, in a round that lets more through, until it has asked all.
So a group of near copies isn't expanded into its pairs, and no match is lost.

A map task keeps ``FEW`` of the members that a list has in a batch if these are over ``CROWD``, and pairs the others itself; a
list of over ``HUGE`` members in a task is cut by a hash. Both make the members ask again unless they are matched.

Null and empty texts have no lines to remove and stay as they are. Rows without an id are left alone. Of repeated rows
(one id) all lose the same lines; lines that repeat by it are later matches only of other ids or line numbers. A table
without rows gives an empty result. Extra columns stay, whatever their names; one called ``removed_lines`` is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import let, partitions, small, stored
from .similarity import ASKS, CROWDED, PERCENT, Hasher, closest, dealt, gathered, slices, summed_levels, together, verify

BITS, LONG, CLOSEST, FEW, CROWD, HUGE = 22, 256, 2, 16, 1024, 4096
#: Of larger sets, and where no bitmap is close, the bitmaps tell little, so more candidates are verified at once.
DENSE, MORE = 200, 64
#: Words in more lines than this are listed together with a second word.
FREQUENT = 1024
#: Lines that may ask for all candidates at once, and as many as there may be.
FEW_LEFT, ALL = 10_000, 1 << 30
#: Bytes of text that are cut into words together; longer texts are cut at line ends.
TOGETHER = 1_000_000
#: Postings or lines that a task holds before it deals them out, and that a bucket holds, about.
HELD = 250_000
LINE = {"k1": np.uint64, "k2": np.uint64, "key": np.int64, "line": np.int32}
#: ``n`` stops at 65535, which makes the filters of larger sets weaker; ``token`` holds 32 bits of those that don't tell the bucket.
POSTING = {"token": np.uint32, "key": np.int64, "line": np.int32, "n": np.uint16, "place": np.uint16, "bits": np.dtype((np.uint64, (2,))), "flags": np.uint8}
PAIR = {"a": np.int64, "a_line": np.int32, "b": np.int64, "b_line": np.int32, "far": np.int16, "most": np.int32}


def segments(keys: list, texts: list) -> Iterator[list[tuple[int, int, bytes]]]:
    """Texts in lower case, as lists of ``(key, first line, bytes)`` of about TOGETHER bytes; rows without a key are left out."""
    held, size = [], 0
    for key, text in zip(keys, texts, strict=True):
        data = (text or "").encode("utf-8", "surrogatepass").lower()
        if key is None or not data:
            continue
        line = at = 0
        while at < len(data):
            end = len(data)
            if end - at > TOGETHER:
                cut = data.find(b"\n", at + TOGETHER)
                end = cut if cut >= 0 else end
            held.append((key, line, data[at:end]))
            size += end - at
            line += data.count(b"\n", at, end) + 1
            at = end + 1
            if size >= TOGETHER:
                yield held
                held, size = [], 0
    if held:
        yield held


class Lines:
    """Sets of the lines of some segments, as flat arrays: of words (``word``, in the order of ``level``, then hash) and of lines (the others)."""

    def __init__(self, own: Hasher, held: list[tuple[int, int, bytes]], min_words: int, levels: np.ndarray | None = None, wanted: np.ndarray | None = None):
        """``wanted``: a table of the last 24 bits of words; lines that hold none of them are left out."""
        data = b"\n".join(x for *_, x in held)
        raw = np.frombuffer(data, np.uint8)
        blank = np.ones(len(raw) + 2, bool)
        blank[1:-1] = (raw == 32) | ((raw >= 9) & (raw <= 13))
        edge = blank[1:] != blank[:-1]
        starts, ends = np.flatnonzero(edge).reshape(-1, 2).T
        breaks = np.flatnonzero(raw == 10)
        row = np.searchsorted(breaks, starts)
        lines = np.array([x.count(b"\n") + 1 for *_, x in held])
        first = np.concatenate(([0], np.cumsum(lines)))
        use = (np.bincount(row, minlength=first[-1]) >= min_words)[row]
        row, word = row[use], own.spans(data, starts[use], ends[use])
        if wanted is not None:
            hits = np.zeros(first[-1], bool)
            hits[row[wanted[(word & np.uint64(0xFFFFFF)).astype(np.int64)] > 0]] = True
            row, word = row[hits[row]], word[hits[row]]
        order = word >> np.uint64(20)
        if levels is not None:
            order = (levels[word >> np.uint64(64 - BITS)].astype(np.uint64) << np.uint64(36)) | (word >> np.uint64(28))
        by = np.argsort((row.astype(np.uint64) << np.uint64(44)) | order)
        row, word = row[by], word[by]
        if len(row):
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (word[1:] != word[:-1])
            row, word = row[new], word[new]
        self.word = word
        self.starts = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1]))) if len(row) else np.zeros(0, int)
        self.n = np.diff(np.concatenate((self.starts, [len(row)]))).astype(np.int64) if len(row) else np.zeros(0, np.int64)
        which = row[self.starts]
        at = np.searchsorted(first, which, "right") - 1
        self.key = np.array([k for k, *_ in held], np.int64)[at]
        self.line = (which - first[at] + np.array([x for _, x, _ in held], np.int64)[at]).astype(np.int32)

    def sums(self, seed: int) -> np.ndarray:
        """A 64-bit digest of each set: the sum of mixed hashes."""
        h = (self.word ^ np.uint64(seed)) * np.uint64(0xC2B2AE3D27D4EB4F)
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9FB21C651E98DF25)
        return np.add.reduceat(h ^ (h >> np.uint64(28)), self.starts) if len(self.starts) else np.zeros(0, np.uint64)

    def parity(self) -> np.ndarray:
        """Bitmaps of 128 bits: whether a bit's words are odd in number."""
        if not len(self.starts):
            return np.zeros((0, 2), np.uint64)
        bit = np.uint64(1) << (self.word & np.uint64(63))
        upper = (self.word & np.uint64(64)) > 0
        return np.stack([np.bitwise_xor.reduceat(np.where(upper == k, bit, np.uint64(0)), self.starts) for k in (False, True)], axis=1)


def line_reader():
    """Words themselves, so that verification takes no hash for a word."""
    return lambda text: frozenset((text or "").encode("utf-8", "surrogatepass").lower().split())


def copies_in(x: dict[str, np.ndarray]) -> np.ndarray:
    """Which lines have the set of a line before them; rows that repeat an id and a line number are one line."""
    by = np.lexsort((x["line"], x["key"], x["k2"], x["k1"]))
    k1, k2, key, line = (x[c][by] for c in ("k1", "k2", "key", "line"))
    same = np.zeros(len(by), bool)
    same[1:] = (k1[1:] == k1[:-1]) & (k2[1:] == k2[:-1])
    item = ~same
    item[1:] |= (key[1:] != key[:-1]) | (line[1:] != line[:-1])
    out = np.zeros(len(by), bool)
    out[by] = same[np.maximum.accumulate(np.where(item, np.arange(len(by)), 0))]
    return out


def counted_lines(docs: DataFrame, buckets: int, min_words: int) -> DataFrame:
    """Rows of three ``kind``s: lines and their digests by bucket (0), copies of a line of the same batch (1), slices of word counts (2)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, table = Hasher(), np.zeros(1 << BITS, np.uint32)
        held: list[dict[str, np.ndarray]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            x = {c: np.concatenate([h[c] for h in held]) for c in LINE}
            held.clear()
            again = copies_in(x)
            yield dealt(1, x["k1"][again], {c: x[c][again] for c in ("key", "line")}, buckets)
            yield dealt(0, x["k1"][~again], {c: v[~again] for c, v in x.items()}, buckets)

        for batch in batches:
            for part in segments(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x = Lines(own, part, min_words)
                np.add.at(table, (x.word >> np.uint64(64 - BITS)).astype(np.int64), 1)
                held.append({"k1": x.sums(1), "k2": x.sums(2), "key": x.key, "line": x.line})
                if sum(len(h["key"]) for h in held) > HELD:
                    yield from flush()
        if held:
            yield from flush()
        found = list(slices(table))
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), 2, np.int32)), pa.array([k for k, _ in found], pa.int32()), pa.array([d for _, d in found], pa.binary())], ["kind", "bucket", "data"])

    return docs.mapInArrow(read, "kind int, bucket int, data binary")


def later_copies(counted: DataFrame) -> DataFrame:
    """``key``, ``line`` of the lines whose set an earlier line has."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for kind, data in gathered(batches):
            if kind == 1:
                x = together(data, {c: LINE[c] for c in ("key", "line")})
            else:
                x = together(data, LINE)
                again = copies_in(x)
                x = {c: x[c][again] for c in ("key", "line")}
            yield pa.RecordBatch.from_arrays([pa.array(x["key"]), pa.array(x["line"])], ["key", "line"])

    return counted.where("kind < 2").repartition("bucket").sortWithinPartitions("bucket", "kind").mapInArrow(read, "key long, line int")


def listed(x: Lines, levels: np.ndarray, stays: np.ndarray, asks: np.ndarray, percent: int) -> dict[str, np.ndarray]:
    """Postings of lines: prefix words, or prefix words with a second one."""
    at = np.repeat(np.arange(len(x.n)), x.n)
    place = np.arange(len(x.word)) - x.starts[at]
    prefix = x.n - -(-percent * x.n // 100) + 1
    level = levels[x.word >> np.uint64(64 - BITS)]
    often = level > 1 + np.rint(4 * np.log2(FREQUENT))
    # sets so small that only equal ones are similar have no part, as classes settle those; level 1: no other line has the word
    use = (stays & (x.n * (100 - percent) >= percent))[at] & (level != 1)
    first = use & (place < prefix[at])
    single = np.flatnonzero(first & (~often | (100 * x.n > percent * LONG)[at]))
    out = [{"token": x.word[single], "at": at[single], "place": place[single]}]
    lead, d = np.flatnonzero(first & often & (x.n <= LONG)[at]), 1
    while len(lead):
        lead = lead[place[lead] + d <= prefix[at[lead]]]  # the second word shared is one place further at most
        second = lead + d
        ok = use[second]
        i, j = lead[ok], second[ok]
        mixed = (x.word[i] ^ (x.word[i] >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + x.word[j]
        out.append({"token": (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9), "at": at[i], "place": place[j] - 1})
        d += 1
    token, at, place = (np.concatenate([o[c] for o in out]) for c in ("token", "at", "place"))
    n = x.n[at]
    return {
        "token": token, "key": x.key[at], "line": x.line[at], "n": np.minimum(n, 65535).astype(np.uint16), "place": np.where(n < 65535, place, 0).astype(np.uint16),
        "bits": x.parity()[at], "flags": asks[at] * np.uint8(ASKS),
    }


def postings(docs: DataFrame, levels: np.ndarray, buckets: int, room: int, min_words: int, percent: int, wanted: np.ndarray | None = None, only_words: bool = False) -> DataFrame:
    """Postings by ``bucket`` (``kind`` 0), and pairs of crowded lists (1). ``docs`` has ``key``, ``text``, ``gone`` (lines to leave out)
    and ``asks`` (lines that ask; null: all do, if ``wanted`` is not given). ``wanted``: bits of the words that lines must hold to be listed.
    ``only_words``: slices of a table of the last 24 bits of the prefix words of lines that ask instead (kind 2)."""
    sent = docs.sparkSession.sparkContext.broadcast((levels.tobytes(), None if wanted is None else wanted.tobytes()))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, known = Hasher(), np.frombuffer(sent.value[0], np.uint8)
        asked = None if sent.value[1] is None else np.unpackbits(np.frombuffer(sent.value[1], np.uint8), bitorder="little")
        held: list[dict[str, np.ndarray]] = []
        seen = np.zeros(1 << 24 if only_words else 0, np.uint16)

        def marked(x: Lines, marks: dict[int, set[int]], other: bool) -> np.ndarray:
            out = np.full(len(x.key), other)
            if marks:
                for i in np.flatnonzero(np.isin(x.key, np.array(list(marks), np.int64))):
                    out[i] = (int(x.line[i]) in marks[int(x.key[i])]) != other
            return out

        def flush() -> Iterator[pa.RecordBatch]:
            x = {c: np.concatenate([h[c] for h in held]) for c in POSTING}
            held.clear()
            _, which, members = np.unique(x["token"], return_inverse=True, return_counts=True)
            crowded = members[which] > CROWD
            if asked is None and crowded.any():
                y = {c: v[crowded] for c, v in x.items()}
                pairs = closest(y, (room, DENSE, max(room, MORE)), percent, HUGE, every=True)
                yield dealt(1, by_later(pairs), pairs, buckets)
                by = np.lexsort((y["line"], y["key"], y["token"]))
                t = y["token"][by]
                start = np.maximum.accumulate(np.where(np.concatenate(([True], t[1:] != t[:-1])), np.arange(len(t)), 0))
                few = np.flatnonzero(crowded)[by[np.arange(len(t)) - start < FEW]]
                x["flags"][few] |= CROWDED
                stay = ~crowded
                stay[few] = True
                x = {c: v[stay] for c, v in x.items()}
            yield dealt(0, x["token"], x | {"token": x["token"].astype(np.uint32)}, buckets)

        for batch in batches:
            keys = batch.column(0).to_pylist()
            gone, asks = ({k: set(g) for k, g in zip(keys, batch.column(c).to_pylist(), strict=True) if g and k is not None} for c in (2, 3))
            for part in segments(keys, batch.column(1).to_pylist()):
                x = Lines(own, part, min_words, known, asked)
                if only_words:
                    at = np.repeat(np.arange(len(x.n)), x.n)
                    prefix = (np.arange(len(x.word)) - x.starts[at] <= (x.n - -(-percent * x.n // 100))[at]) & marked(x, asks, False)[at]
                    seen[(x.word[prefix] & np.uint64(0xFFFFFF)).astype(np.int64)] = 1
                    continue
                held.append(listed(x, known, marked(x, gone, True), np.ones(len(x.key), bool) if asked is None else marked(x, asks, False), percent))
                if sum(len(h["key"]) for h in held) > HELD:
                    yield from flush()
        if held:
            yield from flush()
        found = list(slices(seen))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), 2, np.int32)), pa.array([k for k, _ in found], pa.int32()), pa.array([d for _, d in found], pa.binary())], ["kind", "bucket", "data"])

    return docs.mapInArrow(read, "kind int, bucket int, data binary")


def by_later(pairs: dict[str, np.ndarray]) -> np.ndarray:
    """A hash of the later line of each pair."""
    h = (pairs["b"].view(np.uint64) + pairs["b_line"].astype(np.uint64) * np.uint64(0xD1342543DE82EF95)) * np.uint64(0x9E3779B97F4A7C15)
    return (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def chosen(x: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Of the pairs of all lists, the closest of each later line, and whether it has to ask again."""
    by = np.lexsort((x["a_line"], x["a"], x["far"], x["a_line"] < 0, x["b_line"], x["b"]))
    a, al, b, bl, _, most = (x[c][by] for c in PAIR)
    line = np.ones(len(by), bool)
    line[1:] = (b[1:] != b[:-1]) | (bl[1:] != bl[:-1])
    pair = line.copy()
    pair[1:] |= (a[1:] != a[:-1]) | (al[1:] != al[:-1])
    a, al, b, bl, most, line = a[pair], al[pair], b[pair], bl[pair], most[pair], line[pair]
    which = np.cumsum(line) - 1
    place = np.arange(len(a)) - np.flatnonzero(line)[which] if len(a) else np.zeros(0, int)
    room = np.zeros(which[-1] + 1 if len(a) else 0, np.int32)
    np.maximum.at(room, which, most)
    keep = (al >= 0) & (place < room[which])
    again = np.unique(which[~keep])  # pairs that were left out, or a row that says so
    head = np.flatnonzero(line)[again]
    return {
        "a": np.concatenate((a[keep], np.zeros(len(again), np.int64))), "a_line": np.concatenate((al[keep], np.full(len(again), -1, np.int32))),
        "b": np.concatenate((b[keep], b[head])), "b_line": np.concatenate((bl[keep], bl[head])),
    }


def candidates(posted: DataFrame, buckets: int, room: int, percent: int, huge: int | None) -> DataFrame:
    """Pairs ``a``, ``a_line``, ``b``, ``b_line`` (a before b), each once; of lines that have to ask again, ``a_line`` is -1."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for kind, data in gathered(batches):
            x = together(data, PAIR) if kind == 1 else closest(together(data, POSTING), (room, DENSE, max(room, MORE)), percent, huge)
            yield dealt(0, by_later(x), x, buckets)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, data in gathered(batches):
            x = chosen(together(data, PAIR))
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in x.values()], list(x))

    found = posted.repartition("bucket").sortWithinPartitions("bucket", "kind").mapInArrow(read, "kind int, bucket int, data binary")
    return found.repartition("bucket").sortWithinPartitions("bucket", "kind").mapInArrow(choose, "a long, a_line int, b long, b_line int")


def by_key(lines: DataFrame, name: str) -> DataFrame:
    """``key`` and the array ``name`` of its lines: no longer than the text has lines."""
    return lines.groupBy("key").agg(F.sort_array(F.collect_set("line")).alias(name))


def later_matches(docs: DataFrame, min_words: int = 1, percent: int = PERCENT) -> DataFrame:
    """``key``, ``line`` of every line to remove; ``docs`` has columns ``key`` and ``text``."""
    item, at_least = ["key", "line"], partitions(docs)
    counted = stored(counted_lines(docs, 4 * at_least, min_words), "lines")
    copies = stored(later_copies(counted), "copies")
    levels = summed_levels(counted.where("kind = 2").select(F.col("bucket").alias("slice"), "data"), BITS)
    words = float(np.where(levels > 0, 2.0 ** ((levels - 1.0) / 4), 0).sum())
    buckets = max(2 * at_least, int(words / 4 / HELD) + 1)

    gone = stored(by_key(copies, "gone"), "gone")
    none = F.lit(None).cast("array<int>")
    rows = docs.join(small(gone), "key", "left").select("key", "text", "gone", none.alias("asks"))
    room = CLOSEST
    found = stored(candidates(postings(rows, levels, buckets, room, min_words, percent), buckets, room, percent, HUGE), "candidates")
    settled, rounds = None, 0
    while True:
        pairs = found.where("a_line >= 0")
        matched = stored(verify(pairs, docs, line_reader, percent).select(F.col("b").alias("key"), F.col("b_line").alias("line")).distinct(), "settled")
        settled = matched if settled is None else settled.unionByName(matched)
        again = stored(found.where("a_line < 0").select(F.col("b").alias("key"), F.col("b_line").alias("line")).join(matched, item, "left_anti"), "open")
        if again.isEmpty():
            return copies.unionByName(settled).distinct()
        # what is left asks all lines, and takes more of them (a few lines take all); lines that hold no word of theirs aren't listed
        room = ALL if again.count() <= FEW_LEFT else room * 32
        asks = stored(by_key(again, "asks"), "asks")
        mine = docs.join(small(asks), "key").join(small(gone), "key", "left").select("key", "text", "gone", "asks")
        words_of_mine = postings(mine, levels, buckets, room, min_words, percent, only_words=True).select(F.col("bucket").alias("slice"), "data")
        wanted = np.packbits(summed_levels(words_of_mine, 24) > 0, bitorder="little")  # 2 MB
        rows = docs.join(small(asks), "key", "left").join(small(gone), "key", "left").select("key", "text", "gone", "asks")
        found = stored(candidates(postings(rows, levels, buckets, room, min_words, percent, wanted), buckets, room, percent, None), "candidates")


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = 1, percent: int = PERCENT) -> DataFrame:
    """``docs`` with ``text`` free of later matches, and with ``removed_lines`` (sorted line numbers, from 0) added."""
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{text}`").alias("text"))
    gone = stored(by_key(later_matches(rows, min_words, percent), "gone"), "gone")
    names = [c for c in docs.columns if c != "removed_lines"]
    nested = docs.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{text}`").alias("text"), F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"))
    joined = nested.join(small(gone), "key", "left")
    left = let(F.split("text", "\n"), lambda lines: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "gone"), lambda i: F.get(lines, i)), "\n"))
    cleaned = F.when(F.col("gone").isNull(), F.col("text")).otherwise(left)
    return joined.select(
        *[cleaned.alias(c) if c == text else F.col("row").getField(c).alias(c) for c in names], F.coalesce("gone", F.array().cast("array<int>")).alias("removed_lines")
    )
