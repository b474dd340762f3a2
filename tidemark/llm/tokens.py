"""Words of many texts at once, as arrays of offsets and hashes over one byte string, without an object a word.

Texts are cut by classes of bytes: UTF-8 keeps ASCII bytes for ASCII characters, so a class of ASCII characters, and one of
all others, can be told by single bytes. Texts are handled in parts of about ``PART`` bytes. A longer text is cut at bytes
that its caller names (separators), so memory doesn't grow with a text; only one word is never cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from .similarity import Hasher

PART = 1 << 20
MIX, STEP = np.uint64(0xD1342543DE82EF95), np.uint64(0x9E3779B97F4A7C15)


def byte_class(inside: str) -> np.ndarray:
    """Which of the 256 bytes are among the given ASCII characters."""
    out = np.zeros(256, bool)
    out[np.frombuffer(inside.encode("ascii"), np.uint8)] = True
    return out


def between(*ranges: tuple[int, int]) -> str:
    return "".join(chr(c) for a, b in ranges for c in range(a, b + 1))


#: Fixed values: ``[\x00-\x2F\x3A-\x60\x7B-\x7F]``, what stands between words of letters and digits after lower-casing A-Z.
NOT_ALNUM = byte_class(between((0, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)))


@dataclass
class Part:
    """Rows of a batch, or a part of one: lower-cased bytes, and for each row its number in the batch and where it begins."""

    data: bytes
    rows: np.ndarray
    begins: np.ndarray
    goes_on: bool = False  # the row of the part before


def parts(column: pa.Array, cut: np.ndarray, most: int = PART, lower: bool = True) -> Iterator[Part]:
    """All texts of a column (null: empty), joined by line feeds; texts longer than ``most`` in parts that end at a byte of ``cut``."""
    held: list[bytes] = []
    first, size = 0, 0

    def joined(texts: list[bytes], at: int) -> Part:
        begins = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))[:-1]
        return Part(b"\n".join(texts), np.arange(at, at + len(texts)), begins)

    for k, raw in enumerate(column.cast(pa.binary()).to_pylist()):
        text = (raw or b"").lower() if lower else raw or b""
        if len(text) > most:
            if held:
                yield joined(held, first)
            held, first, size = [], k + 1, 0
            at, again = 0, False
            marks = np.flatnonzero(cut[np.frombuffer(text, np.uint8)])
            while at < len(text):
                end = len(text)
                if end - at > most:
                    i = np.searchsorted(marks, at + most, "right") - 1
                    if i < 0 or marks[i] < at:
                        i = np.searchsorted(marks, at + most)
                    end = int(marks[i]) + 1 if i < len(marks) else len(text)
                yield Part(text[at:end], np.array([k]), np.zeros(1, np.int64), again)
                at, again = end, True
            continue
        if held and size + len(text) > most:
            yield joined(held, first)
            held, first, size = [], k, 0
        held.append(text)
        size += len(text) + 1
    if held:
        yield joined(held, first)


def runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of true."""
    edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    return edge[::2], edge[1::2]


def row_of(part: Part, starts: np.ndarray) -> np.ndarray:
    """For each start, which of the part's rows it is in (from 0)."""
    return np.searchsorted(part.begins, starts, "right") - 1


def stirred(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * MIX
    return h ^ (h >> np.uint64(29))


class Grams:
    """Hashes of windows of 1, 2, 3 and more words, from those of the words."""

    def __init__(self, words: np.ndarray):
        self.words, self.width, self.sums = words, 1, words.copy()
        self.factor = np.uint64(1)

    def next(self) -> np.ndarray:
        """Hashes of the windows of the current width, one for each word that starts one; then the width grows by one."""
        out = stirred(self.sums + np.uint64(self.width))
        with np.errstate(over="ignore"):
            self.factor = self.factor * STEP
            n = max(0, len(self.words) - self.width)
            self.sums = self.sums[:n] + self.words[self.width :] * self.factor if n else np.zeros(0, np.uint64)
        self.width += 1
        return out


def distinct(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Groups of equal pairs of hashes: where one stands, how often it comes, and the order by the first hash.

    Unlike values that share the first hash are told apart by the second; a group may then come in pieces.
    """
    order = np.argsort(first)
    a, b = first[order], second[order]
    new = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))) if len(a) else np.zeros(0, np.int64)
    return order[new], np.diff(np.concatenate((new, [len(a)]))), order


def word_hashers() -> tuple[Hasher, Hasher]:
    return Hasher(7), Hasher(11)
