"""Candles of paged interfaces, as batches and as streams with a cursor for each symbol.

A page holds the first candles at or after a moment, newest first, and no more than a limit. A reader asks from its cursor, keeps what isn't after the end, moves
the cursor behind the last candle, and stops at an empty page; so a hole costs nothing and no page is asked for twice. A stream's offsets are the cursors of all symbols: what lies
between two offsets is read again in the same way after a failure, and each candle comes once.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from tidemark.functions.intervals import INTERVALS


def pages(fetch, symbol: str, interval: str, start: int, end: int, limit: int) -> Iterator[list[list]]:
    """Pages of a symbol from ``start`` to ``end`` (included), each with its candles in order, up to the first empty one."""
    cursor = start
    while cursor <= end:
        found = [r for r in reversed(fetch(symbol, interval, cursor, limit)) if cursor <= int(r[0]) <= end]
        if not found:
            return
        yield found
        cursor = int(found[-1][0]) + INTERVALS[interval]


class PagedCandles(DataSource):
    """A data source over an interface of pages. Options: ``symbols`` (comma-separated), ``interval``, ``start``, ``end`` (ms, included), and those of the interface.

    Subclasses set ``fetch(options, symbol, interval, start, limit)``, which gives a page of rows ``[ms, open, high, low, close, volume, turnover]``, and
    ``newest(options, symbol, interval, end)``, the time of a symbol's newest candle up to a moment, or None. There is no network here.
    """

    page = 1000
    #: Pages that one task reads after each other; a long history is spread over tasks by time.
    chain = 8

    @classmethod
    def name(cls) -> str:
        return "paged_candles"

    def schema(self) -> str:
        return "symbol string, interval string, ts_ms bigint, open double, high double, low double, close double, volume double, turnover double"

    @staticmethod
    def fetch(options: dict, symbol: str, interval: str, start: int, limit: int) -> list[list]:
        raise NotImplementedError("set fetch() to the interface's client")

    @staticmethod
    def newest(options: dict, symbol: str, interval: str, end: int) -> int | None:
        raise NotImplementedError("set newest() to the interface's client")

    def reader(self, schema) -> DataSourceReader:
        return PagedReader(type(self), dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802  named by the interface
        return PagedStream(type(self), dict(self.options))


class Cursors:
    """What batches and streams share: tasks of a stretch of time, and how a task reads its pages."""

    def __init__(self, source: type[PagedCandles], options: dict):
        self.source, self.options = source, options
        self.interval, self.start, self.end = options["interval"], int(options["start"]), int(options["end"])
        self.symbols = [s for s in options["symbols"].split(",") if s]

    def tasks(self, symbol: str, start: int, end: int) -> list[InputPartition]:
        step = INTERVALS[self.interval] * self.source.page * self.source.chain
        return [InputPartition((symbol, a, min(a + step - 1, end))) for a in range(start, end + 1, step)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        symbol, start, end = partition.value
        fetch = lambda *args: self.source.fetch(self.options, *args)
        for page in pages(fetch, symbol, self.interval, start, end, self.source.page):
            for r in page:
                yield symbol, self.interval, int(r[0]), *map(float, r[1:7])


class PagedReader(Cursors, DataSourceReader):
    def partitions(self) -> list[InputPartition]:
        return [t for s in self.symbols for t in self.tasks(s, self.start, self.end)]


class PagedStream(Cursors, DataSourceStreamReader):
    def initialOffset(self) -> dict:  # noqa: N802
        return {s: self.start for s in self.symbols}

    def latestOffset(self) -> dict:  # noqa: N802
        """Each symbol's cursor behind its newest candle."""
        found = {s: self.source.newest(self.options, s, self.interval, self.end) for s in self.symbols}
        return {s: self.start if ms is None else max(self.start, ms + INTERVALS[self.interval]) for s, ms in found.items()}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        """A symbol that is new since the checkpoint starts at the beginning."""
        return [t for s, b in end.items() for t in self.tasks(s, start.get(s, self.start), b - 1)]


@lru_cache(maxsize=64)
def listed(path: str, symbol: str, day: int) -> list[list]:
    files, at = fs.FileSystem.from_uri(path) if ":" in path else (fs.LocalFileSystem(), path)
    found = files.get_file_info(fs.FileSelector(f"{at}/symbol={symbol}/day={day}", allow_not_found=True))
    lines = [x for f in found if f.is_file and f.base_name.startswith("part-") for x in files.open_input_stream(f.path).read().decode().splitlines()]
    return sorted((json.loads(x)["row"] for x in lines), key=lambda r: int(r[0]))


class FolderPages(PagedCandles):
    """Pages of an interface whose answers were kept: JSON lines with a ``row`` of strings in folders by symbol and day (``path``, ``first_day``, ``last_day``)."""

    page = 50

    @classmethod
    def name(cls) -> str:
        return "folder_pages"

    @staticmethod
    def fetch(options: dict, symbol: str, interval: str, start: int, limit: int) -> list[list]:
        out: list[list] = []
        for day in range(max(start // 86_400_000, int(options["first_day"])), int(options["last_day"]) + 1):
            out += [r for r in listed(options["path"], symbol, day) if int(r[0]) >= start][: limit - len(out)]
            if len(out) == limit:
                break
        return out[::-1]

    @staticmethod
    def newest(options: dict, symbol: str, interval: str, end: int) -> int | None:
        for day in range(min(end // 86_400_000, int(options["last_day"])), int(options["first_day"]) - 1, -1):
            found = [int(r[0]) for r in listed(options["path"], symbol, day) if int(r[0]) <= end]
            if found:
                return found[-1]
        return None
