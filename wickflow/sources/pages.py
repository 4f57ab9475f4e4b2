"""Klines that come in pages, as a Spark data source.

A page is what a server gives for a start time and a limit: klines as JSON arrays, in order of time. The reader splits a series' time range
into partitions and pages through each of them by the stop rules of candles.paged, so a long range is fetched by many tasks, and
one that fails fetches its own part again. Offline, a folder stands for the server: each line of its files is a kline, and it must be
mounted where tasks run.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .candles import STEPS, paged

SCHEMA = "symbol string, timeframe string, kline array<string>"


def of_folder(folder: str) -> Callable[[int, int], list]:
    """A function of (start, limit): the first klines from start on in the files of a folder, as a server gives them."""
    rows: dict[int, list] = {}
    for where, _, names in os.walk(folder):
        for name in names:
            if not name.startswith((".", "_")):
                with open(os.path.join(where, name), encoding="utf-8") as f:
                    for line in filter(str.strip, f):
                        kline = json.loads(line)
                        rows[int(kline[0])] = kline
    times = sorted(rows)

    def fetch(start: int, limit: int) -> list:
        from bisect import bisect_left

        at = bisect_left(times, start)
        return [rows[t] for t in times[at : at + limit]]

    return fetch


class Span(InputPartition):
    """The times from start to end (inclusive) of one series."""

    def __init__(self, symbol: str, timeframe: str, start: int, end: int) -> None:
        self.symbol, self.timeframe, self.start, self.end = symbol, timeframe, start, end


class KlineReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.folder = options["path"].removeprefix("file://").removeprefix("file:")
        self.symbols, self.timeframes = options["symbols"].split(","), options["timeframes"].split(",")
        self.start, self.end = int(options["start"]), int(options["end"])
        self.page, self.spans = int(options.get("page", 1000)), int(options.get("partitions", 4))

    def partitions(self) -> list[Span]:
        """Spans of whole steps, so that no candle is in two."""
        out = []
        for symbol in self.symbols:
            for timeframe in self.timeframes:
                step = STEPS[timeframe]
                first, last = self.start // step, self.end // step
                width = max(1, -(-(last - first + 1) // self.spans))
                out += [Span(symbol, timeframe, max(self.start, a * step), min(self.end, (a + width) * step - 1)) for a in range(first, last + 1, width)]
        return out

    def read(self, partition: Span) -> Iterator[tuple]:
        fetch = of_folder(f"{self.folder}/symbol={partition.symbol}/timeframe={partition.timeframe}")
        step = STEPS[partition.timeframe]
        for rows in paged(fetch, partition.start, partition.end, step, most=(partition.end - partition.start) // step + 1, page=self.page):
            for kline in rows:
                if int(kline[0]) <= partition.end:  # a page may go beyond
                    yield partition.symbol, partition.timeframe, [str(x) for x in kline]


class KlinePages(DataSource):
    """spark.read.format("klines"): options path, symbols, timeframes (comma-separated), start, end (ms), page, partitions."""

    @classmethod
    def name(cls) -> str:
        return "klines"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> DataSourceReader:
        return KlineReader(self.options)
