"""Bars from a vendor: a client protocol, a Python data source, a paging planner with retries."""

from __future__ import annotations

import datetime as dt
import time
from collections.abc import Callable, Iterable, Iterator, Sequence
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from barkeel.sources.store import ChunkStore

SCHEMA = "symbol string, timeframe string, timestamp timestamp, open double, high double, low double, close double, volume double"
Row = tuple


class Client(Protocol):
    """What a vendor's history service must offer; connection and contracts are its own matter."""

    def minute_bars(self, symbol: str, start: dt.datetime, end: dt.datetime) -> Sequence[Row]:
        """Rows (timestamp, open, high, low, close, volume) with start <= timestamp < end."""
        ...

    # Optional: ``resolve(symbol)`` gives the contracts of a symbol, of which there must be
    # exactly one; ``errors()`` gives (code, text) pairs that the service reported.


# Codes of messages that are no errors.
INFORMATIONAL = {2104, 2106, 2158}


class VendorError(RuntimeError):
    """A request that failed for good."""


def with_retry(call: Callable[[], Sequence[Row]], attempts: int = 4, pause: float = 10.0, sleep: Callable[[float], None] = time.sleep) -> Sequence[Row]:
    """The call's result; after failure number n it waits n times ``pause``."""
    for n in range(1, attempts + 1):
        try:
            return call()
        except Exception as error:  # noqa: BLE001
            if n == attempts:
                raise VendorError(f"history failed after {attempts} attempts") from error
            sleep(n * pause)
    return []


def fetch(client: Client, symbol: str, start: dt.datetime, end: dt.datetime) -> Sequence[Row]:
    """One window of one symbol; an ambiguous symbol and a reported error are errors, and so is an answer without bars."""
    if hasattr(client, "resolve") and len(contracts := list(client.resolve(symbol))) != 1:
        raise VendorError(f"{symbol} stands for {len(contracts)} contracts")
    rows = client.minute_bars(symbol, start, end)
    reported = [e for e in (client.errors() if hasattr(client, "errors") else []) if e[0] not in INFORMATIONAL]
    if reported:
        raise VendorError(f"{symbol}: {reported}")
    return rows


def windows(start: dt.datetime, end: dt.datetime, days: int = 30) -> Iterator[tuple[dt.datetime, dt.datetime]]:
    """Request windows from the end backwards."""
    while end > start:
        begin = max(start, end - dt.timedelta(days=days))
        yield begin, end
        end = begin


class _Window(InputPartition):
    def __init__(self, symbol: str, start: dt.datetime, end: dt.datetime) -> None:
        self.symbol, self.start, self.end = symbol, start, end


class VendorSource(DataSource):
    """``spark.read.format("vendor_bars")``: one partition per symbol and window.

    Options: symbols (comma separated), start, end (ISO), factory (module:function
    that makes a client), days, attempts.
    """

    @classmethod
    def name(cls) -> str:
        return "vendor_bars"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options) -> None:
        self.options = dict(options)

    def partitions(self) -> list[_Window]:
        o = self.options
        start, end = (dt.datetime.fromisoformat(o[k]) for k in ("start", "end"))
        return [_Window(s.strip(), a, b) for s in o["symbols"].split(",") for a, b in windows(start, end, int(o.get("days", 30)))]

    def read(self, partition: _Window) -> Iterator[Row]:
        import importlib

        module, _, function = self.options["factory"].partition(":")
        client = getattr(importlib.import_module(module), function)()
        rows = with_retry(lambda: fetch(client, partition.symbol, partition.start, partition.end), int(self.options.get("attempts", 4)), float(self.options.get("pause", 10)))
        for r in rows:
            yield (partition.symbol, "1m", *r)


def bars_frame(spark: SparkSession, symbol: str, rows: Iterable[Row]) -> DataFrame:
    """Vendor rows as a frame; no rows are an error."""
    found = [(symbol, "1m", *r) for r in rows]
    if not found:
        raise VendorError(f"no bars of {symbol}")
    return spark.createDataFrame(found, SCHEMA)


def download(spark: SparkSession, symbols: Sequence[str], start: str, end: str, factory: str, **options: str) -> DataFrame:
    """All windows of all symbols, read in parallel."""
    spark.dataSource.register(VendorSource)
    return spark.read.format("vendor_bars").options(symbols=",".join(symbols), start=start, end=end, factory=factory, **options).load()


def download_chunks(
    chunks: ChunkStore, client: Client, symbols: Sequence[str], start: dt.datetime, end: dt.datetime, days: int = 30, pace: float = 11.0, sleep: Callable[[float], None] = time.sleep, **retry: float
) -> list[tuple[str, dt.date]]:
    """Request the windows that have no chunk yet, one at a time and paced, latest first; returns those requested."""
    asked: list[tuple[str, dt.date]] = []
    for symbol in symbols:
        for begin, until in windows(start, end, days):
            if chunks.has(symbol, until.date()):
                continue
            if asked:
                sleep(pace)
            rows = with_retry(lambda s=symbol, a=begin, b=until: fetch(client, s, a, b), sleep=sleep, **retry)
            chunks.write(bars_frame(chunks.spark, symbol, rows), symbol, until.date(), {"symbol": symbol, "start": begin.isoformat(), "end": until.isoformat()})
            asked.append((symbol, until.date()))
    return asked


def repair_plan(missing: DataFrame, limit: int = 20) -> list[dt.date]:
    """The first session dates that lack minutes, at most ``limit`` of them a run."""
    return [r[0] for r in missing.select("session_date").distinct().orderBy("session_date").limit(limit).collect()]


def repair_sessions(chunks: ChunkStore, client: Client, symbol: str, missing: DataFrame, limit: int = 20, pace: float = 11.0, sleep: Callable[[float], None] = time.sleep, **retry: float) -> list[dt.date]:
    """Request whole sessions that lack minutes again and keep them as repairs; a session that was repaired before is left alone."""
    todo = [d for d in repair_plan(missing, limit) if not chunks.has(symbol, d, repair=True)]
    for n, day in enumerate(todo):
        if n:
            sleep(pace)
        begin = dt.datetime.combine(day, dt.time())
        rows = with_retry(lambda a=begin: fetch(client, symbol, a, a + dt.timedelta(days=1)), sleep=sleep, **retry)
        chunks.write(bars_frame(chunks.spark, symbol, rows), symbol, day, {"symbol": symbol, "session": day.isoformat(), "reason": "missing minutes"}, repair=True)
    return todo
