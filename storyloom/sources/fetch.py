"""Fetching as a data source: addresses in, one row for each out, failures too.

``spark.read.format("fetch")`` and ``spark.readStream.format("fetch")`` read the sources named in the option ``urls``, one a line,
split in partitions; ``addresses`` makes that option from a table of sources.  ``fetched`` reads the addresses of any DataFrame, however
many.  All make rows of ``FETCHED``: what a source brought, or why it brought nothing.  A source has a limit of time and of bytes, and so
many attempts; an error of a source is a row and never a failed task, so one slow or broken source holds nobody up.

Options: urls, timeout (seconds, 12), attempts (1), max_bytes (10 million), per_partition (addresses of one task, 16),
agent; for streams also every (seconds between two rounds over all sources, 300).  A stream fetches each source once in a round,
rounds follow the clock, and the checkpoint keeps the last one: a restart repeats none, and rounds missed while it was down are one.
"""

from __future__ import annotations

import gzip
import time
import urllib.error
import urllib.request
from collections.abc import Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

FETCHED = "url string, status int, body string, error string, attempts int, fetched_at timestamp"
SCHEMES = ("http://", "https://", "file:")
DEFAULTS = {"timeout": "12", "attempts": "1", "max_bytes": "10000000", "per_partition": "16", "agent": "storyloom/1.0", "every": "300"}


def _get(url: str, timeout: float, max_bytes: int, agent: str) -> tuple[int, str]:
    """status and text; the limit of time holds for the whole answer, not for each of its parts."""
    if not url.startswith(SCHEMES):
        raise ValueError("unknown scheme")
    end = time.monotonic() + timeout
    request = urllib.request.Request(url, headers={"User-Agent": agent, "Accept-Encoding": "gzip"})
    with urllib.request.urlopen(request, timeout=timeout) as answer:
        parts, size = [], 0
        while part := answer.read(1 << 16):
            size += len(part)
            if size > max_bytes:
                raise ValueError(f"more than {max_bytes} bytes")
            if time.monotonic() > end:
                raise TimeoutError("timed out")
            parts.append(part)
        raw = b"".join(parts)
        if answer.headers.get("Content-Encoding") == "gzip":
            raw = gzip.decompress(raw)
        return answer.status or 200, raw.decode(answer.headers.get_content_charset() or "utf-8", "replace")


def fetch_one(url: str, options: dict[str, str]) -> tuple:
    """A row of ``FETCHED``; attempts end with the first answer, of whatever status, or with the last error."""
    error, tried = "no attempt", 0
    for _ in range(max(1, int(options["attempts"]))):
        tried += 1
        try:
            status, body = _get(url, float(options["timeout"]), int(options["max_bytes"]), options["agent"])
            return url, status, body, None, tried, datetime.now(timezone.utc)
        except urllib.error.HTTPError as e:
            return url, e.code, None, f"status {e.code}", tried, datetime.now(timezone.utc)
        except Exception as e:  # whatever a source does is its own row
            error = f"{type(e).__name__}: {e}"
    return url, None, None, error[:500], tried, datetime.now(timezone.utc)


class Slice(InputPartition):
    def __init__(self, urls: list[str]):
        self.urls = urls


def _options(given: dict[str, str]) -> dict[str, str]:
    return DEFAULTS | {"urls": ""} | {k.lower(): v for k, v in given.items()}


def _listed(options: dict[str, str]) -> list[str]:
    return list(dict.fromkeys(u.strip() for u in options["urls"].split("\n") if u.strip()))


def addresses(sources: DataFrame, column: str = "url") -> str:
    """The option ``urls`` from a table of sources: a list of sites, as a desk has; addresses without such a bound go through ``fetched``."""
    return "\n".join(sorted(r[0] for r in sources.select(column).filter(f"{column} is not null").distinct().collect()))


def _slices(urls: list[str], size: int) -> list[InputPartition]:
    return [Slice(urls[k : k + size]) for k in range(0, len(urls), size)] or [Slice([])]


class Reader(DataSourceReader):
    def __init__(self, options: dict[str, str], urls: list[str]):
        self.options, self.urls = options, urls

    def partitions(self) -> list[InputPartition]:
        return _slices(self.urls, int(self.options["per_partition"]))

    def read(self, partition: Slice) -> Iterator[tuple]:
        for url in partition.urls:
            yield fetch_one(url, self.options)


class Rounds(DataSourceStreamReader):
    """An offset is the number of a round: the time divided by the time between two."""

    def __init__(self, options: dict[str, str], urls: list[str]):
        self.options, self.urls = options, urls

    def _round(self) -> int:
        return int(time.time() // float(self.options["every"]))

    def initialOffset(self) -> dict:
        return {"round": self._round() - 1}

    def latestOffset(self) -> dict:
        return {"round": self._round()}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return _slices(self.urls if end["round"] > start["round"] else [], int(self.options["per_partition"]))

    def read(self, partition: Slice) -> Iterator[tuple]:
        for url in partition.urls:
            yield fetch_one(url, self.options)

    def commit(self, end: dict) -> None:
        pass


class FetchSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fetch"

    def schema(self) -> str:
        return FETCHED

    def reader(self, schema) -> DataSourceReader:
        options = _options(self.options)
        return Reader(options, _listed(options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        options = _options(self.options)
        return Rounds(options, _listed(options))


def register(spark: SparkSession) -> SparkSession:
    """Makes the format known to the session."""
    spark.dataSource.register(FetchSource)
    return spark


def fetched(wanted: DataFrame, **options: str) -> DataFrame:
    """wanted: url -> rows of ``FETCHED``, one for each distinct address; the rows are spread before they are fetched."""
    found = DEFAULTS | {k: str(v) for k, v in options.items()}
    spread = wanted.select("url").filter("url is not null").distinct()

    def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for url in batch["url"]:  # a row at a time: bodies may be large
                yield pd.DataFrame([fetch_one(url, found)], columns=[c.split()[0] for c in FETCHED.split(", ")]).astype({"status": "Int32", "attempts": "int32"})

    return spread.mapInPandas(fetch, FETCHED)
