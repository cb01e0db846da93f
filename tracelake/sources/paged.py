"""A paged service as a Spark data source, over an injected client.

``client(kind, page, limit)`` returns one page of rows (dicts), an empty one behind the last. As a stream the source goes on behind
the rows it has read, for services that only append. ``read_pages`` reads the first
pages, as many as it is told, each as a partition; ``read_all`` reads on until there are no more. A failing page is tried
again and then skipped with its error as a row, so one bad page does not cost the others.
"""

from __future__ import annotations

import itertools
import json
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

Client = Callable[[str, int, int], list[dict]]
SCHEMA = "kind string, page int, payload string, error string"
TRIES = 3
LANES = 8  # partitions of a full read, that is calls at a time


class _Page(InputPartition):
    def __init__(self, page: int):
        super().__init__(page)
        self.page = page


class _Reader(DataSourceReader):
    def __init__(self, client: Client, kind: str, pages: int, limit: int):
        self.client, self.kind, self.pages, self.limit = client, kind, pages, limit

    def partitions(self) -> list[_Page]:
        return [_Page(n) for n in range(1, self.pages + 1)]

    def page(self, page: int) -> tuple[list[dict], str | None]:
        """The rows of a page, or what its last try failed with."""
        for n in range(TRIES):
            try:
                return self.client(self.kind, page, self.limit), None
            except Exception as e:
                if n == TRIES - 1:
                    return [], str(e)[:200]

    def rows(self, page: int, rows: list[dict]) -> Iterator[tuple]:
        for row in rows:
            yield self.kind, page, json.dumps(row, ensure_ascii=False), None

    def read(self, partition: _Page) -> Iterator[tuple]:
        rows, error = self.page(partition.page)
        if error is not None:
            yield self.kind, partition.page, None, error
        yield from self.rows(partition.page, rows)


class _FullReader(_Reader):
    """Lane n reads the pages n, n + LANES, ... until one is empty; the end needn't be known.

    A failing page can't tell whether it is behind the end: the lane goes on, and gives up, with an error row that says so,
    after TRIES failing pages on end.
    """

    def partitions(self) -> list[_Page]:
        return [_Page(n) for n in range(1, LANES + 1)]

    def read(self, partition: _Page) -> Iterator[tuple]:
        page, failed = partition.page, 0
        while failed < TRIES:
            rows, error = self.page(page)
            if error is not None:
                failed += 1
                yield self.kind, page, None, error
            elif not rows:
                return
            else:
                failed = 0
                yield from self.rows(page, rows)
            page += LANES
        yield self.kind, page, None, f"given up: this page and every {LANES}th behind it were not read"


class _Slice(InputPartition):
    """Rows ``low`` to ``high`` (from 0, the last one not included) of one page."""

    def __init__(self, page: int, low: int, high: int):
        super().__init__(page)
        self.page, self.low, self.high = page, low, high


class _StreamReader(DataSourceStreamReader):
    """The offset is the number of rows read. The end of the service is found by doubling and halving page numbers, so a batch
    costs the driver about log(pages) calls; the pages themselves are read by the tasks. A page that fails ends its batch, which is
    then tried again from its own offset: an append-only cursor can't leave rows out.
    """

    def __init__(self, client: Client, kind: str, limit: int):
        self.reader, self.limit, self.seen = _Reader(client, kind, 0, limit), limit, 0

    def initialOffset(self) -> dict:
        return {"rows": 0}

    def _page(self, page: int) -> list[dict]:
        rows, error = self.reader.page(page)
        if error is not None:
            raise RuntimeError(f"page {page}: {error}")
        return rows

    def latestOffset(self) -> dict:
        """Rows there are: the last page that holds any, by search from the page of the last call on."""
        full, empty = self.seen // self.limit, None  # pages known to hold a full set, a page known to be empty
        step = 1
        while empty is None:
            n = len(self._page(full + step))
            if n == self.limit:
                full, step = full + step, step * 2
            elif n:
                self.seen = (full + step - 1) * self.limit + n
                return {"rows": self.seen}
            else:
                empty = full + step
        while empty - full > 1:
            page = (full + empty) // 2
            n = len(self._page(page))
            if n == self.limit:
                full = page
            elif n:
                self.seen = (page - 1) * self.limit + n
                return {"rows": self.seen}
            else:
                empty = page
        self.seen = max(self.seen, full * self.limit)
        return {"rows": self.seen}

    def partitions(self, start: dict, end: dict) -> list[_Slice]:
        a, b, limit = start["rows"], end["rows"], self.limit
        return [_Slice(k + 1, max(a - k * limit, 0), min(b - k * limit, limit)) for k in range(a // limit, -(-b // limit))]

    def read(self, partition: _Slice) -> Iterator[tuple]:
        yield from self.reader.rows(partition.page, self._page(partition.page)[partition.low : partition.high])

    def commit(self, end: dict) -> None:
        pass


def paged_source(client: Client, name: str = "paged") -> type[DataSource]:
    """A data source class to be registered with ``spark.dataSource.register``; options: kind, pages (all without it), limit."""

    class Paged(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema) -> _Reader:
            kind, pages, limit = self.options.get("kind", "traces"), self.options.get("pages"), int(self.options.get("limit", 50))
            return _Reader(client, kind, int(pages), limit) if pages else _FullReader(client, kind, 0, limit)

        def streamReader(self, schema) -> _StreamReader:
            return _StreamReader(client, self.options.get("kind", "traces"), int(self.options.get("limit", 50)))

    return Paged


_names = itertools.count(1)


def _reader_of(spark: SparkSession, client: Client):
    """A reader of this client alone: names are registered for the whole session, so each client gets its own."""
    name = f"paged_{next(_names)}"
    spark.dataSource.register(paged_source(client, name))
    return spark.read.format(name)


def read_pages(spark: SparkSession, client: Client, kind: str, pages: int, limit: int = 50) -> DataFrame:
    return _reader_of(spark, client).options(kind=kind, pages=str(pages), limit=str(limit)).load()


def read_all(spark: SparkSession, client: Client, kind: str, limit: int = 50) -> DataFrame:
    """All pages of a service."""
    return _reader_of(spark, client).options(kind=kind, limit=str(limit)).load()


def stream_pages(spark: SparkSession, client: Client, kind: str, limit: int = 50) -> DataFrame:
    """The rows of a service that only appends, as a stream."""
    name = f"paged_{next(_names)}"
    spark.dataSource.register(paged_source(client, name))
    return spark.readStream.format(name).options(kind=kind, limit=str(limit)).load()
