"""Paged services as a Spark data source: pages are partitions, the client is injected."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from glosswork.operators.durable import ship

#: A client gives the rows of a page (from 0) as tuples, none beyond the last page.
Fetch = Callable[[int], list[tuple]]


def patient(fetch: Fetch, page: int, attempts: int, pause: float) -> list[tuple]:
    """The rows of a page; a call that fails is made again after a pause that doubles, ``attempts`` times in all."""
    for n in range(attempts):
        try:
            return list(fetch(page))
        except Exception as e:
            if n + 1 == attempts:
                raise OSError(f"page {page} failed {attempts} times: {e}") from e
            time.sleep(pause * 2**n)
    return []


def count_pages(fetch: Fetch, most: int) -> int:
    """How many pages come before the first empty one, ``most`` at most, from about twice the logarithm of that number of calls.

    Pages after an empty one are taken to be empty too.
    """
    full, empty = -1, 1
    while empty - 1 < most and fetch(empty - 1):
        full, empty = empty - 1, 2 * empty
    high = min(empty - 1, most)  # empty, or as far as we may go
    low = full + 1
    while low < high:
        mid = (low + high) // 2
        if fetch(mid):
            low = mid + 1
        else:
            high = mid
    return low


class Pages(InputPartition):
    def __init__(self, first: int, last: int) -> None:
        super().__init__(first)
        self.first, self.last = first, last


class PagedReader(DataSourceReader):
    """Counts the pages where the query is planned; each task reads some of them, and begins anew if its executor is lost."""

    def __init__(self, fetch: Fetch, options: dict) -> None:
        self.fetch, options = fetch, {k.lower(): v for k, v in options.items()}
        self.most, self.per_task = int(options.get("pages", 1 << 20)), max(1, int(options.get("pagespertask", 16)))
        self.attempts, self.pause = max(1, int(options.get("attempts", 4))), float(options.get("pause", 0.5))

    def partitions(self) -> list[InputPartition]:
        pages = count_pages(lambda page: patient(self.fetch, page, self.attempts, self.pause), self.most)
        return [Pages(i, min(i + self.per_task, pages)) for i in range(0, pages, self.per_task)] or [Pages(0, 0)]

    def read(self, partition: Pages) -> Iterator[tuple]:
        for page in range(partition.first, partition.last):
            rows = patient(self.fetch, page, self.attempts, self.pause)
            if not rows:  # the service lost pages since they were counted
                return
            yield from rows


def register(spark: SparkSession, name: str, fetch: Fetch, schema: str) -> None:
    """Make ``spark.read.format(name).load()`` read a paged service.

    ``fetch`` runs on the driver and on executors and is all that knows the service. Options: ``pages``, the most to read; ``pagesPerTask``; ``attempts`` for
    each call and the first ``pause`` between them, in seconds. The first empty page ends the table.
    """
    ship(spark)

    class Service(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return schema

        def reader(self, schema) -> DataSourceReader:  # noqa: ARG002
            return PagedReader(fetch, dict(self.options))

    spark.dataSource.register(Service)
