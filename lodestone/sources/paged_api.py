"""A Python data source for paged REST services: one partition for each run of pages.

    spark.dataSource.register(PagedSource)
    spark.read.format("paged").option("url", "https://host/items?page={page}&per_page={size}").load()

Pages stay in their partition, so Spark fetches them in parallel; a page is
retried, and a short page ends the partition. The template may also hold
{start}, {query}, {sort} and {order}; with ``max_results`` no more rows come,
and so many pages are asked for. ``file://`` templates read saved answers.
"""

from __future__ import annotations

import json
import time
import urllib.parse
import urllib.request
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class PageRange(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class PagedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.url = options["url"]
        self.size = int(options.get("page_size", 100))
        most = options.get("max_results")
        self.most = int(most) if most else None
        self.pages = int(options.get("pages", -(-self.most // self.size) if self.most else 1))
        self.asked = {k: urllib.parse.quote(options.get(k, "")) for k in ("query", "sort", "order")}
        self.each = int(options.get("pages_per_partition", 10))
        self.items = options.get("items")
        self.tries = int(options.get("tries", 3))
        self.wait = float(options.get("wait_seconds", 1))

    def partitions(self) -> list[PageRange]:
        return [PageRange(a, min(a + self.each, self.pages + 1)) for a in range(1, self.pages + 1, self.each)]

    def _page(self, page: int) -> list:
        url = self.url.format(page=page, size=self.size, start=(page - 1) * self.size, **self.asked)
        for n in range(self.tries):
            try:
                with urllib.request.urlopen(url, timeout=60) as answer:  # noqa: S310
                    found = json.load(answer)
                return found[self.items] if self.items else found
            except OSError:
                if n + 1 == self.tries:
                    raise
                time.sleep(self.wait * 2**n)
        return []

    def read(self, partition: PageRange) -> Iterator[tuple]:
        for page in range(partition.first, partition.last):
            found = self._page(page)
            if self.most is not None:
                found = found[: max(0, self.most - (page - 1) * self.size)]
            for position, item in enumerate(found):
                yield page, position, json.dumps(item, ensure_ascii=False)
            if len(found) < self.size:
                return


class PagedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "page int, position int, value string"

    def reader(self, schema: object) -> PagedReader:
        return PagedReader(self.options)
