"""A paged service as a stream: pages are read until one is empty, and later triggers go on from there.

    spark.dataSource.register(PagedStream)
    spark.readStream.format("paged_stream").option("url", "https://host/items?page={page}&per_page={size}").load()

The service needn't say how many pages it has. The offset is a page and a place
in it, so that rows that are added to a short last page come with the next
trigger, and none comes twice. The driver only looks where the pages end;
executors read the rows, a few pages for each partition. ``file://`` templates
read saved pages.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition


class Pages:
    """Pages of a service, with retries, and waits where it limits the rate."""

    def __init__(self, options: dict):
        self.url = options["url"]
        self.size = int(options.get("page_size", 100))
        self.items = options.get("items")
        self.first = int(options.get("first_page", 1))
        self.tries = int(options.get("tries", 3))
        self.wait = float(options.get("wait_seconds", 1))
        self.most_wait = float(options.get("most_wait_seconds", 3600))
        self.token = options.get("token")

    def limited(self, error: urllib.error.HTTPError) -> float | None:
        """Seconds to wait before the service answers again; None if it doesn't say that its rate is limited."""
        if error.code not in (403, 429):
            return None
        after, reset = error.headers.get("Retry-After"), error.headers.get("X-RateLimit-Reset")
        if after and after.isdigit():
            return float(after)
        if reset and reset.isdigit() and error.headers.get("X-RateLimit-Remaining", "0") == "0":
            return max(0.0, float(reset) - time.time())
        return 60.0 if error.code == 429 else None

    def page(self, number: int) -> list:
        """The rows of a page; a page that isn't there is empty. Waiting for the rate uses up no try."""
        request = urllib.request.Request(self.url.format(page=number, size=self.size), headers={"Authorization": f"token {self.token}"} if self.token else {})  # noqa: S310
        n, waited = 0, 0.0
        while True:
            try:
                with urllib.request.urlopen(request, timeout=60) as answer:  # noqa: S310
                    found = json.load(answer)
                return found.get(self.items, []) if self.items else found
            except urllib.error.HTTPError as error:
                if error.code in (404, 422):
                    return []
                pause = self.limited(error)
                if pause is not None and waited + pause <= self.most_wait:
                    waited += pause
                    time.sleep(pause)
                    continue
                n += 1
                if n >= self.tries:
                    raise
            except OSError as error:
                if isinstance(getattr(error, "reason", error), FileNotFoundError):
                    return []
                n += 1
                if n >= self.tries:
                    raise
            time.sleep(self.wait * 2 ** (n - 1))


class PageRange(InputPartition):
    """Pages from ``first`` to ``last``: the first from row ``skip`` on, the last up to row ``stop``."""

    def __init__(self, first: int, last: int, skip: int, stop: int | None):
        self.first, self.last, self.skip, self.stop = first, last, skip, stop


class PagedStreamReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.pages = Pages(options)
        self.per_trigger = int(options.get("pages_per_trigger", 1000))
        self.each = int(options.get("pages_per_partition", 10))
        self.at: dict | None = None

    def initialOffset(self) -> dict:  # noqa: N802
        return {"page": self.pages.first, "row": 0}

    def latestOffset(self, start: dict | None = None, limit: object = None) -> dict:  # noqa: N802
        """Where the pages end now, or ``pages_per_trigger`` pages on.

        Full pages are passed by doubling steps and then halving, as no page
        after a short one has rows.
        """
        at = dict(start or self.at or self.initialOffset())
        most = at["page"] + self.per_trigger

        def size(page: int) -> int:
            return len(self.pages.page(page))

        here, step = at["page"], 1
        if size(here) < self.pages.size:
            end = {"page": here, "row": max(at["row"], size(here))}
        else:
            full = here  # is full; look for the first page that isn't
            while full + step < most and size(full + step) >= self.pages.size:
                full, step = full + step, step * 2
            high = min(full + step, most)
            while high - full > 1:
                middle = (full + high) // 2
                full, high = (middle, high) if size(middle) >= self.pages.size else (full, middle)
            end = {"page": high, "row": 0 if high >= most else size(high)}
        self.at = end
        return end

    def partitions(self, start: dict, end: dict) -> list[PageRange]:
        last = end["page"] if end["row"] else end["page"] - 1
        return [
            PageRange(a, min(a + self.each - 1, last), start["row"] if a == start["page"] else 0, end["row"] if min(a + self.each - 1, last) == end["page"] else None)
            for a in range(start["page"], last + 1, self.each)
        ]

    def read(self, partition: PageRange) -> Iterator[tuple]:
        for page in range(partition.first, partition.last + 1):
            skip = partition.skip if page == partition.first else 0
            stop = partition.stop if page == partition.last else None
            for position, item in enumerate(self.pages.page(page)[:stop]):
                if position >= skip:
                    yield page, position, json.dumps(item, ensure_ascii=False)

    def commit(self, end: dict) -> None:
        pass


class PagedStream(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged_stream"

    def schema(self) -> str:
        return "page int, position int, value string"

    def streamReader(self, schema: object) -> PagedStreamReader:  # noqa: N802
        return PagedStreamReader(self.options)
