"""Paged services: pages that grow between triggers, rate limits, and where pages end."""

from __future__ import annotations

import http.server
import json
import threading
import time

import pytest

from lodestone.sources import files
from lodestone.sources.paged_stream import PagedStream, PagedStreamReader, Pages


def save(folder, rows, size):  # noqa: ANN001, ANN201
    for p in range(-(-len(rows) // size)):
        (folder / f"{p + 1}.json").write_text(json.dumps({"items": rows[p * size : (p + 1) * size]}))


def options(folder, **more):  # noqa: ANN001, ANN003, ANN201
    return {"url": f"file://{folder}/{{page}}.json", "page_size": "3", "items": "items", "wait_seconds": "0.01", **more}


def test_no_row_is_lost_or_repeated(spark, tmp_path):  # noqa: ANN001
    spark.dataSource.register(PagedStream)
    (tmp_path / "pages").mkdir()
    rows = [{"id": i} for i in range(40)]
    total = 0
    for n in (0, 2, 2, 7, 9, 10, 40):  # empty, short, unchanged, longer, full last page, just over it, many pages
        save(tmp_path / "pages", rows[:n], 3)
        stream = spark.readStream.format("paged_stream").options(**options(tmp_path / "pages", pages_per_partition="2")).load()
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
        if (tmp_path / "out").exists() and n:
            got = sorted(json.loads(r["value"])["id"] for r in spark.read.schema("page int, position int, value string").parquet(str(tmp_path / "out")).collect())
            assert got == list(range(n))
            total = len(got)
    assert total == 40


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 6, 29, 30, 31])
def test_where_pages_end(tmp_path, n):  # noqa: ANN001
    save(tmp_path, [{"id": i} for i in range(n)], 3)
    reader = PagedStreamReader(options(tmp_path, pages_per_partition="4"))
    end = reader.latestOffset()
    got = [json.loads(v)["id"] for p in reader.partitions(reader.initialOffset(), end) for _, _, v in reader.read(p)]
    assert got == list(range(n)) and reader.latestOffset() == end
    few, seen = PagedStreamReader(options(tmp_path, pages_per_trigger="2")), []
    at = few.initialOffset()
    for _ in range(8):
        end = few.latestOffset(at)
        seen += [json.loads(v)["id"] for p in few.partitions(at, end) for _, _, v in few.read(p)]
        at = end
    assert seen == list(range(n))


def test_rate_limits_and_failures(tmp_path):  # noqa: ANN001
    answers = [(429, {"Retry-After": "0"}), (403, {"X-RateLimit-Remaining": "0", "X-RateLimit-Reset": str(int(time.time()))}), (500, {}), (200, {}), (404, {}), (403, {}), (403, {}), (403, {})]

    class Service(http.server.BaseHTTPRequestHandler):
        def do_GET(self) -> None:  # noqa: N802
            code, headers = answers.pop(0)
            self.send_response(code)
            for k, v in headers.items():
                self.send_header(k, v)
            self.end_headers()
            self.wfile.write(b"[1, 2]" if code == 200 else b"")

        def log_message(self, *_: object) -> None:
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        pages = Pages({"url": f"http://127.0.0.1:{server.server_port}/?page={{page}}", "wait_seconds": "0.01"})
        assert pages.page(1) == [1, 2] and pages.page(2) == []
        with pytest.raises(OSError):
            pages.page(3)
        assert not answers
    finally:
        server.shutdown()


def test_all_repository_fields(spark):  # noqa: ANN001
    row = {
        "id": 7, "name": "n", "full_name": "o/n", "description": None, "html_url": "h", "clone_url": "c", "ssh_url": "s", "language": "Python", "stargazers_count": 3, "forks_count": 2, "watchers_count": 1,
        "open_issues_count": 4, "created_at": "2024-01-02T03:04:05Z", "updated_at": "2024-01-02T03:04:05Z", "pushed_at": None, "size": 9, "owner": {"login": "o", "id": 1}, "private": False, "archived": True, "disabled": False,
    }
    r = files.decoded_repositories(spark.createDataFrame([(json.dumps(row),)], "value string")).first()
    assert (r["clone_url"], r["ssh_url"], r["watchers_count"], r["open_issues_count"], r["size"], r["disabled"], r["topics"], r["pushed_at"]) == ("c", "s", 1, 4, 9, False, [], None)
