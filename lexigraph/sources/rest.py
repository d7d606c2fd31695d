"""A paginated REST source as a Python data source: pages of a service follow each other by token; a fetch is retried with growing pauses.

The fetcher is named by module and attribute, so that executors import it; tests and offline runs use `replay`, which serves a JSON folder-less fixture.
"""

from __future__ import annotations

import importlib
import json
import time

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def with_retry(fetch, tries: int = 3, pause: float = 0.0):
    """fetch's result; failures are retried, pausing twice as long each time."""
    def call(*args):
        for k in range(tries):
            try:
                return fetch(*args)
            except (OSError, ValueError):
                if k == tries - 1:
                    raise
                time.sleep(pause * 2**k)

    return call


def replay(query: str, token: str | None, size: int) -> dict:
    """Offline service: 120 items a query, in pages; the first call for every third page fails."""
    at = int(token or 0)
    key = (query, at)
    if at // size % 3 == 1 and key not in _failed:
        _failed.add(key)
        raise OSError("try again")
    items = [{"id": f"{query}-{i}", "text": f"item {i} of {query}"} for i in range(at, min(at + size, 120))]
    return {"items": items, "nextPageToken": str(at + size) if at + size < 120 else None}


_failed: set = set()


class Query(InputPartition):
    def __init__(self, query: str):
        self.query = query


class Reader(DataSourceReader):
    def __init__(self, options):
        self.queries = json.loads(options.get("queries", "[]"))
        self.size, self.most = int(options.get("page", 50)), int(options.get("most", 500))
        self.fetch = options.get("fetch", "lexigraph.sources.rest:replay")

    def partitions(self):
        return [Query(q) for q in self.queries]

    def read(self, partition):
        module, _, name = self.fetch.partition(":")
        fetch = with_retry(getattr(importlib.import_module(module), name))
        token, n = None, 0
        while n < self.most:
            page = fetch(partition.query, token, self.size)
            for item in page["items"][: self.most - n]:
                yield (partition.query, item["id"], item["text"])
                n += 1
            token = page.get("nextPageToken")
            if not token:
                return


class RestSource(DataSource):
    """spark.read.format("rest_pages"): options queries (JSON list), page, most, fetch ("module:function")."""

    @classmethod
    def name(cls):
        return "rest_pages"

    def schema(self):
        return "query string, id string, text string"

    def reader(self, schema):
        return Reader(self.options)
