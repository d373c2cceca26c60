"""A search interface as a Spark data source: pages of results, with a cap, pauses and retries.

No client comes with the library. The option `client` names a function, `module:function`, that takes a query, a sort
order, a first place and a page size and gives a list of dictionaries with the fields of the dataset's rows.
"""

from __future__ import annotations

import importlib
import time
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader

from vellumflow.schemas import DATASET

NAME = "vellumflow_search"
# The largest page, the pause between requests in seconds, attempts, and the two orders.
PAGE, PAUSE, ATTEMPTS = 100, 3.0, 3
SUBMITTED, UPDATED = "submittedDate ascending", "lastUpdatedDate descending"


def search_query(categories: list[str], start: object = None, end: object = None) -> str:
    """The words of a search: any of the categories, and submission within two minutes, both included."""
    if not categories:
        raise ValueError("at least one category is needed")
    either = " OR ".join(f"cat:{c}" for c in categories)
    if start is None or end is None:
        return either
    return f"({either}) AND submittedDate:[{start:%Y%m%d%H%M} TO {end:%Y%m%d%H%M}]"


class _Reader(DataSourceReader):
    def __init__(self, fields: list[str], options: dict[str, str]):
        self.fields, self.options = fields, options

    def read(self, partition) -> Iterator[tuple]:
        module, _, name = self.options["client"].partition(":")
        client = getattr(importlib.import_module(module), name)
        cap, pause = int(self.options["cap"]), float(self.options.get("pause", PAUSE))
        at = 0
        # One row beyond the cap tells that there are more.
        while at <= cap:
            size = min(PAGE, cap + 1 - at)
            rows = self._page(client, at, size, pause)
            for row in rows:
                yield tuple(row.get(f) for f in self.fields)
            at += len(rows)
            if len(rows) < size:
                return
            if at <= cap:
                time.sleep(pause)

    def _page(self, client, at: int, size: int, pause: float) -> list[dict]:
        for attempt in range(1, ATTEMPTS + 1):
            try:
                return client(self.options["query"], self.options.get("sort", SUBMITTED), at, size)
            except OSError:
                if attempt == ATTEMPTS:
                    raise
                time.sleep(pause)
        raise AssertionError


class SearchSource(DataSource):
    """Options: client, query, cap (one row more is read), sort, pause."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return DATASET

    def reader(self, schema) -> DataSourceReader:
        return _Reader(schema.names, dict(self.options))


def search(spark: SparkSession, client: str, query: str, cap: int, sort: str = SUBMITTED, pause: float = PAUSE) -> DataFrame:
    """Up to cap + 1 rows of a search, in its order; capped() says whether there were more than cap."""
    spark.dataSource.register(SearchSource)
    return spark.read.format(NAME).options(client=client, query=query, cap=str(cap), sort=sort, pause=str(pause)).load()
