"""Rows that are only handed out in pages, read by several tasks."""

from __future__ import annotations

import base64
import bisect
import itertools
import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# A page is fetched by (offset, limit) and holds rows in the order of the columns. The rows of one
# pull must lie in a fixed order.
Fetch = Callable[[int, int], Sequence[tuple]]


@dataclass
class Stride(InputPartition):
    first: int


class PagedReader(DataSourceReader):
    """Task ``k`` of ``n`` reads the pages ``k``, ``k + n`` and so on up to its first short page.

    Behind a short page all pages are empty, so no task needs to know how many there are, and every
    row is read once. A page that fails is asked for again a few times, a lost task starts over.
    """

    def __init__(self, fetch: Fetch, offset: int, limit: int, tasks: int, attempts: int):
        self.fetch, self.offset, self.limit = fetch, offset, limit
        self.tasks, self.attempts = tasks, attempts

    def partitions(self) -> list[Stride]:
        return [Stride(k) for k in range(self.tasks)]

    def page(self, number: int) -> Sequence[tuple]:
        for attempt in range(1, self.attempts + 1):
            try:
                return self.fetch(self.offset + number * self.limit, self.limit)
            except OSError:
                if attempt == self.attempts:
                    raise
                time.sleep(0.05 * 2 ** attempt)
        return ()

    def read(self, partition: Stride) -> Iterator[tuple]:
        number = partition.first
        while True:
            rows = self.page(number)
            yield from (tuple(r) for r in rows)
            if len(rows) < self.limit:
                return
            number += self.tasks


class Paged(DataSource):
    """``format("paged")``, set up by :func:`read_pages`."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def reader(self, schema: T.StructType) -> PagedReader:
        fetch = cloudpickle.loads(base64.b64decode(self.options["fetch"]))
        return PagedReader(fetch, *(int(self.options[k]) for k in (
            "offset", "limit", "tasks", "attempts")))


def read_pages(spark: SparkSession, fetch: Fetch, schema: T.StructType | str, limit: int = 1_000,
               offset: int = 0, tasks: int = 8, attempts: int = 4) -> DataFrame:
    """All rows from ``offset`` on, in pages of ``limit`` rows; OSErrors of a page are retried.

    To resume a pull, pass the number of rows already stored as ``offset``.
    """
    if limit < 1 or tasks < 1 or offset < 0:
        raise ValueError("limit and tasks are at least 1, offset at least 0")
    spark.dataSource.register(Paged)
    options = {"fetch": base64.b64encode(cloudpickle.dumps(fetch)).decode(), "offset": offset,
               "limit": limit, "tasks": tasks, "attempts": attempts}
    return spark.read.format("paged").schema(schema).options(**options).load()


class ParquetPages:
    """Pages of the Parquet files at ``path`` in the order of their names, for :func:`read_pages`.

    A page reads the row groups in which it lies, and the last of them stays for the next page: a task
    reads every row group once at most, however many pages there are.
    """

    def __init__(self, path: str, columns: Sequence[str]):
        self.path, self.columns = path, list(columns)
        self.starts: list[int] = []

    def __getstate__(self) -> dict:
        return {"path": self.path, "columns": self.columns, "starts": []}

    def read(self, group: int) -> pa.Table:
        return self.groups[group].to_table(columns=self.columns)

    def __call__(self, offset: int, limit: int) -> list[tuple]:
        if not self.starts:
            self.groups = [g for f in pq.ParquetDataset(self.path).fragments
                           for g in f.split_by_row_group()]
            sizes = [g.row_groups[0].num_rows for g in self.groups]
            self.starts, self.held = [0, *itertools.accumulate(sizes)], (-1, None)
        rows: list[tuple] = []
        group = bisect.bisect_right(self.starts, offset) - 1
        while len(rows) < limit and group < len(self.groups):
            if self.held[0] != group:
                self.held = (group, self.read(group))
            page = self.held[1].slice(offset + len(rows) - self.starts[group], limit - len(rows))
            rows += zip(*(page.column(c).to_pylist() for c in self.columns))
            group += 1
        return rows
