"""A Python data source whose bytes come from an injected fetcher.

``registered(spark, fetcher)`` makes ``spark.read.format(name)`` read Parquet
files by their row groups, one partition each, through ``fetcher(path)``, which
returns a seekable file. Columns and simple comparisons are pushed down: a row
group whose statistics exclude a filter is never opened. A fetch that fails with
an OSError is tried again by its task, through a new file; what a task has
yielded comes from one whole read, so nothing is repeated.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any, BinaryIO

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.pandas.types import from_arrow_schema

from tidemark.session import ship
from tidemark.sources.readers import retried

Fetcher = Callable[[str], BinaryIO]
#: Comparison -> whether a group of values from low to high can hold a match.
MAY_MATCH: dict[type, Callable[[Any, Any, Any], bool]] = {
    EqualTo: lambda low, high, v: low <= v <= high,
    GreaterThan: lambda low, high, v: high > v,
    GreaterThanOrEqual: lambda low, high, v: high >= v,
    LessThan: lambda low, high, v: low < v,
    LessThanOrEqual: lambda low, high, v: low <= v,
}


def open_uri(path: str) -> BinaryIO:
    """The default fetcher: any file system that Arrow knows by the path's scheme."""
    from pyarrow import fs

    at, inside = fs.FileSystem.from_uri(path)
    return at.open_input_file(inside)


def file_paths(spark: SparkSession, folder: str) -> list[str]:
    """The data files of a written folder, as Spark's own file systems list them."""
    return sorted(r.path for r in spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(folder).select("path").collect())


def may_match(group: pq.RowGroupMetaData, tests: list[tuple[str, str, Any]]) -> bool:
    """Whether the group's statistics leave a row for all of (column, comparison, value)."""
    kinds = {k.__name__: f for k, f in MAY_MATCH.items()}
    columns = {group.column(i).path_in_schema: group.column(i).statistics for i in range(group.num_columns)}
    for column, kind, value in tests:
        s = columns.get(column)
        if s is not None and s.has_min_max and not kinds[kind](s.min, s.max, value):
            return False
    return True


@dataclass
class Group(InputPartition):
    path: str
    number: int

    def __init__(self, path: str, number: int):
        super().__init__((path, number))
        self.path, self.number = path, number


class Reader(DataSourceReader):
    def __init__(self, paths: list[str], columns: list[str], fetcher: Fetcher, attempts: int, wait: float):
        self.paths, self.columns, self.fetcher, self.attempts, self.wait = paths, columns, fetcher, attempts, wait
        self.tests: list[tuple[str, str, Any]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Comparisons choose row groups; Spark still applies all filters to the rows."""
        for f in filters:
            if type(f) in MAY_MATCH and len(f.attribute) == 1 and not isinstance(f.value, (bytes, type(None))):
                self.tests.append((f.attribute[0], type(f).__name__, f.value))
            yield f

    def partitions(self) -> list[Group]:
        out = []
        for path in self.paths:
            meta = self.tried(lambda path=path: pq.ParquetFile(self.fetcher(path)).metadata)
            out += [Group(path, i) for i in range(meta.num_row_groups) if may_match(meta.row_group(i), self.tests)]
        return out

    def read(self, partition: Group) -> Iterator[pa.RecordBatch]:
        def whole() -> pa.Table:
            with self.fetcher(partition.path) as f:
                return pq.ParquetFile(f).read_row_group(partition.number, columns=self.columns)

        yield from self.tried(whole).select(self.columns).to_batches()

    def tried(self, operation):
        return retried(operation, self.attempts, self.wait)


def source(fetcher: Fetcher, name: str = "fetched") -> type[DataSource]:
    """The data source of a fetcher. Options: paths (one a line), columns (comma-joined; default all), attempts, wait (seconds before the second try)."""

    class Fetched(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def paths(self) -> list[str]:
            return [p for p in self.options.get("paths", "").split("\n") if p]

        def tries(self) -> tuple[int, float]:
            return int(self.options.get("attempts", 4)), float(self.options.get("wait", 0.5))

        def schema(self):
            first, *_ = self.paths()
            arrow = retried(lambda: pq.ParquetFile(fetcher(first)).schema_arrow, *self.tries())
            wanted = [c for c in self.options.get("columns", "").split(",") if c] or arrow.names
            return from_arrow_schema(pa.schema([arrow.field(c) for c in wanted]))

        def reader(self, schema) -> Reader:
            return Reader(self.paths(), schema.fieldNames(), fetcher, *self.tries())

    return Fetched


def registered(spark: SparkSession, fetcher: Fetcher = open_uri, name: str = "fetched") -> str:
    """Register the fetcher's source with the session; its format name."""
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(source(fetcher, name))
    return name
