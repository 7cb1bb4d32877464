"""Row groups read through one handle a file, each committed by itself, so a broken read goes on where it stopped."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import ship
from tidemark.sources.fetched import Fetcher, open_uri
from tidemark.sources.readers import retried

#: Called with (file, row group, table); the table that it returns is kept, None stops the file after this group.
Callback = Callable[[str, int, pa.Table], pa.Table | None]


def committed(store: fs.FileSystem, folder: str) -> set[str]:
    found = store.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    return {f.base_name for f in found if not f.base_name.startswith(".")}


def commit(store: fs.FileSystem, folder: str, name: str, table: pa.Table) -> None:
    """Write under a hidden name, then give the file its name: it is there whole or not at all."""
    hidden = f"{folder}/.{name}-{uuid.uuid4().hex}"
    with store.open_output_stream(hidden) as out:
        pq.write_table(table, out)
    store.move(hidden, f"{folder}/{name}")


def file_key(path: str) -> str:
    import hashlib

    return hashlib.sha256(path.encode()).hexdigest()[:24]


def process_groups(spark: SparkSession, paths: list[str], columns: list[str], callback: Callback, state: str, fetcher: Fetcher = open_uri, attempts: int = 4, wait: float = 0.5) -> DataFrame:
    """(path, row_group, n_rows, stopped) of the row groups read by this call; what the callback keeps lies in ``state``.

    Each file is read by one task through one handle, group after group; a read
    that fails with an OSError opens the file anew and goes on with the group at
    hand. The callback runs on whole groups; its own errors end the task and are
    not tried again here. Each group is committed to the folder ``state`` (a URI
    all executors share) before the next is read: a later call with the same
    state, and Spark's own retry of a task, skip what is committed and files that
    the callback has stopped. Files are spread over the tasks, so the slowest
    takes one file.
    """
    ship(spark)
    schema = "path string, row_group int, n_rows bigint, stopped boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = fs.FileSystem.from_uri(state)
        store.create_dir(folder, recursive=True)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                key, done = file_key(path), committed(store, folder)
                if f"{key}.stopped" in done:
                    continue
                handle: list[pq.ParquetFile] = []

                def opened(path: str = path, handle: list = handle) -> pq.ParquetFile:
                    if not handle:
                        handle.append(pq.ParquetFile(fetcher(path)))
                    return handle[0]

                def attempt(operation, handle: list = handle):
                    def run_once():
                        try:
                            return operation()
                        except OSError:
                            handle.clear()
                            raise

                    return retried(run_once, attempts, wait)

                groups = attempt(lambda opened=opened: opened().metadata.num_row_groups)
                for number in range(groups):
                    name = f"{key}-{number:06d}.parquet"
                    if name in done:
                        continue
                    table = attempt(lambda opened=opened, number=number: opened().read_row_group(number, columns=columns))
                    kept = callback(path, number, table)
                    commit(store, folder, name, table.schema.empty_table() if kept is None else kept)
                    if kept is None:
                        commit(store, folder, f"{key}.stopped", pa.table({"row_group": [number]}))
                    yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([number], pa.int32()), pa.array([table.num_rows]), pa.array([kept is None])], ["path", "row_group", "n_rows", "stopped"])
                    if kept is None:
                        break

    files = spark.createDataFrame([(p,) for p in paths], "path string")
    return files.repartition(max(1, len(paths)), F.hash("path")).mapInArrow(run, schema)


def kept_rows(spark: SparkSession, state: str, schema) -> DataFrame:
    """All rows the callbacks have kept."""
    return spark.read.schema(schema).option("pathGlobFilter", "*.parquet").parquet(state)
