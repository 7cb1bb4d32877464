"""Scans with the strictness each format needs."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable
from typing import TypeVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


T = TypeVar("T")


class EmptySource(ValueError):
    """A scan that must not be empty found nothing."""


def not_empty(df: DataFrame, what: str) -> DataFrame:
    if df.isEmpty():
        raise EmptySource(what)
    return df


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """One JSON object per line; blank lines are skipped, a malformed line fails the job."""
    return not_empty(spark.read.schema(schema).option("mode", "FAILFAST").json(path), path)


def read_jsonl_strict(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """As S1, and blank lines, non-objects and repeated keys fail as well."""
    from tidemark.functions.text import has_duplicate_keys_udf

    lines = not_empty(spark.read.text(path), path)
    bad = F.when(F.trim("value") == "", "blank line").when(~F.trim("value").startswith("{"), "not an object").when(has_duplicate_keys_udf("value"), "repeated key")
    checked = lines.withColumn("value", F.when(bad.isNotNull(), F.raise_error(F.concat(bad, F.lit(f" in {path}"))).cast("string")).otherwise(F.col("value")))
    return checked.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def file_states(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """Name, size and time of change of the files of a path, empty ones too; contents aren't read."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files, out = at.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(at, True), []
    while files.hasNext():
        f = files.next()
        if f.getPath().getName()[0] not in "._":
            out.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return sorted(out)


def unfinished(spark: SparkSession, path: str) -> list[str]:
    """Files that are empty or whose last byte isn't a newline; each task reads one byte of its files."""

    def last(batches):
        from pyarrow import fs

        for batch in batches:
            bad = []
            for name, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                at, inside = fs.FileSystem.from_uri(name)
                if size:
                    with at.open_input_file(inside) as f:
                        f.seek(size - 1)
                        if f.read(1) == b"\n":
                            continue
                bad.append(name)
            yield pa.RecordBatch.from_arrays([pa.array(bad, pa.string())], ["path"])

    files = spark.createDataFrame([s[:2] for s in file_states(spark, path)], "path string, length bigint")
    return sorted(r.path for r in files.mapInArrow(last, "path string").collect())


def scanned_strictly(spark: SparkSession, path: str, schema: StructType | str, use: Callable[[DataFrame], T]) -> T:
    """``use`` of the rows of ``read_jsonl_strict``, after checking that each file ends with a newline, and before that none has changed meanwhile."""
    before = file_states(spark, path)
    if bad := unfinished(spark, path):
        raise ValueError(f"no newline at the end of {bad[0]}")
    out = use(read_jsonl_strict(spark, path, schema))
    if file_states(spark, path) != before:
        raise ValueError(f"{path} changed while it was read")
    return out


def read_csv_exact(spark: SparkSession, path: str, schema: StructType, separator: str = ",") -> DataFrame:
    """A header that must equal the schema's field names, in order."""
    header = spark.read.option("header", True).option("sep", separator).csv(path).columns
    if header != schema.fieldNames():
        raise ValueError(f"{path} has the fields {header}")
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("sep", separator).option("mode", "FAILFAST").csv(path)


def unique(df: DataFrame, *keys: str) -> DataFrame:
    """The rows, after checking that no key repeats."""
    twice = df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").limit(1).collect()
    if twice:
        raise ValueError(f"repeated key {twice[0]}")
    return df


def read_strong_labels(spark: SparkSession, classes: str, events: dict[str, str]) -> DataFrame:
    """Events of all splits with their class's display name; non-positive ones dropped, an unknown class fails.

    The class table is broadcast only if Spark finds it small enough.
    """
    known = unique(spark.read.option("header", True).csv(classes).select("mid", "display"), "mid")
    parts = [spark.read.option("header", True).csv(p).withColumn("split", F.lit(s)) for s, p in events.items()]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    typed = every.withColumns({"onset": F.col("onset").cast("double"), "off": F.col("off").cast("double")}).where("off > onset")
    missing = typed.join(known, "mid", "left_anti").select("mid").limit(1).collect()
    if missing:
        raise ValueError(f"unknown class {missing[0].mid}")
    return typed.join(known, "mid")


def read_hierarchy(spark: SparkSession, path: str) -> DataFrame:
    """(parent, child, depth) of all descendants from a JSON array of {id, child_ids}."""
    from tidemark.operators.joins import closure

    nodes = spark.read.option("multiLine", True).json(path)
    return closure(nodes.select(F.col("id").alias("parent"), F.explode("child_ids").alias("child")))


def read_allowed(spark: SparkSession, path: str, columns: list[str], allow: DataFrame, key: str) -> DataFrame:
    """Chosen columns of allowed rows with their file and row number; pruning and the key reach the scan."""
    scan = spark.read.parquet(path).select(*columns, F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.row_index").alias("row_index"))
    return scan.join(allow.select(key).distinct(), key, "left_semi")


def row_groups(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Rows and compressed bytes of each row group, from the footers alone.

    Paths are dealt to tasks, which open each file at its end; no data page is
    read. Files must lie where pyarrow's file systems reach them (a shared
    folder, HDFS, an object store).
    """
    import pyarrow.parquet as pq
    from pyarrow import fs

    def inspect(batches):
        for batch in batches:
            out: list[tuple] = []
            for path in batch.column(0).to_pylist():
                place, at = fs.FileSystem.from_uri(path)

                def footer(place=place, at=at):
                    with place.open_input_file(at) as f:
                        return pq.read_metadata(f)

                meta = retried(footer)
                out += [(path, i, meta.row_group(i).num_rows, sum(meta.row_group(i).column(k).total_compressed_size for k in range(meta.num_columns))) for i in range(meta.num_row_groups)]
            cols = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.string(), pa.int32(), pa.int64(), pa.int64()])], ["path", "row_group", "n_rows", "n_bytes"])

    files = sorted({f if "://" in f or f.startswith("file:") else f"file://{f}" for p in paths for f in spark.read.parquet(p).inputFiles()})
    return spark.createDataFrame([(f.replace("file:///", "/") if f.startswith("file:///") else f,) for f in files], "path string").repartition(max(1, min(len(files), 1000))).mapInArrow(inspect, "path string, row_group int, n_rows bigint, n_bytes bigint")


def read_list(spark: SparkSession, path: str) -> DataFrame:
    """Lines '<split>/sound/<number>.wav', each number once."""
    rx = r"^([a-z]+)/sound/([0-9]+)\.wav$"
    lines = not_empty(spark.read.text(path), path)
    parsed = lines.select(F.when(F.col("value").rlike(rx), F.col("value")).otherwise(F.raise_error(F.concat(F.lit("bad line: "), "value")).cast("string")).alias("path"))
    out = parsed.select("path", F.regexp_extract("path", rx, 1).alias("split"), F.regexp_extract("path", rx, 2).cast("bigint").alias("id"))
    return unique(out, "id")


def zip_members(archives: DataFrame) -> DataFrame:
    """(archive, member, size, crc, content) of rows (path, content); a wrong checksum fails."""

    def members(batches):
        for batch in batches:
            out: list[tuple] = []
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    out += [(name, i.filename, i.file_size, i.CRC, z.read(i)) for i in z.infolist() if not i.is_dir()]
            cols = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()])], ["archive", "member", "size", "crc", "content"])

    return archives.select("path", "content").mapInArrow(members, "archive string, member string, size bigint, crc bigint, content binary")


def checked_members(members: DataFrame, expected: DataFrame) -> DataFrame:
    """The members that ``expected`` (member, size, crc) names; another size or checksum, or a missing member, fails."""
    e = expected.select("member", F.col("size").alias("e_size"), F.col("crc").alias("e_crc"))
    both = e.join(members, "member", "left")
    good = F.coalesce((F.col("size") == F.col("e_size")) & (F.col("crc") == F.col("e_crc")), F.lit(False))
    fail = F.raise_error(F.concat(F.lit("not as expected: "), "member")).cast("string")
    return both.withColumn("member", F.when(good, F.col("member")).otherwise(fail)).select(*members.columns)


def until(df: DataFrame, stop, schema) -> DataFrame:
    """The batches of each partition up to the first for which ``stop(batch)`` holds; the rest of the partition isn't read."""

    def run(batches):
        for batch in batches:
            yield batch
            if stop(batch):
                return

    return df.mapInArrow(run, schema)


def coverage(events: DataFrame) -> DataFrame:
    """Per split and class, its recordings, events and seconds."""
    return events.groupBy("split", "mid").agg(F.count_distinct("recording").alias("recordings"), F.count("*").alias("events"), F.sum(F.col("off") - F.col("onset")).alias("seconds"))


def retried(operation, attempts: int = 4, first: float = 0.5, factor: float = 2.0, sleep=None):
    """ST3: the operation's result; an OSError waits ``first`` seconds, then ``factor`` times as long, and is raised after ``attempts``."""
    import time

    for i in range(attempts):
        try:
            return operation()
        except OSError:
            if i == attempts - 1:
                raise
            (sleep or time.sleep)(first * factor**i)
    raise ValueError("no attempts")


def read_zip_members(spark: SparkSession, path: str) -> DataFrame:
    """The members of all archives of a path."""
    return zip_members(spark.read.format("binaryFile").load(path))


def merged_manifests(df: DataFrame) -> DataFrame:
    """Per (split, video) the union of routes and hashes, and an existing path before a missing one."""
    return df.groupBy("split", "video").agg(F.array_sort(F.collect_set("route")).alias("routes"), F.array_sort(F.collect_set("sha256")).alias("hashes"), F.min_by("path", F.struct(~F.col("path_exists"), "path")).alias("path"))
