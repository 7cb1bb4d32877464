"""Structured Streaming over event files: windows, sessions, deduplication, resumable scans.

Inputs are directories of Parquet files. ``ts`` may be a timestamp without zone,
which has no watermark, so it is cast in the session's zone. Each query drains
what is there (availableNow) and can be run again from its checkpoint.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tidemark.session import shared_dir, work_dir


def event_stream(spark: SparkSession, path: str, files: int = 8) -> DataFrame:
    """ST1: new files only, at most ``files`` per trigger; the path is a folder or one file.

    A stream takes one file only by a pattern, so the path's last letter is put
    in brackets.
    """
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(f"{path[:-1]}[{path[-1]}]").withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(df: DataFrame, width: str, late: str = "1 hour", slide: str | None = None) -> DataFrame:
    """ST5: counts per event-time window and type."""
    return df.withWatermark("ts", late).groupBy(F.window("ts", width, slide), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sessions(df: DataFrame, gap: str, late: str = "1 hour") -> DataFrame:
    """ST6: a user's events without a pause longer than ``gap``."""
    return df.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))


def deduplicated(df: DataFrame, key: str, late: str = "1 hour") -> DataFrame:
    """The first row of each key within the watermark."""
    return df.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def running_turns(df: DataFrame) -> DataFrame:
    """ST6: per user the length of the current run of one event type, in keyed state.

    Rows of a user may come in any order, over several batches or several Arrow
    batches of one: the run is what follows, by (ts, event_id), the latest event
    of another type than the latest event has. The state holds that event's place
    and the run's own, all that a later row can still change; rows without time
    come first.
    """

    def update(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        kind, times, ids = state.get if state.exists else (None, [], [])
        # the first place held is that of the event before the run, if there is one: of another type than any run has
        held = [(t, i, None if n == 0 else kind) for n, (t, i) in enumerate(zip(times, ids))]
        rows = [r for p in batches for r in zip(p.ts.to_numpy("datetime64[us]").astype("int64").tolist(), p.event_id.tolist(), p.event_type)]
        places = sorted([*held, *rows], key=lambda r: r[:2])
        kind = places[-1][2]
        n = next((n for n, r in enumerate(reversed(places)) if r[2] != kind), len(places))
        kept = places[-n - 1 :] if n < len(places) else [(-(1 << 63), -(1 << 63), None), *places]
        state.update((kind, [r[0] for r in kept], [r[1] for r in kept]))
        yield pd.DataFrame({"user_id": [key[0]], "event_type": [kind], "run": [n]})

    rows = df.select("user_id", "event_type", "event_id", "ts")
    return rows.groupBy("user_id").applyInPandasWithState(update, "user_id long, event_type string, run long", "kind string, times array<long>, ids array<long>", "update", "NoTimeout")


def drained(df: DataFrame, mode: str = "append", keep: str | None = None, notify: Callable[[str, dict], None] | None = None) -> DataFrame:
    """ST1, ST2: run to the end of the input, each batch written once under its number; the written rows.

    A batch that is tried again replaces its own folder, so the sink stays
    exact. With ``keep`` the checkpoint has a fixed name and a later call goes on.
    X1, ST4: ``notify`` is called on the driver with ("batch", its number and
    written rows) when a batch is written, and ("finished", their number) at the
    end; every batch is told, however many there are.
    """
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/stream-{keep}" if keep else f"{work_dir(spark)}/stream-{uuid.uuid4().hex}"

    told = 0

    def save(batch: DataFrame, number: int) -> None:
        nonlocal told
        batch.write.mode("overwrite").parquet(f"{at}/rows/batch={number}")
        told += 1
        if notify:
            notify("batch", {"number": number, "rows": spark.read.schema(batch.schema).parquet(f"{at}/rows/batch={number}").count()})

    run = df.writeStream.outputMode(mode).foreachBatch(save).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()
    if notify:
        notify("finished", {"batches": told})
    return spark.read.schema(StructType([*df.schema.fields, StructField("batch", LongType())])).parquet(f"{at}/rows")


def latest(df: DataFrame, *keys: str) -> DataFrame:
    """The last update of each key of a drained update stream."""
    values = [c for c in df.columns if c not in keys and c != "batch"]
    return df.groupBy(*keys).agg(*[F.max_by(c, "batch").alias(c) for c in values])
