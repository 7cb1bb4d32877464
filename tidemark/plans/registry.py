"""Named queries: a Spark callable, the operators it covers, and its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Query:
    name: str
    operators: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(operators: str, sql: str | None = None):
    """Register a function(spark, sf_dir) under its own name."""

    def add(run):
        REGISTRY[run.__name__] = Query(run.__name__, operators, run, sql)
        return run

    return add


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql_round(x, n: int) -> Column:
    """DuckDB's round(x, n) of a double: what is rounded is the product, not the decimal that Spark's round reads."""
    return F.round((F.col(x) if isinstance(x, str) else x) * 10.0**n, 0) / 10.0**n


def sql_round_even(x, n: int) -> Column:
    """DuckDB's round_even(x, n) of a double."""
    return F.rint((F.col(x) if isinstance(x, str) else x) * 10.0**n) / 10.0**n


def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as labelled intervals: one scene per user, a minute per unit of value."""
    onset = (F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)).alias("onset")
    return load(spark, sf_dir, "events").select(F.col("user_id").alias("scene"), F.col("event_type").alias("label"), onset, (onset + F.col("value") * 60).alias("off"), "event_id", (F.col("value") / 500).alias("conf"))


#: The same view for DuckDB, to follow WITH.
TL = "tl AS (SELECT user_id AS scene, event_type AS label, epoch_us(ts)/1e6 AS onset, epoch_us(ts)/1e6 + value*60 AS off, event_id, value/500 AS conf FROM events)"
