"""What the document operators share: narrow inputs, label folds, Arrow maps, components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import ship, written

#: Bytes of one Arrow batch, where the session sets none: bounds a Python worker's memory for long texts.
BATCH_BYTES = 2 << 20
#: Rows of one join key beyond which the key is dealt to several.
HUB = 500_000
_BOUND = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def narrow(df: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns, so extra columns can't clash with ours."""
    return df.select(*[F.col(c) for c in columns])


def fold(doc_id: Column | str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as the text 'null'."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(col.cast("string"), F.lit("null"))) % folds


def arrow_map(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    """mapInArrow with batches bounded by bytes and the package on the workers; a bound that the session has stays."""
    spark = df.sparkSession
    ship(spark)
    if spark.conf.get(_BOUND) in (None, "-1", "-1b"):
        spark.conf.set(_BOUND, str(BATCH_BYTES))
    return df.mapInArrow(function, schema)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores appended to those that ``df`` has already."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def hub_join(rows: DataFrame, per_key: DataFrame, key: str) -> DataFrame:
    """``rows`` with the columns of ``per_key``, which has a row per key and in ``n`` the key's number of rows.

    A key with more than HUB rows is dealt, by a hash of the row, to as many keys
    as it needs. There are at most rows / HUB such keys; up to 100,000 are broadcast.
    ``per_key`` should be a written table: it is read twice.
    """
    parts = F.ceil(F.col("n") / HUB).cast("int")
    hubs = per_key.where(F.col("n") > HUB).select(key, parts.alias("_parts"))
    many = hubs.count()
    if not many:
        return rows.join(per_key.drop("n"), key)
    dealt = rows.join(F.broadcast(hubs) if many <= 100_000 else hubs, key, "left").withColumn("_part", F.pmod(F.xxhash64(*rows.columns), F.coalesce("_parts", F.lit(1))).cast("int")).drop("_parts")
    spread = per_key.withColumn("_part", F.explode(F.sequence(F.lit(0), F.greatest(parts, F.lit(1)) - 1))).drop("n")
    return dealt.join(spread, [key, "_part"]).drop("_part")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 40) -> DataFrame:
    """(node, component) for all nodes of ``edges``; component is the least node id.

    Alternating large-star and small-star steps: each round joins every node to
    the least id in its neighbourhood, so the rounds grow with the logarithm of
    the number of edges, a hub's edges are aggregated (min) before they are
    shuffled, and its links are dealt to several keys in the join. Each round is written to the shared folder. Self-links are
    dropped, repeated edges count once.
    """
    pairs = written(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "cc")
    before = None
    for _ in range(max_rounds):
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n")), "cc")
        large = hub_join(both, least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        pairs = written(small, "cc")
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    roots = pairs.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots).groupBy("node").agg(F.min("component").alias("component"))
