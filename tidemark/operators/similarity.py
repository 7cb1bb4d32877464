"""Ranks by cosine of some rows among all rows, exact, in blocks of rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import ship

#: Rows of a block: a pair of blocks is one matrix product of some MB.
ASKED_ROWS, ROWS = 1024, 2048
#: Cosines are compared as rounded to nine decimals; a product of matrices is off by far less.
SCALE, NEAR = 1e9, 2e-9
#: Stands for the cosine of what isn't a pair; below all others.
NEVER = -2.0
#: Bytes of an Arrow batch of block pairs, where the session sets none.
BATCH_BYTES = 8 << 20
_BOUND = "spark.sql.execution.arrow.maxBytesPerBatch"


def row_dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dot products of rows, added from the first element to the last as SQL does."""
    out = np.zeros(len(a))
    for i in range(a.shape[1]):
        out += a[:, i] * b[:, i]
    return out


def exact(dots: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines from dot products and squared lengths, rounded as SQL's round does; a zero vector's is not a number, which comes first."""
    with np.errstate(invalid="ignore", divide="ignore"):
        x = dots / np.sqrt(a * b) * SCALE
    whole = np.trunc(x)
    x = (whole + np.where(np.abs(x - whole) >= 0.5, np.sign(x), 0)) / SCALE
    return np.where(np.isnan(x), np.inf, x)


def blocks(df: DataFrame, rows: int, prefix: str) -> DataFrame:
    """``df`` (id, label, e, any further numbers) as rows of packed blocks, one binary column per column."""
    columns = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), rows):
                part = batch.slice(at, rows)
                packed = []
                for name in columns:
                    x = part.column(name)
                    flat = x.flatten() if name == "e" else x
                    packed.append(flat.to_numpy(zero_copy_only=False).astype("float64" if name in ("e", "c") else "int64").tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([p], pa.binary()) for p in packed], names=[prefix + n for n in columns])

    return df.mapInArrow(run, ", ".join(f"{prefix}{n} binary" for n in columns))


def ranks(v: DataFrame, asked: DataFrame) -> DataFrame:
    """(id, rank) of ``asked`` rows: the place, by falling cosine and then id, of the first row of equal label among all other rows; null where none has it.

    Both have (id, label, e: array<double>); rows without id or vector don't count.
    Blocks of rows meet blocks of asked rows, twice: for the best row of the
    label, then for the number of rows before it. A matrix product leaves out all
    that can't matter; what is within 2e-9 of the best is added up one by one, so
    the result is that of comparing every pair. Work is the product of both
    numbers of rows, a task holds two blocks.
    """
    spark = v.sparkSession
    ship(spark)
    if spark.conf.get(_BOUND, None) in (None, "-1", "-1b"):
        spark.conf.set(_BOUND, str(BATCH_BYTES))
    whole = lambda df, *more: df.where("id is not null and e is not null").select("id", F.coalesce(F.col("label").cast("bigint"), F.lit(0)).alias("label"), F.col("label").isNotNull().cast("bigint").alias("known"), "e", *more)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    every = blocks(whole(v).repartition(parts, "id"), ROWS, "")

    def pairs(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for row in batch.to_pylist():
                get = lambda n, kind="int64": np.frombuffer(row[n], kind)  # noqa: B023, E731
                ids, q_ids = get("id"), get("q_id")
                e, q = get("e", "float64").reshape(len(ids), -1), get("q_e", "float64").reshape(len(q_ids), -1)
                n, q_n = row_dots(e, e), row_dots(q, q)
                with np.errstate(invalid="ignore", divide="ignore"):
                    near = (q / np.sqrt(q_n)[:, None]) @ (e / np.sqrt(n)[:, None]).T
                if not (n.all() and q_n.all()):
                    near[np.isnan(near)] = np.inf
                own = np.flatnonzero(np.isin(ids, q_ids))
                near[:, own] = np.where(q_ids[:, None] == ids[own], NEVER, near[:, own])
                yield get, ids, q_ids, near, lambda i, j: exact(row_dots(q[i], e[j]), q_n[i], n[j])  # noqa: B023

    def best_of_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for get, ids, q_ids, near, cosine in pairs(batches):
            same = get("q_label")[:, None] == get("label")
            near = np.where(same & (get("known") > 0), near, NEVER)
            top = np.where(get("q_known") > 0, near.max(axis=1), NEVER)
            i, j = np.nonzero(near >= np.where(top == NEVER, np.nan, np.where(np.isinf(top), top, top - NEAR))[:, None])
            c = cosine(i, j)
            order = np.lexsort((ids[j], -c, i))
            first = order[np.unique(i[order], return_index=True)[1]]
            yield pa.RecordBatch.from_arrays([pa.array(q_ids[i[first]]), pa.array(c[first]), pa.array(ids[j[first]])], names=["id", "c", "best"])

    def before_best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for get, ids, q_ids, near, cosine in pairs(batches):
            c, best = get("q_c", "float64"), get("q_best")
            i, j = np.nonzero(near >= np.where(np.isinf(c), c, c - NEAR)[:, None])
            sure = near[i, j] > np.where(np.isinf(c), c, c + NEAR)[i]
            n = np.bincount(i[sure], minlength=len(q_ids))
            i, j = i[~sure], j[~sure]
            x = cosine(i, j)
            n += np.bincount(i[(x > c[i]) | (x == c[i]) & (ids[j] < best[i])], minlength=len(n))
            some = (near > NEVER).any(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(q_ids[some]), pa.array(n[some])], names=["id", "n"])

    asked = asked.select("id", "label", "e")
    # each part of the asked rows makes its own pass over all blocks
    asked_parts = max(1, -(-asked.count() // (8 * ASKED_ROWS)))
    found = every.crossJoin(blocks(whole(asked).repartition(asked_parts, "id"), ASKED_ROWS, "q_")).mapInArrow(best_of_block, "id bigint, c double, best bigint")
    best = found.groupBy("id").agg(F.min(F.struct((-F.col("c")).alias("down"), "best")).alias("b")).select("id", (-F.col("b.down")).alias("c"), F.col("b.best").alias("best"))
    # without a row of the label nothing is before, and the rank is null
    known = asked.join(best, "id", "left").withColumns({"c": F.coalesce("c", F.lit(float("inf"))), "best": F.coalesce("best", F.lit(-(1 << 63)))})
    counts = every.crossJoin(blocks(whole(known, "c", "best").repartition(asked_parts, "id"), ASKED_ROWS, "q_")).mapInArrow(before_best, "id bigint, n bigint")
    total = counts.groupBy("id").agg(F.sum("n").alias("n"))
    return total.join(best.select("id", "best"), "id", "left").select("id", F.when(F.col("best").isNotNull(), F.col("n") + 1).alias("rank"))
