"""Window operators over frames, turns and ranked rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rows(keys: list[str], order: list, low: int, high: int):
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(low, high)


def capped(df: DataFrame, keys: list[str], order: list, most: int) -> DataFrame:
    """W3, SP6, SP25: the first ``most`` rows per key in a total order, with their rank."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= most)


def fixed_count(df: DataFrame, label: str, order: list, count: int) -> DataFrame:
    """SP25: exactly ``count`` rows per label in the given order; a label with fewer is an error."""
    short = df.groupBy(label).agg(F.count("*").alias("n")).where(F.col("n") < count).limit(5).collect()
    if short:
        raise ValueError(f"too few rows: {[(r[0], r.n) for r in short]}")
    return capped(df, [label], order, count)


def registered(df: DataFrame, category: str, order: list, design: dict[str, int]) -> DataFrame:
    """SP24: of each category of a fixed design its number of rows, in order; a category with fewer is an error, others are left out."""
    want = F.create_map(*[F.lit(x) for kv in design.items() for x in kv])
    have = {r[0]: r.n for r in df.where(F.col(category).isin(*design)).groupBy(category).agg(F.count("*").alias("n")).collect()}
    short = {c: n for c, n in design.items() if have.get(c, 0) < n}
    if short:
        raise ValueError(f"the design needs more rows: {short}")
    rank = F.row_number().over(Window.partitionBy(category).orderBy(*order))
    return df.where(F.col(category).isin(*design)).withColumn("rank", rank).where(F.col("rank") <= F.element_at(want, F.col(category)))


def numbered(df: DataFrame, *order: str, parts: int | None = None) -> DataFrame:
    """df with ``number``: the row's place from zero in a total order, without one task ranking all rows.

    Rows are dealt by ranges of the order and written once (ranges come from a
    sample, so they must not be drawn twice); a place is the place in its range
    plus the rows of lesser ranges.
    """
    from tidemark.session import written

    spark = df.sparkSession
    dealt = df.repartitionByRange(parts or int(spark.conf.get("spark.sql.shuffle.partitions")), *order)
    kept = written(dealt.withColumn("_p", F.spark_partition_id()), "ranges")
    sizes = kept.groupBy("_p").agg(F.count("*").alias("_c"))
    before = F.coalesce(F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(sizes.select("_p", before.alias("_s")))  # one row per range
    place = F.row_number().over(Window.partitionBy("_p").orderBy(*order)) - 1
    return kept.join(starts, "_p").withColumn("number", F.col("_s") + place).drop("_p", "_s")


def hash_running(df: DataFrame, key: str, size: str | None, salt: str) -> DataFrame:
    """df with, in hash order of the key, _before: the total size (or count) of lesser hashes, and _total.

    Totals are taken per two-digit hash prefix first, so one window sees 256
    rows and the others a 256th of all rows each.
    """
    n = F.col(size) if size else F.lit(1)
    h = df.withColumn("_h", F.sha2(F.concat(F.lit(salt), F.col(key).cast("string")), 256)).withColumn("_p", F.substring("_h", 1, 2))
    sizes = h.groupBy("_p").agg(F.sum(n).alias("_c"))
    lesser = F.coalesce(F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(sizes.select("_p", lesser.alias("_s"), F.sum("_c").over(Window.partitionBy()).alias("_total")))  # 256 prefixes
    own = F.coalesce(F.sum(n).over(Window.partitionBy("_p").orderBy("_h", key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return h.join(starts, "_p").withColumn("_before", F.col("_s") + own).drop("_h", "_p", "_s")


def hash_split(df: DataFrame, key: str, share: float, salt: str) -> DataFrame:
    """W4, SP19: exactly floor(n * share) keys by hash rank."""
    ranked = hash_running(df, key, None, f"{salt}|")
    return ranked.withColumn("chosen", F.col("_before") < F.floor(F.col("_total") * share)).drop("_before", "_total")


def filled(df: DataFrame, keys: list[str], order: list, column: str) -> DataFrame:
    """Last known value forward, the first known one back to the head."""
    w = Window.partitionBy(*keys).orderBy(*order)
    ahead = F.last(column, True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    head = F.first(column, True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return df.withColumn(column, F.coalesce(ahead, head))


def turns(df: DataFrame, keys: list[str], order: str, column: str) -> DataFrame:
    """W5, W15, ST6: maximal runs of one value, numbered, with the values renumbered by first appearance."""
    w = Window.partitionBy(*keys).orderBy(order)
    new = F.when(F.lag(column).over(w).eqNullSafe(F.col(column)) & F.lag(order).over(w).isNotNull(), 0).otherwise(1)
    run = df.withColumn("_n", new).withColumn("turn", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = run.groupBy(*keys, "turn").agg(F.first(column).alias(column), F.min(order).alias("start"), F.max(order).alias("stop"), F.count("*").alias("n"))
    first = F.min("start").over(Window.partitionBy(*keys, column))
    return out.withColumn("_f", first).withColumn("speaker", F.dense_rank().over(Window.partitionBy(*keys).orderBy("_f"))).drop("_f")


def next_distinct(df: DataFrame, keys: list[str], order: str, column: str) -> DataFrame:
    """The next different value after each run."""
    t = turns(df, keys, order, column)
    return t.withColumn("following", F.lead(column).over(Window.partitionBy(*keys).orderBy("turn")))


def smoothed(column: str, keys: list[str], order: list, width: int) -> Column:
    """Moving sum over an odd width divided by the width, edges as zeros."""
    return F.sum(column).over(rows(keys, order, -(width // 2), width // 2)) / width


def median(column: str, keys: list[str], order: list, width: int) -> Column:
    """The median over an odd width (an even one is widened), edge values repeated."""
    w = Window.partitionBy(*keys).orderBy(*order)
    half = width // 2
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    near = [F.coalesce(F.lag(column, i).over(w), F.first(column).over(whole)) for i in range(half, 0, -1)] + [F.col(column)] + [F.coalesce(F.lead(column, i).over(w), F.last(column).over(whole)) for i in range(1, half + 1)]
    return F.element_at(F.array_sort(F.array(*near)), half + 1)


def peak_component(df: DataFrame, keys: list[str], frame: str, p: str, threshold: float) -> DataFrame:
    """Per key the run of frames at or above ``threshold`` around the first greatest value; that frame alone if it is below."""
    w = Window.partitionBy(*keys)
    peak = F.min_by(frame, F.struct(-F.col(p), F.col(frame))).over(w)
    on = df.withColumn("_peak", peak).where((F.col(p) >= threshold) | (F.col(frame) == F.col("_peak")))
    run = on.withColumn("_g", F.col(frame) - F.row_number().over(w.orderBy(frame)))
    out = run.groupBy(*keys, "_g").agg(F.min(frame).alias("start"), (F.max(frame) + 1).alias("stop"), F.max(p).alias("peak"), F.max(F.col(frame) == F.col("_peak")).alias("_in"))
    return out.where("_in").drop("_g", "_in")


def local_maximum(column: str, keys: list[str], order: list, distance: int, least: float) -> Column:
    """W8."""
    return (F.col(column) >= F.max(column).over(rows(keys, order, -distance, distance))) & (F.col(column) >= least)


def decoded(df: DataFrame, keys: list[str], frame: str, p: str, threshold: float, gap: int, least: int) -> DataFrame:
    """Runs at or above the threshold, runs within ``gap`` frames merged, short ones dropped, greatest p kept."""
    w = Window.partitionBy(*keys).orderBy(frame)
    on = df.where(F.col(p) >= threshold)
    new = F.when(F.col(frame) - F.lag(frame).over(w) - 1 <= gap, 0).otherwise(1)
    run = on.withColumn("_n", new).withColumn("_g", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = run.groupBy(*keys, "_g").agg(F.min(frame).alias("start"), (F.max(frame) + 1).alias("stop"), F.max(p).alias("confidence"))
    return out.where(F.col("stop") - F.col("start") >= least).drop("_g")


def hysteresis(df: DataFrame, keys: list[str], frame: str, p: str, high: float, low: float) -> DataFrame:
    """Runs at or above ``low`` that hold a frame at or above ``high``."""
    return decoded(df, keys, frame, p, low, 0, 1).where(F.col("confidence") >= high)


def onset_mass(p: str, keys: list[str], order: list) -> Column:
    """Positive rises, normalised over the sequence."""
    w = Window.partitionBy(*keys).orderBy(*order)
    rise = F.greatest(F.lit(0.0), F.col(p) - F.coalesce(F.lag(p).over(w), F.lit(0.0)))
    return rise


def first_passage(h: str, keys: list[str], order: list, epsilon: float = 1e-6) -> Column:
    """h[t] * prod(1 - h[u]) over earlier frames."""
    before = F.sum(F.ln(F.greatest(1 - F.col(h), F.lit(epsilon)))).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return F.col(h) * F.exp(F.coalesce(before, F.lit(0.0)))


def refilled(primary: DataFrame, reserve: DataFrame, keys: list[str], rejected: Column, order: list) -> DataFrame:
    """W18, SP8: the n-th rejected row of a key takes the n-th reserve row; without one it stays a deficit."""
    w = Window.partitionBy(*keys).orderBy(*order)
    holes = primary.where(rejected).withColumn("_n", F.row_number().over(w))
    spare = reserve.withColumn("_n", F.row_number().over(w))
    renamed = spare.select(*keys, "_n", *[F.col(x).alias(f"refill_{x}") for x in reserve.columns if x not in keys])
    return holes.join(renamed, [*keys, "_n"], "left").withColumnRenamed("_n", "hole")
