"""Bootstraps and cross-validation with hash-seeded draws.

A draw is a hash of (seed, replicate, place), so every engine and every retry
draws the same. Facts are reduced to sums per cluster before the replicates
multiply them, and a replicate joins cluster numbers only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.sequences import numbered


def hash_number(*parts) -> Column:
    """The first eight bytes of the SHA-256 of the joined parts, as an exact decimal."""
    text = F.concat_ws(":", *[p if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.sha2(text, 256), 1, 16), 16, 10).cast("decimal(20,0)")


def cluster_sums(df: DataFrame, cluster: str, *values: Column) -> DataFrame:
    """One row per cluster with sums s_0.., its row count and a dense number from zero."""
    sums = df.groupBy(cluster).agg(*[F.sum(v).alias(f"s_{i}") for i, v in enumerate(values)], F.count("*").alias("n"))
    return numbered(sums, cluster)


def bootstrap(clusters: DataFrame, replicates: int, seed: str) -> DataFrame:
    """Per replicate, the sums over as many drawn clusters as there are, with replacement.

    ``m_0``.. are means of cluster means in which each draw of a cluster counts
    as a cluster of its own; all statistics of a replicate share its draws.
    """
    n = clusters.count()
    spark = clusters.sparkSession
    draws = spark.range(replicates).select(F.col("id").alias("replicate"), F.explode(F.sequence(F.lit(0), F.lit(max(n - 1, 0)))).alias("draw"))
    drawn = draws.withColumn("number", (hash_number(seed, F.col("replicate"), F.col("draw")) % max(n, 1)).cast("int"))
    weights = drawn.groupBy("replicate", "number").agg(F.count("*").alias("w"))
    sums = [c for c in clusters.columns if c.startswith("s_")]
    return weights.join(clusters, "number").groupBy("replicate").agg(*[F.sum(F.col("w") * F.col(c)).alias(c) for c in sums], *[(F.sum(F.col("w") * F.col(c) / F.col("n")) / F.sum("w")).alias(f"m_{c[2:]}") for c in sums], F.sum(F.col("w") * F.col("n")).alias("n"))


def interval(df: DataFrame, statistic: str, level: float = 0.95) -> DataFrame:
    """Percentile interval by linear interpolation, and the mean."""
    tail = (1 - level) / 2
    return df.agg(F.avg(statistic).alias("mean"), F.percentile(statistic, tail).alias("low"), F.percentile(statistic, 1 - tail).alias("high"))


def floor_interval(df: DataFrame, statistic: str, level: float = 0.95) -> DataFrame:
    """Bounds at index floor(q * (n - 1)) of the sorted statistics."""
    tail = (1 - level) / 2
    ranked = df.withColumns({"_i": F.row_number().over(Window.orderBy(statistic)) - 1, "_n": F.count("*").over(Window.partitionBy())})
    at = lambda q: F.max(F.when(F.col("_i") == F.floor(F.round(q * (F.col("_n") - 1), 9)), F.col(statistic)))
    return ranked.agg(at(tail).alias("low"), at(1 - tail).alias("high"))


def fold_majority(df: DataFrame, key: Column, group: str, value: str, folds: int) -> DataFrame:
    """Each row's majority value of its group in the other folds, else of all rows of the other folds."""
    f = df.withColumn("fold", key % folds)
    counts = f.groupBy("fold", group, value).agg(F.count("*").alias("n"))
    whole = counts.groupBy(group, value).agg(F.sum("n").alias("t"))
    # one row per (group, value) and fold: counts of the other folds by subtraction
    every_fold = whole.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    rest = every_fold.join(counts, ["fold", group, value], "left").withColumn("r", F.col("t") - F.coalesce("n", F.lit(0))).where("r > 0")
    own = rest.groupBy("fold", group).agg(F.min_by(value, F.struct(-F.col("r"), F.col(value))).alias("a"))
    every = rest.groupBy("fold", value).agg(F.sum("r").alias("r")).groupBy("fold").agg(F.min_by(value, F.struct(-F.col("r"), F.col(value))).alias("b"))
    return f.join(own, ["fold", group], "left").join(every, "fold", "left").withColumn("predicted", F.coalesce("a", "b")).drop("a", "b")
