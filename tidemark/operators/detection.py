"""Scores of detected events: boundaries, windows of known place, and slots assigned at least cost."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.matching import assignment

#: Weights of the distance of both ends, of what is missing from full overlap, and of the confidence.
L1_COST, IOU_COST, OBJECT_COST = 5.0, 2.0, 1.0


def paired(predicted: np.ndarray, gold: np.ndarray, tolerance: float) -> int:
    """The greatest number of pairs at most ``tolerance`` apart, each time once; both ascending.

    On a line with one tolerance for all, joining the earliest that fit is best.
    """
    i = j = n = 0
    while i < len(predicted) and j < len(gold):
        apart = predicted[i] - gold[j]
        n += abs(apart) <= tolerance
        i, j = i + (apart <= tolerance), j + (apart >= -tolerance)
    return n


def f1_rows(counts: DataFrame) -> DataFrame:
    """Micro and macro F1 of (label, tp, fp, fn); the macro mean is over labels that occur in the gold events."""
    f1 = lambda tp, fp, fn: 2 * tp / F.greatest(2 * tp + fp + fn, F.lit(1))
    sums = [F.sum(c) for c in ("tp", "fp", "fn")]
    seen = F.when(F.col("tp") + F.col("fn") > 0, f1(*map(F.col, ("tp", "fp", "fn"))))
    return counts.agg(*[s.alias(c) for s, c in zip(sums, ("tp", "fp", "fn"))], f1(*sums).alias("micro_f1"), F.avg(seen).alias("macro_f1"))


def boundary_counts(predicted: DataFrame, gold: DataFrame, keys: list[str], time: str, tolerance: float) -> DataFrame:
    """(label, tp, fp, fn) of one boundary (``time``: onset or off) of events, matched one to one within the tolerance per keys (with label)."""
    kinds = dict(predicted.dtypes)
    left = predicted.select(*keys, F.col(time).cast("double").alias("p"))
    right = gold.select(*[F.col(k).alias(f"g_{k}") for k in keys], F.col(time).cast("double").alias("g"))

    def run(key, p, g):
        n = paired(np.sort(p.p.to_numpy()), np.sort(g.g.to_numpy()), tolerance)
        return pd.DataFrame([[*key, n, len(p) - n, len(g) - n]], columns=[*keys, "tp", "fp", "fn"])

    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", tp bigint, fp bigint, fn bigint"
    each = left.groupBy(*keys).cogroup(right.groupBy(*[f"g_{k}" for k in keys])).applyInPandas(run, schema)
    return each.groupBy("label").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])


def frame_counts(predicted: DataFrame, gold: DataFrame, keys: list[str]) -> DataFrame:
    """(label, tp, fp, fn) of active frames (keys with label and frame), each once."""
    marks = predicted.select(*keys, F.lit(1).alias("p"), F.lit(0).alias("g")).union(gold.select(*keys, F.lit(0), F.lit(1)))
    both = marks.groupBy(*keys).agg(F.max("p").alias("p"), F.max("g").alias("g"))
    return both.groupBy("label").agg(F.sum(F.col("p") * F.col("g")).alias("tp"), F.sum(F.col("p") * (1 - F.col("g"))).alias("fp"), F.sum((1 - F.col("p")) * F.col("g")).alias("fn"))


def oracle_ranks(frames: DataFrame, gold: DataFrame, scene: str, width: int = 64) -> DataFrame:
    """Gold events (scene, event_id, label, onset, off in frames, off exclusive) with the rank of their label in their own window.

    Labels are ranked by their highest score in the window, of equal ones by name;
    a label without scores there has none. Frames meet windows by buckets of
    ``width`` frames, so no scene is paired with itself. A null rank: the label
    has no score in the window.
    """
    windows = gold.select(scene, "event_id", F.col("label").alias("wanted"), "onset", F.greatest(F.col("onset") + 1, "off").alias("off"))
    windows = windows.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("onset") / width), F.floor((F.col("off") - 1) / width))))
    inside = frames.withColumn("bucket", F.floor(F.col("frame") / width)).join(windows, [scene, "bucket"]).where((F.col("frame") >= F.col("onset")) & (F.col("frame") < F.col("off")))
    best = inside.groupBy(scene, "event_id", "wanted", "label").agg(F.max("p").alias("p"))
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy(scene, "event_id").orderBy(F.desc("p"), "label"))).where("label = wanted")
    return gold.join(ranked.select(scene, "event_id", "rank"), [scene, "event_id"], "left")


def oracle_top(ranks: DataFrame, most: list[int]) -> DataFrame:
    """Share of gold events whose label ranks among the first k, over events (micro) and averaged over labels (macro)."""
    hits = [F.coalesce(F.avg((F.col("rank") <= k).cast("int")), F.lit(0.0)) for k in most]
    filled = ranks.withColumn("rank", F.coalesce("rank", F.lit(1 << 30)))
    per = filled.groupBy("label").agg(F.count("*").alias("n"), *[h.alias(f"top{k}") for h, k in zip(hits, most)])
    return per.agg(F.sum("n").alias("events"), *[(F.sum(F.col("n") * F.col(f"top{k}")) / F.sum("n")).alias(f"top{k}_micro") for k in most], *[F.avg(f"top{k}").alias(f"top{k}_macro") for k in most])


def slot_costs(onset: np.ndarray, off: np.ndarray, conf: np.ndarray, g_onset: np.ndarray, g_off: np.ndarray) -> np.ndarray:
    """The cost of each slot (row) for each gold interval (column)."""
    a, b = onset[:, None], off[:, None]
    hull = np.maximum(b, g_off) - np.minimum(a, g_onset)
    iou = np.divide(np.clip(np.minimum(b, g_off) - np.maximum(a, g_onset), 0, None), hull, out=np.zeros_like(hull), where=hull > 0)
    return L1_COST * (np.abs(a - g_onset) + np.abs(b - g_off)) + IOU_COST * (1 - iou) - OBJECT_COST * conf[:, None]


def assigned_slots(slots: DataFrame, gold: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, slot, gold, cost) of a cheapest one-to-one assignment per scene; slots or gold left over have a null partner and cost.

    ``slots`` has (keys, slot, onset, off, conf), ``gold`` (keys, gold, onset,
    off); times are shares of the scene's length. As many pairs are made as the
    smaller side has. A scene has a bounded number of slots.
    """
    kinds = dict(slots.dtypes)
    right = gold.select(*[F.col(k).alias(f"g_{k}") for k in keys], "gold", F.col("onset").alias("g_onset"), F.col("off").alias("g_off"))

    def run(key, p, g):
        p, g = p.sort_values("slot").reset_index(drop=True), g.sort_values("gold").reset_index(drop=True)
        pairs, cost = [], np.zeros((len(p), len(g)))
        if cost.size:
            cost = slot_costs(*(p[c].to_numpy(float) for c in ("onset", "off", "conf")), *(g[c].to_numpy(float) for c in ("g_onset", "g_off")))
            pairs = list(enumerate(assignment(cost))) if len(p) <= len(g) else [(i, j) for j, i in enumerate(assignment(cost.T))]
        rows = [[*key, p.slot[i], g.gold[j], cost[i, j]] for i, j in pairs]
        left, there = {i for i, _ in pairs}, {j for _, j in pairs}
        rows += [[*key, p.slot[i], None, None] for i in range(len(p)) if i not in left] + [[*key, None, g.gold[j], None] for j in range(len(g)) if j not in there]
        return pd.DataFrame(rows, columns=[*keys, "slot", "gold", "cost"]).astype({"slot": "Int64", "gold": "Int64", "cost": "float64"})

    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", slot bigint, gold bigint, cost double"
    return slots.select(*keys, "slot", "onset", "off", "conf").groupBy(*keys).cogroup(right.groupBy(*[f"g_{k}" for k in keys])).applyInPandas(run, schema)


def steady(x: Column, how=F.sum) -> Column:
    """The sum (or F.avg) of doubles, the same in whatever order their rows come: they are added as decimals of 15 places, which also drops what doubles under 1 lost, so a mean half-way between two roundings stays there.

    With any of 1e12 or more, infinite or NaN it is the plain one.
    """
    fits = F.abs(x) < 1e12
    return F.when(F.bool_and(fits), how(F.when(fits, x).cast("decimal(38,15)")).cast("double")).otherwise(how(x))


def evidence_metrics(predicted: DataFrame, gold: DataFrame, records: DataFrame, key: str) -> DataFrame:
    """M3: over all ``records`` (key, no_evidence, p), the mean interval IoU, that of records with evidence, the accuracy and Brier score of p for no evidence, and the share of gold time that predictions keep.

    A record without intervals on both sides has IoU 1, with one side only 0; no
    evidence is predicted from p = 0.5 on; without gold time the kept share is null.
    The order of records changes no result (see `steady`).
    """
    from tidemark.operators.intervals import common_time, union_length

    times = common_time(predicted, gold, [key]).join(union_length(gold, [key]).withColumnRenamed("union_length", "gold_time"), key, "left")
    both = records.join(times, key, "left").withColumn("iou", F.when(F.coalesce("union", F.lit(0.0)) > 0, F.col("intersection") / F.col("union")).otherwise(1.0))
    y = F.col("no_evidence").cast("int")
    error = (F.col("p") - y) * (F.col("p") - y)
    return both.agg(steady(F.col("iou"), F.avg).alias("tiou"), steady(F.when(~F.col("no_evidence"), F.col("iou")), F.avg).alias("tiou_with_evidence"), F.avg(((F.col("p") >= 0.5) == F.col("no_evidence")).cast("int")).alias("no_evidence_accuracy"), steady(error, F.avg).alias("brier"), F.try_divide(steady(F.col("intersection")), steady(F.col("gold_time"))).alias("kept"))
