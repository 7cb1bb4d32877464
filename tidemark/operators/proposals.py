"""Crop choice, audible trimming, peak-split decoding, pools of negatives, pair resolution, confusion groups."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.intervals import overlap_length


def best_crop(df: DataFrame, keys: list[str], length: float, least_visible: float = 0.5) -> DataFrame:
    """Per key the crop start, among event onsets, with most distinct labels, then events, then adjacent pairs, then the earliest.

    Starts meet only the events of their own key within the crop length, by
    time buckets of that length.
    """
    bucket = lambda t: F.floor(t / length)
    starts = df.select(*keys, F.col("onset").alias("start")).distinct().withColumn("bucket", F.explode(F.sequence(bucket(F.col("start")), bucket(F.col("start") + length))))
    seen = df.withColumn("bucket", F.explode(F.sequence(bucket(F.col("onset")), bucket(F.col("off")))))
    both = starts.join(seen, [*keys, "bucket"]).where(F.col("bucket") == F.greatest(bucket(F.col("start")), bucket(F.col("onset"))))
    visible = both.where(overlap_length("onset", "off", F.col("start"), F.col("start") + length) >= least_visible)
    n = visible.groupBy(*keys, "start").agg(F.count_distinct("label").alias("labels"), F.count("*").alias("events"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("labels"), F.desc("events"), "start"))
    return n.withColumn("pairs", F.greatest(F.lit(0), F.col("events") - 1)).withColumn("_r", rank).where("_r = 1").drop("_r")


def audible(wave: np.ndarray, rate: int, onset: float, off: float, window: float = 0.05, hop: float = 0.01, drop_db: float = 30.0, floor: float = 1e-4, pad: float = 0.02) -> tuple[float, float]:
    """First to last frame within drop_db of the peak level and above the floor, padded, never outside the annotation."""
    part = wave[int(onset * rate) : int(off * rate)]
    n, step = max(1, int(window * rate)), max(1, int(hop * rate))
    if len(part) < n:
        return onset, off
    frames = np.lib.stride_tricks.sliding_window_view(part, n)[::step]
    rms = np.sqrt((frames.astype(np.float64) ** 2).mean(1))
    active = np.flatnonzero(rms >= max(floor, rms.max() * 10 ** (-drop_db / 20)))
    if not len(active):
        return onset, off
    return max(onset, onset + active[0] * step / rate - pad), min(off, onset + (active[-1] * step + n) / rate + pad)


def audible_intervals(df: DataFrame, rate: int) -> DataFrame:
    """I26 over (key, wave array<float>, onset, off)."""

    def run(batches):
        for p in batches:
            spans = [audible(np.asarray(w, np.float64), rate, a, b) for w, a, b in zip(p.wave, p.onset, p.off)]
            yield pd.DataFrame({"key": p.key, "onset": [s[0] for s in spans], "off": [s[1] for s in spans]})

    return df.select("key", "wave", "onset", "off").mapInPandas(run, "key bigint, onset double, off double")


def peak_split(df: DataFrame, keys: list[str], threshold: float, peak: float) -> DataFrame:
    """Runs of frames at or above ``threshold``, split midway between local peaks at or above ``peak``; windows alone.

    A peak is above the frame before and not below the one after, ends of a run
    apart; the run's first frame and each midpoint start a piece.
    """
    on = df.where(F.col("p") >= threshold).withColumn("_run", F.col("frame") - F.row_number().over(Window.partitionBy(*keys).orderBy("frame")))
    run = [*keys, "_run"]
    w = Window.partitionBy(*run).orderBy("frame")
    is_peak = (F.col("p") >= peak) & F.coalesce(F.col("p") > F.lag("p").over(w), F.lit(True)) & F.coalesce(F.col("p") >= F.lead("p").over(w), F.lit(True))
    marked = on.withColumns({"_peak": F.when(is_peak, F.col("frame")), "_head": F.row_number().over(w) == 1, "_stop": F.max("frame").over(Window.partitionBy(*run)) + 1})
    last = F.last("_peak", True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    middle = F.floor((last + F.col("_peak") + 1) / 2)
    pieces = marked.withColumn("_middle", middle).withColumn("start", F.explode(F.array_compact(F.array(F.when(F.col("_head"), F.col("frame")), F.col("_middle"))))).select(*run, "_stop", "start").distinct()
    return pieces.withColumn("stop", F.coalesce(F.lead("start").over(Window.partitionBy(*run).orderBy("start")), "_stop")).select(*keys, "start", "stop")


def absent_labels(df: DataFrame, scene: str, partition: str, label: str, seed: str, most: int) -> DataFrame:
    """Per scene the first ``most`` labels, in hash order, that occur in its partition but neither equal nor contain (nor lie in) one of its own.

    Labels per partition and per scene are sets of bounded size compared as
    arrays, so scenes never meet scenes.
    """
    own = df.groupBy(scene, partition).agg(F.array_sort(F.collect_set(label)).alias("own"))
    pool = df.groupBy(partition).agg(F.array_sort(F.collect_set(label)).alias("pool"))
    clash = lambda x: F.exists("own", lambda o: (o == x) | (F.char_length(x) >= 3) & o.contains(x) | (F.char_length(o) >= 3) & x.contains(o))
    free = F.filter("pool", lambda x: ~clash(x))
    ordered = F.array_sort(F.transform(free, lambda x: F.struct(F.sha2(F.concat_ws(":", F.lit(seed), F.col(scene).cast("string"), x), 256).alias("h"), x.alias("label"))))
    return own.join(pool, partition).select(scene, F.slice(F.transform(ordered, lambda x: x["label"]), 1, most).alias("absent"))


def pair_resolution(df: DataFrame, keys: list[str]) -> DataFrame:
    """Whether two different slots cover the two gold intervals (left, right at IoU >= 0.5).

    ``df`` has one row per (keys, slot) with its IoU to either gold interval.
    """
    left = F.array_sort(F.collect_list(F.when(F.col("iou_left") >= 0.5, F.col("slot"))))
    right = F.array_sort(F.collect_list(F.when(F.col("iou_right") >= 0.5, F.col("slot"))))
    return df.groupBy(*keys).agg(left.alias("l"), right.alias("r")).select(*keys, ((F.size("l") > 0) & (F.size("r") > 0) & (F.size(F.array_union("l", "r")) > 1)).alias("resolved"))


def confusion_groups(counts: np.ndarray, groups: int) -> list[int]:
    """SP23: classes in equally large groups of often confused ones: spectral order, then capacity-bound assignment to seeds."""
    n = len(counts)
    w = counts + counts.T
    np.fill_diagonal(w, 0)
    degree = np.maximum(w.sum(1), 1e-9)
    lap = np.eye(n) - w / np.sqrt(degree[:, None] * degree[None])
    vectors = np.linalg.eigh(lap)[1][:, : max(2, groups)]
    order = np.lexsort((np.arange(n), np.round(vectors[:, 1], 9)))
    size, out = -(-n // groups), [0] * n
    for place, i in enumerate(order):
        out[i] = place // size
    return out


def rebalanced_negatives(demand: dict[str, list[str]], capacity: dict[str, int]) -> dict[str, str | None]:
    """SP26, SP12: most constrained item first, each to its feasible key with the lowest relative load."""
    load = dict.fromkeys(capacity, 0)
    out: dict[str, str | None] = {}
    for item in sorted(demand, key=lambda x: (len(demand[x]), x)):
        free = [k for k in demand[item] if load.get(k, 0) < capacity.get(k, 0)]
        out[item] = min(free, key=lambda k: (load[k] / capacity[k], k)) if free else None
        if out[item]:
            load[out[item]] += 1
    return out


def pooled(pools: list[DataFrame], keys: list[str], most_iou: float, per_label: int, most: int) -> DataFrame:
    """Several pools of events in one; per key and label suppressed, then at most ``per_label``, then ``most`` by (confidence, length, earlier onset)."""
    from tidemark.operators.matching import non_maximum
    from tidemark.operators.sequences import capped

    every = pools[0]
    for p in pools[1:]:
        every = every.unionByName(p)
    order = [F.desc("conf"), F.desc(F.col("off") - F.col("onset")), "onset", "event_id"]
    kept = capped(non_maximum(every, [*keys, "label"], most_iou), [*keys, "label"], order, per_label).drop("rank")
    return capped(kept, keys, order, most)
