"""Grouped summaries: coverage, quotas, order statistics, weighted rates, ranking metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def coverage(labels: DataFrame, facts: DataFrame, key: str, *aggs: Column) -> DataFrame:
    """A1: one row per label, also for labels without facts (counts then are null: fill as needed)."""
    return labels.select(key).distinct().join(facts.groupBy(key).agg(*aggs), key, "left")


def at_least(counts: DataFrame, column: str, thresholds: list[int]) -> DataFrame:
    """A2: how many rows reach each threshold."""
    return counts.agg(*[F.count_if(F.col(column) >= t).alias(f"at_{t}") for t in thresholds])


def upper_median(column: str) -> Column:
    """A5: sorted[n // 2], the upper one of two middle values."""
    n = F.count(column)
    return F.element_at(F.array_sort(F.collect_list(column)), (F.floor(n / 2) + 1).cast("int"))


def upper_medians(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """A5 for groups of any size: by row number, without gathering a group's values."""
    w = Window.partitionBy(*keys)
    ranked = df.where(F.col(column).isNotNull()).withColumns({"_n": F.row_number().over(w.orderBy(column)), "_c": F.count("*").over(w)})
    return ranked.groupBy(*keys).agg(F.min(column).alias("least"), F.max(F.when(F.col("_n") == F.floor(F.col("_c") / 2) + 1, F.col(column))).alias("upper_median"), F.max(column).alias("most"))


def deficits(df: DataFrame, keys: list[str], tier: Column, target: int, tiers: int = 3) -> DataFrame:
    """Counts up to each tier and what is missing to the target."""
    counts = [F.count_if(tier <= t).alias(f"tier_{t}") for t in range(tiers)]
    return df.groupBy(*keys).agg(*counts).withColumn("deficit", F.greatest(F.lit(0), target - F.col(f"tier_{tiers - 1}")))


def slices(df: DataFrame, named: dict[str, Column], *aggs: Column) -> DataFrame:
    """Aggregates of overlapping named slices in one pass."""
    names = F.array_compact(F.array(*[F.when(p, F.lit(n)) for n, p in named.items()]))
    return df.withColumn("slice", F.explode(names)).groupBy("slice").agg(*aggs)


def confusion(df: DataFrame, gold: str, predicted: str) -> DataFrame:
    """A12."""
    return df.groupBy(gold, predicted).agg(F.count("*").alias("n"))


def mode(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The most frequent value, the least of equally frequent ones."""
    return df.groupBy(*keys, value).agg(F.count("*").alias("_n")).groupBy(*keys).agg(F.min_by(value, F.struct(-F.col("_n"), F.col(value))).alias("mode"))


def entropy(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Shannon entropy in bits."""
    n = df.groupBy(*keys, value).agg(F.count("*").alias("_n"))
    total = n.groupBy(*keys).agg(F.sum("_n").alias("_t"))
    p = F.col("_n") / F.col("_t")
    return n.join(total, keys).groupBy(*keys).agg((-F.sum(p * F.log2(p))).alias("entropy"))


def distribution(x: str) -> list[Column]:
    """Mean, median, tenths, extremes; zeros for no rows."""
    z = lambda v: F.coalesce(v, F.lit(0.0))
    return [z(F.avg(x)).alias("mean"), z(F.percentile(x, 0.5)).alias("median"), z(F.percentile(x, 0.1)).alias("p10"), z(F.percentile(x, 0.9)).alias("p90"), z(F.min(x)).alias("least"), z(F.max(x)).alias("most")]


def macro(df: DataFrame, outer: list[str], inner: list[str], value: str) -> DataFrame:
    """Mean of the means per inner group."""
    return df.groupBy(*outer, *inner).agg(F.avg(value).alias("_m")).groupBy(*outer).agg(F.avg("_m").alias("macro"))


def overlap_bin(x: Column) -> Column:
    """Bins closed on the right at quarters; up to 1e-8 is zero."""
    return F.when(x <= 1e-8, "zero").when(x <= 0.25, "low").when(x <= 0.5, "mid").when(x <= 0.75, "high").otherwise("full")


def class_weights(counts: DataFrame, n: str = "n", most: float = 10.0) -> DataFrame:
    """Clipped neg/pos weights, and inverse root weights with mean one."""
    w = Window.partitionBy()
    root = 1 / F.sqrt(F.col(n))
    total = F.sum(n).over(w)
    return counts.withColumns({"pos_weight": F.least(F.lit(most), F.greatest(F.lit(1.0), (total - F.col(n)) / F.col(n))), "root_weight": root / F.avg(root).over(w)})


def ranking(df: DataFrame, score: str, label: str) -> DataFrame:
    """AUROC (trapezoid) and AUPRC (steps), equal scores as one point.

    Points are aggregated first, so the single ordered window sees one row per
    distinct score.
    """
    points = df.groupBy(score).agg(F.sum(F.col(label).cast("double")).alias("p"), F.sum((1 - F.col(label)).cast("double")).alias("n"))
    w = Window.orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, 0)
    c = points.withColumns({"tp": F.sum("p").over(w), "fp": F.sum("n").over(w)})
    area = F.sum(F.col("n") * (F.col("tp") - F.col("p") / 2)) / (F.sum("n") * F.sum("p"))
    precision = F.col("tp") / (F.col("tp") + F.col("fp"))
    return c.agg(area.alias("auroc"), (F.sum(precision * F.col("p")) / F.sum("p")).alias("auprc"))


def calibration_error(df: DataFrame, score: str, label: str, bins: int = 10) -> DataFrame:
    """M6: expected calibration error; a score of one lies in the last bin."""
    b = F.least(F.lit(bins - 1), F.floor(F.col(score) * bins))
    per = df.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.abs(F.avg(score) - F.avg(F.col(label).cast("double"))).alias("gap"))
    return per.agg((F.sum(F.col("n") * F.col("gap")) / F.sum("n")).alias("ece"))


def best_balanced(df: DataFrame, score: str, label: str) -> DataFrame:
    """M7: the threshold with the best balanced accuracy; of equal ones the higher."""
    points = df.groupBy(score).agg(F.sum(F.col(label).cast("long")).alias("p"), F.sum((1 - F.col(label)).cast("long")).alias("n"))
    w = Window.orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy()
    acc = (F.sum("p").over(w) / F.sum("p").over(every) + 1 - F.sum("n").over(w) / F.sum("n").over(every)) / 2
    return points.withColumn("accuracy", F.round(acc, 9)).agg(F.max(F.struct("accuracy", score)).alias("m")).select(F.col(f"m.{score}").alias("threshold"), F.col("m.accuracy").alias("accuracy"))


def prf(tp, fp, fn) -> list[Column]:
    """Precision, recall and F1 with denominators of at least one."""
    p, r = tp / F.greatest(tp + fp, F.lit(1)), tp / F.greatest(tp + fn, F.lit(1))
    return [p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1")]


def harmonic(a: Column, b: Column) -> Column:
    """M20."""
    return F.when((a > 0) & (b > 0), 2 * a * b / (a + b)).otherwise(0.0)


def wilson_upper(successes: Column, total: Column, z: float = 1.96) -> Column:
    """M16."""
    p, zz = successes / total, z * z
    return (p + zz / (2 * total) + z * F.sqrt(p * (1 - p) / total + zz / (4 * total * total))) / (1 + zz / total)


def grid_fit(df: DataFrame, score: str, label: str, split: str, keys: list[str] | None = None, steps: int = 1000) -> DataFrame:
    """F1 at each of ``steps`` + 1 thresholds (per key), the best with ties to precision, recall, fewer false positives, then the higher threshold.

    Thresholds are fitted on the split ``val`` alone; another name is an error.
    Scores are counted per grid cell first; the grid meets cells, not rows.
    """
    if split != "val":
        raise ValueError(f"thresholds are not fitted on {split}")
    keys = keys or []
    cell = F.least(F.lit(steps), F.floor(F.col(score) * steps)).alias("cell")
    cells = df.groupBy(*keys, cell).agg(F.sum(F.col(label).cast("long")).alias("p"), F.sum((1 - F.col(label)).cast("long")).alias("n"))
    grid = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(steps).cast("bigint"))).alias("cell")
    every = (df.select(*keys).distinct() if keys else df.sparkSession.range(1)).select(*keys, grid)
    dense = every.join(cells, [*keys, "cell"], "left").na.fill(0, ["p", "n"])
    whole = Window.partitionBy(*keys)
    above = whole.orderBy(F.desc("cell")).rowsBetween(Window.unboundedPreceding, 0)
    s = dense.withColumns({"tp": F.sum("p").over(above), "fp": F.sum("n").over(above), "all": F.sum("p").over(whole)})
    scored = s.select(*keys, "cell", "fp", *prf(F.col("tp"), F.col("fp"), F.col("all") - F.col("tp")))
    best = scored.groupBy(*keys).agg(F.max(F.struct(F.round("f1", 9).alias("f1"), F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"), (-F.col("fp")).alias("fp"), "cell")).alias("m"))
    return best.select(*keys, (F.col("m.cell") / steps).alias("threshold"), "m.f1", "m.precision", "m.recall")


def gains(df: DataFrame, base: str, candidates: list[str], harm: float = 1.0) -> DataFrame:
    """Per candidate the mean gain over ``base``, the share of wins and of harm; and what choosing the best each time gains and chooses."""
    best = F.greatest(base, *candidates)
    chosen = F.when(F.col(base) == best, base)
    for name in candidates:
        chosen = chosen.when(F.col(name) == best, name)
    rate = lambda x: F.avg(x.cast("int"))
    out = [F.count("*").alias("n")]
    for name in candidates:
        gain = F.col(name) - F.col(base)
        out += [F.avg(gain).alias(f"{name}_gain"), rate(gain > 0).alias(f"{name}_wins"), rate(gain < -harm).alias(f"{name}_harm")]
    gain = best - F.col(base)
    out += [F.avg(gain).alias("oracle_gain"), rate(gain > 1e-7).alias("oracle_wins"), rate(gain >= 1).alias("oracle_by_1"), rate(gain >= 2).alias("oracle_by_2")]
    return df.agg(*out, *[F.count_if(chosen == name).alias(f"chose_{name}") for name in [base, *candidates]])


def mention_bias(df: DataFrame, first: str, second: str, predicted: str, gold: str) -> DataFrame:
    """Over questions that name two candidates: how often one is predicted, and the gaps by order of mention."""
    named = F.col(predicted).isin(F.col(first), F.col(second))
    is_first, right = F.col(gold) == F.col(first), (F.col(predicted) == F.col(gold)).cast("int")
    rate = lambda x: F.avg(x.cast("int"))
    return df.where(F.col(gold).isin(F.col(first), F.col(second))).agg(
        rate(named).alias("named_rate"),
        F.abs(F.avg(F.when(named, (F.col(predicted) == F.col(first)).cast("int"))) - rate(is_first)).alias("mention_bias"),
        F.abs(F.avg(F.when(is_first, right)) - F.avg(F.when(~is_first, right))).alias("accuracy_gap"),
    )


#: Measures over rows with evidence, over rows without, and over all.
ANSWERABLE = ("anchor_iou", "answer_iou", "union_iou", "weakest_iou", "boundary_mae", "duration_ratio", "energy_ratio")
OVERALL = ("reconstruction_error", "physical_forwards", "effective_evaluations")


def endpoints(df: DataFrame) -> DataFrame:
    """One row of counts and frozen measures of records (probability and label of no evidence, ANSWERABLE, retained energy, OVERALL, scene, creator).

    Ranking measures come from distinct probabilities, the rest from one pass.
    """
    has = ~F.col("no_evidence")
    label = F.col("no_evidence").cast("int")
    measures = [F.avg(F.when(has, F.col(c))).alias(c) for c in ANSWERABLE] + [F.avg(c).alias(c) for c in OVERALL]
    measures += [F.avg(F.when(~has, F.col("energy_ratio"))).alias("no_evidence_energy_ratio"), F.max("reconstruction_error").alias("reconstruction_maximum"), F.avg((F.col("probability") - label) ** 2).alias("brier")]
    counts = [F.count("*").alias("records"), F.count_distinct("scene").alias("scenes"), F.count_distinct("creator").alias("creators"), F.count_if(has).alias("answerable"), F.count_if(~has).alias("without_evidence"), F.sum("physical_forwards").alias("physical_total"), F.sum("effective_evaluations").alias("effective_total")]
    labelled = df.withColumn("_label", label)
    one = labelled.agg(*counts, *measures)
    # one row each
    return one.crossJoin(F.broadcast(ranking(labelled, "probability", "_label"))).crossJoin(F.broadcast(calibration_error(labelled, "probability", "_label")))


def policy_search(df: DataFrame, pads: list[float], thresholds: list[float], least_reject: float) -> DataFrame:
    """Per relation the threshold and pads with the best (mean IoU, accuracy, rejection, -mean span), the earlier of equal ones.

    ``df`` has relation, score, no_evidence, right (the answer is), onset, off and
    gold_onset, gold_off. Policies that reject at least ``least_reject`` of the
    rows without evidence come first. Rows are summed per pads and threshold step
    before thresholds see them.
    """
    grid = [(i * len(pads) + j, a, b) for i, a in enumerate(pads) for j, b in enumerate(pads)]
    pad = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(float(a)).alias("left"), F.lit(float(b)).alias("right_pad")) for k, a, b in grid])).alias("pad")
    step = sum((F.col("score") >= t).cast("int") for t in sorted(thresholds))  # how many thresholds the row reaches
    x = df.withColumn("step", step).select("*", pad)
    on, off = F.greatest(F.lit(0.0), F.col("onset") - F.col("pad.left")), F.col("off") + F.col("pad.right_pad")
    inner = F.greatest(F.lit(0.0), F.least(off, F.col("gold_off")) - F.greatest(on, F.col("gold_onset")))
    iou = inner / (off - on + F.col("gold_off") - F.col("gold_onset") - inner)
    has = ~F.col("no_evidence")
    sums = x.groupBy("relation", "pad", "step").agg(F.sum(F.when(has, iou).otherwise(0.0)).alias("iou"), F.count_if(has & F.col("right")).alias("ok"), F.count_if(has).alias("has"), F.count_if(~has).alias("none"), F.sum(F.when(has, off - on).otherwise(0.0)).alias("span"))
    levels = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(t)).alias("threshold")) for i, t in enumerate(sorted(thresholds), 1)])).alias("level")
    active = F.col("step") >= F.col("level.i")
    total = lambda c, when=None: F.sum(F.when(when, F.col(c)).otherwise(0) if when is not None else F.col(c))
    scored = sums.select("*", levels).groupBy("relation", "pad", "level").agg(
        F.round(total("iou", active) / F.greatest(total("has"), F.lit(1)), 9).alias("mean_iou"),
        F.round(total("ok", active) / F.greatest(total("has"), F.lit(1)), 9).alias("accuracy"),
        F.round(total("none", ~active) / F.greatest(total("none"), F.lit(1)), 9).alias("rejection"),
        F.round(F.coalesce(F.try_divide(total("span", active), total("has", active)), F.lit(0.0)), 9).alias("mean_span"),
    )
    key = F.struct((F.col("rejection") >= least_reject).alias("ok"), "mean_iou", "accuracy", "rejection", (-F.col("mean_span")).alias("s"), (-F.col("pad.k")).alias("k"), (-F.col("level.i")).alias("i"))
    return scored.groupBy("relation").agg(F.max_by(F.struct(F.col("level.threshold").alias("threshold"), F.col("pad.left").alias("left"), F.col("pad.right_pad").alias("right_pad"), "mean_iou", "accuracy", "rejection", "mean_span"), key).alias("m")).select("relation", "m.*")


def frame_metrics(df: DataFrame, example: str, score: str, target: str, threshold: float) -> DataFrame:
    """M3, M8: IoU and F1 of frames at a threshold, averaged over examples and over all frames; share of frames kept; examples without target left empty.

    An empty union is a match: both measures are one.
    """
    on, gold = F.col(score) >= threshold, F.col(target) == 1
    per = df.groupBy(example).agg(F.count_if(on & gold).alias("tp"), F.count_if(on & ~gold).alias("fp"), F.count_if(~on & gold).alias("fn"), F.count("*").alias("n"))
    iou = lambda tp, fp, fn: F.when(tp + fp + fn == 0, 1.0).otherwise(tp / F.greatest(tp + fp + fn, F.lit(1)))
    f1 = lambda tp, fp, fn: F.when(tp + fp + fn == 0, 1.0).otherwise(2 * tp / F.greatest(2 * tp + fp + fn, F.lit(1)))
    one, every = [F.col(c) for c in ("tp", "fp", "fn")], [F.sum(c) for c in ("tp", "fp", "fn")]
    none = F.col("tp") + F.col("fn") == 0
    return per.agg(F.avg(iou(*one)).alias("macro_iou"), iou(*every).alias("micro_iou"), F.avg(f1(*one)).alias("macro_f1"), f1(*every).alias("micro_f1"), (F.sum(F.col("tp") + F.col("fp")) / F.sum("n")).alias("retained"), F.avg(F.when(none, (F.col("fp") == 0).cast("int"))).alias("reject_rate"))
