"""Events from frame scores: islands, pieces around peaks and strongest segments, as windows and array expressions.

Frames are rows (keys, frame, p) with consecutive frame numbers per key. Islands
are found by gaps in a row number, seeds and peaks are rows of their own, and a
piece reaches from its peak over its island up to midway to the neighbouring
peaks; only arrays of one recording's peaks or frames are ever held together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.arrays import let

KINDS = ("threshold", "hysteresis", "valley", "peak")
#: Valley cuts: peaks count from this share of their run's highest frame.
HIGH_PEAK = 0.7
#: Frames of a bucket in which decoded and gold events meet.
PAIR_FRAMES = 64.0


def islands(frames: DataFrame, keys: list[str], least: float) -> DataFrame:
    """Frames at or above ``least`` with the start and stop (exclusive) of their unbroken run."""
    run = F.col("frame") - F.row_number().over(Window.partitionBy(*keys).orderBy("frame"))
    of = Window.partitionBy(*keys, "_run")
    return frames.where(F.col("p") >= least).withColumn("_run", run).withColumns({"start": F.min("frame").over(of), "stop": F.max("frame").over(of) + 1}).drop("_run")


def spaced(peaks: Column, gap: int) -> Column:
    """Frames of an array of (p, frame): the higher first (of equal ones the earlier), each ``gap`` frames from those before it."""
    ordered = F.array_sort(F.transform(peaks, lambda x: F.struct((-x["p"]).alias("down"), x["frame"].alias("frame"))))
    kept = lambda a, x: F.when(F.forall(a, lambda k: F.abs(k - x["frame"]) >= gap), F.array_append(a, x["frame"])).otherwise(a)
    return F.array_sort(F.aggregate(ordered, F.array().cast("array<bigint>"), kept))


def peaks(frames: DataFrame, keys: list[str], gap: int, among: Column) -> DataFrame:
    """Rows (keys, frame) of frames not below their neighbours within the keys, where ``among`` holds, ``gap`` apart."""
    w = Window.partitionBy(*keys).orderBy("frame")
    top = F.coalesce(F.col("p") >= F.lag("p").over(w), F.lit(True)) & F.coalesce(F.col("p") >= F.lead("p").over(w), F.lit(True))
    found = frames.withColumn("_top", top).where(F.col("_top") & among)
    return found.groupBy(*keys).agg(F.collect_list(F.struct("p", "frame")).alias("_peaks")).select(*keys, F.explode(spaced(F.col("_peaks"), gap)).alias("frame"))


def valley_parts(runs: DataFrame, keys: list[str], gap: int, ratio: float) -> DataFrame:
    """Islands (keys, frame, p, start, stop) cut between neighbouring high peaks at the lowest frame, where it is at most ``ratio`` of the lower peak."""
    run = [*keys, "start", "stop"]
    most = F.max("p").over(Window.partitionBy(*run))
    high = runs.withColumn("_most", most)
    at = peaks(high, run, gap, F.col("p") >= HIGH_PEAK * F.col("_most")).withColumn("_peak", F.col("frame"))
    w = Window.partitionBy(*run).orderBy("frame")
    marked = runs.join(at, [*run, "frame"], "left").withColumn("_left", F.last("_peak", True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    # between two peaks the lowest frame comes before the right one, which isn't below its neighbour
    valleys = marked.where("_left is not null").groupBy(*run, "_left").agg(F.min(F.struct("p", "frame")).alias("low"), F.max_by("p", F.col("frame") == F.col("_left")).alias("_p"))
    after = Window.partitionBy(*run).orderBy("_left")
    cuts = valleys.withColumns({"_next": F.lead("_left").over(after), "_next_p": F.lead("_p").over(after)}).where((F.col("_next") > F.col("_left") + 1) & (F.col("low.p") <= ratio * F.least("_p", "_next_p")))
    edge = F.greatest(F.col("start") + 1, F.least(F.col("stop") - 1, F.col("low.frame")))
    begins = runs.select(*run, F.col("start").alias("_begin")).distinct().union(cuts.select(*run, edge)).distinct()
    parts = begins.withColumn("_end", F.coalesce(F.lead("_begin").over(Window.partitionBy(*run).orderBy("_begin")), "stop"))
    return runs.join(parts, run).where((F.col("frame") >= F.col("_begin")) & (F.col("frame") < F.col("_end"))).select(*keys, "frame", "p", F.col("_begin").alias("start"), F.col("_end").alias("stop"))


def merged(pieces: DataFrame, keys: list[str], gap: int) -> DataFrame:
    """Pieces (keys, start, stop, peak) at most ``gap`` frames apart become one."""
    w = Window.partitionBy(*keys).orderBy("start", "stop")
    before = F.max("stop").over(w.rowsBetween(Window.unboundedPreceding, -1))
    grouped = pieces.withColumn("_new", F.when(F.col("start") <= before + gap, 0).otherwise(1)).withColumn("_n", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return grouped.groupBy(*keys, "_n").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.max("peak").alias("peak")).drop("_n")


def decoded(frames: DataFrame, keys: list[str], high: float, low: float, kind: str, gap: int = 1, ratio: float = 0.5, merge: int = 0) -> DataFrame:
    """(keys, start, stop, peak) of events seeded at ``high``; peak is their highest frame's score.

    ``threshold`` takes the runs at or above ``high``. The others take, around
    each seed's highest frame (the first of equal ones), its island at or above
    ``low`` up to midway to the neighbouring seeds' highest frames: ``hysteresis``
    has a seed per run, ``valley`` one per part of a run between valleys, ``peak``
    one per single peak, ``gap`` frames apart. Events at most ``merge`` frames
    apart become one.
    """
    runs = islands(frames, keys, high)
    if kind == "threshold":
        return merged(runs.groupBy(*keys, "start", "stop").agg(F.max("p").alias("peak")), keys, merge)
    if kind == "peak":
        tops = peaks(frames, keys, gap, F.col("p") >= high)
    else:
        seeds = valley_parts(runs, keys, gap, ratio) if kind == "valley" else runs
        tops = seeds.groupBy(*keys, "start", "stop").agg(F.min(F.struct((-F.col("p")).alias("down"), "frame")).alias("_t")).select(*keys, F.col("_t.frame").alias("frame"))
    w = Window.partitionBy(*keys).orderBy("frame")
    middle = lambda a, b: F.floor((a + b) / 2)
    first = F.coalesce(middle(F.lag("frame").over(w), F.col("frame")), F.lit(0))
    bounds = tops.withColumns({"_first": first, "_last": middle(F.col("frame"), F.lead("frame").over(w))}).withColumn("_last", F.when(F.col("_last").isNotNull(), F.greatest(F.col("_first") + 1, "_last")))
    around = bounds.join(islands(frames, keys, low).drop("p"), [*keys, "frame"])
    pieces = around.select(*keys, F.col("start").alias("_island"), F.greatest("start", "_first").alias("_begin"), F.greatest(F.col("frame") + 1, F.least("stop", F.coalesce("_last", "stop"))).alias("_end"))
    inside = islands(frames, keys, low).withColumnRenamed("start", "_island").drop("stop")
    whole = inside.join(pieces, [*keys, "_island"]).where((F.col("frame") >= F.col("_begin")) & (F.col("frame") < F.col("_end")))
    return merged(whole.groupBy(*keys, F.col("_begin").alias("start"), F.col("_end").alias("stop")).agg(F.max("p").alias("peak")), keys, merge)


def strongest(frames: DataFrame, keys: list[str], most: int, share: float, least: float, most_iou: float = 0.5) -> DataFrame:
    """Up to ``most`` segments (keys, start, stop, peak) per key, found one after the other.

    Each is the unbroken stretch, around the highest frame left (the first of
    equal ones), of frames at or above ``share`` of it and ``least``. Its frames
    leave the pool; it counts unless an earlier one overlaps it at ``most_iou``. A
    recording's frames are one array, as many as it is long.
    """
    state = "struct<left: array<double>, found: array<struct<start: bigint, stop: bigint, peak: double>>>"

    def reach(side: Column, cut: Column) -> Column:
        """How many elements from the front on are at or above the cut."""
        below = F.array_position(F.transform(side, lambda x: x < cut), F.lit(True))
        return F.when(below == 0, F.size(side)).otherwise(below - 1).cast("bigint")

    def grown(x: Column) -> Column:
        """The state (left, found, peak, start, stop) with its segment taken."""
        overlap = lambda o: F.greatest(F.lit(0), F.least(o["stop"], x["stop"]) - F.greatest(o["start"], x["start"])) / (F.greatest(o["stop"], x["stop"]) - F.least(o["start"], x["start"]))
        new = F.struct(x["start"].alias("start"), x["stop"].alias("stop"), x["peak"].alias("peak"))
        more = F.when(F.forall(x["found"], lambda o: overlap(o) < most_iou), F.array_append(x["found"], new)).otherwise(x["found"])
        rest = F.transform(x["left"], lambda v, i: F.when((i >= x["start"]) & (i < x["stop"]), F.lit(-1.0)).otherwise(v))
        return F.struct(rest.alias("left"), more.alias("found"))

    def placed(x: Column) -> Column:
        """The state (left, found, peak, at, from one on, and cut) with the segment's ends."""
        start = x["at"] - 1 - reach(F.reverse(F.slice(x["left"], F.lit(1), (x["at"] - 1).cast("int"))), x["cut"])
        stop = x["at"] + reach(F.slice(x["left"], (x["at"] + 1).cast("int"), F.size(x["left"])), x["cut"])
        return F.struct(x["left"].alias("left"), x["found"].alias("found"), x["peak"].alias("peak"), start.alias("start"), stop.alias("stop"))

    def step(s: Column, _: Column) -> Column:
        # each part is bound once: inside a lambda it would be worked out for every frame
        top = F.struct(s["left"].alias("left"), s["found"].alias("found"), F.array_max(s["left"]).alias("peak"))
        at = lambda x: F.struct(x["left"].alias("left"), x["found"].alias("found"), x["peak"].alias("peak"), F.array_position(x["left"], x["peak"]).alias("at"), F.greatest(F.lit(least), share * x["peak"]).alias("cut"))
        taken = lambda x: let(at(x), lambda y: let(placed(y), grown))
        go_on = lambda x: (F.size(x["found"]) < most) & (x["peak"] >= least)
        return let(top, lambda x: F.when(go_on(x), taken(x).cast(state)).otherwise(F.struct(x["left"].alias("left"), x["found"].alias("found")).cast(state))).cast(state)

    rows = frames.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("frame", F.col("p").cast("double").alias("p")))), lambda x: x["p"]).alias("_p"))
    start = F.struct(F.col("_p").alias("left"), F.array().alias("found")).cast(state)
    found = F.aggregate(F.sequence(F.lit(1), F.lit(3 * most)), start, step)["found"]
    return rows.select(*keys, F.inline(found))


def class_thresholds(frames: DataFrame, gold: DataFrame, grid: list[float], least_iou: float, least_frames: int = 1, merge: int = 0) -> tuple[DataFrame, DataFrame]:
    """(chosen row per label, all rows per label and threshold) of event scores of decoded frames (scene, label, frame, p) against ``gold`` (scene, label, onset, off in frames).

    At each threshold runs are joined over gaps up to ``merge`` frames, those
    under ``least_frames`` go, and the rest is matched one to one with gold events
    at ``least_iou``, as many as can be. The best threshold has the highest F1,
    then precision, recall, fewest false events and the highest threshold. The
    grid multiplies the frames, so its length is the cost's factor. Pairs are
    joined by buckets of frames, so ``least_iou`` must be above 0.
    """
    from tidemark.operators.intervals import hull_iou, overlap_join
    from tidemark.operators.matching import greatest_sizes

    if least_iou <= 0:
        raise ValueError("least_iou must be above 0")
    steps = F.explode(F.array(*map(F.lit, grid))).alias("threshold")
    at = frames.select("*", steps).where("p >= threshold")
    keys = ["scene", "label", "threshold"]
    runs = islands(at, keys, min(grid, default=0.0)).groupBy(*keys, "start", "stop").agg(F.max("p").alias("peak"))
    events = merged(runs, keys, merge).where(F.col("stop") - F.col("start") >= least_frames)
    predicted = events.select(*keys, F.col("start").cast("double").alias("onset"), F.col("stop").cast("double").alias("off"), F.col("start").alias("event_id"))
    wanted = gold.withColumn("event_id", F.monotonically_increasing_id()).select("scene", "label", "onset", "off", "event_id", steps)
    near = overlap_join(predicted, wanted, keys, PAIR_FRAMES).where(hull_iou("l_onset", "l_off", "r_onset", "r_off") >= least_iou)
    sizes = greatest_sizes(near.select(*[F.col(f"l_{k}").alias(k) for k in keys], "l_event_id", "r_event_id"), keys, "l_event_id", "r_event_id")
    # one row per label and threshold of each of the three counts
    tally = lambda df, tp, p, g: df.select("label", "threshold", *[x.cast("bigint").alias(c) for x, c in ((tp, "tp"), (p, "p"), (g, "g"))])
    none, one = F.lit(0), F.lit(1)
    counts = tally(sizes, F.col("matched"), none, none).union(tally(events, none, one, none)).union(tally(gold.select("label", steps), none, none, one)).groupBy("label", "threshold").agg(F.sum("tp").alias("tp"), (F.sum("p") - F.sum("tp")).alias("fp"), (F.sum("g") - F.sum("tp")).alias("fn"))
    every = frames.select("label").union(gold.select("label")).distinct().select("label", steps)
    full = every.join(counts, ["label", "threshold"], "left").fillna(0, ["tp", "fp", "fn"])
    precision, recall = F.col("tp") / F.greatest(F.col("tp") + F.col("fp"), F.lit(1)), F.col("tp") / F.greatest(F.col("tp") + F.col("fn"), F.lit(1))
    curves = full.withColumns({"precision": precision, "recall": recall}).withColumn("f1", 2 * F.col("precision") * F.col("recall") / F.greatest(F.col("precision") + F.col("recall"), F.lit(1e-12)))
    best = F.row_number().over(Window.partitionBy("label").orderBy(F.desc("f1"), F.desc("precision"), F.desc("recall"), "fp", F.desc("threshold")))
    return curves.withColumn("_r", best).where("_r = 1").drop("_r"), curves
