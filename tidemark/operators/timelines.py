"""The timeline query language: ordered events of a scene and questions about them.

Dialects differ in order, neighbour rule and missing-anchor rule, so each keeps
its own functions (suffixes name the dialect). Input columns: scene, label,
onset, off, event_id, conf; ``event_id`` breaks every tie.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ORDER = ("onset", "off", "label", "event_id")


def in_scene(*order: str) -> Window:
    return Window.partitionBy("scene").orderBy(*(order or ORDER))


def flattened(df: DataFrame, order: tuple[str, ...] = ORDER) -> DataFrame:
    """Position in the scene and occurrence number of the label."""
    by_label = Window.partitionBy("scene", "label").orderBy(*order)
    return df.withColumns({"position": F.row_number().over(in_scene(*order)), "occurrence": F.row_number().over(by_label)})


def listed(df: DataFrame) -> DataFrame:
    """Labels in order of first appearance, comma-joined."""
    first = flattened(df).groupBy("scene", "label").agg(F.min("position").alias("p"))
    return first.groupBy("scene").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "label"))), lambda x: x["label"]), ", ").alias("answer"))


def counted(df: DataFrame, label: str) -> DataFrame:
    """How often the label occurs, and YES or NO."""
    n = F.count_if(F.col("label") == label)
    return df.groupBy("scene").agg(n.alias("n"), F.when(n > 0, "YES").otherwise("NO").alias("present"))


def located(df: DataFrame, label: str) -> DataFrame:
    """T5, F25: 'start–end s' of each occurrence, two decimals; no occurrence: NONE.

    Decimals are those of the double itself, half to even, as C prints them;
    format_string would round the shortest decimal that reads as the double.
    """
    spans = F.array_sort(F.collect_list(F.when(F.col("label") == label, F.struct("onset", "off", "event_id"))))
    two = lambda x: F.call_function("format_number", x, F.lit("0.00"))
    text = F.array_join(F.transform(spans, lambda x: F.concat(two(x["onset"]), F.lit("–"), two(x["off"]), F.lit("s"))), ", ")
    return df.groupBy("scene").agg(F.when(text != "", text).otherwise("NONE").alias("answer"))


def extremes(df: DataFrame) -> DataFrame:
    """First, last and longest event (earliest of equally long), and the confidence-weighted longest."""
    key = F.struct("onset", "off", "label", "event_id")
    length = F.col("off") - F.col("onset")
    return df.groupBy("scene").agg(
        F.min_by("label", key).alias("first"),
        F.max_by("label", key).alias("last"),
        F.max_by("label", F.struct(length, -F.col("onset"), -F.col("event_id"))).alias("longest"),
        F.max_by("label", F.struct(length, "conf", -F.col("event_id"))).alias("longest_by_confidence"),
        F.max_by("label", F.struct(length * (0.5 + F.col("conf")), -F.col("event_id"))).alias("longest_weighted"),
    )


def nth(df: DataFrame, label: str, n: int, order: tuple = ORDER) -> DataFrame:
    """The n-th occurrence of a label per scene; only rows of the label are shuffled, by scene alone."""
    return df.where(F.col("label") == label).withColumn("occurrence", F.row_number().over(in_scene(*order))).where(F.col("occurrence") == n)


def _open_order() -> tuple:
    """Order of the open dialects: of equal times the surer event first."""
    return ("onset", "off", F.desc("conf"), "event_id")


def anchored(df: DataFrame, anchor: DataFrame) -> DataFrame:
    """All events of all scenes with their scene's anchor (a_on, a_off, a_id; null where it is absent)."""
    return df.join(anchor.select("scene", F.col("onset").alias("a_on"), F.col("off").alias("a_off"), F.col("event_id").alias("a_id")), "scene", "left")


def reasoned(answer: Column, found: str, missing: str, absent: str) -> Column:
    """Why an answer is what it is: the anchor is absent, no event fits, or it was found."""
    return F.when(F.max("a_id").isNull(), absent).when(answer.isNull(), missing).otherwise(found)


def neighbours(df: DataFrame, label: str, n: int) -> DataFrame:
    """T8 (dialects L1, L2, L6): labels next to the n-th occurrence in scene order, one row per scene.

    Without the anchor both answers are NONE for ``anchor_absent``; at an end of
    the scene one is NONE for ``no_temporal_neighbour``. One sort per scene.
    """
    w = in_scene()
    is_label = F.col("label") == label
    k = F.count_if(is_label).over(w.rowsBetween(Window.unboundedPreceding, 0))
    near = df.select("scene", F.when(is_label & (k == n), F.struct(F.lag("label").over(w).alias("before"), F.lead("label").over(w).alias("after"))).alias("x"))
    one = near.groupBy("scene").agg(F.max("x").alias("x"))

    def reason(side):
        return F.when(F.col("x").isNull(), "anchor_absent").when(F.col(f"x.{side}").isNull(), "no_temporal_neighbour").otherwise("adjacent_onset")

    return one.select("scene", *[c for side in ("before", "after") for c in (F.coalesce(f"x.{side}", F.lit("NONE")).alias(side), reason(side).alias(f"{side}_reason"))])


def strict_neighbours(df: DataFrame, label: str, n: int, epsilon: float = 1e-6) -> DataFrame:
    """T9 / J9 (L3): nearest strictly earlier and later onset; the label may repeat. Every scene has a row with reasons."""
    both = anchored(df, nth(df, label, n))
    earlier, later = F.col("onset") < F.col("a_on") - epsilon, F.col("onset") > F.col("a_on") + epsilon
    before = F.max_by(F.when(earlier, F.col("label")), F.when(earlier, F.struct("onset", -F.col("event_id"))))
    after = F.min_by(F.when(later, F.col("label")), F.when(later, F.struct("onset", "event_id")))
    found, absent = "anchor_occurrence_and_temporal_neighbour", "absent_anchor_occurrence"
    return both.groupBy("scene").agg(before.alias("before"), reasoned(before, found, "no_preceding_proposal", absent).alias("before_reason"), after.alias("after"), reasoned(after, found, "no_following_proposal", absent).alias("after_reason"))


def scored_neighbours(df: DataFrame, label: str, n: int, least: float = 0.2, epsilon: float = 1e-6) -> DataFrame:
    """T10 (L5): before and after, the event of another label with the largest conf - seconds between onsets - 2 IoU.

    Only events of at least ``least`` confidence count, as anchors too; of equal
    scores the first in order wins. Every scene has a row with reasons.
    """
    from tidemark.operators.intervals import hull_iou

    sure = df.where(F.col("conf") >= least)
    anchor = nth(sure, label, n, _open_order())
    both = anchored(df, anchor)
    fits = (F.col("label") != label) & (F.col("conf") >= least)
    score = F.col("conf") - F.abs(F.col("onset") - F.col("a_on")) - 2 * hull_iou("a_on", "a_off", "onset", "off")
    rank = F.struct(-score, "onset", "off", -F.col("conf"), "event_id")
    sides = {"before": F.col("onset") < F.col("a_on") - epsilon, "after": F.col("onset") > F.col("a_on") + epsilon}
    out = []
    for side, when in sides.items():
        answer = F.min_by(F.when(fits & when, F.col("label")), F.when(fits & when, rank))
        out += [F.coalesce(answer, F.lit("no_evidence")).alias(side), reasoned(answer, f"{side}_reranked", f"{side}_missing", "anchor_missing").alias(f"{side}_reason")]
    return both.groupBy("scene").agg(*out)


def preferring_neighbours(df: DataFrame, label: str, n: int, window: float = 0.08, sure: float = 0.5, epsilon: float = 1e-6) -> DataFrame:
    """T9 (L4): neighbours that prefer events apart from the anchor (by up to ``window`` seconds of overlap).

    After: another label; the earliest apart one that is ``sure``, else the
    surest apart one, else the surest. Before: any label; the apart one that ends
    last, else the one that starts last. Every scene has a row with reasons.
    """
    both = anchored(df, nth(df, label, n, _open_order()))
    order = [F.col("onset"), F.col("off"), -F.col("conf"), F.col("event_id")]
    later = (F.col("onset") > F.col("a_on") + epsilon) & (F.col("label") != label)
    apart = F.col("onset") >= F.col("a_off") - window
    tier = F.when(apart & (F.col("conf") >= sure), 0).when(apart, 1).otherwise(2)
    first = F.when(tier == 0, F.col("onset")).otherwise(-F.col("conf"))
    after = F.min_by(F.when(later, F.col("label")), F.when(later, F.struct(tier, first, *[c.alias(f"o{i}") for i, c in enumerate(order)])))
    earlier = (F.col("onset") < F.col("a_on") - epsilon) & (F.col("event_id") != F.col("a_id"))
    ended = F.col("off") <= F.col("a_on") + window
    last = F.when(ended, -F.col("off")).otherwise(-F.col("onset"))
    before = F.min_by(F.when(earlier, F.col("label")), F.when(earlier, F.struct(F.when(ended, 0).otherwise(1), last, -F.col("conf"), *[c.alias(f"o{i}") for i, c in enumerate(order)])))
    return both.groupBy("scene").agg(
        F.coalesce(before, F.lit("no_evidence")).alias("before"),
        reasoned(before, "before_neighbor", "no_preceding_event", "anchor_occurrence_missing").alias("before_reason"),
        F.coalesce(after, F.lit("no_evidence")).alias("after"),
        reasoned(after, "after_neighbor", "no_following_event", "anchor_occurrence_missing").alias("after_reason"),
    )


def between(df: DataFrame, left: str, right: str) -> DataFrame:
    """Distinct labels with onsets strictly between the first occurrences, in order; the strongest; the central one.

    Every scene has a row: ``anchor_absent`` if either anchor is, ``nothing_between`` if no event is.
    """
    a = nth(df, left, 1).select("scene", F.col("onset").alias("l_on"))
    b = nth(df, right, 1).select("scene", F.col("onset").alias("r_on"))
    both = df.join(a, "scene", "left").join(b, "scene", "left")
    inner = F.col("l_on").isNotNull() & F.col("r_on").isNotNull() & (F.col("onset") > F.least("l_on", "r_on")) & (F.col("onset") < F.greatest("l_on", "r_on"))
    central = 2.4 * F.col("conf") - F.abs(F.col("onset") - (F.col("l_on") + F.col("r_on")) / 2) / F.abs(F.col("r_on") - F.col("l_on"))
    in_order = F.array_sort(F.collect_list(F.when(inner, F.struct("onset", "event_id", "label"))))
    n = F.count_if(inner)
    return both.groupBy("scene").agg(
        F.when(n > 0, F.array_join(F.array_distinct(F.transform(in_order, lambda x: x["label"])), ", ")).otherwise("NONE").alias("labels"),
        F.max_by(F.when(inner, F.col("label")), F.when(inner, F.struct("conf", -F.col("event_id")))).alias("strongest"),
        F.max_by(F.when(inner, F.col("label")), F.when(inner, F.struct(central, -F.col("event_id")))).alias("central"),
        F.when(F.max("l_on").isNull() | F.max("r_on").isNull(), "anchor_absent").when(n == 0, "nothing_between").otherwise("between_onsets").alias("reason"),
    )


def overlapping(df: DataFrame, label: str) -> DataFrame:
    """Other labels that overlap any occurrence of the anchor label, in onset order; every scene has a row with a reason."""
    from tidemark.operators.intervals import overlap_join

    pairs = overlap_join(df.where(F.col("label") == label), df.where(F.col("label") != label), ["scene"])
    first = pairs.groupBy(F.col("l_scene").alias("scene"), F.col("r_label").alias("label")).agg(F.min(F.struct("r_onset", "r_event_id")).alias("p"))
    found = first.groupBy("scene").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "label"))), lambda x: x["label"]), ", ").alias("answer"))
    every = df.groupBy("scene").agg(F.count_if(F.col("label") == label).alias("n")).join(found, "scene", "left")
    return every.select("scene", F.coalesce("answer", F.lit("NONE")).alias("answer"), F.when(F.col("n") == 0, "anchor_absent").when(F.col("answer").isNull(), "no_overlap").otherwise("interval_overlap").alias("reason"))


def first_among(df: DataFrame, labels: list[str]) -> DataFrame:
    """The candidate that occurs first; null with a reason if any is absent."""
    own = df.where(F.col("label").isin(labels)).groupBy("scene").agg(F.min_by("label", F.struct("onset", "off", "event_id")).alias("a"), F.count_distinct("label").alias("n"))
    every = df.select("scene").distinct().join(own, "scene", "left")
    full = F.coalesce(F.col("n"), F.lit(0)) == len(labels)
    return every.select("scene", F.when(full, F.col("a")).alias("answer"), F.when(~full, "candidate_absent").alias("reason"))


def offered_after(df: DataFrame, label: str, options: list[str]) -> DataFrame:
    """The next event after the first occurrence whose label is offered; every scene has a row with a reason."""
    both = anchored(df, nth(df, label, 1))
    later = (F.col("onset") > F.col("a_on")) & F.array_contains(F.array(*map(F.lit, options)), F.col("label"))
    answer = F.min_by(F.when(later, F.col("label")), F.when(later, F.struct("onset", "off", "event_id")))
    return both.groupBy("scene").agg(answer.alias("answer"), reasoned(answer, "offered", "no_offered_event", "anchor_absent").alias("reason"))


def boundary_neighbours(df: DataFrame, label: str, n: int, slack: float = 0.05) -> DataFrame:
    """T25 (L8): before = latest off up to the anchor's onset; after = earliest onset from its off, both with slack; every scene has a row."""
    both = anchored(df, nth(df, label, n))
    other = F.col("event_id") != F.col("a_id")
    earlier, later = other & (F.col("off") <= F.col("a_on") + slack), other & (F.col("onset") >= F.col("a_off") - slack)
    before = F.max_by(F.when(earlier, F.col("label")), F.when(earlier, F.struct("off", -F.col("event_id"))))
    after = F.min_by(F.when(later, F.col("label")), F.when(later, F.struct("onset", "event_id")))
    return both.groupBy("scene").agg(before.alias("before"), after.alias("after"), F.max("a_id").isNull().alias("anchor_absent"))


def evidence_window(df: DataFrame) -> DataFrame:
    """Hull of the evidence events per scene and label."""
    return df.groupBy("scene", "label").agg(F.min("onset").alias("start"), F.max("off").alias("stop"))


def best_pair(df: DataFrame, anchor: str, answer: str, distance: float = 1e-6, crowd: float = 0.05, least: float = 0.0) -> DataFrame:
    """Over all pairs of an anchor and a later answer, the one with the largest conf + conf - distance - crowding.

    Distance is ``distance`` per second between the onsets, crowding ``crowd``
    per event between the two. Both are differences, so an anchor's best answer
    is a maximum over the rows after it: one window, no pairs. Every scene has a
    row; below ``least``, or without a pair, there is no evidence.
    """
    is_anchor, is_answer = F.col("label") == anchor, F.col("label") == answer
    share = F.col("conf") - distance * F.col("onset") - crowd * F.col("position")
    after = in_scene().rowsBetween(1, Window.unboundedFollowing)
    best = F.max(F.when(is_answer, F.struct(share.alias("s"), (-F.col("event_id")).alias("b")))).over(after)
    paired = flattened(df).withColumn("best", best)
    total = F.col("conf") + distance * F.col("onset") + crowd * (F.col("position") + 1) + F.col("best.s")
    ok = is_anchor & F.col("best").isNotNull()
    out = paired.groupBy("scene").agg(F.max(F.when(ok, F.struct(total.alias("score"), (-F.col("event_id")).alias("a"), F.col("best.b").alias("b")))).alias("m"), F.count_if(is_anchor).alias("n"))
    good = F.col("m.score") >= least
    reason = F.when(F.col("n") == 0, "anchor_missing").when(F.col("m").isNull(), "no_event_after_anchor").when(good, "ok").otherwise("pair_score_below_min")
    return out.select("scene", F.when(good, -F.col("m.a")).alias("anchor_id"), F.when(good, -F.col("m.b")).alias("answer_id"), F.col("m.score").alias("score"), reason.alias("reason"))


def qa_items(df: DataFrame) -> DataFrame:
    """A question per adjacent pair in each direction, and the two ends without an answer."""
    w = in_scene()
    t = flattened(df).withColumns({"before": F.lag("label").over(w), "after": F.lead("label").over(w)})
    parts = [t.select("scene", F.lit(rel).alias("relation"), F.col("label").alias("anchor"), "occurrence", F.col(rel).alias("answer"), F.col(rel).isNull().alias("no_evidence")) for rel in ("before", "after")]
    return parts[0].unionByName(parts[1])


def balanced(items: DataFrame, keys: list[str], flag: str, order: Column, most: int) -> DataFrame:
    """As many positives as negatives per key, at most ``most``, in hash order."""
    n = F.row_number().over(Window.partitionBy(*keys, flag).orderBy(order))
    sizes = items.groupBy(*keys).agg(F.least(F.count_if(F.col(flag)), F.count_if(~F.col(flag)), F.lit(most)).alias("_m"))
    return items.withColumn("_n", n).join(sizes, keys).where("_n <= _m").drop("_n", "_m")


def unambiguous_items(df: DataFrame, seed: str, gap: float = 0.08, most: int = 4, most_empty: int = 2) -> DataFrame:
    """Questions about neighbours with one right answer, so many per scene.

    Anchor and answer overlap no event of another label, differ in label, do not
    overlap, and start more than ``gap`` seconds apart; the ends of a scene ask
    for what isn't there. Per scene, both relations take turns in hash order.
    """
    from tidemark.operators.intervals import overlap_join

    meets = overlap_join(df, df, ["scene"]).where("l_label <> r_label").select(F.col("l_event_id").alias("event_id"), F.lit(True).alias("_m")).distinct()
    w = in_scene()
    t = flattened(df).join(meets, "event_id", "left").withColumn("ambiguous", F.col("_m").isNotNull())
    parts = []
    for relation, take in (("after", F.lead), ("before", F.lag)):
        other = {c: take(c).over(w) for c in ("label", "onset", "off", "ambiguous")}
        x = t.withColumns({f"o_{c}": v for c, v in other.items()})
        first, second = (("onset", "off"), "o_onset") if relation == "after" else (("o_onset", "o_off"), "onset")
        apart = (F.col(second) - F.col(first[0]) > gap) & (F.col(second) >= F.col(first[1]))
        good = ~F.col("ambiguous") & (F.col("o_label").isNull() | (~F.col("o_ambiguous") & (F.col("o_label") != F.col("label")) & apart))
        parts.append(x.where(good).select("scene", F.lit(relation).alias("relation"), F.col("label").alias("anchor"), "occurrence", F.col("o_label").alias("answer"), F.col("o_label").isNull().alias("no_evidence")))
    items = parts[0].unionByName(parts[1])
    text = lambda *c: F.sha2(F.concat_ws(":", F.lit(seed), *c), 256)
    turn = F.row_number().over(Window.partitionBy("scene", "relation", "no_evidence").orderBy(text("scene", "relation", "anchor", "occurrence")))
    place = F.row_number().over(Window.partitionBy("scene", "no_evidence").orderBy("_i", text("scene", "relation")))
    return items.withColumn("_i", turn).withColumn("_z", place).where(F.col("_z") <= F.when(F.col("no_evidence"), most_empty).otherwise(most)).drop("_i", "_z")


#: Slot, relation, place of the anchor and of the answer (from zero; -1: the absent label, no evidence); first: the two named, in order of mention.
FAMILY = [("after_0", "after", 0, 1), ("after_1", "after", 1, 2), ("before_0", "before", 2, 1), ("before_1", "before", 3, 2), ("first_forward", "first", 0, 2), ("first_reversed", "first", 2, 0), ("after_absent", "after", -1, -1), ("before_absent", "before", -1, -1)]


def question_family(scenes: DataFrame, absent: Column, ordinal: Column, nothing: str = "no_evidence") -> DataFrame:
    """The eight questions of each scene of four events (array ``events`` of event_id, phrase, in order of onset); other scenes give none.

    The answer's place among the five options goes round with scene and slot;
    the label ``absent`` asks for what isn't there.
    """
    slots = F.array(*[F.struct(F.lit(i).alias("index"), F.lit(n).alias("slot"), F.lit(r).alias("relation"), F.lit(a).alias("a"), F.lit(b).alias("b")) for i, (n, r, a, b) in enumerate(FAMILY)])
    q = scenes.where(F.size("events") == 4).withColumns({"_absent": absent, "_ordinal": ordinal}).select("*", F.inline(slots))
    phrase = lambda i: F.get("events", F.col(i) if isinstance(i, str) else i)["phrase"]
    event = lambda i: F.get("events", F.col(i) if isinstance(i, str) else i)["event_id"]
    none = F.col("a") < 0
    first = F.least("a", "b")
    answer = F.when(none, nothing).when(F.col("relation") == "first", phrase(first)).otherwise(phrase("b"))
    text = F.when(F.col("relation") == "first", F.concat(F.lit("Which starts first, "), phrase("a"), F.lit(" or "), phrase("b"), F.lit("?"))).otherwise(F.concat(F.lit("What comes right "), "relation", F.lit(" "), F.when(none, F.col("_absent")).otherwise(phrase("a")), F.lit("?")))
    place = ((F.col("_ordinal") * len(FAMILY) + F.col("index")) % 5).cast("int")
    others = F.array_except(F.concat(F.transform("events", lambda e: e["phrase"]), F.array(F.lit(nothing))), F.array("answer"))
    q = q.withColumns({"answer": answer, "place": place})
    options = F.concat(F.slice(others, F.lit(1), F.col("place")), F.array("answer"), F.slice(others, F.col("place") + 1, F.lit(4)))
    evidence = F.when(none, F.array().cast(f"array<{dict(scenes.select(F.explode('events').alias('e')).select('e.event_id').dtypes)['event_id']}>")).otherwise(F.array(event(F.least("a", "b")), event(F.greatest("a", "b"))))
    return q.select(*scenes.columns, "slot", "relation", text.alias("question"), "answer", F.col("place").alias("answer_index"), options.alias("options"), none.alias("no_evidence"), evidence.alias("evidence"))
