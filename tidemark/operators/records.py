"""Checks of question records as columns: which rules a record breaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NO_EVIDENCE = "no_evidence"


def _position(event_id: str) -> Column:
    """Place of an event in the record's events by onset, from one; zero if it isn't there."""
    ordered = F.transform(F.array_sort(F.transform("events", lambda e: F.struct(e["onset"].alias("o"), e["event_id"].alias("id")))), lambda e: e["id"])
    return F.coalesce(F.array_position(ordered, F.col(event_id)), F.lit(0))


def _count(label: Column) -> Column:
    return F.size(F.filter("events", lambda e: e["label"] == label))


def violations(records: DataFrame) -> DataFrame:
    """``records`` with ``violations``, the names of the rules that each breaks, in order.

    Columns: split, record_id, rate, duration, samples, events
    (array of event_id, label, onset), relation (after, before, first),
    no_evidence, query_label, query_ordinal, candidates (array of two labels),
    anchor_id, answer_id, options, answer_index, answer. A null where a rule
    needs a value breaks the rule.
    """
    ids = F.transform("events", lambda e: e["event_id"])
    onsets = F.transform("events", lambda e: e["onset"])
    anchor, answer = _position("anchor_id"), _position("answer_id")
    empty = F.col("no_evidence")
    neighbour = F.col("relation").isin("after", "before")
    step = F.when(F.col("relation") == "after", 1).otherwise(-1)
    at = lambda i: F.get(F.filter("events", lambda e: e["event_id"] == F.col(i)), F.lit(0))["onset"]
    absent = F.forall("candidates", lambda c: _count(c) == 0)
    rules = {
        "id_prefix": F.startswith("record_id", F.concat("split", F.lit("_"))),
        "samples": F.round(F.col("rate") * F.col("duration")) == F.col("samples"),
        "events": F.size("events") >= 4,
        "unique_ids": F.size(F.array_distinct(ids)) == F.size(ids),
        "unique_onsets": F.size(F.array_distinct(onsets)) == F.size(onsets),
        "options": (F.size("options") == 5) & (F.size(F.array_distinct("options")) == 5) & F.array_contains("options", NO_EVIDENCE),
        "answer_index": F.get("options", F.col("answer_index")) == F.col("answer"),
        "empty_roles": ~empty | (F.col("anchor_id").isNull() & F.col("answer_id").isNull() & (F.col("answer") == NO_EVIDENCE)),
        "absence": ~empty | F.when(neighbour, _count(F.col("query_label")) < F.col("query_ordinal")).otherwise((F.size("candidates") == 2) & absent),
        "roles": empty | ((anchor > 0) & (answer > 0) & (anchor != answer)),
        "adjacent": empty | ~neighbour | ((anchor > 0) & (answer > 0) & (answer == anchor + step)),
        "earlier": empty | (F.col("relation") != "first") | (at("answer_id") < at("anchor_id")),
    }
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))
    return records.withColumn("violations", broken)


def rater_conflicts(left: DataFrame, right: DataFrame, keys: list[str], most_difference: float, least_iou: float) -> DataFrame:
    """The regions of two raters joined by their keys, and how they disagree (missing, phrase, boundary, overlap)."""
    x = left.select(*keys, F.col("phrase").alias("l_phrase"), F.col("onset").alias("l_on"), F.col("off").alias("l_off"))
    y = right.select(*keys, F.col("phrase").alias("r_phrase"), F.col("onset").alias("r_on"), F.col("off").alias("r_off"))
    both = x.join(y, keys, "full_outer")
    inner = F.greatest(F.lit(0.0), F.least("l_off", "r_off") - F.greatest("l_on", "r_on"))
    iou = F.try_divide(inner, F.greatest("l_off", "r_off") - F.least("l_on", "r_on"))
    rules = {
        "missing": F.col("l_on").isNull() | F.col("r_on").isNull(),
        "phrase": F.col("l_phrase") != F.col("r_phrase"),
        "boundary": F.greatest(F.abs(F.col("l_on") - F.col("r_on")), F.abs(F.col("l_off") - F.col("r_off"))) > most_difference,
        "overlap": iou < least_iou,
    }
    return both.select(*keys, F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in rules.items()])).alias("conflicts"))


def option_order(base: DataFrame, permuted: DataFrame, key: str) -> DataFrame:
    """Pairs of one question with its options in two orders: how many, equal predictions, both right, the gap in accuracy.

    Either side has ``key``, question, options, predicted, right (0 or 1).
    """
    x, y = base.alias("x"), permuted.alias("y")
    same = (F.col("x.question") == F.col("y.question")) & (F.array_sort("x.options") == F.array_sort("y.options")) & (F.col("x.options") != F.col("y.options"))
    p = x.join(y, key).where(same)
    return p.agg(F.count("*").alias("pairs"), F.avg((F.col("x.predicted") == F.col("y.predicted")).cast("int")).alias("invariance"), F.avg(F.col("x.right") * F.col("y.right")).alias("both_right"), (F.avg("x.right") - F.avg("y.right")).alias("accuracy_gap"))
