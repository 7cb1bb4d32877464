"""Queries in the timeline language over ``events`` and ``conversations``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import timelines as T
from tidemark.plans.registry import TL, load, query, timeline

O = "ORDER BY onset, off, label, event_id"  # noqa: E741
ORD = f"o AS (SELECT *, row_number() OVER (PARTITION BY scene {O}) pos, row_number() OVER (PARTITION BY scene, label {O}) k, lag(label) OVER (PARTITION BY scene {O}) b, lead(label) OVER (PARTITION BY scene {O}) a FROM tl)"


@query("L1 L2 T8 T16 W1 W2", f"""WITH {TL}, {ORD}, x AS (SELECT scene, b, a FROM o WHERE label = 'error' AND k = 2) SELECT s.scene, coalesce(b, 'NONE') AS before, CASE WHEN x.scene IS NULL THEN 'anchor_absent' WHEN b IS NULL THEN 'no_temporal_neighbour' ELSE 'adjacent_onset' END AS before_reason, coalesce(a, 'NONE') AS after, CASE WHEN x.scene IS NULL THEN 'anchor_absent' WHEN a IS NULL THEN 'no_temporal_neighbour' ELSE 'adjacent_onset' END AS after_reason FROM (SELECT DISTINCT scene FROM tl) s LEFT JOIN x ON x.scene = s.scene""")
def timeline_before_after(spark, sf):
    return T.neighbours(timeline(spark, sf), "error", 2)


@query("T1", f"WITH {TL}, {ORD} SELECT event_id, pos AS position, k AS occurrence FROM o")
def timeline_flatten(spark, sf):
    return T.flattened(timeline(spark, sf)).select("event_id", "position", "occurrence")


@query("T2 U4", f"WITH {TL}, {ORD}, f AS (SELECT scene, label, min(pos) p FROM o GROUP BY 1, 2) SELECT scene, string_agg(label, ', ' ORDER BY p) AS answer FROM f GROUP BY 1")
def timeline_list(spark, sf):
    return T.listed(timeline(spark, sf))


@query("T3 T4", f"WITH {TL} SELECT scene, count(*) FILTER (label = 'purchase') AS n, CASE WHEN count(*) FILTER (label = 'purchase') > 0 THEN 'YES' ELSE 'NO' END AS present FROM tl GROUP BY 1")
def timeline_count_exists(spark, sf):
    return T.counted(timeline(spark, sf), "purchase")


@query("T5 F25", f"WITH {TL} SELECT scene, coalesce(string_agg(printf('%.2f–%.2fs', onset, off), ', ' ORDER BY onset, off, event_id) FILTER (label = 'error'), 'NONE') AS answer FROM tl GROUP BY 1")
def timeline_locate(spark, sf):
    return T.located(timeline(spark, sf), "error")


@query("T6 T7", f"WITH {TL} SELECT scene, first(label {O}) AS first, last(label {O}) AS last, first(label ORDER BY off - onset DESC, onset, event_id) AS longest, first(label ORDER BY off - onset DESC, conf DESC, event_id) AS longest_by_confidence, first(label ORDER BY (off - onset) * (0.5 + conf) DESC, event_id) AS longest_weighted FROM tl GROUP BY 1")
def timeline_first_last_longest(spark, sf):
    return T.extremes(timeline(spark, sf))


#: The 12th error of a scene, which some scenes lack.
NTH = "{o}, x AS (SELECT scene, onset a_on, off a_off, event_id a_id FROM {t} WHERE label = 'error' AND k = {n})"
ANCHOR = NTH.format(o=ORD, t="o", n=12)
SCENES = "(SELECT DISTINCT scene FROM tl) s LEFT JOIN x ON x.scene = s.scene JOIN tl ON tl.scene = s.scene"


def why(answer: str, found: str, missing: str, absent: str) -> str:
    return f"CASE WHEN any_value(a_id) IS NULL THEN '{absent}' WHEN ({answer}) IS NULL THEN '{missing}' ELSE '{found}' END"


STRICT = {"before": "first(label ORDER BY onset DESC, event_id) FILTER (onset < a_on - 1e-6)", "after": "first(label ORDER BY onset, event_id) FILTER (onset > a_on + 1e-6)"}


@query("L3 T9 J9", f"WITH {TL}, {ANCHOR} SELECT s.scene, {STRICT['before']} AS before, {why(STRICT['before'], 'anchor_occurrence_and_temporal_neighbour', 'no_preceding_proposal', 'absent_anchor_occurrence')} AS before_reason, {STRICT['after']} AS after, {why(STRICT['after'], 'anchor_occurrence_and_temporal_neighbour', 'no_following_proposal', 'absent_anchor_occurrence')} AS after_reason FROM {SCENES} GROUP BY 1")
def timeline_strict_neighbours(spark, sf):
    return T.strict_neighbours(timeline(spark, sf), "error", 12)


OPEN = "ORDER BY onset, off, conf DESC, event_id"
SURE = NTH.format(o=f"o AS (SELECT *, row_number() OVER (PARTITION BY scene, label {OPEN}) k FROM tl WHERE conf >= 0.2)", t="o", n=10)
OPENED = NTH.format(o=f"o AS (SELECT *, row_number() OVER (PARTITION BY scene, label {OPEN}) k FROM tl)", t="o", n=12)
SCORE = "conf - abs(onset - a_on) - 2 * (greatest(0, least(off, a_off) - greatest(onset, a_on)) / (greatest(off, a_off) - least(onset, a_on)))"
SCORED = {side: f"first(label ORDER BY {SCORE} DESC, onset, off, conf DESC, event_id) FILTER (label <> 'error' AND conf >= 0.2 AND onset {op} 1e-6)" for side, op in (("before", "< a_on -"), ("after", "> a_on +"))}


@query("L5 T10", f"WITH {TL}, {SURE} SELECT s.scene, " + ", ".join(f"coalesce({q}, 'no_evidence') AS {side}, {why(q, f'{side}_reranked', f'{side}_missing', 'anchor_missing')} AS {side}_reason" for side, q in SCORED.items()) + f" FROM {SCENES} GROUP BY 1")
def timeline_scored_after(spark, sf):
    return T.scored_neighbours(timeline(spark, sf), "error", 10)


TIER = "CASE WHEN onset >= a_off - 0.08 AND conf >= 0.5 THEN 0 WHEN onset >= a_off - 0.08 THEN 1 ELSE 2 END"
PREFERRED = {
    "before": "first(label ORDER BY CASE WHEN off <= a_on + 0.08 THEN 0 ELSE 1 END, CASE WHEN off <= a_on + 0.08 THEN -off ELSE -onset END, conf DESC, onset, off, event_id) FILTER (onset < a_on - 1e-6 AND event_id <> a_id)",
    "after": f"first(label ORDER BY {TIER}, CASE WHEN {TIER} = 0 THEN onset ELSE -conf END, onset, off, conf DESC, event_id) FILTER (label <> 'error' AND onset > a_on + 1e-6)",
}


@query("L4 T9", f"WITH {TL}, {OPENED} SELECT s.scene, " + ", ".join(f"coalesce({q}, 'no_evidence') AS {side}, {why(q, f'{side}_neighbor', missing, 'anchor_occurrence_missing')} AS {side}_reason" for (side, q), missing in zip(PREFERRED.items(), ("no_preceding_event", "no_following_event"))) + f" FROM {SCENES} GROUP BY 1")
def timeline_preferring_after(spark, sf):
    return T.preferring_neighbours(timeline(spark, sf), "error", 12)


INNER = "onset > least(lo, hi) AND onset < greatest(lo, hi)"


@query("T11 T12", f"""WITH {TL}, {ORD}, e AS (SELECT s.scene, l.onset lo, r.onset hi FROM (SELECT DISTINCT scene FROM tl) s LEFT JOIN o l ON l.scene = s.scene AND l.label = 'error' AND l.k = 1 LEFT JOIN o r ON r.scene = s.scene AND r.label = 'signup' AND r.k = 1),
f AS (SELECT tl.scene, label, min(onset) p FROM tl JOIN e ON e.scene = tl.scene WHERE {INNER} GROUP BY 1, 2), l AS (SELECT scene, string_agg(label, ', ' ORDER BY p) labels FROM f GROUP BY 1)
SELECT e.scene, coalesce(any_value(l.labels), 'NONE') AS labels, first(label ORDER BY conf DESC, event_id) FILTER ({INNER}) AS strongest, first(label ORDER BY 2.4 * conf - abs(onset - (lo + hi) / 2) / abs(hi - lo) DESC, event_id) FILTER ({INNER}) AS central, CASE WHEN any_value(lo) IS NULL OR any_value(hi) IS NULL THEN 'anchor_absent' WHEN any_value(l.labels) IS NULL THEN 'nothing_between' ELSE 'between_onsets' END AS reason FROM e JOIN tl ON tl.scene = e.scene LEFT JOIN l ON l.scene = e.scene GROUP BY 1""")
def timeline_between(spark, sf):
    return T.between(timeline(spark, sf), "error", "signup")


@query("T13 J8", f"WITH {TL}, p AS (SELECT l.scene, r.label, min(r.onset) p FROM tl l JOIN tl r ON l.scene = r.scene AND l.label = 'error' AND r.label <> 'error' AND l.onset < r.off AND r.onset < l.off GROUP BY 1, 2), a AS (SELECT scene, string_agg(label, ', ' ORDER BY p) answer FROM p GROUP BY 1) SELECT tl.scene, coalesce(any_value(answer), 'NONE') AS answer, CASE WHEN count(*) FILTER (label = 'error') = 0 THEN 'anchor_absent' WHEN any_value(answer) IS NULL THEN 'no_overlap' ELSE 'interval_overlap' END AS reason FROM tl LEFT JOIN a ON a.scene = tl.scene GROUP BY 1")
def timeline_overlap(spark, sf):
    return T.overlapping(timeline(spark, sf), "error")


@query("T14", f"WITH {TL}, f AS (SELECT scene, count(DISTINCT label) FILTER (label IN ('error', 'signup')) n, first(label ORDER BY onset, off, event_id) FILTER (label IN ('error', 'signup')) a FROM tl GROUP BY 1) SELECT scene, CASE WHEN n = 2 THEN a END AS answer, CASE WHEN n < 2 THEN 'candidate_absent' END AS reason FROM f")
def timeline_first_among(spark, sf):
    return T.first_among(timeline(spark, sf), ["error", "signup"])


OFFERED = "first(label ORDER BY onset, off, event_id) FILTER (onset > a_on AND label IN ('purchase', 'signup'))"


@query("T15", f"WITH {TL}, {NTH.format(o=ORD, t='o', n=1)} SELECT s.scene, {OFFERED} AS answer, {why(OFFERED, 'offered', 'no_offered_event', 'anchor_absent')} AS reason FROM {SCENES} GROUP BY 1")
def timeline_offered_after(spark, sf):
    return T.offered_after(timeline(spark, sf), "error", ["purchase", "signup"])


@query("T25", f"WITH {TL}, {ANCHOR} SELECT s.scene, first(label ORDER BY off DESC, event_id) FILTER (off <= a_on + 0.05 AND event_id <> a_id) AS before, first(label ORDER BY onset, event_id) FILTER (onset >= a_off - 0.05 AND event_id <> a_id) AS after, any_value(a_id) IS NULL AS anchor_absent FROM {SCENES} GROUP BY 1")
def timeline_boundary_neighbours(spark, sf):
    return T.boundary_neighbours(timeline(spark, sf), "error", 12)


@query("T20", f"WITH {TL} SELECT scene, label, round(min(onset), 3) AS start, round(max(off), 3) AS stop FROM tl GROUP BY 1, 2")
def timeline_evidence_window(spark, sf):
    return T.evidence_window(timeline(spark, sf)).select("scene", "label", F.round("start", 3).alias("start"), F.round("stop", 3).alias("stop"))


@query("T27 I30", f"""WITH {TL}, {ORD}, s AS (SELECT l.scene, l.event_id a_id, r.event_id, l.conf + r.conf - 1e-6 * (r.onset - l.onset) - 0.05 * (r.pos - l.pos - 1) score FROM o l JOIN o r ON l.scene = r.scene AND l.label = 'error' AND r.label = 'purchase' AND r.pos > l.pos),
b AS (SELECT *, row_number() OVER (PARTITION BY scene ORDER BY score DESC, a_id, event_id) z FROM s), n AS (SELECT scene, count(*) FILTER (label = 'error') n FROM tl GROUP BY 1)
SELECT n.scene, CASE WHEN score >= 1.5 THEN a_id END AS anchor_id, CASE WHEN score >= 1.5 THEN event_id END AS answer_id, round(score, 6) AS score, CASE WHEN n = 0 THEN 'anchor_missing' WHEN score IS NULL THEN 'no_event_after_anchor' WHEN score >= 1.5 THEN 'ok' ELSE 'pair_score_below_min' END AS reason FROM n LEFT JOIN b ON b.scene = n.scene AND z = 1""")
def timeline_best_pair(spark, sf):
    return T.best_pair(timeline(spark, sf), "error", "purchase", least=1.5).withColumn("score", F.round("score", 6))


QA = f"{ORD}, qa AS (SELECT scene, 'before' AS relation, label AS anchor, k AS occurrence, b AS answer, b IS NULL AS no_evidence FROM o UNION ALL SELECT scene, 'after', label, k, a, a IS NULL FROM o)"


@query("T21", f"WITH {TL}, {QA} SELECT * FROM qa")
def qa_generation(spark, sf):
    return T.qa_items(timeline(spark, sf))


@query("T23 O3", f"WITH {TL}, {QA}, r AS (SELECT *, row_number() OVER (PARTITION BY relation, anchor, occurrence, no_evidence ORDER BY sha256(scene || ':' || occurrence)) n, least(count(*) FILTER (no_evidence) OVER (PARTITION BY relation, anchor, occurrence), count(*) FILTER (NOT no_evidence) OVER (PARTITION BY relation, anchor, occurrence), 20) m FROM qa) SELECT scene, relation, anchor, occurrence, no_evidence FROM r WHERE n <= m")
def qa_balanced(spark, sf):
    order = F.sha2(F.concat_ws(":", "scene", "occurrence"), 256)
    return T.balanced(T.qa_items(timeline(spark, sf)), ["relation", "anchor", "occurrence"], "no_evidence", order, 20).select("scene", "relation", "anchor", "occurrence", "no_evidence")


PLAIN = f"""{ORD}, u AS (SELECT o.*, EXISTS (SELECT 1 FROM tl y WHERE y.scene = o.scene AND y.label <> o.label AND y.onset < o.off AND o.onset < y.off) amb FROM o),
n AS (SELECT *, lag(label) OVER w pl, lag(onset) OVER w po, lag(off) OVER w pf, lag(amb) OVER w pa, lead(label) OVER w nl, lead(onset) OVER w no_, lead(amb) OVER w na FROM u WINDOW w AS (PARTITION BY scene {O})),
q AS (SELECT scene, 'after' AS relation, label AS anchor, k AS occurrence, nl AS answer, nl IS NULL AS no_evidence FROM n WHERE NOT amb AND (nl IS NULL OR (NOT na AND nl <> label AND no_ - onset > 0.08 AND no_ >= off)) UNION ALL SELECT scene, 'before', label, k, pl, pl IS NULL FROM n WHERE NOT amb AND (pl IS NULL OR (NOT pa AND pl <> label AND onset - po > 0.08 AND onset >= pf))),
h AS (SELECT *, row_number() OVER (PARTITION BY scene, relation, no_evidence ORDER BY sha256('qa:' || scene || ':' || relation || ':' || anchor || ':' || occurrence)) i FROM q), j AS (SELECT *, row_number() OVER (PARTITION BY scene, no_evidence ORDER BY i, sha256('qa:' || scene || ':' || relation)) z FROM h)"""


@query("T22 O3", f"WITH {TL}, {PLAIN} SELECT scene, relation, anchor, occurrence, answer, no_evidence FROM j WHERE z <= CASE WHEN no_evidence THEN 2 ELSE 4 END")
def qa_unambiguous(spark, sf):
    return T.unambiguous_items(timeline(spark, sf), "qa")


@query("T17", "SELECT conv_id, count(*) AS turns, count(DISTINCT role) AS speakers, string_agg(DISTINCT role, ',' ORDER BY role) AS roles, coalesce(sum(length(text)) FILTER (role = 'user'), 0)::BIGINT AS user_chars, sha256(coalesce(string_agg(text, ' ' ORDER BY turn) FILTER (role = 'assistant'), '')) AS assistant_text FROM conversations GROUP BY 1")
def speaker_intents(spark, sf):
    c = load(spark, sf, "conversations")
    said = F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == "assistant", F.struct("turn", "text")))), lambda x: x["text"])
    return c.groupBy("conv_id").agg(F.count("*").alias("turns"), F.count_distinct("role").alias("speakers"), F.array_join(F.array_sort(F.collect_set("role")), ",").alias("roles"), F.coalesce(F.sum(F.when(F.col("role") == "user", F.char_length("text"))), F.lit(0)).alias("user_chars"), F.sha2(F.array_join(said, " "), 256).alias("assistant_text"))


@query("T17 W2", "SELECT conv_id, turn, role, lag(role) OVER w AS role_before, lead(role) OVER w AS role_after, length(lag(text) OVER w) AS chars_before FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def turn_adjacency(spark, sf):
    w = Window.partitionBy("conv_id").orderBy("turn")
    return load(spark, sf, "conversations").select("conv_id", "turn", "role", F.lag("role").over(w).alias("role_before"), F.lead("role").over(w).alias("role_after"), F.char_length(F.lag("text").over(w)).cast("bigint").alias("chars_before"))
