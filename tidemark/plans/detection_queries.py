"""Detection scores, assignments, speakers, selections, fetched sources, resumed reads and quotas over streams."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import decoding, detection, selection
from tidemark.plans.registry import load, query, timeline
from tidemark.session import work_dir


def label_frames(spark, sf):
    """A score per event, numbered within its user and type."""
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    return load(spark, sf, "events").select(F.col("user_id").alias("scene"), F.col("event_type").alias("label"), F.row_number().over(w).cast("bigint").alias("frame"), (F.col("value") / 500).alias("p"), "event_id")


@query("M10", None)
def class_event_thresholds(spark, sf):
    x = label_frames(spark, sf)
    gold = x.where("event_id % 3 = 0").select("scene", "label", (F.col("frame") - 1).cast("double").alias("onset"), (F.col("frame") + 1).cast("double").alias("off"))
    return decoding.class_thresholds(x.drop("event_id"), gold, [0.2, 0.4, 0.6, 0.8], 0.3, 1, 1)[0]


@query("M12", "WITH w AS (SELECT user_id s, event_type l, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) f, value / 500 >= 0.5 p, event_id % 3 = 0 g FROM events), c AS (SELECT l, sum((p AND g)::INT) tp, sum((p AND NOT g)::INT) fp, sum((g AND NOT p)::INT) fn FROM w GROUP BY 1) SELECT sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn, round(2 * sum(tp) / greatest(2 * sum(tp) + sum(fp) + sum(fn), 1), 9) AS micro_f1, round(avg(2 * tp / greatest(2 * tp + fp + fn, 1)) FILTER (tp + fn > 0), 9) AS macro_f1 FROM c")
def frame_scores(spark, sf):
    x = label_frames(spark, sf)
    keys = ["scene", "label", "frame"]
    out = detection.f1_rows(detection.frame_counts(x.where("p >= 0.5").select(*keys), x.where("event_id % 3 = 0").select(*keys), keys))
    return out.withColumns({c: F.round(c, 9) for c in ("micro_f1", "macro_f1")})


@query("M12", None)
def boundary_scores(spark, sf):
    t = timeline(spark, sf)
    out = None
    for side in ("onset", "off"):
        rows = detection.f1_rows(detection.boundary_counts(t.where("event_id % 2 = 0"), t.where("event_id % 2 = 1"), ["scene", "label"], side, 3600.0)).withColumn("side", F.lit(side))
        out = rows if out is None else out.union(rows)
    return out


@query("M12", """WITH f AS (SELECT user_id s, event_type l, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) f, value / 500 p, event_id FROM events), g AS (SELECT s, event_id, l, f onset, f + 1 + event_id % 5 AS off FROM f WHERE event_id % 7 = 0),
m AS (SELECT g.s, g.event_id, g.l wanted, f.l, max(p) p FROM g JOIN f ON f.s = g.s AND f.f >= onset AND f.f < off GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY s, event_id ORDER BY p DESC, l) k FROM m), w AS (SELECT * FROM r WHERE l = wanted), c AS (SELECT wanted, count(*) n, avg((k <= 1)::INT) a, avg((k <= 2)::INT) b FROM w GROUP BY 1)
SELECT sum(n)::BIGINT AS events, round(sum(n * a) / sum(n), 9) AS top1_micro, round(sum(n * b) / sum(n), 9) AS top2_micro, round(avg(a), 9) AS top1_macro, round(avg(b), 9) AS top2_macro FROM c""")
def oracle_top_labels(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    x = load(spark, sf, "events").select(F.col("user_id").alias("scene"), F.col("event_type").alias("label"), F.row_number().over(w).cast("bigint").alias("frame"), (F.col("value") / 500).alias("p"), "event_id")
    gold = x.where("event_id % 7 = 0").select("scene", "event_id", "label", F.col("frame").alias("onset"), (F.col("frame") + 1 + F.col("event_id") % 5).alias("off"))
    out = detection.oracle_top(detection.oracle_ranks(x.drop("event_id"), gold, "scene"), [1, 2])
    return out.select("events", *[F.round(f"top{k}_{m}", 9).alias(f"top{k}_{m}") for m in ("micro", "macro") for k in (1, 2)])


@query("J16", None)
def slot_assignment(spark, sf):
    """Events of a user's week as slots (even ids) and gold intervals (odd ids), times as shares of the week."""
    week = 7 * 86400.0
    t = timeline(spark, sf).withColumn("week", F.floor(F.col("onset") / week))
    t = t.withColumns({"onset": F.col("onset") / week - F.col("week"), "off": F.col("off") / week - F.col("week")})
    slots = t.where("event_id % 2 = 0").select("scene", "week", F.col("event_id").alias("slot"), "onset", "off", "conf")
    gold = t.where("event_id % 2 = 1").select("scene", "week", F.col("event_id").alias("gold"), "onset", "off")
    return detection.assigned_slots(slots, gold, ["scene", "week"])


@query("X8", None)
def speaker_windows(spark, sf):
    """Embeddings as windows of recordings of twenty-five each."""
    from tidemark.operators.speakers import speaker_windows as found

    e = load(spark, sf, "embeddings").select(F.floor(F.col("vec_id") / 25).alias("recording"), F.col("vec_id").alias("window"), "embedding")
    return found(e, ["recording"], "window", "embedding", 6, 2)


CENTRES = "e AS (SELECT vec_id, label, embedding::DOUBLE[] x FROM embeddings), u AS (SELECT label, unnest(range(len(x))) i, unnest(x) v FROM e), m AS (SELECT label, list(v ORDER BY i) c FROM (SELECT label, i, avg(v) v FROM u GROUP BY 1, 2) GROUP BY 1)"


def ranked_labels(spark, sf):
    """(label, others): for each vector the labels by falling product with their mean vector; and those vectors by label."""
    e = load(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x"))
    means = e.select("label", F.posexplode("x").alias("i", "v")).groupBy("label", "i").agg(F.avg("v").alias("v")).groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("c")).collect()  # a row per label
    means = sorted((r.label, [c.v for c in r.c]) for r in means)
    labels, matrix = np.array([m[0] for m in means]), np.array([m[1] for m in means])

    def run(batches):
        for p in batches:
            scores = np.stack(p.x.to_list()) @ matrix.T
            order = np.lexsort((np.broadcast_to(labels, scores.shape), -np.round(scores, 9)), axis=1)
            yield p.assign(others=list(labels[order]))[["label", "others"]]

    return e.select("label", "x").mapInPandas(run, "label int, others array<int>"), labels, matrix


@query("SP23", f"WITH {CENTRES}, s AS (SELECT vec_id, e.label, m.label AS other, round(list_dot_product(x, c), 9) v FROM e, m), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY v DESC, other) k FROM s), n AS (SELECT label, count(*) n FROM e GROUP BY 1) SELECT r.label, other, round(sum(1 / log2(k + 1)) / any_value(n), 6) AS weight FROM r JOIN n ON n.label = r.label WHERE k <= 10 AND other <> r.label GROUP BY 1, 2")
def confusion_weights(spark, sf):
    return selection.rank_weighted_confusions(ranked_labels(spark, sf)[0]).withColumn("weight", F.round("weight", 6))


@query("SP23", None)
def balanced_partition(spark, sf):
    ranked, labels, matrix = ranked_labels(spark, sf)
    at = {x: i for i, x in enumerate(labels.tolist())}
    confusion = np.zeros((len(at), len(at)))
    for r in selection.rank_weighted_confusions(ranked).collect():  # a row per pair of labels
        confusion[at[r.label], at[r.other]] = r.weight
    group = selection.balanced_groups(selection.affinities(confusion, matrix), 3)
    return spark.createDataFrame([(int(x), int(g)) for x, g in zip(labels, group)], "label int, grp int")


def routed(spark, sf):
    """Orders as candidates of their priority's route: a side, a rate, labels and tiers."""
    o = load(spark, sf, "orders")
    rate = F.when(F.col("o_orderkey") % 40 == 0, 4).when(F.col("o_orderkey") % 40 == 1, 8).otherwise(0)
    side = F.when(F.col("o_custkey") % 10 == 0, 2).otherwise(1)
    labels = F.array(F.concat(F.lit("k"), (F.col("o_custkey") % 9).cast("string")), F.concat(F.lit("k"), (F.col("o_orderkey") % 7).cast("string")))
    return o.select(F.col("o_orderkey").alias("row"), F.col("o_orderpriority").alias("route"), (side + rate).alias("mask"), labels.alias("labels"), F.array("o_orderstatus").alias("tiers"))


@query("SP12", None)
def stratified_routes(spark, sf):
    return spark.createDataFrame(selection.stratified(routed(spark, sf), 2, [3, 12]), "route string, row bigint, label string")


def part_files(spark, df, name: str, group_rows: int | None = None) -> tuple[list[str], str]:
    """A copy of the rows in the shared folder, where fetchers reach it: its files, and the folder."""
    from tidemark.sources.fetched import file_paths

    at = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
    (df.write.option("parquet.block.row.count.limit", group_rows) if group_rows else df.write).parquet(at)
    return file_paths(spark, at), at


@query("X6", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_totalprice >= 100000")
def fetched_rows(spark, sf):
    from tidemark.sources.fetched import registered

    paths, _ = part_files(spark, load(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice").repartition(8, "o_orderkey"), "fetch")
    rows = spark.read.format(registered(spark)).option("paths", "\n".join(paths)).option("columns", "o_orderkey,o_orderstatus,o_totalprice").load()
    return rows.where(F.col("o_totalprice") >= 100000)


@query("S9 X2", "SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total, true AS broke, true AS resumed, 0 AS twice FROM orders GROUP BY 1")
def resumed_groups(spark, sf):
    """A read whose callback breaks in the first task that reaches a second group, and the call that goes on from there."""
    from tidemark.sources.groups import kept_rows, process_groups

    columns = ["o_orderkey", "o_orderstatus", "o_totalprice"]
    orders = load(spark, sf, "orders").select(*columns)
    n = orders.count()
    paths, folder = part_files(spark, orders.repartition(4, "o_orderkey"), "groups", max(1, n // 16))
    state = f"{folder}-state"
    broke = False

    def breaking(path, number, table):
        if number == 1:
            raise RuntimeError("broken in the second group")
        return table

    try:
        process_groups(spark, paths, columns, breaking, state).count()
    except Exception as e:
        broke = "broken in the second group" in str(e)
    before = kept_rows(spark, state, orders.schema).count()
    later = process_groups(spark, paths, columns, lambda path, number, table: table, state).agg(F.coalesce(F.sum("n_rows"), F.lit(0))).first()[0]
    rows = kept_rows(spark, state, orders.schema)
    twice = max(0, before + later - n)  # tasks of the broken job may commit a group after the count
    return rows.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")).select("*", F.lit(broke).alias("broke"), F.lit(before > 0 and later > 0).alias("resumed"), F.lit(int(twice)).alias("twice"))


@query("S11", "WITH x AS (SELECT event_id, unnest(list_distinct([event_type, 'u' || user_id % 7])) label FROM events WHERE event_id % 11 <> 0), w AS (SELECT * FROM x WHERE label <> 'u6'), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY event_id) k FROM w) SELECT DISTINCT event_id FROM r WHERE k <= 40")
def quota_stream(spark, sf):
    """Events by id as a stream; types and user classes, but one, are wanted forty times each."""
    from tidemark.streaming.quotas import QuotaStream, ordered_stream

    labels = F.array_distinct(F.array("event_type", F.concat(F.lit("u"), (F.col("user_id") % 7).cast("string"))))
    e = load(spark, sf, "events").where("event_id % 11 <> 0").select("event_id", labels.alias("labels"))
    wanted = sorted({r.label for r in e.select(F.explode("labels").alias("label")).distinct().collect()} - {"u6"})  # types and classes
    return QuotaStream(spark, "event_id", "labels", "event_id", wanted, 40).run(ordered_stream(spark, e, "event_id", 5)).select("event_id")


@query("SP16", None)
def diverse_families(spark, sf):
    """Customers as families, their orders' priorities as categories; dearer orders are better."""
    from tidemark.operators.splits import diverse_families as picked

    quota = {"1-URGENT": 5, "2-HIGH": 4, "3-MEDIUM": 3}
    rows = picked(load(spark, sf, "orders"), "o_custkey", "o_orderpriority", [F.desc("o_totalprice"), F.col("o_orderkey")], quota)
    return spark.createDataFrame([(i, c, f) for i, (c, f) in enumerate(rows)], "place int, category string, family bigint")


@query("SP4", None)
def locked_build(spark, sf):
    """Orders as rows, clerks' customers as groups, statuses and priorities as labels."""
    from tidemark.operators.splits import locked_build as built

    o = load(spark, sf, "orders").select("o_orderkey", (F.col("o_custkey") % 60).alias("grp"), F.array("o_orderstatus", "o_orderpriority").alias("labels"))
    side = F.col("grp") % 5
    kept = o.where(side == 4).withColumn("split", F.element_at(F.array(F.lit("train"), F.lit("dev"), F.lit("test")), (F.col("grp") % 3 + 1).cast("int")))
    ontology = sorted({r[0] for r in o.select(F.explode("labels")).distinct().collect()} - {"5-LOW", "P"})
    return built(o.where(side < 3), o.where(side == 3), kept, "grp", "labels", ["o_orderkey", "grp"], ontology, 0.2, "build").withColumn("labels", F.array_join("labels", ","))


@query("SP9", "WITH r AS (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) n FROM part), e AS (SELECT *, n <= 6 OR (p_brand LIKE '%3' AND n = 9) done, p_partkey % 3 <> 0 ok FROM r), g AS (SELECT p_brand, least(5, count(*) FILTER (done AND ok)) accepted, count(*) FILTER (NOT done) rest, coalesce(max(n) FILTER (done) < min(n) FILTER (NOT done), true) in_order FROM e GROUP BY 1) SELECT p_brand, accepted, in_order, CASE WHEN in_order THEN least(rest, ceil((5 - accepted) * 1.5)::BIGINT) ELSE 0 END AS request FROM g")
def frozen_topup(spark, sf):
    from tidemark.operators.splits import topup

    order = [F.desc("p_size"), F.col("p_partkey")]
    n = F.row_number().over(Window.partitionBy("p_brand").orderBy(*order))
    p = load(spark, sf, "part").withColumn("n", n).withColumns({"done": (F.col("n") <= 6) | F.col("p_brand").endswith("3") & (F.col("n") == 9), "ok": F.col("p_partkey") % 3 != 0})
    return topup(p, ["p_brand"], order, "done", "ok", 5, 1.5)


@query("SP14", "WITH r AS (SELECT o_orderkey, o_custkey, o_orderpriority FROM orders), s AS (SELECT o_custkey AS video, CASE WHEN o_custkey % 4 = 0 THEN 'eval' ELSE 'train' END AS split, o_orderpriority l, o_orderkey k FROM r) SELECT video, any_value(split) AS split, string_agg(l || '@' || k, ',' ORDER BY l, k) AS requests FROM s GROUP BY 1")
def locked_joint_plan(spark, sf):
    from tidemark.operators.splits import locked_plan

    split = F.when(F.col("o_custkey") % 4 == 0, "eval").otherwise("train")
    r = load(spark, sf, "orders").select(F.col("o_custkey").alias("video"), split.alias("split"), F.col("o_orderpriority").alias("label"), (F.col("o_custkey") % 16).alias("location"), F.col("o_orderkey").alias("request"))
    quota = {(x.split, x.label): x.n for x in r.groupBy("split", "label").agg(F.count("*").alias("n")).collect()}  # a row per split and label
    plan = locked_plan(r, quota)
    return plan.select("video", "split", F.array_join(F.transform("requests", lambda x: F.concat_ws("@", x["label"], x["request"])), ",").alias("requests"))


@query("M3", """WITH d AS (SELECT event_id % 40 AS k, event_id, user_id, (epoch_us(ts) / 1e6) a, (epoch_us(ts) / 1e6) + value * 60 b FROM events WHERE event_id % 40 < 34), x AS (SELECT k, a AS t, 1 AS da, 0 AS dg FROM d WHERE event_id % 3 = 0 UNION ALL SELECT k, b, -1, 0 FROM d WHERE event_id % 3 = 0 UNION ALL SELECT k, a, 0, 1 FROM d WHERE event_id % 3 = 1 AND k < 30 UNION ALL SELECT k, b, 0, -1 FROM d WHERE event_id % 3 = 1 AND k < 30),
w AS (SELECT k, t, sum(da) OVER o p, sum(dg) OVER o g, lead(t) OVER (PARTITION BY k ORDER BY t) n FROM (SELECT k, t, sum(da) da, sum(dg) dg FROM x GROUP BY 1, 2) WINDOW o AS (PARTITION BY k ORDER BY t)), m AS (SELECT k, sum(n - t) FILTER (p > 0 AND g > 0) i, sum(n - t) FILTER (p > 0 OR g > 0) u, sum(n - t) FILTER (g > 0) g FROM w GROUP BY 1),
r AS (SELECT DISTINCT event_id % 40 AS k, event_id % 40 >= 30 AS none, (event_id % 40) / 40.0 AS q FROM events), j AS (SELECT r.*, coalesce(i, 0) i, g, CASE WHEN coalesce(u, 0) > 0 THEN coalesce(i, 0) / u ELSE 1 END iou FROM r LEFT JOIN m ON m.k = r.k)
SELECT round(avg(iou), 6) AS tiou, round(avg(iou) FILTER (NOT none), 6) AS tiou_with_evidence, round(avg(((q >= 0.5) = none)::INT), 6) AS no_evidence_accuracy, round(avg((q - none::INT) ** 2), 6) AS brier, round(sum(i) / sum(g), 6) AS kept FROM j""")
def evidence_metrics(spark, sf):
    t = timeline(spark, sf).withColumn("k", F.col("event_id") % 40)
    n = F.col("event_id") % 3
    few = t.where("k < 34").select("k", "onset", "off", n.alias("side"))
    records = t.select("k").distinct().select("k", (F.col("k") >= 30).alias("no_evidence"), (F.col("k") / 40).alias("p"))
    m = detection.evidence_metrics(few.where("side = 0"), few.where("side = 1 AND k < 30"), records, "k")
    return m.select(*[F.round(c, 6).alias(c) for c in m.columns])
