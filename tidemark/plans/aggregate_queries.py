"""Aggregation and metric queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import aggregates as A
from tidemark.plans.registry import TL, load, query, timeline

R = lambda x, n=6: F.round(x, n)


@query("A1 A21", "SELECT n_nationkey, count(DISTINCT s_suppkey) AS suppliers, count(s_suppkey) AS n, round(coalesce(sum(s_acctbal), 0), 2) AS balance FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 5000 GROUP BY 1")
def label_coverage(spark, sf):
    facts = load(spark, sf, "supplier").where("s_acctbal > 5000").withColumnRenamed("s_nationkey", "n_nationkey")
    out = A.coverage(load(spark, sf, "nation"), facts, "n_nationkey", F.count_distinct("s_suppkey").alias("suppliers"), F.count("*").alias("n"), R(F.sum("s_acctbal"), 2).alias("balance"))
    return out.na.fill(0).na.fill(0.0)


@query("A2", f"WITH {TL}, c AS (SELECT scene, count(*) n FROM tl GROUP BY 1) SELECT count(*) FILTER (n >= 1) AS at_1, count(*) FILTER (n >= 20) AS at_20, count(*) FILTER (n >= 60) AS at_60, count(*) FILTER (n >= 100) AS at_100 FROM c")
def support_histogram(spark, sf):
    return A.at_least(timeline(spark, sf).groupBy("scene").agg(F.count("*").alias("n")), "n", [1, 20, 60, 100])


@query("A3 A25", "SELECT l_returnflag, count(DISTINCT l_partkey) FILTER (l_linestatus = 'F') AS f, count(DISTINCT l_partkey) FILTER (l_linestatus = 'O') AS o FROM lineitem GROUP BY 1")
def pivot_coverage(spark, sf):
    return load(spark, sf, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(F.count_distinct("l_partkey")).select("l_returnflag", F.col("F").alias("f"), F.col("O").alias("o"))


@query("A4 A7", "SELECT p_brand, count(DISTINCT p_type) FILTER (p_size <= 10) AS small_types, count(*) FILTER (p_size > 40) AS large, greatest(0, 30 - count(*) FILTER (p_size > 40)) AS missing, count(*) FILTER (p_size > 40) >= 30 AS feasible FROM part GROUP BY 1")
def quota_report(spark, sf):
    large = F.count_if(F.col("p_size") > 40)
    return load(spark, sf, "part").groupBy("p_brand").agg(F.count_distinct(F.when(F.col("p_size") <= 10, F.col("p_type"))).alias("small_types"), large.alias("large"), F.greatest(F.lit(0), 30 - large).alias("missing"), (large >= 30).alias("feasible"))


@query("A5", "WITH r AS (SELECT p_brand, p_retailprice x, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice) n, count(*) OVER (PARTITION BY p_brand) c FROM part) SELECT p_brand, min(x) AS least, max(x) FILTER (n = c // 2 + 1) AS upper_median, max(x) AS most FROM r GROUP BY 1")
def upper_median(spark, sf):
    return A.upper_medians(load(spark, sf, "part"), ["p_brand"], "p_retailprice")


@query("A6", "SELECT c_nationkey, count(*) FILTER (t <= 0) AS tier_0, count(*) FILTER (t <= 1) AS tier_1, count(*) FILTER (t <= 2) AS tier_2, greatest(0, 50 - count(*) FILTER (t <= 2)) AS deficit FROM (SELECT *, CASE WHEN c_acctbal > 6000 THEN 0 WHEN c_acctbal > 3000 THEN 1 WHEN c_acctbal > 0 THEN 2 ELSE 3 END t FROM customer) GROUP BY 1")
def tier_deficit(spark, sf):
    tier = F.when(F.col("c_acctbal") > 6000, 0).when(F.col("c_acctbal") > 3000, 1).when(F.col("c_acctbal") > 0, 2).otherwise(3)
    return A.deficits(load(spark, sf, "customer"), ["c_nationkey"], tier, 50)


@query("A8", "SELECT l_partkey, count(DISTINCT l_suppkey) AS routes, count(DISTINCT l_linestatus) AS splits, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) > 25")
def duplicate_locations(spark, sf):
    return load(spark, sf, "lineitem").groupBy("l_partkey").agg(F.count_distinct("l_suppkey").alias("routes"), F.count_distinct("l_linestatus").alias("splits"), F.count("*").alias("n")).where("routes > 25")


@query("A9", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY GROUPING SETS ((), (l_returnflag), (l_linestatus))")
def grouped_slices(spark, sf):
    l = load(spark, sf, "lineitem")  # noqa: E741
    return l.groupingSets([[], [F.col("l_returnflag")], [F.col("l_linestatus")]], F.col("l_returnflag"), F.col("l_linestatus")).agg(F.count("*").alias("n"), R(F.sum("l_quantity"), 2).alias("quantity")).select("l_returnflag", "l_linestatus", "n", "quantity")


@query("A10 X5", "WITH x AS (SELECT *, unnest(list_filter([CASE WHEN true THEN 'all' END, CASE WHEN l_discount > 0.05 THEN 'discounted' END, CASE WHEN l_returnflag = 'R' THEN 'returned' END], lambda v: v IS NOT NULL)) slice FROM lineitem) SELECT slice, count(*) AS n, round(sum(l_tax), 4) AS tax FROM x GROUP BY 1")
def slice_explode(spark, sf):
    return A.slices(load(spark, sf, "lineitem"), {"all": F.lit(True), "discounted": F.col("l_discount") > 0.05, "returned": F.col("l_returnflag") == "R"}, F.count("*").alias("n"), R(F.sum("l_tax"), 4).alias("tax"))


@query("A11 A24", "WITH m AS (SELECT c_mktsegment s, o_custkey, avg(o_totalprice) x FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2), g AS (SELECT s, avg(x) a FROM m GROUP BY 1) SELECT s AS segment, round(a, 2) AS macro, a = min(a) OVER () AS worst FROM g")
def macro_groups(spark, sf):
    o = load(spark, sf, "orders").join(load(spark, sf, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    g = A.macro(o.withColumnRenamed("c_mktsegment", "segment"), ["segment"], ["o_custkey"], "o_totalprice")
    return g.select("segment", R("macro", 2).alias("macro"), (F.col("macro") == F.min("macro").over(Window.partitionBy())).alias("worst"))


KNN = "p AS (SELECT vec_id, label gold, (label + CASE WHEN vec_id % 7 = 0 THEN 1 ELSE 0 END) % 10 pred FROM embeddings)"


def predictions(spark, sf):
    return load(spark, sf, "embeddings").select("vec_id", F.col("label").alias("gold"), ((F.col("label") + F.when(F.col("vec_id") % 7 == 0, 1).otherwise(0)) % 10).alias("pred"))


@query("A12", f"WITH {KNN} SELECT gold, pred, count(*) AS n FROM p WHERE gold <> pred GROUP BY 1, 2 ORDER BY n DESC, gold, pred LIMIT 5")
def confusion_topk(spark, sf):
    return A.confusion(predictions(spark, sf), "gold", "pred").where("gold <> pred").orderBy(F.desc("n"), "gold", "pred").limit(5)


@query("A13", f"WITH {KNN} SELECT gold // 2 AS cluster, round(avg((gold // 2 = pred // 2)::INT), 6) AS collapsed, round(avg((gold = pred)::INT), 6) AS accuracy, count(*) FILTER (gold <> pred) AS wrong FROM p GROUP BY 1")
def collapsed_accuracy(spark, sf):
    half = lambda x: F.floor(F.col(x) / 2)
    return predictions(spark, sf).groupBy(half("gold").alias("cluster")).agg(R(F.avg((half("gold") == half("pred")).cast("int"))).alias("collapsed"), R(F.avg((F.col("gold") == F.col("pred")).cast("int"))).alias("accuracy"), F.count_if(F.col("gold") != F.col("pred")).alias("wrong"))


@query("A14", "SELECT user_id, first(event_type ORDER BY n DESC, event_type) AS mode FROM (SELECT user_id, event_type, count(*) n FROM events GROUP BY 1, 2) GROUP BY 1")
def mode_with_ties(spark, sf):
    return A.mode(load(spark, sf, "events"), ["user_id"], "event_type")


@query("A15", "WITH n AS (SELECT user_id, event_type, count(*) n FROM events GROUP BY 1, 2), t AS (SELECT *, sum(n) OVER (PARTITION BY user_id) t FROM n) SELECT user_id, round(-sum(n / t * log2(n / t)), 6) AS entropy FROM t GROUP BY 1")
def label_entropy(spark, sf):
    return A.entropy(load(spark, sf, "events"), ["user_id"], "event_type").withColumn("entropy", R("entropy"))


@query("A16 A17 A20 I8", "SELECT event_type, round(avg(value), 4) AS mean, round(quantile_cont(value, 0.5), 4) AS median, round(quantile_cont(value, 0.1), 4) AS p10, round(quantile_cont(value, 0.9), 4) AS p90, min(value) AS least, max(value) AS most FROM events GROUP BY 1")
def value_distribution(spark, sf):
    out = load(spark, sf, "events").groupBy("event_type").agg(*A.distribution("value"))
    return out.withColumns({c: R(c, 4) for c in ("mean", "median", "p10", "p90")})


@query("A18", "WITH s AS (SELECT o_custkey % 5 seed, avg(o_totalprice) x FROM orders GROUP BY 1) SELECT round(avg(x), 2) AS mean, round(stddev_samp(x), 2) AS sd FROM s")
def across_seeds(spark, sf):
    s = load(spark, sf, "orders").groupBy(F.col("o_custkey") % 5).agg(F.avg("o_totalprice").alias("x"))
    return s.agg(R(F.avg("x"), 2).alias("mean"), R(F.stddev_samp("x"), 2).alias("sd"))


@query("A26 P12", "SELECT n_nationkey, array_to_string(list_filter([CASE WHEN s < 4 THEN 'suppliers' END, CASE WHEN c < 55 THEN 'customers' END], lambda v: v IS NOT NULL), ',') AS failures FROM (SELECT n_nationkey, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) s, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) c FROM nation)")
def coverage_failures(spark, sf):
    s = load(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("s"))
    c = load(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("c"))
    n = load(spark, sf, "nation").join(s, "n_nationkey", "left").join(c, "n_nationkey", "left").na.fill(0)
    return n.select("n_nationkey", F.array_join(F.array_compact(F.array(F.when(F.col("s") < 4, F.lit("suppliers")), F.when(F.col("c") < 55, F.lit("customers")))), ",").alias("failures"))


@query("A27", "SELECT CASE WHEN l_discount * 10 <= 1e-8 THEN 'zero' WHEN l_discount * 10 <= 0.25 THEN 'low' WHEN l_discount * 10 <= 0.5 THEN 'mid' WHEN l_discount * 10 <= 0.75 THEN 'high' ELSE 'full' END AS bin, count(*) AS n, round(avg((l_returnflag = 'R')::INT), 6) AS rate FROM lineitem GROUP BY 1")
def binned_accuracy(spark, sf):
    return load(spark, sf, "lineitem").groupBy(A.overlap_bin(F.col("l_discount") * 10).alias("bin")).agg(F.count("*").alias("n"), R(F.avg((F.col("l_returnflag") == "R").cast("int"))).alias("rate"))


@query("A28 X4 DD5", "WITH g AS (SELECT source, first(lang ORDER BY n DESC, lang) m FROM (SELECT source, lang, count(*) n FROM documents WHERE doc_id % 5 <> 0 GROUP BY 1, 2) GROUP BY 1), a AS (SELECT first(lang ORDER BY n DESC, lang) m FROM (SELECT lang, count(*) n FROM documents WHERE doc_id % 5 <> 0 GROUP BY 1)) SELECT doc_id, coalesce(g.m, a.m) AS predicted, coalesce(g.m, a.m) = lang AS correct FROM documents d LEFT JOIN g ON g.source = d.source CROSS JOIN a WHERE doc_id % 5 = 0")
def majority_shortcut(spark, sf):
    d = load(spark, sf, "documents").select("doc_id", "source", "lang")
    train = d.where("doc_id % 5 <> 0")
    every = A.mode(train.withColumn("k", F.lit(0)), ["k"], "lang").select("k", F.col("mode").alias("fallback"))
    out = d.where("doc_id % 5 = 0").withColumn("k", F.lit(0)).join(A.mode(train, ["source"], "lang"), "source", "left").join(F.broadcast(every), "k")  # one row
    return out.select("doc_id", F.coalesce("mode", "fallback").alias("predicted"), (F.coalesce("mode", "fallback") == F.col("lang")).alias("correct"))


@query("A29", "WITH n AS (SELECT event_type, count(*) n FROM events GROUP BY 1) SELECT event_type, round(least(10, greatest(1, (sum(n) OVER () - n) / n)), 6) AS pos_weight, round((1 / sqrt(n)) / avg(1 / sqrt(n)) OVER (), 6) AS root_weight FROM n")
def class_weights(spark, sf):
    return A.class_weights(load(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"))).select("event_type", R("pos_weight").alias("pos_weight"), R("root_weight").alias("root_weight"))


@query("A30", "WITH p AS (SELECT o_custkey, count(*) FILTER (o_orderkey % 2 = 0) a, count(*) FILTER (o_orderkey % 2 = 1) b, avg(o_totalprice) FILTER (o_orderkey % 2 = 0) x, avg(o_totalprice) FILTER (o_orderkey % 2 = 1) y FROM orders GROUP BY 1) SELECT count(*) FILTER (a > 0 AND b > 0) AS complete, count(*) FILTER (a = 0 OR b = 0) AS incomplete, round(avg(((x > 200000) = (y > 200000))::INT), 6) AS invariance, round(avg((x > 200000 AND y > 200000)::INT), 6) AS both_high, round(avg(abs(x - y)), 2) AS gap FROM p")
def control_pairs(spark, sf):
    even = F.col("o_orderkey") % 2 == 0
    p = load(spark, sf, "orders").groupBy("o_custkey").agg(F.count_if(even).alias("a"), F.count_if(~even).alias("b"), F.avg(F.when(even, F.col("o_totalprice"))).alias("x"), F.avg(F.when(~even, F.col("o_totalprice"))).alias("y"))
    x, y = F.col("x") > 200000, F.col("y") > 200000
    full = (F.col("a") > 0) & (F.col("b") > 0)
    return p.agg(F.count_if(full).alias("complete"), F.count_if(~full).alias("incomplete"), R(F.avg((x == y).cast("int"))).alias("invariance"), R(F.avg((x & y).cast("int"))).alias("both_high"), R(F.avg(F.abs(F.col("x") - F.col("y"))), 2).alias("gap"))


@query("A32", "WITH s AS (SELECT o_orderstatus m, avg(o_totalprice) mu, greatest(stddev_pop(o_totalprice), 1e-6) sd FROM orders WHERE o_orderkey % 4 = 0 GROUP BY 1) SELECT o_custkey, first(o_orderkey ORDER BY (o_totalprice - mu) / sd DESC, o_orderkey) AS routed FROM orders JOIN s ON s.m = o_orderstatus GROUP BY 1")
def confidence_routing(spark, sf):
    o = load(spark, sf, "orders")
    s = o.where("o_orderkey % 4 = 0").groupBy("o_orderstatus").agg(F.avg("o_totalprice").alias("mu"), F.greatest(F.stddev_pop("o_totalprice"), F.lit(1e-6)).alias("sd"))
    z = (F.col("o_totalprice") - F.col("mu")) / F.col("sd")
    return o.join(s, "o_orderstatus").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct(z, -F.col("o_orderkey"))).alias("routed"))


SCORED = "s AS (SELECT least(1.0, (d.n_chars % 997) / 997.0 * 0.6 + 0.4 * quality) AS score, quality AS label FROM labels JOIN documents d ON d.doc_id = labels.doc_id)"


def scored(spark, sf):
    d = load(spark, sf, "documents").select("doc_id", "n_chars")
    return load(spark, sf, "labels").join(d, "doc_id").select(F.least(F.lit(1.0), (F.col("n_chars") % 997) / 997.0 * 0.6 + 0.4 * F.col("quality")).alias("score"), F.col("quality").alias("label"))


@query("M4 M5 W14", f"WITH {SCORED}, p AS (SELECT round(score, 9) score, sum(label) p, sum(1 - label) n FROM s GROUP BY 1), c AS (SELECT *, sum(p) OVER w tp, sum(n) OVER w fp FROM p WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING)) SELECT round(sum(n * (tp - p / 2)) / (sum(n) * sum(p)), 6) AS auroc, round(sum(tp / (tp + fp) * p) / sum(p), 6) AS auprc FROM c")
def roc_auc(spark, sf):
    return A.ranking(scored(spark, sf).withColumn("score", F.round("score", 9)), "score", "label").select(R("auroc").alias("auroc"), R("auprc").alias("auprc"))


@query("M6", f"WITH {SCORED}, b AS (SELECT least(9, floor(score * 10)) b, count(*) n, abs(avg(score) - avg(label)) g FROM s GROUP BY 1) SELECT round(sum(n * g) / sum(n), 6) AS ece FROM b")
def calibration_error(spark, sf):
    return A.calibration_error(scored(spark, sf), "score", "label").select(R("ece").alias("ece"))


@query("M7", f"WITH {SCORED}, p AS (SELECT round(score, 6) score, sum(label) p, sum(1 - label) n FROM s GROUP BY 1), c AS (SELECT score, round((sum(p) OVER w / sum(p) OVER () + 1 - sum(n) OVER w / sum(n) OVER ()) / 2, 9) a FROM p WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING)) SELECT score AS threshold, a AS accuracy FROM c ORDER BY a DESC, score DESC LIMIT 1")
def best_threshold(spark, sf):
    return A.best_balanced(scored(spark, sf).withColumn("score", R("score")), "score", "label")


GRID = "m AS (SELECT *, tp / greatest(tp + fp, 1) p, tp / greatest(tp + fn, 1) r FROM t), f AS (SELECT *, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 9) f FROM m)"
HIT = "least(1000, floor(score * 1000)) >= c"


@query("M9 M11", f"WITH {SCORED}, g AS (SELECT unnest(range(1001)) c), t AS (SELECT c, count(*) FILTER (label = 1 AND {HIT}) tp, count(*) FILTER (label = 0 AND {HIT}) fp, count(*) FILTER (label = 1 AND NOT {HIT}) fn FROM g CROSS JOIN s GROUP BY 1), {GRID} SELECT c / 1000 AS threshold, f AS f1, round(p, 9) AS precision, round(r, 9) AS recall FROM f ORDER BY f DESC, round(p, 9) DESC, round(r, 9) DESC, fp, c DESC LIMIT 1")
def threshold_grid(spark, sf):
    return A.grid_fit(scored(spark, sf), "score", "label", "val").select("threshold", "f1", "precision", "recall")


@query("M10", f"WITH s AS (SELECT lang, least(1.0, (d.n_chars % 997) / 997.0 * 0.6 + 0.4 * quality) AS score, quality AS label FROM labels JOIN documents d ON d.doc_id = labels.doc_id), g AS (SELECT unnest(range(1001)) c), t AS (SELECT lang, c, count(*) FILTER (label = 1 AND {HIT}) tp, count(*) FILTER (label = 0 AND {HIT}) fp, count(*) FILTER (label = 1 AND NOT {HIT}) fn FROM g CROSS JOIN s GROUP BY 1, 2), {GRID}, k AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY f DESC, round(p, 9) DESC, round(r, 9) DESC, fp, c DESC) n FROM f) SELECT lang, c / 1000 AS threshold, f AS f1, round(p, 9) AS precision, round(r, 9) AS recall FROM k WHERE n = 1")
def class_thresholds(spark, sf):
    d = load(spark, sf, "documents").select("doc_id", "n_chars", "lang")
    s = load(spark, sf, "labels").join(d, "doc_id").select("lang", F.least(F.lit(1.0), (F.col("n_chars") % 997) / 997.0 * 0.6 + 0.4 * F.col("quality")).alias("score"), F.col("quality").alias("label"))
    return A.grid_fit(s, "score", "label", "val", ["lang"])


@query("A19", "WITH v AS (SELECT value % 50 crop, value % 53 a, value % 47 b FROM events), o AS (SELECT *, greatest(crop, a, b) best, CASE WHEN crop >= a AND crop >= b THEN 'crop' WHEN a >= b THEN 'a' ELSE 'b' END pick FROM v) SELECT count(*) AS n, " + ", ".join(f"round(avg({x} - crop), 6) AS {x}_gain, round(avg(({x} - crop > 0)::INT), 6) AS {x}_wins, round(avg(({x} - crop < -1)::INT), 6) AS {x}_harm" for x in "ab") + ", round(avg(best - crop), 6) AS oracle_gain, round(avg((best - crop > 1e-7)::INT), 6) AS oracle_wins, round(avg((best - crop >= 1)::INT), 6) AS oracle_by_1, round(avg((best - crop >= 2)::INT), 6) AS oracle_by_2, " + ", ".join(f"count(*) FILTER (pick = '{x}') AS chose_{x}" for x in ("crop", "a", "b")) + " FROM o")
def candidate_gains(spark, sf):
    v = load(spark, sf, "events").select((F.col("value") % 50).alias("crop"), (F.col("value") % 53).alias("a"), (F.col("value") % 47).alias("b"))
    g = A.gains(v, "crop", ["a", "b"])
    return g.select(*[R(c).alias(c) if dict(g.dtypes)[c] == "double" else c for c in g.columns])


@query("M19", "WITH q AS (SELECT o_orderkey % 5 f, (o_orderkey + 1) % 5 s, o_custkey % 5 p, CASE WHEN o_orderkey % 3 = 0 THEN (o_orderkey + 1) % 5 ELSE o_orderkey % 5 END g FROM orders) SELECT round(avg((p IN (f, s))::INT), 6) AS named_rate, round(abs(avg((p = f)::INT) FILTER (p IN (f, s)) - avg((g = f)::INT)), 6) AS mention_bias, round(abs(avg((p = g)::INT) FILTER (g = f) - avg((p = g)::INT) FILTER (g <> f)), 6) AS accuracy_gap FROM q")
def mention_order_bias(spark, sf):
    k = F.col("o_orderkey")
    q = load(spark, sf, "orders").select((k % 5).alias("f"), ((k + 1) % 5).alias("s"), (F.col("o_custkey") % 5).alias("p"), F.when(k % 3 == 0, (k + 1) % 5).otherwise(k % 5).alias("g"))
    return A.mention_bias(q, "f", "s", "p", "g").select(*[R(c).alias(c) for c in ("named_rate", "mention_bias", "accuracy_gap")])


MEASURED = {"anchor_iou": 101, "answer_iou": 103, "union_iou": 107, "weakest_iou": 109, "boundary_mae": 113, "duration_ratio": 127, "energy_ratio": 131, "reconstruction_error": 137}
RECORDS = "r AS (SELECT round((n_chars % 997) / 997.0 * 0.6 + 0.4 * quality, 9) AS probability, quality = 1 AS no_evidence, " + ", ".join(f"(n_chars % {m}) / {m}.0 AS {c}" for c, m in MEASURED.items()) + ", n_chars % 3 AS physical_forwards, n_chars % 5 AS effective_evaluations, source AS scene, lang AS creator FROM labels JOIN documents d ON d.doc_id = labels.doc_id)"
MEANS = ", ".join(f"round(avg({c}) FILTER (NOT no_evidence), 6) AS {c}" for c in A.ANSWERABLE)


@query("A23", f"""WITH {RECORDS}, p AS (SELECT probability, sum(no_evidence::INT) p, sum(1 - no_evidence::INT) n FROM r GROUP BY 1), c AS (SELECT *, sum(p) OVER w tp, sum(n) OVER w fp FROM p WINDOW w AS (ORDER BY probability DESC ROWS UNBOUNDED PRECEDING)), k AS (SELECT round(sum(n * (tp - p / 2)) / (sum(n) * sum(p)), 6) AS auroc, round(sum(tp / (tp + fp) * p) / sum(p), 6) AS auprc FROM c),
b AS (SELECT least(9, floor(probability * 10)) b, count(*) n, abs(avg(probability) - avg(no_evidence::INT)) g FROM r GROUP BY 1), e AS (SELECT round(sum(n * g) / sum(n), 6) AS ece FROM b)
SELECT count(*) AS records, count(DISTINCT scene) AS scenes, count(DISTINCT creator) AS creators, count(*) FILTER (NOT no_evidence) AS answerable, count(*) FILTER (no_evidence) AS without_evidence, sum(physical_forwards)::BIGINT AS physical_total, sum(effective_evaluations)::BIGINT AS effective_total, {MEANS}, round(avg(reconstruction_error), 6) AS reconstruction_error, round(avg(physical_forwards), 6) AS physical_forwards, round(avg(effective_evaluations), 6) AS effective_evaluations,
round(avg(energy_ratio) FILTER (no_evidence), 6) AS no_evidence_energy_ratio, round(max(reconstruction_error), 6) AS reconstruction_maximum, round(avg((probability - no_evidence::INT) * (probability - no_evidence::INT)), 6) AS brier, any_value(auroc) AS auroc, any_value(auprc) AS auprc, any_value(ece) AS ece FROM r, k, e""")
def frozen_endpoints(spark, sf):
    n = F.col("n_chars")
    d = load(spark, sf, "labels").join(load(spark, sf, "documents").select("doc_id", "n_chars", "source", "lang"), "doc_id")
    r = d.select(F.round((n % 997) / 997.0 * 0.6 + 0.4 * F.col("quality"), 9).alias("probability"), (F.col("quality") == 1).alias("no_evidence"), *[((n % m) / float(m)).alias(c) for c, m in MEASURED.items()], (n % 3).alias("physical_forwards"), (n % 5).alias("effective_evaluations"), F.col("source").alias("scene"), F.col("lang").alias("creator"))
    e = A.endpoints(r)
    return e.select(*[R(c).alias(c) if dict(e.dtypes)[c] == "double" else c for c in e.columns])


PADS, LEVELS = [0.0, 2.0, 5.0], [0.2, 0.4, 0.6, 0.8]
SPANS = "p AS (SELECT event_type AS relation, value / 500 AS score, event_id % 4 = 0 AS no_evidence, event_id % 3 <> 0 AS right_, 10 + event_id % 7 AS onset, 20 + event_id % 11 AS off, 8 + event_id % 5 AS g_on, 22 + event_id % 13 AS g_off FROM events)"


@query("M21", f"""WITH {SPANS}, l AS (SELECT unnest([{', '.join(map(str, PADS))}]) AS l), r AS (SELECT unnest([{', '.join(map(str, PADS))}]) AS r), t AS (SELECT unnest([{', '.join(map(str, LEVELS))}]) AS t),
x AS (SELECT p.*, l, r, t, greatest(0, onset - l) a, off + r b, score >= t act FROM p, l, r, t), y AS (SELECT *, greatest(0, least(b, g_off) - greatest(a, g_on)) i FROM x),
s AS (SELECT relation, l, r, t, round(coalesce(sum(i / (b - a + g_off - g_on - i)) FILTER (NOT no_evidence AND act), 0) / greatest(1, count(*) FILTER (NOT no_evidence)), 9) mean_iou, round(count(*) FILTER (NOT no_evidence AND act AND right_) / greatest(1, count(*) FILTER (NOT no_evidence)), 9) accuracy, round(count(*) FILTER (no_evidence AND NOT act) / greatest(1, count(*) FILTER (no_evidence)), 9) rejection, round(coalesce(avg(b - a) FILTER (NOT no_evidence AND act), 0), 9) mean_span FROM y GROUP BY 1, 2, 3, 4),
k AS (SELECT *, row_number() OVER (PARTITION BY relation ORDER BY (rejection >= 0.5) DESC, mean_iou DESC, accuracy DESC, rejection DESC, mean_span, l, r, t) n FROM s) SELECT relation, t::DOUBLE AS threshold, l::DOUBLE AS left, r::DOUBLE AS right_pad, mean_iou, accuracy, rejection, mean_span FROM k WHERE n = 1""".replace("AS left,", 'AS "left",'))
def policy_search(spark, sf):
    n = F.col("event_id")
    p = load(spark, sf, "events").select(F.col("event_type").alias("relation"), (F.col("value") / 500).alias("score"), (n % 4 == 0).alias("no_evidence"), (n % 3 != 0).alias("right"), (10 + n % 7).alias("onset"), (20 + n % 11).alias("off"), (8 + n % 5).alias("gold_onset"), (22 + n % 13).alias("gold_off"))
    return A.policy_search(p, PADS, LEVELS, 0.5)


@query("M16 M20", f"WITH {SCORED}, a AS (SELECT avg((score >= 0.5)::INT) FILTER (label = 1) x, avg((score < 0.5)::INT) FILTER (label = 0) y, avg((score - label) * (score - label)) b, count(*) FILTER (score >= 0.5) k, count(*) n FROM s) SELECT round(x, 6) AS hit, round(y, 6) AS reject, round(b, 6) AS brier, round(CASE WHEN x > 0 AND y > 0 THEN 2 * x * y / (x + y) ELSE 0 END, 6) AS harmonic, round((k / n + 3.8416 / (2 * n) + 1.96 * sqrt(k / n * (1 - k / n) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n), 6) AS upper FROM a")
def threshold_metrics(spark, sf):
    s = scored(spark, sf)
    a = s.agg(F.avg(F.when(F.col("label") == 1, (F.col("score") >= 0.5).cast("int"))).alias("x"), F.avg(F.when(F.col("label") == 0, (F.col("score") < 0.5).cast("int"))).alias("y"), F.avg((F.col("score") - F.col("label")) ** 2).alias("b"), F.count_if(F.col("score") >= 0.5).alias("k"), F.count("*").alias("n"))
    return a.select(R("x").alias("hit"), R("y").alias("reject"), R("b").alias("brier"), R(A.harmonic(F.col("x"), F.col("y"))).alias("harmonic"), R(A.wilson_upper(F.col("k"), F.col("n"))).alias("upper"))


VEC = "v AS (SELECT vec_id, label, embedding e FROM embeddings)"


@query("M17 F17", f"WITH {VEC}, p AS (SELECT a.vec_id, a.label la, b.label lb, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_dot_product(a.e::DOUBLE[], b.e::DOUBLE[]) / sqrt(list_dot_product(a.e::DOUBLE[], a.e::DOUBLE[]) * list_dot_product(b.e::DOUBLE[], b.e::DOUBLE[])), 9) DESC, b.vec_id) n FROM v a JOIN v b ON a.vec_id <> b.vec_id AND a.vec_id % 100 = 0) SELECT vec_id, min(n) FILTER (la = lb) AS rank, coalesce(min(n) FILTER (la = lb) <= 5, false) AS recall_5 FROM p GROUP BY 1")
def recall_at_k(spark, sf):
    from tidemark.operators.similarity import ranks

    v = load(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").cast("array<double>").alias("e"))
    # the query rows are a stated hundredth; they are compared with all rows
    return ranks(v, v.where("id % 100 = 0")).select(F.col("id").alias("vec_id"), "rank", F.coalesce(F.col("rank") <= 5, F.lit(False)).alias("recall_5"))
