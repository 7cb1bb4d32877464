"""Join queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import joins as J
from tidemark.plans.registry import TL, load, query, timeline


@query("J1 J2 S16", "SELECT coalesce(c.c_custkey, o.k) AS custkey, n_orders, CASE WHEN o.k IS NULL THEN 'unmatched_left' WHEN c.c_custkey IS NULL THEN 'unmatched_right' WHEN c_acctbal < 0 THEN 'negative_balance' END AS reason FROM customer c FULL JOIN (SELECT o_custkey k, count(*) n_orders FROM orders GROUP BY 1) o ON o.k = c.c_custkey")
def anti_join_reasons(spark, sf):
    c = load(spark, sf, "customer").select(F.col("c_custkey").alias("custkey"), "c_acctbal")
    o = load(spark, sf, "orders").groupBy(F.col("o_custkey").alias("custkey")).agg(F.count("*").alias("n_orders"))
    return J.with_reasons(c, o, "custkey", {"negative_balance": F.col("c_acctbal") < 0}).select("custkey", "n_orders", "reason")


@query("J3 S8", "SELECT s_suppkey FROM supplier WHERE (s_suppkey % 3 = 0) OR (s_suppkey % 4 = 0 AND s_nationkey = s_suppkey % 25)")
def scoped_allowlist(spark, sf):
    s = load(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").cast("string").alias("scope"))
    ids = s.select("s_suppkey").where("s_suppkey % 3 = 0").withColumn("scope", F.lit("*"))
    own = s.select("s_suppkey").where("s_suppkey % 4 = 0").withColumn("scope", (F.col("s_suppkey") % 25).cast("string"))
    return J.allowed(s, ids.union(own), "s_suppkey", "scope").select("s_suppkey")


@query("J4 U3", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def anti_join(spark, sf):
    big = load(spark, sf, "orders").where("o_totalprice > 300000")
    c = load(spark, sf, "customer")
    return c.join(big, c["c_custkey"] == big["o_custkey"], "left_anti").select("c_custkey")


@query("J5 O1 O2", "SELECT o_custkey, o_orderkey, o_orderpriority FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END, CASE left(o_orderpriority, 1) WHEN '3' THEN 1 WHEN '1' THEN 2 ELSE 3 END, o_totalprice DESC, sha256(o_orderkey::VARCHAR), o_orderkey) n FROM orders) WHERE n = 1")
def preferred_location(spark, sf):
    o = load(spark, sf, "orders")
    order = (F.when(F.col("o_orderstatus") == "F", 0).otherwise(1), J.rank_in(F.substring("o_orderpriority", 1, 1), ["3", "1"]), F.desc("o_totalprice"), F.sha2(F.col("o_orderkey").cast("string"), 256), "o_orderkey")
    return J.preferred(o, ["o_custkey"], *order).select("o_custkey", "o_orderkey", "o_orderpriority")


@query("J6 F22", "WITH r AS (SELECT l_orderkey k, list(DISTINCT l_suppkey % 10) s FROM lineitem GROUP BY 1), w AS (SELECT o_orderkey k, o_custkey c, [o_custkey % 10, (o_custkey + 1) % 10, (o_custkey + 2) % 10] q FROM orders) SELECT c AS custkey, k AS orderkey, n::BIGINT AS n_covered FROM (SELECT c, w.k, len(list_intersect(q, s)) n, row_number() OVER (PARTITION BY c ORDER BY len(list_intersect(q, s)) DESC, w.k) z FROM w JOIN r ON r.k = w.k) WHERE z = 1")
def set_cover_choice(spark, sf):
    offered = load(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("orderkey")).agg(F.collect_set(F.col("l_suppkey") % 10).alias("s"))
    o = load(spark, sf, "orders").select(F.col("o_orderkey").alias("orderkey"), F.col("o_custkey").alias("custkey"), F.array(*[(F.col("o_custkey") + i) % 10 for i in range(3)]).alias("q"))
    n = o.join(offered, "orderkey").withColumn("n_covered", F.size(F.array_intersect("q", "s")).cast("bigint"))
    return J.preferred(n, ["custkey"], F.desc("n_covered"), F.col("orderkey")).select("custkey", "orderkey", "n_covered")


@query("J7", "SELECT o_orderkey, o_custkey, n_name, n_name IS NULL AS missing FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey WHERE o_totalprice > 200000")
def attach_dimension(spark, sf):
    o = load(spark, sf, "orders").where("o_totalprice > 200000")
    c, n = load(spark, sf, "customer"), load(spark, sf, "nation")
    return o.join(c, o["o_custkey"] == c["c_custkey"], "left").join(n, n["n_nationkey"] == c["c_nationkey"], "left").select("o_orderkey", "o_custkey", "n_name", F.col("n_name").isNull().alias("missing"))


@query("J9", f"WITH {TL} SELECT a.event_id, (SELECT b.event_id FROM tl b WHERE b.scene = a.scene AND b.label = 'purchase' AND b.onset < a.onset ORDER BY b.onset DESC LIMIT 1) AS purchase_id FROM tl a WHERE a.label <> 'purchase'")
def asof_prev_purchase(spark, sf):
    t = timeline(spark, sf)
    return J.asof(t.where("label <> 'purchase'"), t.where("label = 'purchase'"), ["scene"], "onset", "label", "event_id", "purchase_id").select("event_id", "purchase_id")


@query("J10", f"WITH {TL}, p AS (SELECT a.event_id a_id, b.event_id b_id, abs((a.onset + a.off) / 2 - (b.onset + b.off) / 2) d FROM tl a JOIN tl b ON a.scene = b.scene AND a.label = b.label AND a.event_id <> b.event_id AND (abs((a.onset + a.off) / 2 - (b.onset + b.off) / 2) <= 7200 OR (a.onset < b.off AND b.onset < a.off))) SELECT a_id, b_id, round(d, 3) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY a_id ORDER BY d, b_id) n FROM p) WHERE n = 1")
def nearest_same_label(spark, sf):
    t = timeline(spark, sf)
    return J.nearest_same_label(t, t, 7200.0).withColumn("distance", F.round("distance", 3))


@query("J11 J12", "WITH a AS (SELECT o_custkey k, avg(o_totalprice) x FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), b AS (SELECT o_custkey k, avg(o_totalprice) x FROM orders WHERE o_orderstatus = 'O' GROUP BY 1), j AS (SELECT coalesce(a.k, b.k) k, a.x ax, b.x bx FROM a FULL JOIN b ON a.k = b.k) SELECT ax IS NOT NULL AND bx IS NOT NULL AS matched, count(*) FILTER (NOT ax > 150000 AND bx > 150000) AS gained, count(*) FILTER (ax > 150000 AND NOT bx > 150000) AS lost, count(*) FILTER ((ax > 150000) = (bx > 150000)) AS same FROM j GROUP BY 1")
def paired_transitions(spark, sf):
    mean = lambda s: load(spark, sf, "orders").where(F.col("o_orderstatus") == s).groupBy("o_custkey").agg(F.avg("o_totalprice").alias("x"))
    p = J.paired(mean("F"), mean("O"), "o_custkey", "x")
    return J.transitions(p, ["matched"], F.col("before") > 150000, F.col("after") > 150000)


@query("J13 A10", "SELECT o_custkey, max(o_totalprice) FILTER (o_orderstatus = 'F') AS f, max(o_totalprice) FILTER (o_orderstatus = 'O') AS o, max(o_totalprice) FILTER (o_orderstatus = 'P') AS p FROM orders GROUP BY 1")
def pivot_conditions(spark, sf):
    return load(spark, sf, "orders").groupBy("o_custkey").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.max("o_totalprice")).select("o_custkey", F.col("F").alias("f"), F.col("O").alias("o"), F.col("P").alias("p"))


@query("J17", f"WITH {TL}, p AS (SELECT a.event_id id, b.label, (least(a.off, b.off) - greatest(a.onset, b.onset)) / (greatest(a.off, b.off) - least(a.onset, b.onset)) iou, b.event_id bid FROM tl a JOIN tl b ON a.scene = b.scene AND a.event_id <> b.event_id AND a.onset < b.off AND b.onset < a.off) SELECT id AS event_id, first(label ORDER BY iou DESC, bid) AS transferred FROM p GROUP BY 1")
def label_transfer(spark, sf):
    from tidemark.operators.intervals import hull_iou, overlap_join

    t = timeline(spark, sf)
    p = overlap_join(t, t, ["scene"]).where("l_event_id <> r_event_id")
    return p.groupBy(F.col("l_event_id").alias("event_id")).agg(F.max_by("r_label", F.struct(hull_iou("l_onset", "l_off", "r_onset", "r_off"), -F.col("r_event_id"))).alias("transferred"))


@query("J18 F2", "SELECT p_partkey, n FROM part JOIN (SELECT lower(regexp_replace(p_brand, '[^A-Za-z0-9]+', ' ', 'g')) b, count(*) n FROM part GROUP BY 1) ON b = lower(regexp_replace(p_brand, '[^A-Za-z0-9]+', ' ', 'g'))")
def normalized_name_join(spark, sf):
    p = load(spark, sf, "part").withColumn("key", F.lower(F.regexp_replace("p_brand", "[^A-Za-z0-9]+", " ")))
    return p.join(p.groupBy("key").agg(F.count("*").alias("n")), "key").select("p_partkey", "n")


@query("J19", "SELECT a.l_orderkey, count(*) AS n FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_returnflag = b.l_returnflag AND abs(a.l_discount - b.l_discount) <= 1e-7 GROUP BY 1")
def isclose_match(spark, sf):
    l = load(spark, sf, "lineitem").select("l_orderkey", "l_returnflag", "l_discount")  # noqa: E741
    bucket = F.floor(F.col("l_discount") * 1e6)
    a = l.withColumn("b", F.explode(F.array(bucket - 1, bucket, bucket + 1)))
    r = l.select(F.col("l_orderkey").alias("k"), F.col("l_returnflag").alias("f"), F.col("l_discount").alias("d"), bucket.alias("rb"))
    near = a.join(r, (F.col("l_orderkey") == F.col("k")) & (F.col("l_returnflag") == F.col("f")) & (F.col("b") == F.col("rb")) & (F.abs(F.col("l_discount") - F.col("d")) <= 1e-7))
    return near.groupBy("l_orderkey").agg(F.count("*").alias("n"))


TREE = "t AS (SELECT 'R' || r_regionkey c, 'ALL' p FROM region UNION ALL SELECT 'N' || n_nationkey, 'R' || n_regionkey FROM nation UNION ALL SELECT 'S' || s_suppkey, 'N' || s_nationkey FROM supplier)"


def tree(spark, sf):
    name = lambda p, k: F.concat(F.lit(p), F.col(k).cast("string"))
    r = load(spark, sf, "region").select(F.lit("ALL").alias("parent"), name("R", "r_regionkey").alias("child"))
    n = load(spark, sf, "nation").select(name("R", "n_regionkey").alias("parent"), name("N", "n_nationkey").alias("child"))
    s = load(spark, sf, "supplier").select(name("N", "s_nationkey").alias("parent"), name("S", "s_suppkey").alias("child"))
    return r.union(n).union(s)


@query("S5 J20 F23", f"WITH RECURSIVE {TREE}, q AS (SELECT p AS parent, c AS child, 1 AS depth FROM t UNION ALL SELECT q.parent, t.c, depth + 1 FROM q JOIN t ON t.p = q.child) SELECT * FROM q")
def hierarchy_closure(spark, sf):
    return J.closure(tree(spark, sf))


@query("J20", f"WITH RECURSIVE {TREE}, q AS (SELECT p, c, 1 d FROM t UNION ALL SELECT q.p, t.c, d + 1 FROM q JOIN t ON t.p = q.c), m AS (SELECT x.c x, y.c y, x.p a, x.d + y.d d FROM q x JOIN q y ON x.p = y.p AND x.c LIKE 'N%' AND y.c LIKE 'N%' AND x.c < y.c) SELECT x, y, first(a ORDER BY d, a) AS ancestor, min(d) AS distance FROM m GROUP BY 1, 2")
def lowest_common_ancestor(spark, sf):
    n = load(spark, sf, "nation").select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("x"))
    return J.lowest_common(J.closure(tree(spark, sf)), n.join(n.withColumnRenamed("x", "y"), F.col("x") < F.col("y")))


@query("J22", "WITH RECURSIVE a AS (SELECT p_partkey k, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_partkey + (SELECT CASE WHEN p_partkey % 3 = 1 THEN 7 ELSE -5 END) END n FROM part), g AS (SELECT k FROM a WHERE n IS NULL UNION SELECT a.k FROM a JOIN g ON a.n = g.k) SELECT count(*) > 0 AS some_kept FROM g")
def support_pruning(spark, sf):
    p = load(spark, sf, "part").select(F.col("p_partkey").alias("k"), F.when(F.col("p_partkey") % 3 == 0, None).otherwise(F.col("p_partkey") + F.when(F.col("p_partkey") % 3 == 1, 7).otherwise(-5)).alias("n"))
    return J.supported(p, "k", "n").agg((F.count("*") > 0).alias("some_kept"))


@query("J23", "SELECT n_name FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region WHERE r_name LIKE 'A%') AND n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal < 0)")
def union_lookup(spark, sf):
    n, r, s = (load(spark, sf, x) for x in ("nation", "region", "supplier"))
    return n.join(r.where("r_name LIKE 'A%'"), n["n_regionkey"] == r["r_regionkey"], "left_semi").join(s.where("s_acctbal < 0"), n["n_nationkey"] == s["s_nationkey"], "left_anti").select("n_name")


@query("J24", "SELECT a.p_brand, a.p_partkey AS a, b.p_partkey AS b, a.p_type = b.p_type AND abs(a.p_size - b.p_size) <= 5 AS agree FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) n FROM part) a JOIN (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) n FROM part) b ON a.p_brand = b.p_brand AND a.n % 2 = 1 AND b.n = a.n + 1")
def rater_agreement(spark, sf):
    w = Window.partitionBy("p_brand").orderBy("p_partkey")
    p = load(spark, sf, "part").withColumns({"n": F.row_number().over(w), "b": F.lead("p_partkey").over(w), "t2": F.lead("p_type").over(w), "s2": F.lead("p_size").over(w)})
    return p.where("n % 2 = 1 AND b IS NOT NULL").select("p_brand", F.col("p_partkey").alias("a"), "b", ((F.col("p_type") == F.col("t2")) & (F.abs(F.col("p_size") - F.col("s2")) <= 5)).alias("agree"))


@query("J25 A22", "SELECT CASE WHEN grouping(n_regionkey) = 1 THEN -1 ELSE n_regionkey END AS region, count(*) AS suppliers, bool_and(s_acctbal > -1000) AS all_safe, round(sum(s_acctbal), 2) AS balance FROM supplier JOIN nation ON n_nationkey = s_nationkey GROUP BY ROLLUP (n_regionkey)")
def receipt_rollup(spark, sf):
    s, n = load(spark, sf, "supplier"), load(spark, sf, "nation")
    j = s.join(n, s["s_nationkey"] == n["n_nationkey"]).select("n_regionkey", "s_acctbal")
    return j.rollup("n_regionkey").agg(F.grouping("n_regionkey").alias("g"), F.count("*").alias("suppliers"), F.every(F.col("s_acctbal") > -1000).alias("all_safe"), F.round(F.sum("s_acctbal"), 2).alias("balance")).select(F.when(F.col("g") == 1, -1).otherwise(F.col("n_regionkey")).alias("region"), "suppliers", "all_safe", "balance")


@query("S12 W14", "WITH n AS (SELECT *, n_nationkey % 5 shard, n_nationkey // 10 grp FROM nation), g AS (SELECT shard, grp, count(*) c FROM n GROUP BY 1, 2), s AS (SELECT *, coalesce(sum(c) OVER (ORDER BY shard, grp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) start FROM g) SELECT n.n_nationkey, (start + row_number() OVER (PARTITION BY n.shard, n.grp ORDER BY n.n_nationkey) - 1)::BIGINT AS row_number FROM n JOIN s ON s.shard = n.shard AND s.grp = n.grp")
def row_address(spark, sf):
    n = load(spark, sf, "nation").select("n_nationkey", (F.col("n_nationkey") % 5).alias("shard"), F.floor(F.col("n_nationkey") / 10).alias("grp"))
    starts = n.groupBy("shard", "grp").agg(F.count("*").alias("c"))
    before = F.sum("c").over(Window.orderBy("shard", "grp").rowsBetween(Window.unboundedPreceding, -1))
    at = F.row_number().over(Window.partitionBy("shard", "grp").orderBy("n_nationkey")) - 1
    return n.join(starts.withColumn("start", F.coalesce(before, F.lit(0))), ["shard", "grp"]).select("n_nationkey", (F.col("start") + at).alias("row_number"))
