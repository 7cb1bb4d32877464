"""Audits, splits and order-dependent matching as queries."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import audits as D
from tidemark.operators import matching as M
from tidemark.operators import splits as P
from tidemark.plans.registry import TL, load, query, timeline

R = lambda x, n=6: F.round(x, n)


@query("DD1", "SELECT doc_id FROM documents WHERE sha256(text) IN (SELECT sha256(text) FROM documents GROUP BY 1 HAVING count(*) = 1)")
def dup_content(spark, sf):
    return D.without_duplicates(load(spark, sf, "documents"), F.col("text")).select("doc_id")


SPLITS = "s AS (SELECT CASE doc_id % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'dev' ELSE 'test' END AS split, sha256(text) content, source FROM documents)"


@query("DD2 DD3 U2 A8", f"WITH {SPLITS}, l AS (SELECT DISTINCT split, 'content' field, content AS value FROM s UNION SELECT split, 'source', source FROM s), p AS (SELECT a.field, a.value, a.split AS left, b.split AS right FROM l a JOIN l b ON a.field = b.field AND a.value = b.value AND a.split < b.split) SELECT field, \"left\", \"right\", count(*) AS shared, array_to_string(list_sort(list(value))[1:5], ',') AS samples FROM p GROUP BY 1, 2, 3")
def split_leakage(spark, sf):
    d = load(spark, sf, "documents").select(F.element_at(F.array(*map(F.lit, ["train", "dev", "test"])), (F.col("doc_id") % 3 + 1).cast("int")).alias("split"), F.sha2("text", 256).alias("content"), "source")
    return D.leakage(d, "split", ["content", "source"]).withColumn("samples", F.array_join("samples", ","))


@query("DD6", "WITH g AS (SELECT lang, sum(quality) p, sum(1 - quality) n FROM labels JOIN documents USING (doc_id) GROUP BY 1) SELECT round((sum(CASE WHEN p >= n THEN p ELSE 0 END) / sum(p) + sum(CASE WHEN p >= n THEN 0 ELSE n END) / sum(n)) / 2, 6) AS balanced_accuracy FROM g")
def majority_balanced_accuracy(spark, sf):
    d = load(spark, sf, "labels").join(load(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    return D.majority_accuracy(d, ["lang"], "quality").select(R("balanced_accuracy").alias("balanced_accuracy"))


@query("DD7", f"WITH {TL}, n AS (SELECT *, lead(onset) OVER w n_on, lead(label) OVER w n_label FROM tl WINDOW w AS (PARTITION BY scene ORDER BY onset, off, label, event_id)) SELECT scene, count(*) FILTER (onset = n_on) AS ties, count(*) FILTER (n_on < off) AS overlapping, count(*) FILTER (label = n_label) AS same_label FROM n GROUP BY 1")
def temporal_pair_audit(spark, sf):
    w = Window.partitionBy("scene").orderBy("onset", "off", "label", "event_id")
    n = timeline(spark, sf).withColumns({"n_on": F.lead("onset").over(w), "n_label": F.lead("label").over(w)})
    return n.groupBy("scene").agg(F.count_if(F.col("onset") == F.col("n_on")).alias("ties"), F.count_if(F.col("n_on") < F.col("off")).alias("overlapping"), F.count_if(F.col("label") == F.col("n_label")).alias("same_label"))


@query("DD8", f"WITH {TL}, n AS (SELECT *, lag(off) OVER (PARTITION BY scene ORDER BY onset, off, event_id) p FROM tl) SELECT scene, count(*) AS events, count(*) FILTER (abs(onset / 60 - round(onset / 60)) > 1e-8) AS off_grid, count(*) FILTER (p > onset + 1e-8) AS overlapping FROM n GROUP BY 1")
def scene_grid_audit(spark, sf):
    return D.grid_violations(timeline(spark, sf), ["scene"], 60.0)


@query("DD11", "WITH f AS (SELECT l_orderkey, l_linenumber, first(l_partkey ORDER BY l_partkey, l_suppkey, l_quantity) AS part, max(l_discount) - min(l_discount) <= 1e-7 AS consistent FROM lineitem GROUP BY 1, 2) SELECT * FROM f")
def acoustic_units(spark, sf):
    l = load(spark, sf, "lineitem")  # noqa: E741
    return D.deduplicated_units(l, ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey", "l_quantity"], ["l_discount"]).select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("part"), "consistent")


@query("DD10 SP18", "SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) = 3 AND count(DISTINCT l_returnflag) = 3")
def complete_variants(spark, sf):
    return D.complete_groups(load(spark, sf, "lineitem"), "l_orderkey", "l_returnflag", ["A", "N", "R"])


@query("DD13 S21", "SELECT d.doc_id, sha256(d.text) = sha256(e.text) AS bound FROM documents d JOIN documents e ON e.doc_id = d.doc_id + 1")
def receipt_binding(spark, sf):
    h = load(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    return h.join(h.select((F.col("doc_id") - 1).alias("doc_id"), F.col("h").alias("g")), "doc_id").select("doc_id", (F.col("h") == F.col("g")).alias("bound"))


@query("DD2 J3", "SELECT doc_id FROM documents WHERE sha256(text) IN (SELECT sha256(text) FROM benchmark)")
def contamination_semi_join(spark, sf):
    b = load(spark, sf, "benchmark").select(F.sha2("text", 256).alias("h"))
    return load(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("h")).join(b, "h", "left_semi").select("doc_id")


COMP = "WITH RECURSIVE k AS (SELECT DISTINCT s_suppkey s, s_nationkey % 7 a, s_suppkey // 40 b FROM supplier), r(s, t) AS (SELECT s, s FROM k UNION SELECT r.s, y.s FROM r JOIN k x ON x.s = r.t JOIN k y ON y.a = x.a AND abs(y.b - x.b) = 0)"


@query("SP2", COMP + " SELECT s AS s_suppkey, min(t) AS component FROM r GROUP BY 1")
def identity_components(spark, sf):
    s = load(spark, sf, "supplier").select("s_suppkey", F.concat_ws("-", F.col("s_nationkey") % 7, F.floor(F.col("s_suppkey") / 40)).alias("k"))
    return P.components(s, "s_suppkey", ["k"])


@query("SP22", "WITH g AS (SELECT c_nationkey k, count(*) size FROM customer GROUP BY 1), o AS (SELECT *, coalesce(sum(size) OVER (ORDER BY sha256('cal' || k) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) b FROM g) SELECT k AS c_nationkey, size, CASE WHEN b < sum(size) OVER () * 0.5 THEN 'calibration' ELSE 'selection' END AS side FROM o")
def disjoint_halves(spark, sf):
    return P.disjoint_halves(load(spark, sf, "customer"), "c_nationkey", 0.5, "cal")


@query("SP21", "WITH r AS (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY sha256(p_partkey::VARCHAR)) turn FROM part) SELECT p_partkey, turn FROM r ORDER BY turn, p_brand LIMIT 60")
def stratified_limit(spark, sf):
    return P.round_robin(load(spark, sf, "part"), "p_brand", F.sha2(F.col("p_partkey").cast("string"), 256), 60).select("p_partkey", "turn")


@query("SP9", "WITH r AS (SELECT p_brand, p_partkey, p_size, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) n FROM part), a AS (SELECT *, sum((p_size % 2 = 0)::INT) OVER (PARTITION BY p_brand ORDER BY n) k FROM r) SELECT p_brand, count(*) FILTER (p_size % 2 = 0 AND k <= 50) AS accepted, ceil((50 - count(*) FILTER (p_size % 2 = 0 AND k <= 50)) * 1.5)::BIGINT AS request FROM a GROUP BY 1")
def topup_request(spark, sf):
    w = Window.partitionBy("p_brand").orderBy(F.desc("p_size"), "p_partkey")
    good = (F.col("p_size") % 2 == 0).cast("int")
    a = load(spark, sf, "part").withColumn("k", F.sum(good).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    accepted = F.count_if((F.col("p_size") % 2 == 0) & (F.col("k") <= 50))
    return a.groupBy("p_brand").agg(accepted.alias("accepted"), F.ceil((50 - accepted) * 1.5).cast("bigint").alias("request"))


@query("SP20", "WITH a AS (SELECT n_name l, count(*) n FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_acctbal > 9000 GROUP BY 1), b AS (SELECT n_name l, count(*) n FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE s_acctbal > 5000 GROUP BY 1) SELECT coalesce(a.l, b.l) AS label, coalesce(a.n, 0) + coalesce(b.n, 0) AS n, CASE WHEN b.l IS NULL THEN 'a' WHEN a.l IS NULL THEN 'b' ELSE 'ab' END AS route, coalesce(a.n, 0) >= 4 AND coalesce(b.n, 0) >= 2 AS ready FROM a FULL JOIN b ON a.l = b.l")
def coverage_merge(spark, sf):
    n = load(spark, sf, "nation")
    a = load(spark, sf, "customer").where("c_acctbal > 9000").join(n, F.col("n_nationkey") == F.col("c_nationkey")).groupBy(F.col("n_name").alias("label")).agg(F.count("*").alias("a"))
    b = load(spark, sf, "supplier").where("s_acctbal > 5000").join(n, F.col("n_nationkey") == F.col("s_nationkey")).groupBy(F.col("n_name").alias("label")).agg(F.count("*").alias("b"))
    x, y = F.coalesce("a", F.lit(0)), F.coalesce("b", F.lit(0))
    return a.join(b, "label", "full_outer").select("label", (x + y).alias("n"), F.when(F.col("b").isNull(), "a").when(F.col("a").isNull(), "b").otherwise("ab").alias("route"), ((x >= 4) & (y >= 2)).alias("ready"))


@query("SP1 SP3", None)
def stratified_split(spark, sf):
    groups = P.label_groups(load(spark, sf, "documents"), "source", "lang")
    dev = P.improved_partition(groups, P.stratified_dev(groups, 0.2, "dev"), 0.2)
    return spark.createDataFrame([(g, "dev" if g in dev else "train", sum(c.values())) for g, c in sorted(groups.items())], "source string, side string, n bigint")


@query("SP5 SP13 S11", None)
def quota_cover(spark, sf):
    e = load(spark, sf, "events")
    kept = P.cover(e, "user_id", "event_type", {k: 12 for k in ("click", "view", "error", "purchase", "signup")}, "cover")
    sizes = e.join(kept, "user_id").groupBy("user_id", "place").agg(F.count("*").alias("n")).orderBy("place").collect()  # at most the quotas' sum
    batches = P.packed_groups([(str(r.user_id), r.n) for r in sizes], 8, 500)
    return spark.createDataFrame([(k, i) for i, b in enumerate(batches) for k in b], "user_id string, batch bigint")


@query("SP10 SP11 SP15 SP17", None)
def isolated_schedule(spark, sf):
    rows = load(spark, sf, "supplier").select("s_suppkey", "s_nationkey").collect()
    got = P.isolated_allocation([(str(r.s_suppkey), str(r.s_suppkey % 6), str(r.s_nationkey)) for r in rows], {str(i): 6 for i in range(6)}, "alloc")
    scenes = P.schedule(got, 3, 3)
    supply = {k: len(v) for k, v in got.items()}
    # two labels a fold, supplies as equal as can be
    fold = {x: i for i, f in enumerate(P.disjoint_folds(list(supply), 2, 3, lambda c: abs(sum(supply[x] for x in c) - sum(supply.values()) / 3))) for x in f}
    return spark.createDataFrame([(i, ",".join(s), fold[str(int(s[0]) % 6)]) for i, s in enumerate(scenes)], "scene bigint, sources string, fold bigint")


def sides(spark, sf):
    t = timeline(spark, sf)
    return t.where("event_id % 2 = 0"), t.where("event_id % 2 = 1")


@query("J14 M12", None)
def greatest_matching(spark, sf):
    return M.matched(*sides(spark, sf), ["scene", "label"], ["greatest"], 0.1)


@query("J15", None)
def greedy_matchings(spark, sf):
    return M.matched(*sides(spark, sf), ["scene"], ["onset", "confidence", "pairs"], 0.1)


@query("J16", None)
def cheapest_assignment(spark, sf):
    import numpy as np

    def run(key, p):
        p = p.sort_values(["onset", "event_id"])
        a, b = p.iloc[::2], p.iloc[1::2]  # a has as many as b or one more, so b's are the rows
        cost = np.abs(b.onset.values[:, None] - a.onset.values[None, :]) / 86400
        cols = M.assignment(cost) if len(b) else []
        return pd.DataFrame({"scene": [key[0]] * len(b), "left": [a.event_id.values[j] for j in cols], "right": b.event_id.values})

    return timeline(spark, sf).select("scene", "onset", "event_id").groupBy("scene").applyInPandas(run, "scene bigint, left bigint, right bigint")


@query("N1 O5 W12", None)
def non_maximum(spark, sf):
    return M.non_maximum(timeline(spark, sf), ["scene", "label"], 0.1).select("scene", "label", "event_id")


@query("M13", None)
def boundary_error(spark, sf):
    t = timeline(spark, sf).withColumn("day", F.col("onset") / 86400)

    def run(key, p):
        a, b = sorted(p.day[p.event_id % 2 == 0]), sorted(p.day[p.event_id % 2 == 1])
        return pd.DataFrame({"scene": [key[0]], "error": [M.boundary_error(a, b)]})

    return t.select("scene", "day", "event_id").groupBy("scene").applyInPandas(run, "scene bigint, error double")


@query("M14 M15 T26", None)
def word_errors(spark, sf):
    from tidemark.functions.text import with_quotes

    def run(key, p):
        said = [t.split() for t in p.sort_values("turn").text.fillna("")]
        voted = M.vote(said)
        wrong = [M.word_distance(s, voted) for s in said]
        near = sum(e <= 0.25 * len(s) for e, s in zip(wrong, said))
        return pd.DataFrame({"conv_id": [key[0]], "errors": [sum(wrong)], "words": [sum(map(len, said))], "turns": [len(said)], "near": [near], "exact": [wrong.count(0)]})

    # a number of parts: few bytes are much work here, and would be put into one task
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    turns = load(spark, sf, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text")).repartition(parts, "conv_id")
    voted = turns.groupBy("conv_id").applyInPandas(run, "conv_id bigint, errors bigint, words bigint, turns bigint, near bigint, exact bigint")
    ends = turns.groupBy("conv_id").agg(F.min_by("text", "turn").alias("quote"), F.filter(F.split(F.max_by("text", "turn"), r"\s+"), lambda w: w != "").alias("said"))
    quoted = with_quotes(ends, "quote", "said").select("conv_id", F.col("found.start").cast("bigint").alias("quote_start"), F.col("found.ratio").alias("quote_ratio"))
    return voted.join(quoted, "conv_id")
