"""Record checks, selections, coverage, progress and audio as queries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tidemark.operators import aggregates as A
from tidemark.operators import audits as D
from tidemark.operators import records as C
from tidemark.operators import resampling as B
from tidemark.operators import sequences as S
from tidemark.operators import timelines
from tidemark.plans.registry import TL, load, query, timeline
from tidemark.sources import audio, readers
from tidemark.streaming import streams

R = lambda x, n=6: F.round(x, n)

#: Records from orders: their line items are the events, some rules broken on purpose.
RECORD = """e AS (SELECT l_orderkey k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) n, l_returnflag label, l_quantity onset FROM lineitem),
g AS (SELECT k, count(*) c, count(DISTINCT onset) d, count(*) FILTER (label = 'A') a, count(*) FILTER (label IN ('X', 'Y')) z FROM e GROUP BY 1),
p AS (SELECT e.*, row_number() OVER (PARTITION BY k ORDER BY onset, n) pos FROM e), r AS (SELECT g.*, g.k % 3 rel, g.k % 4 = 0 none, x.pos px, x.onset ox, y.pos py, y.onset oy FROM g LEFT JOIN p x ON x.k = g.k AND x.n = 1 LEFT JOIN p y ON y.k = g.k AND y.n = 2)"""
BROKEN = {
    "id_prefix": "k % 13 = 0",
    "samples": "k % 11 = 0",
    "events": "c < 4",
    "unique_onsets": "d < c",
    "options": "k % 7 = 0",
    "answer_index": "k % 5 = 0",
    "empty_roles": "none AND k % 8 = 0",
    "absence": "none AND CASE WHEN rel < 2 THEN a >= 2 ELSE z > 0 END",
    "roles": "NOT none AND py IS NULL",
    "adjacent": "NOT none AND rel < 2 AND (py IS NULL OR py <> px + CASE rel WHEN 0 THEN 1 ELSE -1 END)",
    "earlier": "NOT none AND rel = 2 AND NOT coalesce(oy < ox, false)",
}


@query("P5 P6", f"WITH {RECORD} SELECT k AS l_orderkey, array_to_string(list_filter([" + ", ".join(f"CASE WHEN {bad} THEN '{name}' END" for name, bad in BROKEN.items()) + "], lambda v: v IS NOT NULL), ',') AS violations FROM r")
def record_violations(spark, sf):
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    e = load(spark, sf, "lineitem").withColumn("event_id", n)
    k = F.col("l_orderkey")
    r = e.groupBy("l_orderkey").agg(F.collect_list(F.struct("event_id", F.col("l_returnflag").alias("label"), F.col("l_quantity").alias("onset"))).alias("events"))
    none = k % 4 == 0
    options = F.array(*map(F.lit, ["a", "b", "c", C.NO_EVIDENCE]), F.when(k % 7 == 0, "a").otherwise("d"))
    answer = F.when(none, C.NO_EVIDENCE).otherwise("b")
    r = r.select(
        "l_orderkey", "events", F.lit("dev").alias("split"), F.concat(F.when(k % 13 == 0, "test_").otherwise("dev_"), k.cast("string")).alias("record_id"), F.lit(16000).alias("rate"), F.lit(2.5).alias("duration"), F.when(k % 11 == 0, 1).otherwise(40000).alias("samples"),
        F.element_at(F.array(*map(F.lit, ["after", "before", "first"])), (k % 3 + 1).cast("int")).alias("relation"), none.alias("no_evidence"), F.lit("A").alias("query_label"), F.lit(2).alias("query_ordinal"), F.array(F.lit("X"), F.lit("Y")).alias("candidates"),
        F.when(~none, 1).alias("anchor_id"), F.when(~none | (k % 8 == 0), 2).alias("answer_id"), options.alias("options"), F.when(k % 5 == 0, 0).when(none, 3).otherwise(1).alias("answer_index"), answer.alias("answer"),
    )
    return C.violations(r).select("l_orderkey", F.array_join("violations", ",").alias("violations"))


RATED = "v AS (SELECT scene, label, floor(onset / 86400) AS day, event_id % 2 AS rater, min(onset) onset, max(off) off, count(*) n FROM tl GROUP BY 1, 2, 3, 4)"


@query("J24", f"WITH {TL}, {RATED}, c AS (SELECT coalesce(l.scene, r.scene) AS scene, coalesce(l.label, r.label) AS label, coalesce(l.day, r.day) AS day, l.onset a, l.off b, l.n x, r.onset c, r.off d, r.n y FROM (SELECT * FROM v WHERE rater = 0) l FULL JOIN (SELECT * FROM v WHERE rater = 1) r ON l.scene = r.scene AND l.label = r.label AND l.day = r.day) SELECT scene, label, day::BIGINT AS day, array_to_string(list_filter([CASE WHEN a IS NULL OR c IS NULL THEN 'missing' END, CASE WHEN x <> y THEN 'phrase' END, CASE WHEN greatest(abs(a - c), abs(b - d)) > 7200 AND a IS NOT NULL AND c IS NOT NULL THEN 'boundary' END, CASE WHEN greatest(0, least(b, d) - greatest(a, c)) / (greatest(b, d) - least(a, c)) < 0.5 AND a IS NOT NULL AND c IS NOT NULL THEN 'overlap' END], lambda v: v IS NOT NULL), ',') AS conflicts FROM c")
def rater_conflicts(spark, sf):
    t = timeline(spark, sf).withColumn("day", F.floor(F.col("onset") / 86400))
    v = t.groupBy("scene", "label", "day", (F.col("event_id") % 2).alias("rater")).agg(F.min("onset").alias("onset"), F.max("off").alias("off"), F.count("*").alias("phrase"))
    out = C.rater_conflicts(v.where("rater = 0"), v.where("rater = 1"), ["scene", "label", "day"], 7200.0, 0.5)
    return out.withColumn("conflicts", F.array_join("conflicts", ","))


@query("A31", "WITH b AS (SELECT p_partkey k, p_size % 4 p, p_partkey % 4 g FROM part), m AS (SELECT k, (p_size + p_partkey % 2) % 4 q, k % 5 <> 0 w FROM (SELECT p_partkey k, p_size, p_partkey FROM part)) SELECT count(*) AS pairs, round(avg((p = q)::INT), 6) AS invariance, round(avg((p = g AND q = g)::INT), 6) AS both_right, round(avg((p = g)::INT) - avg((q = g)::INT), 6) AS accuracy_gap FROM b JOIN m ON m.k = b.k WHERE w")
def option_order(spark, sf):
    k, gold = F.col("p_partkey"), F.col("p_partkey") % 4
    p = load(spark, sf, "part")

    def side(predicted, options):
        return p.select("p_partkey", F.col("p_name").alias("question"), options.alias("options"), predicted.alias("predicted"), (predicted == gold).cast("int").alias("right"))

    order = F.array(*map(F.lit, "wxyz"))
    out = C.option_order(side(F.col("p_size") % 4, order), side((F.col("p_size") + k % 2) % 4, F.when(k % 5 == 0, order).otherwise(F.reverse(order))), "p_partkey")
    return out.select("pairs", *[R(c).alias(c) for c in ("invariance", "both_right", "accuracy_gap")])


@query("M3 M8", "WITH f AS (SELECT user_id, value >= 200 o, event_type IN ('click', 'error') AND user_id % 5 <> 0 g FROM events), e AS (SELECT user_id, count(*) FILTER (o AND g) tp, count(*) FILTER (o AND NOT g) fp, count(*) FILTER (NOT o AND g) fn, count(*) n FROM f GROUP BY 1) SELECT round(avg(CASE WHEN tp + fp + fn = 0 THEN 1 ELSE tp / greatest(1, tp + fp + fn) END), 6) AS macro_iou, round(sum(tp) / sum(tp + fp + fn), 6) AS micro_iou, round(avg(CASE WHEN tp + fp + fn = 0 THEN 1 ELSE 2 * tp / greatest(1, 2 * tp + fp + fn) END), 6) AS macro_f1, round(2 * sum(tp) / sum(2 * tp + fp + fn), 6) AS micro_f1, round(sum(tp + fp) / sum(n), 6) AS retained, round(avg((fp = 0)::INT) FILTER (tp + fn = 0), 6) AS reject_rate FROM e")
def frame_metrics(spark, sf):
    f = load(spark, sf, "events").select("user_id", "value", (F.col("event_type").isin("click", "error") & (F.col("user_id") % 5 != 0)).cast("int").alias("target"))
    m = A.frame_metrics(f, "user_id", "value", "target", 200)
    return m.select(*[R(c).alias(c) for c in m.columns])


DELTA = "c AS (SELECT o_custkey % 40 k, sum(o_totalprice) s, sum((o_orderstatus = 'F')::INT * o_totalprice) f, count(*) n FROM orders GROUP BY 1), m AS (SELECT *, row_number() OVER (ORDER BY k) - 1 AS number FROM c), d AS (SELECT r.r, (('0x' || substr(sha256('delta:' || r.r || ':' || i.i), 1, 16))::UBIGINT % 40)::INT AS number FROM (SELECT unnest(range(200)) r) r, (SELECT unnest(range(40)) i) i), b AS (SELECT r, sum(s) / sum(n) AS x, sum(f) / sum(n) AS y, avg(s / n) - avg(f / n) AS z FROM d JOIN m ON m.number = d.number GROUP BY 1)"


@query("B3 B5", f"WITH {DELTA} SELECT round(avg(x - y), 2) AS mean, round(quantile_cont(x - y, 0.025), 2) AS low, round(quantile_cont(x - y, 0.975), 2) AS high, round(avg(z), 2) AS macro FROM b")
def bootstrap_delta(spark, sf):
    o = load(spark, sf, "orders").withColumn("k", F.col("o_custkey") % 40)
    c = B.cluster_sums(o, "k", F.col("o_totalprice"), (F.col("o_orderstatus") == "F").cast("int") * F.col("o_totalprice"))
    b = B.bootstrap(c, 200, "delta").select(((F.col("s_0") - F.col("s_1")) / F.col("n")).alias("d"), (F.col("m_0") - F.col("m_1")).alias("z"))
    return b.agg(R(F.avg("d"), 2).alias("mean"), R(F.percentile("d", 0.025), 2).alias("low"), R(F.percentile("d", 0.975), 2).alias("high"), R(F.avg("z"), 2).alias("macro"))


@query("SP7", "WITH p AS (SELECT * FROM (SELECT p_brand, p_partkey, p_size, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) n FROM part) WHERE n <= 7), r AS (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) n FROM part WHERE p_partkey % 400 NOT IN (SELECT p_partkey % 400 FROM p)) SELECT p_brand, p_partkey, 'primary' AS side, n AS rank FROM p UNION ALL SELECT p_brand, p_partkey, 'reserve', n FROM r WHERE n <= 3")
def primary_and_reserve(spark, sf):
    p = load(spark, sf, "part").select("p_brand", "p_partkey", "p_size", (F.col("p_partkey") % 400).alias("video"))
    order = [F.desc("p_size"), "p_partkey"]
    primary = S.capped(p, ["p_brand"], order, 7)
    reserve = S.capped(p.join(primary.select("video").distinct(), "video", "left_anti"), ["p_brand"], order, 3)
    return primary.select("p_brand", "p_partkey", F.lit("primary").alias("side"), "rank").union(reserve.select("p_brand", "p_partkey", F.lit("reserve"), "rank"))


@query("SP14", "SELECT o_custkey, string_agg(o_orderpriority || '@' || o_orderkey, ',' ORDER BY o_orderkey) AS requests, count(DISTINCT o_orderstatus) = 1 AS one_split, count(DISTINCT o_orderkey % 2) = 1 AS one_location FROM orders GROUP BY 1")
def joint_plan(spark, sf):
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderpriority"))), lambda x: F.concat_ws("@", x["o_orderpriority"], x["o_orderkey"])), ",")
    return load(spark, sf, "orders").groupBy("o_custkey").agg(listed.alias("requests"), (F.count_distinct("o_orderstatus") == 1).alias("one_split"), (F.count_distinct(F.col("o_orderkey") % 2) == 1).alias("one_location"))


@query("SP25", "SELECT event_type, event_id, rank FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY sha256('source:' || event_id)) AS rank FROM events WHERE value >= 5) WHERE rank <= 12")
def label_sources(spark, sf):
    e = load(spark, sf, "events").where("value >= 5")
    return S.fixed_count(e, "event_type", [F.sha2(F.concat(F.lit("source:"), F.col("event_id").cast("string")), 256)], 12).select("event_type", "event_id", "rank")


@query("DD12", "SELECT source, count(*) AS n FROM documents WHERE lang <> 'fr' GROUP BY 1")
def held_out_labels(spark, sf):
    d = load(spark, sf, "documents").select("source", "lang")
    return D.assert_disjoint(d.where("lang <> 'fr'"), d.where("lang = 'fr'"), "lang").groupBy("source").agg(F.count("*").alias("n"))


@query("S4", "SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'dev' ELSE 'train' END AS split, o_orderpriority AS mid, count(DISTINCT o_custkey) AS recordings, count(*) AS events, round(sum(o_orderkey % 50 + 1 - o_orderkey % 7), 6) AS seconds FROM orders GROUP BY 1, 2")
def strong_coverage(spark, sf):
    k = F.col("o_orderkey")
    e = load(spark, sf, "orders").select(F.when(k % 3 == 0, "dev").otherwise("train").alias("split"), F.col("o_orderpriority").alias("mid"), F.col("o_custkey").alias("recording"), (k % 7).alias("onset"), (k % 50 + 1).alias("off"))
    return readers.coverage(e).withColumn("seconds", R(F.col("seconds").cast("double")))


@query("A22 ST4", "WITH r AS (SELECT o_orderstatus s, o_orderpriority p, o_totalprice > 100000 done FROM orders) SELECT s AS split, p AS route, count(*) AS planned, count(*) FILTER (done) AS complete, round(100.0 * count(*) FILTER (done) / count(*), 6) AS percent, count(*) FILTER (done) <= count(*) AS consistent FROM r GROUP BY ROLLUP (s, p)")
def progress(spark, sf):
    o = load(spark, sf, "orders").select("o_orderkey", F.col("o_orderstatus").alias("split"), F.col("o_orderpriority").alias("route"))
    done = load(spark, sf, "orders").where("o_totalprice > 100000").select("o_orderkey", F.lit(1).alias("done"))
    r = o.join(done, "o_orderkey", "left").rollup("split", "route").agg(F.count("*").alias("planned"), F.count("done").alias("complete"))
    return r.select("split", "route", "planned", "complete", R(100.0 * F.col("complete") / F.col("planned")).alias("percent"), (F.col("complete") <= F.col("planned")).alias("consistent"))


@query("A18", "WITH s AS (SELECT o_custkey % 5 seed, avg(o_totalprice) FILTER (o_orderstatus = 'F') a, avg(o_totalprice) FILTER (o_orderstatus = 'O') b FROM orders GROUP BY 1) SELECT round(avg(a - b), 4) AS effect, round(stddev_samp(a - b), 4) AS sd, round(-avg(a - b), 4) AS oriented, count(*) FILTER (a < b) AS better FROM s")
def paired_effects(spark, sf):
    status = lambda x: F.avg(F.when(F.col("o_orderstatus") == x, F.col("o_totalprice")))
    s = load(spark, sf, "orders").groupBy(F.col("o_custkey") % 5).agg((status("F") - status("O")).alias("d"))
    # lower is better: the oriented effect is its negative
    return s.agg(R(F.avg("d"), 4).alias("effect"), R(F.stddev_samp("d"), 4).alias("sd"), R(-F.avg("d"), 4).alias("oriented"), F.count_if(F.col("d") < 0).alias("better"))


@query("M23", "WITH p AS (SELECT label g, (label + CASE WHEN vec_id % 7 = 0 THEN 1 ELSE 0 END) % 10 p, vec_id % 3 <> 0 e FROM embeddings) SELECT g AS label, count(*) AS n, round(avg((g = p)::INT), 6) AS answer, round(avg(e::INT), 6) AS evidence, round(avg((g = p AND e)::INT), 6) AS joint FROM p GROUP BY 1")
def joint_accuracy(spark, sf):
    g, v = F.col("label"), F.col("vec_id")
    right, seen = g == (g + F.when(v % 7 == 0, 1).otherwise(0)) % 10, v % 3 != 0
    return load(spark, sf, "embeddings").groupBy("label").agg(F.count("*").alias("n"), *[R(F.avg(x.cast("int"))).alias(name) for name, x in (("answer", right), ("evidence", seen), ("joint", right & seen))])


COS = "list_dot_product({0}, {1}) / sqrt(list_dot_product({0}, {0}) * list_dot_product({1}, {1}))"


@query("M22", f"WITH v AS (SELECT a.vec_id, a.embedding::DOUBLE[] x, b.embedding::DOUBLE[] y, c.embedding::DOUBLE[] z FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 JOIN embeddings c ON c.vec_id = a.vec_id + 2) SELECT vec_id, round(list_dot_product(y, y) / list_dot_product(x, x), 6) AS energy_ratio, round(({COS.format('x', 'y')}) - ({COS.format('x', 'z')}), 6) AS cosine_margin, round(len(list_filter(x, lambda t: abs(t) >= 0.99)) / len(x), 6) AS clipped FROM v")
def stem_quality(spark, sf):
    from tidemark.functions.arrays import cosine, dot

    e = load(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    near = lambda n, name: e.select((F.col("vec_id") - n).alias("vec_id"), F.col("x").alias(name))
    v = e.join(near(1, "y"), "vec_id").join(near(2, "z"), "vec_id")
    return v.select("vec_id", R(F.try_divide(dot("y", "y"), dot("x", "x"))).alias("energy_ratio"), R(cosine("x", "y") - cosine("x", "z")).alias("cosine_margin"), R(F.size(F.filter("x", lambda t: F.abs(t) >= 0.99)) / F.size("x")).alias("clipped"))


@query("X1 ST4", "SELECT count(*) AS rows, true AS finished FROM events")
def stream_progress(spark, sf):
    seen: list[tuple[str, dict]] = []
    streams.drained(streams.deduplicated(streams.event_stream(spark, f"{sf}/events.parquet"), "event_id", "60 days"), notify=lambda name, payload: seen.append((name, payload)))
    rows = sum(p["rows"] for name, p in seen if name == "batch")
    return spark.createDataFrame([(rows, seen[-1] == ("finished", {"batches": len(seen) - 1}))], "rows bigint, finished boolean")


@query("S18", "SELECT vec_id, len(embedding)::BIGINT AS n, sum_::BIGINT AS total FROM (SELECT vec_id, embedding, list_sum([(vec_id * 31 + i * 7) % 2001 - 1000 FOR i IN range(len(embedding))]) AS sum_ FROM embeddings)")
def wav_decoding(spark, sf):
    import pandas as pd

    def encode(rows):
        for p in rows:
            waves = [audio.encoded(np.array([(v * 31 + i * 7) % 2001 - 1000 for i in range(n)]), 8000) for v, n in zip(p.vec_id, p.n)]
            yield pd.DataFrame({"path": p.vec_id.astype(str), "content": waves})

    files = load(spark, sf, "embeddings").select("vec_id", F.size("embedding").alias("n")).mapInPandas(encode, "path string, content binary")
    total = F.aggregate("samples", F.lit(0.0).cast("double"), lambda a, x: a + x.cast("double"))
    return audio.read_wav(files).select(F.col("path").cast("bigint").alias("vec_id"), F.size("samples").cast("bigint").alias("n"), F.round(total * 32768).cast("bigint").alias("total"))


@query("X7", None)
def model_scores(spark, sf):
    from tidemark.operators.models import MODELS, scored

    e = load(spark, sf, "embeddings").select("vec_id", "embedding", (F.col("label") == 0).cast("int").alias("y"))
    out = [scored(e.where("vec_id % 2 = 0"), e.where("vec_id % 2 = 1"), name, "embedding", "y").select("vec_id", F.lit(name).alias("model"), "score") for name in sorted(MODELS)]
    return out[0].union(out[1]).union(out[2])


@query("X8", None)
def cluster_count(spark, sf):
    from tidemark.operators.models import cluster_count as count

    return spark.createDataFrame([(count(load(spark, sf, "embeddings"), "embedding", 5),)], "clusters int")


@query("J2", "WITH i AS (SELECT o_orderkey k, o_custkey FROM orders WHERE o_orderkey % 2 = 0), g AS (SELECT o_orderkey k, count(*) n, min(o_totalprice) price FROM orders WHERE o_orderkey % 7 <> 0 GROUP BY 1), c AS (SELECT l_orderkey k, count(*) n, min(l_quantity) q FROM lineitem WHERE l_linenumber = 1 GROUP BY 1) SELECT i.k AS o_orderkey, CASE WHEN g.n IS NULL THEN 'missing_truth' WHEN g.n > 1 THEN 'repeated_truth' WHEN c.n IS NULL THEN 'missing_clips' WHEN c.n > 1 THEN 'repeated_clips' WHEN price < 50000 THEN 'too_cheap' END AS reason FROM i LEFT JOIN g ON g.k = i.k LEFT JOIN c ON c.k = i.k")
def metadata_reasons(spark, sf):
    from tidemark.operators.joins import joined_metadata

    o = load(spark, sf, "orders")
    truth = o.where("o_orderkey % 7 <> 0").select("o_orderkey", "o_totalprice")
    clips = load(spark, sf, "lineitem").where("l_linenumber = 1").select(F.col("l_orderkey").alias("o_orderkey"), "l_quantity", "l_partkey")
    return joined_metadata(o.where("o_orderkey % 2 = 0").select("o_orderkey"), {"truth": truth, "clips": clips}, "o_orderkey", {"too_cheap": F.col("o_totalprice") < 50000}).select("o_orderkey", "reason")


KEPT = "m AS (SELECT scene, label, max(conf) p FROM tl GROUP BY 1, 2), r AS (SELECT *, rank() OVER (PARTITION BY scene ORDER BY p DESC) k FROM m), e AS (SELECT tl.* FROM tl JOIN r ON r.scene = tl.scene AND r.label = tl.label WHERE (k <= 2 OR p >= 0.96 OR tl.label = 'error') AND (conf >= 0.2 OR tl.label = 'error')), s AS (SELECT *, CASE WHEN max(off) OVER w IS NULL OR onset > max(off) OVER w + 7200 THEN 1 ELSE 0 END n FROM e WINDOW w AS (PARTITION BY scene, label ORDER BY onset, off ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), g AS (SELECT *, sum(n) OVER (PARTITION BY scene, label ORDER BY onset, off ROWS UNBOUNDED PRECEDING) g FROM s)"


@query("P17", f"WITH {TL}, {KEPT} SELECT scene, label, round(min(onset), 3) AS onset, round(max(off), 3) AS off, round(max(conf), 6) AS conf FROM g WHERE off > onset GROUP BY scene, label, g")
def filtered_inventory(spark, sf):
    from pyspark.sql import Window

    from tidemark.operators.intervals import merged

    t = timeline(spark, sf)
    m = t.groupBy("scene", "label").agg(F.max("conf").alias("p")).withColumn("k", F.rank().over(Window.partitionBy("scene").orderBy(F.desc("p"))))
    forced = F.col("label") == "error"
    kept = t.join(m, ["scene", "label"]).where(((F.col("k") <= 2) | (F.col("p") >= 0.96) | forced) & ((F.col("conf") >= 0.2) | forced))
    out = merged(kept, ["scene", "label"], 7200.0, extra=[F.max("conf").alias("conf")])
    return out.select("scene", "label", R("onset", 3).alias("onset"), R("off", 3).alias("off"), R("conf").alias("conf"))


@query("P18", "WITH e AS (SELECT user_id, event_id, CASE WHEN event_id % 9 = 0 THEN NULL WHEN event_id % 10 = 0 THEN 'nan'::DOUBLE ELSE value END AS onset, value + 5 AS off, CASE WHEN event_id % 4 <> 0 THEN event_id % 4 END occ FROM events) SELECT user_id, string_agg(event_id || '#' || coalesce(occ, 1), ',' ORDER BY onset, off, event_id) AS events FROM e WHERE onset IS NOT NULL AND NOT isnan(onset) GROUP BY 1")
def display_events(spark, sf):
    n = F.col("event_id")
    e = load(spark, sf, "events").select("user_id", n.alias("event_id"), F.when(n % 9 == 0, None).when(n % 10 == 0, float("nan")).otherwise(F.col("value")).alias("onset"), (F.col("value") + 5).alias("off"), F.when(n % 4 != 0, n % 4).alias("occurrence"))
    nested = e.groupBy("user_id").agg(F.collect_list(F.struct("onset", "off", "event_id", "occurrence")).alias("events"))
    # numbers alone are shown: a null or NaN time is none
    shown = F.array_sort(F.filter("events", lambda x: x["onset"].isNotNull() & ~F.isnan(x["onset"]) & x["off"].isNotNull() & ~F.isnan(x["off"])))
    k = nested.withColumn("events", shown).where(F.size("events") > 0)
    return k.select("user_id", F.array_join(F.transform("events", lambda x: F.concat_ws("#", x["event_id"], F.coalesce(x["occurrence"], F.lit(1)))), ",").alias("events"))


TURNS = """x AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) i, CASE WHEN event_id % 3 <> 0 THEN length(event_type) END v FROM events), f AS (SELECT user_id, i, coalesce(last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY i ROWS UNBOUNDED PRECEDING), first_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) v FROM x),
m AS (SELECT user_id, i, list_sort([coalesce(lag(v) OVER w, v), v, coalesce(lead(v) OVER w, v)])[2] v FROM f WINDOW w AS (PARTITION BY user_id ORDER BY i)), n AS (SELECT *, CASE WHEN lag(v) OVER (PARTITION BY user_id ORDER BY i) = v THEN 0 ELSE 1 END s FROM m WHERE v IS NOT NULL), g AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY i ROWS UNBOUNDED PRECEDING) t FROM n), t AS (SELECT user_id, t::BIGINT AS turn, any_value(v) v, min(i) a, max(i) b FROM g GROUP BY 1, 2), q AS (SELECT *, min(a) OVER (PARTITION BY user_id, v) fa FROM t)"""


@query("W5", f"WITH {TURNS} SELECT user_id, turn, a AS start, b AS stop, dense_rank() OVER (PARTITION BY user_id ORDER BY fa) AS speaker FROM q")
def decoded_turns(spark, sf):
    from pyspark.sql import Window

    i = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    x = load(spark, sf, "events").select("user_id", i.alias("i"), F.when(F.col("event_id") % 3 != 0, F.length("event_type")).alias("v"))
    smooth = S.filled(x, ["user_id"], ["i"], "v").withColumn("v", S.median("v", ["user_id"], ["i"], 3)).where("v is not null")
    return S.turns(smooth, ["user_id"], "i", "v").select("user_id", "turn", "start", "stop", "speaker")


@query("SP24", "SELECT event_type, event_id, rank FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS rank FROM events) WHERE rank <= CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 WHEN 'error' THEN 2 ELSE 0 END")
def registered_design(spark, sf):
    return S.registered(load(spark, sf, "events"), "event_type", ["event_id"], {"click": 1, "view": 2, "error": 2}).select("event_type", "event_id", "rank")


def frames(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return load(spark, sf, "events").select(F.col("user_id").alias("scene"), F.row_number().over(w).alias("frame"), (F.col("value") / 500).alias("p"))


@query("W10", None)
def decoder_variants(spark, sf):
    from tidemark.operators.decoding import KINDS, decoded

    out = None
    for kind in KINDS:
        rows = decoded(frames(spark, sf), ["scene"], 0.5, 0.2, kind, 3).withColumn("decoder", F.lit(kind))
        out = rows if out is None else out.union(rows)
    return out


@query("O5", None)
def top_label_segments(spark, sf):
    from tidemark.operators.decoding import strongest

    return strongest(frames(spark, sf), ["scene"], 3, 0.6, 0.2)


@query("U1 W12", None)
def pooled_proposals(spark, sf):
    from tidemark.operators.proposals import pooled

    t = timeline(spark, sf)
    return pooled([t.where("event_id % 2 = 0"), t.where("event_id % 2 = 1").withColumn("conf", F.col("conf") * 0.9)], ["scene"], 0.3, 3, 8).select("scene", "label", "event_id", "rank")


@query("M12", None)
def event_scores(spark, sf):
    from tidemark.operators.matching import matched

    t = timeline(spark, sf)
    m = matched(t.where("event_id % 2 = 0"), t.where("event_id % 2 = 1"), ["scene", "label"], ["greatest"], 0.1)
    per = m.groupBy("label").agg(F.sum("matched").alias("tp"), F.sum("predicted").alias("p"), F.sum("gold").alias("g"))
    f1 = lambda tp, p, g: 2 * tp / F.greatest(p + g, F.lit(1))
    return per.agg(f1(F.sum("tp"), F.sum("p"), F.sum("g")).alias("micro_f1"), F.avg(F.when(F.col("g") > 0, f1(F.col("tp"), F.col("p"), F.col("g")))).alias("macro_f1"), F.sum("tp").alias("matched"))


SLOTS = ", ".join(f"('{n}', '{r}', {a}, {b}, {i})" for i, (n, r, a, b) in enumerate(timelines.FAMILY))


@query("T24", f"""WITH e AS (SELECT l_orderkey k, list('part ' || l_partkey ORDER BY l_linenumber, l_partkey, l_suppkey) p FROM lineitem GROUP BY 1 HAVING count(*) = 4 AND count(DISTINCT l_partkey) = 4), s(slot, relation, a, b, i) AS (VALUES {SLOTS}),
q AS (SELECT *, CASE WHEN a < 0 THEN 'no_evidence' WHEN relation = 'first' THEN p[least(a, b) + 1] ELSE p[b + 1] END answer, (k * 8 + i) % 5 place FROM e, s), o AS (SELECT *, list_filter(list_append(p, 'no_evidence'), lambda x: x <> answer) r FROM q)
SELECT k AS l_orderkey, slot, CASE WHEN relation = 'first' THEN 'Which starts first, ' || p[a + 1] || ' or ' || p[b + 1] || '?' ELSE 'What comes right ' || relation || ' ' || CASE WHEN a < 0 THEN 'part 0' ELSE p[a + 1] END || '?' END AS question, answer, place::BIGINT AS answer_index, array_to_string(list_concat(list_append(r[1:place], answer), r[place + 1:4]), '|') AS options, a < 0 AS no_evidence FROM o""")
def question_families(spark, sf):
    e = load(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.count_distinct("l_partkey").alias("d"), F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("x")).where("n = 4 AND d = 4")
    scenes = e.select("l_orderkey", F.transform("x", lambda v: F.struct(v["l_linenumber"].alias("event_id"), F.concat(F.lit("part "), v["l_partkey"].cast("string")).alias("phrase"))).alias("events"))
    q = timelines.question_family(scenes, F.lit("part 0"), F.col("l_orderkey"))
    return q.select("l_orderkey", "slot", "question", "answer", F.col("answer_index").cast("bigint").alias("answer_index"), F.array_join("options", "|").alias("options"), "no_evidence")
