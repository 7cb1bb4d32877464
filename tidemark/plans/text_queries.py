"""Scalar functions, predicates and record checks as queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import arrays as V
from tidemark.functions import text as X
from tidemark.plans.registry import load, query

NORM = "trim(regexp_replace(lower(replace(replace({}, '_', ' '), '&', ' and ')), '[^a-z0-9]+', ' ', 'g'))"


@query("F1 F2 F3 F4", f"SELECT p_partkey, {NORM.format('p_type')} AS normalized, trim(regexp_replace(lower(p_brand), '[^a-z0-9]+', '_', 'g'), '_') AS safe, replace(replace(replace(p_name, ' ', '_'), '_and_', ' / '), '_', ' ') AS human, array_to_string(list_filter(string_split({NORM.format('p_name')}, ' '), lambda t: t <> 'and'), ' ') AS tokens FROM part")
def text_normalize(spark, sf):
    return load(spark, sf, "part").select("p_partkey", X.normalized_ascii("p_type").alias("normalized"), X.safe_label("p_brand").alias("safe"), X.human_label(F.translate("p_name", " ", "_")).alias("human"), X.name_tokens("p_name").alias("tokens"))


@query("F5 F6", "SELECT n_nationkey, CASE WHEN n_nationkey BETWEEN 1 AND 10 THEN ['first', 'second', 'third', 'fourth', 'fifth', 'sixth', 'seventh', 'eighth', 'ninth', 'tenth'][n_nationkey] ELSE n_nationkey::VARCHAR END AS word, CASE WHEN n_nationkey BETWEEN 1 AND 10 THEN n_nationkey ELSE n_nationkey END::BIGINT AS number FROM nation")
def ordinal_words(spark, sf):
    n = load(spark, sf, "nation").withColumn("word", X.ordinal_word("n_nationkey"))
    asked = F.when(F.col("n_nationkey").between(1, 10), F.concat(F.lit("after the "), "word", F.lit(" bell"))).otherwise(F.concat(F.lit("after the "), "word", F.lit("th bell")))
    return n.select("n_nationkey", "word", X.ordinal_number(asked).cast("bigint").alias("number"))


@query("F7 F8 P22", "SELECT doc_id, array_to_string(list_transform(list_sort(list_filter([CASE WHEN contains(t, ' the ') THEN {'a': instr(t, ' the '), 'l': 'THE'} END, CASE WHEN contains(t, ' was ') THEN {'a': instr(t, ' was '), 'l': 'WAS'} END, CASE WHEN contains(t, ' und ') THEN {'a': instr(t, ' und '), 'l': 'UND'} END], lambda v: v IS NOT NULL)), lambda v: v.l), ',') AS labels, contains(t, ' not ') OR contains(t, ' are ') AS cue FROM (SELECT doc_id, ' ' || " + NORM.format("text") + " || ' ' t FROM documents)")
def label_mentions(spark, sf):
    d = load(spark, sf, "documents")
    return d.select("doc_id", F.array_join(X.mentions("text", {"the": "THE", "was": "WAS", "und": "UND"}), ",").alias("labels"), X.contains_phrase("text", ["not", "are"]).alias("cue"))


@query("F11 F12 F13 F26", "SELECT page_id, trim(regexp_replace(lower(url), '[^a-z0-9]+', ' ', 'g')) AS caption, 'creator_' || sha256('creator:' || url) AS creator, trim(regexp_replace(replace(lower(html), 'ß', 'ss'), '\\s+', ' ', 'g')) AS question, regexp_replace(url, '_[^_]*$', '') AS parent FROM pages")
def text_keys(spark, sf):
    return load(spark, sf, "pages").select("page_id", X.caption("url").alias("caption"), X.domain_key("creator_", "creator:", "url").alias("creator"), X.question("html").alias("question"), X.parent_id("url").alias("parent"))


@query("F14 DD9", """SELECT n_nationkey, sha256('{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || ',"n_regionkey":' || n_regionkey || '}') AS fingerprint FROM nation""")
def canonical_fingerprint(spark, sf):
    return load(spark, sf, "nation").select("n_nationkey", X.canonical_hash("n_nationkey", "n_name", "n_regionkey").alias("fingerprint"))


@query("F14 DD9", """SELECT sha256('[' || string_agg('{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '"}', ',' ORDER BY n_nationkey) || ']') AS fingerprint FROM nation""")
def manifest_fingerprint(spark, sf):
    n = load(spark, sf, "nation")
    return n.agg(F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name")))), 256).alias("fingerprint"))


@query("F15 F21", "SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda t: length(t))), 0)::BIGINT AS n_letters, (('0x' || substr(sha256(doc_id::VARCHAR), 1, 16))::UBIGINT % 97)::BIGINT AS bucket FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') w FROM documents)")
def tokenize_and_bucket(spark, sf):
    from tidemark.operators.resampling import hash_number

    d = load(spark, sf, "documents").withColumn("w", X.words("text"))
    return d.select("doc_id", F.size("w").cast("bigint").alias("n_words"), F.aggregate("w", F.lit(0).cast("bigint"), lambda a, t: a + F.char_length(t)).alias("n_letters"), (hash_number(F.col("doc_id").cast("string")) % 97).cast("bigint").alias("bucket"))


@query("F17 F18 M22", "SELECT vec_id, round(20 * log10(greatest(sqrt(list_sum(list_transform(e, lambda x: x * x)) / 64), 1e-12)), 4) AS rms_db, round(20 * log10(greatest(list_max(list_transform(e, lambda x: abs(x))), 1e-12)), 4) AS peak_db, round(list_sum(list_transform(e, lambda x: x * x)), 4) AS energy FROM (SELECT vec_id, embedding::DOUBLE[] e FROM embeddings)")
def vector_levels(spark, sf):
    v = load(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    return v.select("vec_id", F.round(V.rms_db("e"), 4).alias("rms_db"), F.round(V.peak_db("e"), 4).alias("peak_db"), F.round(V.dot("e", "e"), 4).alias("energy"))


SDR = "WITH v AS (SELECT a.vec_id, a.embedding::DOUBLE[] p, b.embedding::DOUBLE[] t FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1), c AS (SELECT vec_id, list_transform(p, lambda x: x - list_avg(p)) p, list_transform(t, lambda x: x - list_avg(t)) t FROM v), s AS (SELECT *, list_dot_product(p, t) / (list_dot_product(t, t) + 1e-8) a FROM c), n AS (SELECT *, list_sum([(p[i] - a * t[i]) * (p[i] - a * t[i]) FOR i IN range(1, 65)]) n1, list_sum([(p[i] - t[i]) * (p[i] - t[i]) FOR i IN range(1, 65)]) n2, a * a * list_dot_product(t, t) g FROM s) SELECT vec_id, round(10 * log10((g + 1e-8) / (n1 + 1e-8)), 4) AS si_sdr, round(10 * log10((g + 1e-8) / (n2 + 1e-8)), 4) AS sd_sdr FROM n"


@query("M1 M2", SDR)
def signal_ratios(spark, sf):
    v = load(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("p"))
    t = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("p").alias("t"))
    return v.join(t, "vec_id").select("vec_id", F.round(V.si_sdr("p", "t"), 4).alias("si_sdr"), F.round(V.sd_sdr("p", "t"), 4).alias("sd_sdr"))


@query("F19 F24 P3", "SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k, coalesce(nullif(json_extract_string(props, '$.name'), ''), nullif(event_type, ''), 'none') AS name, isfinite(value) AND value > 1 AS good FROM events")
def nested_fallback(spark, sf):
    e = load(spark, sf, "events")
    get = lambda p: F.get_json_object("props", p)
    finite = ~F.isnan("value") & (F.abs("value") != float("inf"))
    return e.select("event_id", get("$.k").cast("bigint").alias("k"), F.coalesce(F.nullif(get("$.name"), F.lit("")), F.nullif("event_type", F.lit("")), F.lit("none")).alias("name"), (finite & (F.col("value") > 1)).alias("good"))


@query("F20", "SELECT l_orderkey, l_linenumber, l_partkey, round_even(l_extendedprice / 100, 0) AS half_even, round(l_extendedprice / 100, 0) AS half_up FROM lineitem")
def rounding_rules(spark, sf):
    l = load(spark, sf, "lineitem")  # noqa: E741
    x = F.col("l_extendedprice") / 100
    return l.select("l_orderkey", "l_linenumber", "l_partkey", F.bround(x, 0).alias("half_even"), F.round(x, 0).alias("half_up"))


@query("F27", "WITH p AS (SELECT p_partkey, p_brand, (row_number() OVER (ORDER BY p_partkey) - 1) % 5 AS k FROM part) SELECT p_partkey, array_to_string(list_concat(list_concat(['a', 'b', 'c', 'd'][1:k], [p_brand]), ['a', 'b', 'c', 'd'][k + 1:4]), '|') AS options FROM p")
def answer_positions(spark, sf):
    from tidemark.operators.sequences import numbered

    d = F.array(*map(F.lit, "abcd"))
    p = numbered(load(spark, sf, "part").select("p_partkey", "p_brand"), "p_partkey").withColumn("k", (F.col("number") % 5).cast("int"))
    return p.select("p_partkey", F.array_join(F.concat(F.slice(d, F.lit(1), F.col("k")), F.array("p_brand"), F.slice(d, F.col("k") + 1, F.lit(4))), "|").alias("options"))


@query("F28", "SELECT c_custkey, round(least(1, greatest(0, c_acctbal / 10000)), 6) AS clamped, round(1 / (1 + exp(-c_acctbal / 1000)), 6) AS activation FROM customer")
def clamp_activation(spark, sf):
    x = F.col("c_acctbal")
    return load(spark, sf, "customer").select("c_custkey", F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), x / 10000)), 6).alias("clamped"), F.round(1 / (1 + F.exp(-x / 1000)), 6).alias("activation"))


@query("F29 O3", "SELECT user_id, first(event_id ORDER BY sha256('pick:' || event_id)) AS chosen FROM events GROUP BY 1")
def seeded_choice(spark, sf):
    return load(spark, sf, "events").groupBy("user_id").agg(F.min_by("event_id", F.sha2(F.concat(F.lit("pick:"), F.col("event_id").cast("string")), 256)).alias("chosen"))


@query("P1 P2 P18", "SELECT user_id, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS labels, count(*) AS n FROM events WHERE value > 10 AND event_type IN ('click', 'error', 'view') AND trim(event_type) <> '' GROUP BY 1")
def semantic_filter(spark, sf):
    nested = load(spark, sf, "events").groupBy("user_id").agg(F.collect_list(F.struct("event_type", "value")).alias("events"))
    kept = F.filter("events", lambda e: (e["value"] > 10) & e["event_type"].isin("click", "error", "view") & (F.trim(e["event_type"]) != ""))
    k = nested.withColumn("events", kept).where(F.size("events") > 0)
    return k.select("user_id", F.array_join(V.sorted_distinct(F.transform("events", lambda e: e["event_type"])), ",").alias("labels"), F.size("events").cast("bigint").alias("n"))


@query("P4", "SELECT event_id, len(json_keys(props)) = 1 AND json_keys(props)[1] = 'k' AS exact FROM events")
def exact_fields(spark, sf):
    keys = F.map_keys(F.from_json("props", "map<string,string>"))
    want = F.array(F.lit("k"))
    return load(spark, sf, "events").select("event_id", ((F.size(F.array_except(keys, want)) == 0) & (F.size(F.array_except(want, keys)) == 0)).alias("exact"))


@query("P8", "WITH o AS (SELECT user_id, event_type, ts, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) k FROM events) SELECT user_id, event_type, min(k) = 1 AND max(k) = count(*) AND count(DISTINCT k) = count(*) AS valid FROM o GROUP BY 1, 2")
def occurrence_check(spark, sf):
    k = F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id"))
    return load(spark, sf, "events").withColumn("k", k).groupBy("user_id", "event_type").agg(((F.min("k") == 1) & (F.max("k") == F.count("*")) & (F.count_distinct("k") == F.count("*"))).alias("valid"))


@query("P9", """SELECT event_id, sha256('{"event_id":' || event_id || ',"event_type":"' || event_type || '"}') AS binding FROM events""")
def label_free_projection(spark, sf):
    return load(spark, sf, "events").select("event_id", X.canonical_hash("event_id", "event_type").alias("binding"))


@query("P12 P13", "SELECT p_partkey, g AS failed, CASE WHEN g = '' THEN 'gold' WHEN s = '' AND p_size <= 40 THEN 'silver' ELSE 'rejected' END AS level FROM (SELECT p_partkey, p_size, array_to_string(list_filter([CASE WHEN p_retailprice < 1200 THEN 'price' END, CASE WHEN p_size > 20 THEN 'size' END], lambda v: v IS NOT NULL), ',') g, CASE WHEN p_retailprice < 1000 THEN 'price' ELSE '' END s FROM part)")
def quality_gates(spark, sf):
    failed = F.array_join(F.array_compact(F.array(F.when(F.col("p_retailprice") < 1200, F.lit("price")), F.when(F.col("p_size") > 20, F.lit("size")))), ",")
    p = load(spark, sf, "part").withColumns({"failed": failed, "s": F.when(F.col("p_retailprice") < 1000, "price").otherwise("")})
    return p.select("p_partkey", "failed", F.when(F.col("failed") == "", "gold").when((F.col("s") == "") & (F.col("p_size") <= 40), "silver").otherwise("rejected").alias("level"))


CONDITIONS = {"gold": [("price", "p_retailprice", ">=", 1200.0), ("size", "p_size", "<=", 20.0)], "silver": [("price", "p_retailprice", ">", 1000.0), ("size", "p_size", "<=", 40.0)]}


@query("P15 P16", " UNION ALL ".join(f"SELECT p_partkey, '{gate}' AS gate, '{code}' AS code, {column}::DOUBLE AS value, '{op}' AS operator, {limit} AS threshold FROM part WHERE NOT {column} {op} {limit}" for gate, rows in CONDITIONS.items() for code, column, op, limit in rows))
def rejection_details(spark, sf):
    from tidemark.operators.audits import failed_conditions

    return failed_conditions(load(spark, sf, "part"), "p_partkey", CONDITIONS)


@query("P20", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'claims.best_oracle' WHEN 1 THEN 'scores[].SI-SDR,scores[].old.sdr' ELSE '' END AS paths FROM events")
def prohibited_fields(spark, sf):
    """Payloads of the events, half of them with fields that may not be there."""
    from tidemark.functions.text import prohibited_paths

    n, v = F.col("event_id") % 4, F.col("value").cast("string")
    payload = F.when(n == 0, F.concat(F.lit('{"claims": {"best_oracle": '), v, F.lit(', "fine": 1}}')))
    payload = payload.when(n == 1, F.concat(F.lit('{"scores": [{"at": 1}, {"SI-SDR": '), v, F.lit(', "old": {"sdr": null}}]}'))).when(n == 2, F.concat(F.lit('{"note": "oracle", "k": '), v, F.lit("}"))).otherwise(F.col("props"))
    return load(spark, sf, "events").select("event_id", F.array_join(prohibited_paths(payload), ",").alias("paths"))


INTENTS = ", ".join(f"'{i}'" for i in X.INTENTS)
SAID = "s AS (SELECT event_id, event_type l, CASE event_id % 5 WHEN 0 THEN ' After ' WHEN 1 THEN 'dance' WHEN 2 THEN 'speech_after_quote' WHEN 3 THEN 'speaker_count' ELSE 'before' END i, (event_id % 4 - 1)::VARCHAR || CASE WHEN event_id % 7 = 0 THEN 'x' ELSE '' END o, CASE event_id % 3 WHEN 0 THEN 'Female' WHEN 1 THEN 'robot' ELSE '' END w, (event_id % 30 - 5) / 10.0 c FROM events)"


@query("T19", f"""WITH {SAID} SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'unsupported' WHEN lower(trim(i)) IN ({INTENTS}) THEN lower(trim(i)) ELSE 'unsupported' END AS intent,
CASE WHEN event_id % 11 = 0 OR l NOT IN ('click', 'error') THEN '' ELSE upper(l) END AS labels, CASE WHEN event_id % 11 = 0 THEN '' ELSE greatest(1, coalesce(try_cast(o AS INTEGER), 1))::VARCHAR END AS ordinals,
CASE WHEN event_id % 11 = 0 THEN NULL WHEN i = 'speaker_count' OR w = 'robot' THEN 'any' ELSE nullif(lower(w), '') END AS speaker, CASE WHEN event_id % 11 <> 0 AND i = 'speech_after_quote' THEN l || ' now' END AS quote, CASE WHEN event_id % 11 = 0 THEN 0.0 ELSE least(1, greatest(0, c)) END::DOUBLE AS confidence FROM s""")
def question_programs(spark, sf):
    e, n = load(spark, sf, "events"), F.col("event_id")
    intent = F.element_at(F.array(*map(F.lit, [" After ", "dance", "speech_after_quote", "speaker_count", "before"])), (n % 5 + 1).cast("int"))
    ordinal = F.concat((n % 4 - 1).cast("string"), F.when(n % 7 == 0, "x").otherwise(""))
    who = F.element_at(F.array(*map(F.lit, ["Female", "robot", ""])), (n % 3 + 1).cast("int"))
    body = F.to_json(F.struct(intent.alias("intent"), F.array(F.col("event_type"), F.concat("event_type", F.lit("  "))).alias("labels"), F.array(ordinal).alias("ordinals"), who.alias("speaker"), F.concat(F.lit(" "), "event_type", F.lit(" now ")).alias("quote"), ((n % 30 - 5) / 10.0).cast("double").alias("confidence")))
    p = e.select("event_id", X.normalized_program(F.when(n % 11 == 0, "sorry, no").otherwise(body), {"click": "CLICK", "error": "ERROR"}).alias("p"))
    return p.select("event_id", "p.intent", F.array_join("p.labels", ",").alias("labels"), F.array_join("p.ordinals", ",").alias("ordinals"), "p.speaker", "p.quote", "p.confidence")


@query("P17", "WITH m AS (SELECT user_id, event_type, max(value) p FROM events GROUP BY 1, 2), r AS (SELECT *, rank() OVER (PARTITION BY user_id ORDER BY p DESC) k FROM m) SELECT e.event_id FROM events e JOIN r ON r.user_id = e.user_id AND r.event_type = e.event_type WHERE (k <= 2 OR p >= 480 OR e.event_type = 'error') AND (value >= 100 OR e.event_type = 'error')")
def inventory_filter(spark, sf):
    e = load(spark, sf, "events")
    m = e.groupBy("user_id", "event_type").agg(F.max("value").alias("p")).withColumn("k", F.rank().over(Window.partitionBy("user_id").orderBy(F.desc("p"))))
    forced = F.col("event_type") == "error"
    return e.join(m, ["user_id", "event_type"]).where(((F.col("k") <= 2) | (F.col("p") >= 480) | forced) & ((F.col("value") >= 100) | forced)).select("event_id")


@query("P19", "SELECT s_suppkey, CASE s_nationkey % 4 WHEN 0 THEN 'train' WHEN 1 THEN 'train' WHEN 2 THEN 'dev' ELSE 'test' END AS split FROM supplier WHERE s_suppkey >= 0 AND s_nationkey IS NOT NULL")
def split_aliases(spark, sf):
    alias = F.create_map(*[F.lit(x) for kv in {"0": "train", "1": "train", "2": "dev", "3": "test"}.items() for x in kv])
    return load(spark, sf, "supplier").where("s_suppkey >= 0 AND s_nationkey IS NOT NULL").select("s_suppkey", F.element_at(alias, (F.col("s_nationkey") % 4).cast("string")).alias("split"))


@query("P21", "WITH s AS (SELECT o_custkey, list(DISTINCT o_orderkey % 5) e, [o_custkey % 5] a, [(o_custkey + 1) % 5] b FROM orders GROUP BY o_custkey) SELECT o_custkey, CASE WHEN len(list_intersect(e, a)) = 0 AND len(list_intersect(e, b)) = 0 THEN 'neither' WHEN len(list_intersect(e, a)) = 0 THEN 'answer_only' WHEN len(list_intersect(e, b)) = 0 THEN 'anchor_only' WHEN len(e) = 2 THEN 'exact' ELSE 'extra' END AS status FROM s")
def evidence_policy(spark, sf):
    s = load(spark, sf, "orders").groupBy("o_custkey").agg(F.collect_set(F.col("o_orderkey") % 5).alias("e"))
    has = lambda i: F.array_contains("e", (F.col("o_custkey") + i) % 5)
    return s.select("o_custkey", F.when(~has(0) & ~has(1), "neither").when(~has(0), "answer_only").when(~has(1), "anchor_only").when(F.size("e") == 2, "exact").otherwise("extra").alias("status"))


@query("F1", None)
def unicode_normalize(spark, sf):
    return load(spark, sf, "documents").select("doc_id", X.normalize_udf("text").alias("normalized"))


@query("F10", "SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events")
def json_recovery(spark, sf):
    found = X.first_json_udf(F.concat(F.lit("reply: {oops "), "props", F.lit(" thanks")))
    return load(spark, sf, "events").select("event_id", F.get_json_object(found, "$.k").cast("bigint").alias("k"))


@query("S2", "SELECT event_id, CASE event_id % 5 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN NULL ELSE false END AS duplicated FROM events")
def duplicate_json_keys(spark, sf):
    """Properties as they are, with a key twice, with one twice below, and broken off."""
    n = F.col("event_id") % 5
    text = F.when(n == 0, F.concat(F.lit('{"k": 0, '), F.substring("props", 2, 1000))).when(n == 1, F.concat(F.lit('{"in": [{"a": 1, "a": '), "props", F.lit("}]}"))).when(n == 2, F.concat("props", F.lit("{"))).otherwise(F.col("props"))
    return load(spark, sf, "events").select("event_id", X.has_duplicate_keys_udf(text).alias("duplicated"))


@query("F10", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_type END AS relation, CASE WHEN event_id % 3 <> 0 AND event_id % 2 = 0 THEN 'a ' || user_id END AS anchor, CASE WHEN event_id % 3 <> 0 THEN event_id % 9 END AS ordinal, CASE WHEN event_id % 3 = 0 THEN 'missing_relation' ELSE 'partial' END AS outcome FROM events")
def partial_fields(spark, sf):
    """Fields of objects that break off before their end."""
    n = F.col("event_id")
    head = F.when(n % 3 == 0, F.lit('{"other": 1')).otherwise(F.concat(F.lit('{"relation" : "'), "event_type", F.lit('"')))
    anchor = F.when(n % 2 == 0, F.concat(F.lit(', "anchor_label": "a '), F.col("user_id").cast("string"), F.lit('"'))).otherwise(F.lit(', "anchor_label": null'))
    text = F.concat(F.lit("so: "), head, anchor, F.lit(', "anchor_ordinal": '), (n % 9).cast("string"), F.lit(', "candidate_labels": ["x", '))
    f = X.recovered_fields(text)
    return load(spark, sf, "events").select("event_id", f["relation"].alias("relation"), f["anchor_label"].alias("anchor"), f["anchor_ordinal"].cast("bigint").alias("ordinal"), f["outcome"].alias("outcome"))
