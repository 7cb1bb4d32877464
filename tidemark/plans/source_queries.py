"""Sources and sinks by round trips through the shared folder, and the remaining operators."""

from __future__ import annotations

import io
import uuid
import zipfile

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from tidemark.operators import proposals as Q
from tidemark.plans.registry import TL, load, query, timeline
from tidemark.session import work_dir
from tidemark.sources import readers, writers

NATION = "SELECT n_nationkey, n_name, n_regionkey FROM nation"


def place(spark, name):
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("S1 S2 S19", NATION)
def jsonl_round_trip(spark, sf):
    at = place(spark, "jsonl")
    writers.write_jsonl(load(spark, sf, "nation"), at)
    schema = "n_nationkey int, n_name string, n_regionkey int"
    lenient, strict = readers.read_jsonl(spark, at, schema), readers.read_jsonl_strict(spark, at, schema)
    return strict.intersect(lenient)


@query("S3 S6 S16 S23", NATION)
def table_round_trip(spark, sf):
    at = place(spark, "tsv")
    writers.write_table(load(spark, sf, "nation"), at)
    schema = StructType([StructField("n_nationkey", IntegerType()), StructField("n_name", StringType()), StructField("n_regionkey", IntegerType())])
    return readers.unique(readers.read_csv_exact(spark, at, schema, "\t"), "n_nationkey")


@query("S4", "SELECT 'R' || n_regionkey AS mid, r_name AS display, n_nationkey / 1.0 AS onset, 'train' AS split FROM nation JOIN region ON r_regionkey = n_regionkey WHERE n_nationkey > 2")
def strong_labels(spark, sf):
    a, b = place(spark, "classes"), place(spark, "strong")
    load(spark, sf, "region").select(F.concat(F.lit("R"), F.col("r_regionkey").cast("string")).alias("mid"), F.col("r_name").alias("display")).write.option("header", True).csv(a)
    load(spark, sf, "nation").select(F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("mid"), F.col("n_nationkey").cast("double").alias("onset"), (F.col("n_nationkey") * 2 - 2.5).alias("off")).write.option("header", True).csv(b)
    return readers.read_strong_labels(spark, a, {"train": b}).select("mid", "display", "onset", "split")


@query("S5", "WITH RECURSIVE t AS (SELECT 'R' || n_regionkey p, 'N' || n_nationkey c FROM nation UNION ALL SELECT 'ALL', 'R' || r_regionkey FROM region), q AS (SELECT p, c, 1 d FROM t UNION ALL SELECT q.p, t.c, d + 1 FROM q JOIN t ON t.p = q.c) SELECT p AS parent, c AS child, d AS depth FROM q")
def ontology_json(spark, sf):
    at = place(spark, "ontology")
    n = load(spark, sf, "nation").groupBy(F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("id")).agg(F.collect_list(F.concat(F.lit("N"), F.col("n_nationkey").cast("string"))).alias("child_ids"))
    r = load(spark, sf, "region").agg(F.collect_list(F.concat(F.lit("R"), F.col("r_regionkey").cast("string"))).alias("child_ids")).select(F.lit("ALL").alias("id"), "child_ids")
    n.unionByName(r).agg(F.to_json(F.collect_list(F.struct("id", "child_ids")))).write.text(at)  # one array, as ontology files are
    return readers.read_hierarchy(spark, at)


@query("S15", "SELECT s_suppkey AS id, CASE WHEN s_suppkey % 4 = 0 THEN 'dev' ELSE 'train' END AS split FROM supplier")
def list_files(spark, sf):
    at = place(spark, "lists")
    split = F.when(F.col("s_suppkey") % 4 == 0, "dev").otherwise("train")
    load(spark, sf, "supplier").select(F.concat(split, F.lit("/sound/"), F.col("s_suppkey").cast("string"), F.lit(".wav"))).write.text(at)
    return readers.read_list(spark, at).select("id", "split")


@query("S14", "SELECT n_regionkey || '.zip' AS archive, n_nationkey || '.txt' AS member, length(n_name)::BIGINT AS size, n_name AS content FROM nation")
def zip_members(spark, sf):
    """An archive per region, made where its rows are; members are checked against sizes and checksums of the rows."""
    import pandas as pd

    def packed(key, rows):
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w") as z:
            for k, name in sorted(zip(rows.n_nationkey, rows.n_name)):
                z.writestr(f"{k}.txt", name)
        return pd.DataFrame({"path": [f"{key[0]}.zip"], "content": [buffer.getvalue()]})

    n = load(spark, sf, "nation")
    archives = n.groupBy("n_regionkey").applyInPandas(packed, "path string, content binary")
    expected = n.select(F.concat(F.col("n_nationkey").cast("string"), F.lit(".txt")).alias("member"), F.length("n_name").cast("bigint").alias("size"), F.crc32(F.col("n_name").cast("binary")).alias("crc"))
    return readers.checked_members(readers.zip_members(archives), expected).select("archive", "member", "size", F.col("content").cast("string").alias("content"))


@query("S17", "WITH m AS (SELECT o_custkey % 50 v, o_orderstatus s, o_orderpriority r, o_orderkey k, o_orderkey % 3 = 0 e FROM orders) SELECT s AS split, v AS video, array_to_string(list_sort(list(DISTINCT r)), ',') AS routes, first('p' || lpad(k::VARCHAR, 9, '0') ORDER BY NOT e, k) AS path FROM m GROUP BY 1, 2")
def manifest_merge(spark, sf):
    o = load(spark, sf, "orders").select(F.col("o_orderstatus").alias("split"), (F.col("o_custkey") % 50).alias("video"), F.col("o_orderpriority").alias("route"), F.lit("h").alias("sha256"), F.concat(F.lit("p"), F.lpad(F.col("o_orderkey").cast("string"), 9, "0")).alias("path"), (F.col("o_orderkey") % 3 == 0).alias("path_exists"))
    return readers.merged_manifests(o).select("split", "video", F.array_join("routes", ",").alias("routes"), "path")


@query("S10 S20 S21 S22 S25 ST2", "SELECT count(*) AS n, sum(vec_id)::BIGINT AS ids, true AS files_bounded, false AS second_commit FROM embeddings")
def shard_commit(spark, sf):
    at = place(spark, "shards")
    e = load(spark, sf, "embeddings")
    writers.write_shards(e, at, 100)
    shards = spark.read.parquet(f"{at}/*.parquet")
    most = shards.groupBy(F.col("_metadata.file_path")).agg(F.count("*").alias("n")).agg((F.max("n") <= 100).alias("b"))
    frag = place(spark, "fragment")
    writers.commit_fragment(shards, frag)
    again = writers.commit_fragment(shards, frag)
    return shards.agg(F.count("*").alias("n"), F.sum("vec_id").alias("ids")).select("n", "ids", F.lit(most.first().b).alias("files_bounded"), F.lit(again).alias("second_commit"))


@query("S24", r"""SELECT '| n_nationkey | n_name |' || chr(10) || '|---|---|' || chr(10) || string_agg('| ' || n_nationkey || ' | ' || n_name || ' |', chr(10) ORDER BY n_nationkey) AS markdown,
'\begin{tabular}{ll}' || chr(10) || 'n\_nationkey & n\_name \\' || chr(10) || string_agg(n_nationkey || ' & ' || replace(n_name, '_', '\_') || ' \\', chr(10) ORDER BY n_nationkey) || chr(10) || '\end{tabular}' AS latex FROM nation""")
def report_tables(spark, sf):
    n = load(spark, sf, "nation").select("n_nationkey", "n_name").orderBy("n_nationkey")
    return spark.createDataFrame([(writers.markdown(n), writers.latex(n))], "markdown string, latex string")


@query("I23", f"""WITH {TL}, d AS (SELECT scene, floor(onset / 86400) dy, label, onset - floor(onset / 86400) * 86400 onset, off - floor(onset / 86400) * 86400 off FROM tl), s AS (SELECT DISTINCT scene, dy, onset st FROM d),
v AS (SELECT s.scene, s.dy, s.st, count(DISTINCT label) l, count(*) n FROM s JOIN d ON d.scene = s.scene AND d.dy = s.dy AND greatest(0, least(d.off, st + 7200) - greatest(d.onset, st)) >= 0.5 GROUP BY 1, 2, 3)
SELECT scene, dy::BIGINT AS day, round(st, 3) AS start, l AS labels, n AS events FROM (SELECT *, row_number() OVER (PARTITION BY scene, dy ORDER BY l DESC, n DESC, st) r FROM v) WHERE r = 1""")
def best_crop(spark, sf):
    day = F.floor(F.col("onset") / 86400)
    t = timeline(spark, sf).withColumn("day", day).withColumns({"onset": F.col("onset") - F.col("day") * 86400, "off": F.col("off") - F.col("day") * 86400})
    return Q.best_crop(t, ["scene", "day"], 7200.0).select("scene", "day", F.round("start", 3).alias("start"), "labels", "events")


@query("I26", "WITH v AS (SELECT vec_id, list_transform((embedding::DOUBLE[])[1:64], lambda x: abs(x)) e FROM embeddings), t AS (SELECT *, greatest(1e-4, list_max(e) * power(10, -1.5)) h FROM v), m AS (SELECT vec_id, list_transform(e, lambda x: x >= h) a FROM t) SELECT vec_id AS key, round(greatest(0, (list_position(a, true) - 1) / 10 - 0.02), 6) AS onset, round(least(6.4, (len(a) - list_position(list_reverse(a), true) + 1) / 10 + 0.02), 6) AS off FROM m")
def audible_trim(spark, sf):
    e = load(spark, sf, "embeddings").select(F.col("vec_id").alias("key"), F.col("embedding").alias("wave"), F.lit(0.0).alias("onset"), F.lit(6.4).alias("off"))
    return Q.audible_intervals(e, 10).select("key", F.round("onset", 6).alias("onset"), F.round("off", 6).alias("off"))


@query("I33", None)
def unique_starts(spark, sf):
    import pandas as pd

    from tidemark.operators.matching import unique_starts as shifted

    def run(key, p):
        p = p.sort_values(["frame", "event_id"])
        found = pd.array(shifted(p.frame.tolist(), [1] * len(p), 24 * 60), "Int64")
        return pd.DataFrame({"scene": key[0], "event_id": p.event_id, "start": found, "placed": ~found.isna()})

    t = timeline(spark, sf).select("scene", "event_id", (F.floor(F.col("onset") / 3600) % 24).alias("frame"))
    return t.groupBy("scene").applyInPandas(run, "scene bigint, event_id bigint, start bigint, placed boolean")


@query("W11", """WITH fr AS (SELECT user_id AS scene, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS frame, value / 500 AS p FROM events), o AS (SELECT *, frame - row_number() OVER (PARTITION BY scene ORDER BY frame) g FROM fr WHERE p >= 0.1), b AS (SELECT *, lag(p) OVER w lp, lead(p) OVER w np FROM o WINDOW w AS (PARTITION BY scene, g ORDER BY frame)),
k AS (SELECT scene, g, frame, lag(frame) OVER (PARTITION BY scene, g ORDER BY frame) pf FROM b WHERE p >= 0.2 AND (lp IS NULL OR p > lp) AND (np IS NULL OR p >= np)), c AS (SELECT scene, g, (pf + frame + 1) // 2 c FROM k WHERE pf IS NOT NULL UNION SELECT scene, g, min(frame) FROM o GROUP BY 1, 2), r AS (SELECT scene, g, max(frame) + 1 stop FROM o GROUP BY 1, 2)
SELECT c.scene, c AS start, coalesce(lead(c) OVER (PARTITION BY c.scene, c.g ORDER BY c), stop) AS stop FROM c JOIN r ON r.scene = c.scene AND r.g = c.g""")
def peak_split_decode(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts")
    d = load(spark, sf, "events").select(F.col("user_id").alias("scene"), F.row_number().over(w).cast("bigint").alias("frame"), (F.col("value") / 500).alias("p"))
    return Q.peak_split(d, ["scene"], 0.1, 0.2)


@query("J21", "WITH s AS (SELECT p_partkey % 40 sc, (p_partkey % 40) % 4 pa, list(DISTINCT split_part(p_type, ' ', 1)) own FROM part WHERE p_size < 4 GROUP BY 1, 2), q AS (SELECT pa, unnest(own) l FROM s GROUP BY 1, 2), c AS (SELECT sc, l FROM s JOIN (SELECT DISTINCT pa, l FROM q) q ON q.pa = s.pa WHERE len(list_filter(own, lambda o: o = l OR (length(l) >= 3 AND contains(o, l)) OR (length(o) >= 3 AND contains(l, o)))) = 0), r AS (SELECT *, row_number() OVER (PARTITION BY sc ORDER BY sha256('neg:' || sc || ':' || l)) n FROM c) SELECT s.sc AS scene, coalesce(string_agg(r.l, ',' ORDER BY n) FILTER (n <= 2), '') AS absent FROM s LEFT JOIN r ON r.sc = s.sc GROUP BY 1")
def absent_pools(spark, sf):
    p = load(spark, sf, "part").where("p_size < 4").select((F.col("p_partkey") % 40).alias("scene"), (F.col("p_partkey") % 40 % 4).alias("part"), F.split_part("p_type", F.lit(" "), F.lit(1)).alias("label"))
    return Q.absent_labels(p, "scene", "part", "label", "neg", 2).select("scene", F.array_join("absent", ",").alias("absent"))


@query("M18", "WITH s AS (SELECT o_custkey k, o_orderkey % 4 slot, max(o_totalprice / 500000) l, max((o_totalprice % 1000) / 1000) r FROM orders GROUP BY 1, 2), g AS (SELECT k, list(DISTINCT slot) FILTER (l >= 0.5) a, list(DISTINCT slot) FILTER (r >= 0.5) b FROM s GROUP BY 1) SELECT k AS custkey, coalesce(len(a), 0) > 0 AND coalesce(len(b), 0) > 0 AND len(list_distinct(list_concat(a, b))) > 1 AS resolved FROM g")
def pair_resolution(spark, sf):
    s = load(spark, sf, "orders").groupBy(F.col("o_custkey").alias("custkey"), (F.col("o_orderkey") % 4).alias("slot")).agg(F.max(F.col("o_totalprice") / 500000).alias("iou_left"), F.max(F.col("o_totalprice") % 1000 / 1000).alias("iou_right"))
    return Q.pair_resolution(s, ["custkey"])


#: Turns in ASCII as words between single spaces, with the places of two frequent words.
ASKED = r"""a AS (SELECT conv_id, turn, ' ' || trim(lower(regexp_replace(text, '[^A-Za-z0-9]+', ' ', 'g'))) || ' ' AS s FROM conversations WHERE regexp_full_match(text, '[\x00-\x7F]*') AND NOT contains(text, '&')),
p AS (SELECT *, list_sort(list_filter([{'place': strpos(s, ' the '), 'l': 'the'}, {'place': strpos(s, ' and '), 'l': 'and'}], lambda x: x.place > 0)) AS m FROM a)"""


@query("T18 F6", f"""WITH {ASKED} SELECT conv_id, turn, CASE WHEN len(m) >= 2 THEN 'first' WHEN len(m) = 1 AND contains(s, ' to ') THEN 'to' WHEN len(m) = 1 AND contains(s, ' of ') THEN 'of' END AS relation,
array_to_string(list_transform(m, lambda x: x.l), ',') AS labels FROM p""")
def parsed_turns(spark, sf):
    """Every turn in ASCII read as a question, with two frequent words as labels and two as cues."""
    import pandas as pd

    from tidemark.functions.text import parse_question

    def run(batches):
        for p in batches:
            found = [parse_question(t, ["the", "and"], ("to", "of")) for t in p.text]
            yield pd.DataFrame({"conv_id": p.conv_id, "turn": p.turn, "relation": [f[0] for f in found], "labels": [",".join(f[1]) for f in found]})

    asked = load(spark, sf, "conversations").where(F.col("text").rlike(r"\A[\x00-\x7F]*\z") & ~F.col("text").contains("&"))
    return asked.select("conv_id", "turn", "text").mapInPandas(run, "conv_id bigint, turn bigint, relation string, labels string")


@query("T18 F6 F9", "SELECT DISTINCT event_type, CASE WHEN event_type = 'purchase' THEN 'None|[]|1' ELSE 'after|[''' || event_type || ''']|2' END AS parsed, 'purchase' AS fuzzy FROM events")
def parsed_questions(spark, sf):
    from tidemark.functions.text import batched, parse_question, with_fuzzy_mentions

    asked = F.concat(F.lit("What came after the second "), "event_type", F.lit(" sound, roughly the purchse one?"))
    parse = batched(lambda q: "|".join(map(str, parse_question(q, ["click", "view", "error", "signup"]))), "string")
    kinds = load(spark, sf, "events").select("event_type").distinct().select("event_type", asked.alias("asked"))
    return with_fuzzy_mentions(kinds, "asked", {"purchase": "purchase"}).select("event_type", parse("asked").alias("parsed"), F.array_join("labels", ",").alias("fuzzy"))


@query("SP23 SP26", None)
def confusion_partition(spark, sf):
    labels = load(spark, sf, "embeddings").groupBy("label", (F.col("vec_id") % 10).alias("pred")).agg(F.count("*").alias("n")).collect()
    counts = np.zeros((10, 10))
    for r in labels:
        counts[r.label, r.pred] = r.n
    group = Q.confusion_groups(counts, 3)
    taken = Q.rebalanced_negatives({str(i): [str((i + j) % 5) for j in range(1 + i % 3)] for i in range(10)}, {str(i): 2 for i in range(5)})
    return spark.createDataFrame([(i, g, taken[str(i)]) for i, g in enumerate(group)], "label bigint, grp bigint, negative string")
