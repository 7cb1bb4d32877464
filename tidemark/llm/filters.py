"""Interaction of filters by inclusion-exclusion.

Five filters each fail some documents. For every set of filters the documents
that fail all of them are counted, as sums of products of failure flags, with the
same sums over good and toxic documents: 32 joint-failure counts each, whose
Möbius transforms give everything else. With g(T) the documents that fail all of T:

* survivors of a set S: sum over T within S of (-1)^|T| g(T);
* failures of exactly S: sum over T around S of (-1)^|T - S| g(T);
* Harsanyi dividend of S in the game "documents removed by S": (-1)^(|S| + 1) g(S),
  and a filter's Shapley value is the sum of its sets' dividends, each divided by
  the set's size. Over all 120 orders that makes 120 / |S| of each dividend.

Only expressions: conditions and digests are computed in the scan, so texts never
meet a shuffle. Rows are summed up by (text digest, part, labels) before they
move, so copies that hold a third of the table arrive as a few rows.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import table

FILTERS = "ABCDE"
FULL = (1 << len(FILTERS)) - 1
#: The same sums over all documents, over those with label quality 1, and over those with label toxic 1.
WEIGHTS = ("all", "good", "toxic")
SPACE = "[\\t-\\r ]+"

#: White space at either end of a text, which separates no words.
_EDGES = " \t\n\x0b\x0c\r"


def conditions(text: Column) -> dict[str, Column]:
    """Failure flags A to D of a text; the words are those of the column ``_words`` (see ``flagged``)."""
    n = F.size("_words") - F.col("_none").cast("int")
    distinct = F.size(F.array_distinct("_words")) - F.col("_none").cast("int")
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {"A": n < 200, "B": 100 * distinct < 50 * n, "C": 100 * capitals > 3 * F.length(text), "D": text.rlike("[#$%&*|]")}


def flagged(docs: DataFrame) -> DataFrame:
    """(doc_id, part, digest, A, B, C, D) of each document; flags are 0 or 1."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), text.alias("_text"))
    bare = F.trim(F.col("_text"), F.lit(_EDGES))
    rows = rows.withColumns({"_words": F.split(bare, SPACE), "_none": bare == ""})
    return rows.select("doc_id", "part", F.unhex(F.sha2(F.col("_text").cast("binary"), 256)).alias("digest"), *[c.cast("bigint").alias(name) for name, c in conditions(F.col("_text")).items()])


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Distinct (doc_id, part, digest, A-D) with their number of rows n and the labels good and toxic (0 or 1)."""
    rows = docs.groupBy("doc_id", "part", "digest", *"ABCD").agg(F.count("*").alias("n"))
    of = labels.where("doc_id is not null").groupBy("doc_id").agg(*[F.coalesce(F.max((F.col(c) == 1).cast("bigint")), F.lit(0)).alias(name) for c, name in (("quality", "good"), ("toxic", "toxic"))])
    known = rows.where("doc_id is not null").join(of, "doc_id", "left").select(*rows.columns, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("good", "toxic")])
    return known.union(rows.where("doc_id is null").select("*", F.lit(0).cast("bigint"), F.lit(0).cast("bigint")))  # null ids don't meet in the join


def copies(rows: DataFrame) -> DataFrame:
    """(part, A-D, good, toxic, n, e): rows summed up by text, e of the n have a copy with a smaller doc_id."""
    some = rows.groupBy("digest", "part", *"ABCD", "good", "toxic").agg(F.sum("n").alias("n"), F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("first"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("nameless"))
    least = F.min("first.doc_id").over(Window.partitionBy("digest"))  # a text has a row per part and labels here, not per document
    unique = F.when(F.col("first.doc_id") == least, F.col("first.n")).otherwise(0) + F.col("nameless")
    return some.select("part", *"ABCD", "good", "toxic", "n", (F.col("n") - unique).alias("e"))


def joint_failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part: arrays all, good and toxic of 32 counts, at place S of documents that fail all filters of the bit set S.

    Null texts are empty and equal to empty ones; a null lang and an empty one are
    the part ''. Repeated rows count each; rows of equal id and text are no copies
    of each other, and a null id is neither smaller nor larger than another. A
    document is good or toxic if any label row of its id says so; null labels and
    labels of unknown ids don't count. An empty table gives no parts; further
    columns are ignored.
    """
    rows = copies(labelled(flagged(docs), labels))
    sums = []
    for s in range(FULL + 1):
        product = F.col("e") if s >> 4 & 1 else F.col("n")
        for k, name in enumerate("ABCD"):
            if s >> k & 1:
                product = product * F.col(name)
        sums += [F.sum(product if w == "all" else product * F.col(w)).alias(f"{w}{s}") for w in WEIGHTS]
    return rows.groupBy("part").agg(*sums).select("part", *[F.array(*[f"{w}{s}" for s in range(FULL + 1)]).alias(w) for w in WEIGHTS])


def _signed(sign: Column, x: Column) -> Column:
    """x, or -x where the number ``sign`` is odd."""
    return F.when(sign % 2 == 0, x).otherwise(-x)


def _over_sets(g: Column, term: Callable[[Column, Column], Column]) -> Column:
    """Array over all bit sets s of the sum of term(s, t) over all bit sets t."""
    sets = F.sequence(F.lit(0), F.lit(FULL))
    return F.transform(sets, lambda s: F.aggregate(sets, F.lit(0).cast("bigint"), lambda a, t: a + term(s, t)))


def survivors(g: Column) -> Column:
    """For each bit set how many pass all its filters."""
    return _over_sets(g, lambda s, t: F.when(t.bitwiseAND(F.bitwise_not(s)) == 0, _signed(F.bit_count(t), g[t])).otherwise(0))


def exactly(g: Column) -> Column:
    """For each bit set how many fail its filters and no other."""
    return _over_sets(g, lambda s, t: F.when(s.bitwiseAND(F.bitwise_not(t)) == 0, _signed(F.bit_count(t) - F.bit_count(s), g[t])).otherwise(0))


def shapley(g: Column) -> Column:
    """For each bit set of one filter the documents it removes, summed over all orders: dividends of the sets around it by size."""
    return _over_sets(g, lambda s, t: F.when((s > 0) & (s.bitwiseAND(F.bitwise_not(t)) == 0), _signed(F.bit_count(t) + 1, g[t]) * F.floor(F.lit(120) / F.bit_count(t))).otherwise(0))


def audit(joint: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley): every order and step of each part of ``joint_failures``."""
    after = [survivors(F.col(w)).alias(f"_{w}") for w in WEIGHTS]
    k_of = [F.col("all").alias("_fails"), exactly(F.col("all")).alias("_unique"), shapley(F.col("all")).alias("_shapley")]
    orders = F.split(F.lit(",".join(map("".join, permutations(FILTERS)))), ",")
    rows = joint.select("part", *after, *k_of, F.explode(orders).alias("filter_order"))
    bits = F.transform(F.split("filter_order", ""), lambda c: F.pow(F.lit(2), F.instr(F.lit(FILTERS), c) - 1).cast("int"))
    rows = rows.select("*", bits.alias("_bits"), F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    rows = rows.withColumn("_before", F.aggregate(F.slice("_bits", 1, F.col("step") - 1), F.lit(0), lambda a, b: a + b))
    rows = rows.withColumns({"_now": F.col("_before") + F.col("_bits")[F.col("step") - 1], "_k": F.col("_bits")[F.col("step") - 1]})
    lost = {w: F.col(f"_{w}")[F.col("_before")] - F.col(f"_{w}")[F.col("_now")] for w in WEIGHTS}
    of = {name: F.col(f"_{name}")[F.col("_k")] for name in ("fails", "unique", "shapley")}
    return rows.select("part", "filter_order", "step", F.col("_all")[F.col("_now")].alias("kept"), lost["all"].alias("removed"), (of["fails"] - lost["all"]).alias("redundant"), of["unique"].alias("unique_fails"), lost["good"].alias("good_lost"), lost["toxic"].alias("toxic_lost"), of["shapley"].alias("shapley"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of all documents; rules as in ``joint_failures``."""
    return audit(joint_failures(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


#: Applies every order step by step, without inclusion-exclusion.
ORACLE_SQL = r"""
WITH docs AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
least_id AS (SELECT t, min(doc_id) AS first_id FROM docs GROUP BY t),
marks AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
cells AS (
  SELECT part, len(w) < 200 AS a, 100 * len(list_distinct(w)) < 50 * len(w) AS b, 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) AS c,
    regexp_matches(t, '[#$%&*|]') AS d, coalesce(first_id < docs.doc_id, false) AS e, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, count(*) AS n
  FROM docs JOIN least_id USING (t) LEFT JOIN marks ON docs.doc_id = marks.doc_id GROUP BY ALL),
letters(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
orders AS (
  SELECT p.x || q.x || r.x || s.x || u.x AS o FROM letters p, letters q, letters r, letters s, letters u
  WHERE len(list_distinct([p.x, q.x, r.x, s.x, u.x])) = 5),
fell AS (
  SELECT *, least(if(a, strpos(o, 'A'), 9), if(b, strpos(o, 'B'), 9), if(c, strpos(o, 'C'), 9), if(d, strpos(o, 'D'), 9), if(e, strpos(o, 'E'), 9)) AS place, a::int + b::int + c::int + d::int + e::int AS fails
  FROM cells, orders),
steps AS (
  SELECT *, substr(o, step, 1) AS letter, CASE substr(o, step, 1) WHEN 'A' THEN a WHEN 'B' THEN b WHEN 'C' THEN c WHEN 'D' THEN d ELSE e END AS failing
  FROM fell, (SELECT unnest(range(1, 6))::int AS step)),
counted AS (
  SELECT part, o AS filter_order, step, letter, sum(if(place > step, n, 0))::bigint AS kept, sum(if(place = step, n, 0))::bigint AS removed, sum(if(failing AND place < step, n, 0))::bigint AS redundant,
    sum(if(failing AND fails = 1, n, 0))::bigint AS unique_fails, sum(if(place = step AND good, n, 0))::bigint AS good_lost, sum(if(place = step AND toxic, n, 0))::bigint AS toxic_lost
  FROM steps GROUP BY part, o, step, letter)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) OVER (PARTITION BY part, letter)::bigint AS shapley FROM counted
"""
