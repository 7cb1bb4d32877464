"""Joins with reasons, scopes and preferences. Interval joins are in ``intervals``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_reasons(left: DataFrame, right: DataFrame, key: str, checks: dict[str, Column] | None = None) -> DataFrame:
    """Full outer join; ``reason`` is null for a good pair, else the first defect that holds."""
    joined = left.withColumn("_l", F.lit(True)).join(right.withColumn("_r", F.lit(True)), key, "full_outer")
    reason = F.when(F.col("_r").isNull(), "unmatched_left").when(F.col("_l").isNull(), "unmatched_right")
    for name, bad in (checks or {}).items():
        reason = reason.when(bad, name)
    return joined.withColumn("reason", reason).drop("_l", "_r")


def joined_metadata(items: DataFrame, sources: dict[str, DataFrame], key: str, checks: dict[str, Column] | None = None) -> DataFrame:
    """``items`` with the columns of several metadata tables and ``reason``: the first table without the key, else the first defect, else null.

    A table in which a key repeats would multiply items, so the key then counts
    as ``repeated_<table>``.
    """
    out, reason = items, None
    for name, table in sources.items():
        n = Window.partitionBy(key)
        one = table.withColumns({f"_{name}": F.count("*").over(n), "_k": F.row_number().over(n.orderBy(*[c for c in table.columns if c != key]))}).where("_k = 1").drop("_k")
        out = out.join(one, key, "left")
        bad = [(F.col(f"_{name}").isNull(), f"missing_{name}"), (F.col(f"_{name}") > 1, f"repeated_{name}")]
        for when, text in bad:
            reason = reason.when(when, text) if reason is not None else F.when(when, text)
    for text, when in (checks or {}).items():
        reason = reason.when(when, text)
    return out.withColumn("reason", reason).drop(*[f"_{name}" for name in sources])


def allowed(df: DataFrame, allow: DataFrame, key: str, scope: str) -> DataFrame:
    """Rows whose key is allowed for their scope or for '*'."""
    a = allow.select(F.col(key).alias("_k"), F.col(scope).alias("_s"))
    exact = a.where("_s <> '*'")
    wild = a.where("_s = '*'").select("_k").distinct()
    by_scope = df.join(exact, (df[key] == exact["_k"]) & (df[scope] == exact["_s"]), "left_semi")
    anywhere = df.join(wild, df[key] == wild["_k"], "left_semi")
    return by_scope.union(anywhere.join(exact, (anywhere[key] == exact["_k"]) & (anywhere[scope] == exact["_s"]), "left_anti"))


def preferred(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row per key, the first in a total order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def rank_in(value: Column, priority: list[str]) -> Column:
    """Position of a value in a priority list; absent ones come last."""
    at = F.array_position(F.array(*map(F.lit, priority)), value)
    return F.when(at == 0, len(priority) + 1).otherwise(at)


def asof(left: DataFrame, right: DataFrame, keys: list[str], t: str, tie: str, value: str, name: str) -> DataFrame:
    """The last right value strictly before each left row, by one sort of the union instead of a range join."""
    a = left.select("*", F.lit(0).alias("_side"))
    b = right.select(*keys, t, tie, F.col(value).alias("_v"), F.lit(1).alias("_side"))
    both = a.unionByName(b, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(F.col(t), F.col("_side")).rowsBetween(Window.unboundedPreceding, -1)
    return both.withColumn(name, F.last(F.when(F.col("_side") == 1, F.col("_v")), True).over(w)).where("_side = 0").drop("_side", "_v")


def nearest_same_label(df: DataFrame, candidates: DataFrame, tolerance: float) -> DataFrame:
    """The candidate of equal scene and label with the nearest midpoint within tolerance, or overlapping.

    Times are bucketed by the tolerance, so only neighbouring buckets meet.
    """
    mid = (F.col("onset") + F.col("off")) / 2
    a = df.select("scene", "label", F.col("event_id").alias("a_id"), F.col("onset").alias("a_on"), F.col("off").alias("a_off"), mid.alias("a_mid"))
    b = candidates.select("scene", "label", F.col("event_id").alias("b_id"), F.col("onset").alias("b_on"), F.col("off").alias("b_off"), mid.alias("b_mid"))
    reach = lambda lo, hi: F.explode(F.sequence(F.floor(lo / tolerance), F.floor(hi / tolerance)))
    a = a.withColumn("bucket", reach(F.least("a_on", F.col("a_mid") - tolerance), F.greatest("a_off", F.col("a_mid") + tolerance)))
    b = b.withColumn("bucket", reach(F.col("b_on"), F.col("b_off")))
    pairs = a.join(b, ["scene", "label", "bucket"]).where((F.col("a_id") != F.col("b_id")) & ((F.abs(F.col("a_mid") - F.col("b_mid")) <= tolerance) | ((F.col("a_on") < F.col("b_off")) & (F.col("b_on") < F.col("a_off")))))
    best = pairs.groupBy("a_id").agg(F.min(F.struct(F.abs(F.col("a_mid") - F.col("b_mid")).alias("distance"), F.col("b_id"))).alias("m"))
    return best.select("a_id", F.col("m.b_id").alias("b_id"), F.col("m.distance").alias("distance"))


def paired(a: DataFrame, b: DataFrame, key: str, measure: str) -> DataFrame:
    """Two reports on equal ids; rows with an id of one side only are flagged."""
    return a.select(key, F.col(measure).alias("before")).join(b.select(key, F.col(measure).alias("after")), key, "full_outer").withColumn("matched", F.col("before").isNotNull() & F.col("after").isNotNull())


def transitions(df: DataFrame, keys: list[str], before: Column, after: Column) -> DataFrame:
    """How often a pair of booleans changed, and how."""
    n = F.count_if
    return df.groupBy(*keys).agg(n(~before & after).alias("gained"), n(before & ~after).alias("lost"), n(before == after).alias("same"))


def closure(edges: DataFrame, rounds: int = 30) -> DataFrame:
    """(parent, child, depth) of all descendants; a cycle raises.

    Paths double in each round, so the rounds are logarithmic in the depth.
    """
    from tidemark.session import written

    paths = written(edges.select("parent", "child", F.lit(1).alias("depth")).distinct(), "closure")
    for _ in range(rounds):
        a, b = paths.alias("a"), paths.alias("b")
        longer = a.join(b, F.col("a.child") == F.col("b.parent")).select("a.parent", "b.child", (F.col("a.depth") + F.col("b.depth")).alias("depth"))
        new = written(paths.union(longer).groupBy("parent", "child").agg(F.min("depth").alias("depth")), "closure")
        if not new.where("parent = child").isEmpty():
            raise ValueError("the hierarchy has a cycle")
        if new.count() == paths.count():
            return new
        paths = new
    raise ValueError("the hierarchy is too deep")


def lowest_common(closed: DataFrame, pairs: DataFrame) -> DataFrame:
    """The shared ancestor of (x, y) with the least total distance, then the lesser name."""
    up = closed.select("child", F.col("parent").alias("ancestor"), "depth")
    a = pairs.join(up.select(F.col("child").alias("x"), "ancestor", F.col("depth").alias("dx")), "x")
    b = a.join(up.select(F.col("child").alias("y"), "ancestor", F.col("depth").alias("dy")), ["y", "ancestor"])
    best = b.groupBy("x", "y").agg(F.min(F.struct((F.col("dx") + F.col("dy")).alias("distance"), "ancestor")).alias("m"))
    return best.select("x", "y", F.col("m.ancestor").alias("ancestor"), F.col("m.distance").alias("distance"))


def supported(df: DataFrame, key: str, needs: str, rounds: int = 50) -> DataFrame:
    """Drop rows whose needed key has no remaining row, until nothing changes."""
    from tidemark.session import written

    now = written(df, "supported")
    for _ in range(rounds):
        own = now.select(F.col(key).alias("_k")).distinct()
        new = written(now.where(F.col(needs).isNull()).union(now.join(own, now[needs] == own["_k"], "left_semi")), "supported")
        if new.count() == now.count():
            return new
        now = new
    raise ValueError("support did not settle")
