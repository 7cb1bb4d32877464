"""Duplicates, leakage between splits, and consistency of records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType


def without_duplicates(df: DataFrame, content: Column) -> DataFrame:
    """DD1: rows whose content occurs once; all copies go. Counts are aggregated before they meet the rows."""
    many = df.groupBy(F.sha2(content, 256).alias("_h")).agg(F.count("*").alias("_n")).where("_n > 1").select("_h")
    return df.withColumn("_h", F.sha2(content, 256)).join(many, "_h", "left_anti").drop("_h")


def identities(df: DataFrame, split: str, fields: list[str]) -> DataFrame:
    """Long form (split, field, value) of identity columns, nulls dropped."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])
    return df.select(F.col(split).alias("split"), F.explode(pairs).alias("x")).select("split", "x.*").where("value is not null").distinct()


def leakage(df: DataFrame, split: str, fields: list[str], samples: int = 5) -> DataFrame:
    """DD2, DD3, U2: shared identities of each split pair and field, with a few examples.

    Splits of a value are gathered (few), so values never meet each other.
    """
    by_value = identities(df, split, fields).groupBy("field", "value").agg(F.array_sort(F.collect_set("split")).alias("s")).where(F.size("s") > 1)
    pairs = by_value.select("field", "value", F.explode("s").alias("left"), "s").select("field", "value", "left", F.explode("s").alias("right")).where("left < right")
    ranked = pairs.withColumn("_n", F.row_number().over(Window.partitionBy("field", "left", "right").orderBy("value")))
    few = ranked.where(F.col("_n") <= samples).groupBy("field", "left", "right").agg(F.array_sort(F.collect_list("value")).alias("samples"))
    return pairs.groupBy("field", "left", "right").agg(F.count("*").alias("shared")).join(few, ["field", "left", "right"])


def majority_accuracy(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """DD6: balanced accuracy of the majority class (0 or 1; ties 1) of each feature group."""
    g = df.groupBy(*features).agg(F.sum(F.col(target).cast("long")).alias("p"), F.sum((1 - F.col(target)).cast("long")).alias("n"))
    guess = F.col("p") >= F.col("n")
    tp, tn = F.sum(F.when(guess, F.col("p")).otherwise(0)), F.sum(F.when(guess, 0).otherwise(F.col("n")))
    return g.agg(((F.try_divide(tp, F.sum("p")) + F.try_divide(tn, F.sum("n"))) / 2).alias("balanced_accuracy"))


def deduplicated_units(df: DataFrame, key: list[str], order: list, measures: list[str], tolerance: float = 1e-7) -> DataFrame:
    """DD11: the first row per key, and whether the others agree with it."""
    spread = [(F.max(m) - F.min(m) <= tolerance) for m in measures]
    agree = spread[0]
    for s in spread[1:]:
        agree = agree & s
    first = df.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")
    return first.join(df.groupBy(*key).agg(agree.alias("consistent")), key)


def grid_violations(df: DataFrame, keys: list[str], step: float, tolerance: float = 1e-8) -> DataFrame:
    """DD8: per key, events off the grid and events that overlap their predecessor."""
    w = Window.partitionBy(*keys).orderBy("onset", "off", "event_id")
    off_grid = F.abs(F.col("onset") / step - F.round(F.col("onset") / step)) > tolerance
    overlap = F.coalesce(F.lag("off").over(w) > F.col("onset") + tolerance, F.lit(False))
    return df.withColumns({"_g": off_grid, "_o": overlap}).groupBy(*keys).agg(F.count("*").alias("events"), F.count_if("_g").alias("off_grid"), F.count_if("_o").alias("overlapping"))


def complete_groups(df: DataFrame, group: str, variant: str, wanted: list[str]) -> DataFrame:
    """SP18, DD10: groups whose variants are exactly the wanted ones, each once."""
    want = F.array_sort(F.array(*map(F.lit, wanted)))
    return df.groupBy(group).agg(F.array_sort(F.collect_set(variant)).alias("v"), F.count("*").alias("n")).where((F.col("v") == want) & (F.col("n") == len(wanted))).select(group)


def holds(value: Column, operator: str, threshold: float) -> Column:
    """Value >=, > or <= threshold; null, NaN and infinite values fail."""
    tests = {">=": value >= threshold, ">": value > threshold, "<=": value <= threshold}
    finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))
    return F.coalesce(finite & tests[operator], F.lit(False))


def failed_conditions(df: DataFrame, key: str, gates: dict[str, list[tuple[str, str, str, float]]]) -> DataFrame:
    """A row per failed condition: key, gate, code, value, operator, threshold. ``gates``: gate -> (code, column, operator, threshold)."""
    rows = []
    for gate, conditions in gates.items():
        for code, column, operator, threshold in conditions:
            x = F.col(column).cast("double")
            rows.append(F.when(~holds(x, operator, threshold), F.struct(F.lit(gate).alias("gate"), F.lit(code).alias("code"), x.alias("value"), F.lit(operator).alias("operator"), F.lit(float(threshold)).alias("threshold"))))
    return df.select(key, F.inline(F.array_compact(F.array(*rows))))


def prohibited_fields(schema: StructType, words: tuple[str, ...] = ("oracle", "sdr")) -> list[str]:
    """P20: paths of fields, at any depth, whose name holds one of the words (case and '-' aside)."""
    out: list[str] = []

    def walk(kind, path: str) -> None:
        if isinstance(kind, StructType):
            for f in kind.fields:
                at = f"{path}.{f.name}" if path else f.name
                if any(w in f.name.casefold().replace("-", "_") for w in words):
                    out.append(at)
                walk(f.dataType, at)
        elif isinstance(kind, ArrayType):
            walk(kind.elementType, f"{path}[]")
        elif isinstance(kind, MapType):
            walk(kind.valueType, f"{path}{{}}")

    walk(schema, "")
    return out


def assert_disjoint(train: DataFrame, held_out: DataFrame, key: str) -> DataFrame:
    """DD12: ``train``, after checking that none of its keys is held out."""
    shared = train.join(held_out.select(key).distinct(), key, "left_semi").select(key).limit(5).collect()
    if shared:
        raise ValueError(f"held-out keys in training: {[r[0] for r in shared]}")
    return train
