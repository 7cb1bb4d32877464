"""Sinks; Spark's committers make each of them atomic per job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_jsonl(df: DataFrame, path: str) -> None:
    """JSON lines with sorted keys."""
    df.select(*sorted(df.columns)).write.json(path)


def write_shards(df: DataFrame, path: str, rows: int) -> None:
    """Files of at most ``rows`` rows, old ones replaced."""
    df.write.mode("overwrite").option("maxRecordsPerFile", rows).parquet(path)


def write_exclusive(df: DataFrame, path: str) -> None:
    """Fails if the target exists."""
    df.write.mode("errorifexists").json(path)


def write_table(df: DataFrame, path: str, separator: str = "\t") -> None:
    """S23."""
    df.write.option("header", True).option("sep", separator).csv(path)


def fingerprint(df: DataFrame) -> tuple[int, int]:
    """Row count and an order-free sum of row hashes."""
    row = df.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64(*sorted(df.columns)).cast("decimal(38,0)")), F.lit(0))).first()
    return int(row[0]), int(row[1])


def commit_fragment(df: DataFrame, path: str) -> bool:
    """S21, ST2: write once; the same rows again are accepted (False), other rows fail."""
    spark = df.sparkSession
    files = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if files.getFileSystem(spark._jsc.hadoopConfiguration()).exists(files):
        if fingerprint(spark.read.schema(df.schema).parquet(path)) != fingerprint(df):
            raise ValueError(f"{path} holds other rows")
        return False
    df.write.mode("overwrite").parquet(path)
    return True


#: Most rows of a report table; more is an error, not a cut.
REPORT_ROWS = 10_000


def _report(df: DataFrame, most: int) -> list:
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report of more than {most} rows")
    return rows


def markdown(df: DataFrame, rows: int = REPORT_ROWS) -> str:
    """A report table of all rows; more than ``rows`` fail."""
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in _report(df, rows)])


def latex(df: DataFrame, rows: int = REPORT_ROWS) -> str:
    """As ``markdown``."""
    escape = lambda v: "" if v is None else str(v).replace("\\", r"\textbackslash{}").replace("&", r"\&").replace("%", r"\%").replace("_", r"\_")
    body = [" & ".join(map(escape, r)) + r" \\" for r in [df.columns, *_report(df, rows)]]
    return "\n".join([rf"\begin{{tabular}}{{{'l' * len(df.columns)}}}", *body, r"\end{tabular}"])
