"""Quotas over a stream: rows are kept while a label of theirs is wanted, and each batch leaves a manifest.

A row is kept if one of its labels is below its quota, and then counts for all
its labels that are. So a label below its quota counts every row that has it, and
a row is kept exactly if it is among the first rows, as many as the quota, of
some label. Counts per label are all the state; no rows wait and none are
collected.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tidemark.session import work_dir

COUNTS = "label string, n bigint"


@dataclass(frozen=True)
class Manifest:
    """What a batch left: rows seen and kept so far, counts per label (at most the quota), and whether the run is over."""

    batch: int
    seen: int
    kept: int
    counts: dict[str, int]
    finished: bool


class QuotaStream:
    """Keeps rows (key, labels, position) of a stream; every step can be done again with the same outcome.

    Batch n reads the counts after batch n - 1 and writes its rows, counts and
    manifest under its own number, replacing an unfinished try. With all ``wanted``
    labels at their quota, or ``most`` rows, later batches keep nothing and the
    query stops.
    """

    def __init__(self, spark: SparkSession, key: str, labels: str, position: str, wanted: list[str], quota: int, most: int | None = None, at: str | None = None):
        self.spark, self.key, self.labels, self.position = spark, key, labels, position
        self.wanted, self.quota, self.most = wanted, quota, most
        self.at = at or f"{work_dir(spark)}/quota-{uuid.uuid4().hex}"

    def path(self, kind: str, batch: int) -> str:
        return f"{self.at}/{kind}/batch={batch}"

    def manifests(self) -> list[Manifest]:
        """Those of the batches so far, in order."""
        found = self.spark.read.schema("value string").text(f"{self.at}/manifest/*").collect() if self.started else []
        return sorted((Manifest(**json.loads(r.value)) for r in found), key=lambda m: m.batch)

    started = False

    def last(self, before: int) -> Manifest:
        if not before:
            return Manifest(-1, 0, 0, {}, False)
        (row,) = self.spark.read.schema("value string").text(self.path("manifest", before - 1)).collect()
        return Manifest(**json.loads(row.value))

    def step(self, rows: DataFrame, batch: int) -> None:
        """One batch: labels are ranked in parallel, each by its own rows in order of position."""
        old = self.last(batch)
        wanted = F.array_intersect(self.labels, F.array(*map(F.lit, self.wanted)))
        known = rows.withColumn("_wanted", wanted).persist()
        try:
            each = known.select(self.key, self.position, F.explode("_wanted").alias("label"))
            counts = self.spark.createDataFrame(sorted(old.counts.items()), COUNTS)  # a row per wanted label
            place = F.row_number().over(Window.partitionBy("label").orderBy(self.position, self.key))
            ranked = each.withColumn("_place", place).join(F.broadcast(counts), "label", "left").withColumn("_n", F.coalesce("n", F.lit(0)) + F.col("_place"))
            helped = ranked.where(F.col("_n") <= self.quota).select(self.key).distinct()
            kept = known.join(helped, self.key).drop("_wanted")
            if self.most is not None:
                kept = kept.orderBy(self.position, self.key).limit(max(0, self.most - old.kept))
            kept = kept.limit(0) if old.finished else kept
            kept.write.mode("overwrite").parquet(self.path("rows", batch))
            written = self.spark.read.schema(kept.schema).parquet(self.path("rows", batch))
            new = written.select(F.explode(F.array_intersect(self.labels, F.array(*map(F.lit, self.wanted)))).alias("label")).groupBy("label").agg(F.count("*").alias("n")).collect()
            after = dict(old.counts)
            for r in new:
                after[r.label] = min(self.quota, after.get(r.label, 0) + r.n)
            n = old.kept + written.count()
            full = all(after.get(x, 0) >= self.quota for x in self.wanted) or self.most is not None and n >= self.most
            manifest = {"batch": batch, "seen": old.seen + (0 if old.finished else known.count()), "kept": n, "counts": dict(sorted(after.items())), "finished": old.finished or full}
            self.spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.mode("overwrite").text(self.path("manifest", batch))
            self.started = True
        finally:
            known.unpersist()

    def run(self, stream: DataFrame) -> DataFrame:
        """Reads what is there, one trigger after the other, until the quotas are met; the kept rows with their batch."""
        query = stream.writeStream.foreachBatch(self.step).option("checkpointLocation", f"{self.at}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
        schema = StructType([*stream.schema.fields, StructField("batch", LongType())])
        return self.spark.read.schema(schema).parquet(f"{self.at}/rows")


def ordered_stream(spark: SparkSession, rows: DataFrame, position: str, batches: int) -> DataFrame:
    """A stream of ``rows`` in ranges of ``position``, a trigger each: files are written range by range, as a source would deliver them."""
    at = f"{work_dir(spark)}/ordered-{uuid.uuid4().hex}"
    low, high = rows.agg(F.min(position), F.max(position)).first()
    if low is None:
        rows.write.parquet(at)
    else:
        width = (high - low) // batches + 1
        for i in range(batches):
            begin = low + i * width
            rows.where((F.col(position) >= begin) & (F.col(position) < begin + width)).coalesce(1).write.mode("append").parquet(at)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(at)
