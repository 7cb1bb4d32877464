"""SimHash near-duplicates by a segment-popcount embedding and grid range-join.

A 64-bit fingerprint is embedded as 32 bit counts (0 to 2), one per segment of
two bits. One differing bit moves one count by at most one, so the Manhattan
distance of two embeddings is a lower bound of the Hamming distance. Of a pair
within Manhattan distance 3, one half of the coordinates is within distance 1.
So each half is a grid of unit cells, and each fingerprint looks in its own cell
and in the neighbouring cells one step up; the neighbour one step down looks
for it. Candidates that pass the Manhattan bound over all coordinates are then
verified on the exact bits. A pair counts in the first half in which it meets.

Two random halves share a cell with probability 2^-22.6 (per coordinate 3/8), so
a fingerprint among n meets about 8e-6 n candidates in its cells and their
neighbours. Cells with more than ``HOT`` fingerprints are dealt as pairs of
blocks, by the same bound and check, and return a spanning forest of their links
instead of all links.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import arrow_map, connected_components, fresh, hub_join, narrow, table
from tidemark.session import ship, written

SEGMENTS, LIMIT, SHINGLE, SEED = 32, 3, 3, 42
#: The lower bit of each two-bit field.
ONES = 0x5555555555555555
#: A cell with more fingerprints is dealt in blocks of this many.
HOT = 2048


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Majority bits of XXH64 over word shingles; no words: zero."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = ends[shingle - 1 :] if len(words) >= shingle else ends[-1:]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[i:j], SEED) for i, j in zip(starts[:n].tolist(), last.tolist())), np.uint64, n)
    return majority(hashes)


def majority(hashes: np.ndarray) -> int:
    """A bit is 1 if set in over half the hashes."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        rows = hashes[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(rows, axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big")


def _fingerprints(text_col: str, keep: bool, name: str):
    def run(batches):
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col))
            values = np.array([fingerprint(t.as_py()) for t in texts], np.uint64).view(np.int64)
            kept = [n for n in batch.schema.names if keep or n != text_col]
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(n)) for n in kept], pa.array(values)], [*kept, name])

    return run


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) for each row; null text counts as empty."""
    return arrow_map(narrow(docs, "doc_id", "text"), _fingerprints("text", False, "fp"), "doc_id bigint, fp bigint")


def with_fingerprint(docs: DataFrame, name: str) -> DataFrame:
    """The rows of ``docs`` with their fingerprint as column ``name``."""
    return arrow_map(docs, _fingerprints("text", True, name), T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())]))


def counts_of(fp: Column) -> Column:
    """The embedding: 32 two-bit fields of one long, each the bit count of its segment."""
    x, y = fp.bitwiseAND(F.lit(ONES)), F.shiftrightunsigned(fp, 1).bitwiseAND(F.lit(ONES))
    return x.bitwiseXOR(y).bitwiseOR(F.shiftleft(x.bitwiseAND(y), 1))  # adds without a carry out of the field


def manhattan(x: Column, y: Column) -> Column:
    """Sum of the fields' differences: 1 where the lower bit differs, 2 where only the upper does (0 and 2)."""
    d = x.bitwiseXOR(y)
    low = d.bitwiseAND(F.lit(ONES))
    high = F.shiftrightunsigned(d, 1).bitwiseAND(F.lit(ONES))
    return F.bit_count(low) + 2 * F.bit_count(high.bitwiseAND(F.bitwise_not(low)))


def half_of(v: Column, half: int) -> Column:
    return F.shiftrightunsigned(v, 32) if half else v.bitwiseAND(F.lit((1 << 32) - 1))


def homes(v: DataFrame) -> DataFrame:
    """(half, cell, fp, v): the cell of each fingerprint in either half."""
    cells = F.array(*[F.struct(F.lit(h).alias("half"), half_of(F.col("v"), h).alias("cell")) for h in (0, 1)])
    return v.select(F.inline(cells), "fp", "v")


def probes(v: DataFrame) -> DataFrame:
    """(half, cell, step, fp, v): the own cell (step 0) and the neighbours with one more in one coordinate."""

    def look(h):
        own = half_of(F.col("v"), h)
        up = [F.when(F.shiftrightunsigned(own, 2 * i).bitwiseAND(F.lit(3)) < 2, F.struct(F.lit(h).alias("half"), (own + (1 << 2 * i)).alias("cell"), F.lit(1).alias("step"))) for i in range(SEGMENTS // 2)]
        return [F.struct(F.lit(h).alias("half"), own.alias("cell"), F.lit(0).alias("step")), *up]

    return v.select(F.inline(F.array_compact(F.array(*look(0), *look(1)))), "fp", "v")


def _distances(x: int, others: np.ndarray) -> np.ndarray:
    d = others ^ np.uint64(x)
    low, high = d & np.uint64(ONES), (d >> np.uint64(1)) & np.uint64(ONES)
    return np.bitwise_count(low) + 2 * np.bitwise_count(high & ~low)


def _counts(fp: np.ndarray) -> np.ndarray:
    x, y = fp & np.uint64(ONES), (fp >> np.uint64(1)) & np.uint64(ONES)
    return (x ^ y) | (x & y) << np.uint64(1)


def forest(left: np.ndarray, right: np.ndarray, limit: int = LIMIT) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links between two blocks of fingerprints: Manhattan bound, then exact bits."""
    values = np.concatenate([left, right])
    root = list(range(len(values)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    out, u = [], right.view(np.uint64)
    embedded = _counts(u)
    for i, x in enumerate(left.view(np.uint64).tolist()):
        near = np.flatnonzero(_distances(int(_counts(np.uint64(x))), embedded) <= limit)
        for j in near[np.bitwise_count(u[near] ^ np.uint64(x)) <= limit].tolist():
            a, b = find(i), find(len(left) + j)
            if a != b and values[i] != right[j]:
                root[b] = a
                out.append((int(values[i]), int(right[j])))
    return out


def _block_links(both):
    side, fp = both.column("side").to_numpy(), both.column("fp").to_numpy()
    found = forest(fp[side == 0], fp[side == 1])
    return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})


def candidates(distinct: DataFrame) -> DataFrame:
    """(x, y): the fingerprints and embeddings of pairs that meet in a cell, before bound and check; each pair once."""
    v = distinct.select("fp", counts_of(F.col("fp")).alias("v"))
    return _met(homes(v), probes(v))


def _met(home: DataFrame, probe: DataFrame) -> DataFrame:
    x, y = home.alias("x"), probe.alias("y")
    once = (F.col("y.step") == 1) | (F.col("x.fp") < F.col("y.fp"))
    first = (F.col("x.half") == 0) | (manhattan(half_of(F.col("x.v"), 0), half_of(F.col("y.v"), 0)) > LIMIT // 2)
    return x.join(y, (F.col("x.half") == F.col("y.half")) & (F.col("x.cell") == F.col("y.cell")) & once & first)


def links(distinct: DataFrame) -> DataFrame:
    """(a, b): fingerprints at 3 or fewer differing bits, enough of them to join every component.

    ``distinct`` has one row per fingerprint in column ``fp``.
    """
    ship(distinct.sparkSession)
    v = distinct.select("fp", counts_of(F.col("fp")).alias("v"))
    home, probe = homes(v), probes(v)
    hot = written(home.groupBy("half", "cell").agg(F.count("*").alias("n")).where(F.col("n") > HOT), "hot-cells")
    hot_cells = hot.count()
    small = (lambda df: F.broadcast(df)) if hot_cells <= 100_000 else (lambda df: df)
    cool = (lambda df: df.join(small(hot), ["half", "cell"], "left_anti")) if hot_cells else (lambda df: df)
    pairs = _met(cool(home), cool(probe)).where(manhattan(F.col("x.v"), F.col("y.v")) <= LIMIT)
    near = pairs.where(F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= LIMIT).select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))
    if not hot_cells:
        return near
    asked = probe.join(small(hot.select("half", "cell")), ["half", "cell"], "left_semi").groupBy("half", "cell").agg(F.count("*").alias("m"))
    sizes = written(hot.join(asked, ["half", "cell"]).select("half", "cell", F.ceil(F.col("n") / HOT).cast("int").alias("left"), F.ceil(F.col("m") / HOT).cast("int").alias("right")), "hot-blocks")

    def dealt(df: DataFrame, side: int, own: str, other: str) -> DataFrame:
        block = F.pmod(F.xxhash64("fp"), F.col(own)).cast("int").alias(f"{own}_block")
        return df.join(small(sizes), ["half", "cell"]).select("half", "cell", block, F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(f"{other}_block"), "fp", F.lit(side).alias("side"))

    every = dealt(home, 0, "left", "right").unionByName(dealt(probe, 1, "right", "left"))
    return near.union(every.groupBy("half", "cell", "left_block", "right_block").applyInArrow(_block_links, "a bigint, b bigint"))


def classes(fps: DataFrame) -> DataFrame:
    """(fp, component, least, n) for each fingerprint of (doc_id, fp): a name of its component, the least doc_id there, the fingerprint's rows."""
    least = written(fps.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "distinct-fp")
    linked = connected_components(links(least.select("fp"))).withColumnRenamed("node", "fp").join(least, "fp")
    named = linked.groupBy("component").agg(F.min("rep").alias("least"))
    joined = linked.join(named, "component").select("fp", "component", "least", "n")
    return joined.union(least.join(joined, "fp", "left_anti").select("fp", F.col("fp").alias("component"), "rep", "n"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id): the smallest doc_id reachable over links, itself included.

    Null or empty texts have fingerprint zero and link like any other; rows with
    equal texts share a component; null ids belong to components but never name
    one unless all ids are null; an empty table gives an empty result; a
    fingerprint of very many rows is dealt to several keys; further columns are
    ignored.
    """
    fps = written(fingerprints(docs), "fingerprints")
    return hub_join(fps, written(classes(fps), "classes"), "fp").select("doc_id", "fp", F.col("least").alias("component_id"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document, rules as in ``near_duplicates``."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each component: one with the doc_id that names it. All columns stay.

    A component without any id keeps one of its rows. An id that occurs once is
    decided on ids alone. Rows that share an id are looked at with their own
    text, so an id with several texts keeps a row of each component it names; of
    several rows of a component that remain, the least text stays.
    """
    fps = written(fingerprints(docs), "fingerprints")
    found = written(classes(fps), "classes")
    fp, component, place = fresh(docs, "_fp", "_component", "_place")
    several = written(fps.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "repeated-ids")
    repeats = not several.isEmpty()
    named = hub_join(fps, found, "fp").where("doc_id = least").select("doc_id", F.col("fp").alias(fp), F.col("component").alias(component))
    single = named.join(several, "doc_id", "left_anti") if repeats else named
    out = docs.join(single.select("doc_id"), "doc_id", "left_semi").select(*docs.columns)

    def first_rows(rows: DataFrame) -> DataFrame:
        order = Window.partitionBy(component).orderBy("text", F.xxhash64(*docs.columns))
        return rows.withColumn(place, F.row_number().over(order)).where(F.col(place) == 1).select(*docs.columns)

    if repeats:
        rows = with_fingerprint(docs.join(several, "doc_id", "left_semi").select(*docs.columns), fp)
        out = out.union(first_rows(rows.join(named.distinct(), ["doc_id", fp])))
    nameless = found.where("least is null").select(F.col("fp").alias(fp), F.col("component").alias(component))
    if nameless.isEmpty():
        return out
    return out.union(first_rows(with_fingerprint(docs.where("doc_id is null"), fp).join(nameless, fp)))
