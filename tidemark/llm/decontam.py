"""Benchmark decontamination by a prefix-filtered set join over item-sized windows.

A window is ``window`` consecutive words of a benchmark item; a shorter item is
one window. Its tokens are the word shingles inside it. All shingles of the
benchmark are counted over all documents and ordered by rarity. Containment of
a whole window needs every one of its shingles, so the necessary prefix is the
rarest one alone: documents join on that shingle.

Flow: the benchmark's windows and shingles are tables, made by Spark. One pass
over the documents hashes all their shingles, looks them up in a bit map of the
benchmark's (a filter without false negatives, of at most ``FILTER_BITS`` bits)
and writes their counts and the runs of consecutive hits that are long enough to
hold a window (the length bound). Equal runs are taken once. Their shingles join
the windows' prefix shingles; the window must lie inside the run (the positional
bound), and its words must equal the run's. Hits return from the runs to the
documents, the runs of hot passages dealt to several keys. Neither documents nor
benchmark pass through the driver; it holds the bit map and a few counts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_map, fresh, hub_join, table
from tidemark.session import written

WINDOW, SHINGLE = 13, 5
#: Most bits of the filter (32 MB): with two probes, 30 million shingles let 4 % of the others pass.
FILTER_BITS = 1 << 28
#: Words whose hashes a worker remembers.
MOST_WORDS = 100_000
#: Shingle counts that a task gathers before it writes them.
MOST_COUNTS = 200_000
#: A-Z to lower case; what is neither letter, digit nor beyond ASCII separates words.
_TO_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TO_WORDS).split()


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


_KNOWN = _Hashes()


def word_hashes(found: list[bytes]) -> np.ndarray:
    if len(_KNOWN) > MOST_WORDS:
        _KNOWN.clear()
    return np.fromiter(map(_KNOWN.__getitem__, found), np.uint64, len(found))


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each run of k words."""
    n = len(hashes) - k + 1
    out = np.full(max(n, 0), k, np.uint64)
    for j in range(k if n > 0 else 0):
        out = (out ^ hashes[j : j + n]) * _MULTIPLIER
        out ^= out >> np.uint64(29)
    return out


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _windows(window: int):
    def cut(batches):
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = words(text)
                size = min(window, len(found))
                k = min(SHINGLE, size)
                hashes = shingles(word_hashes(found), k) if found else np.zeros(0, np.uint64)
                for at in range(0, len(found) - size + 1 if found else 0, 10_000):
                    some = range(at, min(at + 10_000, len(found) - size + 1))
                    text_of = [b" ".join(found[i : i + size]).decode("utf-8", "surrogatepass") for i in some]
                    tokens = [hashes[i : i + size - k + 1].view(np.int64) for i in some]
                    yield pa.RecordBatch.from_arrays([pa.array([item] * len(some), pa.string()), pa.array(text_of, pa.string()), pa.array([size] * len(some), pa.int32()), pa.array([k] * len(some), pa.int32()), pa.array(tokens, pa.list_(pa.int64()))], ["item", "window", "size", "k", "tokens"])

    return cut


def windows_of(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item, window, size, k, tokens) for each window of each item: its words, their number, its shingles' length and hashes; written."""
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), "text")
    return written(arrow_map(rows, _windows(window), "item string, window string, size int, k int, tokens array<bigint>"), "windows")


def bit_map(tokens: DataFrame, bits: int) -> np.ndarray:
    """The filter: two bits of ``bits`` set for each hash in ``h``; the driver receives its non-zero words."""
    first, second = F.col("h").bitwiseAND(F.lit(bits - 1)), F.shiftrightunsigned("h", 32).bitwiseAND(F.lit(bits - 1))
    places = tokens.select(F.explode(F.array(first, second)).alias("p"))
    filled = places.groupBy(F.shiftrightunsigned("p", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("w"))
    out = np.zeros(bits // 64, np.uint64)
    got = filled.toArrow()
    out[got.column("at").to_numpy()] = got.column("w").to_numpy().view(np.uint64)
    return out


def _passes(hashes: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    mask = np.uint64(len(bitmap) * 64 - 1)
    out = np.ones(len(hashes), bool)
    for p in (hashes & mask, (hashes >> np.uint64(32)) & mask):
        out &= (bitmap[p >> np.uint64(6)] >> (p & np.uint64(63))) & np.uint64(1) > 0
    return out


def _scanned(filter_, least: dict[int, int]):
    """Rows of three kinds: a document (n_words), a run of benchmark shingles (k, start, run), a count (h, n)."""
    names = ["doc_id", "key", "n_words", "k", "start", "run", "h", "n"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int64()]

    def counted(counts):
        h = np.fromiter(counts, np.int64, len(counts))
        n = np.fromiter(counts.values(), np.int64, len(counts))
        return pa.RecordBatch.from_arrays([*[pa.nulls(len(h), t) for t in types[:6]], pa.array(h), pa.array(n)], names)

    def scan(batches):
        bitmap, counts = filter_.value, {}
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                found = words(text.as_py())
                hashes = word_hashes(found)
                rows.append((doc_id, key, len(found), None, None, None, None, None))
                for k, fewest in least.items():
                    tokens = shingles(hashes, k)
                    hit = _passes(tokens, bitmap)
                    if not hit.any():
                        continue
                    for h, n in zip(*(x.tolist() for x in np.unique(tokens[hit].view(np.int64), return_counts=True))):
                        counts[h] = counts.get(h, 0) + n
                    edges = np.flatnonzero(np.diff(np.concatenate(([False], hit, [False])).astype(np.int8)))
                    for a, b in edges.reshape(-1, 2).tolist():
                        if b - a >= fewest:
                            rows.append((doc_id, key, len(found), k, a, b" ".join(found[a : b + k - 1]).decode("utf-8", "surrogatepass"), None, None))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)] if rows else [pa.nulls(0, t) for t in types], names)
            if len(counts) > MOST_COUNTS:
                yield counted(counts)
                counts = {}
        yield counted(counts)

    return scan


SCANNED = "doc_id bigint, key bigint, n_words bigint, k int, start bigint, run string, h bigint, n bigint"


def _tokens(window: int):
    """(run_id, k, pos, h, context, first) for each shingle of a run: the words around it, from word ``first`` on."""

    def explode(batches):
        for batch in batches:
            for run_id, k, run in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                found = run.encode("utf-8", "surrogatepass").split(b" ")
                h, wide = shingles(word_hashes(found), k), window - k
                for at in range(0, len(h), 10_000):
                    some = range(at, min(at + 10_000, len(h)))
                    context = [b" ".join(found[max(0, i - wide) : i + window]).decode("utf-8", "surrogatepass") for i in some]
                    n = len(some)
                    columns = [pa.array([run_id] * n, pa.string()), pa.array([k] * n, pa.int32()), pa.array(some, pa.int64()), _signed(h[at : at + n]), pa.array(context, pa.string()), pa.array([max(0, i - wide) for i in some], pa.int64()), pa.array([len(found)] * n, pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, ["run_id", "k", "pos", "h", "context", "first", "n_run"])

    return explode


def verified(runs: DataFrame, windows: DataFrame, counts: DataFrame, window: int) -> DataFrame:
    """(run_id, start, size, window): the windows that occur in distinct runs (run_id, k, run); prefix join, bounds, exact check."""
    distinct = windows.select("window", "size", "k", "tokens").dropDuplicates(["window"])
    every = distinct.select("window", "size", "k", F.posexplode("tokens").alias("offset", "h"))
    rarest = every.join(counts, "h", "left").groupBy("window").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "h", "offset", "size", "k")).alias("p"))
    prefix = rarest.select("window", "p.h", "p.offset", "p.size", "p.k")
    tokens = arrow_map(runs.select("run_id", "k", "run"), _tokens(window), "run_id string, k int, pos bigint, h bigint, context string, first bigint, n_run bigint")
    start = F.col("pos") - F.col("offset")
    met = tokens.join(prefix, ["k", "h"]).withColumn("start", start).where((F.col("start") >= 0) & (F.col("start") + F.col("size") <= F.col("n_run")))
    same = F.array_join(F.slice(F.split("context", " "), (F.col("start") - F.col("first") + 1).cast("int"), F.col("size")), " ") == F.col("window")
    return met.where(same).select("run_id", "start", "size", "window")


def _covered(spans: Column) -> Column:
    """The number of words in the union of spans sorted by start."""
    seed = F.struct(F.lit(0).cast("bigint").alias("to"), F.lit(0).cast("bigint").alias("n"))
    add = lambda acc, s: F.struct(F.greatest(acc["to"], s["end"]).alias("to"), (acc["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(acc["to"], s["start"]))).alias("n"))
    return F.aggregate(spans, seed, add, lambda acc: acc["n"])


def _key(text_col: str) -> Column:
    """With the id it names a row: rows that agree in both have the same text, so the same result."""
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def overlaps(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(doc_id, key, n_words, n_hit, spans, items), a row per row of ``docs``: words, hit words, the windows' word spans, the items they are from.

    Null and empty texts have no words; a null item_id counts as 'null'; repeated
    items count once; repeated rows give repeated results; an empty benchmark
    hits nothing; very long texts are scanned whole in one task; further columns
    are ignored.
    """
    spark = docs.sparkSession
    windows = windows_of(benchmark, window)
    tokens = written(windows.select("k", F.explode("tokens").alias("h")).distinct(), "tokens")
    bits = min(FILTER_BITS, 1 << max(16, (16 * tokens.count()).bit_length()))
    least = {r.k: r.n for r in windows.groupBy("k").agg(F.min(F.size("tokens")).alias("n")).collect()}
    # at most FILTER_BITS bits
    filter_ = spark.sparkContext.broadcast(bit_map(tokens, bits))
    rows = docs.select("doc_id", _key(text_col).alias("key"), F.col(text_col).alias("text"))
    scanned = written(arrow_map(rows, _scanned(filter_, least), SCANNED), "scanned")
    counts = scanned.where("h is not null").groupBy("h").agg(F.sum("n").alias("n"))
    runs = written(scanned.where("run is not null").select("doc_id", "key", "k", "start", F.sha2("run", 256).alias("run_id"), "run").distinct(), "runs")
    found = verified(runs.select("run_id", "k", "run").dropDuplicates(["run_id", "k"]), windows, counts, window)
    found = written(found, "verified")
    items = found.join(windows.select("window", "item").distinct(), "window").groupBy("run_id").agg(F.collect_set("item").alias("items"))
    spans = found.groupBy("run_id").agg(F.collect_set(F.struct("start", "size")).alias("found"))
    sizes = runs.groupBy("run_id").agg(F.count("*").alias("n"))
    per_run = written(spans.join(items, "run_id").join(sizes, "run_id"), "run-hits")
    hits = hub_join(runs.select("doc_id", "key", "start", "run_id"), per_run, "run_id")
    placed = hits.select("doc_id", "key", F.transform("found", lambda f: F.struct((f["start"] + F.col("start")).alias("start"), (f["start"] + f["size"] + F.col("start")).alias("end"))).alias("spans"), "items")
    per_doc = placed.groupBy("doc_id", "key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    per_doc = written(per_doc.withColumn("n_hit", _covered(F.col("spans"))), "document-hits")
    mine = scanned.where("h is null and run is null").select("doc_id", "key", "n_words").alias("m")
    both = mine.join(per_doc.alias("p"), F.col("m.doc_id").eqNullSafe(F.col("p.doc_id")) & (F.col("m.key") == F.col("p.key")), "left")
    empty = {"spans": "array<struct<start:bigint,end:bigint>>", "items": "array<string>"}
    return both.select("m.doc_id", "m.key", "m.n_words", F.coalesce("p.n_hit", F.lit(0).cast("bigint")).alias("n_hit"), *[F.coalesce(f"p.{c}", F.array().cast(t)).alias(c) for c, t in empty.items()])


def is_contaminated() -> Column:
    """Any hit, and hits make up at least a twentieth of the words."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of every document and whether it is contaminated, rules as in ``overlaps``."""
    found = overlaps(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        is_contaminated().alias("contaminated"),
    )


def clean_of(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows that aren't contaminated, with their columns. Only ids and hashes of the others are joined."""
    bad_id, bad_key, key = fresh(docs, "_bad_id", "_bad_key", "_key")
    bad = written(overlaps(docs.select("doc_id", "text"), benchmark).where(is_contaminated()).select(F.col("doc_id").alias(bad_id), F.col("key").alias(bad_key)).distinct(), "contaminated")
    keyed = docs.withColumn(key, _key("text"))
    return keyed.join(bad, F.col("doc_id").eqNullSafe(F.col(bad_id)) & (F.col(key) == F.col(bad_key)), "left_anti").select(*docs.columns)
