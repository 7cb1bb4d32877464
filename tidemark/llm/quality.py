"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages. Each passage is encoded by one hidden layer
over byte-class and word-repetition features; gated attention
softmax(w . (tanh(Vh) * sigmoid(Uh))) weights the encodings, and a logistic
output scores the weighted sum. All weights are learned together from document
labels by gradient descent on the driver, over a bounded sample (``SAMPLE``
labelled documents, half of each label, picked by a hash of the id, each with at
most ``FIT_PASSAGES`` passages spread over its text). Every passage of every
document is encoded when it is scored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.bytestats import FEATURES, encoded, groups, passages
from tidemark.llm.common import arrow_map, fold, fresh, narrow, table

SAMPLE, FIT_PASSAGES, HIDDEN, GATE, FOLDS, SEED = 3000, 64, 16, 8, 5, 11
THRESHOLD = 0.3


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Attention:
    """The weights, their forward pass over bags, and the gradients."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, seed: int = SEED):
        rng = np.random.default_rng(seed)
        normal = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.mean, self.scale = mean, scale
        self.p = {"E": normal(FEATURES, HIDDEN), "e": np.zeros(HIDDEN, np.float32), "V": normal(HIDDEN, GATE), "U": normal(HIDDEN, GATE), "w": normal(GATE), "c": normal(HIDDEN), "b": np.zeros(1, np.float32)}

    def forward(self, x: np.ndarray, count: np.ndarray) -> dict:
        p, first = self.p, np.cumsum(count) - count
        bag = np.repeat(np.arange(len(count)), count)
        h = np.tanh(x @ p["E"] + p["e"])
        t, g = np.tanh(h @ p["V"]), sigmoid(h @ p["U"])
        s = (t * g) @ p["w"]
        s = np.exp(s - np.maximum.reduceat(s, first)[bag])
        a = s / np.add.reduceat(s, first)[bag]
        z = np.add.reduceat(a[:, None] * h, first, axis=0)
        return {"h": h, "t": t, "g": g, "a": a, "z": z, "y": sigmoid(z @ p["c"] + p["b"][0]), "bag": bag, "first": first}

    def gradients(self, x: np.ndarray, count: np.ndarray, label: np.ndarray) -> dict:
        p, f = self.p, self.forward(x, count)
        bag, h, a = f["bag"], f["h"], f["a"]
        dy = ((f["y"] - label) / len(label)).astype(np.float32)
        dz = dy[:, None] * p["c"]
        dh = a[:, None] * dz[bag]
        da = (dz[bag] * h).sum(1)
        ds = a * (da - np.add.reduceat(a * da, f["first"])[bag])
        dt, dg = ds[:, None] * p["w"] * f["g"] * (1 - f["t"] ** 2), ds[:, None] * p["w"] * f["t"] * f["g"] * (1 - f["g"])
        dh += dt @ p["V"].T + dg @ p["U"].T
        dpre = dh * (1 - h**2)
        return {"E": x.T @ dpre, "e": dpre.sum(0), "V": h.T @ dt, "U": h.T @ dg, "w": (f["t"] * f["g"]).T @ ds, "c": f["z"].T @ dy, "b": dy.sum(keepdims=True)}

    def fit(self, x: np.ndarray, count: np.ndarray, label: np.ndarray, rounds: int = 200) -> None:
        x = self.scaled(x)
        m, v = ({k: np.zeros_like(q) for k, q in self.p.items()} for _ in range(2))
        for i in range(1, rounds + 1):
            for k, g in self.gradients(x, count, label).items():
                g = g + 1e-4 * self.p[k]
                m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.99 * v[k] + 0.01 * g * g
                self.p[k] = self.p[k] - 0.03 * (m[k] / (1 - 0.9**i)) / (np.sqrt(v[k] / (1 - 0.99**i)) + 1e-7)

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -5, 5).astype(np.float32)

    def score(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The score of each text and the weight of its most attended passage."""
        y, top = np.zeros(len(texts)), np.zeros(len(texts))
        for a, b in groups(texts):
            x, count = passages(texts[a:b])
            f = self.forward(self.scaled(x), count)
            y[a:b], top[a:b] = f["y"], np.maximum.reduceat(f["a"], f["first"])
        return y, top


def spread(x: np.ndarray, most: int = FIT_PASSAGES) -> np.ndarray:
    """At most ``most`` rows, evenly spaced from the first to the last."""
    return x if len(x) <= most else x[np.linspace(0, len(x) - 1, most).astype(int)]


def _sampled(batches):
    for batch in batches:
        texts = [encoded(t) for t in batch.column(1).to_pylist()]
        rows = [spread(passages([t])[0]).astype(np.float16).tobytes() for t in texts]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], ["label", "x"])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Attention | None:
    """Learn from the labels outside fold 0; repeated labels of a document count once (the largest).

    None if either label is missing. ``labels`` has a row per labelled document,
    and the sample taken before the join is small.
    """
    known = labels.where((fold("doc_id", FOLDS) != 0) & F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").cast("int").alias("label"))
    counts = {r.label: r.n for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return None
    share = F.when(F.col("label") == 1, min(1.0, sample / 2 / counts[1])).otherwise(min(1.0, sample / 2 / counts[0]))
    picked = known.where(F.pmod(F.xxhash64("doc_id", F.lit("quality")), F.lit(1 << 20)) < share * (1 << 20))
    # about `sample` ids and labels: the side broadcast is bounded by that parameter
    rows = sorted(tuple(r) for r in arrow_map(docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("label", "text"), _sampled, "label int, x binary").collect())
    if len({label for label, _ in rows}) < 2:
        return None
    bags = [np.frombuffer(x, np.float16).reshape(-1, FEATURES) for _, x in rows]
    x = np.concatenate(bags).astype(np.float32)
    model = Attention(x.mean(0), x.std(0) + 0.02)
    model.fit(x, np.array([len(b) for b in bags]), np.array([label for label, _ in rows], np.float32))
    return model


def _scored(model: Attention | None, text_col: str, names: list[str]):
    def run(batches):
        for batch in batches:
            texts = [encoded(t) for t in batch.column(batch.schema.get_field_index(text_col)).to_pylist()]
            y, top = model.score(texts) if model else (np.full(len(texts), 0.5), np.zeros(len(texts)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(y, pa.float64()), pa.array(top, pa.float64())], [*batch.schema.names, *names])

    return run


def scored(docs: DataFrame, model: Attention | None, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with _score and _attention (more underscores if ``docs`` has such columns).

    Null and empty texts have one empty passage; equal texts get equal scores;
    a long text is read in slices; without a model (a label is missing) every
    score is one half; an empty table gives no rows.
    """
    score, top = names = fresh(docs, "_score", "_attention")
    schema = T.StructType([*docs.schema.fields, T.StructField(score, T.DoubleType()), T.StructField(top, T.DoubleType())])
    return arrow_map(docs, _scored(model, text_col, names), schema)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document, rules as in ``scored``; labels of fold 0 are never learned from."""
    docs = narrow(table(spark, sf_dir, "documents"), "doc_id", "text")
    found = scored(docs, fit(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", (fold("doc_id", FOLDS) == 0).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= THRESHOLD).cast("int").alias("predicted"), F.col("_attention").alias("top_attention"))


def accepted(docs: DataFrame, model: Attention | None, text_col: str = "text") -> DataFrame:
    """The rows that score at least the threshold, with their columns."""
    score, _ = fresh(docs, "_score", "_attention")
    return scored(docs, model, text_col).where(F.col(score) >= THRESHOLD).select(*docs.columns)
