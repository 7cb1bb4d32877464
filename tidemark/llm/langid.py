"""Language identification by error-correcting output codes.

Each language has a codeword of ``bits`` signs, chosen for a large least
distance. One linear classifier per bit predicts it from hashed byte n-grams of
the whole text. Decoding takes the codeword with the least logistic loss, each
bit weighted by how well its classifier did in training; a small lead over the
second codeword flags the text as ambiguous. The classifiers are fitted on the
driver from a bounded sample (``SAMPLE`` rows over all languages, picked by a
hash of the id); every row is predicted.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.bytestats import encoded, groups, ngram_counts
from tidemark.llm.common import arrow_map, fold, narrow, table

BUCKETS, SAMPLE, FOLDS, SEED = 4096, 3000, 5, 7
AMBIGUOUS = 0.2
UNDETERMINED = "und"


def codewords(n: int, seed: int = SEED) -> np.ndarray:
    """n rows of signs; the best of 400 random codes by least distance, no constant bit."""
    rng, best, least = np.random.default_rng(seed), None, -1
    bits = 15 if n <= 8 else 8 * int(np.ceil(np.log2(n)))
    for _ in range(400):
        code = rng.choice([-1, 1], (n, bits))
        constant = np.abs(code.sum(0)) == n
        code[0, constant] *= -1
        far = min((int((code[i] != code[j]).sum()) for i in range(n) for j in range(i)), default=bits)
        if far > least:
            best, least = code, far
    return best


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def features(texts: list[str | None]) -> np.ndarray:
    """Unit vectors of the square roots of n-gram counts of the lower-cased texts."""
    low = [encoded(t.lower() if t else t) for t in texts]
    out = np.zeros((len(texts), BUCKETS), np.float32)
    for a, b in groups(low):
        out[a:b] = np.sqrt(ngram_counts(low[a:b], BUCKETS))
    norm = np.sqrt(np.einsum("ij,ij->i", out, out))
    return out / np.maximum(norm, 1e-9)[:, None]


class Model:
    def __init__(self, x: np.ndarray, langs: list[str], rounds: int = 150):
        self.langs = sorted(set(langs))
        self.code = codewords(len(self.langs))
        row = {lang: i for i, lang in enumerate(self.langs)}
        y = self.code[[row[lang] for lang in langs]].astype(np.float32)
        self.w, self.b = np.zeros((x.shape[1], y.shape[1]), np.float32), np.zeros(y.shape[1], np.float32)
        m, v = np.zeros_like(self.w), np.zeros_like(self.w)
        for i in range(1, rounds + 1):  # Adam on the logistic loss with a little decay
            g = -y / (1 + np.exp(y * (x @ self.w + self.b))) / len(x)
            gw = x.T @ g + 1e-5 * self.w
            m, v = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw * gw
            self.w -= 0.3 * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-8)
            self.b -= 2 * g.sum(0)
        error = (np.sign(x @ self.w + self.b) != y).mean(0)
        self.weight = np.maximum(0.05, 1 - 2 * error)

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(language number, share of the best codeword, ambiguous)."""
        margin = x @ self.w + self.b
        loss = np.stack([(np.logaddexp(0, -margin * c) * self.weight).sum(1) for c in self.code], 1)
        share = np.exp(loss.min(1, keepdims=True) - loss)
        share /= share.sum(1, keepdims=True)
        best = share.argmax(1)
        second = np.sort(share, 1)[:, -2] if share.shape[1] > 1 else np.zeros(len(share))
        score = share[np.arange(len(best)), best]
        return best, score, score - second < AMBIGUOUS


def _sampled(batches):
    for batch in batches:
        x = features(batch.column(1).to_pylist()).astype(np.float16)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in x], pa.binary())], ["lang", "x"])


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Learn from (lang, text, key): the key picks about ``sample`` rows, as many of each language."""
    counts = {r.lang: r.n for r in docs.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    share = F.lit(0.0)
    for lang, n in counts.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, sample / len(counts) / n))).otherwise(share)
    picked = docs.where(F.pmod(F.xxhash64("key", F.lit("langid")), F.lit(1 << 20)) < share * (1 << 20))
    rows = sorted(tuple(r) for r in arrow_map(picked.select("lang", "text"), _sampled, "lang string, x binary").collect())
    return Model(np.stack([np.frombuffer(x, np.float16) for _, x in rows]).astype(np.float32), [lang for lang, _ in rows]) if rows else None


def _predicted(model: Model | None):
    def run(batches):
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            lang, score, unsure = [UNDETERMINED] * len(texts), [0.0] * len(texts), [True] * len(texts)
            with_letters = [i for i, t in enumerate(texts) if model and has_letter(t)]
            for at in range(0, len(with_letters), 500):
                part = with_letters[at : at + 500]
                for i, k, s, u in zip(part, *(x.tolist() for x in model.decode(features([texts[i] for i in part])))):
                    lang[i], score[i], unsure[i] = model.langs[k], s, u
            kept = [(c, n) for c, n in zip(batch.columns, batch.schema.names) if n != "text"]
            yield pa.RecordBatch.from_arrays([*[c for c, _ in kept], pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(unsure, pa.bool_())], [*[n for _, n in kept], "lang_pred", "score", "ambiguous"])

    return run


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document. Null, empty and letterless texts are ``und`` with score 0; so is all without labels.

    Equal texts and repeated rows get equal answers; of equally near codewords
    the first language in order wins and the row is flagged ambiguous; a long
    text is counted in slices; further columns are ignored.
    """
    docs = table(spark, sf_dir, "documents").withColumn("held_out", fold("doc_id", FOLDS) == 0)
    known = docs.where("not held_out and lang is not null").select("lang", "text", F.col("doc_id").alias("key"))
    return arrow_map(narrow(docs, "doc_id", "held_out", "text"), _predicted(fit(known)), "doc_id bigint, held_out boolean, lang_pred string, score double, ambiguous boolean")
