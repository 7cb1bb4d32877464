"""LM scoring by the subword lattice likelihood of an existing unigram vocabulary.

Every segmentation of a word into pieces of the vocabulary is a path of a
lattice; a log-space forward recursion sums their probabilities. The pieces and
their first weights (a Zipf law over the rank that is a piece's score) come from
a public vocabulary file. One expectation step over all distinct training words,
weighted by their counts, then gives the piece probabilities used for scoring,
with the file's weights as a prior of ``PRIOR`` pseudo-counts. Words are
whitespace-separated, so a document's marginal is the product of its words'
marginals and of the end token's probability.

Flow: each task numbers the words of chunks of about ``CHUNK_BYTES`` of text and
writes, per document, word numbers with counts, and one vocabulary row per
chunk. One shuffle brings the rows of a word together and gives them its count;
each distinct word is taken once by the expectation step and scored once, and
counts and scores return to their chunks by number. No vocabulary of the corpus
is collected or broadcast.
"""

from __future__ import annotations

import math
from array import array
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_map, fold, table
from tidemark.session import ship, written

CHUNK_BYTES = 16 << 20
PRIOR = 1000.0
VOCABULARY = "piece_bpe_32k.model"
FOLDS, HELD_OUT = 7, 2
_MARK = "▁"


#: Characters of a word whose edges the expectation step holds at once; a longer word's are made again, block by block.
MOST_CHARS = 10_000
#: Rows of one word that meet in a window (it has one per chunk); with more chunks a word is dealt to several keys.
WORD_ROWS = 200_000


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def log_sum(terms: list[float]) -> float:
    """log of the sum of the exponentials."""
    if len(terms) == 1:
        return terms[0]
    if len(terms) == 2:
        x, y = terms
        return x + math.log1p(math.exp(y - x)) if x > y else y + math.log1p(math.exp(x - y))
    m = max(terms)
    return m + math.log(sum([math.exp(t - m) for t in terms]))


class Lattice:
    """The pieces as a trie; 256 byte pieces stand in for characters without a piece.

    A trie node is [weight or None, piece number, children].
    """

    def __init__(self, pieces: list[tuple[str, int]], logp: np.ndarray):
        self.root: list = [None, -1, {}]
        for piece, i in pieces:
            node = self.root
            for ch in piece:
                node = node[2].setdefault(ch, [None, -1, {}])
            node[0], node[1] = float(logp[i]), i
        self.bytes = [float(x) for x in logp[:256]]
        self.longest = max((len(p) for p, _ in pieces), default=1)

    def by_bytes(self, ch: str) -> float | None:
        """The weight of a character spelled in byte pieces; None if it has a piece of its own."""
        node = self.root[2].get(ch)
        if node is not None and node[0] is not None:
            return None
        return sum(self.bytes[x] for x in ch.encode("utf-8", "surrogatepass"))

    def score(self, word: str) -> float:
        """Natural logarithm of the word's marginal probability, by forward recursion."""
        return self._forward(_MARK + word, None)

    def _forward(self, s: str, alphas: array | None) -> float:
        """The log-probability of the whole; ``alphas`` takes that of each beginning."""
        n, first = len(s), self.root[2]
        terms: defaultdict[int, list[float]] = defaultdict(list)  # only places that a piece has reached and none has left
        terms[0].append(0.0)
        for i in range(n):
            alpha = log_sum(terms.pop(i))
            if alphas is not None:
                alphas.append(alpha)
            node, j = first.get(s[i]), i + 1
            if node is None or node[0] is None:
                terms[j].append(alpha + self.by_bytes(s[i]))
            while node is not None:
                if (w := node[0]) is not None:
                    terms[j].append(alpha + w)
                if j == n:
                    break
                node = node[2].get(s[j])
                j += 1
        return log_sum(terms[n])

    def expect(self, word: str, count: float, into_counts: list[float]) -> None:
        """Add the expected piece counts of ``count`` copies of the word: forward, then mass backward.

        A long word keeps a number per character, and the edges of one block.
        """
        s = _MARK + word
        if len(s) <= MOST_CHARS:
            self._expect(s, count, into_counts)
            return
        n, first = len(s), self.root[2]
        alphas = array("d")
        alphas.append(self._forward(s, alphas))
        back = array("d", bytes(8 * n))
        back.append(count)
        for top in range(n, 0, -MOST_CHARS):
            low = max(0, top - MOST_CHARS)
            edges: list[list[tuple[int, int, float]]] = [[] for _ in range(top - low)]
            for i in range(max(0, low + 1 - self.longest), top):
                node, j = first.get(s[i]), i + 1
                if (node is None or node[0] is None) and j > low:
                    edges[j - low - 1].append((i, -1, self.by_bytes(s[i])))
                while node is not None:
                    if node[0] is not None and j > low:
                        edges[j - low - 1].append((i, node[1], node[0]))
                    if j == top:
                        break
                    node = node[2].get(s[j])
                    j += 1
            for j in range(top, low, -1):
                if mass := back[j]:
                    for i, piece, w in edges[j - low - 1]:
                        share = mass * math.exp(alphas[i] + w - alphas[j])
                        back[i] += share
                        if piece >= 0:
                            into_counts[piece] += share
                        else:
                            for x in s[i].encode("utf-8", "surrogatepass"):
                                into_counts[x] += share

    def _expect(self, s: str, count: float, into_counts: list[float]) -> None:
        n, first = len(s), self.root[2]
        terms: list[list[float]] = [[] for _ in range(n + 1)]
        froms: list[list[tuple[int, int]]] = [[] for _ in range(n + 1)]  # (start, piece; -1: bytes)
        terms[0].append(0.0)
        alphas = []
        for i in range(n):
            alpha = log_sum(terms[i])
            alphas.append(alpha)
            node, j = first.get(s[i]), i + 1
            if node is None or node[0] is None:
                terms[j].append(alpha + self.by_bytes(s[i]))
                froms[j].append((i, -1))
            while node is not None:
                if (w := node[0]) is not None:
                    terms[j].append(alpha + w)
                    froms[j].append((i, node[1]))
                if j == n:
                    break
                node = node[2].get(s[j])
                j += 1
        alphas.append(log_sum(terms[n]))
        exp = math.exp
        back = [0.0] * n + [count]
        for j in range(n, 0, -1):
            if mass := back[j]:
                edges = froms[j]
                if len(edges) == 1:
                    shares = (mass,)
                else:
                    a = alphas[j]
                    shares = [mass * exp(t - a) for t in terms[j]]
                for (i, piece), share in zip(edges, shares):
                    back[i] += share
                    if piece >= 0:
                        into_counts[piece] += share
                    else:
                        for x in s[i].encode("utf-8", "surrogatepass"):
                            into_counts[x] += share


def vocabulary(name: str = VOCABULARY) -> tuple[list[tuple[str, int]], np.ndarray]:
    """(pieces with numbers, first log-probabilities); numbers 0-255 are bytes, the last is the end."""
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
    pieces, ranks = [], []
    for i in range(model.get_piece_size()):
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)) and (score := model.get_score(i)) > -1e8:
            pieces.append((model.id_to_piece(i), 256 + len(pieces)))
            ranks.append(-score)
    weights = 1 / (1 + np.concatenate([np.full(256, len(ranks)), ranks, [0.0]]))
    return pieces, np.log(weights / weights.sum())


def numbering() -> defaultdict[bytes, int]:
    """Gives each new word the next number."""
    out: defaultdict[bytes, int] = defaultdict()
    out.default_factory = out.__len__
    return out


def _chunks(chunk_bytes: int):
    names = ["chunk", "doc_id", "held_out", "n_words", "idx", "tf", "words", "counts"]
    types = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.binary()), pa.list_(pa.int64())]

    def rows(columns):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    def number(batches):
        base, part = TaskContext.get().partitionId() << 24, 0
        numbers, counts, size = numbering(), np.zeros(1 << 16, np.int64), 0

        def close():
            n = len(numbers)
            return rows([[base + part], [None], [None], [None], [None], [None], [list(numbers)], [counts[:n]]])

        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for doc_id, held, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                found = tokens(text.as_py())
                ids = np.fromiter(map(numbers.__getitem__, found), np.int32, len(found))
                idx, tf = np.unique(ids, return_counts=True)
                if len(numbers) > len(counts):
                    counts = np.concatenate([counts, np.zeros(max(len(counts), len(numbers) - len(counts)), np.int64)])
                if not held:
                    counts[idx] += tf
                for c, v in zip(out, (base + part, doc_id, held, len(found), idx, tf)):
                    c.append(v)
                size += sum(map(len, found)) + len(found)
                if size >= chunk_bytes:
                    yield rows([*out, [None] * len(out[0]), [None] * len(out[0])])
                    yield close()
                    out = [[], [], [], [], [], []]
                    part, size, numbers, counts = part + 1, 0, numbering(), np.zeros(1 << 16, np.int64)
            yield rows([*out, [None] * len(out[0]), [None] * len(out[0])])
        yield close()

    return number


CHUNK_SCHEMA = "chunk bigint, doc_id bigint, held_out boolean, n_words bigint, idx array<int>, tf array<int>, words array<binary>, counts array<bigint>"


def _expectation(pieces, logp):
    def run(batches):
        lattice, counts = Lattice(pieces, logp), [0.0] * len(logp)
        for batch in batches:
            for word, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                lattice.expect(word.decode("utf-8", "surrogatepass"), c, counts)
        counts = np.array(counts)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(counts[some])], ["piece", "n"])

    return run


def _scored(pieces, logp):
    """(of_chunk, idx, c, lp) of (word, chunk, idx, c); equal words come one after the other and are scored once."""

    def run(batches):
        lattice, last, lp = Lattice(pieces, logp), None, 0.0
        for batch in batches:
            out = []
            for word in batch.column(0).to_pylist():
                if word != last:
                    last, lp = word, lattice.score(word.decode("utf-8", "surrogatepass"))
                out.append(lp)
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), batch.column(3), pa.array(out, pa.float64())], ["of_chunk", "idx", "c", "lp"])

    return run


def _documents(n: int, v: int, ends: int, end_logp: float):
    def run(docs, words):
        size = words.num_rows
        c, lp = np.zeros(size), np.zeros(size)
        at = words.column("idx").to_numpy()
        c[at], lp[at] = words.column("c").to_numpy(), words.column("lp").to_numpy()
        norm = math.log10(n + v + 1)
        base, known = np.log10(c + 1) - norm, c > 0
        out: list[tuple] = []
        for idx, tf in zip(docs.column("idx"), docs.column("tf")):
            i, t = idx.values.to_numpy(), tf.values.to_numpy()
            out.append(((t * known[i]).sum() + (ends > 0), (t * base[i]).sum() + math.log10(ends + 1) - norm, ((t * lp[i]).sum() + end_logp) / math.log(10)))
        cols = list(zip(*out)) or [(), (), ()]
        rows = docs.num_rows
        return pa.table({"doc_id": docs.column("doc_id"), "held_out": docs.column("held_out"), "n_tokens": pa.array(docs.column("n_words").to_numpy() + 1), "n_known": pa.array(cols[0], pa.int64()), "train_tokens": pa.array([n] * rows, pa.int64()), "base_score": pa.array(cols[1], pa.float64()), "score": pa.array(cols[2], pa.float64())})

    return run


RESULT = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def counted_words(numbered: DataFrame, n_chunks: int) -> DataFrame:
    """(chunk, idx, word, n) with, for n, the word's count c over all chunks, and ``first``: one of its rows, which speaks for it.

    One shuffle brings a word's rows together, up to WORD_ROWS chunks of it; with
    more chunks they are summed up by (word, part of the chunks), the parts by
    word, and the count goes back to the parts.
    """
    parts = max(1, -(-n_chunks // WORD_ROWS))
    part = F.pmod(F.xxhash64("chunk"), F.lit(parts)).cast("int") if parts > 1 else F.lit(0)
    w = Window.partitionBy("word", "part") if parts > 1 else Window.partitionBy("word")
    summed = numbered.withColumn("part", part).withColumns({"c": F.sum("n").over(w), "first": F.row_number().over(w.orderBy("chunk", "idx")) == 1}).drop("n")
    if parts == 1:
        return written(summed.drop("part"), "words")
    summed = written(summed, "words")
    some = summed.where("first").select("word", "part", "c")
    total = some.groupBy("word").agg(F.sum("c").alias("total"), F.min("part").alias("speaker"))
    back = some.drop("c").join(total, "word")
    return written(summed.drop("c").join(back, ["word", "part"]).select("chunk", "idx", "word", F.col("total").alias("c"), (F.col("first") & (F.col("part") == F.col("speaker"))).alias("first")), "words")


def scores(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES, name: str = VOCABULARY) -> DataFrame:
    """One row per document; null and empty texts have the end token only.

    Rows with equal texts get equal scores; a null id falls into the fold of the
    text 'null'; without training rows all counts are zero; a long text or word
    is taken whole; further columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    chunks = written(arrow_map(docs.select("doc_id", (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "text"), _chunks(chunk_bytes), CHUNK_SCHEMA), "chunks")
    numbered = chunks.where("words is not null").select("chunk", F.posexplode(F.arrays_zip("words", "counts")).alias("idx", "w")).select("chunk", "idx", F.col("w.words").alias("word"), F.col("w.counts").alias("n"))
    counted = counted_words(numbered, chunks.where("words is not null").count())
    distinct_words = counted.where("first and c > 0")
    n_words, distinct = distinct_words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    ends = chunks.where("words is null and not held_out").count()
    n, v = n_words + ends, distinct + (ends > 0)
    pieces, first = vocabulary(name)
    expected = np.zeros(len(first))
    for row in arrow_map(distinct_words.select("word", "c"), _expectation(pieces, first), "piece int, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect():
        expected[row.piece] = row.n
    expected[-1] = ends
    logp = np.log((expected + PRIOR * np.exp(first)) / (expected.sum() + PRIOR))
    back = arrow_map(counted.select("word", "chunk", "idx", "c"), _scored(pieces, logp), "of_chunk bigint, idx int, c bigint, lp double")
    rows = chunks.where("words is null").select("chunk", "doc_id", "held_out", "n_words", "idx", "tf")
    return rows.groupBy("chunk").cogroup(back.groupBy("of_chunk")).applyInArrow(_documents(n, v, ends, float(logp[-1])), RESULT)


def op9_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every document, rules as in ``scores``."""
    return scores(table(spark, sf_dir, "documents"))
