"""Packing of token sequences by Karmarkar-Karp multiway differencing.

Documents are tokenised whole and cut at multiples of the capacity; full pieces
are sequences of their own. The rest, cut into quarters of the capacity (measured
padding: 2.4 % uncut, 0.7 % in quarters), are dealt into blocks by hash and each
block is differenced: partial partitions, each a vector of window sums, are
merged two at a time, those with the largest spreads first, the large sums of
one with the small sums of the other. The windows of the last partition are
nearly equal. If one exceeds the capacity, the block is differenced again with
more windows.
"""

from __future__ import annotations

import heapq
import os
import re
import unicodedata
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_map, narrow, table
from tidemark.session import ship, written

CAPACITY, END_ID = 2048, 1
#: Pieces of one block: bounds a task's memory and the differencing's time.
BLOCK_PIECES = 1024
VOCABULARY = "byte_bpe_50k"
#: Words whose ids a worker remembers, and the longest of them; longer ones are tokenised with their text.
MOST_WORDS, WORD_CHARS = 500_000, 1000
_ENCODERS: dict[str, Encoder] = {}
#: The vocabulary's words in ASCII text.
_ASCII = re.compile(r"'(?:[sdmt]|ll|ve|re)| ?[A-Za-z]++| ?[0-9]++| ?[^\t-\r A-Za-z0-9]++|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]")
#: The vocabulary's characters for bytes: printable Latin-1 stands for itself, the others follow from 256 on.
_SHOWN = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTES = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _SHOWN)}


class Encoder:
    """Ids by the vocabulary's tokenizer, whose model is asked once for each distinct word.

    Merges never cross the words its pre-tokenizer cuts, so a text's ids are
    those of its words. Texts with a special token's string, with unassigned code
    points (on which Unicode versions differ) or with very long words go to the
    tokenizer whole.
    """

    def __init__(self, vocabulary: str = VOCABULARY):
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(f"{vocabulary}.json"))
        self.model = self.tokenizer.model
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.cut = regex.compile(public_tokenizers.PATTERN)
        self.plain: set[str] = set()
        self.clear()

    def clear(self) -> None:
        self.number: defaultdict[str, int] = defaultdict()
        self.number.default_factory = self.number.__len__
        self.known = self.total = 0
        self.start, self.size, self.flat = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), np.zeros(1 << 17, np.uint32)

    def assigned(self, text: str) -> bool:
        new = set(text) - self.plain
        if any(unicodedata.category(c) == "Cn" for c in new):
            return False
        self.plain |= new
        return True

    def learn(self, words: list[str]) -> None:
        found = [[t.id for t in self.model.tokenize(w.encode().decode("latin-1").translate(_BYTES))] for w in words]
        size = np.fromiter(map(len, found), np.int64, len(found))
        n, total = self.known + len(words), self.total + int(size.sum())
        if n > len(self.size):
            self.start, self.size = (np.concatenate([x, np.zeros(n, np.int64)]) for x in (self.start, self.size))
        if total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(total, np.uint32)])
        self.size[self.known : n], self.start[self.known : n] = size, self.total + np.cumsum(size) - size
        self.flat[self.total : total] = [i for ids in found for i in ids]
        self.known, self.total = n, total

    def __call__(self, text: str) -> np.ndarray:
        ascii_ = text.isascii()
        words = (_ASCII if ascii_ else self.cut).findall(text)
        if any(s in text for s in self.special) or not (ascii_ or self.assigned(text)) or len(max(words, key=len, default="")) > WORD_CHARS:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
        if self.known > MOST_WORDS:
            self.clear()
        at = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
        if len(self.number) > self.known:
            new, first = np.unique(at, return_index=True)
            self.learn([words[i] for i in first[new >= self.known].tolist()])
        size = self.size[at]
        return self.flat[np.repeat(self.start[at] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))]


def encoder(vocabulary: str = VOCABULARY) -> Encoder:
    """This process's encoder of the vocabulary."""
    if vocabulary not in _ENCODERS:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # one core a task
        _ENCODERS[vocabulary] = Encoder(vocabulary)
    return _ENCODERS[vocabulary]


def cuts(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n ids: full sequences, then quarters."""
    full, step = n - n % capacity, max(1, capacity // 4)
    return [(at, capacity) for at in range(0, full, capacity)] + [(at, min(step, n - at)) for at in range(full, n, step)]


def _pieces(capacity: int, vocabulary: str):
    def cut(batches):
        encode = encoder(vocabulary)
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.append(encode(text.as_py() or ""), np.uint32(END_ID)).astype("<u4")
                out += [(doc_id, start, length, zlib.crc32(ids[start : start + length].tobytes()), len(ids)) for start, length in cuts(len(ids), capacity)]
            columns = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return cut


def difference(lengths: np.ndarray, windows: int) -> tuple[np.ndarray, np.ndarray]:
    """The window of each item after multiway differencing, and the windows' sums.

    A partial partition holds its non-zero sums in ascending order, and for each
    the group of items behind it; groups are chained by the last item's link.
    """
    n = len(lengths)
    link = np.full(n, -1, np.int64)
    # A group is (head, tail); partial partitions: -spread, order, sums, heads, tails.
    heap = [(-int(x), i, np.array([x], np.int64), np.array([i]), np.array([i])) for i, x in enumerate(lengths)]
    heapq.heapify(heap)
    order = n
    while len(heap) > 1:
        _, _, s1, h1, t1 = heapq.heappop(heap)
        _, _, s2, h2, t2 = heapq.heappop(heap)
        both = len(s1) + len(s2) - windows
        if both > 0:  # each padded with zeros, one ascending and one descending: the least non-zero sums meet
            s = np.concatenate([s1[:both] + s2[:both][::-1], s1[both:], s2[both:]])
            link[t1[:both]] = h2[:both][::-1]
            h = np.concatenate([h1, h2[both:]])
            t = np.concatenate([t2[:both][::-1], t1[both:], t2[both:]])
        else:
            s, h, t = np.concatenate([s1, s2]), np.concatenate([h1, h2]), np.concatenate([t1, t2])
        at = np.argsort(s, kind="stable")
        s, h, t = s[at], h[at], t[at]
        spread = int(s[-1]) - (int(s[0]) if len(s) == windows else 0)
        heapq.heappush(heap, (-spread, order, s, h, t))
        order += 1
    window = np.zeros(n, np.int64)
    if not n:
        return window, np.zeros(0, np.int64)
    _, _, sums, heads, _ = heap[0]
    for w, item in enumerate(heads.tolist()):
        while item >= 0:
            window[item] = w
            item = int(link[item])
    return window, sums


def pack(lengths: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """The window of each item; no window exceeds the capacity."""
    window = np.zeros(len(lengths), np.int64)
    full = lengths >= capacity
    rest = np.flatnonzero(~full)
    windows = max(1, -(-int(lengths[rest].sum()) // capacity))
    while len(rest):
        found, sums = difference(lengths[rest], windows)
        if sums[-1] <= capacity:
            window[rest] = found
            break
        windows += 1
    window[full] = windows + np.arange(int(full.sum()))
    return window


def _pack_block(capacity: int):
    def run(key, block):
        block = block.sort_by([("length", "descending"), ("ids_crc32", "ascending"), ("doc_id", "ascending"), ("start", "ascending")])
        lengths = block.column("length").to_numpy()
        window = pack(lengths, capacity)
        at = np.argsort(window, kind="stable")
        before = np.cumsum(lengths[at]) - lengths[at]
        first = np.concatenate(([True], window[at][1:] != window[at][:-1]))
        offset = np.empty(len(at), np.int64)
        offset[at] = before - np.maximum.accumulate(np.where(first, before, 0))
        return block.drop_columns(["block"]).append_column("sequence_id", pa.array((key[0].as_py() << 32) + window)).append_column("offset", pa.array(offset))

    return run


PIECE = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"


def packed(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per piece, with the sequence it lies in and its offset there.

    A null or empty text is the end id alone. Null ids, repeated rows and equal
    texts are packed like any other rows; an empty table gives no pieces.
    """
    spark = docs.sparkSession
    ship(spark)
    pieces = written(arrow_map(narrow(docs, "doc_id", "text"), _pieces(capacity, vocabulary), PIECE), "pieces")
    blocks = max(1, -(-pieces.count() // BLOCK_PIECES))
    # by place in the written table, not by content: equal rows spread over the blocks
    dealt = pieces.withColumn("block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)))
    return dealt.groupBy("block").applyInArrow(_pack_block(capacity), f"{PIECE}, sequence_id bigint, offset bigint")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2,048 ids, rules as in ``packed``."""
    return packed(table(spark, sf_dir, "documents"))
