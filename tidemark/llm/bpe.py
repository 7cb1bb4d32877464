"""Byte-pair encoding by a pair occurrence index, and decoding.

The new distinct words of a batch are laid out side by side as symbols. An index
holds, for each pair of symbols that the vocabulary merges, all its places in
that layout. Pairs are applied in ascending order of rank, each at all its places
at once from left to right; a merge links its neighbours anew and adds the places
of the pairs that it makes to their lists. Places whose symbols have changed
meanwhile are passed over. A merge only ever makes pairs of a higher rank
(checked when the vocabulary is read), so no applied rank comes back.

Merges never cross words, so a text's ids are those of its words, and each
distinct word is encoded once per worker. Normalisation is the vocabulary's own;
its word pattern is written out below, and texts with code points that Unicode
versions classify differently go through the vocabulary's own splitter.
"""

from __future__ import annotations

import functools
import heapq
import json
import os
import re
import unicodedata
from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_map, table

VOCABULARY = "word_bpe_49k"
#: Characters of a text that are cut into words at once; cuts stand before white space, which no word holds.
SLICE = 1 << 20
#: Words whose ids a worker remembers, and symbols of one index (a longer word has an index of its own).
MOST_WORDS, INDEX_SYMBOLS = 200_000, 1 << 20

# The vocabulary's word pattern (for ASCII, and for all text) and its characters for bytes.
_ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]++|[0-9]|[^\t-\r a-z0-9]++")
_ANY = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}++|\p{N}|[^\p{White_Space}\p{L}\p{N}]++"
_SHOWN = {*range(33, 127), *range(161, 173), *range(174, 256)}
_SPACE = re.compile(r"[\t-\r ]")

_GAP, _GONE = -1, -2
_ENCODERS: dict[str, Encoder] = {}


class PairIndex:
    """Merges the symbols of many words at once."""

    def __init__(self, parts: list[tuple[int, int]], products: list[int]):
        self.parts, self.products = parts, products
        self.rank = {a << 16 | b: r for r, (a, b) in enumerate(parts)}
        order = np.argsort([a << 16 | b for a, b in parts])
        self.keys, self.ranks = np.array([a << 16 | b for a, b in parts], np.int64)[order], order
        made = {ab: r for r, ab in enumerate(products)}
        if len(made) < len(products) or any(max(made.get(a, -1), made.get(b, -1)) >= r for r, (a, b) in enumerate(parts)):
            raise ValueError("a merge uses a symbol that is made later, or two merges make the same")

    def places(self, symbols: np.ndarray) -> dict[int, array]:
        """Rank of each mergeable pair -> its places, ascending."""
        keys = symbols[:-1].astype(np.int64) << 16 | symbols[1:]
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        hit = np.flatnonzero((self.keys[at] == keys) & (symbols[:-1] >= 0) & (symbols[1:] >= 0))
        ranks = self.ranks[at[hit]]
        order = np.argsort(ranks, kind="stable")
        kinds, first = np.unique(ranks[order], return_index=True)
        return {int(r): array("i", p.astype("i").tobytes()) for r, p in zip(kinds, np.split(hit[order], first[1:]))}

    def merge(self, symbols: np.ndarray) -> np.ndarray:
        """The symbols after all merges; words are divided by gaps, which stay, and end with one."""
        n = len(symbols)
        index: defaultdict[int, array] = defaultdict(lambda: array("i"), self.places(symbols))
        sym = array("i", symbols.astype("i").tobytes())
        after, before = array("i", range(1, n + 1)), array("i", range(-1, n - 1))
        active = list(index)
        heapq.heapify(active)
        rank = self.rank.get
        while active:
            r = heapq.heappop(active)
            (a, b), ab = self.parts[r], self.products[r]
            for p in sorted(index.pop(r)):  # lists grow in turn by several ranks
                q = after[p]
                if sym[p] != a or sym[q] != b:
                    continue
                z, y = after[q], before[p]
                sym[p], sym[q], after[p], before[z] = ab, _GONE, z, p
                for left, right, place in ((sym[y] if y >= 0 else _GAP, ab, y), (ab, sym[z], p)):
                    if left >= 0 and right >= 0 and (s := rank(left << 16 | right)) is not None:
                        if s not in index:
                            heapq.heappush(active, s)
                        index[s].append(place)
        out = np.frombuffer(sym, "i")
        return out[out != _GONE]


class Numbers(dict):
    """Gives each new word the next number and notes it."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n


class Encoder:
    """Ids of texts; remembers the ids of words."""

    def __init__(self, name: str = VOCABULARY):
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        path = public_tokenizers.path(f"{name}.json")
        tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        ids, suffix = model["vocab"], model["end_of_word_suffix"]
        pairs = [(x.split(" ") if isinstance(x, str) else x) for x in model["merges"]]
        self.index = PairIndex([(ids[a], ids[b]) for a, b in pairs], [ids[a + b] for a, b in pairs])
        shown = iter(range(256, 512))
        letters = [chr(x if x in _SHOWN else next(shown)) for x in range(256)]
        self.inner, self.last = (np.array([ids[c + end] for c in letters], np.int32) for end in ("", suffix))
        self.normalize, self.split = tokenizer.normalizer.normalize_str, tokenizer.pre_tokenizer.pre_tokenize_str
        self.special = {t.content: i for i, t in tokenizer.get_added_tokens_decoder().items()}
        self.cut_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.cut = regex.compile(_ANY)
        self.plain: set[str] = set()
        self.clear()

    def clear(self) -> None:
        self.number = Numbers()
        self.ends, self.flat, self.known, self.total = np.zeros(1 << 16, np.int64), np.zeros(1 << 17, np.uint32), 0, 0

    def merged(self, words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids, number of ids of each word) of blocks of the words."""
        at = 0
        while at < len(words):
            block, size = [], 0
            while at < len(words) and (not block or size + len(words[at]) <= INDEX_SYMBOLS):
                block.append(words[at].encode())
                size += len(block[-1]) + 1
                at += 1
            ends = np.cumsum([len(w) + 1 for w in block])
            raw = np.frombuffer(b"\0".join([*block, b""]), np.uint8)
            symbols = self.inner[raw]
            symbols[ends - 2], symbols[ends - 1] = self.last[raw[ends - 2]], _GAP
            out = self.index.merge(symbols)
            gaps = np.flatnonzero(out == _GAP)
            yield out[out != _GAP].astype(np.uint32), np.diff(gaps, prepend=-1) - 1

    def learn(self) -> None:
        """Encode the words met since the last call."""
        for ids, sizes in self.merged(self.number.new):
            n, total = self.known + len(sizes), self.total + len(ids)
            if n >= len(self.ends):
                self.ends = np.concatenate([self.ends, np.zeros(n, np.int64)])
            if total > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros(total, np.uint32)])
            self.ends[self.known + 1 : n + 1] = self.total + np.cumsum(sizes)
            self.flat[self.total : total] = ids
            self.known, self.total = n, total
        self.number.new = []

    def words(self, text: str) -> list[str]:
        if text.isascii():
            return _ASCII.findall(text.lower())
        new = set(text) - self.plain
        known = not any(unicodedata.category(c) == "Cn" for c in new)
        text = self.normalize(text)
        if known:
            self.plain |= new
            return self.cut.findall(text)
        return [text[a:b] for _, (a, b) in self.split(text)]

    def slices(self, text: str) -> Iterator[str]:
        """Special tokens, and what stands between them in slices."""
        for part in self.cut_special.split(text) if any(s in text for s in self.special) else [text]:
            at = 0
            while at < len(part):
                space = None if part in self.special else _SPACE.search(part, at + SLICE)
                end = space.start() if space else len(part)
                yield part[at:end]
                at = end

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text; the new words of about SLICE characters share an index."""
        out: list[list[bytes]] = [[] for _ in texts]
        waiting: list[tuple[int, np.ndarray]] = []
        size = 0

        def settle() -> None:
            self.learn()
            for i, number in waiting:
                if number.dtype != np.int64:  # a special token's id
                    out[i].append(number.tobytes())
                    continue
                start = self.ends[number]
                n = self.ends[number + 1] - start
                out[i].append(self.flat[np.repeat(start - np.cumsum(n) + n, n) + np.arange(int(n.sum()))].astype("<u4").tobytes())
            waiting.clear()
            if self.known > MOST_WORDS:
                self.clear()

        for i, text in enumerate(texts):
            for part in self.slices(text):
                if part in self.special:
                    waiting.append((i, np.array([self.special[part]], "<u4")))
                    continue
                words = self.words(part)
                waiting.append((i, np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))))
                size += len(part)
                if size >= SLICE:
                    settle()
                    size = 0
        settle()
        return [b"".join(x) for x in out]


def decode(ids: bytes, names: list[str]) -> str:
    """The names of the ids with a space between; ids without a name say nothing."""
    return " ".join(filter(None, [names[i] if i < len(names) else "" for i in np.frombuffer(ids, "<u4").tolist()]))


@functools.lru_cache(2)
def token_names(vocabulary: str = VOCABULARY) -> list[str]:
    """The vocabulary's tokens by id, special ones too; all that decoding needs of the file."""
    import public_tokenizers

    with open(public_tokenizers.path(f"{vocabulary}.json"), encoding="utf-8") as f:
        found = json.load(f)
    named = found["model"]["vocab"] | {t["content"]: t["id"] for t in found["added_tokens"]}
    names = [""] * (max(named.values()) + 1)
    for token, i in named.items():
        names[i] = token
    return names


def encoder(name: str = VOCABULARY) -> Encoder:
    """This process's encoder of the vocabulary."""
    if name not in _ENCODERS:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # one core a task
        _ENCODERS[name] = Encoder(name)
    return _ENCODERS[name]


def encoded(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, ids): each text's ids as little-endian unsigned 32-bit integers.

    A null or empty text, and one of white space, has no ids. A special token's
    string in a text is that token. Repeated rows, ties and null ids stay rows of
    their own; long texts are cut into slices at white space and long words have
    an index of their own; an empty table gives no rows; further columns are ignored.
    """

    def run(batches):
        encode = encoder(vocabulary).encode
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(encode([t or "" for t in batch.column(1).to_pylist()]), pa.binary())], ["doc_id", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return arrow_map(docs.select("doc_id", "text"), run, f"doc_id {kind}, ids binary")


def decoded(ids: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, ids, text): the tokens' names with a space between, as the library decodes without a decoder.

    Special tokens show their names; ids outside the vocabulary say nothing; null ids give an empty text.
    """

    def run(batches):
        names = token_names(vocabulary)
        for batch in batches:
            texts = [decode(x.as_py() or b"", names) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["doc_id", "ids", "text"])

    kind = ids.schema["doc_id"].dataType.simpleString()
    return arrow_map(ids.select("doc_id", "ids"), run, f"doc_id {kind}, ids binary, text string")


def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document and the texts they decode to, as counts and digests; rules as in ``encoded`` and ``decoded``."""
    back = decoded(encoded(table(spark, sf_dir, "documents")))
    return back.select("doc_id", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))
