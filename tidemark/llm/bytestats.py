"""Byte features of many whole texts at once, in groups of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes of one group of texts, and of one slice of a longer text.
GROUP_BYTES = 512 << 10
_SLOT = np.uint64(0x9E3779B97F4A7C15)
#: One multiplier for each position in a word, repeating after 64 bytes.
_ROUND = np.cumsum(np.full(64, _SLOT, np.uint64)) | np.uint64(1)


def encoded(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def groups(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """(from, to) of runs of texts of at most GROUP_BYTES."""
    at = size = 0
    for i, t in enumerate(texts):
        if i > at and size + len(t) > GROUP_BYTES:
            yield at, i
            at, size = i, 0
        size += len(t)
    if at < len(texts):
        yield at, len(texts)


def slices(text: bytes, step: int = GROUP_BYTES) -> list[bytes]:
    return [text[at : at + step] for at in range(0, len(text), step)] or [text]


def joined(texts: list[bytes], gap: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, each followed by ``gap``, and the number of each byte's text."""
    data = np.frombuffer(gap.join([*texts, b""]), np.uint8)
    owner = np.repeat(np.arange(len(texts)), [len(t) + len(gap) for t in texts])
    return data, owner


def ngram_counts(texts: list[bytes], buckets: int) -> np.ndarray:
    """Hashed counts of 1-, 2- and 3-grams of bytes; a text's end counts as two zero bytes. A long text is counted in slices."""
    if len(texts) == 1 and len(texts[0]) > GROUP_BYTES:
        total = np.zeros((1, buckets), np.int64)
        for at in range(0, len(texts[0]), GROUP_BYTES):
            both = texts[0][at : at + GROUP_BYTES + 2]  # the grams that begin in the two bytes beyond count with the next slice
            total += _ngram_counts([both], buckets) - (_ngram_counts([both[GROUP_BYTES:]], buckets) if len(both) > GROUP_BYTES else 0)
        return total
    return _ngram_counts(texts, buckets)


def _ngram_counts(texts: list[bytes], buckets: int) -> np.ndarray:
    data, owner = joined(texts, b"\0\0")
    x = data.astype(np.uint32)
    inside = np.flatnonzero(data)
    inside = inside[inside < len(x) - 2]
    one, own = x[inside], owner[inside]
    two = one << np.uint32(8) | x[inside + 1]
    three = two << np.uint32(8) | x[inside + 2]
    out = np.zeros(len(texts) * buckets, np.int64)
    for salt, grams in ((1, one), (2, two), (3, three)):
        h = (grams + np.uint32(salt << 24)) * np.uint32(0x9E3779B1)
        h = (h >> np.uint32(15)) % np.uint32(buckets)
        out += np.bincount(own * buckets + h, minlength=len(out))
    return out.reshape(len(texts), buckets)


#: Byte classes: each ASCII punctuation mark by itself, then letters, digits, spaces and the rest.
_PUNCTUATION = [c for c in range(33, 127) if not chr(c).isalnum()]
CLASSES = len(_PUNCTUATION) + 7
_CLASS = np.full(256, CLASSES - 1, np.uint8)
for _i, _c in enumerate(_PUNCTUATION):
    _CLASS[_c] = _i
for _name, _bytes in enumerate((range(97, 123), range(65, 91), range(48, 58), [32, 9], [10, 13], range(128, 256))):
    _CLASS[list(_bytes)] = len(_PUNCTUATION) + _name
#: Coarse classes for pairs: all punctuation is one.
COARSE = 8
_COARSE = np.where(_CLASS < len(_PUNCTUATION), 0, _CLASS - len(_PUNCTUATION) + 1).astype(np.uint8)
PASSAGE_BYTES = 512
WORDS = 4
FEATURES = CLASSES + COARSE * COARSE + WORDS


def passages(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Features of every passage (PASSAGE_BYTES of a text, at least one), and passages of each text.

    A long text is read in slices of whole passages.
    """
    if len(texts) == 1 and len(texts[0]) > GROUP_BYTES:
        parts = [_passages([part])[0] for part in slices(texts[0])]
        return np.concatenate(parts), np.array([sum(map(len, parts))])
    return _passages(texts)


def _passages(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    data, owner = joined(texts, b"\n")
    length = np.array([len(t) + 1 for t in texts])
    start = np.cumsum(length) - length
    count = np.maximum(1, -(-(length - 1) // PASSAGE_BYTES))
    first = np.cumsum(count) - count
    within = np.arange(len(data)) - start[owner]
    passage = first[owner] + np.minimum(within // PASSAGE_BYTES, count[owner] - 1)
    n = int(count.sum())
    kind = _CLASS[data]
    size = np.bincount(passage, minlength=n)[:, None]
    classes = np.bincount(passage * CLASSES + kind, minlength=n * CLASSES).reshape(n, CLASSES) / size
    coarse = _COARSE[data].astype(np.int64)
    pairs = np.bincount(passage[1:] * COARSE**2 + coarse[:-1] * COARSE + coarse[1:], minlength=n * COARSE**2)[: n * COARSE**2].reshape(n, -1) / size
    space = (data == 32) | ((data >= 9) & (data <= 13))
    begins = np.flatnonzero(~space & np.concatenate(([True], space[:-1])))
    words = np.zeros((n, WORDS))
    if len(begins):
        at = np.cumsum(np.bincount(begins, minlength=len(data))) - 1
        inner = np.flatnonzero(~space)
        slot = (inner - begins[at[inner]]) & 63
        value = (data[inner].astype(np.uint64) + np.uint64(1)) * _ROUND[slot]
        value ^= value >> np.uint64(31)
        bounds = np.searchsorted(inner, begins)
        hashes = np.add.reduceat(value * _SLOT, bounds)
        lengths = np.diff(np.concatenate((bounds, [len(inner)])))
        where, own = passage[begins], owner[begins]
        total = np.maximum(1, np.bincount(where, minlength=n))
        for i, gap in enumerate((1, 2)):
            same = np.flatnonzero((hashes[gap:] == hashes[:-gap]) & (own[gap:] == own[:-gap])) + gap
            words[:, i] = np.bincount(where[same], minlength=n) / total
        words[:, 2] = np.minimum(np.bincount(where, weights=lengths, minlength=n) / total, 40) / 40
        words[:, 3] = np.bincount(where, weights=lengths == 1, minlength=n) / total
    return np.concatenate([np.sqrt(classes), np.sqrt(pairs), words], axis=1).astype(np.float32), count
