"""GIF media: LZW code streams, palettes, disposal, transparency, timed frames, histograms.

Codes between two clear codes have widths that depend only on their position,
so they are cut out of the bit stream together. A code that names a table entry
stands for the output of an earlier code plus one byte, so lengths and sources
of all output bytes follow by pointer doubling, without a loop over codes.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.bytestats import encoded
from tidemark.llm.common import arrow_map, narrow, table

#: Payloads are stored in rows of this many pixels, frames of at most this many rows.
WIDTH, FRAME_ROWS, DELAY_CS = 192, 256, 10
#: Files whose frames are held at once: they are several times the texts' size.
FILES = 64
#: Bytes of frames that wait together; a larger file's frames go on in several batches.
FRAME_BYTES = 8 << 20
MOST_CODES = 4096
#: Pixels of the largest canvas or image that is decoded (RGBA: 64 MB), and of all frames of a file (1 GB); beyond, the row has an error.
MOST_PIXELS, MOST_TOTAL = 16 << 20, 256 << 20


@functools.cache
def widths(size: int, n: int = MOST_CODES) -> tuple[np.ndarray, np.ndarray]:
    """Bits of the first n codes after a clear code, and where each ends, for codes of ``size`` bits."""
    following = (1 << size) + 2 + np.maximum(np.arange(n) - 1, 0)
    bits = np.clip(np.floor(np.log2(following)).astype(np.int64) + 1, size + 1, 12)
    return bits, np.cumsum(bits)


def _cut(data: np.ndarray, at: np.ndarray, bits: np.ndarray) -> np.ndarray:
    i = at >> 3
    value = data[i].astype(np.int64) | data[i + 1].astype(np.int64) << 8 | data[i + 2].astype(np.int64) << 16
    return (value >> (at & 7)) & ((1 << bits) - 1)


def _expand(codes: np.ndarray, clear: int) -> np.ndarray:
    """The bytes of the codes of one segment; stops before a code that names no entry yet."""
    n = len(codes)
    number = np.arange(n)
    entry = codes - clear - 2
    bad = np.flatnonzero((codes >= clear) & ((entry < 0) | (entry >= number)))
    if len(bad):
        codes, entry, number, n = codes[: bad[0]], entry[: bad[0]], number[: bad[0]], int(bad[0])
    literal = codes < clear
    parent, length = np.where(literal, number, entry), np.where(literal, 0, 1)
    while True:
        further = length[parent]
        if not further.any():
            break
        length = length + further
        parent = parent[parent]
    length += 1
    start = np.cumsum(length) - length
    total = int(length.sum())
    owner = np.repeat(number, length)
    source = np.arange(total)
    copied = ~literal[owner]
    source[copied] += (start[np.where(literal, 0, entry)] - start)[owner[copied]]
    while True:
        step = source[source]
        if np.array_equal(step, source):
            break
        source = step
    return codes[owner[source]].astype(np.uint8)


def lzw_decode(data: bytes, size: int, limit: int) -> np.ndarray:
    """Up to ``limit`` bytes of an LZW stream; fewer if it ends or breaks early."""
    clear, out, have, at = 1 << size, [], 0, 0
    padded = np.frombuffer(data + b"\0\0\0", np.uint8)
    end_bits = 8 * len(data)
    while have < limit and at < end_bits:
        n = MOST_CODES
        while True:  # a table left full goes on with 12 bits
            bits, ends = widths(size, n)
            fit = int(np.searchsorted(ends, end_bits - at, side="right"))
            bits, ends = bits[:fit], at + ends[:fit]
            codes = _cut(padded, ends - bits, bits)
            special = np.flatnonzero((codes == clear) | (codes == clear + 1))
            if len(special) or fit < n or fit > limit:
                break
            n *= 4
        stop = int(special[0]) if len(special) else fit
        if stop:
            part = _expand(codes[:stop], clear)
            out.append(part)
            have += len(part)
        if not len(special) or codes[stop] == clear + 1:
            break
        at = int(ends[stop])
    return np.concatenate(out)[:limit] if out else np.zeros(0, np.uint8)


_TABLE = [0] * (MOST_CODES << 8)


def lzw_encode(data: bytes, size: int = 8) -> bytes:
    """The LZW stream of the bytes, with a clear code whenever the table is full."""
    clear = 1 << size
    parts = [np.array([clear])]
    bits_of, _ = widths(size)
    bits = [bits_of[:1]]

    def close(keys: list[int], last: list[int]) -> None:
        codes = np.array(keys + last, np.int64) >> 8
        parts.append(codes)
        bits.append(bits_of[: len(codes)])

    if data:
        table = _TABLE  # from code << 8 | byte to the longer code << 8; zeros between calls
        keys: list[int] = []
        append, following, most = keys.append, (clear + 2) << 8, MOST_CODES << 8
        w = data[0] << 8
        for c in data[1:]:
            key = w | c
            if n := table[key]:
                w = n
                continue
            append(key)
            w = c << 8
            if following < most:
                table[key] = following
                following += 256
            else:
                close(keys, [clear << 8])
                for key in keys:
                    table[key] = 0
                keys.clear()
                following = (clear + 2) << 8
        close(keys, [w, (clear + 1) << 8])
        for key in keys:
            table[key] = 0
    else:
        close([], [(clear + 1) << 8])
    values, bits = np.concatenate(parts), np.concatenate(bits)
    at = np.cumsum(bits) - bits
    value = values << (at & 7)
    out = np.zeros((int(bits.sum()) + 7) // 8 + 3, np.int64)
    for k in range(3):
        out += np.bincount((at >> 3) + k, weights=(value >> (8 * k)) & 255, minlength=len(out)).astype(np.int64)
    return out.astype(np.uint8).tobytes()[: (int(bits.sum()) + 7) // 8]


@dataclass
class Frame:
    """The canvas after one image: RGBA pixels, when it appears and for how long (milliseconds)."""

    at_ms: int
    delay_ms: int
    box: tuple[int, int, int, int]
    pixels: np.ndarray

    def histogram(self, bins: int = 8) -> list[int]:
        """Counts of red, green and blue in equal bins, opaque pixels only."""
        seen = self.pixels.reshape(-1, 4)
        if not seen[:, 3].all():
            seen = seen[seen[:, 3] > 0]
        return [n for channel in range(3) for n in np.bincount(seen[:, channel] // (256 // bins), minlength=bins).tolist()]


@dataclass
class Gif:
    width: int = 0
    height: int = 0
    frames: list[Frame] = field(default_factory=list)
    error: str | None = None


def _blocks(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while data[at]:
        parts.append(data[at + 1 : at + 1 + data[at]])
        at += 1 + data[at]
    return b"".join(parts), at + 1


@functools.lru_cache(64)
def _palette(triples: bytes) -> np.ndarray:
    colours = np.zeros((256, 4), np.uint8)
    colours[: len(triples) // 3, :3] = np.frombuffer(triples, np.uint8).reshape(-1, 3)
    colours[:, 3] = 255
    return colours


def decode(data: bytes | None, most_pixels: int = MOST_PIXELS, most_total: int = MOST_TOTAL) -> Gif:
    """All frames of a GIF, as ``drawn`` gives them one by one."""
    gif = Gif()
    gif.frames = list(drawn(data, gif, most_pixels, most_total))
    return gif


def drawn(data: bytes | None, gif: Gif, most_pixels: int = MOST_PIXELS, most_total: int = MOST_TOTAL) -> Iterator[Frame]:
    """The frames of a GIF, composed by its disposal and transparency rules; ``gif`` takes the size and, by the last frame, the error.

    Null, empty or foreign bytes give no frames and an error; a file that breaks
    off gives the frames before the break, the last filled as far as it goes; a
    code size outside 2 to 8, a canvas or image of more than ``most_pixels``, or
    frames of more than ``most_total`` pixels end the file there with an error.
    """
    if not data or data[:6] not in (b"GIF87a", b"GIF89a"):
        gif.error = "not a GIF"
        return
    try:
        gif.width, gif.height, flags = struct.unpack_from("<HHB", data, 6)
        at, shared = 13, None
        if flags & 0x80:
            n = 2 << (flags & 7)
            shared, at = _palette(data[at : at + 3 * n]), at + 3 * n
        if gif.height * gif.width > most_pixels:
            raise ValueError(f"canvas of {gif.width} x {gif.height}")
        canvas = np.zeros((gif.height, gif.width, 4), np.uint8)
        clock = delay = disposal = n_frames = 0
        transparent = -1
        while data[at] != 0x3B:
            if data[at] == 0x21:
                label = data[at + 1]
                body, at = _blocks(data, at + 2)
                if label == 0xF9 and len(body) >= 4:
                    disposal, delay = body[0] >> 2 & 7, 10 * struct.unpack_from("<H", body, 1)[0]
                    transparent = body[3] if body[0] & 1 else -1
                continue
            if data[at] != 0x2C:
                raise ValueError(f"block {data[at]}")
            x, y, w, h, flags = struct.unpack_from("<HHHHB", data, at + 1)
            at, colours = at + 10, shared
            if flags & 0x80:
                n = 2 << (flags & 7)
                colours, at = _palette(data[at : at + 3 * n]), at + 3 * n
            if colours is None:
                raise ValueError("no palette")
            size = data[at]
            if not 2 <= size <= 8:
                raise ValueError(f"code size {size}")
            if w * h > most_pixels or gif.height * gif.width * (n_frames + 1) > most_total:
                raise ValueError(f"image {n_frames} of {w} x {h}")
            stream, at = _blocks(data, at + 1)
            index = np.zeros(w * h, np.uint8)
            got = lzw_decode(stream, size, w * h)
            index[: len(got)] = got
            drawn = np.arange(w * h) < len(got)
            index, drawn = index.reshape(h, w), drawn.reshape(h, w)
            if flags & 0x40:
                order = np.concatenate([np.arange(a, h, b) for a, b in ((0, 8), (4, 8), (2, 4), (1, 2))])
                back = np.argsort(order)
                index, drawn = index[back], drawn[back]
            before = canvas.copy() if disposal == 3 else None
            rows, cols = slice(y, min(y + h, gif.height)), slice(x, min(x + w, gif.width))
            inside = (slice(0, max(0, rows.stop - y)), slice(0, max(0, cols.stop - x)))
            paint = (drawn & (index != transparent))[inside]
            if paint.all():
                canvas[rows, cols] = colours[index[inside]]
            else:
                canvas[rows, cols][paint] = colours[index[inside][paint]]
            if len(got) < w * h:
                gif.error = "short image"
            yield Frame(clock, delay, (x, y, w, h), canvas.copy())
            n_frames += 1
            clock += delay
            if disposal == 2:
                canvas[rows, cols] = 0
            elif disposal == 3:
                canvas = before
            delay = disposal = 0
            transparent = -1
    except (IndexError, ValueError, struct.error) as e:
        gif.error = gif.error or f"broken: {e}"


_GREYS = bytes(v for c in range(256) for v in (c, c, c))


def encode(payload: bytes, width: int = WIDTH, rows: int = FRAME_ROWS, delay_cs: int = DELAY_CS) -> bytes:
    """A grey GIF of the payload (a multiple of ``width``), frame after frame."""
    height = len(payload) // width
    out = [b"GIF89a", struct.pack("<HHBBB", width, min(height, rows), 0xF7, 0, 0), _GREYS]
    for at in range(0, height, rows):
        part = payload[at * width : (at + rows) * width]
        stream = lzw_encode(part)
        out.append(b"\x21\xf9\x04\x04" + struct.pack("<HBB", delay_cs, 0, 0) + struct.pack("<BHHHHB", 0x2C, 0, 0, width, len(part) // width, 0) + b"\x08")
        out += [bytes([len(b)]) + b for b in (stream[i : i + 255] for i in range(0, len(stream), 255))]
        out.append(b"\0")
    return b"".join([*out, b"\x3b"])


FRAMES = "frame int, at_ms bigint, delay_ms bigint, width int, height int, rows int, pixels binary, histogram array<bigint>, error string"


def _frames(media: str, most_total: int = MOST_TOTAL):
    def run(batches):
        for batch in batches:
            kept = [n for n in batch.schema.names if n != media]
            types = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.string()]
            rows: list[tuple] = []
            source: list[int] = []

            def out(batch=batch, kept=kept, types=types, rows=rows, source=source):
                columns = list(zip(*rows)) or [()] * 9
                take = pa.array(source, pa.int64())
                made = pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(n)).take(take) for n in kept], *[pa.array(c, t) for c, t in zip(columns, types)]], [*kept, "frame", "at_ms", "delay_ms", "width", "height", "rows", "pixels", "histogram", "error"])
                rows.clear()
                source.clear()
                return made

            held = 0
            for i, data in enumerate(batch.column(batch.schema.get_field_index(media))):
                gif, waiting = Gif(), None
                for k, f in enumerate(drawn(data.as_py(), gif, most_total=most_total)):
                    if waiting:
                        rows.append((*waiting, None))
                        source.append(i)
                    waiting = k, f.at_ms, f.delay_ms, gif.width, gif.height, f.box[3], f.pixels.tobytes(), f.histogram()
                    held += len(waiting[6])
                    if held >= FRAME_BYTES and rows:
                        yield out()
                        held = len(waiting[6])
                rows.append((*(waiting or [None] * 8), gif.error))  # the last frame tells
                source.append(i)
            yield out()

    return run


def frames(df: DataFrame, key: str, media: str) -> DataFrame:
    """One row per frame of each GIF: key, times, RGBA pixels and colour histogram (eight bins each of red, green, blue).

    What isn't a GIF, null and empty bytes have one row with a null frame and its
    error; the error of a file with frames stands in its last one; equal files and repeated rows give equal frames; what is too large is
    cut off with an error (``decode``); further columns are ignored; an empty
    table gives no rows.
    """
    kind = dict(df.dtypes)[key]
    return arrow_map(narrow(df, key, media), _frames(media), f"{key} {kind}, {FRAMES}")


def padded(text: str | None) -> tuple[bytes, int]:
    """The text's bytes with blanks up to a positive multiple of WIDTH, and their number before."""
    data = encoded(text)
    return data + b" " * (-len(data) % WIDTH if data else WIDTH), len(data)


def _media(batches):
    """(row, doc_id, n_bytes, media, media_sha256, media_bytes) of (doc_id, text): each text as a grey GIF."""
    number = itertools.count()
    names, types = ["row", "doc_id", "n_bytes", "media", "media_sha256", "media_bytes"], [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.int64()]
    for batch in batches:
        rows = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            payload, n = padded(text.as_py())
            media = encode(payload)
            rows.append((next(number), doc_id, n, media, hashlib.sha256(media).hexdigest(), len(media)))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 6, types)], names)


class _File:
    """What is told of a stored file, frame by frame."""

    def __init__(self):
        self.n = self.size = self.delay = 0
        self.sha, self.tail, self.total = hashlib.sha256(), b"", np.zeros(8, np.int64)

    def add(self, pixels: bytes, width: int, rows: int, delay: int, histogram: list[int]) -> None:
        # an image fills whole rows of its canvas; below a shorter last one the image before still shows
        part = pixels[: 4 * width * rows : 4]
        self.sha.update(part)
        self.tail = (self.tail + part[-16:])[-16:]
        self.n, self.size, self.delay = self.n + 1, self.size + len(part), self.delay + delay
        self.total += histogram[:8]


def _digests(batches):
    """One row per stored file, from its frames as ``frames`` stores them, in order; a file's frames may be in several batches."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_frames"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    here, of, seen = None, None, _File()

    def told():
        doc_id, n_bytes, media_bytes, media_sha256, width, height = of
        feature = f"{width}x{height}x{seen.n}@{seen.delay}:" + ".".join(map(str, seen.total.tolist()))
        return doc_id, n_bytes, seen.size, seen.sha.hexdigest(), zlib.crc32(seen.tail), media_bytes, media_sha256, feature, seen.n

    def made(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 9, types)], names)

    for batch in batches:
        f = {n: batch.column(batch.schema.get_field_index(n)) for n in batch.schema.names}
        plain = {n: c.to_pylist() for n, c in f.items() if n not in ("pixels",)}
        rows = []
        for i in range(batch.num_rows):
            if plain["row"][i] != here:
                if of:
                    rows.append(told())
                here, seen = plain["row"][i], _File()
                of = tuple(plain[n][i] for n in ("doc_id", "n_bytes", "media_bytes", "media_sha256", "width", "height"))
            seen.add(f["pixels"][i].as_py(), plain["width"][i], plain["rows"][i], plain["delay_ms"][i], plain["histogram"][i])
        yield made(rows)
    if of:
        yield made([told()])


def _stored(batches):
    few = (b.slice(i, FILES) for b in batches for i in range(0, b.num_rows, FILES))
    return _digests(_frames("media", 1 << 62)(_media(few)))  # our own files: all of every text


def op1_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text stored as a grey GIF, its frames read back as ``frames`` stores them, and their digest.

    Null texts are empty, so 192 blanks; long texts have many frames; equal texts
    and repeated rows give equal values; further columns are ignored.
    """
    return arrow_map(narrow(table(spark, sf_dir, "documents"), "doc_id", "text"), _stored, "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, n_frames bigint")
