"""PCM WAV files as rows of samples."""

from __future__ import annotations

import io
import wave

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

KINDS = {1: (np.uint8, 128, 128.0), 2: (np.dtype("<i2"), 0, 32768.0), 4: (np.dtype("<i4"), 0, 2147483648.0)}
SCHEMA = "path string, rate int, channels int, samples array<float>, error string"


def decoded(content: bytes | None, start: float = 0.0, stop: float | None = None) -> tuple[int, int, np.ndarray]:
    """(rate, channels, mono samples in [-1, 1]) of 8, 16 or 32 bit PCM from ``start`` to ``stop`` seconds; only those frames are read."""
    with wave.open(io.BytesIO(content or b"")) as w:
        kind, zero, scale = KINDS[w.getsampwidth()]
        first = min(w.getnframes(), round(start * w.getframerate()))
        last = w.getnframes() if stop is None else min(w.getnframes(), round(stop * w.getframerate()))
        w.setpos(first)
        data = np.frombuffer(w.readframes(max(0, last - first)), kind).astype(np.float64)
        mono = ((data - zero) / scale).reshape(-1, w.getnchannels()).mean(1)
        return w.getframerate(), w.getnchannels(), mono.astype(np.float32)


def read_wav(files: DataFrame, start: float = 0.0, stop: float | None = None) -> DataFrame:
    """One row per file of (path, content); what isn't PCM WAV has an error and no samples."""

    def run(batches):
        for batch in batches:
            rows: list[tuple] = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    rows.append((path, *decoded(content, start, stop), None))
                except (wave.Error, EOFError, KeyError, ValueError) as e:
                    rows.append((path, None, None, None, f"{type(e).__name__}: {e}"))
            types = [pa.string(), pa.int32(), pa.int32(), pa.list_(pa.float32()), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 5, types)], ["path", "rate", "channels", "samples", "error"])

    return files.select("path", "content").mapInArrow(run, SCHEMA)


def encoded(samples: np.ndarray, rate: int) -> bytes:
    """16 bit mono PCM of whole numbers."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(np.asarray(samples, "<i2").tobytes())
    return out.getvalue()
