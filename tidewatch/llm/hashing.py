"""64-bit hashes of many byte ranges at once, with numpy: prefix sums of a polynomial, then a mix of the bits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once.
CHUNK = 1 << 19

_rng = np.random.default_rng(20240229)
BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
STEP = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(int(STEP), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(step: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, step, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


_UP, _DOWN = _powers(STEP, CHUNK), _powers(_BACK, CHUNK)


def _hashed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    n = len(data)
    up, down = (_UP, _DOWN) if n <= CHUNK else (_powers(STEP, n), _powers(_BACK, n))
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTE[data] * up[:n], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts])


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of data[starts[i]:ends[i]], ranges in order and not empty; about CHUNK bytes at a time, so memory is bounded
    by the longest range."""
    if len(data) <= CHUNK:
        return _hashed(data, starts, ends)
    out, a = [np.zeros(0, np.uint64)], 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + CHUNK, "right")))
        low, high = int(starts[a]), int(ends[b - 1])
        out.append(_hashed(data[low:high], starts[a:b] - low, ends[a:b] - low))
        a = b
    return np.concatenate(out)


def text_chunks(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, begins) of pieces of a batch with a text column, about CHUNK bytes each, straight from
    Arrow's buffers; null texts are empty."""
    text = batch.column("text").cast(pa.large_string()).fill_null("")
    if not len(text):
        return
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    data = np.frombuffer(text.buffers()[2] or b"", np.uint8)
    row = 0
    while row < len(text):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK, "right")) - 1)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row:end] - offsets[row]
        row = end


def gathered(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions starts[0], starts[0] + 1, ... of all ranges, one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)
