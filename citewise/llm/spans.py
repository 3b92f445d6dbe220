"""Words of many texts as byte spans, and strings cut from one buffer, with numpy and Arrow only."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """True for the bytes of the closed ranges."""
    table = np.zeros(256, bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


def word_spans(inside: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first byte, one past the last) of every run of inside bytes; a text's start always ends the run before it."""
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    border = starts[(starts > 0) & (starts < len(inside))]
    opens[border] = inside[border]
    closes[border - 1] = inside[border - 1]
    return np.flatnonzero(opens), np.flatnonzero(closes) + 1


def segments(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, cut: np.ndarray, at_once: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The buffer in parts of about at_once bytes, cut after bytes of the class or between texts only: (bytes, starts, row of each start)."""
    borders = np.unique(np.concatenate([np.flatnonzero(cut[raw]) + 1, starts, [len(raw)]]))
    at, row = 0, np.arange(len(starts))
    while at < len(raw):
        i = int(np.searchsorted(borders, at + at_once, side="right")) - 1
        stop = int(borders[i]) if borders[i] > at else int(borders[i + 1])
        held = (starts < stop) & (ends > at)
        yield raw[at:stop], np.maximum(starts[held] - at, 0), row[held]
        at = stop


def gather(raw: np.ndarray, first: np.ndarray, last: np.ndarray, pad: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of the spans one after the other, their borders); pad leaves so many bytes unset after each span."""
    sizes = last - first + pad
    borders = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=borders[1:])
    if not len(raw):
        return np.zeros(borders[-1], np.uint8), borders
    kind = np.int32 if max(borders[-1], len(raw)) < 1 << 31 else np.int64
    places = np.arange(borders[-1], dtype=kind)
    places += np.repeat((first - borders[:-1]).astype(kind), sizes)
    return raw.take(places, mode="clip"), borders


def strings(data: np.ndarray, borders: np.ndarray) -> pa.Array:
    """The spans between the borders as an Arrow string array."""
    return pa.LargeStringArray.from_buffers(len(borders) - 1, pa.py_buffer(borders.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data)))


def larger_batches(batches: Iterator[pa.RecordBatch], max_bytes: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about max_bytes, so that equal rows meet before they are sent on."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= max_bytes:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if held and sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
