"""Text columns as byte blocks inside tasks, compact array blobs, and runs of rows that share a key.

Tasks that work on text get Arrow batches. They cut them into blocks of a few megabytes and treat a block as one byte
array with document offsets, so that no Python code runs once per word. Null texts count as empty.
"""

from __future__ import annotations

import json
import struct
import sys
import types
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard

BLOCK_BYTES = 2 << 20


def worker_store() -> dict:
    """A dictionary that lives as long as the Python worker, for caches that later tasks may use."""
    return sys.modules.setdefault("_task_worker_store", types.ModuleType("_task_worker_store")).__dict__


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column as (bytes, offsets from 0); nulls are empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    low, high = int(offsets[0]), int(offsets[-1])
    data = np.frombuffer(data, np.uint8, high - low, low) if high > low else np.zeros(0, np.uint8)
    return data, offsets - low


def text_blocks(batches: Iterator[pa.RecordBatch], text: str = "text", size: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about `size` bytes of text; a longer text is a slice of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = utf8(batch.column(batch.schema.get_field_index(text)))
        start = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + size, "right")) - 1)
            yield batch.slice(start, stop - start)
            start = stop


def pack(*arrays: np.ndarray, level: int = 1) -> bytes:
    """Arrays as one compressed blob; the bytes of wider numbers are laid out plane by plane."""
    head, body = [], []
    for a in arrays:
        a = np.ascontiguousarray(a)
        head.append([a.dtype.str, len(a)])
        body.append(a.view(np.uint8).reshape(len(a), -1).T.tobytes() if a.dtype.itemsize > 1 and len(a) else a.tobytes())
    head = json.dumps(head).encode()
    return zstandard.ZstdCompressor(level=level).compress(struct.pack("<I", len(head)) + head + b"".join(body))


def unpack(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    at = 4 + struct.unpack_from("<I", raw)[0]
    out = []
    for kind, n in json.loads(raw[4:at]):
        kind = np.dtype(kind)
        planes = np.frombuffer(raw, np.uint8, n * kind.itemsize, at)
        at += n * kind.itemsize
        out.append(planes.reshape(kind.itemsize, n).T.copy().view(kind).reshape(n) if kind.itemsize > 1 else planes.view(kind))
    return out


def narrow(a: np.ndarray) -> np.ndarray:
    """Non-negative integers in the smallest unsigned type that holds them."""
    return a.astype(np.min_scalar_type(int(a.max())) if len(a) else np.uint8)


def runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[object, Iterator[dict]]]:
    """Rows of a partition sorted by `key`, one run of equal keys after the other; a run is read as a stream."""
    rows = (row for b in batches for row in _rows(b))
    row = next(rows, None)
    state = [row]

    def run(value):
        while state[0] is not None and state[0][key] == value:
            yield state[0]
            state[0] = next(rows, None)

    while state[0] is not None:
        value = state[0][key]
        yield value, (mine := run(value))
        for _ in mine:
            pass


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    for start in range(0, batch.num_rows, 64):
        yield from batch.slice(start, 64).to_pylist()


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions starts[i], starts[i] + 1, ... of all spans, one span after the other."""
    total = int(lengths.sum())
    out = np.ones(total, np.int64)
    keep = lengths > 0
    starts, lengths = starts[keep], lengths[keep]
    if total:
        at = np.cumsum(lengths)[:-1]
        out[0] = starts[0]
        out[at] = starts[1:] - (starts[:-1] + lengths[:-1] - 1)
    return np.cumsum(out)


def crc(keys) -> list[int]:
    """crc32 of each key written as text."""
    return [zlib.crc32(str(k).encode()) for k in keys]
