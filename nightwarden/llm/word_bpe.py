"""BPE encoding over a distinct-word table, and decoding through an id-to-piece join.

Text blocks are split into words (the tokenizer's pre-tokens). A block sends each distinct word once to the bucket of
its hash, where every distinct word is encoded once; the ids come back to the block, which puts them at the positions
of its words. What moves is one position list and one distinct-word list per block, compressed. Decoding joins ids
with the vocabulary's pieces (a table of fixed size that every task holds).

Ids equal those of the tokenizers library with add_special_tokens=False; special tokens in a text become their ids.
Null and empty texts have no ids. Repeated rows, and rows with equal keys, are encoded each. An empty table gives an
empty result. Other columns are left out; names of theirs never clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .blocks import narrow, pack, runs, spread, text_blocks, unpack, utf8
from .pieces import encoder
from .ranges import partitions
from .words import hash_spans

SPLIT_BYTES = 8 << 20
FEW, LEVEL = 240, 9
_ROWS = "target int, chunk bigint, kind int, blob binary"
_NAMES = ["target", "chunk", "kind", "blob"]
_POSITIONS, _WORDS = 0, 1


def _ranked(rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranks in two streams, a byte for each and the rest of those that need more; they pack better than wide numbers."""
    return np.minimum(rank, FEW).astype(np.uint8), narrow(rank[rank >= FEW] - FEW)


def _from_ranked(low: np.ndarray, rest: np.ndarray) -> np.ndarray:
    rank = low.astype(np.int64)
    rank[low == FEW] += rest
    return rank


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int64(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], _NAMES)


def _binaries(flat: np.ndarray, edges: np.ndarray) -> pa.Array:
    """Little-endian unsigned 32-bit integers, one binary for each document."""
    at = np.ascontiguousarray(edges, np.int64) * 4
    flat = np.ascontiguousarray(flat, "<u4")
    return pa.Array.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(at), pa.py_buffer(flat)]).cast(pa.binary())


def encode(df: DataFrame, spec: bytes, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids): ids as little-endian unsigned 32-bit integers; key is a long."""
    shared = df.sparkSession.sparkContext.broadcast(spec)
    buckets = max(1, partitions(df.sparkSession))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, task = encoder(shared.value), TaskContext.get().partitionId()
        for i, b in enumerate(text_blocks(batches, size=SPLIT_BYTES)):
            data, offsets = utf8(b.column(1))
            starts, _ = bpe.split(data, offsets)
            ends = np.append(starts[1:], len(data)) if len(starts) else starts
            words, first, back, count = np.unique(hash_spans(data, starts, ends), return_index=True, return_inverse=True, return_counts=True)
            rank = np.empty(len(words), np.int64)
            rank[np.argsort(-count, kind="stable")] = np.arange(len(words))
            keys = b.column(0)
            chunk = task << 32 | i
            rows = [(chunk % buckets, chunk, _POSITIONS, pack(
                keys.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), keys.is_valid().to_numpy(zero_copy_only=False).astype(np.uint8),
                np.searchsorted(starts, offsets), *_ranked(rank[back]), level=LEVEL))]
            bucket = (words % np.uint64(buckets)).astype(np.int64)
            by = np.argsort(bucket, kind="stable")
            edges = np.searchsorted(bucket[by], np.arange(buckets + 1))
            s, n = starts[first], (ends - starts)[first]
            for k in range(buckets):
                mine = by[edges[k]: edges[k + 1]]
                if len(mine):
                    mine = mine[np.argsort(rank[mine])]
                    rows.append((k, chunk, _WORDS, pack(narrow(np.diff(rank[mine], prepend=0)), narrow(n[mine]), data[spread(s[mine], n[mine])], level=LEVEL)))
            yield _batch(rows)

    def encode_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, known = encoder(shared.value), {}
        special = dict(bpe.special)
        for b in batches:
            for row in (r for start in range(0, b.num_rows, 64) for r in b.slice(start, 64).to_pylist()):
                if row["kind"] == _POSITIONS:
                    yield _batch([tuple(row[c] for c in _NAMES)])
                    continue
                steps, sizes, raw = unpack(row["blob"])
                raw, at, ids, count = raw.tobytes(), 0, [], []
                for n in sizes.tolist():
                    word = raw[at: at + n]
                    at += n
                    if word not in known:
                        known[word] = [special[word]] if word in special else bpe.encode_piece(word)
                    mine = known[word]
                    ids += mine
                    count.append(len(mine))
                blob = pack(steps, narrow(np.array(count, np.int64)), narrow(np.array(ids, np.int64)), level=LEVEL)
                yield _batch([(row["target"], row["chunk"], _WORDS, blob)])

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in runs(batches, "chunk"):
            keys, valid, edges, low, rest = unpack(next(rows)["blob"])
            back = _from_ranked(low, rest)
            size = int(back.max()) + 1 if len(back) else 0
            at, count, flat, total = np.zeros(size, np.int64), np.zeros(size, np.int64), [], 0
            for row in rows:
                steps, n, ids = unpack(row["blob"])
                rank, n = np.cumsum(steps.astype(np.int64)), n.astype(np.int64)
                at[rank], count[rank] = total + np.cumsum(n) - n, n
                flat.append(ids.astype(np.uint32))
                total += len(ids)
            flat = np.concatenate(flat) if flat else np.zeros(0, np.uint32)
            before = np.concatenate([[0], np.cumsum(count[back])])
            low = 0
            while low < len(keys):  # about SPLIT_BYTES of ids at a time
                high = max(low + 1, int(np.searchsorted(before[edges], before[edges[low]] + SPLIT_BYTES // 4, "right")) - 1)
                mine = back[edges[low]: edges[high]]
                ids = flat[spread(at[mine], count[mine])]
                yield pa.RecordBatch.from_arrays([
                    pa.array(keys[low:high], pa.int64(), mask=valid[low:high] == 0),
                    _binaries(ids, before[edges[low: high + 1]] - before[edges[low]])], [key, "ids"])
                low = high

    rows = df.selectExpr(f"CAST(`{key}` AS BIGINT) AS key", f"`{text}` AS text").mapInArrow(split, _ROWS)
    rows = rows.repartition(buckets, "target").mapInArrow(encode_words, _ROWS)
    rows = rows.repartition(buckets, "chunk").sortWithinPartitions("chunk", "kind")
    return rows.mapInArrow(assemble, f"`{key}` bigint, ids binary")


def decode(df: DataFrame, spec: bytes, ids: str = "ids", out: str = "text") -> DataFrame:
    """All columns of df and the text of its ids; null ids give an empty text. A column named `out` is replaced."""
    df = df.drop(out) if ids != out else df
    shared = df.sparkSession.sparkContext.broadcast(spec)
    where = df.columns.index(ids)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(shared.value)
        for whole in batches:
            for start in range(0, whole.num_rows, 1024):
                b = whole.slice(start, 1024)
                rows = [x or b"" for x in b.column(where).to_pylist()]
                edges = np.concatenate([[0], np.cumsum([len(x) // 4 for x in rows])]).astype(np.int64)
                data, at = bpe.decode(np.frombuffer(b"".join(rows), "<u4"), edges)
                raw, at = data.tobytes(), at.tolist()
                texts = [raw[low:high].decode("utf-8", "replace") for low, high in zip(at, at[1:])]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], [*b.schema.names, out])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), f"`{out}` string"])
    return df.mapInArrow(join, schema)
