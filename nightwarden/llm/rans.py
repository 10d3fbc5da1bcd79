"""Token ids in compressed container files: static range asymmetric numeral system (rANS).

A container holds the ids of consecutive documents. Its frequency table is shared by all its blocks; each block is
encoded on its own, with LANES interleaved states, keeps checkpoints (lane states and stream position every CHECK
steps, from which decoding can begin) and the checksum of its ids. So containers, blocks and parts of blocks can be
decoded in parallel. Containers are rows of a table, written in ascending key order by key ranges; each knows how many
ids of its range come before it.

Null and empty texts hold the end id alone. Nulls among the keys sort first, equal keys by a hash of their text. An
empty table gives no container. A damaged block raises ValueError.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import pack, text_blocks, unpack, utf8
from .pieces import encoder
from .ranges import partitions, range_of

SCALE, LANES, BLOCK, CHECK = 20, 512, 1 << 17, 128
CONTAINER_IDS = 1 << 20
_LOW, _WORD = np.uint64(1 << 31), np.uint64(32)
_MASK = np.uint64((1 << SCALE) - 1)
_HEAD, _BLOCK = "<4sIQQ", "<IIIII"
CONTAINERS = "part int, seq int, ids_before bigint, n_ids bigint, payload binary"


def frequencies(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct ids, their frequencies out of 2**SCALE, none of them 0)."""
    symbols, counts = np.unique(ids, return_counts=True)
    room = (1 << SCALE) - len(symbols)
    if room < 0:
        raise ValueError("more distinct ids than the frequency table holds")
    f = 1 + counts * room // max(1, int(counts.sum()))
    if len(f):
        f[np.argmax(f)] += (1 << SCALE) - int(f.sum())
    return symbols, f


def encode_block(rank: np.ndarray, freq: np.ndarray, cum: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(states at step 0 and every CHECK steps after it, words read before those steps, words)."""
    steps = -(-len(rank) // LANES)
    x = np.full(LANES, _LOW)
    out, states, counts = [], [], np.zeros(steps, np.int64)
    f_all, c_all = freq[rank], cum[rank]
    for t in range(steps - 1, -1, -1):
        f, c = f_all[t * LANES:(t + 1) * LANES], c_all[t * LANES:(t + 1) * LANES]
        y = x[:len(f)]
        over = (y >> np.uint64(63 - SCALE)) >= f
        words = y[over]
        out.append(words.astype(np.uint32))
        counts[t] = len(words)
        y[over] >>= _WORD
        q = y // f
        x[:len(f)] = (q << np.uint64(SCALE)) + (y - q * f) + c
        if t % CHECK == 0:
            states.append(x.copy())
    before = np.cumsum(counts) - counts
    return np.concatenate(states[::-1]), before[::CHECK].astype(np.uint32), np.concatenate(out[::-1])


def decode_steps(x: np.ndarray, words: np.ndarray, n: int, lookup: np.ndarray, freq: np.ndarray, cum: np.ndarray) -> np.ndarray:
    """The next n ranks from lane states x; `words` begins where those states read on."""
    out, at, x = np.empty(n, np.int64), 0, x.copy()
    words = words.astype(np.uint64)
    for t in range(0, n, LANES):
        y = x[: min(LANES, n - t)]
        slot = y & _MASK
        s = lookup[slot]
        out[t: t + len(y)] = s
        y = freq[s] * (y >> np.uint64(SCALE)) + slot - cum[s]
        low = np.flatnonzero(y < _LOW)
        y[low] = y[low] << _WORD | words[at: at + len(low)]
        at += len(low)
        x[: len(y)] = y
    return out


def to_container(keys: pa.Array, ids: np.ndarray, lengths: np.ndarray) -> bytes:
    """One container: header, document table, frequency table, then each block with its directory entry."""
    symbols, f = frequencies(ids)
    freq = f.astype(np.uint64)
    cum = np.cumsum(freq) - freq
    valid = keys.is_valid().to_numpy(zero_copy_only=False).astype(np.uint8)
    docs = pack(keys.fill_null(0).to_numpy().astype(np.int64), valid, lengths.astype(np.int64))
    table = pack(symbols.astype(np.uint32), f.astype(np.uint32))
    parts = [struct.pack(_HEAD, b"RNS1", len(keys), len(docs), len(table)), docs, table]
    for start in range(0, len(ids), BLOCK):
        mine = ids[start: start + BLOCK]
        states, before, words = encode_block(np.searchsorted(symbols, mine), freq, cum)
        body = states.astype("<u8").tobytes() + before.astype("<u4").tobytes() + words.astype("<u4").tobytes()
        parts += [struct.pack(_BLOCK, len(mine), len(before), len(words), zlib.crc32(mine.astype("<u4").tobytes()), len(body)), body]
    return b"".join(parts)


class Container:
    """A container's tables; blocks, or parts of them, are decoded as they are asked for."""

    def __init__(self, payload: bytes):
        magic, self.n_docs, docs, table = struct.unpack_from(_HEAD, payload)
        if magic != b"RNS1":
            raise ValueError("not a container")
        at = struct.calcsize(_HEAD)
        self.keys, self.valid, self.lengths = unpack(payload[at: at + docs])
        symbols, f = unpack(payload[at + docs: at + docs + table])
        self.symbols, self.freq = symbols, f.astype(np.uint64)
        self.cum = np.cumsum(self.freq) - self.freq
        self.lookup = np.repeat(np.arange(len(f)), f)
        self.blocks, at, entry = [], at + docs + table, struct.calcsize(_BLOCK)
        while at < len(payload):
            self.blocks.append((at + entry, *struct.unpack_from(_BLOCK, payload, at)))
            at += entry + self.blocks[-1][-1]
        self.payload = payload

    def block(self, i: int, checkpoint: int = 0) -> np.ndarray:
        """The ids of block i, from one of its checkpoints on; a whole block is compared with its checksum."""
        at, n, checks, n_words, crc, _ = self.blocks[i]
        states = np.frombuffer(self.payload, "<u8", checks * LANES, at).reshape(checks, LANES)
        before = np.frombuffer(self.payload, "<u4", checks, at + states.nbytes)
        words = np.frombuffer(self.payload, "<u4", n_words, at + states.nbytes + before.nbytes)
        left = n - checkpoint * CHECK * LANES
        try:
            ids = self.symbols[decode_steps(states[checkpoint], words[int(before[checkpoint]):], left, self.lookup, self.freq, self.cum)]
        except (IndexError, ValueError) as e:
            raise ValueError("damaged block") from e
        if not checkpoint and zlib.crc32(ids.astype("<u4").tobytes()) != crc:
            raise ValueError("damaged block")
        return ids

    def ids(self) -> np.ndarray:
        return np.concatenate([self.block(i) for i in range(len(self.blocks))]) if self.blocks else np.zeros(0, np.uint32)


def to_containers(df: DataFrame, spec: bytes, key: str = "doc_id", text: str = "text", end: int = 0) -> DataFrame:
    """(part, seq, ids_before, n_ids, payload) of all documents, encoded, in ascending key order; key is a long."""
    shared = df.sparkSession.sparkContext.broadcast(spec)
    parts = max(1, partitions(df.sparkSession))

    def flush(part: int, seq: int, before: int, keys: list, ids: list, lengths: list) -> pa.RecordBatch:
        ids = np.concatenate(ids)
        payload = to_container(pa.concat_arrays(keys), ids, np.concatenate(lengths))
        return pa.RecordBatch.from_arrays([
            pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([before], pa.int64()),
            pa.array([len(ids)], pa.int64()), pa.array([payload], pa.binary())], ["part", "seq", "ids_before", "n_ids", "payload"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(shared.value)
        part, seq, before, n, held = None, 0, 0, 0, ([], [], [])
        for whole in text_blocks(batches):
            numbers = whole.column(2).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(numbers)) + 1), len(numbers)]
            for low, high in zip(edges, edges[1:]):
                b = whole.slice(low, high - low)
                if n and (n >= CONTAINER_IDS or numbers[low] != part):
                    yield flush(part, seq, before, *held)
                    seq, before, n, held = seq + 1, before + n, 0, ([], [], [])
                if numbers[low] != part:
                    part, seq, before = int(numbers[low]), 0, 0
                ids, at = bpe.encode(*utf8(b.column(1)))
                held[0].append(b.column(0).cast(pa.int64()))
                held[1].append(np.insert(ids, at[1:], end))
                held[2].append(np.diff(at) + 1)
                n += len(held[1][-1])
        if n:
            yield flush(part, seq, before, *held)

    rows = df.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).withColumn(
        "part", range_of(df.select(F.col(key).cast("long").alias("key")), "key", parts))
    rows = rows.repartition(parts, "part").sortWithinPartitions("part", "key", F.xxhash64("text"))
    return rows.select("key", "text", "part").mapInArrow(write, CONTAINERS)


def from_containers(containers: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, start, ids) of all documents; start counts the ids of all documents before, ids are little-endian uint32."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, before, payload in zip(*(b.column(i).to_pylist() for i in range(3))):
                c = Container(payload)
                edges = np.concatenate([[0], np.cumsum(c.lengths)])
                ids = c.ids().astype("<u4")
                n = c.n_docs
                yield pa.RecordBatch.from_arrays([
                    pa.array(c.keys, pa.int64(), mask=c.valid == 0), pa.array(np.full(n, part), pa.int32()),
                    pa.array(edges[:-1] + before, pa.int64()),
                    pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(edges * 4), pa.py_buffer(ids)]).cast(pa.binary()),
                ], ["key", "part", "start", "ids"])

    before = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per key range
    sums = containers.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__base"))
    rows = containers.select("part", "ids_before", "payload").mapInArrow(read, "key bigint, part int, start bigint, ids binary")
    return rows.join(F.broadcast(sums), "part").select(F.col("key").alias(key), (F.col("start") + F.col("__base")).alias("start"), "ids")
