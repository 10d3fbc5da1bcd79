"""Token sequences of bounded length packed from documents by vector best-fit.

A document becomes pieces: its token ids and the end id, cut into `limit` tokens only where it is longer (the first
piece takes the remainder). Pieces go into sequences under three capacities: tokens, number of pieces, and attention
cost (the sum of squared piece lengths). Pieces are placed by falling length; of all open sequences that keep every
capacity, the one with the smallest weighted residual norm afterwards is taken (or, with rule "dot", the largest weighted
dot product of demand and residual). By default the piece capacity is the token limit and the cost capacity its square, so
they weigh in the choice but cost no sequence; smaller ones bind. Packing runs in independent groups of thousands of
pieces, dealt by hash, so no task sees the whole; each group leaves at most a few open sequences.

Null and empty texts give one piece that holds the end id alone. Repeated rows are packed each. Ties: the sequence opened
first; pieces of one length in the order of their columns. An empty table gives an empty result. Input columns named
like an output are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import text_blocks, utf8
from .pieces import encoder

GROUP_PIECES = 8192
GROUP_SEQUENCES = 1024
TOKEN_BYTES = 4  # about so many bytes of text make a token; only the size of groups depends on it
WEIGHTS = (1.0, 1.0, 1.0)
PIECE_SCHEMA = "piece int, start bigint, length bigint, ids binary"


def token_pieces(df: DataFrame, spec: bytes, key: str = "doc_id", text: str = "text", limit: int = 1024, end: int = 2) -> DataFrame:
    """(key, piece, start, length, ids): ids as little-endian unsigned 32-bit integers."""
    shared = df.sparkSession.sparkContext.broadcast(spec)
    kind = df.schema[key].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(shared.value)
        for b in text_blocks(batches):
            ids, edges = bpe.encode(*utf8(b.column(1)))
            n = len(edges) - 1
            ids = np.insert(ids.astype(np.uint32), edges[1:], end)
            edges = edges + np.arange(n + 1)
            length = np.diff(edges)
            count = -(-length // limit)
            doc = np.repeat(np.arange(n), count)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
            short = (length - 1) % limit + 1
            start = np.where(piece == 0, 0, short[doc] + (piece - 1) * limit)
            size = np.where(piece == 0, short[doc], limit)
            at = np.append(edges[:-1][doc] + start, len(ids)).astype(np.int64) * 4
            yield pa.RecordBatch.from_arrays([
                b.column(0).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(size, pa.int64()),
                pa.Array.from_buffers(pa.large_binary(), len(doc), [None, pa.py_buffer(at), pa.py_buffer(ids)]).cast(pa.binary()),
            ], [key, "piece", "start", "length", "ids"])

    return df.select(key, text).mapInArrow(cut, f"`{key}` {kind}, {PIECE_SCHEMA}")


def groups_for(docs: DataFrame, text: str = "text", limit: int = 1024) -> int:
    """How many groups to pack the pieces of all texts in: about GROUP_PIECES short pieces each, more of them if they are tiny.

    A document has at most one piece that isn't full. Only the length of texts is read.
    """
    n, size = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()
    return max(1, min(-(-n // GROUP_PIECES), -(-(size + n) // (TOKEN_BYTES * limit * GROUP_SEQUENCES))))


def place(demand: np.ndarray, capacity: np.ndarray, weights: np.ndarray, rule: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """(bin, position in its bin's order) of each item; demand has a row of resources per item, in placing order.

    An item that alone breaks a capacity raises ValueError.
    """
    if (demand > capacity).any():
        raise ValueError("an item is larger than a capacity")
    n, k = demand.shape
    room = np.empty((k, n), np.float64)
    names = np.empty(n, np.int64)
    least = np.minimum.accumulate(demand[::-1], axis=0)[::-1] if n else demand
    scale = weights / capacity ** 2
    chosen, order, opened, used = np.empty(n, np.int64), np.empty(n, np.int64), 0, 0
    held = np.zeros(n, np.int64)
    for i in range(n):
        d = demand[i]
        if i % 512 == 0 and used:  # sequences that can take nothing more are closed
            keep = (room[:, :used] >= least[i][:, None]).all(0)
            live = int(keep.sum())
            room[:, :live], names[:live] = room[:, :used][:, keep], names[:used][keep]
            used = live
        fits = room[0, :used] >= d[0]
        for j in range(1, k):
            fits &= room[j, :used] >= d[j]
        at = np.flatnonzero(fits)
        if len(at):
            if rule == "norm":
                score = sum(scale[j] * (room[j, at] - d[j]) ** 2 for j in range(k) if weights[j])
            else:
                score = -sum(scale[j] * room[j, at] * d[j] for j in range(k) if weights[j])
            b = int(at[np.argmin(score)])
        else:
            b, names[used], room[:, used] = used, opened, capacity
            used += 1
            opened += 1
        room[:, b] -= d
        chosen[i], order[i] = names[b], held[names[b]]
        held[names[b]] += 1
    return chosen, order


def best_fit(items: DataFrame, limit: int = 1024, max_pieces: int | None = None, max_cost: int | None = None,
             weights: tuple = WEIGHTS, rule: str = "norm", groups: int | None = None) -> DataFrame:
    """Add sequence_id and offset to rows with a `length`; `groups` defaults to one per GROUP_PIECES rows."""
    max_pieces, max_cost = limit if max_pieces is None else max_pieces, limit ** 2 if max_cost is None else max_cost
    items = items.drop("sequence_id", "offset")
    groups = groups or max(1, -(-items.count() // GROUP_PIECES))
    rows = items.withColumn("__group", F.pmod(F.xxhash64(*items.columns), F.lit(groups)).cast("int"))
    names = [f.name for f in items.schema.fields]
    capacity, weigh = np.array([limit, max_pieces, max_cost], np.float64), np.array(weights, np.float64)

    def packed(table: pa.Table) -> pa.RecordBatch:
        group = table.column("__group")[0].as_py()
        length = table.column("length").to_numpy().astype(np.int64)
        bins, order = np.arange(len(length), dtype=np.int64), np.zeros(len(length), np.int64)
        part = np.flatnonzero(length < limit)  # a full piece is a sequence by itself
        part = part[np.argsort(-length[part], kind="stable")]
        if max_pieces < 1 or limit ** 2 > max_cost and len(part) < len(length):
            raise ValueError("an item is larger than a capacity")
        full = len(length) - len(part)
        bins[np.flatnonzero(length >= limit)] = np.arange(full)
        d = length[part]
        mine, order[part] = place(np.stack([d, np.ones_like(d), d * d], 1), capacity, weigh, rule)
        bins[part] = full + mine
        by = np.lexsort((order, bins))
        before = np.cumsum(length[by]) - length[by]
        offset = np.empty_like(length)
        first = np.r_[True, bins[by][1:] != bins[by][:-1]]
        offset[by] = before - np.maximum.accumulate(np.where(first, before, 0))
        out = table.select(names).append_column("sequence_id", pa.array(bins + (group << 40), pa.int64()))
        return out.append_column("offset", pa.array(offset, pa.int64())).combine_chunks().to_batches()[0]

    def by_group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            ids = b.column(b.num_columns - 1).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(ids)) + 1), len(ids)] if len(ids) else []
            for low, high in zip(edges, edges[1:]):
                if held and held[0].column(b.num_columns - 1)[0].as_py() != ids[low]:
                    yield packed(pa.Table.from_batches(held))
                    held = []
                held.append(b.slice(low, high - low))
        if held:
            yield packed(pa.Table.from_batches(held))

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema.fields), "sequence_id bigint, offset bigint"])
    return rows.repartition(groups, "__group").sortWithinPartitions("__group", *items.columns).mapInArrow(by_group, schema)
