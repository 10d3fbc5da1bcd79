"""Removal of repeated passages, located by sharded Aho-Corasick automata.

A window is `window` consecutive words of one document. A word goes if it lies in a window whose word sequence also
starts anywhere else, in another document or the same one. Windows are judged on the input.

Equal texts are treated once, with their number. Each window has an anchor: its leftmost ANCHOR-word run of smallest
hash, so equal windows have equal anchors, and neighbours mostly share one. Then:

1. Count the anchors (combined before the exchange). Only windows whose anchor occurs more than once can recur.
2. The text around such anchors goes, once per distinct segment, to the shard of its anchor. There passages are confirmed: windows that
   occur more than once, in runs, are the phrases, each kept once.
3. The phrases of a shard are compiled to an automaton over word numbers, and all documents stream through it, as the
   distinct segments around the shard's anchors (a phrase can occur nowhere else). What the automata report are the places.
4. Places go back to the texts that hold the segments.

An anchor with more than PART distinct segments has several shards: its windows are dealt among them by their hash, and a
segment visits those of its windows. The text moves once, into a table of text blocks (about GROUP_BYTES each, chosen by the
text's hash; one pass over the column finds how many) bucketed by block. All later steps ask by block without moving it again:
a block sends each of its anchors once and gets back those that recur, then sends each of its segments once and gets back
their spans. So a passage that all texts share is a few rows per block, however many texts the block has.

Null texts have no words; empty texts and texts shorter than the window stay as they are (words joined by one blank).
Rows are kept, repeated ones too: their passages repeat, so all their windows go. An empty table gives an empty result.
A very long text is one row and must fit in a task. Texts and windows are told apart by 128 bits, words by 64. Columns named like a
result are replaced by `attach`; others are not touched.
"""

from __future__ import annotations

import uuid
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import words
from .blocks import spread, text_blocks, utf8
from .ranges import partitions

ANCHOR = 8
PART = 20_000
SHARD_BYTES = 2 << 20
GROUP_BYTES = 256 << 10


def text_keys(text: str = "text"):
    """Two 64-bit hashes that tell texts apart; null counts as empty."""
    value = F.coalesce(F.col(text), F.lit(""))
    return F.xxhash64(value).alias("h1"), F.xxhash64(F.lit(1), value).alias("h2")


def smallest(g: np.ndarray, n: int) -> np.ndarray:
    """For each n consecutive values the position of the leftmost smallest one."""
    if len(g) < n:
        return np.zeros(0, np.int64)
    at, width = np.arange(len(g)), 1

    def lower(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.where(g[b] < g[a], b, a)

    while width * 2 <= n:
        at = lower(at[:-width], at[width:])
        width *= 2
    return lower(at[: len(g) - n + 1], at[n - width: n - width + len(g) - n + 1])


def anchors(h: np.ndarray, first: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash, low, high) of each anchor: windows starting at words low to high (in the text) have it."""
    n = len(h) - window + 1
    if n <= 0:
        return tuple(np.zeros(0, t) for t in (np.int64, np.uint64, np.int64, np.int64))
    k = min(ANCHOR, window)
    g = words.grams(h, k)
    at = smallest(g, window - k + 1)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    valid = np.flatnonzero(text[:n] == text[window - 1:])
    if not len(valid):
        return tuple(np.zeros(0, t) for t in (np.int64, np.uint64, np.int64, np.int64))
    new = np.r_[True, (at[valid[1:]] != at[valid[:-1]]) | (np.diff(valid) > 1) | (text[valid[1:]] != text[valid[:-1]])]
    low = valid[new]
    high = valid[np.r_[np.flatnonzero(new)[1:] - 1, len(valid) - 1]]
    t = text[low]
    return t, g[at[low]], low - first[t], high - first[t]


@dataclass
class Segments:
    """Texts of a shard as word numbers; the words of segment i are first[i] to first[i + 1] - 1."""

    ids: np.ndarray
    first: np.ndarray

    def owners(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def window_hashes(h: np.ndarray, first: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, hash, hash) of each window that lies in one segment."""
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    n = max(0, len(h) - window + 1)
    at = np.flatnonzero(owner[:n] == owner[window - 1:])
    return at, words.grams(h, window, 1)[at], words.grams(h, window, 2)[at]


def confirm(segments: Segments, weight: np.ndarray, mine: np.ndarray, hashes: tuple[np.ndarray, ...], window: int) -> set[tuple[int, ...]]:
    """The phrases: runs of windows of which each occurs more than once; a segment stands for `weight` places.

    Only the windows marked in `mine` are judged; hashes are their positions and two hashes.
    """
    at, one, two = (a[mine] for a in hashes)
    key = np.empty(len(at), [("a", "<u8"), ("b", "<u8")])
    key["a"], key["b"] = one, two
    _, back = np.unique(key, return_inverse=True)
    owner = segments.owners()
    starts = at[np.bincount(back, weight[owner[at]])[back] > 1] if len(at) else at
    if not len(starts):
        return set()
    new = np.r_[True, (np.diff(starts) > 1) | (owner[starts[1:]] != owner[starts[:-1]])]
    low = starts[new]
    high = starts[np.r_[np.flatnonzero(new)[1:] - 1, len(starts) - 1]] + window
    ids = segments.ids.tolist()
    return {tuple(ids[a:b]) for a, b in zip(low.tolist(), high.tolist())}


def compiled(phrases: set[tuple[int, ...]]) -> ahocorasick.Automaton:
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    for phrase in phrases:
        automaton.add_word(phrase, len(phrase))
    automaton.make_automaton()
    return automaton


def locate(automaton: ahocorasick.Automaton, segments: Segments) -> tuple[np.ndarray, np.ndarray]:
    """(segment, spans) of every occurrence of a phrase, overlapping ones merged; spans are rows of start and end word."""
    if not len(automaton):
        return np.zeros(0, np.int64), np.zeros((0, 2), np.int64)
    ids, first = segments.ids.tolist(), segments.first.tolist()
    starts, ends = array("q"), array("q")
    for i, (low, high) in enumerate(zip(first, first[1:])):
        base = low + i + 1  # a gap between segments keeps their spans apart
        for end, size in automaton.iter(tuple(ids[low:high])):
            starts.append(base + end - size)
            ends.append(base + end)
    spans = _merged(np.column_stack([np.array(starts), np.array(ends)]))
    gaps = segments.first[:-1] + np.arange(len(first) - 1)
    owner = np.searchsorted(gaps, spans[:, 0], "right") - 1
    return owner, spans - gaps[owner, None]


def _u64(a: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(a).view(np.int64), pa.int64())


def _merged(spans: np.ndarray) -> np.ndarray:
    """Spans (rows of start, end) as disjoint ones in order."""
    if not len(spans):
        return spans
    spans = spans[np.lexsort((spans[:, 1], spans[:, 0]))]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.r_[True, spans[1:, 0] > reach[:-1]]
    at = np.flatnonzero(new)
    return np.column_stack([spans[at, 0], np.maximum.reduceat(spans[:, 1], at)])


def _firsts(*columns: np.ndarray) -> np.ndarray:
    """Where each run of equal rows begins."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return np.flatnonzero(new)


def _sums(values: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.array(np.add.reduceat(values, at) if len(at) else np.zeros(0, np.int64), pa.int64())


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Equal texts of a batch as one row with their number, so that many copies don't travel to one task."""
    for b in batches:
        one, two = (b.column(c).to_numpy() for c in ("h1", "h2"))
        by = np.lexsort((two, one))
        new = _firsts(one[by], two[by])
        taken = b.take(pa.array(by[new]))
        yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(np.diff(np.append(new, len(by))), pa.int64())], [*b.schema.names, "times"])


def _in_order(rows: pa.Table) -> pa.Table:
    """The texts of a block by their hashes: each has the same place in it whenever the block is read."""
    return rows.take(np.lexsort((rows["h2"].to_numpy(), rows["h1"].to_numpy()))).combine_chunks()


def _array(column: pa.ChunkedArray) -> pa.Array:
    return column.chunk(0) if column.num_chunks == 1 else pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def _lists(rows: pa.RecordBatch, columns: list[str], owner: np.ndarray, **values: np.ndarray) -> pa.RecordBatch:
    """One row for each row of `rows` that owns values (owner rises), with the values in a list of structs."""
    there, counts = np.unique(owner, return_counts=True)
    entries = pa.StructArray.from_arrays([pa.array(v, pa.int32()) for v in values.values()], list(values))
    lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)], pa.int32()), entries)
    taken = rows.take(pa.array(there))
    return pa.RecordBatch.from_arrays([*(taken.column(c) for c in columns), lists], [*columns, "spans"])


def _slices(batch: pa.RecordBatch, size: int) -> Iterator[pa.RecordBatch]:
    """The rows in slices of about `size` bytes, by their mean."""
    step = max(1, batch.num_rows * size // max(batch.nbytes, 1))
    for low in range(0, batch.num_rows, step):
        yield batch.slice(low, step)


def _whole_shards(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (shard, part) in batches of about `size` bytes, or of a larger shard, that hold whole shards."""
    held = None
    for b in (part for whole in batches for part in _slices(whole, size // 4)):
        held = b if held is None else pa.concat_batches([held, b])
        if held.nbytes < size:
            continue
        shard, part = (held.column(c).to_numpy() for c in ("shard", "part"))
        edges = np.flatnonzero((np.diff(shard) != 0) | (np.diff(part) != 0)) + 1
        if len(edges):
            yield held.slice(0, int(edges[-1]))
            held = held.slice(int(edges[-1]))
    if held is not None:
        yield held


SEGMENTS = "shard bigint, s1 bigint, s2 bigint, segment string, times bigint, part int, parts int"


def without_repeats(df: DataFrame, window: int = 35, text: str = "text") -> DataFrame:
    """(h1, h2, kept, n_words, n_removed) for each distinct text of df."""
    spark = df.sparkSession
    n = max(1, partitions(spark))
    table = f"texts_{uuid.uuid4().hex}"
    size = df.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0
    blocks = max(4 * n, -(-size // GROUP_BYTES))
    texts = df.select(*text_keys(text), F.coalesce(F.col(text), F.lit("")).alias("text"))
    texts = texts.mapInArrow(_once, "h1 bigint, h2 bigint, text string, times bigint")
    texts = texts.withColumn("block", F.pmod(F.col("h1"), F.lit(blocks).cast("long"))).repartition(n, "block")
    texts = texts.groupBy("block", "h1", "h2").agg(F.first("text").alias("text"), F.sum("times").alias("times"))
    texts.write.bucketBy(n, "block").sortBy("block").saveAsTable(table)
    texts = spark.table(table)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_blocks(batches):
            data, offsets = utf8(b.column(0))
            starts, ends, first = words.split(data, offsets)
            t, key, _, _ = anchors(words.hash_spans(data, starts, ends), first, window)
            block, times = b.column(1).to_numpy()[t], b.column(2).to_numpy()[t]
            by = np.lexsort((key, block))
            block, key, times = block[by], key[by], times[by]
            new = _firsts(block, key)
            yield pa.RecordBatch.from_arrays([pa.array(block[new], pa.int64()), _u64(key[new]), _sums(times, new)], ["block", "anchor", "times"])

    found = texts.select("text", "block", "times").mapInArrow(find, "block bigint, anchor bigint, times bigint")
    often = found.groupBy("anchor").agg(F.sum("times").alias("n")).where("n > 1").select("anchor")
    often = cut_lineage(often)  # so that the join has an exchange of its own on both sides, and a hot anchor can be split
    near = cut_lineage(found.join(often, "anchor", "left_semi").select("block", "anchor"))

    def cut(with_text: bool):
        """Distinct segments of a block around recurring anchors: (shard, s1, s2) and their words, or the texts that hold them and where."""
        def run(rows: pa.Table, recurring: pa.Table) -> pa.Table:
            rows = _in_order(rows)
            data, offsets = utf8(_array(rows["text"]))
            starts, ends, first = words.split(data, offsets)
            h = words.hash_spans(data, starts, ends)
            t, key, low, high = anchors(h, first, window)
            key = key.view(np.int64)
            mine = np.flatnonzero(np.isin(key, recurring["anchor"].to_numpy()))
            t, key, low, high = t[mine], key[mine], low[mine], high[mine]
            a, e = first[t] + low, first[t] + high + window
            one, two = words.span_hashes(h, a, e)
            by = np.lexsort((low, t, two, one, key))
            t, key, low, one, two, a, e = (x[by] for x in (t, key, low, one, two, a, e))
            new = _firsts(key, one, two)
            names = [pa.array(key[new], pa.int64()), _u64(one[new]), _u64(two[new])]
            if with_text:
                raw = data.tobytes()
                seg = [raw[starts[i]:ends[j - 1]].decode() for i, j in zip(a[new].tolist(), e[new].tolist())]
                return pa.table([*names, _sums(rows["times"].to_numpy()[t], new), pa.array(seg, pa.string())], ["shard", "s1", "s2", "times", "segment"])
            places = pa.StructArray.from_arrays([pa.array(t, pa.int32()), pa.array(low, pa.int32())], ["text", "low"])
            places = pa.ListArray.from_arrays(pa.array(np.append(new, len(t)), pa.int32()), places)
            return pa.table([pa.array(np.full(len(new), rows["block"][0].as_py()), pa.int64()), *names, places], ["block", "shard", "s1", "s2", "places"])
        return run

    by_block = texts.select("block", "h1", "h2", "text", "times").groupBy("block")  # the texts stay where they are
    near = by_block.cogroup(near.groupBy("block"))
    places = cut_lineage(near.applyInArrow(cut(False), "block bigint, shard bigint, s1 bigint, s2 bigint, places array<struct<text:int,low:int>>"))
    segments = near.applyInArrow(cut(True), "shard bigint, s1 bigint, s2 bigint, times bigint, segment string")
    segments = segments.groupBy("shard", "s1", "s2").agg(F.first("segment").alias("segment"), F.sum("times").alias("times"))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each part that a segment of a crowded anchor has windows in."""
        for b in text_blocks(batches, "segment"):
            data, offsets = utf8(b.column(3))
            starts, ends, first = words.split(data, offsets)
            at, one, _ = window_hashes(words.hash_spans(data, starts, ends), first, window)
            row = np.searchsorted(first, at, "right") - 1
            parts = b.column(5).to_numpy().astype(np.uint64)
            goes = np.unique(np.column_stack([row, (one % parts[row]).astype(np.int64)]), axis=0)
            taken = pa.array(goes[:, 0])
            yield pa.RecordBatch.from_arrays(
                [*(b.column(i).take(taken) for i in range(5)), pa.array(goes[:, 1], pa.int32()), b.column(5).take(taken)],
                ["shard", "s1", "s2", "segment", "times", "part", "parts"])

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _whole_shards(batches, SHARD_BYTES):
            data, offsets = utf8(b.column(3))
            starts, ends, first = words.split(data, offsets)
            h = words.hash_spans(data, starts, ends)
            mine = Segments(np.unique(h, return_inverse=True)[1], first)
            hashes = window_hashes(h, first, window)
            row = np.searchsorted(first, hashes[0], "right") - 1
            part, parts = b.column(5).to_numpy(), b.column(6).to_numpy().astype(np.uint64)
            judged = (hashes[1] % parts[row]).astype(np.int64) == part[row]
            phrases = confirm(mine, b.column(4).to_numpy().astype(np.float64), judged, hashes, window)
            owner, spans = locate(compiled(phrases), mine)
            yield _lists(b, ["shard", "s1", "s2"], owner, start=spans[:, 0], end=spans[:, 1])

    crowded = places.select("shard", "s1", "s2").distinct().groupBy("shard").agg(F.count("*").alias("n")).where(F.col("n") > PART)
    crowded = cut_lineage(crowded.select("shard", F.ceil(F.col("n") / PART).cast("int").alias("parts")))
    columns = ["shard", "s1", "s2", "segment", "times"]
    if crowded.isEmpty():
        segments = segments.select(*columns, F.lit(0).alias("part"), F.lit(1).alias("parts"))
    else:
        segments = cut_lineage(segments.join(crowded, "shard", "left").select(*columns, "parts"))
        segments = segments.where("parts IS NULL").select(*columns, F.lit(0).alias("part"), F.lit(1).alias("parts")).unionAll(
            segments.where("parts IS NOT NULL").mapInArrow(deal, SEGMENTS))
    located = segments.repartition(n, "shard", "part").sortWithinPartitions("shard", "part", "s1", "s2")
    located = located.mapInArrow(stream, "shard bigint, s1 bigint, s2 bigint, spans array<struct<start:int,end:int>>")
    if not crowded.isEmpty():  # a segment has a row from each part
        located = located.groupBy("shard", "s1", "s2").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    spans = places.join(located, ["shard", "s1", "s2"]).select("block", "places", "spans")

    def keep(rows: pa.Table, spans: pa.Table) -> pa.Table:
        rows = _in_order(rows)
        data, offsets = utf8(_array(rows["text"]))
        starts, ends, first = words.split(data, offsets)
        there, inside = _array(spans["places"]), _array(spans["spans"])
        each = np.diff(there.offsets.to_numpy())
        (t, low), (a, e) = ((c.to_numpy(zero_copy_only=False).astype(np.int64) for c in x.flatten().flatten()) for x in (there, inside))
        begin = inside.offsets.to_numpy().astype(np.int64)
        begin, many = np.repeat(begin[:-1] - begin[0], each), np.repeat(np.diff(begin), each)
        place, span = np.repeat(np.arange(len(t)), many), spread(begin, many)  # a place has all the spans of its segment
        base = first[t[place]] + low[place]
        gone = np.zeros(int(first[-1]) + 1, np.int64)
        np.add.at(gone, base + a[span], 1)
        np.add.at(gone, base + e[span], -1)
        gone = np.cumsum(gone)[:-1] > 0
        kept = np.flatnonzero(~gone)
        size = ends[kept] - starts[kept] + 1
        out = np.append(data, np.uint8(32))[spread(starts[kept], size)]
        edge = np.append(0, np.cumsum(size))
        out[edge[1:] - 1] = 32
        raw, edge = out.tobytes(), edge[np.searchsorted(kept, first)].tolist()
        texts = [raw[i:max(i, j - 1)].decode() for i, j in zip(edge, edge[1:])]
        removed = np.diff(np.append(0, np.cumsum(gone))[first])
        return pa.table([rows["h1"], rows["h2"], pa.array(texts, pa.string()), pa.array(np.diff(first), pa.int64()), pa.array(removed, pa.int64())],
                        ["h1", "h2", "kept", "n_words", "n_removed"])

    return by_block.cogroup(spans.groupBy("block")).applyInArrow(keep, "h1 bigint, h2 bigint, kept string, n_words bigint, n_removed bigint")


def attach(df: DataFrame, results: DataFrame, text: str = "text", how: str = "inner") -> DataFrame:
    """Every row of df and its text's results; a column of df that clashes with a result is replaced."""
    names = [c for c in results.columns if c not in ("h1", "h2")]
    results = results.withColumnsRenamed({"h1": "__r1", "h2": "__r2"})
    rows = df.drop(*names)
    one, two = text_keys(text)
    rows = rows.withColumns({"__t1": one, "__t2": two})
    return rows.join(results, (F.col("__t1") == F.col("__r1")) & (F.col("__t2") == F.col("__r2")), how).drop("__t1", "__t2", "__r1", "__r2")
