"""Near-duplicate documents: an exact Jaccard join of word shingle sets by grouped prefixes.

A document's set holds its distinct runs of `n` words (A-Z lower-cased); with fewer words, the whole sequence as one;
without words, or for null text, nothing, and then it is linked with nothing. Two documents link when
den * intersection >= num * union. The result is the class of documents reachable by links.

1. A count sketch of fixed size (2**COUNTERS counters over all shingles) says roughly how frequent a shingle is. Sets
   are ordered by that, rare first. Of a linked pair's common shingles, the first `l` are among the first
   |x| - ceil(t |x|) + l of both sets (their prefixes); l grows with the set, see `needed`.
2. Equal sets are one member. Members of equal prefix and size form a group, which is indexed once.
3. Groups that share prefix shingles are joined: a shingle of up to LIST groups gives their pairs, filtered by size and
   position, and a pair stays if it has l shingles in common; a more frequent shingle gives a chain of its groups by size,
   broken where sizes are too far apart, so that what is made never grows with the square of a group of copies. Groups
   connected by either form a cluster, and members go to their cluster with their sets.
4. In a cluster, group pairs pass the length and position filters again, then members are verified, unless they are
   already connected. A cluster beyond CLUSTER_BYTES is cut into blocks by size class and hash, and block pairs that can
   hold links become tasks of their own.
5. Links of all tasks are joined to classes.

Repeated rows and equal texts are in one class. Null keys take part; a class's id is its smallest key that is not null.
An empty table gives an empty result. Shingles are told apart by 64 bits, sets and groups by 128.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import words
from .blocks import pack, runs, text_blocks, unpack, utf8
from .components import components
from .ranges import partitions

COUNTERS = 22
SKETCH_ROWS = 64
CLUSTER_BYTES = 16 << 20
LIST = 64
BROADCAST_ROWS = 500_000


def shingles(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, shingle hash) of all shingles, repeated ones too."""
    data = words.lower(data)
    starts, ends, first = words.split(data, offsets)
    h, count = words.hash_spans(data, starts, ends), np.diff(first)
    doc = np.repeat(np.arange(len(count)), count)
    size = max(0, len(h) - n + 1)
    good = np.flatnonzero(doc[:size] == doc[n - 1:])
    owner, value = doc[good], words.grams(h, n)[good]
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        owner = np.concatenate([owner, short])
        value = np.concatenate([value, np.array([words.whole(h[first[i]:first[i + 1]], n) for i in short], np.uint64)])
    return owner, value


def frequency_classes(df: DataFrame, n: int, text: str) -> np.ndarray:
    """4 * log2 of each counter of a sketch over the shingles of all documents; 4 MB whatever the input."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = np.zeros(1 << COUNTERS, np.int64)
        for b in text_blocks(batches, text):
            _, value = shingles(*utf8(b.column(0)), n)
            counters += np.bincount((value >> np.uint64(64 - COUNTERS)).astype(np.int64), minlength=1 << COUNTERS)
        small = counters.reshape(SKETCH_ROWS, -1)
        kind = np.min_scalar_type(int(counters.max()))
        yield pa.RecordBatch.from_arrays([pa.array(range(SKETCH_ROWS), pa.int32()), pa.array([pack(r.astype(kind)) for r in small])], ["row", "blob"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, mine in runs(batches, "row"):
            total = sum(unpack(m["blob"])[0].astype(np.int64) for m in mine)
            yield pa.RecordBatch.from_arrays([pa.array([row], pa.int32()), pa.array([pack((4 * np.log2(total + 1)).astype(np.uint8))])], ["row", "blob"])

    schema = "row int, blob binary"
    rows = df.select(text).mapInArrow(count, schema).repartition(SKETCH_ROWS, "row").sortWithinPartitions("row").mapInArrow(add, schema)
    found = {r["row"]: unpack(r["blob"])[0] for r in rows.collect()}
    none = np.zeros((1 << COUNTERS) // SKETCH_ROWS, np.uint8)
    return np.concatenate([found.get(i, none) for i in range(SKETCH_ROWS)])


class Ordered:
    """Sets of a block in rare-first order: set i is value[first[i]:first[i + 1]]."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, n: int, classes: np.ndarray):
        owner, value = shingles(data, offsets, n)
        by = np.lexsort((value, owner << 8 | classes[(value >> np.uint64(64 - COUNTERS)).astype(np.int64)]))
        owner, value = owner[by], value[by]
        new = np.ones(len(value), bool)
        new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
        owner, self.value = owner[new], value[new]
        self.first = np.searchsorted(owner, np.arange(len(offsets)))
        self.size = np.diff(self.first)
        self.one, self.two = words.span_hashes(self.value, self.first[:-1], self.first[1:])


def needed(size):
    """How many of its prefix shingles a set must share with another that needs as many or more."""
    return 1 + size // 64


def prefix_length(size, num: int, den: int):
    return np.minimum(size, size - -(-num * size // den) + needed(size))


def overlap(a, b, num: int, den: int):
    """The common shingles that a link of sets of these sizes needs."""
    return -(-num * (a + b) // (num + den))


def _longs(flat: np.ndarray, edges: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(np.ascontiguousarray(flat).view(np.int64), pa.int64()))


def link_members(sets: list[np.ndarray], num: int, den: int) -> list[tuple[int, int]]:
    """Links that connect all linked sets (a spanning forest); sets are in rare-first order and by rising size."""
    n = len(sets)
    size = np.array([len(s) for s in sets])
    groups: dict[bytes, int] = {}
    members: list[list[int]] = []
    group_of = np.empty(n, np.int64)
    for i, s in enumerate(sets):
        key = s[: prefix_length(len(s), num, den)].tobytes() + len(s).to_bytes(8, "little")
        group_of[i] = groups.setdefault(key, len(groups))
        if group_of[i] == len(members):
            members.append([])
        members[group_of[i]].append(i)
    by_value = [np.sort(s) for s in sets]
    root, links = np.arange(n), []
    index: dict[int, list[tuple[int, int]]] = {}
    group_size = np.array([size[m[0]] for m in members])

    def verify(x: int, others: np.ndarray) -> None:
        """Compare x with the others, in growing batches, leaving out those already connected to it."""
        batch = 1
        others = others[root[others] != root[x]]
        while len(others):
            now, others = others[:batch], others[batch:]
            where = np.searchsorted(by_value[x], flat := np.concatenate([by_value[y] for y in now]))
            where[where == len(by_value[x])] = 0
            edges = np.concatenate([[0], np.cumsum(size[now])[:-1]])
            common = np.add.reduceat((by_value[x][where] == flat).astype(np.int64), edges)
            for y in now[den * common >= num * (size[x] + size[now] - common)]:
                if root[x] != root[y]:
                    links.append((x, int(y)))
                    root[root == root[y]] = root[x]
            others = others[root[others] != root[x]]
            batch = min(batch * 4, 256)

    for g, mine in enumerate(members):
        for k, x in enumerate(mine[1:], 1):
            verify(x, np.array(mine[:k]))
        nx = int(group_size[g])
        prefix = sets[mine[0]][: prefix_length(nx, num, den)].tolist()
        found: list[np.ndarray] = []
        for px, token in enumerate(prefix):
            there = index.get(token)
            if there is not None:
                other, py = np.array(there).T
                ny = group_size[other]
                least = overlap(nx, ny, num, den)
                at_most = np.minimum(px, py) + 1 + np.minimum(nx - px - 1, ny - py - 1)
                found.append(other[(den * ny >= num * nx) & (at_most >= least)])
        if found:
            for x in mine:
                candidates = np.unique(np.concatenate(found))
                verify(x, np.array([y for h in candidates for y in members[h]], np.int64))
        for px, token in enumerate(prefix):
            index.setdefault(token, []).append((g, px))
    return links


def candidate_pairs(batches: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Pairs of groups that share a prefix shingle; rows (token, size, g, at) are sorted by token and size.

    (a, b, common, need): 1 for a shared shingle and how many the pair must share; a link of a chain has all it needs.
    """
    def pairs(token, size, g, at) -> pa.RecordBatch:
        new = np.r_[True, token[1:] != token[:-1]]
        run = np.cumsum(new) - 1
        length = np.bincount(run)[run]
        out = []
        i = np.flatnonzero(length > LIST)
        i = i[:-1][token[i[:-1]] == token[i[:-1] + 1]] if len(i) else i
        i = i[den * size[i] >= num * size[i + 1]]
        out.append((g[i], g[i + 1], needed(size[i]), needed(size[i])))
        live = np.flatnonzero(length <= LIST)
        for d in range(1, LIST):
            live = live[live + d < len(token)]
            live = live[token[live] == token[live + d]]
            if not len(live):
                break
            a, b = live, live + d
            most = np.minimum(at[a], at[b]) + 1 + np.minimum(size[a] - at[a], size[b] - at[b]) - 1
            good = (den * size[a] >= num * size[b]) & (most >= overlap(size[a], size[b], num, den))
            a, b = a[good], b[good]
            out.append((g[a], g[b], np.ones(len(a), np.int64), needed(size[a])))
        a, b, common, need = (np.concatenate(c) for c in zip(*out))
        other = a != b
        columns = (np.minimum(a, b), np.maximum(a, b), common, need)
        return pa.RecordBatch.from_arrays([pa.array(c[other], pa.int64()) for c in columns], ["a", "b", "common", "need"])

    held: list[tuple] = []
    for b in batches:
        if not b.num_rows:
            continue
        held.append(tuple(c.to_numpy() for c in b.columns))
        if sum(len(h[0]) for h in held) < 200_000 or held[0][0][0] == held[-1][0][-1] and len(held) < 64:
            continue
        columns = [np.concatenate(c) for c in zip(*held)]
        cut = int(np.searchsorted(columns[0], columns[0][-1]))  # the last shingle may go on
        if cut:
            yield pairs(*(c[:cut] for c in columns))
            held = [tuple(c[cut:] for c in columns)]
        else:  # one shingle, and a long one: a chain, of which the last row is kept
            yield pairs(*columns)
            held = [tuple(np.repeat(c[-1:], LIST + 1) for c in columns)]
    if held:
        yield pairs(*(np.concatenate(c) for c in zip(*held)))


def classes_of(df: DataFrame, n: int = 5, num: int = 80, den: int = 100, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id) for every row of df; component_id is the smallest key of its class."""
    spark = df.sparkSession
    parts = max(1, partitions(spark))
    docs = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    classes = spark.sparkContext.broadcast(frequency_classes(docs, n, "text"))
    key_type = docs.schema["key"].dataType.simpleString()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_blocks(batches):
            s = Ordered(*utf8(b.column(1)), n, classes.value)
            width = np.where(s.size > 0, prefix_length(s.size, num, den), 0)
            at = s.first[:-1]
            g, g2 = (words.mix(x ^ s.size.astype(np.uint64)) for x in words.span_hashes(s.value, at, at + width))
            inside = np.arange(len(s.value)) - np.repeat(at, s.size) < np.repeat(width, s.size)
            edges = np.concatenate([[0], np.cumsum(width)])
            yield pa.RecordBatch.from_arrays([
                b.column(0), pa.array(s.size, pa.int64()), *(pa.array(x.view(np.int64), pa.int64()) for x in (s.one, s.two, g, g2)),
                _longs(s.value[inside], edges)], ["key", "n_shingles", "s1", "s2", "g", "g2", "prefix"])

    signs = cut_lineage(docs.mapInArrow(sign, f"key {key_type}, n_shingles bigint, s1 bigint, s2 bigint, g bigint, g2 bigint, prefix array<bigint>"))
    members = signs.where("n_shingles > 0").groupBy("s1", "s2").agg(F.min("key").alias("first_key"), F.min("g").alias("g"), F.min("n_shingles").alias("n_shingles"))
    tokens = signs.where("n_shingles > 0").dropDuplicates(["g", "g2"]).select(F.posexplode("prefix").alias("at", "token"), F.col("n_shingles").alias("size"), "g")
    tokens = tokens.select("token", "size", "g", F.col("at").cast("long").alias("at"))
    tokens = tokens.repartition(parts, "token").sortWithinPartitions("token", "size", "g")
    pairs = tokens.mapInArrow(lambda batches: candidate_pairs(batches, num, den), "a bigint, b bigint, common bigint, need bigint")
    pairs = pairs.groupBy("a", "b").agg(F.sum("common").alias("common"), F.min("need").alias("need")).where("common >= need")
    clusters = components(pairs.select("a", "b"), "a", "b")
    members = members.join(clusters, F.col("g") == F.col("node"), "left").select(
        "s1", "s2", "first_key", "n_shingles", F.coalesce("root", "g").alias("cluster"),
        F.floor(F.log("n_shingles") / log(den / num)).cast("int").alias("band") if num < den else F.col("n_shingles").cast("int").alias("band"))
    members = cut_lineage(members)

    # Which tasks see a member: its cluster, or all block pairs of a large cluster that its block is in.
    load = F.sum("n_shingles") * 8
    by_band = members.groupBy("cluster", "band").agg(F.count("*").alias("n"), load.alias("bytes"))
    whole = by_band.groupBy("cluster").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.max("bytes").alias("most")).where("n > 1")
    cuts = by_band.join(whole.where(F.col("bytes") > CLUSTER_BYTES).select("cluster"), "cluster").select(
        "cluster", "band", F.ceil(F.col("bytes") * 2 / CLUSTER_BYTES).cast("int").alias("cut"))
    some = members.join(whole.select("cluster"), "cluster")
    for step, name in ((0, "here"), (-1, "below"), (1, "above")):
        side = cuts.select("cluster", (F.col("band") - step).alias("band"), F.col("cut").alias(name))
        some = some.join(side, ["cluster", "band"], "left")
    mine = F.pmod("s1", F.col("here")).cast("int")

    def pairs(count: str, make):
        return F.when(F.col(count) > 0, F.transform(F.sequence(F.lit(0), F.col(count) - 1), make)).otherwise(F.array().cast("array<bigint>"))

    task = F.when(F.col("here").isNull(), F.array(F.xxhash64("cluster"))).otherwise(F.concat(
        pairs("here", lambda j: F.xxhash64("cluster", "band", F.least(mine, j), "band", F.greatest(mine, j))),
        pairs("above", lambda j: F.xxhash64("cluster", "band", mine, F.col("band") + 1, j)),
        pairs("below", lambda j: F.xxhash64("cluster", F.col("band") - 1, j, "band", mine))))
    some = some.select("s1", "s2", "first_key", task.alias("tasks"))

    def load_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_blocks(batches):
            s = Ordered(*utf8(b.column(0)), n, classes.value)
            yield pa.RecordBatch.from_arrays([*(pa.array(x.view(np.int64), pa.int64()) for x in (s.one, s.two)), _longs(s.value, s.first)], ["s1", "s2", "items"])

    wanted = some.select(F.col("first_key").alias("key")).distinct()
    if wanted.count() <= BROADCAST_ROWS:  # 8 bytes each; beyond, the texts are shuffled
        wanted = F.broadcast(wanted)
    texts = docs.join(wanted.withColumnRenamed("key", "__key"), F.col("key").eqNullSafe(F.col("__key"))).select("text")
    sets = texts.mapInArrow(load_sets, "s1 bigint, s2 bigint, items array<bigint>")
    sets = sets.join(some, ["s1", "s2"]).select("s1", "s2", "items", F.explode("tasks").alias("task"))

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in runs(batches, "task"):
            found = {(r["s1"], r["s2"]): np.array(r["items"], np.int64).view(np.uint64) for r in rows}
            names = sorted(found, key=lambda k: (len(found[k]), k))
            out = link_members([found[k] for k in names], num, den)
            if out:
                a, b = ([names[i] for i in side] for side in zip(*out))
                kind = pa.struct([("s1", pa.int64()), ("s2", pa.int64())])
                yield pa.RecordBatch.from_arrays([pa.array([{"s1": x, "s2": y} for x, y in side], kind) for side in (a, b)], ["a", "b"])

    links = sets.repartition(parts, "task").sortWithinPartitions("task").mapInArrow(
        link, "a struct<s1:bigint,s2:bigint>, b struct<s1:bigint,s2:bigint>")
    joined = components(links, "a", "b").select("node.s1", "node.s2", "root")
    named = members.select("s1", "s2", "first_key").join(joined, ["s1", "s2"], "left").withColumn(
        "root", F.coalesce("root", F.struct("s1", "s2")))
    smallest = named.groupBy("root").agg(F.min("first_key").alias("component_id"))
    named = named.join(smallest, "root").select("s1", "s2", "component_id")
    out = signs.select("key", "n_shingles", "s1", "s2").join(named, ["s1", "s2"], "left")
    own = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("key"))
    return out.select(F.col("key").alias(key), "n_shingles", own.alias("component_id"))
