"""Language model scores by a probabilistic suffix tree over words.

Symbols are words (A-Z lower-cased) and one end per text; a text's history begins with the end symbol. The tree's states
are contexts of up to two symbols:

* The root gives a symbol (c + 1) / (N + V + 1), from its count c among the N training tokens of V kinds.
* A context is a candidate if it occurs LEAST times among the training tokens, however many these are. (A SHARE of them
  may be asked for as well; it is 0.) It is retained if its next-symbol distribution diverges from that of
  its longest retained suffix: over its continuations, each left out of the counts when it is its turn, the mean log
  ratio of the two probabilities is at least DIVERGENCE nats. (With all counts in, rare contexts always seem to.)
* A state's distribution is smoothed into its suffix's: (c(state, w) + PRIOR * p(suffix, w)) / (c(state) + PRIOR).
* A symbol is scored by the longest retained suffix of its history.

Nothing is sampled, and no list of contexts is gathered anywhere: what is asked is asked by text blocks. A block sends
its distinct words with counts to word buckets and gets numbers and totals back; then its distinct pairs of symbols with
training counts to the buckets of their first symbols, which answer with totals and with the symbols' divergence; then
its distinct triples to the buckets of their contexts, which answer with totals and with the contexts that are retained.
What a block knows of its documents isn't sent along: it is worked out again from the block when the answers are there.
So a word or pair that holds a third of all tokens is a few entries per block; a word's pairs and contexts are also
spread over buckets in proportion to its count, and a block adds up the parts of its divergence. There are at least as
many buckets as leave BUCKET_TOKENS training tokens to each.

Null and empty texts hold the end alone. Rows whose flag is null are not learned from. Repeated rows and equal keys
count and are scored each. Without training rows every token has probability 1 / (0 + 0 + 1). An empty table gives an
empty result. Other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import words
from .blocks import narrow, pack, runs, spread, text_blocks, unpack, utf8
from .ranges import partitions

LEAST, SHARE = 2, 0.0
DIVERGENCE = 0.02
PRIORS = (1000.0, 500.0)
CHUNK_BYTES = 4 << 20
BUCKET_TOKENS = 4_000_000
END = 0
_POSITIONS, _WORDS, _KINDS, _PAIRS, _TRIPLES = range(5)
_ROWS, _NAMES = "target bigint, chunk bigint, kind int, blob binary", ["target", "chunk", "kind", "blob"]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [[]] * 4, kinds)], _NAMES)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        for i in range(b.num_rows):  # a row may hold megabytes
            yield from b.slice(i, 1).to_pylist()


def _distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, an index of it, rank by falling frequency of each value)."""
    values, first, back, count = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
    rank = np.empty(len(values), np.int64)
    rank[np.argsort(-count, kind="stable")] = np.arange(len(values))
    return values, first[np.argsort(rank)], rank[back]


def _starts(*sorted_columns: np.ndarray) -> np.ndarray:
    new = np.ones(len(sorted_columns[0]), bool)
    if len(new):
        new[1:] = False
        for c in sorted_columns:
            new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def left_out(n: np.ndarray, p: np.ndarray, of: np.ndarray, prior: float) -> np.ndarray:
    """n times the log ratio of a context's probability to p, for a continuation seen n times of `of`, without itself."""
    seen = np.maximum(n, 1)
    return n * np.log((seen - 1 + prior * p) / (of - 1 + prior) / p)


def training_size(df: DataFrame, text: str, train: str) -> tuple[int, int]:
    """(tokens, documents) to learn from."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_blocks(batches):
            _, _, first = words.split(*utf8(b.column(0)))
            yield pa.RecordBatch.from_arrays([pa.array([int(first[-1]) + b.num_rows], pa.int64()), pa.array([b.num_rows], pa.int64())], ["tokens", "docs"])

    rows = df.where(train).select(F.col(text).alias("text")).mapInArrow(count, "tokens bigint, docs bigint")
    row = rows.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("docs"), F.lit(0))).first()
    return row[0], row[1]


class Block:
    """The symbols of a text block by position, each with the one before it; END is the last of the block's symbols."""

    def __init__(self, rows: Iterator[dict], n_ends: int, n_train: int, routes: int):
        self.keys, self.valid, self.learn, sizes, rank = unpack(next(rows)["blob"])
        size = int(rank.max()) + 1 if len(rank) else 0
        self.number, self.count = np.zeros(size + 1, np.int64), np.zeros(size + 1, np.int64)
        self.number[size], self.count[size] = END, n_ends
        self.rest = []
        for row in rows:
            if row["kind"] != _WORDS:
                self.rest.append(row)
                continue
            steps, ids, n = unpack(row["blob"])
            mine = np.cumsum(steps.astype(np.int64))
            self.number[mine], self.count[mine] = ids, n
        self.routes, self.fan = routes, _fan(self.count, n_train, routes)
        self.sizes = sizes.astype(np.int64) + 1
        self.doc = np.repeat(np.arange(len(self.keys)), self.sizes)
        self.symbol = np.insert(rank.astype(np.int64), np.cumsum(self.sizes - 1), size)  # an end after each document
        self.begin = np.cumsum(self.sizes) - self.sizes
        self.before = np.empty_like(self.symbol)
        self.before[1:], self.before[self.begin] = self.symbol[:-1], size
        self.train = self.learn[self.doc].astype(np.int64)

    def bucket(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of symbols a, each spread by b over as many buckets as its count asks for."""
        part = words.mix(self.number[b].astype(np.uint64) + np.uint64(7)) % self.fan[a].astype(np.uint64)
        return ((words.mix(self.number[a].astype(np.uint64) + np.uint64(3)) + part) % np.uint64(self.routes)).astype(np.int64)

    def pairs(self, least: int) -> tuple[np.ndarray, ...]:
        """Distinct (before, next): both, training count, and the pair of each position; those to ask for, by bucket.

        Pairs whose count must be 0 or whose first symbol is too rare are not asked for.
        """
        key, back = np.unique(self.before * len(self.number) + self.symbol, return_inverse=True)
        a, b = key // len(self.number), key % len(self.number)
        ask = np.flatnonzero((self.count[a] >= least) & (self.count[b] > 0))
        bucket = self.bucket(a[ask], b[ask])
        by = np.lexsort((self.number[b[ask]], self.number[a[ask]], bucket))
        return a, b, np.bincount(back, self.train, minlength=len(a)).astype(np.int64), back, ask[by], bucket[by]

    def starters(self, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Symbols that may be contexts, with each bucket they are spread over; by bucket."""
        some = np.flatnonzero(self.count >= least)
        some = some[np.argsort(self.number[some])]
        word, part = np.repeat(some, self.fan[some]), spread(np.zeros(len(some), np.int64), self.fan[some])
        bucket = ((words.mix(self.number[word].astype(np.uint64) + np.uint64(3)) + part.astype(np.uint64)) % np.uint64(self.routes)).astype(np.int64)
        by = np.argsort(bucket, kind="stable")
        return word[by], bucket[by]


def _fan(count: np.ndarray, n_train: int, routes: int) -> np.ndarray:
    """Over how many buckets symbols are spread."""
    return np.clip(-(-count.astype(np.int64) * routes // max(1, n_train)), 1, routes)


def _edges(sorted_buckets: np.ndarray) -> list[tuple[int, int, int]]:
    """(bucket, from, to) of each run."""
    at = [*_starts(sorted_buckets).tolist(), len(sorted_buckets)]
    return [(int(sorted_buckets[i]), i, j) for i, j in zip(at, at[1:])]


def _merged(parts: list[tuple], keys: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Distinct rows of the first `keys` columns in order, all columns of each one's first entry, the row of each entry, the last column."""
    columns = [np.concatenate(c) for c in zip(*parts)]
    by = np.lexsort(columns[:keys][::-1])
    at = _starts(*(c[by] for c in columns[:keys]))
    back = np.empty(len(by), np.int64)
    back[by] = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(by))))
    return [c[by[at]] for c in columns], back, columns[-1]


def score(df: DataFrame, train: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row; scores are log10."""
    spark = df.sparkSession
    buckets = max(1, partitions(spark))
    docs = df.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    n_train, n_ends = training_size(docs, "text", "train")
    routes = max(2 * buckets, -(-n_train // BUCKET_TOKENS))
    least = max(LEAST, ceil(SHARE * n_train))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for i, b in enumerate(text_blocks(batches, size=CHUNK_BYTES)):
            chunk = task << 32 | i
            data, offsets = utf8(b.column(1))
            data = words.lower(data)
            starts, ends, first = words.split(data, offsets)
            hashes, where, rank = _distinct(words.hash_spans(data, starts, ends))
            learn = b.column(2).to_numpy(zero_copy_only=False).astype(bool)
            counts = np.bincount(rank[np.repeat(learn, np.diff(first))], minlength=len(where))
            keys = b.column(0)
            rows = [(chunk % buckets, chunk, _POSITIONS, pack(
                keys.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), keys.is_valid().to_numpy(zero_copy_only=False).astype(np.uint8),
                learn.astype(np.uint8), narrow(np.diff(first)), narrow(rank)))]
            s, size = starts[where], (ends - starts)[where]
            bucket = (words.hash_spans(data, s, ends[where]) % np.uint64(buckets)).astype(np.int64)
            for k in np.unique(bucket):
                mine = np.flatnonzero(bucket == k)
                rows.append((int(k), chunk, _WORDS, pack(
                    narrow(np.diff(mine, prepend=0)), narrow(counts[mine]), narrow(size[mine]), data[spread(s[mine], size[mine])])))
            yield _batch(rows)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Number the words of each bucket, sum their counts, and send both back to the blocks."""
        seen: dict[int, dict[bytes, int]] = {}
        sums: dict[int, list[int]] = {}
        held = []
        for row in _rows(batches):
            if row["kind"] == _POSITIONS:
                yield _batch([tuple(row[c] for c in _NAMES)])
                continue
            steps, counts, sizes, raw = unpack(row["blob"])
            known, sum_of = seen.setdefault(row["target"], {}), sums.setdefault(row["target"], [])
            raw, at, mine = raw.tobytes(), 0, []
            for n, c in zip(sizes.tolist(), counts.tolist()):
                i = known.setdefault(raw[at: at + n], len(known))
                at += n
                if i == len(sum_of):
                    sum_of.append(0)
                sum_of[i] += c
                mine.append(i)
            held.append((row["target"], row["chunk"], steps, np.array(mine, np.int64)))
        seen.clear()
        numbers = {}
        for bucket, s in sums.items():  # frequent words get small numbers
            n = np.array(s, np.int64)
            rank = np.empty(len(n), np.int64)
            rank[np.argsort(-n, kind="stable")] = np.arange(len(n))
            numbers[bucket] = (1 + rank * buckets + bucket, n)
            yield _batch([(bucket, -1, _KINDS, pack(np.array([int((n > 0).sum())])))])
        for bucket, chunk, steps, mine in held:
            number, n = numbers[bucket]
            yield _batch([(bucket, chunk, _WORDS, pack(steps, narrow(number[mine]), narrow(n[mine])))])

    def ask_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per block: its symbols, and the distinct pairs behind them, to their buckets."""
        for chunk, rows in runs(batches, "chunk"):
            x = Block(rows, n_ends, n_train, routes)
            a, b, n, _, ask, bucket = x.pairs(least)
            word, home = x.starters(least)
            asked = {k: ask[i:j] for k, i, j in _edges(bucket)}
            out = []
            for k, i, j in _edges(home):
                mine = asked.get(k, ask[:0])
                first = word[i:j]
                sizes = np.zeros(len(x.number), np.int64)
                np.add.at(sizes, a[mine], 1)
                used, second = np.unique(b[mine], return_inverse=True)
                out.append((k, chunk, _PAIRS, pack(
                    narrow(np.diff(x.number[first], prepend=0)), narrow(x.count[first]), narrow(sizes[first]),
                    narrow(x.number[used]), narrow(x.count[used]), narrow(second), narrow(n[mine]))))
            yield _batch(out)

    def count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Totals of the pairs, and each symbol's sum of gains or its bucket's part of it, to the blocks."""
        for target, rows in runs(batches, "target"):
            parts, chunks, asked = [], [], []
            for row in rows:
                first, n_first, sizes, number, count, second, n = unpack(row["blob"])
                first = np.cumsum(first.astype(np.int64))
                chunks.append(row["chunk"])
                asked.append(first)
                before = np.repeat(np.arange(len(first)), sizes)
                parts.append((first[before], number[second].astype(np.int64), n_first[before].astype(np.int64), count[second].astype(np.int64), n.astype(np.int64)))
            ends = np.cumsum([len(x[0]) for x in parts])[:-1]
            (before, _, n_before, n_next, _), back, n = _merged(parts, 2)
            parts.clear()
            total = np.bincount(back, n, minlength=len(before)).astype(np.int64)
            gain = left_out(total, (n_next + 1) / root, n_before.astype(np.float64), PRIORS[0])
            at = _starts(before)
            symbols, of, gain = before[at], n_before[at], np.add.reduceat(gain, at) if len(at) else np.zeros(0)
            spread_out = _fan(of, n_train, routes) > 1
            gain = np.where(spread_out, gain, np.where(gain >= of * DIVERGENCE, np.inf, -np.inf))
            for chunk, first, mine in zip(chunks, asked, np.split(back, ends)):
                where = np.minimum(np.searchsorted(symbols, first), max(0, len(symbols) - 1))
                mine_gain = np.where(symbols[where] == first, gain[where], 0.0) if len(symbols) else np.zeros(len(first))
                yield _batch([(target, chunk, _PAIRS, pack(narrow(total[mine]), mine_gain))])

    def with_triples(rows: Iterator[dict]) -> tuple:
        """A block, which of its symbols are retained, and its distinct pairs and triples; what is asked and what is answered have one order."""
        x = Block(rows, n_ends, n_train, routes)
        a, b, _, pair, ask, bucket = x.pairs(least)
        word, home = x.starters(least)
        n_pair, gain = np.zeros(len(a), np.int64), np.zeros(len(x.number))
        pairs_of, words_of = {k: ask[i:j] for k, i, j in _edges(bucket)}, {k: word[i:j] for k, i, j in _edges(home)}
        for row in x.rest:  # in the order of the buckets, so that all blocks add up alike
            if row["kind"] == _PAIRS:
                total, part = unpack(row["blob"])
                n_pair[pairs_of.get(row["target"], ask[:0])] = total
                gain[words_of[row["target"]]] += part
        kept = ((x.count >= least) & (gain >= x.count * DIVERGENCE)).astype(np.uint8)
        # the context is the pair that ends one position before; it may be too rare, and a text's first symbol has none
        context = np.zeros(len(pair), np.int64)
        context[1:] = n_pair[pair[:-1]]
        context[x.begin] = 0
        go = np.flatnonzero(context >= least)
        key, back = np.unique(pair[go - 1] * len(a) + pair[go], return_inverse=True)
        first, second = key // max(1, len(a)), key % max(1, len(a))
        to = x.bucket(b[first], a[first])
        by = np.lexsort((x.number[a[first]], x.number[b[first]], to))
        place = np.empty(len(by), np.int64)
        place[by] = np.arange(len(by))
        return x, kept, (a, b, n_pair, pair), (first[by], second[by], to[by], go, place[back])

    def ask_triples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per block: its distinct triples to their contexts' buckets."""
        for chunk, rows in runs(batches, "chunk"):
            x, kept, (a, b, n_pair, _), (first, second, to, go, back) = with_triples(rows)
            n = np.bincount(back, x.train[go], minlength=len(to)).astype(np.int64)
            w2, w1, w0 = a[first], b[first], b[second]
            out = []
            for k, i, j in _edges(to):
                symbols = np.concatenate([w2[i:j], w1[i:j], w0[i:j]])
                number, where, local = np.unique(x.number[symbols], return_index=True, return_inverse=True)
                used, (c2, c1, c0) = symbols[where], np.split(local, 3)  # in the order of the numbers, so that c1 rises and its steps are short
                out.append((k, chunk, _TRIPLES, pack(
                    narrow(np.diff(number, prepend=0)), narrow(x.count[used]), kept[used], narrow(c2), narrow(np.diff(c1, prepend=0)), narrow(c0),
                    narrow(n_pair[second[i:j]]), narrow(n[i:j]))))
            yield _batch(out)

    def count_triples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """1 more than the total of each triple whose context is retained, 0 for others, to the blocks."""
        for target, rows in runs(batches, "target"):
            parts, chunks = [], []
            for row in rows:
                number, count, kept, *local, n_pair, n = unpack(row["blob"])
                number, (a, b, c) = np.cumsum(number.astype(np.int64)), local
                b = np.cumsum(b.astype(np.int64))
                p = (count[c].astype(np.float64) + 1) / root
                p = np.where(kept[b] > 0, (n_pair + PRIORS[0] * p) / (count[b].astype(np.float64) + PRIORS[0]), p)
                chunks.append(row["chunk"])
                parts.append((number[a], number[b], number[c], p, n.astype(np.int64)))
            ends = np.cumsum([len(x[0]) for x in parts])[:-1]
            (a, b, _, p, _), back, n = _merged(parts, 3)
            parts.clear()
            n = np.bincount(back, n, minlength=len(a))
            at = _starts(a, b)
            size = np.diff(np.append(at, len(a)))
            of = np.add.reduceat(n, at)
            gain = np.add.reduceat(left_out(n, p, np.repeat(of, size), PRIORS[1]), at)
            total = np.where(np.repeat((of >= least) & (gain >= of * DIVERGENCE), size), n + 1, 0).astype(np.int64)
            for chunk, mine in zip(chunks, np.split(back, ends)):
                yield _batch([(target, chunk, _TRIPLES, pack(narrow(total[mine])))])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums of the documents by contexts of up to one symbol, and what retained contexts of two symbols add to them."""
        for _, rows in runs(batches, "chunk"):
            x, kept, (a, b, n_pair, pair), (first, second, _, go, back) = with_triples(rows)
            p0 = (x.count[b] + 1) / root
            p = np.where(kept[a] > 0, (n_pair + PRIORS[0] * p0) / (x.count[a] + PRIORS[0]), p0)
            many = len(x.keys)
            n = np.concatenate([back[:0], *(unpack(row["blob"])[0] for row in x.rest if row["kind"] == _TRIPLES)]).astype(np.int64)
            # a context's total is that of its pair: every pair but one that ends a text has a next symbol
            more = np.where(n > 0, np.log10((np.maximum(n, 1) - 1 + PRIORS[1] * p[second]) / (n_pair[first] + PRIORS[1]) / p[second]), 0.0)
            at = np.argsort(back, kind="stable")
            total = np.bincount(x.doc, np.log10(p)[pair], minlength=many) + np.bincount(x.doc[go][at], more[back[at]], minlength=many)
            base = np.bincount(x.doc, np.log10(x.count[x.symbol] + 1.0), minlength=many)
            yield pa.RecordBatch.from_arrays([
                pa.array(x.keys, pa.int64(), mask=x.valid == 0), pa.array(x.learn == 0), pa.array(x.sizes, pa.int64()),
                pa.array(np.bincount(x.doc, x.count[x.symbol] > 0, minlength=many).astype(np.int64)),
                pa.array(np.full(many, n_train), pa.int64()), pa.array(base - x.sizes * np.log10(root)), pa.array(total)],
                [key, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    def dealt(rows: DataFrame, by: str) -> DataFrame:
        return rows.repartition(buckets, by).sortWithinPartitions(by, "kind", "target")

    table = cut_lineage(docs.mapInArrow(split, _ROWS).repartition(buckets, "target").mapInArrow(total, _ROWS), release=True)
    kinds = table.where(F.col("kind") == _KINDS).select("blob").collect()  # one number per bucket
    n_kinds = sum(int(unpack(r["blob"])[0][0]) for r in kinds) + (n_ends > 0)
    root = float(n_train + n_kinds + 1)
    blocks = table.where(F.col("kind") != _KINDS)
    pairs = dealt(blocks, "chunk").mapInArrow(ask_pairs, _ROWS)
    pairs = cut_lineage(dealt(pairs, "target").mapInArrow(count_pairs, _ROWS), release=True)  # the questions leave the disk before the triples come
    known = blocks.unionAll(pairs)
    triples = dealt(known, "chunk").mapInArrow(ask_triples, _ROWS)
    triples = cut_lineage(dealt(triples, "target").mapInArrow(count_triples, _ROWS), release=True)  # and these before the answers go back
    return dealt(known.unionAll(triples), "chunk").mapInArrow(
        finish, f"`{key}` bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
