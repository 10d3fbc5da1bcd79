"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are counted over the whole text (null: empty): byte classes, words, repeated and adjacent equal words, word
ends, lines. Trees are fitted on histograms of binned statistics, on a sample of at most SAMPLE_ROWS labelled documents
(those with the smallest hashes of their key), in one task, which gets nothing but their statistics. The forest becomes five flat
arrays that every task holds; scoring walks all trees for a block of documents at once.

Labels: null labels are left out; a key with several labels takes the smallest. Documents that share a key all count.
Without labelled documents, or with one class only, every score is the share of class 1 (0.5 without any). An empty text
has statistics (zeros) and so a score. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words
from .blocks import text_blocks, utf8

SAMPLE_ROWS = 32768
TREES, DEPTH, BINS, RATE, LEAF_ROWS, RIDGE = 80, 5, 64, 0.15, 20, 1.0

_CLASSES = ["upper", "lower", "digit", "space", "line", "stop", "mark", "symbol", "beyond", "other"]
_CLASS = np.full(256, 9, np.uint8)
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58], _CLASS[128:] = 0, 1, 2, 8
for _c, _k in ((b" \t", 3), (b"\n\r\x0b\x0c", 4), (b".,;:", 5), (b"!?", 6), (b"#$%&*@|<>=~^\\/+_", 7)):
    _CLASS[list(_c)] = _k
STATISTICS = [f"share_{c}" for c in _CLASSES] + [
    "log_bytes", "log_words", "word_bytes", "distinct", "top_word", "adjacent_equal", "symbol_end", "mark_end", "stop_end",
    "upper_start", "all_upper", "words_per_line", "short_words", "long_words", "stop_words_per_word"]


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of STATISTICS for each document of a block."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    doc = np.repeat(np.arange(n), size)
    kinds = _CLASS[data]
    classes = np.bincount(doc * 10 + kinds, minlength=n * 10).reshape(n, 10)
    share = classes / np.maximum(size, 1)[:, None]
    starts, ends, first = words.split(data, offsets)
    count = np.diff(first)
    many = np.maximum(count, 1)
    mine = np.repeat(np.arange(n), count)
    h = words.hash_spans(words.lower(data), starts, ends)

    def per_word(flag: np.ndarray) -> np.ndarray:
        return np.bincount(mine, flag, minlength=n) / many

    key, times = np.unique((mine.astype(np.uint64) << np.uint64(44)) | (h >> np.uint64(20)), return_counts=True)
    owner = (key >> np.uint64(44)).astype(np.int64)
    top = np.zeros(n, np.int64)
    if len(key):
        there = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        top[owner[there]] = np.maximum.reduceat(times, there)
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (mine[1:] == mine[:-1])
    last, head, length = kinds[ends - 1], kinds[starts], ends - starts
    second = kinds[np.minimum(starts + 1, ends - 1)]
    return np.column_stack([
        share, np.log1p(size), np.log1p(count), np.bincount(mine, length, minlength=n) / many,
        np.bincount(owner, minlength=n) / many, top / many, per_word(same), per_word(last == 7), per_word(last == 6),
        per_word(last == 5), per_word(head == 0), per_word((head == 0) & (second == 0)), count / (classes[:, 4] + 1),
        per_word(length <= 2), per_word(length >= 12), classes[:, 5] / many])


@dataclass
class Forest:
    """Trees as flat arrays: a node goes right if its statistic exceeds the threshold; leaves point to themselves."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(DEPTH):
                right = x[rows, self.feature[node]] > self.threshold[node]
                node = np.where(right, self.right[node], self.left[node])
            total += self.value[node]
        return 1.0 / (1.0 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray) -> Forest:
    """Boosted trees for the logistic loss; y is 0 or 1."""
    mean = float(y.mean()) if len(y) else 0.5
    empty = [np.zeros(0, np.int32), np.zeros(0), np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0), np.zeros(0, np.int32)]
    if not len(y) or not 0 < mean < 1:
        return Forest(*empty, base={0.0: -np.inf, 1.0: np.inf}.get(mean, 0.0))
    n, k = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(k)]
    binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], 1)
    nodes: list[list] = []
    base = float(np.log(mean / (1 - mean)))
    margin, roots = np.full(n, base), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        gradient, weight = y - p, np.maximum(p * (1 - p), 1e-9)
        roots.append(len(nodes))
        nodes.append([0, np.inf, len(nodes), len(nodes), 0.0])
        level, at = [roots[-1]], np.zeros(n, np.int64)  # at: index into level, or -1 in a finished leaf
        rows = np.arange(n)
        for depth in range(DEPTH + 1):
            m = len(level)
            live = rows[at >= 0]
            g, w, c = (np.stack([np.bincount(at[live] * BINS + binned[live, j], v, minlength=m * BINS).reshape(m, BINS) for j in range(k)])
                       for v in (gradient[live], weight[live], None))
            total_g, total_w = g[0].sum(1), w[0].sum(1)
            for i, node in enumerate(level):
                nodes[node][4] = RATE * total_g[i] / (total_w[i] + RIDGE)
            gl, wl, cl = (a.cumsum(2)[:, :, :-1] for a in (g, w, c))
            gr, wr, cr = total_g[None, :, None] - gl, total_w[None, :, None] - wl, c[0].sum(1)[None, :, None] - cl
            gain = gl**2 / (wl + RIDGE) + gr**2 / (wr + RIDGE) - (total_g**2 / (total_w + RIDGE))[None, :, None]
            gain[(cl < LEAF_ROWS) | (cr < LEAF_ROWS)] = 0
            following, go = [], np.full((m, 2), -1)
            split_feature, split_bin = np.zeros(m, np.int64), np.zeros(m, np.int64)
            for i, node in enumerate(level if depth < DEPTH else []):
                j, b = divmod(int(gain[:, i].argmax()), BINS - 1)
                if gain[j, i, b] > 1e-6 and b < len(cuts[j]):
                    left = len(nodes)
                    nodes.extend([0, np.inf, left + s, left + s, 0.0] for s in (0, 1))
                    nodes[node][:4] = [j, cuts[j][b], left, left + 1]
                    go[i] = len(following), len(following) + 1
                    following += [left, left + 1]
                    split_feature[i], split_bin[i] = j, b
            now = at[live]
            right = binned[live, split_feature[now]] > split_bin[now]
            done = go[now, 0] < 0
            values = np.array([nodes[v][4] for v in level])
            margin[live[done]] += values[now[done]]
            at[live] = np.where(done, -1, go[now, right.astype(int)])
            level = following
            if not level:
                break
    columns = list(zip(*nodes))
    return Forest(np.array(columns[0], np.int32), np.array(columns[1]), np.array(columns[2], np.int32),
                  np.array(columns[3], np.int32), np.array(columns[4]), np.array(roots, np.int32), base)


def train(df: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text",
          learn: Column | None = None, sample_rows: int = SAMPLE_ROWS) -> Forest:
    """Fit on documents whose key has a label; `learn` (over the key) says which keys may be used."""
    marks = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull())
    marks = (marks.where(learn) if learn is not None else marks).groupBy(key).agg(F.min(label).cast("int").alias("__label"))
    marks = marks.orderBy(F.xxhash64(F.lit(11), key), key).limit(sample_rows)
    rows = df.select(key, text).join(F.broadcast(marks), key).select(text, "__label")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_blocks(batches, text):
            x = statistics(*utf8(b.column(0)))
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(list(x), pa.list_(pa.float64()))], ["label", "x"])

    measured = rows.mapInArrow(measure, "label int, x array<double>")

    def learn_trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(b.column(0).to_numpy(), b.column(1).flatten().to_numpy().reshape(-1, len(STATISTICS))) for b in batches if b.num_rows]
        y = np.concatenate([a for a, _ in got]) if got else np.zeros(0)
        x = np.concatenate([a for _, a in got]) if got else np.zeros((0, len(STATISTICS)))
        by = np.lexsort((*x.T, y))  # the same trees whatever order the rows come in
        f = fit(x[by], y[by].astype(np.float64))
        arrays = [f.feature, f.threshold, f.left, f.right, f.value, f.roots, np.array([f.base])]
        yield pa.RecordBatch.from_arrays([pa.array([a.astype(float).tolist()], pa.list_(pa.float64())) for a in arrays],
                                         ["feature", "threshold", "left", "right", "value", "roots", "base"])

    names = ["feature", "threshold", "left", "right", "value", "roots", "base"]
    row = measured.repartition(1).mapInArrow(learn_trees, ", ".join(f"`{c}` array<double>" for c in names)).collect()
    if not row:
        return fit(np.zeros((0, len(STATISTICS))), np.zeros(0))
    kinds = [np.int32, float, np.int32, np.int32, float, np.int32]
    return Forest(*(np.array(row[0][c]).astype(k) for c, k in zip(names, kinds)), base=row[0]["base"][0])


def with_score(df: DataFrame, forest: Forest, text: str = "text", out: str = "score") -> DataFrame:
    """All columns and the score (0 to 1, higher: class 1 likelier); a column named `out` is replaced."""
    df = df.drop(out)
    where = df.columns.index(text)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_blocks(batches, text):
            score = forest.score(statistics(*utf8(b.column(where))))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(score)], [*b.schema.names, out])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), f"`{out}` double"])
    return df.mapInArrow(add, schema)
