"""Encoding, packing and containers against the tokenizers library."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from nightwarden.llm import packing, rans, word_bpe


def little(ids):
    return np.array(ids, "<u4").tobytes()


def test_words_are_encoded_once_and_come_back(spark, docs, rows, spec, library, monkeypatch):
    monkeypatch.setattr(word_bpe, "SPLIT_BYTES", 3000)
    encoded = word_bpe.encode(docs, spec)
    decoded = word_bpe.decode(encoded, spec)
    got = Counter((r.doc_id, bytes(r.ids), r.text) for r in decoded.collect())
    want = [(i, library.encode(t or "", add_special_tokens=False).ids) for i, t in rows]
    assert got == Counter((i, little(ids), library.decode(ids, skip_special_tokens=False)) for i, ids in want)


def test_decode_of_other_ids(spark, spec, library):
    ids = [[], [50256, 11], [127, 222], None]
    df = spark.createDataFrame([(i, None if x is None else bytearray(little(x)), "old") for i, x in enumerate(ids)], "k int, ids binary, text string")
    got = {r.k: r.text for r in word_bpe.decode(df, spec).collect()}
    assert got == {i: library.decode(x or [], skip_special_tokens=False) for i, x in enumerate(ids)}


def test_no_rows(spark, empty, spec):
    assert word_bpe.decode(word_bpe.encode(empty, spec), spec).count() == 0
    assert packing.best_fit(packing.token_pieces(empty, spec)).count() == 0
    assert rans.from_containers(rans.to_containers(empty, spec)).count() == 0


def test_pieces_and_sequences(spark, docs, rows, spec, library):
    limit = 64
    pieces = packing.token_pieces(docs, spec, limit=limit, end=2)
    packed = packing.best_fit(pieces.withColumn("offset", F.lit(-1)), limit=limit, max_cost=limit * limit, groups=2).collect()
    assert len(packed) == pieces.count()
    sequences = defaultdict(list)
    for r in packed:
        sequences[r.sequence_id].append((r.offset, r.length))
    for places in sequences.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= limit
    tokens = sum(r.length for r in packed)
    assert len(sequences) <= tokens / limit * 1.1 + 3
    want = Counter()
    for i, t in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        head = (len(ids) - 1) % limit + 1
        cuts = [0, *range(head, len(ids) + 1, limit)]
        want.update((i, n, a, b - a, little(ids[a:b])) for n, (a, b) in enumerate(zip(cuts, cuts[1:])))
    assert Counter((r.doc_id, r.piece, r.start, r.length, bytes(r.ids)) for r in packed) == want


def by_loop(demand, capacity, weights, rule):
    """Best fit as it is defined: every open bin is looked at."""
    bins, out = [], []
    for d in demand:
        best = None
        for i, left in enumerate(bins):
            if all(x <= r for x, r in zip(d, left)):
                if rule == "norm":
                    s = sum(w * ((r - x) / c) ** 2 for w, r, x, c in zip(weights, left, d, capacity))
                else:
                    s = -sum(w * (r / c) * (x / c) for w, r, x, c in zip(weights, left, d, capacity))
                if best is None or s < best[0] - 1e-12:
                    best = (s, i)
        if best is None:
            bins.append(list(capacity))
            best = (0, len(bins) - 1)
        bins[best[1]] = [r - x for r, x in zip(bins[best[1]], d)]
        out.append(best[1])
    return out


@pytest.mark.parametrize("rule,weights", [("norm", (1, 0, 0)), ("norm", (1, 1, 1)), ("dot", (1, 0.5, 2))])
def test_placing_equals_the_loop_under_every_capacity(rule, weights):
    rng = random.Random(3)
    length = sorted((rng.randrange(1, 60) for _ in range(700)), reverse=True)
    demand = np.array([(n, 1, n * n) for n in length])
    capacity = np.array([100.0, 5, 4000])
    bins, order = packing.place(demand, capacity, np.array(weights, float), rule)
    assert bins.tolist() == by_loop(demand.tolist(), capacity.tolist(), weights, rule)
    for b in set(bins):
        mine = demand[bins == b]
        assert (mine.sum(0) <= capacity).all() and sorted(order[bins == b]) == list(range(len(mine)))
    with pytest.raises(ValueError):
        packing.place(np.array([[101, 1, 1]]), capacity, np.ones(3))


def test_containers_hold_ids_in_key_order(spark, docs, rows, spec, library, monkeypatch):
    for name, value in (("CONTAINER_IDS", 700), ("BLOCK", 512), ("LANES", 8), ("CHECK", 4)):
        monkeypatch.setattr(rans, name, value)
    containers = rans.to_containers(docs, spec, end=0)
    got = sorted((r.start, r.doc_id, bytes(r.ids)) for r in rans.from_containers(containers).collect())
    at, seen = 0, Counter()
    for start, doc, ids in got:
        assert start == at
        at += len(ids) // 4
        seen[doc, ids] += 1
    assert seen == Counter((i, little([*library.encode(t or "", add_special_tokens=False).ids, 0])) for i, t in rows)
    order = [d for _, d, _ in got]
    assert order == sorted(order, key=lambda d: (d is not None, d or 0))


def test_blocks_decode_alone_and_from_checkpoints(monkeypatch):
    import pyarrow as pa

    for name, value in (("BLOCK", 1000), ("LANES", 16), ("CHECK", 8)):
        monkeypatch.setattr(rans, name, value)
    rng = np.random.default_rng(1)
    for ids in (np.minimum(rng.geometric(0.05, 3333), 60000), np.full(500, 7), rng.integers(0, 50000, 2500), np.zeros(1, int)):
        payload = rans.to_container(pa.array([5]), ids, np.array([len(ids)]))
        c = rans.Container(payload)
        assert (c.ids() == ids).all()
        for i in range(len(c.blocks)):
            whole = c.block(i)
            for k in range(c.blocks[i][2]):
                assert (c.block(i, k) == whole[k * 8 * 16:]).all()
    broken = bytearray(payload[:-1]) + bytes([payload[-1] ^ 1])
    short = rans.to_container(pa.array([5]), rng.integers(0, 50000, 2500), np.array([2500]))
    broken = bytearray(short)
    broken[-3] ^= 64
    with pytest.raises(ValueError):
        rans.Container(bytes(broken)).ids()
    assert zlib.crc32(short) != zlib.crc32(bytes(broken))


def test_frequencies_fill_the_table():
    for ids in (np.arange(50000), np.r_[np.zeros(10**6, int), 1], np.array([3])):
        symbols, f = rans.frequencies(ids)
        assert f.min() >= 1 and f.sum() == 1 << rans.SCALE and len(symbols) == len(np.unique(ids))
