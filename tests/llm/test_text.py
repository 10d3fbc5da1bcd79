"""Blocks, words and pieces against plain Python and the tokenizers library."""

import random

import numpy as np
import pyarrow as pa

from nightwarden.llm import blocks, pieces, words

from . import plain


def test_blocks_keep_rows_in_order_and_long_texts_whole():
    texts = ["a" * 10, None, "b" * 100, "", "é" * 30]
    batch = pa.RecordBatch.from_pydict({"text": pa.array(texts).slice(0)})
    got = list(blocks.text_blocks(iter([batch]), size=50))
    assert [t for b in got for t in b.column(0).to_pylist()] == texts and len(got) > 1
    data, offsets = blocks.utf8(batch.slice(2).column(0))
    assert [data[a:b].tobytes().decode() for a, b in zip(offsets, offsets[1:])] == texts[2:]
    assert len(blocks.utf8(pa.array([], pa.string()))[1]) == 1


def test_packed_arrays_come_back():
    arrays = [np.arange(1000, dtype=np.int64) - 7, np.zeros(0, np.uint16), np.array([3], np.uint8), np.linspace(0, 1, 5)]
    for a, b in zip(arrays, blocks.unpack(blocks.pack(*arrays))):
        assert a.dtype == b.dtype and (a == b).all()


def test_spread_of_spans():
    starts, lengths = np.array([5, 0, 9, 9]), np.array([2, 0, 3, 1])
    assert blocks.spread(starts, lengths).tolist() == [5, 6, 9, 10, 11, 9]
    assert blocks.spread(starts[:0], lengths[:0]).tolist() == []


def test_runs_of_equal_keys():
    batches = [pa.RecordBatch.from_pydict({"k": k}) for k in ([1, 1, 2], [2, 3], [3, 3])]
    assert [(k, len(list(r))) for k, r in blocks.runs(iter(batches), "k")] == [(1, 2), (2, 2), (3, 3)]
    assert [k for k, _ in blocks.runs(iter(batches), "k")] == [1, 2, 3]  # unread runs are skipped


def test_words_equal_the_pattern():
    texts = plain.hard_texts(3)
    data, offsets = blocks.utf8(pa.array(texts, pa.string()))
    starts, ends, first = words.split(data, offsets)
    raw = data.tobytes()
    got = [[raw[starts[w]:ends[w]].decode() for w in range(first[i], first[i + 1])] for i in range(len(texts))]
    assert got == [plain.words(t) for t in texts]
    h = words.hash_spans(data, starts, ends)
    by_hash = {}
    for s, e, k in zip(starts, ends, h.tolist()):
        assert by_hash.setdefault(k, raw[s:e]) == raw[s:e]
    assert len(by_hash) == len(set(by_hash.values()))


def test_hashes_of_words_that_differ_in_one_byte():
    texts = [f"erbleo{a}{b}" for a in "abcdefghijklmnopqrst" for b in "abcdefghijklmnopqrstuvwxyz"] + ["x" * n for n in range(1, 700, 7)]
    data, offsets = blocks.utf8(pa.array(texts))
    assert len(set(words.hash_spans(data, *words.split(data, offsets)[:2]).tolist())) == len(texts)


def test_span_hashes_depend_on_content_alone():
    h = words.mix(np.array([1, 2, 3, 9, 1, 2, 3], np.uint64))
    one, two = words.span_hashes(h, np.array([0, 4, 0, 2, 5]), np.array([3, 7, 4, 2, 5]))
    assert one[0] == one[1] != one[2] and two[0] == two[1] != two[2] and one[3] == one[4]


def test_pieces_equal_the_library(spec, library):
    bits = ["a", "B", "s", "t", "re", "ve", "ll", "'", "'s", " ", "  ", "\n", "\t", " ", "　", " ", "é", "ß", "中", "1", "²", "٣", "!",
            "?", "😀", "́", "\x00", "\x85", "\x1c", "<|endoftext|>", "<|endoftext", "|>", "d", "m", "​", "Ⅷ", "க", "﻿", "\x0b", "\r"]
    rng, encoder = random.Random(1), pieces.PieceEncoder(spec)
    for _ in range(60):
        texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(25))) if rng.random() > 0.05 else None for _ in range(50)]
        ids, edges = encoder.encode(*blocks.utf8(pa.array(texts, pa.string())))
        want = [x.ids for x in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
        assert [ids[a:b].tolist() for a, b in zip(edges, edges[1:])] == want
        data, at = encoder.decode(ids, edges)
        assert [data[a:b].tobytes().decode() for a, b in zip(at, at[1:])] == [t or "" for t in texts]


def test_the_piece_cache_may_be_forgotten(spec, library, monkeypatch):
    monkeypatch.setattr(pieces, "CACHED_PIECES", 3)
    encoder = pieces.PieceEncoder(spec)
    for text in plain.hard_texts(5, 20):
        ids, _ = encoder.encode(*blocks.utf8(pa.array([text], pa.string())))
        assert ids.tolist() == library.encode(text or "", add_special_tokens=False).ids
