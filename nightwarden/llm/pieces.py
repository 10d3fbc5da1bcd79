"""Byte-level BPE for whole text blocks: cut into pieces on byte arrays, each distinct piece encoded once.

Only tokenizers of this kind are taken: byte-level pre-tokenizer with its usual pattern, no normalizer, merges in id
order. The result equals that of the tokenizers library with add_special_tokens=False: special tokens written out in a
text become their ids. Character classes are asked of the library itself, so they are those of its Unicode version.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np

from .blocks import spread, worker_store
from .words import hash_spans

CACHED_PIECES = 1 << 20
_LETTER, _NUMBER, _SPACE, _OTHER, _UNKNOWN = 0, 1, 2, 3, 255


def byte_characters() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class PieceEncoder:
    """Encodes blocks; keeps the ids of up to CACHED_PIECES distinct pieces."""

    def __init__(self, spec: bytes):
        import tiktoken
        from tokenizers import Tokenizer

        what = json.loads(spec)
        model, pre = what["model"], what["pre_tokenizer"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        ordered = all(model["vocab"]["".join(m)] == 256 + i for i, m in enumerate(merges))
        if what["normalizer"] or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"] or not ordered:
            raise ValueError("only plain byte-level BPE with merges in id order")
        to_byte = byte_characters()
        special = {t["content"]: t["id"] for t in what["added_tokens"]}
        self.special = [(t.encode(), i) for t, i in special.items()]
        self.pieces = {i: t.encode() if t in special else bytes(to_byte[c] for c in t) for t, i in (model["vocab"] | special).items()}
        ranks = {self.pieces[i]: i for t, i in model["vocab"].items() if t not in special}
        self.bpe = tiktoken.Encoding("pieces", pat_str="(?s:.+)", mergeable_ranks=ranks, special_tokens={})
        self.split_text = Tokenizer.from_str(spec.decode()).pre_tokenizer.pre_tokenize_str
        self.kinds = np.full(0x110000, _UNKNOWN, np.uint8)
        self.forget()

    def forget(self) -> None:
        self.keys, self.at, self.count = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int32)

    def kind(self, code: int) -> int:
        c = chr(code)
        return next((k for k, before in ((_LETTER, "a"), (_NUMBER, "1"), (_OTHER, "!")) if len(self.split_text(before + c)) == 1), _SPACE)

    def classes(self, data: np.ndarray) -> np.ndarray:
        """The class of the character that each byte belongs to."""
        if self.kinds[0] == _UNKNOWN:
            self.kinds[:128] = [self.kind(c) for c in range(128)]
        out = self.kinds[data]
        lead = np.flatnonzero(data >= 0xC0)
        if len(lead):
            b = data[lead].astype(np.int32)
            width = 2 + (b >= 0xE0) + (b >= 0xF0)
            code = b & np.array([0, 0, 0x1F, 0x0F, 0x07])[width]
            for j in range(1, 4):
                more = width > j
                code[more] = code[more] << 6 | data[lead[more] + j] & 0x3F
            for c in np.unique(code[self.kinds[code] == _UNKNOWN]):
                self.kinds[c] = self.kind(int(c))
            kinds = self.kinds[code]
            out[lead] = kinds
            for j in range(1, 4):
                more = width > j
                out[lead[more] + j] = kinds[more]
        return out

    def split(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, dict[int, int]]:
        """Where pieces start, and the ids of the starts that are special tokens."""
        n, edges, found = len(data), offsets, {}
        if not n:
            return np.zeros(0, np.int64), found
        raw = data.tobytes()
        for token, i in self.special:
            at = raw.find(token)
            while at >= 0:
                if np.searchsorted(offsets, at, "right") == np.searchsorted(offsets, at + len(token) - 1, "right"):
                    found[at] = i
                at = raw.find(token, at + 1)
        size = {i: len(t) for t, i in self.special}
        if found:
            edges = np.unique(np.concatenate([offsets, [x for a, i in found.items() for x in (a, a + size[i])]]))
        kinds = self.classes(data)
        begins = np.zeros(n + 1, bool)
        begins[edges] = True
        first = begins[:n]
        space = kinds == _SPACE
        same = np.zeros(n, bool)
        same[1:] = kinds[1:] == kinds[:-1]
        blank = data == 32
        after_blank = np.zeros(n, bool)
        after_blank[1:] = blank[:-1]
        start = first | ~same & (space | ~after_blank)
        # The last white space before other text stands alone, or joins that text if it is a plain blank.
        last = space.copy()
        last[:-1] &= ~space[1:] & ~begins[1:n]
        last[-1] = False
        at = np.flatnonzero(last)
        while len(inner := np.flatnonzero(data[at] & 0xC0 == 0x80)):
            at[inner] -= 1
        start[at] = True
        # 's 't 'm 'd 're 've 'll after a letter, number, start or other white space.
        quote = np.flatnonzero((data == 39) & start)
        for ending in (b"s", b"t", b"m", b"d", b"re", b"ve", b"ll"):
            k = len(ending)
            at = quote[quote + k < n]
            hit = np.ones(len(at), bool)
            for j, c in enumerate(ending, 1):
                hit &= (data[at + j] == c) & ~begins[at + j]
            at = at[hit]
            start[at + 1] = False
            inside = at[at + k + 1 < n] + k + 1
            start[inside[~space[inside]]] = True
        for a, i in found.items():
            start[a + 1: a + size[i]] = False
        return np.flatnonzero(start), found

    def encode_piece(self, piece: bytes) -> list[int]:
        return self.bpe._core_bpe.encode_single_piece(piece)

    def look_up(self, keys: np.ndarray, raw: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(at, count) in self.ids for distinct sorted keys."""
        if len(self.keys) > CACHED_PIECES:
            self.forget()
        pos = np.searchsorted(self.keys, keys)
        missing = np.ones(len(keys), bool)
        inside = pos < len(self.keys)
        missing[inside] = self.keys[pos[inside]] != keys[inside]
        new = np.flatnonzero(missing)
        if len(new):
            ids = [self.encode_piece(raw[s:e]) for s, e in zip(starts[new].tolist(), ends[new].tolist())]
            count = np.fromiter(map(len, ids), np.int64, len(ids))
            at = len(self.ids) + np.cumsum(count) - count
            self.ids = np.concatenate([self.ids, np.fromiter((x for i in ids for x in i), np.int32, int(count.sum()))])
            self.keys, self.at, self.count = (np.insert(a, pos[new], b) for a, b in ((self.keys, keys[new]), (self.at, at), (self.count, count)))
            pos = np.searchsorted(self.keys, keys)
        return self.at[pos], self.count[pos]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all documents in order, offsets of the documents in them)."""
        starts, found = self.split(data, offsets)
        ends = np.append(starts[1:], len(data)) if len(starts) else starts
        h = hash_spans(data, starts, ends)
        keys, where, back = np.unique(h, return_index=True, return_inverse=True)
        at, count = self.look_up(keys, data.tobytes(), starts[where], ends[where])
        lengths = count[back]
        ids = self.ids[spread(at[back], lengths)]
        before = np.concatenate([[0], np.cumsum(lengths)])
        if found:  # rare: a special token's piece has its one id
            for a, i in found.items():
                p = int(np.searchsorted(starts, a))
                ids[before[p]] = i
                ids[before[p] + 1: before[p + 1]] = -1
            keep = ids >= 0
            before = np.concatenate([[0], np.cumsum(keep)])[before]
            ids = ids[keep]
        return ids, before[np.searchsorted(starts, offsets)]

    def decode(self, ids: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Join ids with the id-to-piece table: (bytes of all documents, offsets)."""
        if not hasattr(self, "table"):
            size = max(self.pieces) + 1
            self.width = np.array([len(self.pieces.get(i, b"")) for i in range(size)])
            self.where = np.cumsum(self.width) - self.width
            self.table = np.frombuffer(b"".join(self.pieces.get(i, b"") for i in range(size)), np.uint8)
        width = self.width[ids]
        before = np.concatenate([[0], np.cumsum(width)])
        return self.table[spread(self.where[ids], width)], before[edges]


def read_spec(path: str) -> bytes:
    """The tokenizer's file, read on the driver; about 1.5 MB, so it can go to every task."""
    with open(path, "rb") as f:
        return f.read()


def encoder(spec: bytes) -> PieceEncoder:
    """This worker's encoder for a tokenizer file."""
    store, key = worker_store(), "encoder-" + hashlib.sha256(spec).hexdigest()
    if key not in store:
        store[key] = PieceEncoder(spec)
    return store[key]
