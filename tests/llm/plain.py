"""The operators restated as plain loops, and texts that are hard on them."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def hard_texts(seed=1, n=60):
    """Copies, near copies, shared passages, one very long text, repeated words, odd characters, empty and null texts."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefgé") for _ in range(rng.randrange(1, 7))) for _ in range(300)]

    def prose(k):
        return " ".join(rng.choice(vocabulary) for _ in range(k))

    base, passage = prose(200), prose(60)
    texts = [None, "", " \t\n", "one", "One  ONE\none", "the " * 80, base, base, base, "<|endoftext|> a<|endoftext|>", "  x'll 'sé it's　y  ",
             "z" * 3000, prose(4000) + " " + passage, "\x00\x1c\x85 ²Ⅷ 😀!?", passage]
    for _ in range(12):
        w = base.split()
        w[rng.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    while len(texts) < n:
        texts.append(prose(rng.randrange(1, 120)) + rng.choice([" ", "\n"]) + (passage if rng.random() < 0.3 else prose(5)))
    return texts


def words(text, lower=False):
    return WORD.findall((text or "").translate(LOWER) if lower else text or "")


def shingles(text, n):
    w = words(text, True)
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def classes(rows, n, num, den):
    """rows of (key, text) -> (set size, smallest key reachable) of each."""
    sets = [shingles(t, n) for _, t in rows]
    near = defaultdict(set)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and den * len(a & b) >= num * len(a | b):
                near[i].add(j)
                near[j].add(i)
    out = []
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            todo += (new := near[todo.pop()] - seen)
            seen |= new
        keys = [rows[j][0] for j in seen if rows[j][0] is not None]
        out.append((rows[i][0], len(sets[i]), min(keys, default=None) if sets[i] else rows[i][0]))
    return out


def without_repeats(texts, window):
    """(words, removed, kept) of each text."""
    split = [words(t) for t in texts]
    times = Counter(tuple(w[i:i + window]) for w in split for i in range(len(w) - window + 1))
    out = []
    for w in split:
        gone = set()
        for i in range(len(w) - window + 1):
            if times[tuple(w[i:i + window])] > 1:
                gone |= set(range(i, i + window))
        out.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def suffix_tree(rows, learn, share, divergence, priors):
    """(tokens, known, training tokens, base, score) of each text; learn says which are learned from."""
    end = object()
    split = [words(t, True) + [end] for t in rows]
    one, two, three = Counter(), Counter(), Counter()
    for w, yes in zip(split, learn):
        if yes:
            history = [end] + w[:-1]
            one.update(w)
            two.update(zip(history, w))
            three.update(zip(history, w[:-1], w[1:]))
    total = sum(one.values())
    root, least = total + len(one) + 1, max(2, math.ceil(share * total))

    def p0(x):
        return (one[x] + 1) / root

    def gain(n, of, p, prior):
        return n * math.log((n - 1 + prior * p) / (of - 1 + prior) / p)

    mean = defaultdict(float)
    for (a, x), n in two.items():
        mean[a] += gain(n, one[a], p0(x), priors[0]) / one[a]
    single = {a for a, g in mean.items() if one[a] >= least and g >= divergence}

    def p1(a, x):
        return (two[a, x] + priors[0] * p0(x)) / (one[a] + priors[0]) if a in single else p0(x)

    mean = defaultdict(float)
    for (a, b, x), n in three.items():
        if two[a, b] >= least:
            mean[a, b] += gain(n, two[a, b], p1(b, x), priors[1]) / two[a, b]
    double = {c for c, g in mean.items() if g >= divergence}
    out = []
    for w in split:
        score, a, b = 0.0, None, end
        for x in w:
            score += math.log10((three[a, b, x] + priors[1] * p1(b, x)) / (two[a, b] + priors[1]) if (a, b) in double else p1(b, x))
            a, b = b, x
        out.append((len(w), sum(one[x] > 0 for x in w), total, sum(math.log10(p0(x)) for x in w), score))
    return out


def crc(value):
    return zlib.crc32(str(value).encode())
