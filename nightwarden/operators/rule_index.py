"""Thousands of rules over one scan (C14): an index from the values of an event to the rules that it can match.

A rule's condition becomes terms (any may hold) of selections that must hold or must not. Every test of a selection that must hold is an
indexed predicate where its literals can be looked up: equality by (field, value), contained, leading and trailing texts by
(field, rarest trigram of the literal). An event's own values and trigrams are looked up in Arrow batches. A term is met by the predicate that
fewest terms share; then its hits are counted, and its rule is evaluated only for events that hit all its predicates. Evaluation is exact and data-driven: the rules travel as a table of tests,
so the plan does not grow with their number. Terms without a predicate that can be looked up are evaluated for every event.

Results equal `rules.match_rules` for rules that look at one event. Missing values match no test but null itself; ties do not
arise, an event is listed once for each rule. Nothing is shuffled, and each task holds the index, which grows with the rules only.
"""

from __future__ import annotations

import ast
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import rules as ru

LINE = "__line"
MAX_TERMS = 64
EVERY = "*"
GRAM = 3


@dataclass(frozen=True)
class Test:
    """One field test; values are lower-case texts, `null` says whether a missing value matches."""

    field: str
    op: str
    values: tuple[str, ...]
    null: bool = False


@dataclass
class Compiled:
    """A rule as data: tests of each selection, and terms of selection numbers from 1, negative where it must not hold."""

    selections: list[list[list[Test]]] = field(default_factory=list)
    terms: list[list[int]] = field(default_factory=list)


def tests_of(body) -> list[list[Test]]:
    """A selection as alternatives of tests that must all hold."""
    if isinstance(body, list):
        phrases = tuple(str(w).lower() for w in body if not isinstance(w, dict))
        alternatives = [tests for w in body if isinstance(w, dict) for tests in tests_of(w)]
        return alternatives + ([[Test(LINE, "contains", phrases)]] if phrases else [])
    tests = []
    for field_expr, expected in body.items():
        name, mods = ru._modifiers(field_expr)
        values = expected if isinstance(expected, list) else [expected]
        null, texts = any(v is None for v in values), tuple(str(v) for v in values if v is not None)
        op = "all" if "all" in mods else next(iter(mods), "eq")
        tests.append(Test(name.lower(), op, tuple(f"(?i){t}" for t in texts) if op == "re" else tuple(t.lower() for t in texts), null))
    return [tests]


def terms_of(rule: ru.Rule) -> list[list[int]]:
    """The condition as alternatives of selections that must (n) or must not (-n) hold, n from 1."""
    numbers = {name: i + 1 for i, name in enumerate(rule.selections)}
    text = ru.condition_text(rule, lambda name: f"s{numbers[name]}").replace("`", "")

    def both(a: list[frozenset], b: list[frozenset]) -> list[frozenset]:
        out = list(dict.fromkeys(x | y for x in a for y in b if not any(-n in y for n in x)))
        if len(out) > MAX_TERMS:
            raise ru.RuleError(f"condition {rule.condition!r} has too many alternatives")
        return out

    def alternatives(node: ast.expr, holds: bool) -> list[frozenset]:
        if isinstance(node, ast.UnaryOp):
            return alternatives(node.operand, not holds)
        if isinstance(node, ast.Name):
            n = int(node.id[1:])
            return [frozenset([n if holds else -n])]
        parts = [alternatives(v, holds) for v in node.values]
        if isinstance(node.op, ast.And) == holds:
            return reduce(both, parts)
        return list(dict.fromkeys(t for p in parts for t in p))

    # and, or, not and parentheses bind in rules as they do in Python
    return [sorted(t) for t in alternatives(ast.parse(text, mode="eval").body, True)]


def compile_rule(rule: ru.Rule) -> Compiled:
    return Compiled([tests_of(body) for body in rule.selections.values()], terms_of(rule))


def grams(text: str) -> list[str]:
    return [text[i:i + GRAM] for i in range(len(text) - GRAM + 1)]


def literals(test: Test) -> list[list[str]] | None:
    """Groups of literals of which one each must occur, or None where that can't be looked up."""
    if test.null or test.op == "re" or not test.values:
        return None
    if test.op == "eq":
        return [list(test.values)]
    groups = [[v] for v in test.values] if test.op == "all" else [list(test.values)]
    groups = [g for g in groups if all(len(v) >= GRAM for v in g)]
    return groups or None


def index_rows(compiled: list[Compiled]) -> list[tuple[str, int, int, int, int]]:
    """(atom, rule, term, predicate, predicates of the term); an atom names a field and what must be in it."""
    common = Counter(g for c in compiled for s in c.selections for tests in s for t in tests if t.op not in ("eq", "re") for v in t.values for g in set(grams(v)))
    out = []
    for r, c in enumerate(compiled):
        for number, term in enumerate(c.terms):
            groups: list[set[str]] = []
            for selection in (c.selections[n - 1] for n in term if n > 0):
                if len(selection) != 1:
                    continue  # alternatives inside a selection: no single test must hold
                for t in selection[0]:
                    for group in literals(t) or []:
                        rare = (min(grams(v), key=lambda g: (common[g], g)) for v in group) if t.op != "eq" else group
                        groups.append({f"{t.field}{'=' if t.op == 'eq' else '~'}{v}" for v in rare})
            if not groups:
                groups = [{EVERY}]
            out += [(atom, r, number, p, len(groups)) for p, g in enumerate(groups) for atom in sorted(g)]
    return out


def texts_of(name: str) -> Column:
    """The lower-case texts that a field's tests look at: one, the items of a list, or none."""
    if name == LINE:
        return F.array_compact(F.array(F.lower(ru.log_line())))
    col, kind = ru.field_column(name), ru._field_type(name)
    if isinstance(kind, T.ArrayType):
        return F.coalesce(F.transform(F.array_compact(col), F.lower), F.array().cast("array<string>"))
    if isinstance(kind, T.MapType):
        return F.array_compact(F.array(F.lower(F.to_json(col))))
    return F.array_compact(F.array(F.lower(col.cast("string"))))


def missing(name: str) -> Column:
    return F.lit(False) if name == LINE else ru.field_column(name).isNull()


def _holds(test: Column, texts: Column, gone: Column) -> Column:
    """Whether a test (field, op, values, null) holds for an event's texts by field number."""
    op, values = test["op"], test["values"]

    def one(text: Column) -> Column:
        def some(f):
            return F.exists(values, lambda v: f(text, v))

        return (
            F.when(op == "eq", F.array_contains(values, text)).when(op == "contains", some(lambda x, v: F.contains(x, v)))
            .when(op == "all", F.forall(values, lambda v: F.contains(text, v))).when(op == "startswith", some(lambda x, v: F.startswith(x, v)))
            .when(op == "endswith", some(lambda x, v: F.endswith(x, v))).otherwise(some(lambda x, v: F.regexp_like(x, v))))

    return F.exists(F.element_at(texts, test["field"]), one) | (test["null"] & F.element_at(gone, test["field"]))


_RULES = ("__rule int, rule_ord int, selections array<array<array<struct<field:int,op:string,values:array<string>,null:boolean>>>>, "
          "terms array<array<int>>")


class Index:
    """From texts of a field to atoms, and from atoms to the terms whose predicates they may satisfy.

    Each term is found by the predicate that it shares with the fewest others, so that a predicate of hundreds of rules costs an event nothing;
    its other predicates are then counted among the event's atoms.
    """

    def __init__(self, rows: list[tuple[str, int, int, int, int]]):
        terms = sorted({(rule, term) for _, rule, term, _, _ in rows})
        number = {t: i for i, t in enumerate(terms)}
        self.rule, self.term = (np.array([t[i] for t in terms], np.int64) for i in (0, 1))
        self.always = np.array([number[rule, term] for atom, rule, term, _, _ in rows if atom == EVERY], np.int64)
        rows = [r for r in rows if r[0] != EVERY]
        atom = {a: i for i, a in enumerate(dict.fromkeys(r[0] for r in rows))}
        self.atoms = max(len(atom), 1)
        self.found, self.by_gram = atom, {}
        for a, i in atom.items():
            if a[-GRAM - 1:-GRAM] == "~":
                self.by_gram.setdefault(a[:-GRAM - 1], {})[a[-GRAM:]] = i
        # every (term, predicate, atom), in this order, with the runs of terms and of predicates
        held = np.array(sorted({(number[rule, term], p, atom[a]) for a, rule, term, p, _ in rows}), np.int64).reshape(-1, 3)
        self.atom_of, new = held[:, 2], np.ones(len(held), bool)
        new[1:] = (np.diff(held[:, :2], axis=0) != 0).any(axis=1)
        self.begin = np.searchsorted(held[:, 0], np.arange(len(terms) + 1))
        self.opens = new
        shared = np.bincount(self.atom_of, minlength=self.atoms)
        at = np.flatnonzero(new)
        sharing = np.add.reduceat(shared[self.atom_of], at) if len(at) else NONE
        of = held[at, 0]
        best = np.lexsort((sharing, of))
        best = best[np.r_[True, np.diff(of[best]) != 0]] if len(best) else best
        chosen = np.isin(np.cumsum(new) - 1, best)
        by = np.argsort(self.atom_of[chosen], kind="stable")
        self.seed_term = held[chosen, 0][by]
        self.seed_begin = np.searchsorted(self.atom_of[chosen][by], np.arange(self.atoms + 1))

    def atoms_of(self, name: str, text: str) -> list[int]:
        """The atoms that a text of a field has."""
        value, found = self.found.get(f"{name}={text}"), self.by_gram.get(name, {})
        return [*([] if value is None else [value]), *(found[g] for g in found.keys() & set(grams(text)))]

    def candidates(self, names: list[str], texts: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        """(event, term) of the terms whose predicates are all hit, in order; an event has a list of texts for each name."""
        inner = texts.flatten()
        owner = np.repeat(np.arange(len(inner)), np.diff(inner.offsets.to_numpy()))
        values = inner.flatten().dictionary_encode()
        each, back = np.unique(owner % len(names) * max(len(values.dictionary), 1) + values.indices.to_numpy(), return_inverse=True)
        words = values.dictionary.to_pylist()
        lists = [self.atoms_of(names[k // len(words)], words[k % len(words)]) for k in each.tolist()]
        sizes, flat = np.array([len(x) for x in lists], np.int64), np.array([a for x in lists for a in x], np.int64)
        hit = flat[spread((np.cumsum(sizes) - sizes)[back], sizes[back])]
        pairs = np.unique(np.repeat(owner // len(names), sizes[back]) * self.atoms + hit)  # an atom counts once for an event
        event, hit = pairs // self.atoms, pairs % self.atoms
        n = max(len(self.rule), 1)
        low, many = self.seed_begin[hit], np.diff(self.seed_begin)[hit]
        keys = np.unique(np.repeat(event, many) * n + self.seed_term[spread(low, many)])
        keys = keys[self._all_hit(keys // n, keys % n, pairs)]
        every = (np.arange(len(texts))[:, None] * n + self.always).ravel()
        keys = np.sort(np.concatenate([keys, every]))
        return keys // n, keys % n

    def _all_hit(self, event: np.ndarray, term: np.ndarray, pairs: np.ndarray) -> np.ndarray:
        """Whether an event has an atom of each predicate of a term; pairs are events' atoms, sorted."""
        if not len(event):
            return np.zeros(0, bool)
        sizes = np.diff(self.begin)[term]
        at = spread(self.begin[term], sizes)
        want = np.repeat(event, sizes) * self.atoms + self.atom_of[at]
        met = pairs[np.minimum(np.searchsorted(pairs, want), len(pairs) - 1)] == want
        opens = np.flatnonzero(self.opens[at])
        of = np.repeat(np.arange(len(event)), sizes)[opens]
        return np.bincount(of, ~np.logical_or.reduceat(met, opens), minlength=len(event)) == 0


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions starts[i], starts[i] + 1, ... of all spans, one span after the other."""
    ends = np.cumsum(lengths)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - ends + lengths, lengths)


NONE = np.zeros(0, np.int64)


def match_indexed(events: DataFrame, rules: list[ru.Rule], carry: tuple[str, ...] = ("seq", "ts", "hostname", "username", "source_ip")) -> DataFrame:
    """C14: (carried columns, rule_ord) of every event and rule that it matches; counting rules are left out."""
    spark = events.sparkSession
    numbers = [i for i, r in enumerate(rules) if not r.counts]
    compiled = [compile_rule(rules[i]) for i in numbers]
    fields = sorted({t.field for c in compiled for s in c.selections for tests in s for t in tests})
    place = {f: i + 1 for i, f in enumerate(fields)}
    index = Index(index_rows(compiled))
    table = spark.createDataFrame(
        [(r, numbers[r], [[[(place[t.field], t.op, list(t.values), t.null) for t in tests] for tests in s] for s in c.selections], c.terms)
         for r, c in enumerate(compiled)], _RULES)
    rows = events.select(*carry, F.array(*map(texts_of, fields)).cast("array<array<string>>").alias("__texts"), F.array(*map(missing, fields)).cast("array<boolean>").alias("__gone"))
    if not fields:
        return rows.limit(0).select(*carry, F.lit(0).alias("rule_ord"))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            event, term = index.candidates(fields, b.column(len(carry)))
            rule = index.rule[term]
            new = np.flatnonzero(np.r_[True, (np.diff(event) != 0) | (np.diff(rule) != 0)]) if len(event) else NONE
            taken = pa.array(event[new])
            lists = pa.ListArray.from_arrays(pa.array(np.r_[new, len(event)], pa.int32()), pa.array(index.term[term], pa.int32()))
            yield pa.RecordBatch.from_arrays([*(c.take(taken) for c in b.columns), pa.array(rule[new], pa.int32()), lists], [*b.schema.names, "__rule", "__terms"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields), "__rule int, __terms array<int>"])
    able = rows.mapInArrow(look_up, schema).join(table, "__rule")  # a row a rule; Spark broadcasts it while it is small
    texts, gone = F.col("__texts"), F.col("__gone")
    holds = F.transform("selections", lambda s: F.exists(s, lambda tests: F.forall(tests, lambda t: _holds(t, texts, gone))))
    able = able.withColumn("__held", holds)

    def fires(number: Column) -> Column:
        return F.forall(F.get("terms", number), lambda n: F.element_at("__held", F.abs(n)) == (n > 0))

    return able.filter(F.exists("__terms", fires)).select(*carry, "rule_ord")
