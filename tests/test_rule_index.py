"""The rule index finds what evaluating every rule finds."""

import random
import tracemalloc

import pyarrow as pa
import pytest

from nightwarden.operators import rule_index as ri
from nightwarden.operators import rules as ru

from . import helpers as h


def rule(n, detection):
    return ru.parse_rule({"title": f"r{n}", "id": f"r{n}", "detection": {"condition": "s"} | detection}, f"r{n}")


def random_rules(seed, n):
    rng = random.Random(seed)
    words = ["failed", "root", "passwd", "cmd", "a", "\\Temp\\", "ssh", "Admin"]

    def test():
        return rng.choice([
            {"username": rng.choice(["bob", "ann", None, ["bob", None]])}, {"EventID": rng.choice([4625, [4624, 4688], "x"])},
            {"CommandLine|contains": rng.choice([rng.choice(words), rng.sample(words, 2)])}, {"CommandLine|contains|all": rng.sample(words, 2)},
            {"message|startswith": rng.choice(words)}, {"message|endswith": rng.sample(words, 2)}, {"message|re": rng.choice(["^f.*d", "ro+t$"])},
            {"tags": rng.choice(["sudo", ["su", "ssh_failed"]])}, {"tags|contains": "ssh"}, {"TaskName|contains": "Temp"}, {"nothing": "x"},
            {"raw|contains": "temp"}, ["failed", "root"], [{"username": "bob"}, "ssh"]])

    def selection():
        a, b = test(), test()
        return a if isinstance(a, list) or isinstance(b, list) else a | b

    conditions = ["a", "a and b", "a or b", "a and not b", "not a", "not (a and b) and c", "1 of them", "all of them", "a and (b or not c)", "a or b and c", "not (a or not b)"]
    return [rule(i, {"a": selection(), "b": selection(), "c": selection(), "condition": rng.choice(conditions)}) for i in range(n)]


def event_rows(seed, n):
    rng = random.Random(seed)
    texts = ["failed root", "ssh Failed", "passwd for ROOT", "a", "", None, "cmd /c \\TEMP\\a", "fed", "rooot"]
    return [{"username": rng.choice(["bob", "Ann", None]), "event_id": rng.choice([4625, 4624, 4688, None]), "command_line": rng.choice(texts),
             "message": rng.choice(texts), "tags": rng.choice([[], ["sudo"], ["su", "ssh_failed"], ["SSH_x"]]),
             "raw": rng.choice([{}, {"TaskName": "\\Temp\\x"}, {"line": "Failed for bob"}]), "at": i} for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_indexed_matches_equal_all_evaluations(spark, seed):
    rules, ev = random_rules(seed, 60), h.events(spark, event_rows(seed, 120))
    rules.insert(3, rule("count", {"s": {"username": "bob"}, "condition": "s | count() > 3"}))
    got = h.rows(ri.match_indexed(h.spread(ev, 5), rules), "seq", "rule_ord")
    plain = [r if not r.counts else rule("none", {"s": {"nothing": "x"}}) for r in rules]
    want = h.rows(ru.match_rules(ev, plain), "seq", "rule_ord")
    assert [(r, rules[r].selections, rules[r].condition) for r in sorted({r for _, r in set(got) ^ set(want)})] == []
    assert got == want and len(want) > 500


def test_terms_of_conditions():
    body = {"a": {"x": 1}, "b": {"x": 2}, "c": {"x": 3}}
    for condition, want in (("a and not (b or c)", [[-3, -2, 1]]), ("not (a and b)", [[-1], [-2]]), ("a and not a", []), ("1 of them", [[1], [2], [3]])):
        assert ri.terms_of(rule(1, body | {"condition": condition})) == want


def test_predicates_are_looked_up_by_value_and_rarest_trigram():
    rules = [rule(i, {"s": {"CommandLine|contains": f"common{i:02d}", "username": f"u{i}"}}) for i in range(20)]
    rows = ri.index_rows([ri.compile_rule(r) for r in rules])
    assert len(rows) == 40 and all(wanted == 2 for *_, wanted in rows)
    grams = [a for a, *_ in rows if "~" in a]
    assert "commandline~com" not in grams and len(set(grams)) > 5
    assert ri.index_rows([ri.compile_rule(rule(1, {"s": {"message|re": "x"}}))]) == [("*", 0, 0, 0, 1)]


def test_the_plan_scans_once_and_does_not_grow(spark, tmp_path):
    h.events(spark, event_rows(1, 50)).write.parquet(f"{tmp_path}/e")
    ev = spark.read.parquet(f"{tmp_path}/e")
    plans = []
    for n in (10, 400):
        rules = [rule(i, {"s": {"username": f"u{i}", "message|contains": f"text{i}"}}) for i in range(n)]
        plans.append(ri.match_indexed(ev, rules)._jdf.queryExecution().executedPlan().toString())
    assert all(p.count("FileScan parquet") == 1 for p in plans) and len(plans[1]) < 1.2 * len(plans[0])


def test_no_rules_and_no_events(spark):
    ev = h.events(spark, event_rows(1, 5))
    assert ri.match_indexed(ev, []).count() == 0
    assert ri.match_indexed(ev.limit(0), random_rules(1, 5)).count() == 0


def test_a_predicate_of_many_rules_costs_an_event_nothing():
    """2,000 rules share a status and differ in the user; what an event is looked up by is its user."""
    rules = [rule(i, {"s": {"status": "failure", "user": f"u{i}", "message|contains": ["failed", "wrong"]}}) for i in range(2_000)]
    index = ri.Index(ri.index_rows([ri.compile_rule(r) for r in rules]))
    events = [[["failure"], [f"u{i}"], ["it failed"] if i % 2 else ["fine"]] for i in range(2_000)]
    tracemalloc.start()
    event, term = index.candidates(["status", "user", "message"], pa.array(events, pa.list_(pa.list_(pa.string()))))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert event.tolist() == term.tolist() == list(range(1, 2_000, 2))
    assert peak < 8 << 20
