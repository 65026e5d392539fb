"""The graph of derived feeds against walks on small graphs."""

import random

from rangeloom.operators import lineage
from rangeloom.sources import versions

EDGES = "feed string, parent string, additive boolean"


def graph(spark, rows):
    return spark.createDataFrame([(a, b, k) for a, b, k in rows], EDGES)


def walked(edges: list, name: str) -> set:
    seen, todo = set(), [name]
    while todo:
        for a, b, _ in edges:
            if a == todo[0] and b not in seen:
                seen.add(b)
                todo.append(b)
        todo.pop(0)
    return seen


def test_closure_cycles_and_leaves_of_random_graphs(spark):
    rng = random.Random(4)
    for most in (12, 20):
        edges = [(f"f{a}", f"f{rng.randrange(12)}", rng.random() < 0.8) for a in [rng.randrange(12) for _ in range(most)]]
        edges += [edges[0], ("f1", None, True)]
        real, names = [e for e in edges if e[1]], [f"f{i}" for i in range(10)]
        reach = {n: walked(real, n) for n in {a for a, _, _ in real}}
        assert {tuple(r) for r in lineage.closure(graph(spark, edges)).collect()} == {(a, b) for a, s in reach.items() for b in s}
        want = {(min(y for y in reach[x] if x in reach.get(y, ())), x) for x in reach if x in reach[x]}
        assert {tuple(r) for r in lineage.cycles(graph(spark, edges)).collect()} == want
        additive = [e for e in real if e[2]]
        derived = {a for a, _, _ in additive}
        leaves = {(n, x) for n in names for x in walked(additive, n) | {n} if x not in derived and x in names}
        feeds = spark.createDataFrame([(n,) for n in [*names, names[0]]], "feed string")
        assert sorted(tuple(r) for r in lineage.leaves(feeds, graph(spark, edges)).collect()) == sorted(leaves)


def test_dates_pass_down_a_chain_and_stop_at_cycles(spark):
    shape = "feed string, source_date long, processed_date long, provenance string, frequency_mins long, status string"
    feeds = spark.createDataFrame([("root", 500, 1, "primary", 10, "ok"), ("dead", 0, 0, "primary", 5, "gone"), ("merge", 90, 2, "secondary_merge", 20, "x"), ("window", 0, 70, "secondary_retention", 30, "y"), ("alone", 0, 33, "secondary_retention", 7, "z"),
                                   ("up", 900, 1, "secondary_upstream", 1, "u"), ("ring1", 10, 1, "secondary_merge", 1, "r"), ("ring2", 20, 1, "secondary_merge", 1, "r"), ("after", 5, 1, "secondary_merge", 1, "r")], shape)
    edges = graph(spark, [("merge", "root", True), ("merge", "dead", True), ("merge", "unknown", True), ("window", "merge", True), ("alone", "dead", True), ("up", "root", True), ("ring1", "ring2", True), ("ring2", "ring1", True), ("after", "ring2", False)])
    got = {r["feed"]: r for r in lineage.effective_entries(feeds, edges).collect()}
    assert list(got) == sorted(got)
    dates = {"root": 500, "dead": 0, "merge": 500, "window": 500, "alone": 33, "up": 900, "ring1": 10, "ring2": 20, "after": 20}
    assert {n: r["source_date"] for n, r in got.items()} == dates
    assert (got["window"]["frequency_mins"], got["window"]["status"], got["window"]["processed_date"]) == (20, "x", 70)
    assert (got["alone"]["frequency_mins"], got["merge"]["frequency_mins"], got["alone"]["status"]) == (5, 20, "gone")


def test_what_may_be_passed_on(spark):
    feeds = spark.createDataFrame([("a", True), ("b", False), ("m", None), ("n", True), ("o", True)], "feed string, redistributable boolean")
    edges = graph(spark, [("m", "a", True), ("n", "m", True), ("n", "b", False), ("o", "n", True)])
    assert {tuple(r) for r in lineage.redistributable(feeds, edges).collect()} == {("a", True), ("b", False), ("m", True), ("n", False), ("o", False)}


def test_rounds_are_released(spark):
    versions.release(spark)
    reach = lineage.closure(graph(spark, [("a", "b", True), ("b", "c", True)]))
    assert reach.count() == 3 and versions.release(spark) >= 2 and versions.release(spark) == 0


def test_no_rows(spark):
    feeds, edges = spark.createDataFrame([], "feed string"), graph(spark, [])
    assert lineage.closure(edges).count() == lineage.cycles(edges).count() == lineage.leaves(feeds, edges).count() == lineage.related(lineage.leaves(feeds, edges)).count() == 0
