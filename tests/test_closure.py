"""Chains and trees of any depth, cycles, missing parents, empty tables; ambiguity behind a common prefix."""

import random

from lexstrata.operators import closure, scope


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_a_chain_of_ten_thousand(spark):
    n = 10_000
    order = list(range(n))
    random.Random(1).shuffle(order)
    links = spark.createDataFrame([(order[i], order[i + 1] if i + 1 < n else None) for i in range(n)], "id long, nxt long").repartition(4)
    assert rows(closure.chain_ends(links, "id", "nxt")) == sorted((order[i], order[-1], n - 1 - i, False) for i in range(n))


def test_cycles_and_missing_ends(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 1), (5, 99), (6, 5), (7, None), (8, 8)], "id long, nxt long")
    got = {r["id"]: (r["end"], r["steps"], r["cyclic"]) for r in closure.chain_ends(links, "id", "nxt").collect()}
    assert all(got[i] == (None, None, True) for i in (1, 2, 3, 4, 8))
    assert got[5] == (99, 1, False) and got[6] == (99, 2, False) and got[7] == (7, 0, False)
    assert closure.chain_ends(links.filter("id > 100"), "id", "nxt").count() == 0


def test_paths_of_a_deep_forest(spark):
    deep = [(f"a{i}", f"a{i - 1}" if i else None, f"n{i}") for i in range(300)]
    nodes = [*deep, ("b", None, "b"), ("c", "b", "c"), ("x", "y", "x"), ("y", "x", "y"), ("z", "x", "z"), ("lost", "nobody", "l")]
    found = {r["id"]: r for r in scope.tree_paths(spark.createDataFrame(nodes, "id string, parent string, name string")).collect()}
    assert set(found) == {x[0] for x in deep} | {"b", "c"}
    assert all(found[f"a{i}"]["path"] == [f"n{k}" for k in range(i + 1)] and found[f"a{i}"]["depth"] == i for i in range(300))
    assert found["a299"]["leaf"] and found["c"]["leaf"] and not found["b"]["leaf"]


def test_closure_below_deep_nodes(spark):
    nodes = [(f"a{i}", f"a{i - 1}" if i else None, "n", i != 30) for i in range(40)]
    got = scope.closure_offenders(spark.createDataFrame(nodes, "id string, parent string, name string, enabled boolean"), spark.createDataFrame([("a20",), ("a35",)], "id string"))
    want = {"a20": sorted(f"a{i}" for i in range(21, 40) if i not in (30, 35)), "a35": ["a36", "a37", "a38", "a39"]}
    assert {r["target"]: r["offenders"] for r in got.collect()} == want


def test_names_behind_the_common_prefix_count_if_the_question_has_them(spark):
    nodes = [("r", None, "Root"), ("a", "r", "Site A"), ("b", "r", "Site B"), ("p", "a", "Crane Work"), ("q", "b", "crane  work"), ("s", "p", "Rules"), ("t", "q", "Checks"), ("u", "q", " rules")]
    paths = scope.tree_paths(spark.createDataFrame(nodes, "id string, parent string, name string"))
    ranked = spark.createDataFrame([(q, i, s) for q in (1, 2, 3) for i, s in (("s", 0.9), ("t", 0.8), ("u", 0.7))], "query_id long, id string, score double")
    asked = spark.createDataFrame([(1, "What about CRANE work?"), (2, "And Root?"), (3, None)], "query_id long, question string")
    got = {}
    for r in scope.ambiguous(ranked, paths, questions=asked).orderBy("query_id", "option").collect():
        got.setdefault(r["query_id"], []).append(r["id"])
    assert got == {1: ["s", "t", "u"], 2: ["s", "u"], 3: ["s", "u"]}
    assert [r["id"] for r in scope.ambiguous(ranked, paths).filter("query_id = 1").orderBy("option").collect()] == ["s", "u"]
