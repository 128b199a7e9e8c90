"""Differences of nested JSON snapshots, without Python workers."""

import json
import random

from lexstrata.operators import audit

ROWS = "id long, b string, a string"


def test_nested_objects_and_lists(spark):
    rows = [
        (1, '{"a": {"b": [1, {"c": null}]}, "x~/y": "s"}', '{"a": {"b": [1, {"c": 2}, []]}, "x~/y": "é\\"q"}'),
        (2, "[1, 2, 3]", "[1, 3]"),
        (3, "not json", '{"k": true}'),
        (4, None, "7"),
        (5, '{"same": 1, "n": null}', '{"n": null,  "same": 1}'),
        (6, '{"o": {"p": 1}}', '{"o": 5}'),
        (7, "{}", "[]"),
    ]
    found = audit.json_changes(spark.createDataFrame(rows, ROWS), "id", "b", "a")
    assert sorted(map(tuple, found.collect()), key=str) == sorted(
        [(1, "/a/b/1/c", None, "2"), (1, "/x~0~1y", '"s"', '"é\\"q"'), (2, "/1", "2", "3"), (2, "/2", "3", None), (3, "/k", None, "true"), (4, "", None, "7"), (6, "/o", None, "5"), (6, "/o/p", "1", None)],
        key=str,
    )
    assert "Python" not in found._jdf.queryExecution().toString() and "Pandas" not in found._jdf.queryExecution().toString()
    assert audit.json_changes(spark.createDataFrame([], ROWS), "id", "b", "a").count() == 0


def test_random_trees_against_a_walk(spark):
    r = random.Random(2)

    def tree(depth):
        kind = r.random()
        if depth and kind < 0.35:
            return {r.choice("abcd"): tree(depth - 1) for _ in range(r.randint(0, 3))}
        if depth and kind < 0.6:
            return [tree(depth - 1) for _ in range(r.randint(0, 3))]
        return r.choice([None, True, False, 0, -7, "", "text", "ü"])

    def walk(x, path=""):
        if isinstance(x, dict | list):
            for k, v in x.items() if isinstance(x, dict) else enumerate(x):
                yield from walk(v, f"{path}/{k}")
        elif x is not None:
            yield path, json.dumps(x, ensure_ascii=False)

    rows = [(i, json.dumps(tree(5)), json.dumps(tree(5))) for i in range(150)]
    want = []
    for i, b, a in rows:
        x, y = dict(walk(json.loads(b))), dict(walk(json.loads(a)))
        want += [(i, p, x.get(p), y.get(p)) for p in {*x, *y} if x.get(p) != y.get(p)]
    got = audit.json_changes(spark.createDataFrame(rows, ROWS), "id", "b", "a").collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
