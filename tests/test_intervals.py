"""Interval joins against a loop."""

import random

import pytest

from lexstrata.operators import intervals


def slow(points, spans):
    inside = lambda at, s, e: (s is None or s <= at) and (e is None or at <= e)
    return sorted(((k, at, p, name) for k, at, p in points if None not in (k, at) for j, s, e, name in spans if j == k and inside(at, s, e)), key=repr)


@pytest.mark.parametrize("hot_rows", [5, 5000])
def test_joins_against_a_loop(spark, hot_rows):
    """Short, long, open, inverted and repeated spans, hot positions, negative and very large numbers, nulls."""
    draw = random.Random(hot_rows)
    points = [(draw.choice([1, 1, 1, 2, 3, None]), draw.choice([draw.randint(-50, 300), 7, 7, None, 1 << 40]), i) for i in range(400)]
    spans = []
    for i in range(60):
        s = draw.randint(-80, 300)
        spans.append((draw.choice([1, 2, 4, None]), draw.choice([s, s, None]), draw.choice([s, s + draw.randint(-3, 20), s + 200, None, 1 << 41]), f"s{i}"))
    spans.append(spans[0])
    a = spark.createDataFrame(points, "k long, at long, p int")
    b = spark.createDataFrame(spans, "k long, s long, e long, name string")
    got = intervals.spans_of_points(a, b, ["k"], "at", "s", "e", hot_rows=hot_rows).select("k", "at", "p", "name").collect()
    assert sorted(map(tuple, got), key=repr) == slow(points, spans)


def test_empty_sides_and_clashing_names(spark):
    a = spark.createDataFrame([], "k long, at long")
    b = spark.createDataFrame([(1, 2, 3)], "k long, s long, e long")
    c = spark.createDataFrame([(1, 2)], "k long, at long")
    assert intervals.spans_of_points(a, b, ["k"], "at", "s", "e").count() == 0
    assert intervals.spans_of_points(c, b.limit(0), ["k"], "at", "s", "e").count() == 0
    assert intervals.spans_of_points(c, b, ["k"], "at", "s", "e").collect() == [(1, 2, 2, 3)]
    with pytest.raises(ValueError, match="at"):
        intervals.spans_of_points(c, b.withColumnRenamed("s", "at"), ["k"], "at", "at", "e")


def test_united_runs(spark):
    rows = [(1, 0, 3), (1, 4, 5), (1, 2, 9), (1, 11, 12), (1, 30, 20), (1, None, 4), (2, 1, 1), (2, 1, 1), (2, 3, 4)]
    got = intervals.united(spark.createDataFrame(rows, "k long, s long, e long"), ["k"], "s", "e").collect()
    assert sorted(map(tuple, got)) == [(1, 0, 9), (1, 11, 12), (2, 1, 1), (2, 3, 4)]


def test_long_spans_are_not_unrolled(spark):
    """A span over 2^40 positions is at most two rows of the join."""
    spans = spark.createDataFrame([(1, 5, 1 << 40, "x")], "k long, s long, e long, name string")
    points = spark.createDataFrame([(1, 4), (1, 5), (1, (1 << 40) + 1), (1, 1 << 39)], "k long, at long")
    assert sorted(r["at"] for r in intervals.spans_of_points(points, spans, ["k"], "at", "s", "e").collect()) == [5, 1 << 39]
