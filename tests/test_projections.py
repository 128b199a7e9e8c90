"""Search by projection tables: recall against all pairs, on clustered and on the given vectors; hot buckets; small inputs."""

import os

import numpy as np
import pytest

from lexstrata.operators import projections, vectors
from lexstrata.plans.base import Tables
from lexstrata.plans.retrieval_plans import asked, unit

FOLDER = "/root/testdata/sf0.01"


def frame(spark, v, name):
    v = v / np.linalg.norm(v, axis=1, keepdims=True)
    return spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], f"{name} long, v array<double>")


def recall(found, exact):
    want = {(r["query_id"], r["vec_id"]) for r in exact.collect()}
    return len({(r["query_id"], r["vec_id"]) for r in found.collect()} & want) / len(want)


def test_clustered_vectors(spark):
    r = np.random.default_rng(3)
    centres = r.standard_normal((150, 32))
    points = frame(spark, centres[np.arange(6000) % 150] + 0.35 * r.standard_normal((6000, 32)), "vec_id")
    queries = frame(spark, centres[r.integers(0, 150, 120)] + 0.35 * r.standard_normal((120, 32)), "query_id")
    model = projections.fit(points, 10)
    assert model.scored < 0.1
    found = projections.projected_top_k(queries, points, 10, model=model)
    assert recall(found, vectors.exact_top_k(queries, points, 10)) >= 0.9


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the given tables are not here")
def test_the_given_vectors(spark):
    t = Tables(spark, FOLDER)
    points = unit(t).select("vec_id", "v")
    assert recall(projections.projected_top_k(asked(t), points, 10), vectors.exact_top_k(asked(t), points, 10)) >= 0.9


def test_hot_buckets_in_pieces_are_exact_inside(spark, monkeypatch):
    """One bucket that holds all rows equals the search over all pairs, however it is cut."""
    monkeypatch.setattr(projections, "PIECE", 7)
    r = np.random.default_rng(4)
    points, queries = frame(spark, np.repeat(r.standard_normal((12, 8)), 5, axis=0), "vec_id"), frame(spark, r.standard_normal((20, 8)), "query_id")
    one = projections.Projections(np.zeros((1, 0, 8)), 1, 1.0, 1.0)
    rows = lambda d: sorted(map(tuple, d.select("query_id", "vec_id", "score", "rank").collect()))
    assert rows(projections.projected_top_k(queries, points, 6, model=one)) == rows(vectors.exact_top_k(queries, points, 6))


def test_few_points(spark):
    none = spark.createDataFrame([], "vec_id long, v array<double>")
    queries = frame(spark, np.eye(3), "query_id")
    assert projections.projected_top_k(queries, none, 5).count() == 0
    assert projections.projected_top_k(queries, frame(spark, np.eye(3)[:1], "vec_id"), 5).count() == 3
