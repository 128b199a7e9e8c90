"""Exact search: what it finds, how batches meet, and that nothing is worked out twice."""

import time
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from lexstrata.functions.text import CJK, words
from lexstrata.operators import vectors


def rows_of(spark, n, seed, missing=()):
    """Unit vectors of few directions, so that scores tie; ids of ``missing`` have none."""
    v = np.random.default_rng(seed).integers(-1, 2, (n, 3)).astype(float)
    v[(v == 0).all(axis=1)] = 1.0
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    return v, [(i, None if i in missing else v[i].tolist(), f"c{i % 3}" if i % 7 else None) for i in range(n)]


def best(q, p, k, by_collection):
    out = []
    for i, v, _ in q:
        groups = defaultdict(list)
        for j, w, c in p:
            if v is not None and w is not None:
                groups[c if by_collection else ""].append((-round(float(np.dot(v, w)), 6) + 0.0, j))
        out += [(i, j, s, n, c) for c, x in groups.items() for n, (s, j) in enumerate(sorted(x)[:k], 1)]
    return sorted((i, j, round(-s, 6) + 0.0, n, str(c)) for i, j, s, n, c in out)


def test_ties_missing_vectors_and_collections(spark):
    _, q = rows_of(spark, 23, 1, {5})
    _, p = rows_of(spark, 301, 2, {7, 300})
    queries = spark.createDataFrame(q, "query_id long, v array<double>, c string").select("query_id", "v")
    points = spark.createDataFrame(p, "vec_id long, v array<double>, label string")
    for by_collection in (False, True):
        found = vectors.exact_top_k(queries, points if by_collection else points.drop("label"), 6, "label" if by_collection else None, batch_rows=16)
        got = sorted((r["query_id"], r["vec_id"], r["score"] + 0.0, r["rank"], str(r["collection"]) if by_collection else "") for r in found.collect())
        assert got == best(q, p, 6, by_collection)


def test_rounding_decides_before_the_id(spark):
    points = spark.createDataFrame([(9, [0.50000049]), (3, [0.50000010]), (5, [0.49999951]), (1, [0.4999985])], "vec_id long, v array<double>")
    found = vectors.exact_top_k(spark.createDataFrame([(0, [1.0])], "query_id long, v array<double>"), points, 3).orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in found] == [(3, 0.5), (5, 0.5), (9, 0.5)]


def test_repeated_batches_of_queries_are_not_sent_out_by_the_driver(spark):
    _, rows = rows_of(spark, 50, 3)
    both = spark.createDataFrame(rows, "vec_id long, v array<double>, label string")
    for collection in (None, "label"):
        found = vectors.exact_top_k(both.select(F.col("vec_id").alias("query_id"), "v"), both, 3, collection)
        found.collect()
        assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_points_are_worked_out_once(spark):
    worked = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            worked.add(batch.num_rows)
            yield batch

    _, rows = rows_of(spark, 60, 4)
    points = spark.createDataFrame(rows, "vec_id long, v array<double>, label string").select("vec_id", "v").mapInArrow(counted, "vec_id long, v array<double>")
    vectors.exact_top_k(spark.createDataFrame([(0, [1.0, 0.0, 0.0])], "query_id long, v array<double>"), points, 3, n_points=60).collect()
    assert worked.value == 60


def test_hashed_vectors_of_each_row(spark):
    rows = spark.createDataFrame([(1, ["a", "b", "a"]), (2, []), (3, None), (4, ["c"])], "id long, w array<string>")
    got = {r["id"]: r["v"] for r in vectors.hashed_vectors(rows, "id", F.col("w")).collect()}
    assert set(got) == {1, 4} and sorted(x for x in got[4] if x) == [1.0]
    assert np.allclose(sorted(x for x in got[1] if x), np.sort(np.log1p([1, 2])) / np.linalg.norm(np.log1p([1, 2])))


def test_words_of_every_character_by_fast_patterns(spark):
    plain = lambda c: F.regexp_extract_all(F.lower(c), F.lit(f"[\\p{{L}}\\p{{N}}&&[^{CJK}]]+"), F.lit(0))
    pairs = lambda c: F.regexp_extract_all(F.lower(c), F.lit(f"[{CJK}]+"), F.lit(0))
    kept = lambda a: [chr(c) for c in range(a, a + 64) if not 0xD800 <= c < 0xE000]
    rows = [("".join(f"{c}b {c} a{c}Z," for c in kept(a)),) for a in range(0, 0x110000, 64)] + [(None,), ("",)]
    texts = spark.createDataFrame(rows, "text string")
    alone = F.concat(plain(F.col("text")), F.filter(pairs(F.col("text")), lambda r: F.length(r) < 3))  # no run of CJK here is longer
    assert texts.filter(~words(F.col("text")).eqNullSafe(alone)).count() == 0
    long = spark.range(8).select(F.repeat(F.lit("Ein längerer Satz of plain words, número 12. "), 20000).alias("text")).cache()
    long.count()

    def seconds(c):
        began = time.time()
        long.select(c.alias("x")).write.format("noop").mode("overwrite").save()
        return time.time() - began

    seconds(words(F.col("text"))), seconds(F.split("text", " "))
    assert min(seconds(words(F.col("text"))) for _ in range(2)) < 15 * min(seconds(F.split("text", " ")) for _ in range(2))
