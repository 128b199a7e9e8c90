"""Vectors that share an id: the largest counts, whatever the order of rows."""

from lexstrata.llm.balltree import top_k_inner_product


def test_the_largest_vector_of_an_id_counts(spark):
    rows = [(1, [1.0, 0.0]), (2, [5.0, 1.0]), (2, [5.0, 9.0]), (2, [-7.0, 99.0]), (3, [2.0, 2.0]), (3, [2.0, 2.0])]
    want = [(1, 1, 2, 5), (1, 2, 3, 2), (2, 1, 3, 28), (2, 2, 1, 5), (3, 1, 2, 28), (3, 2, 1, 2)]
    for order in (rows, rows[::-1]):
        points = spark.createDataFrame(order, "vec_id long, v array<double>").repartition(3)
        found = top_k_inner_product(points, points, 5).select("query_id", "rank", "vec_id", "score").collect()
        assert sorted(map(tuple, found)) == want
