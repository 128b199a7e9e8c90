import os

import pytest

from lexstrata.plans.base import Tables
from lexstrata.plans.retrieval_plans import asked, unit
from lexstrata.operators import vectors

FOLDER = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the given tables are not here")
def test_cells_find_most_of_the_exact_neighbours(spark):
    t = Tables(spark, FOLDER)
    points = unit(t).select("vec_id", "v")
    exact = {(r["query_id"], r["vec_id"]) for r in vectors.exact_top_k(asked(t), points, 10).collect()}
    found = {(r["query_id"], r["vec_id"]) for r in vectors.cell_top_k(asked(t), points, 10).collect()}
    assert len(found & exact) >= 0.9 * len(exact)
