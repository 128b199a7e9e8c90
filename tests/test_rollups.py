"""Merged hourly sketches against exact numbers."""

import datetime
import random

import numpy as np

from lexstrata.operators import rollups


def test_windows_of_merged_hours(spark):
    r = random.Random(9)
    start = datetime.datetime(2024, 1, 1)
    rows = [(start + datetime.timedelta(minutes=r.randrange(60 * 24 * 12)), r.choice([None, *range(4000)]), r.choice("ab"), r.choice([None, float("nan"), r.expovariate(1.0), r.gauss(50, 9)])) for _ in range(30_000)]
    events = spark.createDataFrame(rows, "ts timestamp, user_id long, kind string, value double")
    hours = rollups.hourly(events, ["kind"])
    assert hours.count() <= 12 * 24 * 2
    found = rollups.estimates(rollups.rolled(hours, ["kind"], [1, 7]), {"p50": 0.5, "p95": 0.95}).collect()
    assert len(found) == 2 * (12 + 18)
    for w in found:
        inside = [x for x in rows if x[2] == w["kind"] and w["window_end"] - datetime.timedelta(days=w["days"]) <= x[0] < w["window_end"]]
        users = len({x[1] for x in inside if x[1] is not None})
        values = np.array([x[3] for x in inside if x[3] is not None and x[3] == x[3]])
        assert w["n"] == len(inside) and abs(w["users"] - users) <= max(1, 0.025 * users)
        for q in (0.5, 0.95):
            got = w[f"p{int(q * 100)}"]
            assert (values < got).mean() - 0.03 <= q <= (values <= got).mean() + 0.03


def test_no_events(spark):
    none = spark.createDataFrame([], "ts timestamp, user_id long, kind string, value double")
    assert rollups.estimates(rollups.rolled(rollups.hourly(none, ["kind"]), ["kind"], [1]), {"p50": 0.5}).count() == 0
