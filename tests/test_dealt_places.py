"""Many places in one cube."""

import math
import random
from collections import Counter

from pyspark.sql import functions as F

from paperlode.operators import nearby as N


def test_places_in_one_cube_are_dealt_to_many_tasks(rows, monkeypatch):
    monkeypatch.setattr(N, "SIDE", 8)
    rng = random.Random(5)
    spots = [(50 + rng.gauss(0, 0.002), 8 + rng.gauss(0, 0.002)) for _ in range(150)] + [(50.0, 8.0)] * 20
    left = rows([(i % 60, *p) for i, p in enumerate(spots[:70])], "l bigint, lat double, lng double").coalesce(1)
    right = rows([(i, *p) for i, p in enumerate(spots[70:])], "r bigint, lat double, lng double").coalesce(1)
    found = N.within_distance(left, right, "l", "r", ("lat", "lng"), ("lat", "lng"), 300).select("*", F.spark_partition_id().alias("task")).collect()

    def far(p, q):
        (a, b), (c, d) = (map(math.radians, x) for x in (p, q))
        h = math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2
        return 2 * 6371008.8 * math.asin(math.sqrt(min(1, h)))

    want = Counter((i % 60, j) for i, p in enumerate(spots[:70]) for j, q in enumerate(spots[70:]) if far(p, q) <= 300)
    assert Counter((r.l, r.r) for r in found) == want
    assert len({r.task for r in found}) > 1
