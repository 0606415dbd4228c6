"""The stored vector index against brute force."""

import math
import re

import numpy as np
import pytest

from paperlode.operators import vector_index as V
from paperlode.plans import vector_index as P
from paperlode.plans.registry import Tables
from tests.conftest import SMALL

SCHEMA = "id bigint, v array<double>"


def exact(rows, queries, k):
    def cosine(a, b):
        if a is None or b is None or len(a) != len(b) or any(x is None or not math.isfinite(x) for x in (*a, *b)):
            return None
        norm = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
        return round(sum(x * y for x, y in zip(a, b)) / norm, 6) + 0.0 if norm else None

    out = []
    for q, a in queries:
        scored = sorted((-s, i) for i, b in rows if (s := cosine(a, b)) is not None)
        out += [(q, r + 1, i, -s + 0.0) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def clustered(n, centres=9, dim=8, seed=5):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, dim))
    return [(i, [float(x) for x in middle[i % centres] + 0.15 * rng.normal(size=dim)]) for i in range(n)]


def test_all_cells_are_the_exact_ranking_and_few_have_most(spark, tmp_path):
    rows = clustered(600)
    rows += [(1000 + i, rows[0][1]) for i in range(300)]  # a third of all rows in one place
    rows += [(2000, None), (2001, [0.0] * 8), (2002, [1.0, None] + [0.0] * 6), (2003, [math.nan] * 8), (2004, [1.0]), (2005, [])]
    path = str(tmp_path / "index")
    V.write_vector_index(spark.createDataFrame(rows, SCHEMA), "id", "v", path, cells=9)
    asked = rows[1:60:3] + [(3000, None), (3001, [0.0] * 8), (3002, [1.0])]
    queries = spark.createDataFrame([(i, v) for i, v in asked], "q bigint, a array<double>")
    found = V.search_vector_index(queries, path, "q", "a", 7)
    # rows of another number of components are not in the index
    want = exact([r for r in rows if r[1] and len(r[1]) == 8], asked, 7)
    assert sorted(tuple(r)[:4] for r in found.collect()) == want

    curve = {r.probes: r.recall for r in V.recall_by_probes(queries, path, "q", "a", 7).collect()}
    assert sorted(curve) == list(range(1, 10)) and curve[9] == 1.0 and all(curve[p] <= curve[p + 1] for p in range(1, 9))
    probes = V.probes_for(queries, path, "q", "a", 7, recall=0.9)
    few = {tuple(r)[:3:2] for r in V.search_vector_index(queries, path, "q", "a", 7, probes).collect()}
    share = len(few & {(q, i) for q, _, i, _ in want}) / len(want)
    assert share >= 0.9 and share == pytest.approx(curve[probes]) and probes < 9


def test_added_rows_are_found(spark, tmp_path):
    rows = clustered(200)
    path = str(tmp_path / "index")
    V.write_vector_index(spark.createDataFrame(rows[:150], SCHEMA), "id", "v", path)
    V.add_to_vector_index(spark.createDataFrame(rows[150:], SCHEMA), path)
    queries = spark.createDataFrame(rows[140:160], "q bigint, a array<double>")
    found = V.search_vector_index(queries, path, "q", "a", 3)
    assert sorted(tuple(r)[:4] for r in found.collect()) == exact(rows, rows[140:160], 3)


def test_only_probed_cells_are_read(spark, tmp_path):
    rows = clustered(300)
    path = str(tmp_path / "index")
    V.write_vector_index(spark.createDataFrame(rows, SCHEMA), "id", "v", path, cells=9)
    one = spark.createDataFrame(rows[:1], "q bigint, a array<double>")
    plan = V.search_vector_index(one, path, "q", "a", 3, probes=1)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^]]*cell#", plan)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [0.0, 0.0])]])
def test_an_index_of_nothing(spark, tmp_path, rows):
    path = str(tmp_path / "index")
    V.write_vector_index(spark.createDataFrame(rows, SCHEMA), "id", "v", path)
    queries = spark.createDataFrame([(1, [1.0, 2.0])], "q bigint, a array<double>")
    assert V.search_vector_index(queries, path, "q", "a").collect() == []
    assert V.probes_for(queries, path, "q", "a") == 1


def test_recall_over_the_table(spark):
    t = Tables(spark, SMALL)
    want = {(r.query_id, r.vec_id) for r in P.vector_index_all_cells(t).collect()}
    found = {(r.query_id, r.vec_id) for r in P.vector_index_probed(t).collect()}
    assert len(want & found) / len(want) >= 0.9
