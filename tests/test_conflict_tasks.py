"""Tasks of the join under the conflict query."""

import math
import re
from collections import defaultdict

from pyspark.sql import functions as F

from paperlode.operators import blocks as B
from paperlode.plans import QUERIES
from tests.conftest import SMALL


def test_tasks_of_the_conflict_join_follow_the_rows(spark, monkeypatch):
    monkeypatch.setattr(B, "TASK_ROWS", 500)
    n = spark.read.parquet(f"{SMALL}/lineitem.parquet").count()
    query = QUERIES["supplier_conflicts"](spark, SMALL)
    used = set(re.findall(r"RepartitionByExpression \[[^]]*\], (\d+)", query._jdf.queryExecution().toString()))
    assert used == {str(math.ceil(n / 500))}
    lines = spark.read.parquet(f"{SMALL}/lineitem.parquet").join(spark.read.parquet(f"{SMALL}/orders.parquet"), F.col("l_orderkey") == F.col("o_orderkey"))
    stated, sources = defaultdict(set), defaultdict(set)
    for r in lines.select("o_custkey", "l_orderkey", "l_suppkey").collect():
        stated[r.o_custkey, r.l_suppkey].add(r.l_orderkey)
        sources[r.o_custkey].add(r.l_orderkey)
    values = defaultdict(list)
    for (c, _), s in stated.items():
        values[c].append(len(s))
    want = {(c, len(s), len(values[c])) for c, s in sources.items() if max(values[c]) < len(s)}
    assert {tuple(r) for r in query.collect()} == want
