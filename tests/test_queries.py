"""Every registered query against its SQL, over whole tables at the smallest scale."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from paperlode.plans import QUERIES
from tests.conftest import SMALL


def normal(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(value):
        return repr(float(f"{value:.9g}")) if isinstance(value, float) else str(value)

    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SMALL)
    mine = normal([tuple(r) for r in df.collect()], df.columns)
    if QUERIES[name].sql is None:
        return
    result = duck.execute(QUERIES[name].sql)
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert mine == normal(result.fetchall(), columns)


def test_driver_contract(spark):
    assert set(oracle_sql()) <= set(queries())
    found = entry(spark)
    assert found.columns == ["doc_id", "source", "fused", "lexical_rank", "dense_rank"]
    assert found.count() == 20
