"""Evaluate costly expressions once per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def computed_once(df: DataFrame, keep: list[str], columns: dict[str, Column]) -> DataFrame:
    """`keep` plus new columns that later filters and joins read instead of computing them again.

    The optimizer copies an expression into every filter it pushes below a projection, including the
    null checks that it infers for joins. It does not push through a generator, so the new columns come
    out of one that yields exactly one row.
    """
    made = F.struct(*[c.alias(name) for name, c in columns.items()])
    return df.select(*keep, F.inline(F.array(made)))
