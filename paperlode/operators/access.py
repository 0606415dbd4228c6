"""Row visibility: permissive policies joined by OR, as in SQL row security."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class Policy:
    """One permissive policy: a predicate, keys that must be in a lookup, keys that must not be."""

    predicate: Column
    requires: DataFrame | None = None
    forbids: DataFrame | None = None
    key: str = field(default="")


def visible_rows(df: DataFrame, policies: list[Policy]) -> DataFrame:
    """Rows that at least one policy admits. Without policies nothing is visible.

    Lookups become one flag per key, so the OR of several EXISTS tests costs one left join per lookup.
    """
    admitted = F.lit(False)
    out = df
    for i, policy in enumerate(policies):
        test = policy.predicate
        for kind, lookup in (("in", policy.requires), ("out", policy.forbids)):
            if lookup is None:
                continue
            flag = f"__{kind}{i}"
            keys = lookup.select(policy.key).where(F.col(policy.key).isNotNull()).distinct()
            out = out.join(keys.withColumn(flag, F.lit(True)), policy.key, "left")
            test = test & (F.col(flag).isNotNull() if kind == "in" else F.col(flag).isNull())
        admitted = admitted | F.coalesce(test, F.lit(False))
    return out.where(admitted).select(*df.columns)


def has_grant(grants: Column, needed: str) -> Column:
    return F.array_contains(grants, needed)
