"""Joins that stay correct and balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperlode.functions.times import epoch_micros
from paperlode.operators.ordered import asof_join


def left_join_many(one: DataFrame, many: DataFrame, one_key: str, many_key: str) -> DataFrame:
    """LEFT JOIN where the right side may hold a huge group for one key."""
    return left_join_chain(one, [(many, one_key, many_key)])


def left_join_chain(one: DataFrame, steps: Sequence[tuple[DataFrame, str, str]]) -> DataFrame:
    """LEFT JOINs of `one` with (table, key so far, key of the table) in turn, where tables may have hot keys.

    The adaptive planner cannot cut the right side of an outer join. The same rows come from branches, one per
    step: inner joins, which it can cut on either side, up to a step, and there the rows whose key is absent,
    which compares distinct keys only. Every branch reads a table once, so reads grow with the number of
    steps and do not double at each.
    """
    joined, branches = one, []
    for table, key, table_key in steps:
        keys = table.select(F.col(table_key).alias("__key")).distinct()
        branches.append(joined.join(keys, F.col(key) == F.col("__key"), "left_anti"))
        joined = joined.join(table, joined[key] == table[table_key])
    for branch in branches:
        joined = joined.unionByName(branch, allowMissingColumns=True)
    return joined


def not_listed(value: Column, listed: Column) -> Column:
    """SQL's `value NOT IN (...)` over an array. A null in the array makes the test null, never true."""
    return ~F.array_contains(listed, value)


def missing_references(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """(missing_key, n_rows): keys that rows of `child` point to and `parent` lacks; null keys point nowhere."""
    used = child.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("missing_key")).agg(F.count("*").alias("n_rows"))
    return used.join(parent.select(F.col(parent_key).alias("missing_key")), "missing_key", "left_anti")


def suffix_join(uris: DataFrame, uri: str, names: DataFrame, name: str) -> DataFrame:
    """LEFT JOIN on "uri ends with name" as an equi-join.

    Names have few distinct lengths. Each distinct URI offers its ending at each of those lengths, and the
    endings join by equality; what matched goes back to the rows by one left join, whose left side the
    adaptive planner can cut if one URI has very many rows. The lengths are collected: at most one number per
    length of a name.
    """
    lengths = [r[0] for r in names.select(F.length(name).alias("n")).where("n > 0").distinct().collect()]
    if not lengths:
        return uris.join(names.where(F.lit(False)), F.lit(False), "left")
    offered = F.array(*[F.when(F.length(uri) >= n, F.right(F.col(uri), F.lit(n))) for n in sorted(lengths)])
    endings = uris.select(uri).distinct().select(
        F.col(uri).alias("__uri"), F.explode(F.array_compact(offered)).alias("__ending")
    )
    matched = endings.join(names, F.col("__ending") == F.col(name)).drop("__ending")
    return uris.join(matched, F.col(uri) == F.col("__uri"), "left").drop("__uri")


def correlated(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    ts: str,
    amount: str,
    left_id: str,
    right_id: str,
    within_s: int,
    tolerance: float,
) -> DataFrame:
    """(left id, n_matches, nearest): right rows of the same party whose amount is within `tolerance` and whose time
    is at most `within_s` seconds away, and of these the nearest in time (the smallest id among equals).

    Time and amount are cut into cells as wide as their limits, and a left row looks into the cells around its own. So
    rows meet by equality, and only rows close in both are compared, also if one party has a third of them. Left
    rows without a match are kept with 0; a missing key, time or amount matches nothing. A limit of 0 asks for equality.
    """
    if within_s < 0 or not tolerance >= 0:
        raise ValueError("limits must not be negative")
    at = epoch_micros(F.col(ts))
    width = within_s * 1_000_000
    # cells of some width, also where the limit has none
    t_cell, a_cell = max(width, 1), tolerance or 1.0

    def placed(df: DataFrame, row_id: str, name: str) -> DataFrame:
        return df.select(
            *keys, F.col(row_id).alias(name), at.alias(f"{name}_at"), F.col(amount).cast("double").alias(f"{name}_amount")
        )

    around = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    mine = (
        placed(left, left_id, "l")
        .withColumn("t", F.explode(F.transform(around, lambda i: F.floor(F.col("l_at") / t_cell) + i)))
        .withColumn("a", F.explode(F.transform(around, lambda i: F.floor(F.col("l_amount") / a_cell) + i)))
    )
    other = placed(right, right_id, "r")
    other = other.withColumn("t", F.floor(F.col("r_at") / t_cell)).withColumn("a", F.floor(F.col("r_amount") / a_cell))
    apart = F.abs(F.col("l_at") - F.col("r_at"))
    near = mine.join(other, [*keys, "t", "a"]).where(
        (apart <= width) & (F.abs(F.col("l_amount") - F.col("r_amount")) <= tolerance)
    )
    found = near.groupBy("l").agg(F.count("*").alias("n"), F.min(F.struct(apart.alias("apart"), "r")).alias("best"))
    return left.select(F.col(left_id)).join(found, F.col(left_id) == F.col("l"), "left").select(
        left_id, F.coalesce("n", F.lit(0)).alias("n_matches"), F.col("best.r").alias("nearest")
    )


def latest_within(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    ts: str,
    right_id: str,
    within_s: int,
    prefix: str = "matched_",
    splits: Sequence[float] | None = None,
) -> DataFrame:
    """Each left row with the latest right row of its key at most `within_s` seconds earlier, if any.

    Adds `<prefix>id` and `<prefix>delta_us`. One ordered pass links the rows, so no pairs are formed.
    """
    at: Column = epoch_micros(F.col(ts))
    found = asof_join(
        left,
        right,
        keys,
        at,
        at,
        F.struct(F.col(right_id).alias("id"), at.alias("at")),
        "__m",
        tie=F.col(right_id),
        splits=splits,
    )
    delta = at - F.col("__m.at")
    near = delta <= within_s * 1_000_000
    return (
        found.withColumn(f"{prefix}id", F.when(near, F.col("__m.id")))
        .withColumn(f"{prefix}delta_us", F.when(near, delta))
        .drop("__m")
    )
