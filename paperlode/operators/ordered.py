"""Row order at scale: numbering, previous row, carry-forward and as-of matching.

A plain window over one key puts all rows of that key into one task, and a window without a
key puts the whole table there. Here rows are first cut into blocks of about equal row count
along the order column (quantiles, so a hot key is cut too). A window then runs inside
(key, block), and one summary row per (key, block) carries state from block to block.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from paperlode.session import shuffle_width

BLOCK = "__block"
#: Numbers that a block leaves for the blocks inside of one position.
WITHIN = 1 << 20


class Splits(list):
    """Cut points of a leading position, and for positions that many rows share, cut points of what orders these."""

    def __init__(self, cuts: Sequence[float], inner: dict[float, list[float]] | None = None) -> None:
        super().__init__(cuts)
        self.inner = inner or {}


def order_splits(
    df: DataFrame, position: Column, n_blocks: int | None = None, then: Column | None = None
) -> Splits:
    """Cut points that divide the rows into `n_blocks` of about equal count.

    This runs a job that reads only the order columns. What returns to the driver is one
    number per block. The cut points become literals, so a recomputed task sees the same blocks. A position
    that holds more rows than a block is cut again by `then`, the number that orders its rows.
    """
    n_blocks = n_blocks or shuffle_width(df.sparkSession)
    columns = [position.cast("double").alias("p")] + ([] if then is None else [then.cast("double").alias("q")])
    values = df.select(*columns).where("p IS NOT NULL")
    shares = [i / n_blocks for i in range(1, n_blocks)]
    found = values.approxQuantile("p", shares, 1.0 / (2 * n_blocks)) if shares else []
    cuts, inner = set(found), {}
    # quantiles that coincide show a position of more rows than a block should have
    hot = {v: found.count(v) + 1 for v in cuts if found.count(v) > 1}
    if then is not None and hot:
        every = [i / n_blocks for i in range(1, n_blocks)]
        shared = values.where(F.col("p").isin(list(hot))).groupBy("p")
        for row in shared.agg(F.percentile_approx("q", every, 100 * n_blocks).alias("q")).collect():
            inner[row.p] = sorted(set(row.q or []))
            cuts |= {row.p, math.nextafter(row.p, math.inf)}
    # Without rows any cut point will do; there must be one.
    return Splits([float("-inf"), *sorted(cuts or {0.0}), float("inf")], inner)


def with_block(
    df: DataFrame, position: Column, splits: Sequence[float], then: Column | None = None, unplaced: Column | None = None
) -> DataFrame:
    """Add the number of the block that each row's position falls into (binary search, in the JVM).

    Rows without a position come first, as nulls do in an ascending order, and share a block unless `unplaced`
    (a number from 0) deals them out. Inside a position with cut points of its own the block goes by `then`.
    """
    at, inside = "__position", F.lit(0)
    if then is not None:
        for value, cuts in getattr(splits, "inner", {}).items():
            listed = F.array(*[F.lit(c) for c in cuts])
            below = F.size(F.filter(listed, lambda c: c <= then.cast("double")))
            inside = F.when(F.col(at) == value, F.coalesce(below, F.lit(0))).otherwise(inside)
    located = Bucketizer(splits=list(splits), inputCol=at, outputCol=BLOCK, handleInvalid="keep")
    none = F.lit(-1) if unplaced is None else -1 - unplaced
    number = F.coalesce(F.col(BLOCK).cast("bigint") * WITHIN + inside, none.cast("bigint"))
    placed = located.transform(df.withColumn(at, position.cast("double")))
    return placed.withColumn(BLOCK, number).drop(at)


def dense_positions(df: DataFrame, order: str, output: str, splits: Sequence[float] | None = None) -> DataFrame:
    """Number all rows 0,1,2... in the order of a unique numeric column, without one global sort task."""
    blocked = with_block(df, F.col(order), splits or order_splits(df, F.col(order)))
    # At most one row per block reaches the window without a key.
    offsets = blocked.groupBy(BLOCK).count().select(
        F.col(BLOCK),
        F.coalesce(
            F.sum("count").over(W.orderBy(BLOCK).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)
        ).alias("__offset"),
    )
    inside = F.row_number().over(W.partitionBy(BLOCK).orderBy(order)) - 1
    # The offsets hold one row per block, hence no more than the number of cut points.
    return (
        blocked.withColumn("__inside", inside)
        .join(F.broadcast(offsets), BLOCK)
        .withColumn(output, (F.col("__inside") + F.col("__offset")).cast("bigint"))
        .drop(BLOCK, "__inside", "__offset")
    )


def carry_forward(
    df: DataFrame,
    keys: Sequence[str],
    position: Column,
    order: Sequence[Column],
    value: Column,
    output: str,
    include_current: bool = True,
    splits: Sequence[float] | None = None,
    then: Column | None = None,
    unplaced: Column | None = None,
) -> DataFrame:
    """Last non-null `value` at or before each row (strictly before if not `include_current`).

    `position` is a number that leads the order; `order` is the full sort key in a block, and `then` a number that
    orders rows of one position as `order` does, so that a position with very many rows can be cut. Callers that
    know the cut points of the same data pass `splits` and save the job that finds them.
    """
    splits = splits or order_splits(df, position, then=then)
    blocked = with_block(df.withColumn("__v", value), position, splits, then, unplaced)
    # One row per key and block; partial aggregation shrinks it before the shuffle. A single order column
    # keeps the buffer flat, which lets Spark hash instead of sort.
    key = order[0] if len(order) == 1 else F.struct(*_ascending(order))
    has_value = F.col("__v").isNotNull()
    latest = F.max_by("__v", F.when(has_value, key))
    # max_by passes over rows whose key is null; among those any one is the last.
    unplaced = F.max_by("__v", F.when(has_value, F.lit(1)))
    tails = blocked.groupBy(*keys, BLOCK).agg(F.coalesce(latest, unplaced).alias("__tail"))
    # A key has at most one such row per block, so this window never holds more than the number of blocks.
    across = W.partitionBy(*keys).orderBy(BLOCK).rowsBetween(W.unboundedPreceding, -1)
    heads = tails.select(
        *keys, BLOCK, F.last("__tail", ignorenulls=True).over(across).alias("__v"), F.lit(0).alias("__real")
    ).where("__v IS NOT NULL")
    # What a block inherits goes into it as a row ahead of its own rows: the rows are shuffled once, and no
    # join has to find them again.
    stream = blocked.withColumn("__real", F.lit(1)).unionByName(heads, allowMissingColumns=True)
    inside = (
        W.partitionBy(*keys, BLOCK)
        .orderBy("__real", *order)
        .rowsBetween(W.unboundedPreceding, 0 if include_current else -1)
    )
    filled = stream.withColumn(output, F.last("__v", ignorenulls=True).over(inside))
    return filled.where("__real = 1").select(*df.columns, output)


def previous_row(
    df: DataFrame,
    keys: Sequence[str],
    position: Column,
    order: Sequence[Column],
    columns: Sequence[str],
    output: str,
    splits: Sequence[float] | None = None,
) -> DataFrame:
    """Struct of `columns` from the row just before, per key (or over the whole table without keys)."""
    return carry_forward(
        df, keys, position, order, F.struct(*columns), output, include_current=False, splits=splits
    )


def asof_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_at: Column,
    right_at: Column,
    right_value: Column,
    output: str,
    tie: Column | None = None,
    splits: Sequence[float] | None = None,
) -> DataFrame:
    """For each left row the struct `right_value` of the latest right row with `right_at <= left_at`.

    A null key or time matches nothing, as in an SQL join; such a left row is kept with a null.

    Both sides are merged into one ordered stream, so each row is shuffled once and no pairs
    are formed. Among right rows at one instant the one with the largest `tie` wins. Left rows of one instant are
    dealt by a hash and rows without a time by another, so neither share a task.
    """
    names = left.columns
    from_left = left.select(
        *[F.col(k) for k in keys],
        left_at.alias("__at"),
        F.lit(1).alias("__side"),
        F.xxhash64(*[F.col(n).cast("string") for n in names]).alias("__tie"),
        F.struct(*names).alias("__left"),
    ).withColumn("__right", F.lit(None))
    from_right = right.select(
        *[F.col(k) for k in keys],
        right_at.alias("__at"),
        F.lit(0).alias("__side"),
        (tie if tie is not None else F.lit(0)).cast("bigint").alias("__tie"),
        right_value.alias("__right"),
    ).dropna(subset=[*keys, "__at"])
    stream = from_left.drop("__right").unionByName(from_right, allowMissingColumns=True)
    filled = carry_forward(
        stream,
        keys,
        F.col("__at"),
        [F.col("__at"), F.col("__side"), F.col("__tie")],
        F.col("__right"),
        output,
        splits=splits,
        # at one instant right rows come first, by their tie, and then the left rows, by their hash
        then=F.when(F.col("__side") == 0, F.col("__tie").cast("double")).otherwise(1e300 + F.col("__tie") * 1e270),
        unplaced=F.pmod(F.col("__tie"), F.lit(shuffle_width(left.sparkSession))),
    )
    matched = F.when(F.col("__at").isNotNull(), F.col(output)).alias(output)
    return filled.where("__side = 1").select(*[F.col(f"__left.{n}").alias(n) for n in names], matched)


def backward_steps(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    measured: str,
    splits: Sequence[float] | None = None,
) -> DataFrame:
    """Per key: rows, and rows whose `measured` value lies below that of the row before them."""
    needed = df.select(*keys, order, measured)
    paired = previous_row(needed, keys, F.col(order), [F.col(order)], [measured], "prev", splits)
    return paired.groupBy(*keys).agg(
        F.count("*").alias("n_rows"),
        F.count_if(F.col(measured) < F.col(f"prev.{measured}")).alias("n_backward"),
    )


def _ascending(order: Sequence[Column]) -> list[Column]:
    return [c.alias(f"o{i}") for i, c in enumerate(order)]
