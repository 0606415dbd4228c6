"""Traversal of edge tables to a fixed point: forests by pointer jumping, any graph by squaring its reach.

Both take as many rounds as the depth has binary digits, not as it has levels. Every round is written to the shared folder,
so that plans stay short and a lost executor costs one round.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperlode.session import shared_dir


def _kept(df: DataFrame, purpose: str) -> DataFrame:
    path = shared_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _key(columns: Sequence[str], names: Sequence[str]) -> Column:
    """One value for a key of several columns; null if any of them is."""
    whole = F.lit(True)
    for c in columns:
        whole = whole & F.col(c).isNotNull()
    return F.when(whole, F.struct(*[F.col(c).alias(n) for c, n in zip(columns, names)]))


def roots(nodes: DataFrame, node: Sequence[str], parent: Sequence[str]) -> DataFrame:
    """The rows of `nodes` with `root` (a struct named like `node`) and `depth`: where the way over parents ends, after how many steps.

    A parent that is null (in any column), or that is no node itself, ends the way: its child is a root of depth 0. On a
    cycle, or on a way into one, both are null, and so they are for a row without a node. Nodes must be unique.

    In round k each node knows its ancestor 2^k steps up, and asks that one for its ancestor. A parent with very many
    children is one row on one side of each join; its children are the side that the adaptive planner can split.
    """
    rows = nodes.select(F.struct("*").alias("row"), _key(node, node).alias("node"), _key(parent, node).alias("up"))
    # written, so that each join exchanges both sides
    given = _kept(rows, "edges")
    known = _kept(given.select(F.col("node").alias("up"), F.lit(True).alias("is_node")).dropna(), "nodes")
    now = given.where("node IS NOT NULL").select("node", "up").join(known, "up", "left")
    steps = F.coalesce("is_node", F.lit(False)).cast("bigint").alias("steps")
    now = _kept(now.select("node", F.when(F.col("is_node"), F.col("up")).otherwise(F.col("node")).alias("up"), steps), "pointers")
    before = None
    while True:
        ahead = now.select(F.col("node").alias("up"), F.col("up").alias("further"), F.col("steps").alias("more"))
        moved = now.join(ahead, "up").select("node", F.col("further").alias("up"), (F.col("steps") + F.col("more")).alias("steps"))
        now = _kept(moved, "pointers")
        # nodes whose pointer has not come to a root; if there are no fewer than before, only those of cycles are left
        inner = now.where("steps > 0").select(F.col("node").alias("up"))
        restless = now.join(inner, "up", "left_semi")
        state = restless.count()
        if state in (0, before):
            break
        before = state
    ended = now.join(inner, "up", "left_anti").select("node", F.col("up").alias("root"), F.col("steps").alias("depth"))
    return given.join(ended, "node", "left").select("row.*", "root", "depth")


def reach(edges: DataFrame, source: str, target: str, max_depth: int | None = None) -> DataFrame:
    """(source, target, depth): every node that can be reached from another one, with the smallest number of edges.

    Cycles stop by themselves, as a pair stays with its smallest depth; a node on a cycle reaches itself. Edges
    with a null end lead nowhere. The result may be as large as the square of a component: give `max_depth`
    where that is not wanted.

    After round k all pairs up to 2^k edges apart are known. A longer shortest way has a node after exactly 2^k edges,
    so only pairs of that depth are joined with all pairs; a node of many edges is split by the adaptive planner.
    """
    now = edges.select(F.col(source).alias("s"), F.col(target).alias("t")).dropna().distinct()
    now = _kept(now.withColumn("depth", F.lit(1).cast("bigint")), "reach")
    length = 1
    while max_depth is None or length < max_depth:
        far = now.where(F.col("depth") == length).select("s", F.col("t").alias("via"))
        onward = now.select(F.col("s").alias("via"), "t", (F.col("depth") + length).alias("depth"))
        if max_depth is not None:
            onward = onward.where(F.col("depth") <= max_depth)
        both = now.unionByName(far.join(onward, "via").select("s", "t", "depth"))
        now = _kept(both.groupBy("s", "t").agg(F.min("depth").alias("depth")), "reach")
        length *= 2
        # nobody at the far end: no longer way begins there
        if now.where(F.col("depth") == length).isEmpty():
            break
    if max_depth is not None:
        now = now.where(F.col("depth") <= max_depth)
    return now.select(F.col("s").alias(source), F.col("t").alias(target), "depth")
