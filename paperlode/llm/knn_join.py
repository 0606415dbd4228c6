"""Exact top-k by inner product as a Voronoi join (Lu, Shen, Chen and Ooi 2012).

Vectors and queries fall to their nearest pivot. Summaries of the cells (rows, smallest and largest distance to the pivot,
the k + 1 smallest distances) bound, for all queries of a cell, how far the k-th neighbour can be; a vector goes to
a group of queries only if the triangle inequality allows it to be closer. Each task solves one group against one
block of such vectors, with the bounds of each single query, and the best k of all blocks are the answer.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperlode.llm import vectors as V
from paperlode.llm.common import stored

#: The most pivots, whatever the number of vectors, and the rows looked at to choose a pivot.
PIVOTS, CANDIDATES = 256, 4


def assigned(rows: DataFrame, queries: Column, pivots: np.ndarray, space: V.Space, id_col: str, vector_col: str) -> DataFrame:
    """(row, id, v, cell, dist, asks, near, away): the cell of a vector, and of the query that it also is where `asks`."""

    def run(batches):
        for batch in batches:
            matrix, kept = V.floored(batch.column("v"), space.dim)
            far, out = V.between_points(matrix, pivots, space), V.from_queries(matrix, pivots, space)
            cell, near = far.argmin(axis=1), out.argmin(axis=1)
            at = np.arange(len(kept))
            rest = [batch.column(c).take(pa.array(kept)) for c in ("row", "id", "asks")]
            columns = [*rest, V.packed(matrix, space), cell, far[at, cell], near, out[at, near]]
            yield pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], ["row", "id", "asks", "v", "cell", "dist", "near", "away"])

    given = rows.filter(F.col(id_col).isNotNull()).select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"),
        F.coalesce(queries, F.lit(False)).alias("asks"), F.col(vector_col).alias("v"),
    )
    return given.mapInArrow(run, "row long, id long, asks boolean, v binary, cell long, dist double, near long, away double")


class Summary:
    """What the driver knows of the cells: a few numbers for each pivot."""

    def __init__(self, table: DataFrame, pivots: np.ndarray, space: V.Space, k: int) -> None:
        n = len(pivots)
        self.count, self.queries, self.reach = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64), np.zeros(n)
        self.least, self.most = np.full(n, math.inf), np.zeros(n)
        #: k + 1, because a query is itself one of the vectors
        self.closest = np.full((n, k + 1), math.inf)
        for r in table.groupBy("cell").agg(F.count("*").alias("n"), F.min("dist").alias("lo"), F.max("dist").alias("hi")).collect():
            self.count[r.cell], self.least[r.cell], self.most[r.cell] = r.n, r.lo, r.hi
        for r in table.filter("asks").groupBy("near").agg(F.count("*").alias("n"), F.max("away").alias("hi")).collect():
            self.queries[r.near], self.reach[r.near] = r.n, r.hi
        line = Window.partitionBy("cell").orderBy("dist")
        first = table.select("cell", "dist").withColumn("place", F.row_number().over(line)).filter(F.col("place") <= k + 1)
        for r in first.collect():
            self.closest[r.cell, r.place - 1] = r.dist
        self.apart = V.between_points(pivots, pivots, space)

    def bounds(self, to_pivots: np.ndarray) -> np.ndarray:
        """How far at most the k-th neighbour of queries with these distances to the pivots is."""
        ways = (to_pivots[:, :, None] + self.closest[None]).reshape(len(to_pivots), -1)
        k = self.closest.shape[1]
        return np.partition(ways, k - 1, axis=1)[:, k - 1]


def top_k(
    rows: DataFrame, queries: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding",
    pivots: int | None = None,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best other rows of each row that `queries` is true for, over whole `rows`.

    Components are floor(256 x), the score is the integer inner product, ties go to the smaller id. Rows without id or vector,
    or with a component that is null or not finite (256 x included), take no part; shorter vectors count as ending in
    zeros. Only its own row is no candidate of a query: rows that repeat an id or a vector are each answered, and each
    found. Other columns are ignored; no rows, no answers. Scores that a long can't hold become the nearest that it can.
    """
    space = V.measured(rows, id_col, vector_col)
    wanted = pivots or max(1, min(PIVOTS, round(math.sqrt(space.rows))))
    points = V.sample(rows, id_col, vector_col, wanted * CANDIDATES, space)
    points = points[V.far_apart(points, wanted, space)]
    table = stored(assigned(rows, queries, points, space, id_col, vector_col), "voronoi")
    known = Summary(table, points, space, k)

    # for all queries of cell i: their k-th neighbour is at most this far, so a vector of cell j must be so far from its pivot
    bound = known.bounds(known.reach[:, None] + known.apart)
    lowest = known.apart - (known.reach + bound)[:, None] - space.slack
    highest = known.apart + (known.reach + bound)[:, None] + space.slack
    needs = (known.most[None] >= lowest) & (known.least[None] <= highest) & (known.queries[:, None] > 0) & (known.count[None] > 0)
    deal = V.dealt(known.queries, known.count, needs, V.width_of(rows))
    asked = []
    for g in range(len(deal.parts)):
        for j in np.flatnonzero(needs[deal.gang == g].any(axis=0)):
            own = (deal.gang == g) & needs[:, j]
            asked.append((g, int(j), float(lowest[own, j].min()), float(highest[own, j].max())))
    needed = rows.sparkSession.createDataFrame(asked, "gang long, cell long, lowest double, highest double")

    def solve(left: pa.Table, right: pa.Table) -> pa.Table:
        q, x = V.unpacked(left["v"], space), V.unpacked(right["v"], space)
        q_row, x_row, ids, cells = (t.to_numpy() for t in (left["row"], right["row"], right["id"], right["cell"]))
        best = V.Best(len(q), k)
        if len(q) and len(x):
            own = np.einsum("ij,ij->i", q, q)
            to_pivots = V.from_queries(q, points, space)
            limit = known.bounds(to_pivots)
            # a cell's vectors are at least so far from a query: by the ring that they lie in, and by the plane
            # halfway between the query's pivot and theirs
            near = to_pivots.argmin(axis=1)
            ring = np.maximum(to_pivots - known.most[None], known.least[None] - to_pivots)
            gap = np.maximum(2 * known.apart[near], 1e-300)
            plane = np.where(known.apart[near] > 0, (to_pivots**2 - to_pivots.min(axis=1)[:, None] ** 2) / gap, 0)
            away = np.maximum(ring, plane) - space.slack
            # cells that lie close to these queries first
            order = np.lexsort((cells, away.mean(axis=0)[cells]))
            for at in range(0, len(order), V.CHUNK):
                chunk = order[at : at + V.CHUNK]
                closest = away[:, np.unique(cells[chunk])].min(axis=1)
                now = np.where(best.least > V.NO_SCORE, V.as_distance(best.least, own, space), math.inf)
                active = np.flatnonzero(closest <= np.minimum(limit, now) + space.slack)
                if len(active):
                    found = V.scores(q[active], x[chunk], space)
                    found[q_row[active][:, None] == x_row[chunk][None]] = V.NO_SCORE
                    best.add(active, found, ids[chunk])
        asked_by = left.select(["row", "id"]).take(pa.array(best.query)).rename_columns(["row", "query_id"])
        return asked_by.append_column("vec_id", pa.array(best.id)).append_column("score", pa.array(best.score))

    asks = table.filter("asks").select("row", "id", "v", F.col("near").alias("cell"))
    searched = table.select("row", "id", "v", "cell", "dist")
    within = F.col("dist").between(F.col("lowest"), F.col("highest"))
    found = V.meet(asks, searched, deal, needed, within, solve, "row long, query_id long, vec_id long, score long")
    line = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(line)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
