"""Hard negatives by a tree of multiway hyperplane splits, after GNAT (Brin 1995).

A node has up to 16 split points; a vector goes to the nearest of them. Each split point keeps the smallest and largest
distance to the vectors under each of its siblings (and under itself). A window of scores around an anchor is an annulus
around its point: a subtree is left out when, for one of the split points, its range of distances does not meet the
range that the annulus allows. The leaves that stay are searched exactly.

The tree's shape comes from a bounded sample. All vectors are placed in it and all ranges are those of all vectors.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperlode.llm import vectors as V
from paperlode.llm.common import stored

#: Vectors that shape the tree, of which so many make no further node, and the most split points of a node. The
#: number of leaves is bounded by the sample, whatever the number of vectors.
SAMPLE, LEAF_SAMPLE, SPLITS = 8_192, 32, 16
#: Sample rows looked at for each split point.
CANDIDATES = 3


@dataclass
class Node:
    points: np.ndarray
    #: For each split point the number of a node, or of a leaf below -1 turned around.
    below: list[int] = field(default_factory=list)
    #: [i, j]: distances of split point i to what lies under split point j. Nothing there: an empty range.
    least: np.ndarray | None = None
    most: np.ndarray | None = None


class Tree:
    """Nodes by number, a parent before its children; leaves are numbered from left to right."""

    def __init__(self, points: np.ndarray, space: V.Space, leaf_rows: int = LEAF_SAMPLE) -> None:
        self.space, self.nodes, self.leaves = space, [], 0
        self._grow(points, leaf_rows)

    def _grow(self, points: np.ndarray, leaf_rows: int) -> int:
        """The number of a new node or leaf over different `points`."""
        if len(points) <= max(1, leaf_rows) and self.nodes:
            self.leaves += 1
            return -self.leaves
        number = len(self.nodes)
        splits = min(SPLITS, max(1, len(points) // max(1, leaf_rows // 2)))
        node = Node(points[V.far_apart(points[: splits * CANDIDATES], splits, self.space)])
        self.nodes.append(node)
        nearest = V.between_points(points, node.points, self.space).argmin(axis=1)
        for k in range(len(node.points)):
            # a node of one split point has just a leaf
            few = leaf_rows if len(node.points) > 1 else len(points)
            node.below.append(self._grow(points[nearest == k], few))
        shape = (len(node.points), len(node.points))
        node.least, node.most = np.full(shape, math.inf), np.full(shape, -math.inf)
        return number

    def walk(self, matrix: np.ndarray):
        """(node, rows, distances to its split points, split point of each row) of every node that vectors pass."""
        waiting = {0: np.arange(len(matrix))}
        for number, node in enumerate(self.nodes):
            rows = waiting.pop(number, None)
            if rows is not None and len(rows):
                far = V.between_points(matrix[rows], node.points, self.space)
                nearest = far.argmin(axis=1)
                yield number, rows, far, nearest
                for k, below in enumerate(node.below):
                    if below >= 0:
                        waiting[below] = rows[nearest == k]

    def leaf_of(self, matrix: np.ndarray) -> np.ndarray:
        leaf = np.zeros(len(matrix), dtype=np.int64)
        for number, rows, _, nearest in self.walk(matrix):
            below = np.array(self.nodes[number].below)[nearest]
            leaf[rows[below < 0]] = -below[below < 0] - 1
        return leaf

    def alive(self, queries: np.ndarray, inner: np.ndarray, outer: np.ndarray) -> np.ndarray:
        """[query, leaf]: the leaf may hold vectors at a distance of `inner` to `outer` from the query."""
        out = np.zeros((len(queries), self.leaves), dtype=bool)
        waiting = {0: np.arange(len(queries))}
        for number, node in enumerate(self.nodes):
            rows = waiting.pop(number, None)
            if rows is None or not len(rows):
                continue
            far = V.from_queries(queries[rows], node.points, self.space)
            a, b, slack = inner[rows, None], outer[rows, None], self.space.slack
            lowest, highest = np.maximum(far - b, a - far) - slack, far + b + slack
            meets = np.ones((len(rows), len(node.points)), dtype=bool)
            for i in range(len(node.points)):
                meets &= (node.most[i][None] >= lowest[:, i, None]) & (node.least[i][None] <= highest[:, i, None])
            for k, below in enumerate(node.below):
                if below >= 0:
                    waiting[below] = rows[meets[:, k]]
                else:
                    out[rows[meets[:, k]], -below - 1] = True
        return out

    def measure(self, table: DataFrame) -> None:
        """Set the ranges of all nodes to those of all vectors; a task sends a few numbers for each node."""

        def run(batches):
            ranges = {}
            for batch in batches:
                for number, _, far, nearest in self.walk(V.unpacked(batch.column("v"), self.space)):
                    for j in np.unique(nearest):
                        here = far[nearest == j]
                        old = ranges.get((number, int(j)), (math.inf, -math.inf))
                        ranges[number, int(j)] = np.minimum(old[0], here.min(axis=0)), np.maximum(old[1], here.max(axis=0))
            found = [(n, i, j, float(lo[i]), float(hi[i])) for (n, j), (lo, hi) in ranges.items() for i in range(len(lo))]
            if found:
                yield pa.RecordBatch.from_pydict(dict(zip(("node", "i", "j", "lo", "hi"), map(list, zip(*found)))))

        rows = table.select("v").mapInArrow(run, "node long, i long, j long, lo double, hi double")
        for r in rows.groupBy("node", "i", "j").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect():
            self.nodes[r.node].least[r.i, r.j], self.nodes[r.node].most[r.i, r.j] = r.lo, r.hi


def placed(rows: DataFrame, anchors: Column, label: Column, tree: Tree, id_col: str, vector_col: str) -> DataFrame:
    """(row, id, label, asks, v, cell): all vectors that take part, and the leaf of each."""
    names = ["row", "id", "label", "asks"]

    def run(batches):
        for batch in batches:
            matrix, kept = V.floored(batch.column("v"), tree.space.dim)
            rest = [batch.column(c).take(pa.array(kept)) for c in names]
            yield pa.RecordBatch.from_arrays([*rest, V.packed(matrix, tree.space), pa.array(tree.leaf_of(matrix))], [*names, "v", "cell"])

    given = rows.filter(F.col(id_col).isNotNull() & label.isNotNull()).select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"),
        F.coalesce(anchors, F.lit(False)).alias("asks"), F.col(vector_col).alias("v"),
    )
    return given.mapInArrow(run, "row long, id long, label long, asks boolean, v binary, cell long")


class Search:
    """Searches of one set of anchors in one table of placed vectors."""

    def __init__(self, table: DataFrame, tree: Tree) -> None:
        self.table, self.tree, self.width = table, tree, V.width_of(table)
        # one number for each leaf
        self.count = self._per_leaf(table)
        self.vectors = table.select("row", "id", "label", "v", "cell")

    def _per_leaf(self, df: DataFrame) -> np.ndarray:
        out = np.zeros(self.tree.leaves, dtype=np.int64)
        for r in df.groupBy("cell").count().collect():
            out[r.cell] = r["count"]
        return out

    def _needs(self, anchors: DataFrame, alive) -> np.ndarray:
        """[i, j]: an anchor in leaf i needs leaf j; at most the square of the bounded number of leaves."""
        shape = (self.tree.leaves, self.tree.leaves)

        def run(batches):
            seen = np.zeros(shape, dtype=bool)
            for batch in batches:
                np.logical_or.at(seen, batch.column("cell").to_numpy(), alive(pa.Table.from_batches([batch])))
            i, j = np.nonzero(seen)
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j)], ["i", "j"])

        pairs = anchors.mapInArrow(run, "i long, j long").distinct().toArrow()
        needs = np.zeros(shape, dtype=bool)
        needs[pairs["i"].to_numpy(), pairs["j"].to_numpy()] = True
        return needs

    def run(self, anchors: DataFrame, alive, pick, schema: str) -> DataFrame:
        """`pick` for each task: anchors, vectors, and the pairs of both that their leaves let through, chunk by chunk."""
        needs = self._needs(anchors, alive)
        deal = V.dealt(self._per_leaf(anchors), self.count, needs, self.width)
        asked = {(int(deal.gang[i]), int(j)) for i, j in zip(*np.nonzero(needs))}
        needed = self.table.sparkSession.createDataFrame(sorted(asked), "gang long, cell long")
        space = self.tree.space

        def solve(left: pa.Table, right: pa.Table) -> pa.Table:
            def chunks():
                if not len(left) or not len(right):
                    return
                q, x, cells = V.unpacked(left["v"], space), V.unpacked(right["v"], space), right["cell"].to_numpy()
                own, their = left["row"].to_numpy(), right["row"].to_numpy()
                open_, order = alive(left), np.argsort(cells, kind="stable")
                for at in range(0, len(order), V.CHUNK):
                    chunk = order[at : at + V.CHUNK]
                    active = np.flatnonzero(open_[:, np.unique(cells[chunk])].any(axis=1))
                    if len(active):
                        found = V.scores(q[active], x[chunk], space)
                        found[own[active][:, None] == their[chunk][None]] = V.NO_SCORE
                        yield active, chunk, found

            return pick(left, right, chunks())

        return V.meet(anchors, self.vectors, deal, needed, F.lit(True), solve, schema)


def _nearest_of_label(k: int):
    """Up to k (row, other, score) of the anchor's label."""

    def pick(left: pa.Table, right: pa.Table, chunks) -> pa.Table:
        mine, theirs, ids = left["label"].to_numpy(), right["label"].to_numpy(), right["id"].to_numpy()
        best = V.Best(len(left), k)
        for active, chunk, found in chunks:
            best.add(active, np.where(mine[active][:, None] == theirs[chunk][None], found, V.NO_SCORE), ids[chunk])
        return pa.table({"row": left["row"].take(pa.array(best.query)), "other": best.id, "score": best.score})

    return pick


def _in_windows(n_windows: int, k: int):
    """Up to k (row, place, other, score) of other labels in each of the anchor's windows of scores."""

    def pick(left: pa.Table, right: pa.Table, chunks) -> pa.Table:
        mine, theirs, ids = left["label"].to_numpy(), right["label"].to_numpy(), right["id"].to_numpy()
        windows = left["windows"].to_pylist()
        # windows that an anchor has not are empty
        low, high = np.zeros((len(left), n_windows), dtype=np.int64), np.full((len(left), n_windows), -1, dtype=np.int64)
        for at, own in enumerate(windows):
            for w in own:
                low[at, w["place"] - 1], high[at, w["place"] - 1] = w["low"], w["high"]
        best = [V.Best(len(left), k) for _ in range(n_windows)]
        for active, chunk, found in chunks:
            other = mine[active][:, None] != theirs[chunk][None]
            for w in range(n_windows):
                inside = other & (found >= low[active, w, None]) & (found <= high[active, w, None])
                best[w].add(active, np.where(inside, found, V.NO_SCORE), ids[chunk])
        row = pa.concat_arrays([left["row"].combine_chunks().take(pa.array(b.query)) for b in best])
        place = np.concatenate([np.full(len(b.query), w + 1, dtype=np.int32) for w, b in enumerate(best)])
        return pa.table({"row": row, "place": place, "other": np.concatenate([b.id for b in best]), "score": np.concatenate([b.score for b in best])})

    return pick


def ranked(found: DataFrame, key: list[str], k: int) -> DataFrame:
    line = Window.partitionBy(*key).orderBy(F.desc("score"), "other")
    return found.withColumn("place_", F.row_number().over(line)).filter(F.col("place_") <= k)


def hard_negatives(
    rows: DataFrame, anchors: Column, label: Column, positives: int = 5, negatives: int = 5, percent: int = 80,
    id_col: str = "vec_id", vector_col: str = "embedding", leaf_rows: int = LEAF_SAMPLE,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score over whole `rows`.

    An anchor's positives are its best other rows of the same label; to each belong the best rows of other labels
    with a score from `percent` per cent of the positive's score up to it, so that a positive with a score below zero has
    none. Components are floor(256 x), ties go to the smaller id. Rows without id, label or vector, or with a component
    that is null or not finite, take no part; shorter vectors count as ending in zeros. Only its own row is no
    partner of an anchor: rows that repeat an id or a vector are each answered, and each found. Other columns are
    ignored; no rows, no answers.
    """
    space = V.measured(rows.filter(label.isNotNull()), id_col, vector_col)
    tree = Tree(V.sample(rows.filter(label.isNotNull()), id_col, vector_col, SAMPLE, space), space, leaf_rows)
    table = stored(placed(rows, anchors, label, tree, id_col, vector_col), "gnat")
    tree.measure(table)
    search = Search(table, tree)
    asks = table.filter("asks").drop("asks")

    # first the anchor's own leaf, which bounds how far its positives can be
    def at_home(left: pa.Table) -> np.ndarray:
        return left["cell"].to_numpy()[:, None] == np.arange(tree.leaves)[None]

    pick, found_schema = _nearest_of_label(positives), "row long, other long, score long"
    home = ranked(search.run(asks, at_home, pick, found_schema), ["row"], positives)
    bounds = home.filter(F.col("place_") == positives).select("row", F.col("score").alias("bound"))
    bounded = stored(asks.join(bounds, "row", "left"), "gnat-bounds")

    def within_bound(left: pa.Table) -> np.ndarray:
        q = V.unpacked(left["v"], space)
        known = left["bound"].is_valid().to_numpy()
        score = left["bound"].fill_null(0).to_numpy()
        outer = np.where(known, V.as_distance(score, np.einsum("ij,ij->i", q, q), space), math.inf)
        return tree.alive(q, np.zeros(len(q)), outer)

    best = ranked(search.run(bounded, within_bound, pick, found_schema), ["row"], positives)
    # ceil of the lower end, in whole numbers
    low = -F.expr(f"(-{percent} * cast(score as decimal(38, 0))) div 100")
    window = F.struct(F.col("place_").alias("place"), F.col("other").alias("positive"), low.cast("long").alias("low"), F.col("score").alias("high"))
    windows = best.filter("score >= 0").groupBy("row").agg(F.sort_array(F.collect_list(window)).alias("windows"))
    windowed = stored(asks.join(windows, "row"), "gnat-windows")

    def in_annulus(left: pa.Table) -> np.ndarray:
        q = V.unpacked(left["v"], space)
        own, windows = np.einsum("ij,ij->i", q, q), left["windows"].to_pylist()
        inner = V.as_distance(np.array([max(w["high"] for w in ws) for ws in windows], dtype=np.int64), own, space)
        outer = V.as_distance(np.array([min(w["low"] for w in ws) for ws in windows], dtype=np.int64), own, space)
        return tree.alive(q, inner, outer)

    pick = _in_windows(positives, negatives)
    found = search.run(windowed, in_annulus, pick, "row long, place int, other long, score long")
    chosen = ranked(found, ["row", "place"], negatives)
    named = windowed.select("row", F.col("id").alias("anchor_id"), F.explode("windows").alias("w"))
    named = named.select("row", "anchor_id", F.col("w.place").alias("place"), F.col("w.positive").alias("positive_id"), F.col("w.high").alias("positive_score"))
    return chosen.join(named, ["row", "place"]).select(
        "anchor_id", "positive_id", F.col("place_").alias("rank"), F.col("other").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score"),
    )
