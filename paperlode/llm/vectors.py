"""Whole-number vectors for exact search by inner product, as points of a metric space, and tasks of bounded size.

A component x becomes floor(256 x). With M the largest squared length of all vectors, a vector x is the point
(x, sqrt(M - |x|^2)) and a query q the point (q, 0). All points of vectors are sqrt(M) long, so the squared distance from
q to x is |q|^2 + M - 2 q.x: the larger the inner product the closer the point, and the triangle inequality
holds for bounds. Distances only rule things out, with `Space.slack` for rounding; scores are whole numbers.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperlode.session import shuffle_width

SCALE = 256
#: Rows that meet in one task: of the queries, and of the vectors that are searched.
GANG_ROWS, BLOCK_ROWS = 8_192, 16_384
#: Vectors compared at a time within a task.
CHUNK = 512
LONG = np.iinfo(np.int64)
#: Stands below every score.
NO_SCORE = LONG.min


@dataclass(frozen=True)
class Space:
    """What holds for all vectors of a table: components (shorter vectors count as ending in zeros), the largest
    squared length, the number type that keeps every component, and whether doubles add up inner products exactly."""

    dim: int
    longest: float
    dtype: str
    exact: bool
    rows: int

    @property
    def slack(self) -> float:
        """More than distances can be off by rounding: the root of what squares of lengths lose."""
        return 1e-6 * math.sqrt(self.longest) + 1e-9


def floored(column: pa.Array, dim: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(matrix, rows): the whole-number vectors of the rows that are not null and hold neither nulls nor infinite numbers."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    with np.errstate(over="ignore"):
        flat = np.floor(SCALE * column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False))
    row = np.repeat(np.arange(len(column)), lengths)
    good = pc.is_valid(column).to_numpy(zero_copy_only=False).copy()
    good[row[~np.isfinite(flat)]] = False
    matrix = np.zeros((len(column), int(lengths.max(initial=0)) if dim is None else dim))
    matrix[row, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    rows = np.flatnonzero(good)
    return matrix[rows], rows


def measured(rows: DataFrame, id_col: str, vector_col: str) -> Space:
    """One pass over the vectors; a row for each batch of them is added up."""

    def run(batches):
        for batch in batches:
            matrix, _ = floored(batch.column("v"))
            if len(matrix):
                most = float(np.abs(matrix).max(initial=0))
                length = float(np.einsum("ij,ij->i", matrix, matrix).max())
                yield pa.RecordBatch.from_pydict({"n": [len(matrix)], "dim": [matrix.shape[1]], "most": [most], "length": [length]})

    given = rows.filter(F.col(id_col).isNotNull()).select(F.col(vector_col).alias("v"))
    found = given.mapInArrow(run, "n long, dim long, most double, length double")
    n, dim, most, length = found.agg(F.sum("n"), F.max("dim"), F.max("most"), F.max("length")).first()
    dim, most = max(1, dim or 1), most or 0.0
    return Space(dim, length or 0.0, "<i2" if most < 2**15 else "<f8", dim * most * most < 2**53, n or 0)


def packed(matrix: np.ndarray, space: Space) -> pa.Array:
    """One binary value a row."""
    size = space.dim * np.dtype(space.dtype).itemsize
    data = np.ascontiguousarray(matrix.astype(space.dtype)).tobytes()
    offsets = np.arange(len(matrix) + 1, dtype=np.int32) * size
    return pa.Array.from_buffers(pa.binary(), len(matrix), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def unpacked(column: pa.ChunkedArray | pa.Array, space: Space) -> np.ndarray:
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    parts = [np.zeros((0, space.dim))]
    for chunk in chunks:
        if len(chunk):
            size = np.dtype(space.dtype).itemsize * space.dim
            data = np.frombuffer(chunk.buffers()[2], dtype=np.uint8)[chunk.offset * size : (chunk.offset + len(chunk)) * size]
            parts.append(data.view(space.dtype).reshape(-1, space.dim).astype(np.float64))
    return np.concatenate(parts)


def scores(queries: np.ndarray, vectors: np.ndarray, space: Space) -> np.ndarray:
    """Inner products as longs. Numbers that doubles can't add up exactly are added as Python's; what a long can't
    hold is set to the nearest one that is no `NO_SCORE`."""
    if space.exact:
        return (queries @ vectors.T).astype(np.int64)
    whole = np.frompyfunc(int, 1, 1)
    sums = whole(queries) @ whole(vectors).T
    return np.clip(sums, LONG.min + 1, LONG.max).astype(np.int64)


def heights(matrix: np.ndarray, space: Space) -> np.ndarray:
    """The last coordinate of the vectors' points."""
    return np.sqrt(np.maximum(space.longest - np.einsum("ij,ij->i", matrix, matrix), 0))


def between_points(left: np.ndarray, right: np.ndarray, space: Space) -> np.ndarray:
    """Distances of vectors to vectors."""
    inner = left @ right.T + np.outer(heights(left, space), heights(right, space))
    return np.sqrt(np.maximum(2 * space.longest - 2 * inner, 0))


def from_queries(queries: np.ndarray, vectors: np.ndarray, space: Space) -> np.ndarray:
    """Distances of queries to vectors."""
    own = np.einsum("ij,ij->i", queries, queries)[:, None]
    return np.sqrt(np.maximum(own + space.longest - 2 * (queries @ vectors.T), 0))


def as_distance(score: np.ndarray, own: np.ndarray, space: Space) -> np.ndarray:
    """The distance at which a query of squared length `own` has this score."""
    return np.sqrt(np.maximum(own + space.longest - 2 * np.asarray(score, dtype=np.float64), 0))


def sample(rows: DataFrame, id_col: str, vector_col: str, size: int, space: Space) -> np.ndarray:
    """Up to `size` different vectors, by a hash of their ids; the zero vector if there is none."""
    fine = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    chosen = rows.filter(F.col(id_col).isNotNull() & fine).select(F.col(vector_col).alias("v"), F.xxhash64(id_col).alias("h"))
    chosen = chosen.orderBy("h", "v").limit(size).select("v").toArrow()
    matrix, _ = floored(chosen["v"], space.dim)
    return np.unique(matrix, axis=0) if len(matrix) else np.zeros((1, space.dim))


def far_apart(points: np.ndarray, count: int, space: Space) -> np.ndarray:
    """Rows of `points` that each lie far from those chosen before, the first one being the first row."""
    chosen = [0]
    nearest = between_points(points, points[:1], space)[:, 0]
    while len(chosen) < min(count, len(points)):
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, between_points(points, points[chosen[-1:]], space)[:, 0])
    return np.array(chosen)


@dataclass(frozen=True)
class Deal:
    """Which cells' queries go together (a gang), into how many parts a gang is cut, and into how many blocks what it searches."""

    gang: np.ndarray
    parts: np.ndarray
    blocks: np.ndarray


def dealt(queries: np.ndarray, vectors: np.ndarray, needs: np.ndarray, width: int) -> Deal:
    """A deal for numbers of queries and of vectors per cell; needs[i, j]: queries of cell i search cell j.

    Neighbouring cells share a gang while their queries fit one part; a cell with more is a gang of several parts.
    There are as many blocks as keep a task's vectors within bounds, and enough tasks for `width` of them to run.
    """
    gang, now, filled = np.zeros(len(queries), dtype=np.int64), 0, 0
    for cell, n in enumerate(queries):
        if filled and filled + n > GANG_ROWS:
            now, filled = now + 1, 0
        gang[cell] = now
        filled += n
    parts, blocks = np.ones(now + 1, dtype=np.int64), np.ones(now + 1, dtype=np.int64)
    for g in range(now + 1):
        cells = gang == g
        parts[g] = max(1, -(-int(queries[cells].sum()) // GANG_ROWS))
        searched = int(vectors[needs[cells & (queries > 0)].any(axis=0)].sum())
        blocks[g] = max(1, -(-searched // BLOCK_ROWS))
    least = -(-width // int(parts.sum()))
    return Deal(gang, parts, np.maximum(blocks, least))


def meet(queries: DataFrame, vectors: DataFrame, deal: Deal, needs: DataFrame, within: Column, solve, schema: str) -> DataFrame:
    """`solve` for each gang part and block: queries have a column `cell`; vectors are sent where `needs`
    (gang, cell, and what `within` tests) asks for their cell."""
    spark = queries.sparkSession
    sizes = [(int(g), int(p), int(b)) for g, (p, b) in enumerate(zip(deal.parts, deal.blocks))]
    sizes = F.broadcast(spark.createDataFrame(sizes, "gang long, n_parts long, n_blocks long"))  # one row a gang, of cells
    gangs = F.broadcast(spark.createDataFrame([(i, int(g)) for i, g in enumerate(deal.gang)], "cell long, gang long"))
    asked = queries.join(gangs, "cell").join(sizes, "gang").withColumns({
        "part": F.pmod(F.xxhash64("row"), "n_parts"), "block": F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1)),
    })
    # needs are at most one row for each two cells, and the number of cells is bounded
    sent = vectors.join(F.broadcast(needs), "cell").filter(within).join(sizes, "gang").withColumns({
        "part": F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_parts") - 1)), "block": F.pmod(F.xxhash64("row", F.lit(7)), "n_blocks"),
    })
    key = ["gang", "part", "block"]
    # columns under new identities, as both sides may come from one table
    left = asked.select(*[F.col(c).alias(c) for c in (*key, *queries.columns)]).groupBy(*key)
    right = sent.select(*key, *vectors.columns).groupBy(*key)
    return left.cogroup(right).applyInArrow(solve, schema)


def width_of(df: DataFrame) -> int:
    return shuffle_width(df.sparkSession)


class Best:
    """The k best (score, id) of each query: higher scores first, then smaller ids."""

    def __init__(self, n: int, k: int) -> None:
        self.k = k
        self.query, self.score, self.id = (np.zeros(0, dtype=np.int64) for _ in range(3))
        self.least = np.full(n, NO_SCORE)

    def add(self, query: np.ndarray, found: np.ndarray, ids: np.ndarray) -> None:
        """Scores (`found`, a row for each of `query`, a column for each of `ids`); NO_SCORE takes no part."""
        if found.shape[1] > self.k:
            floor = np.partition(found, -self.k, axis=1)[:, -self.k]
        else:
            floor = np.full(len(query), NO_SCORE)
        floor = np.maximum(floor, self.least[query])
        at, column = np.nonzero((found >= floor[:, None]) & (found != NO_SCORE))
        if not len(at):
            return
        q = np.concatenate([self.query, query[at]])
        s = np.concatenate([self.score, found[at, column]])
        i = np.concatenate([self.id, ids[column]])
        order = np.lexsort((i, -s, q))
        q, s, i = q[order], s[order], i[order]
        starts = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
        place = np.arange(len(q)) - np.repeat(starts, np.diff(np.r_[starts, len(q)]))
        keep = place < self.k
        self.query, self.score, self.id = q[keep], s[keep], i[keep]
        full = place == self.k - 1
        self.least[q[full]] = s[full]
