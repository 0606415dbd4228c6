"""An approximate vector index: a coarse quantiser, its cells stored as partitions, probing with exact rescoring.

The inverted file of Jégou, Douze and Schmid (2011) without their product codes: k-means centroids cut the space into
cells; a query reads the cells of its nearest centroids only and ranks what it reads by exact cosine. With all
cells probed the result is the exact ranking.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from paperlode.operators.retrieval import SCORE_DIGITS
from paperlode.session import shared_dir

#: Rows that k-means sees at most, and the most cells; the rest of the table is assigned, never left out.
SAMPLE_ROWS, MAX_CELLS = 50_000, 4_096
#: Stored vectors, and queries, that meet in one task at most (on average; they are dealt by a hash).
BLOCK_ROWS, PART_ROWS = 16_384, 4_096
#: Pairs of a vector and a centroid that a task holds at once.
HELD_PAIRS = 1 << 16


def _units(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(matrix, rows): unit vectors, and the rows that have `dim` finite components and a length."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    fits = pc.fill_null(pc.equal(pc.list_value_length(column), dim), False)
    rows = np.flatnonzero(fits.to_numpy(zero_copy_only=False))
    flat = column.filter(fits).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    matrix = flat.reshape(-1, dim)
    norms = np.sqrt(np.einsum("ij,ij->i", matrix, matrix))
    good = np.isfinite(norms) & (norms > 0)
    return matrix[good] / norms[good, None], rows[good]


def _slices(matrix: np.ndarray, rows: np.ndarray, cells: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The vectors and their rows, few at a time: each is held once for every cell."""
    step = max(1, HELD_PAIRS // cells)
    for start in range(0, len(rows), step):
        yield matrix[start : start + step], rows[start : start + step]


def _centroids(df: DataFrame, vector: str, dim: int, cells: int, sample_rows: int, n: int, seed: int) -> np.ndarray:
    """Unit centroids of k-means over a bounded sample."""
    few = df if n <= sample_rows else df.sample(fraction=sample_rows / n, seed=seed)
    usable = (F.size(vector) == dim) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable &= F.exists(vector, lambda x: x != 0)
    train = few.where(usable).select(array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
    train = train.persist()
    try:
        if not train.take(1):
            return np.eye(1, dim)
        model = KMeans(k=max(2, cells), seed=seed, maxIter=10, initSteps=2, distanceMeasure="cosine").fit(train)
        found = np.array([c for c in model.clusterCenters()])
    finally:
        train.unpersist()
    return found / np.linalg.norm(found, axis=1, keepdims=True)


def _with_cell(df: DataFrame, row_id: str, vector: str, centroids: np.ndarray) -> DataFrame:
    dim = centroids.shape[1]

    def run(batches):
        for batch in batches:
            matrix, rows = _units(batch.column(1), dim)
            for few, at in _slices(matrix, rows, len(centroids)):
                cell = pa.array((few @ centroids.T).argmax(axis=1).astype(np.int32))
                yield pa.RecordBatch.from_arrays([*batch.take(pa.array(at)).columns, cell], [row_id, vector, "cell"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(row_id, vector).schema]
    return df.select(row_id, vector).mapInArrow(run, ", ".join([*fields, "cell int"]))


def _write_rows(df: DataFrame, row_id: str, vector: str, centroids: np.ndarray, path: str) -> None:
    # the rebalance hint lets the adaptive planner cut a cell that holds very many rows
    placed = _with_cell(df, row_id, vector, centroids).hint("rebalance", "cell")
    placed.sortWithinPartitions("cell").write.mode("append").partitionBy("cell").parquet(f"{path}/rows")


def write_vector_index(
    df: DataFrame, row_id: str, vector: str, path: str, cells: int | None = None, sample_rows: int = SAMPLE_ROWS, seed: int = 7
) -> None:
    """Store the vectors of `df` by cells below `path`; about the square root of their number makes the cells.

    The index is over the most frequent number of components. Rows with another number, without a vector, with a
    component that is null or not finite, or of length zero have no cosine to a query and are left out.
    """
    sizes = df.groupBy(F.size(vector).alias("dim")).count().where("dim > 0").orderBy(F.desc("count"), "dim").first()
    dim, n = (sizes["dim"], sizes["count"]) if sizes else (1, 0)
    cells = cells or max(1, min(MAX_CELLS, round(math.sqrt(n))))
    centroids = _centroids(df, vector, dim, cells, sample_rows, n, seed)
    spark = df.sparkSession
    listed = [(k, [float(x) for x in c]) for k, c in enumerate(centroids)]
    spark.createDataFrame(listed, "cell int, centroid array<double>").write.parquet(f"{path}/cells")
    types = {c: df.schema[c].dataType.simpleString() for c in (row_id, vector)}
    schema = f"`{row_id}` {types[row_id]}, `{vector}` {types[vector]}, cell int"
    spark.createDataFrame([(row_id, vector, schema)], "row_id string, vector string, rows_schema string").write.parquet(f"{path}/about")
    _write_rows(df, row_id, vector, centroids, path)


def add_to_vector_index(df: DataFrame, path: str) -> None:
    """Store further rows in the cells that are there; centroids stay as they are."""
    spark = df.sparkSession
    about = spark.read.parquet(f"{path}/about").first()
    _write_rows(df, about.row_id, about.vector, read_centroids(spark, path), path)


def read_centroids(spark: SparkSession, path: str) -> np.ndarray:
    rows = spark.read.parquet(f"{path}/cells").orderBy("cell").collect()  # at most MAX_CELLS
    return np.array([r.centroid for r in rows])


def search_vector_index(
    queries: DataFrame, path: str, query_id: str, query_vector: str, k: int = 10, probes: int | None = None
) -> DataFrame:
    """(query_id, rank, row id, score, probe): the k best of the probed cells for each query, by cosine.

    `probes` cells are read for each query, all of them if None, which makes the ranking exact. `probe` says as which
    cell of its query (from 1) a row's cell was read. Only cells that some query probes are read at all. Scores are
    rounded, ties go to the smaller id. Query ids must be unique; queries without a cosine to anything find nothing.
    """
    spark = queries.sparkSession
    about = spark.read.parquet(f"{path}/about").first()
    row_id, vector = about.row_id, about.vector
    centroids = read_centroids(spark, path)
    dim, wanted = centroids.shape[1], min(probes or len(centroids), len(centroids))
    stored = spark.read.schema(about.rows_schema).parquet(f"{path}/rows")
    id_type, asked_type = stored.schema[row_id].dataType.simpleString(), queries.schema[query_id].dataType.simpleString()
    vector_type = queries.schema[query_vector].dataType.simpleString()

    def probed(batches):
        for batch in batches:
            matrix, rows = _units(batch.column(1), dim)
            for few, at in _slices(matrix, rows, len(centroids)):
                near = np.argsort(-(few @ centroids.T), axis=1, kind="stable")[:, :wanted]
                kept = batch.take(pa.array(np.repeat(at, wanted)))
                cell, place = pa.array(near.reshape(-1).astype(np.int32)), pa.array(np.tile(np.arange(1, wanted + 1, dtype=np.int32), len(at)))
                yield pa.RecordBatch.from_arrays([*kept.columns, cell, place], ["q", "qv", "cell", "probe"])

    asked = queries.select(F.col(query_id).alias("q"), F.col(query_vector).alias("qv"))
    asked = asked.mapInArrow(probed, f"q {asked_type}, qv {vector_type}, cell int, probe int")
    kept = shared_dir(spark, "probes")
    asked.write.parquet(kept)
    asked = spark.read.schema(asked.schema).parquet(kept)
    # one number a cell, on both sides: how finely its rows and its queries are dealt out
    per_cell = {r.cell: r.n for r in asked.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    stored = stored.where(F.col("cell").isin(sorted(per_cell)))
    sizes = {r.cell: r.n for r in stored.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    shares = [(c, -(-sizes[c] // BLOCK_ROWS), -(-n // PART_ROWS)) for c, n in sorted(per_cell.items()) if c in sizes]
    shares = F.broadcast(spark.createDataFrame(shares, "cell int, n_blocks bigint, n_parts bigint"))
    left = asked.join(shares, "cell").select(
        "cell", F.pmod(F.xxhash64("q"), "n_parts").alias("part"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_blocks") - 1)).alias("block"),
        "q", "qv", "probe",
    )
    right = stored.join(shares, "cell").select(
        "cell", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_parts") - 1)).alias("part"),
        F.pmod(F.xxhash64(row_id), "n_blocks").alias("block"), F.col(row_id).alias("i"), F.col(vector).alias("v"),
    )

    def solve(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        a, at = _units(mine["qv"], dim)
        b, rows = _units(theirs["v"], dim)
        ids = theirs["i"].take(pa.array(rows)).to_pandas().to_numpy()
        order = np.argsort(ids, kind="stable")  # then a stable sort by score leaves ties in the order of ids
        b, ids, rows = b[order], ids[order], rows[order]
        query, found, score = [], [], []
        for start in range(0, len(a), 256):
            close = np.round(a[start : start + 256] @ b.T, SCORE_DIGITS)
            best = np.argsort(-close, axis=1, kind="stable")[:, :k]
            query.append(np.repeat(at[start : start + 256], best.shape[1]))
            found.append(rows[best].reshape(-1))
            score.append(np.take_along_axis(close, best, axis=1).reshape(-1))
        query = np.concatenate(query or [np.zeros(0, dtype=np.int64)])
        found, score = (np.concatenate(x or [np.zeros(0, dtype=kind)]) for x, kind in ((found, np.int64), (score, np.float64)))
        named = mine.select(["q", "probe"]).take(pa.array(query))
        return named.append_column("i", theirs["i"].take(pa.array(found))).append_column("score", pa.array(score))

    key = ["cell", "part", "block"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(solve, f"q {asked_type}, probe int, i {id_type}, score double")
    # the product of unit vectors may be a negative zero, which compares as zero but shows differently
    found = found.withColumn("score", F.col("score") + F.lit(0.0))
    line = W.partitionBy("q").orderBy(F.desc("score"), "i")
    ranked = found.withColumn("rank", F.row_number().over(line)).where(F.col("rank") <= k)
    return ranked.select(F.col("q").alias(query_id), "rank", F.col("i").alias(row_id), "score", "probe")


def recall_by_probes(queries: DataFrame, path: str, query_id: str, query_vector: str, k: int = 10) -> DataFrame:
    """(probes, recall) for every number of probes at once: the share of the exact k best that lie in the first cells.

    One exact search says at which probe each neighbour's cell would have been read.
    """
    exact = search_vector_index(queries, path, query_id, query_vector, k)
    hits = exact.groupBy("probe").agg(F.count("*").alias("n"))
    cells = queries.sparkSession.read.parquet(f"{path}/cells").select((F.col("cell") + 1).alias("probes"))
    by = cells.join(hits, cells.probes == hits.probe, "left").select("probes", F.coalesce("n", F.lit(0)).alias("n"))
    # one row a cell, and the number of cells is bounded
    upto = F.sum("n").over(W.orderBy("probes").rowsBetween(W.unboundedPreceding, 0))
    return by.select("probes", (upto / F.nullif(F.sum("n").over(W.partitionBy()), F.lit(0))).alias("recall"))


def probes_for(queries: DataFrame, path: str, query_id: str, query_vector: str, k: int = 10, recall: float = 0.9) -> int:
    """The smallest number of probes whose measured recall over `queries` (a bounded sample) reaches the target."""
    curve = recall_by_probes(queries, path, query_id, query_vector, k)
    first = curve.where(F.col("recall") >= recall).agg(F.min("probes")).first()[0]
    return first or len(read_centroids(queries.sparkSession, path))
