"""Set similarity self-join on word shingles by chosen paths (Christiani, Pagh and Sivertsen 2017).

Every set becomes T coordinates by min-hashing, so that two sets agree in a coordinate with a probability equal to their
Jaccard similarity. A tree is grown over all sets: a node samples coordinates and sends each set to the child named by
its value there, so similar sets keep meeting. Buckets that are small enough are compared by brute force,
larger ones are split again. Several trees are grown until a pair at the threshold meets with the wanted
probability.

What meets is only a candidate. Candidates are joined to components, and inside each component all pairs of
sets are compared exactly, block against block. Pairs are counted where they are compared and never leave the task.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperlode.llm.common import NEAR_COPY, SHINGLE_WORDS, broadcast_if_small, pieces, stored, text_or_empty
from paperlode.llm.components import components

COORDINATES = 64
#: Coordinates that a node samples. 1 / similarity is what keeps a path alive at all; two make it likely to live.
SAMPLED = 2
#: Buckets up to this size are compared; larger ones are split until this depth. Sets that still share a bucket
#: then agree in as many coordinates and go on together.
LEAF, DEPTH = 64, 4
#: Least agreement of 64 two-bit coordinates that a compared pair needs to become a candidate: the expected agreement
#: at the threshold less 3.5 standard deviations.
DEVIATIONS = 3.5
#: Sets and bytes of one side of an exact comparison.
BLOCK_SETS, BLOCK_BYTES = 1024, 16 << 20
COLUMNS = 4096  # shingles that are compared at a time
PACKED = 6  # bytes that are kept of a shingle's hash


def trees_for(recall: float, similarity: float = NEAR_COPY, sampled: int = SAMPLED) -> int:
    """How many trees find a pair of this similarity with probability `recall`, however deep they are.

    A shared path dies out with the probability q = (1 - s + s q)^k of a branching process with k samples.
    """
    q = 0.0
    for _ in range(200):
        q = (1 - similarity + similarity * q) ** sampled
    return max(1, math.ceil(math.log(1 - recall) / math.log(q))) if 0 < q < 1 else 1


_SPACES = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))


def _shingles(text: str, n: int) -> np.ndarray:
    """The distinct hashes of the word n-grams of a text; one of all its words if it has fewer."""
    # after lower-casing A-Z, bytes beyond ASCII, digits and letters make words, as in the decontamination
    found = text.encode().lower().translate(_SPACES).split()
    if not found:
        return np.empty(0, np.uint64)
    h = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in found), np.uint64, len(found))
    n = min(n, len(h))
    with np.errstate(over="ignore"):
        mixed = np.zeros(len(h) - n + 1, np.uint64)
        for i in range(n):
            mixed = (mixed ^ h[i : len(h) - n + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed & np.uint64((1 << 8 * PACKED) - 1))


def _coefficients() -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(20170808)
    a = draw.integers(1, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return a, draw.integers(0, 1 << 63, COORDINATES, dtype=np.uint64)


def _min_hashes(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    least = np.full(COORDINATES, np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(values), 4096):
        part = values[at : at + 4096]
        with np.errstate(over="ignore"):
            h = part[None, :] * a[:, None] + b[:, None]
            h ^= h >> np.uint64(31)
            h *= np.uint64(0xD6E8FEB86659FD93)
        least = np.minimum(least, (h >> np.uint64(32)).astype(np.uint32).min(axis=1))
    return least


def _tag(sketch: np.ndarray) -> np.ndarray:
    """Two bits of each coordinate, 64 coordinates in two 64-bit numbers."""
    bits = (sketch & 3).astype(np.uint64).reshape(2, 32) << (2 * np.arange(32, dtype=np.uint64))
    return np.bitwise_or.reduce(bits, axis=1).view(np.int64)


SETS = "row bigint, doc_id bigint, text_hash bigint, n int, set_key binary, t0 bigint, t1 bigint, sketch array<int>, packed binary"


def sketches(docs: DataFrame, shingle: int = SHINGLE_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's shingle set: a key that equal sets share, its coordinates, and the hashes themselves."""
    a, b = _coefficients()

    def build(batches):
        for batch in (part for whole in batches for part in pieces(whole)):
            out = []
            for text in batch.column("text"):
                values = _shingles(text.as_py() or "", shingle)
                sketch = _min_hashes(values, a, b)
                packed = values.view(np.uint8).reshape(-1, 8)[:, :PACKED].tobytes()
                t0, t1 = _tag(sketch)
                out.append((len(values), xxhash.xxh3_128_digest(packed), t0, t1, sketch.view(np.int32), packed))
            n, key, t0, t1, sketch, packed = zip(*out) if out else ([],) * 6
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("row"),
                    batch.column("doc_id"),
                    batch.column("text_hash"),
                    pa.array(n, pa.int32()),
                    pa.array(key, pa.binary()),
                    pa.array(t0, pa.int64()),
                    pa.array(t1, pa.int64()),
                    pa.array(sketch, pa.list_(pa.int32())),
                    pa.array(packed, pa.binary()),
                ],
                ["row", "doc_id", "text_hash", "n", "set_key", "t0", "t1", "sketch", "packed"],
            )

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("bigint").alias("doc_id"),
                       F.xxhash64(text_or_empty(F.col(text_col))).alias("text_hash"), F.col(text_col).alias("text"))
    return stored(rows.mapInArrow(build, SETS), "shingle-sets")


def _children(rows: DataFrame) -> DataFrame:
    """The buckets one level down: `SAMPLED` coordinates chosen by the path, each with the set's value there."""
    first = F.pmod(F.xxhash64("path", F.lit(0)), F.lit(COORDINATES))
    step = 1 + F.pmod(F.xxhash64("path", F.lit(1)), F.lit(COORDINATES - 1))
    at = F.explode(F.array(*[F.pmod(first + j * step, F.lit(COORDINATES)).cast("int") for j in range(SAMPLED)]))
    found = rows.select("path", "rep", "t0", "t1", "sketch", at.alias("at"))
    return found.select(F.xxhash64("path", "at", F.get("sketch", "at")).alias("path"), "rep", "t0", "t1")


def _bucket_edges(least_agreement: int):
    """Compare all pairs of a small bucket and keep a spanning forest of those that agree enough."""

    def compare(batches):
        for batch in batches:
            us, vs = [], []
            for members in batch.column(0).to_pylist():
                reps = np.array([m["rep"] for m in members])
                tags = np.array([(m["t0"], m["t1"]) for m in members])
                differ = tags[:, None, :] ^ tags[None, :, :]
                differ = (differ | (differ >> 1)) & 0x5555555555555555
                near = COORDINATES - np.bitwise_count(differ).sum(axis=2) >= least_agreement
                for i, j in _forest(near):
                    us.append(reps[i])
                    vs.append(reps[j])
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])

    return compare


def _forest(near: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of a boolean adjacency matrix."""
    edges, left = [], np.ones(len(near), bool)
    while left.any():
        todo = [int(np.argmax(left))]
        left[todo[0]] = False
        while todo:
            i = todo.pop()
            for j in np.flatnonzero(near[i] & left):
                left[j] = False
                edges.append((i, int(j)))
                todo.append(int(j))
    return edges


def candidate_edges(sets: DataFrame, similarity: float = NEAR_COPY, recall: float = 0.999) -> DataFrame:
    """Edges (u, v) between sets that met in some tree; their components hold all pairs that met."""
    expected = similarity + (1 - similarity) / 4
    agreement = math.floor(
        COORDINATES * expected - DEVIATIONS * math.sqrt(COORDINATES * expected * (1 - expected))
    )
    roots = F.explode(F.array(*[F.xxhash64(F.lit("tree"), F.lit(i)) for i in range(trees_for(recall, similarity))]))
    rows = sets.select(roots.alias("path"), "rep", "t0", "t1", "sketch")
    edges: list[DataFrame] = []
    for depth in range(1, DEPTH + 1):
        rows = stored(_children(rows), "paths")
        sizes = stored(rows.groupBy("path").agg(F.count("*").alias("size"), F.min("rep").alias("head"))
                       .filter("size > 1"), "bucket-sizes")
        members = rows.join(broadcast_if_small(sizes), "path")
        small = members.filter(F.col("size") <= LEAF).groupBy("path").agg(
            F.collect_list(F.struct("rep", "t0", "t1")).alias("members")
        )
        edges.append(stored(small.select("members").mapInArrow(_bucket_edges(agreement), "u bigint, v bigint"), "met"))
        large = members.filter(F.col("size") > LEAF)
        if depth == DEPTH:
            edges.append(large.select(F.col("rep").alias("u"), F.col("head").alias("v")))
        elif sizes.filter(F.col("size") > LEAF).isEmpty():
            break
        else:
            rows = large.select("path", "rep").join(sets, "rep").select("path", "rep", "t0", "t1", "sketch")
    found = edges[0]
    for more in edges[1:]:
        found = found.unionByName(more)
    return found.filter("u != v")


def _exact(similarity: float):
    """Compare the sets of block pairs exactly. Rows come sorted by (root, a, b), so a group is a run of rows.

    Yields for each set how many rows it is linked to (copies counted), and a spanning forest of the links.
    """

    def links(group, a, b):
        reps = np.array([g[0] for g in group])
        copies = np.array([g[1] for g in group])
        side = np.array([g[2] for g in group])
        if a != b and (side == side[0]).all():  # the other block got no sets; links inside this one count at (a, a)
            return []
        values = [np.frombuffer(g[3], np.uint8).reshape(-1, PACKED) for g in group]
        sizes = np.array([len(v) for v in values])
        wide = np.zeros((int(sizes.sum()), 8), np.uint8)
        wide[:, :PACKED] = np.concatenate(values)
        known, place, times = np.unique(wide.view(np.uint64).ravel(), return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(len(group)), sizes)
        shared = times[place] > 1  # a shingle of one set alone adds to no intersection
        column = np.cumsum(times > 1)[place[shared]] - 1
        owner, width = owner[shared], int((times > 1).sum())
        common = np.zeros((len(group), len(group)), np.float32)
        for at in range(0, width, COLUMNS):  # some columns at a time, so that memory stays bounded for long texts
            here = (column >= at) & (column < at + COLUMNS)
            matrix = np.zeros((len(group), min(COLUMNS, width - at)), np.float32)
            matrix[owner[here], column[here] - at] = 1.0
            common += matrix @ matrix.T
        near = common >= similarity * (sizes[:, None] + sizes[None, :] - common) - 1e-4
        np.fill_diagonal(near, False)
        if a != b:
            near &= side[:, None] != side[None, :]
        linked = near @ copies
        forest = _forest(near)
        out = [(int(r), int(n), None) for r, n in zip(reps, linked) if n]
        return out + [(int(reps[i]), 0, int(reps[j])) for i, j in forest]

    def compare(batches):
        key, group = None, []
        for batch in (part for whole in batches for part in pieces(whole)):
            out = []
            for row in batch.to_pylist():
                if (row["root"], row["a"], row["b"]) != key:
                    if len(group) > 1:
                        out += links(group, *key[1:])
                    key, group = (row["root"], row["a"], row["b"]), []
                group.append((row["rep"], row["copies"], row["block"], row["packed"]))
            yield _link_batch(out)
        if len(group) > 1:
            yield _link_batch(links(group, *key[1:]))

    return compare


def _link_batch(rows) -> pa.RecordBatch:
    columns = zip(*rows) if rows else ([], [], [])
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["rep", "linked", "other"])


def verified_links(reps: DataFrame, rows: DataFrame, candidates: DataFrame, similarity: float = NEAR_COPY) -> DataFrame:
    """(rep, linked, other): per set the number of rows linked with it, and edges that span the linked sets.

    A component is dealt into blocks of bounded size; every pair of blocks is compared in a task of its own.
    """
    members = components(candidates).withColumnRenamed("node", "rep").join(reps.select("rep", "copies"), "rep")
    members = broadcast_if_small(stored(members, "candidates"))
    held = stored(rows.select(F.col("row").alias("rep"), "packed").join(members, "rep"), "candidate-sets")
    need = F.greatest(F.ceil(F.count("*") / BLOCK_SETS), F.ceil(F.sum(F.octet_length("packed")) / BLOCK_BYTES))
    blocks = stored(held.groupBy("root").agg(need.cast("int").alias("blocks")), "component-blocks")
    dealt = held.join(blocks, "root").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    paired = dealt.select("root", "rep", "copies", "packed", "block", other.alias("other")).select(
        "root", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), "rep", "copies", "block", "packed"
    )
    width = int(held.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    grouped = paired.repartition(width, "root", "a", "b").sortWithinPartitions("root", "a", "b")
    return stored(grouped.mapInArrow(_exact(similarity), "rep bigint, linked bigint, other bigint"), "links")


def similar_documents(docs: DataFrame, similarity: float = NEAR_COPY, shingle: int = SHINGLE_WORDS, recall: float = 0.999,
                      id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, class_id, n_links, first, and text_hash of the text.

    Two rows are linked if the Jaccard similarity of their word shingles is at least `similarity`; `n_links` counts
    the rows linked with a row, copies of its own set included. Rows that are connected by links are a class,
    whose id is its smallest doc_id (null if none of its rows has an id); the row with that id is `first`, one of
    them if it repeats. A pair at the threshold becomes a
    candidate with probability `recall`; candidates are compared exactly. Texts of fewer words have one shingle. A
    text without words, null included, is linked with nothing and is a class of its own. Extra columns are ignored.
    """
    rows = sketches(docs, shingle, id_col, text_col)
    first = F.min(F.struct(F.col("row").alias("rep"), "t0", "t1", "sketch")).alias("f")
    keys = rows.filter("n > 0").groupBy("set_key").agg(first, F.count("*").alias("copies"))
    reps = stored(keys.select("set_key", "copies", "f.*"), "distinct-sets")
    links = verified_links(reps, rows, candidate_edges(reps, similarity, recall), similarity)
    linked = links.groupBy("rep").agg(F.sum("linked").alias("linked"))
    spanning = links.filter("other is not null").select(F.col("rep").alias("u"), F.col("other").alias("v"))
    roots = components(spanning).withColumnRenamed("node", "rep")
    known = stored(
        reps.join(linked, "rep", "left").join(roots, "rep", "left").select(
            "set_key",
            F.coalesce("root", "rep").alias("root"),
            (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"),
        ),
        "set-classes",
    )
    # texts without words have no set to share; each is its own class
    with_words = rows.filter("n > 0").select("row", "doc_id", "text_hash", "set_key").join(known, "set_key")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "row")).alias("first")
    firsts = stored(with_words.groupBy("root").agg(first), "class-firsts")
    found = with_words.join(firsts, "root").select(
        "doc_id", F.col("first.doc_id").alias("class_id"), "n_links", (F.col("first.row") == F.col("row")).alias("first"),
        "text_hash"
    )
    alone = rows.filter("n = 0").select("doc_id", F.col("doc_id").alias("class_id"),
                                        F.lit(0).cast("bigint").alias("n_links"), F.lit(True).alias("first"), "text_hash")
    return found.unionByName(alone)
