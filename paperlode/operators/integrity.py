"""Tamper evidence and content identity: linked digests, Merkle trees, copies, repeatable ingest."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperlode.functions.hashing import sha256_bytes, sha256_hex
from paperlode.operators.once import computed_once
from paperlode.operators.ordered import dense_positions, previous_row
from paperlode.session import shared_dir

GENESIS = "0" * 64
FAN_IN = 1024


def link_rows(df: DataFrame, order: str, payload: Column, splits: Sequence[float] | None = None) -> DataFrame:
    """Add `row_hash`, `prev_hash` (of the row before in the whole table) and `link_hash` over both."""
    hashed = df.withColumn("row_hash", sha256_hex(payload))
    linked = previous_row(hashed, [], F.col(order), [F.col(order)], ["row_hash"], "__prev", splits)
    return (
        linked.withColumn("prev_hash", F.coalesce(F.col("__prev.row_hash"), F.lit(GENESIS)))
        .drop("__prev")
        .withColumn("link_hash", sha256_hex(F.concat("prev_hash", "row_hash")))
    )


def verify_links(log: DataFrame, order: str, payload: Column, splits: Sequence[float] | None = None) -> DataFrame:
    """Three checks per stored row: its content, its link, and its pointer to the row before.

    Each row is checked on its own against its neighbour, so a chain of any length is verified in
    parallel although it can only be built in sequence. A hash that was erased fails its checks. Rows cut
    off at the end leave no trace in the links; `matches_seal` finds them.
    """
    ahead = previous_row(log, [], F.col(order), [F.col(order)], ["row_hash"], "__prev", splits)
    return (
        ahead.withColumn("content_ok", _same(F.col("row_hash"), sha256_hex(payload)))
        .withColumn("link_ok", _same(F.col("link_hash"), sha256_hex(F.concat("prev_hash", "row_hash"))))
        .withColumn("pointer_ok", _same(F.col("prev_hash"), F.coalesce(F.col("__prev.row_hash"), F.lit(GENESIS))))
        .drop("__prev")
    )


def _same(stored: Column, computed: Column) -> Column:
    """Equality that is false, not null, when either side is missing."""
    return F.coalesce(stored == computed, F.lit(False))


def verify_chain(
    log: DataFrame, order: str, payload: Column, splits: Sequence[float] | None = None, keys: Sequence[str] = ()
) -> DataFrame:
    """The same checks for cumulative chains (one for each of `keys`), where `hash` = sha256(`prev_hash` + payload)."""
    ahead = previous_row(log, keys, F.col(order), [F.col(order)], ["hash"], "__prev", splits)
    return (
        ahead.withColumn("content_ok", _same(F.col("hash"), sha256_hex(F.concat(F.col("prev_hash"), payload))))
        .withColumn("pointer_ok", _same(F.col("prev_hash"), F.coalesce(F.col("__prev.hash"), F.lit(GENESIS))))
        .drop("__prev")
    )


def _node(left: bytes, right: bytes) -> bytes:
    return hashlib.sha256(b"\x01" + left + right).digest()


def _root_of(hashes: list[bytes]) -> bytes:
    while len(hashes) > 1:
        paired = [_node(hashes[i], hashes[i + 1]) for i in range(0, len(hashes) - 1, 2)]
        hashes = paired + hashes[len(paired) * 2 :]
    return hashes[0]


def _path_in(hashes: list[bytes], at: int) -> list[bytes]:
    """Siblings from the leaf upwards; a node without a sibling rises as it is."""
    path = []
    while len(hashes) > 1:
        if at ^ 1 < len(hashes):
            path.append(hashes[at ^ 1])
        paired = [_node(hashes[i], hashes[i + 1]) for i in range(0, len(hashes) - 1, 2)]
        hashes = paired + hashes[len(paired) * 2 :]
        at //= 2
    return path


@F.pandas_udf(T.BinaryType())
def _fold(groups: pd.Series) -> pd.Series:
    return groups.map(lambda g: _root_of([bytes(h) for h in g]))


def merkle_leaves(df: DataFrame, order: str, payload: Column, splits: Sequence[float] | None = None) -> DataFrame:
    """(idx, hash): RFC 6962 leaf hashes of the rows in order."""
    leaf = sha256_bytes(F.concat(F.lit(b"\x00"), payload.cast("binary")))
    return dense_positions(df.select(F.col(order), leaf.alias("hash")), order, "idx", splits).select("idx", "hash")


def merkle_levels(leaves: DataFrame, n: int, fan_in: int = FAN_IN, store: bool = False) -> list[DataFrame]:
    """Leaves, then each coarser level up to one row. A group holds at most `fan_in` hashes.

    Aligned groups of a power of two are whole subtrees, and only the last may be short, so the top
    equals the RFC 6962 tree head. A billion leaves take three rounds. With `store` each level is written to the shared
    folder once, for callers that read levels more than once.
    """

    def kept(level: DataFrame) -> DataFrame:
        if not store:
            return level
        path = shared_dir(level.sparkSession, "tree-level")
        level.sortWithinPartitions("idx").write.parquet(path)
        return level.sparkSession.read.schema(level.schema).parquet(path)

    if fan_in < 2 or fan_in & (fan_in - 1):
        raise ValueError("fan_in must be a power of two")
    levels, size = [kept(leaves)], n
    while size > 1:
        grouped = (
            levels[-1]
            .groupBy((F.col("idx") / fan_in).cast("bigint").alias("idx"))
            .agg(F.array_sort(F.collect_list(F.struct(F.col("idx").alias("i"), "hash"))).alias("members"))
        )
        levels.append(kept(grouped.select("idx", _fold(F.col("members.hash")).alias("hash"))))
        size = -(-size // fan_in)
    return levels


def merkle_root(leaves: DataFrame, n: int, fan_in: int = FAN_IN) -> DataFrame:
    """One row (root_hash) for `n` leaves, or none for an empty table."""
    return merkle_levels(leaves, n, fan_in)[-1].select(F.lower(F.hex("hash")).alias("root_hash"))


def seal(df: DataFrame, order: str, payload: Column, splits: Sequence[float] | None = None) -> DataFrame:
    """One row (n_rows, root_hash) that fixes a table: its size and tree head. The head is null without rows."""
    n = df.count()
    root = merkle_root(merkle_leaves(df, order, payload, splits), n).first()
    return df.sparkSession.createDataFrame([(n, root and root.root_hash)], "n_rows bigint, root_hash string")


def matches_seal(df: DataFrame, order: str, payload: Column, sealed: DataFrame) -> DataFrame:
    """One row (n_rows, size_ok, root_ok): whether a table is still what `sealed` fixed. Rows that were cut off
    at the end, which links cannot show, change both."""
    then = sealed.first()
    now = seal(df, order, payload)
    return now.select(
        "n_rows",
        (F.col("n_rows") == then.n_rows).alias("size_ok"),
        F.col("root_hash").eqNullSafe(F.lit(then.root_hash)).alias("root_ok"),
    )


def audit_path(levels: list[DataFrame], idx: int, fan_in: int = FAN_IN) -> list[bytes]:
    """Inclusion path of one leaf in stored levels. Per level, the driver receives the one group on the path (`fan_in` hashes)."""
    path: list[bytes] = []
    for level in levels[:-1]:
        first = idx // fan_in * fan_in
        group = level.where(F.col("idx").between(first, first + fan_in - 1)).orderBy("idx").collect()
        path += _path_in([bytes(r["hash"]) for r in group], idx - first)
        idx //= fan_in
    return path


def _climb(leaf: bytes, idx: int, size: int, path) -> bytes | None:
    """Tree head implied by a path (RFC 9162, section 2.1.3.2); null if the geometry is wrong."""
    if not 0 <= idx < size:
        return None
    at, last, node = idx, size - 1, leaf
    for sibling in path:
        if last == 0:
            return None
        if at & 1 or at == last:
            node = _node(bytes(sibling), node)
            while at and not at & 1:
                at, last = at >> 1, last >> 1
        else:
            node = _node(node, bytes(sibling))
        at, last = at >> 1, last >> 1
    return node if last == 0 else None


def included(leaf: Column, idx: Column, size: Column, path: Column, root: Column) -> Column:
    """Whether a path (array of binary) proves that `leaf` stands at `idx` in a tree of `size` leaves."""

    @F.pandas_udf("boolean")
    def run(lf: pd.Series, i: pd.Series, n: pd.Series, p: pd.Series, r: pd.Series) -> pd.Series:
        return pd.Series([_climb(bytes(a), b, c, d) == bytes(e) for a, b, c, d, e in zip(lf, i, n, p, r)])

    return run(leaf, idx, size, path, root)


def content_groups(df: DataFrame, row_id: str, content: Column) -> DataFrame:
    """One row per distinct content: its digest, the first id that has it, the number of copies.

    Only digest and id are shuffled, and partial aggregation merges the copies of a hot content first.
    """
    return (
        df.select(F.col(row_id), sha256_hex(content).alias("content_hash"))
        .groupBy("content_hash")
        .agg(F.min(row_id).alias("first_id"), F.count("*").alias("n_copies"))
    )


def repeated_groups(df: DataFrame, row_id: str, content: Column) -> DataFrame:
    """Contents held by more than one row, i.e. violations of one canonical row per content."""
    return content_groups(df, row_id, content).where("n_copies > 1")


def new_content(incoming: DataFrame, stored: DataFrame, row_id: str, content: Column) -> DataFrame:
    """(content_hash, first_id, n_copies) of contents that the store lacks; running it twice adds nothing.

    Both sides are reduced to distinct digests before the anti join, so copies cannot skew it.
    """
    known = computed_once(stored, [], {"content_hash": sha256_hex(content)}).distinct()
    return content_groups(incoming, row_id, content).join(known, "content_hash", "left_anti")
