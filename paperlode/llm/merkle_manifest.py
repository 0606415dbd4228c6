"""A manifest of a dataset: persistent Merkle trees of 16 children a node, and one version for each tampered leaf.

Leaves of one source ascend by id. They are cut into aligned blocks of 16^3, so that a node of a block never depends
on another block: one task builds the three levels of a block, and the digests on top of all blocks are the
leaves of the next round, until each source has one node. The sources' nodes are the leaves of one more such tree.

A version is made by copying a path: the nodes above the changed leaf inside its block, and then, with the
siblings that come down from the upper rounds, those above the block. Every other node is shared with the
original tree and never computed again. Both the original and its versions leave through the same pass.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperlode.llm.common import ascii_lower, broadcast_if_small, stored
from paperlode.session import shuffle_width

FAN_OUT = 16
#: Levels inside a block, and so its size: what one task holds at a time.
LEVELS = 3
BLOCK = FAN_OUT**LEVELS
#: Hexadecimal digits of a digest.
DIGITS = 64
#: Rows of a partition that `monotonically_increasing_id` numbers before it goes on to the next partition.
PLACE_BITS = 33
PATH = "array<struct<before:string,after:string>>"


def sha256_hex(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def depth(n: int) -> int:
    """Levels above `n` nodes until one is left."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FAN_OUT), levels + 1
    return levels


def build(digests: list[str], levels: int) -> tuple[list[list[str]], list[str]]:
    """The runs of 16 digests (joined) of each level above `digests`, and what is left on top."""
    runs = []
    for _ in range(levels):
        joined = ["".join(digests[at : at + FAN_OUT]) for at in range(0, len(digests), FAN_OUT)]
        runs.append(joined)
        digests = [sha256_hex(run) for run in joined]
    return runs, digests


def path_of(runs: list[list[str]], at: int) -> Iterator[tuple[str, str]]:
    """The siblings before and after the ancestors of node `at`, from its own level up."""
    for level in runs:
        run, place = level[at // FAN_OUT], at % FAN_OUT * DIGITS
        yield run[:place], run[place + DIGITS :]
        at //= FAN_OUT


def encoded(value: Column) -> Column:
    """A value as `-` if it is null, else its bytes in UTF-8 behind their number and a colon."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaves(
    docs: DataFrame, fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), id_col: str = "doc_id",
    group_col: str = "source", text_col: str = "text", one_in: int = 5,
) -> DataFrame:
    """(group, id, leaf, tampered) of every row: its digest, and that of the tampered row (null where nobody tampers).

    Rows whose id has a CRC-32 (of its decimal text) that `one_in` divides are tampered with: A-Z of their text goes
    to lower case. A null id is never tampered with. `group` names the source so that null comes first.
    """
    chosen = F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(one_in)) == 0
    plain = {f: encoded(F.col(f)) for f in fields}
    # lower-casing A-Z keeps the number of bytes
    length = F.octet_length(F.col(text_col)).cast("string")
    lowered = F.coalesce(F.concat(length, F.lit(":"), ascii_lower(F.col(text_col))), F.lit("-"))
    changed = plain | {text_col: lowered}
    digest = lambda parts: F.sha2(F.concat(*parts.values()), 256)
    return docs.select(
        F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit("-")).alias("group"),
        F.col(id_col).alias("id"),
        digest(plain).alias("leaf"),
        F.when(chosen, digest(changed)).alias("tampered"),
    )


def numbered(nodes: DataFrame, order: Sequence[str]) -> DataFrame:
    """`nodes` with `pos`, the place in their group from 0, and `n`, the size of the group.

    Rows are dealt into ranges of (group, order), which cuts a group of any size; one row for each group and
    range carries the count on. Rows equal in all of `order` are in any order.
    """
    # rows that agree in everything are told apart by a number, so that no range grows with them
    told = nodes.withColumn("told", F.xxhash64(F.monotonically_increasing_id()))
    by = ["group", *order, "told"]
    placed = told.repartitionByRange(shuffle_width(nodes.sparkSession), *by).sortWithinPartitions(*by)
    placed = stored(placed.withColumn("place", F.monotonically_increasing_id()).drop("told"), "placed-nodes")
    placed = placed.withColumn("part", F.shiftright("place", PLACE_BITS))
    parts = placed.groupBy("group", "part").agg(F.min("place").alias("first"), F.count("*").alias("size"))
    before = Window.partitionBy("group").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(
        "group", "part", "first", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset"),
        F.sum("size").over(Window.partitionBy("group")).alias("n"),
    )
    pos = F.col("place") - F.col("first") + F.col("offset")
    joined = placed.join(broadcast_if_small(stored(parts, "node-parts")), ["group", "part"])
    return joined.withColumn("pos", pos).drop("place", "part", "first", "offset")


def _in_block(table: pa.Table, digest: str) -> tuple[list[list[str]], list[str], pa.Table]:
    table = table.sort_by("pos")
    n = table["n"][0].as_py()
    return *build(table[digest].to_pylist(), min(LEVELS, depth(n))), table


def _top(table: pa.Table) -> pa.Table:
    """The node on top of a block, as a node of the next round."""
    _, (top,), table = _in_block(table, "digest")
    n = table["n"][0].as_py()
    return pa.table({"group": table["group"][:1], "pos": table["block"][:1], "n": [-(-n // BLOCK)], "digest": [top]})


def _paths(table: pa.Table) -> pa.Table:
    """The path of every node to the top of its block."""
    runs, _, table = _in_block(table, "digest")
    steps = [[{"before": b, "after": a} for b, a in path_of(runs, k)] for k in range(len(table))]
    kind = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))
    return pa.table({"group": table["group"], "pos": table["pos"], "block": table["block"], "steps": pa.array(steps, kind)})


def _blocked(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("block", F.floor(F.col("pos") / BLOCK).cast("long"))


def climb(nodes: DataFrame) -> list[DataFrame]:
    """Rounds over (group, pos, n, digest): the nodes, the tops of their blocks, and so on until a group has one node."""
    rounds = [nodes.select("group", "pos", "n", "digest")]
    while (rounds[-1].agg(F.max("n")).first()[0] or 0) > 1:
        many = _blocked(rounds[-1].filter("n > 1"))
        tops = many.groupBy("group", "block").applyInArrow(_top, "group string, pos long, n long, digest string")
        rounds.append(stored(tops, "tree-round"))
    return rounds


def tops(rounds: list[DataFrame]) -> DataFrame:
    """(group, digest): the one node left of every group."""
    last = [r.filter("n = 1").select("group", "digest") for r in rounds]
    found = last[0]
    for df in last[1:]:
        found = found.unionByName(df)
    return found


def paths(rounds: list[DataFrame]) -> DataFrame:
    """(group, pos, path) of the nodes of the first round: siblings on the way to the group's last node."""
    none = F.array().cast(PATH)
    known = None
    for nodes in reversed(rounds):
        alone = nodes.filter("n = 1").select("group", "pos", none.alias("path"))
        if known is not None:
            steps = _blocked(nodes.filter("n > 1")).groupBy("group", "block")
            steps = steps.applyInArrow(_paths, f"group string, pos long, block long, steps {PATH}")
            above = known.select("group", F.col("pos").alias("block"), F.col("path").alias("above"))
            joined = steps.join(above, ["group", "block"]).select("group", "pos", F.concat("steps", "above").alias("path"))
            alone = alone.unionByName(joined)
        known = stored(alone, "tree-paths")
    return known


def _prove(left: pa.Table, right: pa.Table) -> pa.Table:
    """Proof and version of each leaf of a block; `right` is one row, what lies above the block."""
    runs, _, left = _in_block(left, "leaf")
    above = right.to_pylist()[0]
    upper = [(s["before"], s["after"]) for s in above["path"]]
    upper_text = "".join(b + a for b, a in upper)
    leaf, tampered = left["leaf"].to_pylist(), left["tampered"].to_pylist()
    proofs, copied = [], []
    for k, original in enumerate(leaf):
        own = list(path_of(runs, k))
        proofs.append(sha256_hex("".join(b + a for b, a in own) + upper_text))
        # the copied path: in the block first, then up to the root; siblings are the original ones
        version = [tampered[k] or original]
        for before, after in (*own, *upper):
            version.append(sha256_hex(before + version[-1] + after))
        copied.append(version)
    n, root = len(leaf), above["root"]
    return pa.table({
        "id": left["id"], "leaf": left["leaf"], "subroot": [above["subroot"]] * n, "root": [root] * n,
        "proof_sha256": proofs, "folded_root": [v[-1] for v in copied], "verified": [v[-1] == root for v in copied],
        "version": pa.array([v if t else None for v, t in zip(copied, tampered)], pa.list_(pa.string())),
    })


def manifest(docs: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """One row for each row: id, leaf, subroot, root, proof_sha256, folded_root, verified, and `version`.

    `version` lists the copied nodes of a tampered row's version, from the leaf up to its root, and is null for other
    rows. Null fields are `-`, a null or empty text is a leaf like any other, null ids come first in their source and
    are never tampered with. Rows that repeat an id are ordered by their leaves; equal rows have equal leaves and any
    order. Other columns are ignored; an empty table gives no rows. `how` goes to `leaves`.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    # stored first, because dealing into ranges reads its input twice
    hashed = stored(leaves(docs, id_col=id_col, **how), "manifest-leaves")
    placed = stored(numbered(hashed, ["id", "leaf"]), "manifest-numbered")
    rounds = climb(placed.withColumnRenamed("leaf", "digest"))
    # the sources' last nodes are the leaves of the tree above them
    subroots = numbered(tops(rounds).select(F.lit("").alias("group"), F.col("group").alias("name"), "digest"), ["name"])
    subroots = stored(subroots, "manifest-subroots")
    upper = climb(subroots)
    root = tops(upper).first()
    onward = paths(upper).select("pos", F.col("path").alias("onward"))
    named = subroots.join(onward, "pos").select(F.col("name").alias("group"), F.col("digest").alias("subroot"), "onward")
    # what lies above each block of leaves: inside its source, and from there on. A lone leaf is its own block.
    lone = placed.filter("n = 1").select("group", F.col("pos").alias("block"), F.array().cast(PATH).alias("path"))
    blocks = lone
    if len(rounds) > 1:
        blocks = lone.unionByName(paths(rounds[1:]).select("group", F.col("pos").alias("block"), "path"))
    above = blocks.join(named, "group").select(
        "group", "block", "subroot", F.lit(root and root.digest).cast("string").alias("root"), F.concat("path", "onward").alias("path")
    )
    above = stored(above, "manifest-above")
    schema = (
        f"id {id_type}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, "
        "verified boolean, version array<string>"
    )
    both = _blocked(placed).groupBy("group", "block").cogroup(above.groupBy("group", "block"))
    return both.applyInArrow(_prove, schema).withColumnRenamed("id", id_col)
