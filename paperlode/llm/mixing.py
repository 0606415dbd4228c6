"""Temperature mixing of sources, realised as permutations of blocks under a token budget.

A source with the share p of all tokens gets the weight p^a / sum p^a. The exponent a is bisected until the
weights reach a target entropy, or until no source has to be repeated more often than a limit. The documents of
a source are dealt into blocks by a hash; whole passes over a source give every document one copy each, and
the rest of its budget takes blocks in permuted order, the last of them up to a cut in its own permuted order.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperlode.llm.common import broadcast_if_small, stored, text_or_empty

SEED = 9
#: Documents of a block, about.
BLOCK_DOCS = 4_096
#: Exponents tried in one pass over the sources: fifteen inner points do the work of four bisections.
POINTS, PASSES = 15, 10


def token_count(text: Column) -> Column:
    """White-space separated words."""
    trimmed = F.trim(F.regexp_replace(text_or_empty(text), r"\s+", " "))
    return F.when(trimmed == "", 0).otherwise(F.length(trimmed) - F.length(F.replace(trimmed, F.lit(" "))) + 1)


@dataclass(frozen=True)
class Mix:
    """The exponent, the token budget, and per source and block what is taken."""

    exponent: float
    budget: float
    sources: DataFrame  # source, n_docs, n_tokens, weight, passes, rest, blocks
    blocks: DataFrame  # source, block, cut: rows up to this key get one more copy


def _key(id_col: str, text_col: str) -> Column:
    """The place of a row in the permutation of its block; rows that repeat id and text share it."""
    return F.xxhash64(F.lit(SEED), id_col, text_col)


def _block(blocks: Column, id_col: str, text_col: str) -> Column:
    return F.pmod(F.xxhash64(F.lit(SEED + 1), id_col, text_col), blocks)


def _entropy(exponents: list[float]) -> list[Column]:
    """Entropy in nats of the weights under each exponent: ln Z - a * sum(p^a ln p) / Z."""
    out = []
    for i, a in enumerate(exponents):
        z = F.sum(F.pow("p", F.lit(a)))
        out.append((F.log(z) - a * F.sum(F.pow("p", F.lit(a)) * F.log("p")) / z).alias(f"x{i}"))
    return out


def _repetition(exponents: list[float], budget: float | None) -> list[Column]:
    """The most passes any source needs: weight * budget / tokens, largest for the smallest share. Without a
    budget the largest source is used exactly once."""
    out = []
    for i, a in enumerate(exponents):
        z = F.sum(F.pow("p", F.lit(a)))
        whole = F.lit(budget) if budget is not None else F.max("tokens") / (F.pow(F.max("p"), F.lit(a)) / z)
        out.append((F.pow(F.min("p"), F.lit(a)) / z * whole / F.min("tokens")).alias(f"x{i}"))
    return out


def exponent_for(shares: DataFrame, entropy: float | None, repetition: float | None, budget: float | None) -> float:
    """The exponent from 0 (all sources alike) over 1 (as they are) to, for an entropy below that of the sources as
    they are, more than 1. Entropy and repetition both fall as it grows, so the smallest exponent is sought at which they
    are no higher than the target. Sources of equal size at the top keep the entropy above some targets; then it is
    as large as numbers allow. Only a few sums reach the driver, whatever the number of sources."""
    low, high = 0.0, 1.0
    if entropy is not None:
        top = shares.agg(F.max("p")).first()[0]
        # weights are powers of shares, which must not vanish
        while top is not None and top ** (2 * high) > 1e-250 and high < 1e6:
            if shares.agg(*_entropy([high])).first()[0] <= entropy + 1e-12:
                break
            low, high = high, 2 * high
    for _ in range(PASSES):
        tried = [low + (high - low) * (i + 1) / (POINTS + 1) for i in range(POINTS)]
        measures = _entropy([low, *tried]) if entropy is not None else _repetition([low, *tried], budget)
        target = entropy if entropy is not None else repetition
        at_low, *values = shares.agg(*measures).first()
        if at_low is None or at_low <= target + 1e-12:
            return low
        for a, value in zip(tried, values):
            if value <= target:
                high = a
                break
            low = a
    return high


def plan(docs: DataFrame, entropy_share: float | None = None, repetition: float | None = None, budget: float | None = None,
         spent_passes: float | None = None, block_docs: int = BLOCK_DOCS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> Mix:
    """What to take of each source. Give `entropy_share` (a part of the highest entropy, ln of the number of sources)
    or `repetition` (the most passes over a source). `budget` counts tokens, `spent_passes` gives it as a multiple of all
    tokens; without either it is what uses the largest source exactly once. A missing source is a source of its own; sources without tokens get nothing.
    """
    if (entropy_share is None) == (repetition is None):
        raise ValueError("give either entropy_share or repetition")
    rows = stored(
        docs.select(F.col(source_col).alias("source"), F.col(id_col).alias("id"),
                    F.xxhash64(text_or_empty(F.col(text_col))).alias("h"), token_count(F.col(text_col)).alias("tokens")),
        "mix-rows",
    )
    counted = stored(
        rows.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("tokens").cast("double").alias("tokens")), "mix-sources"
    )
    total, n_sources = counted.filter("tokens > 0").agg(F.sum("tokens"), F.count("*")).first()
    shares = counted.filter("tokens > 0").withColumn("p", F.col("tokens") / F.lit(total or 1.0))
    if spent_passes is not None:
        budget = spent_passes * (total or 0.0)
    entropy = None if entropy_share is None else entropy_share * math.log(max(n_sources, 1))
    a = exponent_for(shares, entropy, repetition, budget)
    z, top, most = shares.agg(F.sum(F.pow("p", F.lit(a))), F.max("p"), F.max("tokens")).first()
    spent = budget if budget is not None else (most * z / top**a if n_sources else 0.0)
    weight = F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / F.lit(total or 1.0), F.lit(a)) / F.lit(z or 1.0)).otherwise(0.0)
    # a share of a millionth of a token is rounding and no reason for one more document
    passes = F.when(F.col("tokens") > 0, F.floor(F.col("weight") * spent / F.col("tokens") + 1e-9)).otherwise(0)
    sources = stored(
        counted.withColumn("weight", weight).withColumn("passes", passes.cast("int")).select(
            "source", "n_docs", F.col("tokens").cast("long").alias("n_tokens"), "weight", "passes",
            F.greatest(F.lit(0.0), F.col("weight") * spent - F.col("passes") * F.col("tokens") - 1e-6).alias("rest"),
            F.ceil(F.col("n_docs") / block_docs).alias("blocks"),
        ),
        "mix-plan",
    )
    placed = _with_sources(rows, sources).select(
        "source", "rest", "tokens", _key("id", "h").alias("key"), _block(F.col("blocks"), "id", "h").alias("block")
    )
    sums = placed.filter("rest > 0").groupBy("source", "block", "rest").agg(F.sum("tokens").alias("tokens"))
    order = Window.partitionBy("source").orderBy(F.xxhash64(F.lit(SEED + 2), "block"), "block")
    before = F.coalesce(F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    taken = stored(sums.withColumn("before", before).filter("before < rest"), "mix-blocks")
    whole = taken.filter("before + tokens <= rest").select("source", "block", F.lit((1 << 63) - 1).alias("cut"))
    # at most one block of a source is cut, by a running sum over its own rows
    last = taken.filter("before + tokens > rest").select("source", "block", "before")
    inside = Window.partitionBy("source", "block").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    mine = placed.alias("r").join(
        broadcast_if_small(last).alias("b"), F.col("r.source").eqNullSafe(F.col("b.source")) & (F.col("r.block") == F.col("b.block"))
    ).select("r.source", "r.block", "rest", "tokens", "key", "before")
    run = F.col("before") + F.coalesce(F.sum("tokens").over(inside), F.lit(0))
    cuts = mine.withColumn("run", run).filter("run < rest").groupBy("source", "block").agg(F.max("key").alias("cut"))
    return Mix(a, float(spent), sources, stored(whole.unionByName(cuts), "mix-cuts"))


def _with_sources(rows: DataFrame, sources: DataFrame) -> DataFrame:
    renamed = sources.select(F.col("source").alias("mix_source"), "weight", "passes", "rest", "blocks")
    return rows.join(broadcast_if_small(renamed), F.col("source").eqNullSafe(F.col("mix_source")), "left").drop("mix_source")


def realise(docs: DataFrame, mix: Mix, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of `docs` with the columns mix_weight, mix_block and mix_copies (0 or more); columns of `docs` whose
    names start with mix_ give way to them. Nothing is shuffled as long
    as the plan is small; a plan beyond that size is joined by a shuffle."""
    kept = [c for c in docs.columns if not c.startswith("mix_")]
    docs = docs.select(*kept)
    plan_columns = mix.sources.select(F.col("source").alias("mix_source"), F.col("weight").alias("mix_weight"),
                                      F.col("passes").alias("mix_passes"), F.col("blocks").alias("mix_blocks"))
    rows = docs.join(broadcast_if_small(plan_columns), F.col(source_col).eqNullSafe(F.col("mix_source")), "left")
    rows = rows.withColumn("mix_hash", F.xxhash64(text_or_empty(F.col(text_col))))
    rows = rows.withColumn("mix_block", _block(F.col("mix_blocks"), id_col, "mix_hash"))
    cuts = mix.blocks.select(F.col("source").alias("mix_cut_source"), F.col("block").alias("mix_cut_block"), F.col("cut").alias("mix_cut"))
    rows = rows.join(
        broadcast_if_small(cuts), F.col(source_col).eqNullSafe(F.col("mix_cut_source")) & (F.col("mix_block") == F.col("mix_cut_block")), "left"
    )
    more = F.when(F.col("mix_cut").isNotNull() & (_key(id_col, "mix_hash") <= F.col("mix_cut")), 1).otherwise(0)
    return rows.select(*kept, "mix_weight", "mix_block", (F.col("mix_passes") + more).alias("mix_copies"))


def permuted(docs: DataFrame, mix: Mix, **names: str) -> DataFrame:
    """One row per copy, with mix_epoch (from 0) and the places of its block and of itself in the permutation of that
    epoch. Sorting by (mix_epoch, mix_block_place, mix_place) gives the training order."""
    rows = realise(docs, mix, **names).filter("mix_copies > 0")
    copies = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("mix_copies") - 1)).alias("mix_epoch"))
    id_col = names.get("id_col", "doc_id")
    return copies.select(
        *[c for c in docs.columns if not c.startswith("mix_")],
        "mix_epoch",
        F.xxhash64(F.lit(SEED), "mix_epoch", names.get("source_col", "source"), "mix_block").alias("mix_block_place"),
        F.xxhash64(F.lit(SEED), "mix_epoch", id_col).alias("mix_place"),
    )


def mix_report(docs: DataFrame, mix: Mix) -> DataFrame:
    """One row per input row: doc_id, source, n_tokens, weight (of its source), block, copies."""
    rows = realise(docs.select("doc_id", "source", "text"), mix)
    return rows.select("doc_id", "source", token_count(F.col("text")).cast("long").alias("n_tokens"),
                       F.col("mix_weight").alias("weight"), F.col("mix_block").alias("block"),
                       F.col("mix_copies").alias("copies"))
