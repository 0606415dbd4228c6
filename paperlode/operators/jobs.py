"""Batch forms of queue upkeep: order of work, and what becomes of stale work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ordinal(value: Column, tiers: list[str]) -> Column:
    """Place of a text tier in its list, from 0; null for a value outside it."""
    out = F.lit(None).cast("int")
    for i, tier in reversed(list(enumerate(tiers))):
        out = F.when(value == tier, F.lit(i)).otherwise(out)
    return out


def next_jobs(jobs: DataFrame, order: list[Column], n: int = 1) -> DataFrame:
    return jobs.orderBy(*order).limit(n)


def sweep_stale(jobs: DataFrame, stale: Column, attempts: Column, max_attempts: int, output: str) -> DataFrame:
    """Mark stale jobs 'queued' again, or 'dead' once their attempts are used up; others keep null."""
    return jobs.withColumn(
        output,
        F.when(stale, F.when(attempts >= max_attempts, F.lit("dead")).otherwise(F.lit("queued"))),
    )
