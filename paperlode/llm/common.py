"""Helpers that several operators share."""

from __future__ import annotations

import contextlib
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperlode.session import shared_dir

#: Two texts with as many words in common as this are near copies: shingles of five words, Jaccard 0.8.
SHINGLE_WORDS, NEAR_COPY = 5, 0.8
#: A table goes to every executor only if it has been counted and has at most so many rows (of some 40 bytes).
BROADCAST_ROWS = 200_000
#: A word is a run of ASCII letters and digits and of all characters beyond ASCII.
NON_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SEPARATORS = "".join(c for c in map(chr, range(128)) if not c.isalnum())


#: Folders written while a `released` block runs, the innermost block last.
_written: list[list[str]] = []


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """`df` written to the shared folder and read again: each row is computed once, and a lost executor costs
    a read instead of the work before it."""
    path = shared_dir(df.sparkSession, purpose)
    for block in _written[-1:]:
        block.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def released(spark):
    """Removes what `stored` writes inside the block when it ends; its results must have been written elsewhere by then.

    Yields the list of folders to remove, to which others may be added or from which one may be taken."""
    _written.append([])
    try:
        yield _written[-1]
    finally:
        for path in _written.pop():
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def broadcast_if_small(df: DataFrame) -> DataFrame:
    """`df` with a broadcast hint if a count proves that it has at most `BROADCAST_ROWS` rows, all of them narrow;
    larger tables are left to a shuffle. A stored table is counted from its footers."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def pieces(batch, rows: int = 512):
    """An Arrow batch or array in runs of a few rows, so that few texts are Python objects at a time."""
    for at in range(0, len(batch), rows):
        yield batch.slice(at, rows)


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case; other letters stay, unlike under `lower`."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def words(text: Column) -> Column:
    """The words of a text in order; null has none."""
    inner = F.btrim(ascii_lower(text_or_empty(text)), F.lit(SEPARATORS))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, NON_WORD))
