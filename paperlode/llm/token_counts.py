"""Token counts of byte-pair encodings without making tokens.

A piece of text starts as a linked list of byte symbols. A heap holds the adjacent pairs that the vocabulary can
merge; the pair of the lowest rank is popped and its two symbols become one, until no pair is left. Each merge
takes one symbol away, so the count is the initial symbols minus the merges and no identifier is ever emitted.
"""

from __future__ import annotations

import heapq
import json
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperlode.llm.common import pieces, text_or_empty

#: How byte-level vocabularies of this family cut a text into pieces before merging (fixed value).
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces up to this length are remembered, and so many of them; longer ones are rare and counted each time.
REMEMBERED_CHARS, REMEMBERED = 64, 300_000


def byte_symbols() -> dict[str, int]:
    """The byte that each printable stand-in of a byte-level vocabulary file means: bytes that print stand for
    themselves, the others follow from U+0100 on in order."""
    printing = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printing)]
    return {chr(b): b for b in printing} | {chr(0x100 + i): b for i, b in enumerate(others)}


class MergeCounter:
    """Counts the tokens of texts under the merges of one vocabulary."""

    def __init__(self, definition: str) -> None:
        spec = json.loads(definition)
        model, stand_ins = spec["model"], byte_symbols()
        ids = {token: i for i, token in enumerate(model["vocab"])}
        self.base = {stand_ins[t]: i for t, i in ids.items() if len(t) == 1 and t in stand_ins}
        self.ranks: dict[int, int] = {}  # of a pair, packed into one number
        self.made: list[int] = []  # the symbol that the merge of a rank makes
        for rank, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            self.ranks[ids[a] << 32 | ids[b]] = rank
            self.made.append(ids[a + b])
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.pieces = regex.compile(PIECES)
        self.known: dict[str, int] = {}

    def piece(self, data: bytes) -> int:
        """Tokens of one piece."""
        symbol = list(map(self.base.__getitem__, data))
        n, rank_of, made = len(symbol), self.ranks.get, self.made
        # an entry of the heap is the rank of a pair, then the place of its left symbol
        heap = []
        for i in range(n - 1):
            rank = rank_of(symbol[i] << 32 | symbol[i + 1])
            if rank is not None:
                heap.append(rank << 32 | i)
        if not heap:
            return n
        heapq.heapify(heap)
        after, before = [*range(1, n), -1], list(range(-1, n - 1))
        merged = 0
        while heap:
            entry = heapq.heappop(heap)
            i, rank = entry & 0xFFFFFFFF, entry >> 32
            left = symbol[i]
            j = after[i]
            if left < 0 or j < 0 or rank_of(left << 32 | symbol[j]) != rank:
                continue  # one of the two went into another merge meanwhile
            symbol[i], symbol[j] = made[rank], -1
            right = after[i] = after[j]
            merged += 1
            if right >= 0:
                before[right] = i
                rank = rank_of(symbol[i] << 32 | symbol[right])
                if rank is not None:
                    heapq.heappush(heap, rank << 32 | i)
            left = before[i]
            if left >= 0:
                rank = rank_of(symbol[left] << 32 | symbol[i])
                if rank is not None:
                    heapq.heappush(heap, rank << 32 | left)
        return n - merged

    def _remembered(self, piece: str) -> int:
        n = self.known.get(piece)
        if n is None:
            n = self.piece(piece.encode())
            if len(piece) <= REMEMBERED_CHARS:
                if len(self.known) >= REMEMBERED:
                    self.known.clear()
                self.known[piece] = n
        return n

    def text(self, text: str) -> int:
        """Tokens of a text; the special strings of the vocabulary are one token each wherever they stand."""
        parts, specials = [text], 0
        if self.special and self.special.search(text):
            parts = self.special.split(text)
            specials = len(parts) - 1
        total = specials
        for part in parts:
            for piece, times in Counter(self.pieces.findall(part)).items():
                total += times * self._remembered(piece)
        return total


def token_counts(docs: DataFrame, definition: str, id_col: str = "doc_id", text_col: str = "text",
                 limit: int = 512) -> DataFrame:
    """One row per input row: doc_id, n_bytes (UTF-8), n_tokens, over_limit (more than `limit` tokens).

    `definition` is the content of a byte-level BPE file, whose size does not depend on the data; it goes to
    the tasks as one broadcast. A null text is empty and has 0 tokens; repeated rows give repeated results,
    a missing id stays null. Nothing is shuffled, and a text of any length is counted whole.
    """
    shared = docs.sparkSession.sparkContext.broadcast(definition)

    @F.arrow_udf(T.LongType())
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counter = MergeCounter(shared.value)  # local to the task, so that its memory goes with it
        for text in batches:
            yield pa.array([counter.text(t) for part in pieces(text) for t in part.to_pylist()], pa.int64())

    text = text_or_empty(F.col(text_col))
    counted = docs.select(F.col(id_col).alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"),
                          count(text).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def read_definition(spark: SparkSession, path: str) -> str:
    """A vocabulary file through Spark's own readers, from any store."""
    return spark.read.text(path, wholetext=True).first().value
