"""Finding the names of a large dictionary in texts: one automaton (Aho and Corasick 1975) for all of them."""

from __future__ import annotations

import pickle
import uuid

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: An automaton goes to every executor, so no more names are put into one; a larger dictionary is cut into several.
NAMES_PER_AUTOMATON = 250_000

_built: dict[str, ahocorasick.Automaton] = {}


def _word(ch: str) -> bool:
    return ch == "_" or ch.isalnum()


def name_spans(automaton: ahocorasick.Automaton, text: str) -> list[tuple[int, int]]:
    """All (start, end) of names that no word runs into."""
    out = []
    for last, size in automaton.iter(text):
        start, end = last - size + 1, last + 1
        inner = _word(text[start]) and start > 0 and _word(text[start - 1])
        if not inner and not (_word(text[end - 1]) and end < len(text) and _word(text[end])):
            out.append((start, end))
    return out


def leftmost_longest(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    taken, reached = [], 0
    for start, end in sorted(set(spans), key=lambda s: (s[0], -s[1])):
        if start >= reached:
            taken.append((start, end))
            reached = end
    return taken


class Dictionary:
    """Names, as automata that tasks unpack once in each worker."""

    def __init__(self, spark: SparkSession, names: DataFrame, name: str) -> None:
        chosen = names.where(F.length(name) > 0).select(F.col(name).alias("name")).distinct()
        shards = max(1, -(-chosen.count() // NAMES_PER_AUTOMATON))
        self.parts = []
        for shard in range(shards):
            automaton = ahocorasick.Automaton()
            part = chosen.where(F.pmod(F.xxhash64("name"), F.lit(shards)) == shard)
            for row in part.toLocalIterator():
                automaton.add_word(row.name, len(row.name))
            if len(automaton):
                automaton.make_automaton()
                self.parts.append((uuid.uuid4().hex, spark.sparkContext.broadcast(pickle.dumps(automaton))))

    def spans(self, text: Column) -> Column:
        """(start, end, name) of the names in a text, in code points from 0, end exclusive: of names that overlap the leftmost
        is taken, of those that start together the longest. A name counts where its own first and last character
        do not go on into a word. A null text has none."""
        parts = self.parts

        @F.arrow_udf(T.ArrayType(T.StructType.fromDDL("start int, end int, name string")))
        def run(batch: pa.Array) -> pa.Array:
            automata = []
            for key, part in parts:
                if key not in _built:
                    _built[key] = pickle.loads(part.value)
                automata.append(_built[key])
            found = []
            for text in batch.to_pylist():
                spans = leftmost_longest([s for a in automata for s in name_spans(a, text)]) if text else []
                found.append([{"start": a, "end": b, "name": text[a:b]} for a, b in spans])
            kind = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("name", pa.string())])
            return pa.array(found, pa.list_(kind))

        return run(text)
