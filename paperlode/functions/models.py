"""Plug points for models that Spark does not bring: embedders and rerankers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def model_column(load: Callable[[], Callable], result_type: str) -> Callable[..., Column]:
    """A column function backed by a model.

    `load` runs once per Python worker task and returns a function from one pandas Series per input
    column to a Series or list of results; it then sees one Arrow batch at a time.
    """

    @F.pandas_udf(result_type)
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        model = load()
        for batch in batches:
            # Spark passes a bare Series, not a tuple, when there is one input column.
            yield pd.Series(model(*batch) if isinstance(batch, tuple) else model(batch))

    return run


def pair_reranker(load: Callable[[], Callable], query: str) -> Callable[[Column], Column]:
    """Reranker for `hybrid_search` from a model that scores (query, text) pairs."""
    score = model_column(load, "double")
    return lambda text: score(F.lit(query), text)
