"""Hash chains that a stream continues: one chain for each key, its tip kept as state from batch to batch."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from paperlode.operators.integrity import GENESIS

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _append(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Links the new rows of a key to the tip of its chain, in their order."""
    seq, last, tip = state.get if state.exists else (0, None, GENESIS)
    new = sorted(row for part in rows for row in zip(part["order_"].tolist(), part["payload_"].tolist()))
    chain = []
    for order, payload in new:
        if last is not None and order <= last:
            continue  # in the chain already
        digest = hashlib.sha256((tip + payload).encode()).hexdigest()
        seq, last = seq + 1, order
        chain.append((order, seq, tip, digest))
        tip = digest
    if chain:
        state.update((seq, last, tip))
        order, place, prev, digest = map(list, zip(*chain))
        yield pd.DataFrame({"key_": key[0], "order_": order, "seq": place, "prev_hash": prev, "hash": digest})


def continued_chains(stream: DataFrame, key: str, order: str, payload: Column) -> DataFrame:
    """A stream of (key, order, seq, prev_hash, hash): `hash` is sha256(`prev_hash` + payload), the first link hangs on zeros.

    Inside a batch rows are linked in the order of `order`, a whole number that rises along each key. A row that does not
    lie beyond its key's last link is in the chain already, or came too late to be in it: it adds nothing. So a batch that is
    sent again changes no chain. Rows with a null key or order, or without a payload, are not linked. State is one small
    row for each key. A chain is a sequence by its nature: the rows that one batch has of one key are linked in one task.
    """
    key_type, order_type = (stream.schema[c].dataType.simpleString() for c in (key, order))
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    rows = stream.select(F.col(key).alias("key_"), F.col(order).alias("order_"), payload.alias("payload_")).dropna()
    chained = rows.groupBy("key_").applyInPandasWithState(
        _append,
        outputStructType=f"key_ {key_type}, order_ {order_type}, seq bigint, prev_hash string, hash string",
        stateStructType="seq bigint, last bigint, hash string",
        outputMode="append",
        timeoutConf=GroupStateTimeout.NoTimeout,
    )
    return chained.withColumnsRenamed({"key_": key, "order_": order})
