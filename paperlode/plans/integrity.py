"""Digests, links, trees and copies over events and documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from paperlode.functions.hashing import canonical_json, row_payload, sha256_hex
from paperlode.functions.text import name_key
from paperlode.functions.times import epoch_micros
from paperlode.operators import documents as D
from paperlode.operators import integrity as I
from paperlode.operators.ordered import order_splits
from paperlode.plans.registry import Tables, query
from paperlode.session import shared_dir
from paperlode.sources.tables import SCHEMAS
from paperlode.streaming.chains import continued_chains
from paperlode.streaming.ingest import run_to_table


def _payload() -> Column:
    return row_payload(
        F.col("event_id"), F.col("user_id"), F.col("event_type"), epoch_micros(F.col("ts")), F.col("props")
    )


def _payload_sql(*columns: str) -> str:
    return " || ".join(f"coalesce(length({c})::VARCHAR || ':' || {c}, '-')" for c in columns)


_PAYLOAD_SQL = _payload_sql("event_id::VARCHAR", "user_id::VARCHAR", "event_type", "epoch_us(ts)::VARCHAR", "props")

_LINKED_SQL = f"""
hashed AS (SELECT *, sha256({_PAYLOAD_SQL}) AS row_hash FROM events),
pointed AS (SELECT *, coalesce(lag(row_hash) OVER (ORDER BY event_id), repeat('0', 64)) AS prev_hash FROM hashed),
linked AS (SELECT *, sha256(prev_hash || row_hash) AS link_hash FROM pointed)"""


@query(f"WITH {_LINKED_SQL} SELECT event_id, row_hash, prev_hash, link_hash FROM linked")
def link_events(t: Tables) -> DataFrame:
    linked = I.link_rows(t.events, "event_id", _payload())
    return linked.select("event_id", "row_hash", "prev_hash", "link_hash")


@query(f"""
WITH {_LINKED_SQL},
altered AS (SELECT event_id, user_id, event_type, ts, prev_hash,
              CASE WHEN NOT (event_type = 'view' AND value < 5) THEN row_hash END AS row_hash,
              CASE WHEN NOT (event_type = 'view' AND value < 2) THEN link_hash END AS link_hash,
              CASE WHEN event_type = 'error' AND value < 5 THEN '' ELSE props END AS props
            FROM linked WHERE NOT (event_type = 'signup' AND value < 5))
SELECT event_id, coalesce(row_hash = sha256({_PAYLOAD_SQL}), false) AS content_ok,
  coalesce(link_hash = sha256(prev_hash || row_hash), false) AS link_ok,
  prev_hash = coalesce(lag(row_hash) OVER (ORDER BY event_id), repeat('0', 64)) AS pointer_ok
FROM altered""")
def verify_altered_log(t: Tables) -> DataFrame:
    """Link all events, then change some rows, delete others and erase hashes; verification must find all."""
    splits = order_splits(t.events, F.col("event_id"))
    linked = I.link_rows(t.events, "event_id", _payload(), splits)
    deleted = (F.col("event_type") == "signup") & (F.col("value") < 5)
    changed = (F.col("event_type") == "error") & (F.col("value") < 5)
    altered = linked.where(~deleted).withColumn("props", F.when(changed, "").otherwise(F.col("props")))
    for name, below in (("row_hash", 5), ("link_hash", 2)):
        erased = (F.col("event_type") == "view") & (F.col("value") < below)
        altered = altered.withColumn(name, F.when(~erased, F.col(name)))
    return I.verify_links(altered, "event_id", _payload(), splits).select(
        "event_id", "content_ok", "link_ok", "pointer_ok"
    )


_CHAIN_SQL = f"""
e AS (SELECT *, {_PAYLOAD_SQL} AS payload, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS seq FROM events WHERE user_id IS NOT NULL),
chain AS (SELECT user_id, event_id, seq, repeat('0', 64) AS prev_hash, sha256(repeat('0', 64) || payload) AS hash FROM e WHERE seq = 1
  UNION ALL SELECT e.user_id, e.event_id, e.seq, c.hash, sha256(c.hash || e.payload) FROM chain c JOIN e ON e.user_id = c.user_id AND e.seq = c.seq + 1)"""


def _chained(t: Tables) -> DataFrame:
    """The chains of all users, continued over four batches of files, of which one is sent twice."""
    path = shared_dir(t.spark, "chains")
    third = F.floor(F.percent_rank().over(W.orderBy("first")) * 2.999)
    # batches are cut by ranges of the id, from one row for each thousand ids
    ranges = t.events.groupBy(F.floor(F.col("event_id") / 1000).alias("part")).agg(F.min("event_id").alias("first"))
    ranges = F.broadcast(ranges.select("part", third.alias("batch")))
    split = t.events.withColumn("part", F.floor(F.col("event_id") / 1000)).join(ranges, "part").drop("part")
    split.hint("rebalance", "batch").write.partitionBy("batch").parquet(f"{path}/split")
    batches = t.spark.read.schema(f"{SCHEMAS['events']}, batch int").parquet(f"{path}/split")
    for batch in (0, 1, 1, 2):
        batches.where(F.col("batch") == batch).drop("batch").write.mode("append").parquet(f"{path}/arrived")
        stream = t.spark.readStream.schema(SCHEMAS["events"]).parquet(f"{path}/arrived")
        run_to_table(continued_chains(stream, "user_id", "event_id", _payload()), f"{path}/chain").awaitTermination()
    return t.spark.read.schema("user_id bigint, event_id bigint, seq bigint, prev_hash string, hash string").parquet(f"{path}/chain/data")


@query(f"WITH RECURSIVE {_CHAIN_SQL} SELECT user_id, event_id, seq, prev_hash, hash FROM chain")
def chained_events(t: Tables) -> DataFrame:
    """A chain for each user, appended to by a stream; what is sent again adds nothing."""
    return _chained(t)


@query(f"""
WITH RECURSIVE {_CHAIN_SQL},
altered AS (SELECT c.user_id, c.event_id, event_type, ts, c.prev_hash, c.hash, CASE WHEN event_type = 'error' AND value < 5 THEN '' ELSE props END AS props
  FROM chain c JOIN e USING (event_id) WHERE NOT (event_type = 'signup' AND value < 5))
SELECT user_id, event_id, coalesce(hash = sha256(prev_hash || {_PAYLOAD_SQL}), false) AS content_ok,
  prev_hash = coalesce(lag(hash) OVER (PARTITION BY user_id ORDER BY event_id), repeat('0', 64)) AS pointer_ok
FROM altered""")
def verify_chained_events(t: Tables) -> DataFrame:
    """The chains of all users after some rows were changed and others deleted."""
    log = _chained(t).select("event_id", "prev_hash", "hash").join(t.events, "event_id")
    deleted = (F.col("event_type") == "signup") & (F.col("value") < 5)
    changed = (F.col("event_type") == "error") & (F.col("value") < 5)
    altered = log.where(~deleted).withColumn("props", F.when(changed, "").otherwise(F.col("props")))
    checked = I.verify_chain(altered, "event_id", _payload(), keys=["user_id"])
    return checked.select("user_id", "event_id", "content_ok", "pointer_ok")


@query(rf"""
WITH RECURSIVE leaves AS (SELECT list(sha256('\x00'::BLOB || encode({_PAYLOAD_SQL})) ORDER BY event_id) AS hs FROM events),
r AS (SELECT hs FROM leaves UNION ALL
  SELECT list_transform(range(0, (len(hs) + 1) // 2), lambda i: CASE WHEN 2 * i + 2 <= len(hs)
    THEN sha256('\x01'::BLOB || unhex(hs[2 * i + 1]) || unhex(hs[2 * i + 2])) ELSE hs[2 * i + 1] END)
  FROM r WHERE len(hs) > 1)
SELECT hs[1] AS root_hash FROM r WHERE len(hs) = 1""")
def merkle_root(t: Tables) -> DataFrame:
    return I.merkle_root(I.merkle_leaves(t.events, "event_id", _payload()), t.events.count())


_CHUNK = 256


@query(f"""
WITH b AS (SELECT doc_id, hex(encode(text)) AS h FROM documents WHERE text <> ''),
c AS (SELECT doc_id, h, unnest(range(0, (length(h) // 2 + {_CHUNK - 1}) // {_CHUNK})) AS i FROM b)
SELECT doc_id, doc_id || '-' || lpad(i::VARCHAR, 6, '0') AS chunk_id, i::INT AS chunk_no, (i * {_CHUNK})::BIGINT AS byte_offset,
  (length(substring(h, i * {2 * _CHUNK} + 1, {2 * _CHUNK})) // 2)::INT AS byte_size,
  sha256(unhex(substring(h, i * {2 * _CHUNK} + 1, {2 * _CHUNK}))) AS chunk_hash FROM c""")
def byte_chunks(t: Tables) -> DataFrame:
    return D.byte_chunks(t.documents, "doc_id", "text", _CHUNK)


@query("""
SELECT sha256(text) AS content_hash, min(doc_id) AS first_id, count(*) AS n_copies FROM documents GROUP BY 1""")
def content_groups(t: Tables) -> DataFrame:
    return I.content_groups(t.documents, "doc_id", F.col("text"))


@query("""
SELECT sha256(regexp_replace(regexp_replace(lower(text), '[^a-z0-9 ]+', ' ', 'g'), ' +', ' ', 'g')) AS content_hash,
  min(doc_id) AS first_id, count(*) AS n_copies FROM documents GROUP BY 1 HAVING count(*) > 1""")
def repeated_after_normalising(t: Tables) -> DataFrame:
    return I.repeated_groups(t.documents, "doc_id", name_key(F.col("text")))


@query("""
WITH stored AS (SELECT DISTINCT sha256(text) AS h FROM documents WHERE doc_id IN (SELECT doc_id FROM labels))
SELECT sha256(text) AS content_hash, min(doc_id) AS first_id, count(*) AS n_copies FROM documents
WHERE sha256(text) NOT IN (SELECT h FROM stored) GROUP BY 1""")
def new_content(t: Tables) -> DataFrame:
    """Labelled documents count as stored already; all documents arrive."""
    stored = t.documents.join(t.labels.select("doc_id").distinct(), "doc_id", "left_semi")
    return I.new_content(t.documents, stored, "doc_id", F.col("text"))


@query("""SELECT event_id, replace(props, ' ', '') AS canonical, sha256(replace(props, ' ', '')) AS canonical_hash FROM events""")
def canonical_props(t: Tables) -> DataFrame:
    shaped = t.events.select("event_id", canonical_json(F.col("props")).alias("canonical"))
    return shaped.withColumn("canonical_hash", sha256_hex(F.col("canonical")))
