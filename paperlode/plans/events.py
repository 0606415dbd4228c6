"""Ordered and time-based queries over events, and the event stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperlode.functions.times import epoch_micros
from paperlode.operators import joins as J
from paperlode.operators import ordered as O
from paperlode.plans.registry import Tables, query
from paperlode.streaming.ingest import ingest_once


@query("""
WITH p AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY event_id) AS prev FROM events)
SELECT user_id, count(*) AS n_rows, count(*) FILTER (WHERE ts < prev) AS n_backward FROM p GROUP BY user_id""")
def backward_timestamps(t: Tables) -> DataFrame:
    return O.backward_steps(t.events, ["user_id"], "event_id", "ts")


@query("""
WITH o AS (SELECT o_orderkey, o_custkey, o_orderdate, lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS prev
           FROM orders)
SELECT o_custkey, count(*) AS n_rows, count(*) FILTER (WHERE o_orderdate < prev) AS n_backward FROM o GROUP BY o_custkey""")
def backward_order_dates(t: Tables) -> DataFrame:
    return O.backward_steps(t.orders, ["o_custkey"], "o_orderkey", "o_orderdate")


@query("""
SELECT event_id, user_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS)
  OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_purchase_id
FROM events""")
def carried_purchase(t: Tables) -> DataFrame:
    events = t.events.select("event_id", "user_id", "event_type", epoch_micros(F.col("ts")).alias("at"))
    carried = O.carry_forward(
        events,
        ["user_id"],
        F.col("at"),
        [F.col("at"), F.col("event_id")],
        F.when(F.col("event_type") == "purchase", F.col("event_id")),
        "last_purchase_id",
        then=F.col("event_id"),
    )
    return carried.select("event_id", "user_id", "last_purchase_id")


@query("""SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS position FROM events""")
def dense_numbering(t: Tables) -> DataFrame:
    return O.dense_positions(t.events.select("event_id"), "event_id", "position")


@query("""
WITH m AS (
  SELECT p.event_id, p.user_id, c.event_id AS matched_id, epoch_us(p.ts) - epoch_us(c.ts) AS matched_delta_us,
    row_number() OVER (PARTITION BY p.event_id ORDER BY c.ts DESC NULLS LAST, c.event_id DESC) AS rn
  FROM (SELECT * FROM events WHERE event_type = 'purchase') p
  LEFT JOIN (SELECT * FROM events WHERE event_type = 'click') c
    ON c.user_id = p.user_id AND c.ts <= p.ts AND epoch_us(p.ts) - epoch_us(c.ts) <= 21600000000)
SELECT event_id, user_id, matched_id, matched_delta_us FROM m WHERE rn = 1""")
def purchase_after_click(t: Tables) -> DataFrame:
    """Each purchase with the user's latest click in the six hours before it."""
    events = t.events.select("event_id", "user_id", "ts", "event_type")
    linked = J.latest_within(
        events.where("event_type = 'purchase'"),
        events.where("event_type = 'click'"),
        ["user_id"],
        "ts",
        "event_id",
        within_s=6 * 3600,
    )
    return linked.select("event_id", "user_id", "matched_id", "matched_delta_us")


@query("""SELECT event_id, user_id, event_type FROM events WHERE json_extract_string(props, '$.k') = '7'""")
def json_filter(t: Tables) -> DataFrame:
    return t.events.where(F.get_json_object("props", "$.k") == "7").select("event_id", "user_id", "event_type")


@query("""SELECT event_id, user_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 20""")
def latest_events(t: Tables) -> DataFrame:
    return t.events.orderBy(F.desc("ts"), F.desc("event_id")).limit(20).select("event_id", "user_id", "event_type")


@query("""
SELECT user_id, min_by(event_id, ts) AS first_event_id, min_by(event_type, ts) AS first_event_type FROM events GROUP BY user_id""")
def earliest_event(t: Tables) -> DataFrame:
    first = F.min_by(F.struct("event_id", "event_type"), F.struct("ts", "event_id"))
    return t.events.groupBy("user_id").agg(first.alias("e")).select(
        "user_id", F.col("e.event_id").alias("first_event_id"), F.col("e.event_type").alias("first_event_type")
    )


@query("""
SELECT event_id, user_id, event_type, round(value, 4) AS value FROM events QUALIFY row_number() OVER (PARTITION BY event_id) = 1""")
def streamed_events(t: Tables) -> DataFrame:
    """All events through the stream that stores each id once."""
    stored = ingest_once(t.spark, t.base, "events", "event_id")
    return stored.select("event_id", "user_id", "event_type", F.round("value", 4).alias("value"))
