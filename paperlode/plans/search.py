"""Substring search in a stored index, joins by distance, and names of a dictionary in texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperlode.functions.dictionary import Dictionary
from paperlode.operators import gram_index as G
from paperlode.operators import nearby as N
from paperlode.plans.registry import Tables, query
from paperlode.session import shared_dir
from paperlode.sources.tables import version_of

_PATHS: dict[tuple, str] = {}


def gram_index(t: Tables) -> str:
    """The folder of the index over `documents`; built once in a session for each state of the table's files."""
    key = (t.spark.sparkContext.applicationId, version_of(t.documents))
    if key not in _PATHS:
        path = shared_dir(t.spark, "gram-index")
        G.write_gram_index(t.documents, "doc_id", "text", path)
        _PATHS[key] = path
    return _PATHS[key]


@query(r"SELECT doc_id, source FROM documents WHERE text LIKE '%icensed un_er%version%'")
def like_by_index(t: Tables) -> DataFrame:
    """A pattern of two stretches and a wildcard between; only texts with its rarest windows are read."""
    return G.search_like(t.documents, gram_index(t), "doc_id", "text", "%icensed un_er%version%").select("doc_id", "source")


@query("SELECT doc_id, source FROM documents WHERE text LIKE '%Qu%'")
def like_of_two_characters(t: Tables) -> DataFrame:
    """A pattern without any window of three characters."""
    return G.search_like(t.documents, gram_index(t), "doc_id", "text", "%Qu%").select("doc_id", "source")


def _place(key: Column, seed: int) -> list[Column]:
    """A place made from a key, near the poles and the date line too; the tables have no places."""
    return [((key * (37 + seed)) % 1801 / 10 - 90).alias("lat"), ((key * (101 + seed)) % 3601 / 10 - 180).alias("lng")]


_PLACE_SQL = "({0} * {1}) % 1801 / 10.0::DOUBLE - 90 AS {3}lat, ({0} * {2}) % 3601 / 10.0::DOUBLE - 180 AS {3}lng"


@query(f"""
WITH c AS (SELECT c_custkey, {_PLACE_SQL.format("c_custkey", 37, 101, "a")} FROM customer),
s AS (SELECT s_suppkey, {_PLACE_SQL.format("s_suppkey", 48, 112, "b")} FROM supplier),
d AS (SELECT c_custkey, s_suppkey, 2 * 6371008.8::DOUBLE * asin(sqrt(least(1.0, sin(radians(blat - alat) / 2) ** 2
  + cos(radians(alat)) * cos(radians(blat)) * sin(radians(blng - alng) / 2) ** 2))) AS metres FROM c, s)
SELECT c_custkey, s_suppkey, round(metres, 1) AS metres FROM d WHERE metres <= 400000""")
def customers_near_suppliers(t: Tables) -> DataFrame:
    """All pairs at most 400 km apart."""
    customers = t.customer.select("c_custkey", *_place(F.col("c_custkey"), 0))
    suppliers = t.supplier.select("s_suppkey", *_place(F.col("s_suppkey"), 11))
    found = N.within_distance(suppliers, customers, "s_suppkey", "c_custkey", ("lat", "lng"), ("lat", "lng"), 400_000)
    return found.select("c_custkey", "s_suppkey", F.round("metres", 1).alias("metres"))




@query("""
WITH names(name) AS (SELECT DISTINCT r_name FROM region UNION SELECT DISTINCT n_name FROM nation),
t AS (SELECT c_custkey, c_name || ' of ' || n_name || ' (' || r_name || '), not of x' || n_name || ' or ' || n_name || '_' AS text, n_name, r_name, c_name
  FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey)
SELECT c_custkey, (length(c_name) + 4)::INTEGER AS first_start, n_name || ',' || r_name AS found FROM t""")
def names_of_dictionary(t: Tables) -> DataFrame:
    """The nations and regions that a line about each customer names, but not where they are parts of other words."""
    names = t.nation.select(F.col("n_name").alias("name")).unionByName(t.region.select(F.col("r_name").alias("name")))
    customer, nation, region = t.customer, t.nation, t.region
    joined = customer.join(nation, customer.c_nationkey == nation.n_nationkey).join(region, nation.n_regionkey == region.r_regionkey)
    text = F.concat("c_name", F.lit(" of "), "n_name", F.lit(" ("), "r_name", F.lit("), not of x"), "n_name", F.lit(" or "), "n_name", F.lit("_"))
    found = joined.select("c_custkey", Dictionary(t.spark, names, "name").spans(text).alias("s"))
    return found.select("c_custkey", F.get("s", F.lit(0))["start"].alias("first_start"), F.array_join(F.transform("s", lambda x: x["name"]), ",").alias("found"))
