"""Joins within a distance on the sphere: points with points, and points with lines.

A point is a unit vector, and space is cut into cubes as wide as the distance. Two points that are close lie in the same
cube or in neighbouring ones, so they meet by equality of cubes. A cube knows neither poles nor a date line.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperlode.functions.geo import EARTH_RADIUS_M, haversine_m
from paperlode.operators.once import computed_once
from paperlode.session import shuffle_width

AXES = ("x", "y", "z")
#: The narrowest cubes, some half a metre; smaller distances are told apart by the exact test alone.
NARROWEST = 1e-7
#: Places of each side that meet in one piece of a cube (on average; they are dealt by a hash), and pairs that a task tests.
SIDE, TASK_PAIRS = 2_048, 1 << 24


def unit_vector(lat: Column, lng: Column) -> Column:
    a, b = F.radians(lat), F.radians(lng)
    return F.struct((F.cos(a) * F.cos(b)).alias("x"), (F.cos(a) * F.sin(b)).alias("y"), F.sin(a).alias("z"))


def on_earth(lat: Column, lng: Column) -> Column:
    """Whether a place is one: both numbers there and finite, the latitude from -90 to 90."""
    return F.coalesce(lat.between(-90.0, 90.0) & (F.abs(lng) < float("inf")), F.lit(False))


def cube_width(metres: float) -> float:
    """The straight distance, in earth radii, between points `metres` apart, and a little more."""
    return max(NARROWEST, 2 * math.sin(min(metres / EARTH_RADIUS_M, math.pi) / 2) * (1 + 1e-9))


def cube(vector: Column, width: float) -> Column:
    return F.struct(*[F.floor(vector[a] / width).alias(a) for a in AXES])


def cubes_around(vector: Column, width: float) -> Column:
    """The cube of a vector and its 26 neighbours."""
    steps = [(i, j, k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)]
    own = cube(vector, width)
    return F.array(*[F.struct(*[(own[a] + F.lit(d)).alias(a) for a, d in zip(AXES, step)]) for step in steps])


def _checked(metres: float) -> float:
    if not metres >= 0:
        raise ValueError("a distance must not be negative")
    return metres


def within_distance(
    left: DataFrame, right: DataFrame, left_id: str, right_id: str, left_at: tuple[str, str], right_at: tuple[str, str], metres: float
) -> DataFrame:
    """(left id, right id, metres): all pairs of places at most `metres` apart. Ids must have different names.

    The left side is copied to the cubes around each of its points, so it should be the smaller one. Places that are null,
    not finite or beyond the poles match nothing; longitudes may run round the earth more than once. Repeated rows match
    as often as they are there. Nothing but the pairs themselves grows faster than the rows: two points that meet
    are at most four times `metres` apart. A cube of many places on both sides is cut into pieces of `SIDE` by `SIDE`, and the
    pieces go to as many tasks as the pairs to test need.
    """
    width = cube_width(_checked(metres))
    a, b = (F.col(c).cast("double") for c in left_at), (F.col(c).cast("double") for c in right_at)
    mine = left.select(F.col(left_id).alias("l__"), *[c.alias(n) for c, n in zip(a, ("a_lat", "a_lng"))]).where(on_earth(F.col("a_lat"), F.col("a_lng")))
    mine = computed_once(mine, mine.columns, {"u": unit_vector(F.col("a_lat"), F.col("a_lng"))})
    mine = mine.select("*", F.explode(cubes_around(F.col("u"), width)).alias("cube"))
    other = right.select(F.col(right_id).alias("r__"), *[c.alias(n) for c, n in zip(b, ("b_lat", "b_lng"))]).where(on_earth(F.col("b_lat"), F.col("b_lng")))
    other = computed_once(other, other.columns, {"v": unit_vector(F.col("b_lat"), F.col("b_lng"))})
    other = computed_once(other, other.columns, {"cube": cube(F.col("v"), width)})
    counts = mine.groupBy("cube").agg(F.count("*").alias("n_a")).join(other.groupBy("cube").agg(F.count("*").alias("n_b")), "cube")
    pairs = F.col("n_a").cast("double") * F.col("n_b")
    n_tasks = max(shuffle_width(left.sparkSession), math.ceil((counts.agg(F.sum(pairs)).first()[0] or 0) / TASK_PAIRS))
    # a cube that is cut has millions of pairs, so this is a small part of the cubes
    cut = counts.where(pairs > SIDE * SIDE).select("cube", *[F.ceil(F.col(n) / SIDE).alias(n) for n in ("n_a", "n_b")])

    def dealt(df: DataFrame, place: list[str], own: str, rest: str) -> DataFrame:
        """Each row in one part of its own side, beside all parts of the other."""
        known = df.join(F.broadcast(cut), "cube", "left")
        part = F.pmod(F.xxhash64(*place), F.coalesce(f"n_{own}", F.lit(1)))
        copies = F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce(f"n_{rest}", F.lit(1)) - 1)).alias(f"part_{rest}")
        return known.select(*df.columns, part.alias(f"part_{own}"), copies).repartition(n_tasks, "cube", "part_a", "part_b")

    met = dealt(mine, ["l__", "a_lat", "a_lng"], "a", "b").join(dealt(other, ["r__", "b_lat", "b_lng"], "b", "a"), ["cube", "part_a", "part_b"])
    # the straight distance, with room for rounding, rules out most pairs before the costly one
    straight = sum(((F.col("u")[x] - F.col("v")[x]) * (F.col("u")[x] - F.col("v")[x]) for x in AXES), F.lit(0.0))
    far = haversine_m(F.col("a_lat"), F.col("a_lng"), F.col("b_lat"), F.col("b_lng"))
    found = met.where((straight <= (1.01 * width + NARROWEST) ** 2) & (far <= metres))
    return found.select(F.col("l__").alias(left_id), F.col("r__").alias(right_id), far.alias("metres"))


def _dot(u: Column, v: Column) -> Column:
    return u["x"] * v["x"] + u["y"] * v["y"] + u["z"] * v["z"]


def _cross(u: Column, v: Column) -> Column:
    return F.struct(
        (u["y"] * v["z"] - u["z"] * v["y"]).alias("x"), (u["z"] * v["x"] - u["x"] * v["z"]).alias("y"), (u["x"] * v["y"] - u["y"] * v["x"]).alias("z")
    )


def _angle(u: Column, v: Column) -> Column:
    """Angle between unit vectors; exact for small ones too."""
    cross = _cross(u, v)
    return F.atan2(F.sqrt(_dot(cross, cross)), _dot(u, v))


def to_segment(p: Column, a: Column, b: Column, normal: Column) -> Column:
    """Angle from a point to the shorter arc from a to b, whose plane has this normal."""
    beside = (_dot(_cross(normal, a), p) >= 0) & (_dot(_cross(b, normal), p) >= 0)
    size = F.sqrt(_dot(normal, normal))
    across = F.asin(F.least(F.abs(_dot(normal, p)) / size, F.lit(1.0)))
    return F.when((size > 1e-15) & beside, across).otherwise(F.least(_angle(p, a), _angle(p, b)))


def near_lines(
    points: DataFrame, lines: DataFrame, point_id: str, line_id: str, point_at: tuple[str, str], line: str, metres: float
) -> DataFrame:
    """(point id, line id, metres): points at most `metres` from a line, and how far they are from its nearest part.

    `line` is an array of structs (lat, lng) joined by shortest arcs, each less than half way round the earth. A line of one
    place is that place; places that are none are left out of their line. A segment marks the cubes at
    steps of `metres` along it, so its rows grow with its length over the distance. Line ids must be unique.
    """
    reach = 1.5 * max(_checked(metres), 0.1)  # a point near the arc is so near to one of the steps
    width = cube_width(reach)
    fine = lines.select(F.col(line_id).alias("line__"), F.filter(line, lambda q: on_earth(q["lat"].cast("double"), q["lng"].cast("double"))).alias("path"))
    fine = fine.withColumn("path", F.transform("path", lambda q: unit_vector(q["lat"].cast("double"), q["lng"].cast("double"))))
    ends = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size("path") - 1, F.lit(1))),
        lambda i: F.struct(F.element_at("path", i).alias("a"), F.element_at("path", F.least(i + 1, F.size("path"))).alias("b")),
    )
    segments = fine.where(F.size("path") > 0).select("line__", F.posexplode(ends).alias("place", "s")).select("line__", "place", "s.a", "s.b")
    turn = _angle(F.col("a"), F.col("b"))
    segments = computed_once(segments, ["line__", "place", "a", "b"], {"turn": turn, "normal": _cross(F.col("a"), F.col("b"))})
    n = F.ceil(F.col("turn") * EARTH_RADIUS_M / max(metres, 0.1)).cast("int") + 1
    steps = segments.select("*", F.explode(F.sequence(F.lit(0), n)).alias("step"), n.alias("steps"))
    share = F.col("step") / F.col("steps")
    weight = lambda f: F.when(F.col("turn") > 1e-12, F.sin(f * F.col("turn")) / F.sin("turn")).otherwise(f)
    place = F.struct(*[(F.col("a")[c] * weight(1 - share) + F.col("b")[c] * weight(share)).alias(c) for c in AXES])
    marked = steps.select("line__", "place", "a", "b", "normal", cube(place, width).alias("cube")).distinct()
    asked = points.select(F.col(point_id).alias("point__"), *[F.col(c).cast("double").alias(name) for c, name in zip(point_at, ("lat", "lng"))])
    asked = computed_once(asked.where(on_earth(F.col("lat"), F.col("lng"))), ["point__"], {"p": unit_vector(F.col("lat"), F.col("lng"))})
    asked = asked.withColumn("point_row", F.monotonically_increasing_id()).select("*", F.explode(cubes_around(F.col("p"), width)).alias("cube"))
    far = to_segment(F.col("p"), F.col("a"), F.col("b"), F.col("normal")) * EARTH_RADIUS_M
    met = asked.join(marked, "cube").groupBy("point__", "point_row", "line__").agg(F.min(far).alias("metres"))
    return met.where(F.col("metres") <= metres).select(F.col("point__").alias(point_id), F.col("line__").alias(line_id), "metres")
