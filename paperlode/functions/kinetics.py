"""Plausibility of a measured level under the textbook one-compartment model with first-order elimination."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def expected_level(dose: Column, volume_per_kg: Column, weight_kg: Column, half_life: Column, elapsed: Column) -> Column:
    """Dose over volume of distribution, halved every half-life; null unless volume, weight and half-life are positive.

    The result has the unit of `dose` per unit of `volume_per_kg`.
    """
    usable = (volume_per_kg > 0) & (weight_kg > 0) & (half_life > 0)
    return F.when(usable, dose / (volume_per_kg * weight_kg) * F.exp(-math.log(2) * elapsed / half_life))


def level_ratio(measured: Column, expected: Column, low: float, high: float) -> Column:
    """Struct of the ratio measured / expected and whether it lies in [low, high]; both null without usable inputs."""
    ratio = F.when(expected > 0, measured / expected)
    return F.struct(ratio.alias("ratio"), ratio.between(low, high).alias("in_range"))
