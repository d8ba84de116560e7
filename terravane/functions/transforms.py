"""Scoring transforms M01-M06 as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from terravane.config import DEFAULT, Preset


def present(x: Column) -> Column:
    """x with NaN and infinities as NULL."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def exp_decay(x: Column, decay_km: float) -> Column:
    return F.when(x.isNull() | F.isnan(x), 0.0).otherwise(F.exp(-x / F.lit(decay_km)))


def sigmoid(x: Column, center: float, spread: float) -> Column:
    return 1.0 / (1.0 + F.exp(-(x - F.lit(center)) / F.lit(spread)))


def linear_clamp(x: Column, low: float, high: float, invert: bool = False) -> Column:
    r = (x - F.lit(low)) / F.lit(high - low)
    r = F.when(r < 0, 0.0).when(r > 1, 1.0).otherwise(r)
    return 1.0 - r if invert else r


def power_redundancy(near: Column, distinct: Column, p: Preset = DEFAULT) -> Column:
    w = p.secondary_weight
    return (1 - w) * exp_decay(near, p.primary_decay_km) + w * exp_decay(distinct, p.secondary_decay_km)


def latency(metro: Column, cable: Column, p: Preset = DEFAULT) -> Column:
    w = p.cable_weight
    return (1 - w) * exp_decay(metro, p.metro_decay_km) + w * exp_decay(cable, p.cable_decay_km)


def climate(temp: Column, p: Preset = DEFAULT) -> Column:
    return linear_clamp(temp, p.temp_low_c, p.temp_high_c, invert=True)


def relative_humidity(t_c: Column, dew_c: Column) -> Column:
    """Magnus formula, clamped to 0..100."""
    a, b = 17.625, 243.04
    rh = 100.0 * F.exp(a * dew_c / (b + dew_c)) / F.exp(a * t_c / (b + t_c))
    return F.least(F.greatest(rh, F.lit(0.0)), F.lit(100.0))
