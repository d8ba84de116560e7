"""Weighted suitability scores (M07), exclusion mask and reasons (P01-P03), merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terravane.config import DEFAULT, FILL, REASONS, Exclusions, Preset
from terravane.functions import transforms as t

SUBS = ["sub_power", "sub_water", "sub_conn", "sub_solar", "sub_clim", "sub_lat"]


def score(features: DataFrame, preset: Preset = DEFAULT, fill: bool = True) -> DataFrame:
    """``features`` plus six sub-scores and the score, in one projection."""
    c = (lambda n: F.coalesce(t.present(F.col(n)), F.lit(FILL[n]))) if fill else F.col
    w = preset.weights()
    subs = {
        "sub_power": t.power_redundancy(c("nearest_hv_line_km"), c("nearest_hv_line_distinct_subgrid_km"), preset),
        "sub_water": t.exp_decay(c("nearest_water_km"), preset.water_decay_km),
        "sub_conn": t.exp_decay(c("nearest_highway_km"), preset.highway_decay_km),
        "sub_solar": t.sigmoid(c("annual_pvout_kwh_per_kwp"), preset.pvout_center, preset.pvout_spread),
        "sub_clim": t.climate(c("mean_temp_c"), preset),
        "sub_lat": t.latency(c("nearest_metro_km"), c("nearest_cable_landing_km"), preset),
    }
    total = sum((F.lit(w[k]) * F.col(s) for k, s in zip(w, SUBS)), F.lit(0.0))
    return features.withColumns(subs).withColumn("score", F.least(F.lit(1.0), F.greatest(F.lit(0.0), total)))


def _over(name: str, limit: float) -> Column:
    return F.coalesce(t.present(F.col(name)) > limit, F.lit(False))


def rules(e: Exclusions) -> list[tuple[str, Column]]:
    tests = [
        F.coalesce(F.col("in_zone_v"), F.lit(False)),
        _over("flood_pct", e.flood_pct),
        _over("slope_deg", e.slope_deg),
        _over("urban_pct", e.urban_pct),
        _over("forest_pct", e.forest_pct),
        _over("wetland_pct", e.wetland_pct),
        _over("water_pct", e.water_pct),
        F.coalesce(F.col("in_protected"), F.lit(False)),
    ]
    return list(zip(REASONS, tests))


def exclusion_mask(cells: DataFrame, e: Exclusions | None = None) -> DataFrame:
    """``cells`` with is_excluded and exclusion_reasons, in the vocabulary's order."""
    found = rules(e or Exclusions())
    reasons = F.array_compact(F.array(*(F.when(test, F.lit(name)) for name, test in found)))
    return cells.withColumn("exclusion_reasons", reasons).withColumn("is_excluded", F.size("exclusion_reasons") > 0)


def join_layers(cells: DataFrame, layers: dict[str, DataFrame], resolution: int, key: str = "cell_id") -> DataFrame:
    """Left-join zonal layers of one resolution."""
    for layer in layers.values():
        own = layer.filter(F.col("resolution") == resolution).drop("resolution") if "resolution" in layer.columns else layer
        cells = cells.join(own, key, "left")
    return cells


def merge_together(features: DataFrame, layers: list[DataFrame], key: str = "cell_id") -> DataFrame:
    """The layers' columns where all layers have the key, NULL elsewhere."""
    inner = layers[0]
    for layer in layers[1:]:
        inner = inner.join(layer, key)
    return features.join(inner, key, "left")


def fill_from(features: DataFrame, new: DataFrame, columns: list[str], key: str = "cell_id") -> DataFrame:
    """Columns take the new value, or keep the old one if the new is NULL or missing."""
    fresh = new.select(key, *(F.col(c).alias(f"_new_{c}") for c in columns))
    out = features.join(fresh, key, "left")
    return out.withColumns({c: F.coalesce(f"_new_{c}", c) for c in columns}).drop(*(f"_new_{c}" for c in columns))
