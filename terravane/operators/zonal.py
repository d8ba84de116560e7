"""Zonal statistics of pixels per cell (S09, Z1-Z7): one aggregation each, then a left join from the cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terravane.functions import hexgrid
from terravane.functions.transforms import present, relative_humidity

# fixed values: class codes of the land-cover map
LANDCOVER = {"forest_pct": [10, 95], "cropland_pct": [40], "urban_pct": [50], "water_pct": [80], "bareland_pct": [60], "wetland_pct": [90]}


def assign_pixels(pixels: DataFrame, resolution: int) -> DataFrame:
    """``pixels`` (lon, lat, ...) with the cell_id of the grid cell that holds each."""
    return pixels.withColumn("cell_id", hexgrid.cell_at(F.col("lon"), F.col("lat"), resolution))


def zonal(cells: DataFrame, pixels: DataFrame, **stats: Column) -> DataFrame:
    """Every cell with the given aggregates of its pixels; NULL for cells without pixels."""
    return cells.select("cell_id").join(pixels.groupBy("cell_id").agg(*(c.alias(k) for k, c in stats.items())), "cell_id", "left")


def _clip(c: Column) -> Column:
    return F.greatest(F.least(c, F.lit(100.0)), F.lit(0.0))


def seismic(cells: DataFrame, pixels: DataFrame, value: str = "value", zone_v: float = 0.36) -> DataFrame:
    out = zonal(cells, pixels, pga_g=F.avg(value))
    return out.withColumn("in_zone_v", F.coalesce(present(F.col("pga_g")) > zone_v, F.lit(False)))


def flood(cells: DataFrame, pixels: DataFrame, occurrence: str = "occurrence", seasonality: str = "seasonality") -> DataFrame:
    out = zonal(cells, pixels, occurrence_pct=F.avg(occurrence), seasonality=F.avg(seasonality))
    return out.withColumn("occurrence_pct", _clip(F.coalesce(present(F.col("occurrence_pct")), F.lit(0.0))))


def slope(cells: DataFrame, pixels: DataFrame, value: str = "value") -> DataFrame:
    return zonal(cells, pixels, mean_slope_deg=F.avg(value), max_slope_deg=F.max(value), p95_slope_deg=F.percentile(value, F.lit(0.95)))


def landcover(cells: DataFrame, pixels: DataFrame, code: str = "code") -> DataFrame:
    share = lambda codes: _clip(F.avg(F.when(F.col(code).isin(codes), 1.0).otherwise(0.0)) * 100)
    return zonal(cells, pixels, **{k: share(v) for k, v in LANDCOVER.items()})


def solar(cells: DataFrame, pixels: DataFrame, has_pvout: bool = True) -> DataFrame:
    """Mean pvout and ghi; without a pvout source ghi is the sum of monthly J/m2 and pvout three quarters of it."""
    if has_pvout:
        return zonal(cells, pixels, pvout_kwh_per_kwp=F.avg("pvout"), ghi_kwh_per_m2=F.avg("ghi"))
    out = zonal(cells, pixels, ghi_kwh_per_m2=F.sum("monthly_j_m2") / F.lit(3.6e6))
    return out.withColumn("pvout_kwh_per_kwp", F.col("ghi_kwh_per_m2") * 0.75)


def climate(cells: DataFrame, pixels: DataFrame) -> DataFrame:
    out = zonal(cells, pixels, mean_temp_c=F.avg("temp_k") - 273.15, dew_c=F.avg("dew_k") - 273.15)
    return out.withColumn("mean_rh_pct", relative_humidity(F.col("mean_temp_c"), F.col("dew_c"))).drop("dew_c")


def population(cells: DataFrame, pixels: DataFrame, cell_area_km2: float, value: str = "value") -> DataFrame:
    out = zonal(cells, pixels, pop_total=F.sum(value))
    return out.withColumn("pop_density_per_km2", F.col("pop_total") / F.lit(cell_area_km2))
