"""Thresholds, weight presets and curated lists."""

from __future__ import annotations

from dataclasses import dataclass, field, replace


@dataclass(frozen=True)
class Exclusions:
    # fixed values
    pga_g: float = 0.36
    flood_pct: float = 25.0
    slope_deg: float = 10.0
    urban_pct: float = 70.0
    forest_pct: float = 60.0
    wetland_pct: float = 30.0
    water_pct: float = 50.0


@dataclass(frozen=True)
class Preset:
    """Weights need not sum to one; transforms are in km, °C and kWh/kWp."""

    # fixed values
    power_redundancy: float = 0.30
    water_proximity: float = 0.15
    connectivity: float = 0.15
    solar_potential: float = 0.10
    climate: float = 0.10
    latency: float = 0.20
    primary_decay_km: float = 15.0
    secondary_decay_km: float = 30.0
    secondary_weight: float = 0.4
    water_decay_km: float = 10.0
    highway_decay_km: float = 5.0
    pvout_center: float = 1400.0
    pvout_spread: float = 200.0
    temp_low_c: float = 18.0
    temp_high_c: float = 38.0
    metro_decay_km: float = 100.0
    cable_decay_km: float = 200.0
    cable_weight: float = 0.5

    def weights(self) -> dict[str, float]:
        raw = {k: getattr(self, k) for k in ("power_redundancy", "water_proximity", "connectivity", "solar_potential", "climate", "latency")}
        total = sum(raw.values())
        if total <= 0:
            raise ValueError("weights must sum to more than zero")
        return {k: v / total for k, v in raw.items()}


def preset_from(values: dict[str, float]) -> Preset:
    """The default preset with some of its values changed; an unknown name is an error."""
    return replace(Preset(), **values)


DEFAULT = Preset()
# fixed values
TIER4 = replace(
    DEFAULT, power_redundancy=0.50, solar_potential=0.05, climate=0.05, latency=0.10, primary_decay_km=10.0, secondary_decay_km=20.0, secondary_weight=0.5
)
GREEN = Preset(
    power_redundancy=0.20, water_proximity=0.15, connectivity=0.10, solar_potential=0.30, climate=0.15, latency=0.10,
    primary_decay_km=20.0, secondary_decay_km=40.0, pvout_center=1500.0, pvout_spread=150.0, temp_low_c=16.0, temp_high_c=32.0,
    metro_decay_km=150.0, cable_decay_km=250.0, cable_weight=0.4,
)
PRESETS = {"default": DEFAULT, "tier4": TIER4, "green": GREEN}

# fixed values: what a missing feature counts as
FILL = {
    "nearest_hv_line_km": 9999.0,
    "nearest_hv_line_distinct_subgrid_km": 9999.0,
    "nearest_water_km": 9999.0,
    "nearest_highway_km": 9999.0,
    "nearest_metro_km": 9999.0,
    "nearest_cable_landing_km": 9999.0,
    "annual_pvout_kwh_per_kwp": 1000.0,
    "mean_temp_c": 50.0,
}
DISTANCE_CAP_KM = 500.0
EARTH_KM = 6371.0088
# fixed values: name, population, state, lon, lat
METROS = [
    ("Mumbai", 21000000, "MH", 72.877, 19.076),
    ("Delhi", 32000000, "DL", 77.209, 28.614),
    ("Bengaluru", 13600000, "KA", 77.594, 12.972),
    ("Hyderabad", 10500000, "TG", 78.486, 17.385),
    ("Chennai", 11500000, "TN", 80.270, 13.083),
    ("Pune", 7400000, "MH", 73.856, 18.520),
    ("Kolkata", 15000000, "WB", 88.363, 22.572),
    ("Ahmedabad", 8400000, "GJ", 72.581, 23.025),
    ("Jaipur", 4000000, "RJ", 75.787, 26.912),
    ("Lucknow", 3500000, "UP", 80.946, 26.846),
]
# fixed values: name, city, lon, lat
LANDINGS = [
    ("Mumbai (Versova)", "Mumbai", 72.821, 19.139),
    ("Chennai", "Chennai", 80.275, 13.083),
    ("Tuticorin", "Tuticorin", 78.135, 8.789),
    ("Kochi", "Kochi", 76.236, 9.982),
    ("Trivandrum", "Thiruvananthapuram", 76.928, 8.524),
    ("Visakhapatnam", "Visakhapatnam", 83.293, 17.692),
    ("Digha", "Digha", 87.516, 21.624),
]
# one vocabulary for the mask's reasons and the graph's reason nodes
REASONS = ["seismic_zone_v", "flood_recurrence", "slope_too_steep", "urban_built_up", "forest_cover", "wetland", "water_body", "protected_area"]


@dataclass(frozen=True)
class Settings:
    exclusions: Exclusions = field(default_factory=Exclusions)
    preset: Preset = field(default_factory=Preset)
    drill_top_n: int = 200
    min_spacing_km: float = 50.0
    top_n_per_state: int = 20
