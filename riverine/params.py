"""Parameter records of the steps; their defaults are part of the semantics."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, replace

# Available pipe diameters (m) run from 0.15 to 3.0 in steps of 0.075.
DIAMETERS = tuple(round(0.15 + 0.075 * i, 3) for i in range(39))
INCH, FOOT3 = 0.0254, 35.3147
SQFT = 10.7639


@dataclass(frozen=True)
class Subcatchments:
    min_drainage_area_m2: float = 100_000
    lane_width: float = 3.5
    max_street_length: float = 60
    dem_resolution: float = 10
    lulc_year: int = 2019
    buffer_size_local: float = 5
    min_hole_areasqm_local: float = 1000
    buffer_size_major: float = 15
    min_hole_areasqm_major: float = 20_000


@dataclass(frozen=True)
class Outfalls:
    river_buffer_distance: float = 150
    outfall_clustering_factor: float = 1
    include_water_body_outfalls: bool = False
    water_body_min_area_m2: float = 200
    online_pond_intake: bool = False
    pond_intake_buffer_m: float = 30
    pond_intake_min_area_m2: float = 0
    pond_footprint_match_m: float = 5


@dataclass(frozen=True)
class Topology:
    omit_edges: tuple[str, ...] = ("corridor", "track", "footway", "path")
    weights: tuple[str, ...] = ("chahinian_slope", "length", "contributing_area")
    scaling: dict = field(default_factory=lambda: {"chahinian_slope": 1.0, "length": 0.1, "contributing_area": 0.1})
    exponent: dict = field(default_factory=lambda: {"chahinian_slope": 1.0, "length": 1.0, "contributing_area": 1.0})
    angle_scaling: float = 0.3

    def __post_init__(self):
        if missing := [w for w in self.weights if w not in self.scaling or w not in self.exponent]:
            raise ValueError(f"scaling and exponent are missing for {missing}")


@dataclass(frozen=True)
class Channels:
    mannings_n: float = 0.035
    width_coeff: float = 2.7
    width_exponent: float = 0.5
    depth_ratio: float = 0.4
    min_width: float = 1
    max_width: float = 50
    min_depth: float = 0.3
    max_depth: float = 5


@dataclass(frozen=True)
class Ponds:
    side_slope_pct: float = 25
    max_depth_m: float = 3.81
    n_curve_points: int = 5
    bottom_area_min_ratio: float = 0.30
    orifice_cd: float = 0.65
    orifice_inches: tuple[int, ...] = (6, 8, 12, 18, 24, 30, 36, 48)
    max_orifice_diameter_m: float = 0.9144
    peak_margin: float = 1.1
    pipe_fraction: float = 0.8
    weir_cw: float = 3.0
    weir_crest_ratio: float = 0.90
    weir_length_m: float = 4.6
    fdot_intercept: float = 0.6431
    fdot_slope: float = 2.5921
    min_area_m2: float = 200
    max_pond_area_m2: float = 50_000
    lake_tags: tuple[str, ...] = ("lake", "reservoir", "lagoon", "oxbow")
    max_snap: float = 200
    min_outfall_head_drop_m: float = 2
    downstream_search_max_m: float = 750
    sub_reroute_max: float = 500
    capacity_multiplier: float = 2
    river_front_m: float = 60
    enclosed_gap_close_m: float = 75
    inflow_offset_m: float = 0.30
    orifice_crest_offset_m: float = 0.10
    closed_basin_sur_depth_m: float = 2
    open_basin_sur_depth_m: float = 0
    closed_basin_psi_mm: float = 50
    closed_basin_ksat_mm_hr: float = 12.5
    closed_basin_imd: float = 0.3


@dataclass(frozen=True)
class Hydraulics:
    diameters: tuple[float, ...] = DIAMETERS
    min_v: float = 0.61
    max_v: float = 3.05
    min_depth: float = 0.5
    max_depth: float = 5
    precipitation: float = 0.006
    min_positive_slope: float = 0.001
    flat_terrain_capacity_factor: float = 1.5
    manhole_drop_m: float = 0.03
    max_outfall_slope: float = 0.05
    design_return_period: int = 10
    design_duration: str = "60-min"


@dataclass(frozen=True)
class DualDrainage:
    enabled: bool = True
    curb_depth_m: float = 0.3
    channel_roughness: float = 0.016
    default_lanes: float = 2


@dataclass(frozen=True)
class Simplification:
    enabled: bool = False
    min_contributing_area_m2: float = 0
    max_conduit_length: float = 500


@dataclass(frozen=True)
class Trunks:
    enabled: bool = True
    max_trunk_length_m: float = 2000
    placeholder_diameter_m: float = 0.30


@dataclass(frozen=True)
class Parameters:
    subcatchments: Subcatchments = Subcatchments()
    outfalls: Outfalls = Outfalls()
    topology: Topology = Topology()
    channels: Channels = Channels()
    ponds: Ponds = Ponds()
    hydraulics: Hydraulics = Hydraulics()
    dual_drainage: DualDrainage = DualDrainage()
    simplification: Simplification = Simplification()
    trunks: Trunks = Trunks()

    def override(self, values: dict[str, dict]) -> Parameters:
        """A copy with values[group][name] set; unknown groups or names raise ValueError."""
        out = {}
        for group, some in values.items():
            if group not in {f.name for f in fields(self)}:
                raise ValueError(f"no parameter group {group!r}")
            record = getattr(self, group)
            if unknown := set(some) - {f.name for f in fields(record)}:
                raise ValueError(f"{group} has no {sorted(unknown)}")
            out[group] = replace(record, **some)
        return replace(self, **out)
