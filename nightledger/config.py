"""Tunable thresholds of the engine, gathered in one immutable object."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    # Thresholds that decide verdicts and match results.
    trail_elongation: float = 2.0
    trail_align_deg: float = 15.0
    trail_threshold: float = 0.03
    trail_min_exposure_s: float = 1.0
    trail_line_band_px: float = 15.0
    trail_line_gap: float = 3.0
    trail_line_min: int = 3
    trail_quality_cap: float = 25.0
    star_sat_fraction: float = 0.95
    star_edge_px: int = 16
    star_min_clean: int = 30
    star_min_sample: int = 5
    star_sample: int = 200
    star_flux_skip: int = 20
    star_flux_min: int = 40
    star_left_out: int = 100
    grid_cols: int = 8
    grid_rows: int = 6
    grid_empty_fraction: float = 0.2
    grid_min_median_stars: float = 5.0
    occluded_threshold: float = 0.15
    dip_map_px: int = 512
    dip_block_min: int = 16
    dip_fit_degree: int = 4
    dip_smooth: float = 0.03
    dip_edge: float = 0.08
    shadow_threshold: float = 0.025
    seq_gap_hours: float = 3.0
    seq_baseline_frames: int = 5
    seq_star_drop: float = 0.3
    seq_hfr_rise: float = 0.25
    seq_empty_rise: float = 0.15
    seq_spread_rise: float = 1.0
    seq_flux_drop: float = 0.3
    seq_dip_rise: float = 0.015
    setpoint_tolerance_c: float = 1.0
    psf_fit_stars: int = 40
    psf_min_fits: int = 5
    cal_temp_tolerance: float = 2.0
    cal_flat_max_days: float = 30.0
    mtime_tolerance_s: float = 1.0
    error_text_max: int = 500
    diagnostics_version: int = 2

    # Physical knobs: they change how work is spread, never a result.
    exact_group_rows: int = 1_000_000   # larger groups get the multi-stage median
    # edges of the sky grid cells, one grid for each size of field
    sky_levels_deg: tuple[float, ...] = (0.5, 2.0, 8.0, 32.0, 180.0)


DEFAULTS = Settings()
