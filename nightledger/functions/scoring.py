"""Derived frame columns: scale, score, verdict flags, effective geometry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nightledger.config import DEFAULTS, Settings
from nightledger.functions.numeric import nonzero, py_round



def pixel_scale(pixel_um: Column, focal_mm: Column, xbinning: Column) -> Column:
    """Arcsec per pixel; unknown when either size is missing or zero."""
    xbin = F.coalesce(nonzero(xbinning), F.lit(1))
    return F.when((pixel_um != 0) & (focal_mm != 0), 206.265 * (pixel_um * xbin) / focal_mm)


def fwhm_arcsec(fwhm_px: Column, scale: Column) -> Column:
    return nonzero(fwhm_px) * nonzero(scale)


def trail_after_exposure(trail: Column, exptime: Column, analyzed: Column, cfg: Settings = DEFAULTS) -> Column:
    """An analyzed exposure too short to trail scores 0."""
    return F.when(analyzed & (exptime < cfg.trail_min_exposure_s), F.lit(0.0)).otherwise(trail)


def quality_score(hfr: Column, fwhm: Column, eccentricity: Column, trail: Column, cfg: Settings = DEFAULTS) -> Column:
    """0-100: focus weighs .6, roundness .4, over whichever is known.

    Focus falls from 100 at 1.5 px to 0 at 6 px; roundness from 100 at
    eccentricity .3 to 0 at .8.  Trailed frames are capped.
    """
    focus = F.coalesce(hfr, fwhm / 2.0)
    f = F.least(F.greatest((6.0 - focus) / (6.0 - 1.5) * 100.0, F.lit(0.0)), F.lit(100.0))
    r = F.least(F.greatest((0.8 - eccentricity) / (0.8 - 0.3) * 100.0, F.lit(0.0)), F.lit(100.0))
    # An unknown part has weight 0; its clipped value is then irrelevant.
    wf = F.when(hfr.isNotNull() | fwhm.isNotNull(), 0.6).otherwise(0.0)
    wr = F.when(eccentricity.isNotNull(), 0.4).otherwise(0.0)
    score = py_round((f * wf + r * wr) / F.nullif(wf + wr, F.lit(0.0)), 1)
    cap = F.when(trail > cfg.trail_threshold, F.lit(cfg.trail_quality_cap))
    return F.when(F.coalesce(hfr, fwhm, eccentricity).isNotNull(), F.least(score, cap))


def cfa_pattern(bayer: Column) -> Column:
    """The 2x2 colour-filter pattern, NULL for mono and other values."""
    v = F.upper(F.trim(bayer))
    return F.when(v.rlike("^[RGB]{4}$"), v)


def one_shot_colour(bayer: Column) -> Column:
    return F.coalesce(bayer, F.lit("")) != ""


# -- verdicts: NULL when the metric is unknown ---------------------------------


VERDICTS = ["trailed", "good_tracking", "occluded", "shadow", "satellite", "off_setpoint"]


def verdict(name: str, cfg: Settings = DEFAULTS) -> Column:
    c = F.col
    if name == "trailed":
        return c("trail_score") > cfg.trail_threshold
    if name == "good_tracking":
        return c("trail_score") <= cfg.trail_threshold
    if name == "occluded":
        return c("empty_cells") > cfg.occluded_threshold
    if name == "shadow":
        return c("bg_dip") > cfg.shadow_threshold
    if name == "satellite":
        return c("streaks") > 0
    return F.abs(c("ccd_temp") - c("set_temp")) > cfg.setpoint_tolerance_c


def grade_name(rejected: Column) -> Column:
    return F.when(rejected == 1, F.lit("rejected")).when(rejected == 0, F.lit("accepted"))


# -- effective geometry --------------------------------------------------------


def effective_scale() -> Column:
    return F.coalesce(F.col("wcs_scale"), F.col("pixel_scale"))


def effective_fov(stored: str, naxis: str, zero_is_missing: bool) -> Column:
    """Stored field of view, else pixels times scale.

    `zero_is_missing` treats a stored 0 (field, pixels or scale) as unknown,
    which is how the catalogue and the target matching read it; selection
    expressions take a stored 0 as a value.
    """
    s, n = F.col(stored), F.col(naxis)
    if zero_is_missing:
        s, n = nonzero(s), nonzero(n)
    return F.coalesce(s, n * effective_scale() / 3600.0)


def with_scores(df: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    """Recompute the trail rule and the score from stored metrics."""
    trail = trail_after_exposure(F.col("trail_score"), F.col("exptime"), F.col("star_count").isNotNull(), cfg)
    return df.withColumn("trail_score", trail).withColumn(
        "quality_score",
        quality_score(F.col("median_hfr"), F.col("median_fwhm"), F.col("eccentricity"), F.col("trail_score"), cfg),
    )


def to_sensor_pixels(df: DataFrame, k: int, is_binned: Column | None = None) -> DataFrame:
    """Frame metrics measured on k x k bins, expressed in sensor pixels.

    Averaging a k x k box widens a star by the box variance k^2/12, which is
    taken out in quadrature (never below a quarter of the variance).  Works on
    whichever of the size and flux columns the table has.
    """
    binned = F.lit(True) if is_binned is None else is_binned
    box = k * k / 12.0
    for name, sigmas in (("median_fwhm", 2.3548), ("median_hfr", 1.1774), ("psf_fwhm", 2.3548)):
        if name in df.columns:
            var = F.pow(F.col(name) * k / sigmas, F.lit(2.0))
            value = sigmas * F.sqrt(F.greatest(var - box, 0.25 * var))
            df = df.withColumn(name, F.when(binned, value).otherwise(F.col(name)))
    if "star_flux" in df.columns:
        df = df.withColumn("star_flux", F.when(binned, F.col("star_flux") * (k * k)).otherwise(F.col("star_flux")))
    return df
