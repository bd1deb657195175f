"""A frame's quality columns from its detections and background tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nightledger.config import DEFAULTS, Settings
from nightledger.functions import scoring
from nightledger.operators import background, stars


def frame_metrics(
    detections: DataFrame, bg_cells: DataFrame, bg_blocks: DataFrame, frame_info: DataFrame, cfg: Settings = DEFAULTS, block_info: DataFrame | None = None,
) -> DataFrame:
    """One row per frame of `frame_info` with every quality column.

    `frame_info` may carry exptime, focal_length, xbinning, pixsz and
    back_median for the derived columns.  Frames of a colour mosaic were
    measured on 2 x 2 bins; their sizes are given in sensor pixels.  Where the
    background maps were made from frames of other sizes, `block_info` has them.
    """
    have = set(frame_info.columns)

    def info(name: str):
        return F.col(name) if name in have else F.lit(None).cast("double")

    classified = stars.classify_sources(detections, frame_info, cfg)
    m = frame_info
    for part in (
        stars.star_metrics(classified, cfg),
        stars.trail_scores(detections, cfg),
        background.grid_metrics(detections, bg_cells, frame_info, cfg).select("frame_id", "empty_cells", "bg_spread"),
        background.background_dips(bg_blocks, frame_info if block_info is None else block_info, cfg).select("frame_id", "bg_dip"),
    ):
        m = m.join(part, "frame_id", "left")
    m = m.withColumn("star_count", F.coalesce("star_count", F.lit(0).cast("long")))
    m = scoring.to_sensor_pixels(m, 2, F.coalesce(scoring.cfa_pattern(F.col("bayer")).isNotNull(), F.lit(False)))
    for name in ("median_hfr", "psf_fwhm", "psf_beta"):
        if name not in m.columns:
            m = m.withColumn(name, F.lit(None).cast("double"))
    scale = scoring.pixel_scale(info("pixsz"), info("focal_length"), info("xbinning"))
    m = m.withColumns({
        "pixel_scale": scale,
        "fwhm_arcsec": scoring.fwhm_arcsec(F.col("median_fwhm"), scale),
        "trail_score": scoring.trail_after_exposure(F.col("trail_score"), info("exptime"), F.lit(True), cfg),
        "background_median": info("back_median"),
    })
    score = scoring.quality_score(F.col("median_hfr"), F.col("median_fwhm"), F.col("eccentricity"), F.col("trail_score"), cfg)
    return m.select(
        "frame_id", "star_count", "median_hfr", "median_fwhm", "fwhm_arcsec", "eccentricity", "trail_score", "background_median",
        "pixel_scale", score.alias("quality_score"), "empty_cells", "bg_spread", "bg_dip", "psf_fwhm", "psf_beta", "star_flux",
        F.col("streaks").cast("int").alias("streaks") if "streaks" in have else F.lit(None).cast("int").alias("streaks"),
    )
