"""Frames against user-defined sky positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nightledger.config import DEFAULTS, Settings
from nightledger.functions.scoring import effective_fov
from nightledger.functions.spatial import angsep, contains, sky_cell, sky_cells_around
from nightledger.operators.rollups import frame_set_rollup, night_filter_rollup
from nightledger.sources.catalog import light_frames


def _spherical_sep(ra1: Column, dec1: Column, ra2: Column, dec2: Column) -> Column:
    """Separation by the cosine law, as the radius test defines it."""
    c = F.sin(F.radians(dec1)) * F.sin(F.radians(dec2)) + F.cos(F.radians(dec1)) * F.cos(F.radians(dec2)) * F.cos(F.radians(ra1 - ra2))
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c))))


def match_targets(frames: DataFrame, targets: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    """(target_id, frame columns...) for every readable light frame whose
    rotated field of view covers the target, or whose centre lies within the
    target's radius (a radius of 0 counts as none).

    One equi-join on sky cells of several sizes.  A frame's level is that of
    its field, a target's that of its radius, and a pair meets once, at the
    larger of both levels: there the target lists its own and the neighbouring
    cells, which hold the centre of any frame that can match, and the frame
    its own.  A frame has one row for each level from its own up, so wide and
    narrow fields alike meet few targets in vain.

    Frames are read once and nothing is counted beforehand.  Spark broadcasts
    the targets below its threshold; a target has at most some 9 narrow rows a
    level.  Otherwise the adaptive join splits a cell that holds much of the
    catalogue.  Positions that are unknown never match.
    """
    lights = light_frames(frames)
    own = lights.columns
    levels = list(enumerate(cfg.sky_levels_deg))
    # A hair more than the exact reach, so rounding never loses a border case.
    slack = 1e-6

    def level_of(reach: Column) -> Column:
        return F.coalesce(*[F.when(reach <= size, F.lit(i)) for i, size in levels[:-1]], F.when(reach.isNull(), F.lit(0)), F.lit(len(levels) - 1))

    pos = lights.withColumns({
        "_ra": F.coalesce("wcs_ra", "ra"), "_dec": F.coalesce("wcs_dec", "dec"),
        "_w": effective_fov("fov_w", "naxis1", True), "_h": effective_fov("fov_h", "naxis2", True),
    }).filter(F.col("_ra").isNotNull() & F.col("_dec").isNotNull())
    pos = pos.withColumn("_level", level_of(F.sqrt(F.col("_w") * F.col("_w") + F.col("_h") * F.col("_h")) / 2 + slack))
    # Even meetings are at the frame's level, odd ones at a target's larger one.
    at = [F.when(F.col("_level") <= i, F.struct((2 * F.lit(i) + (F.col("_level") < i).cast("int")).alias("_meeting"), sky_cell(F.col("_ra"), F.col("_dec"), size).alias("_cell"))) for i, size in levels]
    frame_side = pos.select(*own, "_ra", "_dec", "_w", "_h", F.inline(F.array_compact(F.array(*at))))

    t = targets.select(
        F.col("id").alias("target_id"), F.col("ra").alias("_t_ra"), F.col("dec").alias("_t_dec"),
        F.when(F.col("radius_deg") != 0, F.col("radius_deg")).alias("_t_radius"),
    ).filter(F.col("_t_ra").isNotNull() & F.col("_t_dec").isNotNull())
    r = F.col("_t_radius") + slack
    t = t.withColumn("_level", level_of(r))

    def around(reach: Column, i: int, size: float, wanted: Column) -> Column:
        edge = F.abs(F.col("_t_dec")) + reach
        ra_reach = F.when(edge >= 89.9, F.lit(180.0)).otherwise(reach / F.cos(F.radians(edge)))
        return F.when(wanted, F.transform(sky_cells_around(F.col("_t_ra"), F.col("_t_dec"), reach, ra_reach, size), lambda c: F.struct(F.lit(i).alias("_meeting"), c.alias("_cell"))))

    cells = [around(F.lit(size + slack), 2 * i, size, F.col("_level") <= i) for i, size in levels]
    cells += [around(r, 2 * i + 1, size, (F.col("_level") == i) & r.isNotNull()) for i, size in levels[1:]]
    target_side = t.select("target_id", "_t_ra", "_t_dec", "_t_radius", F.inline(F.flatten(F.array_compact(F.array(*cells)))))

    covered = contains(F.col("_ra"), F.col("_dec"), F.col("_w"), F.col("_h"), F.col("wcs_rotation"), F.col("_t_ra"), F.col("_t_dec"))
    inside = _spherical_sep(F.col("_ra"), F.col("_dec"), F.col("_t_ra"), F.col("_t_dec")) <= F.col("_t_radius")
    return frame_side.join(target_side, ["_meeting", "_cell"]).filter(covered | inside).select("target_id", *own)


def user_targets_rollup(frames: DataFrame, targets: DataFrame, rounded: bool = True, cfg: Settings = DEFAULTS) -> DataFrame:
    """Every user target with the totals of its frames, longest first;
    unmatched targets show zeros."""
    totals = frame_set_rollup(match_targets(frames, targets, cfg), ["target_id"], rounded)
    out = targets.join(totals, targets["id"] == totals["target_id"], "left").drop("target_id")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("frames", "nights", "rejected")}
    zero["integration_sec"] = F.coalesce("integration_sec", F.lit(0.0))
    return out.withColumns(zero).orderBy(F.col("integration_sec").desc(), "name", "id")


def user_target_night_filters(frames: DataFrame, targets: DataFrame, rounded: bool = True, cfg: Settings = DEFAULTS) -> DataFrame:
    """Night x filter leaves per user target."""
    return night_filter_rollup(match_targets(frames, targets, cfg), ["target_id"], rounded)


def user_target_nights(frames: DataFrame, targets: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    """Nights per user target, newest first; rig and moon phase are those of
    the night's frame with the lowest id."""
    rows = match_targets(frames, targets, cfg)
    out = rows.groupBy("target_id", F.coalesce(F.substring("date_obs", 1, 10), F.lit("Unknown")).alias("night")).agg(
        F.count(F.lit(1)).alias("frames"), F.coalesce(F.sum("exptime"), F.lit(0.0)).alias("integration_sec"),
        F.min_by(F.struct("telescop", "instrume", "moon_illum"), "id").alias("_f"),
    )
    return out.select("target_id", "night", "frames", "integration_sec", F.col("_f.telescop").alias("telescop"), F.col("_f.instrume").alias("instrume"), F.col("_f.moon_illum").alias("moon_illum")).orderBy(F.col("night").desc(), "target_id")


def cone(frames: DataFrame, ra: float, dec: float, radius: float) -> DataFrame:
    """Frames whose effective centre lies within the radius.  The declination
    test is plain, so with stored positions it prunes before any trigonometry."""
    d = F.coalesce("wcs_dec", "dec")
    return frames.filter(d.between(dec - radius, dec + radius) & (angsep(F.coalesce("wcs_ra", "ra"), d, ra, dec) <= radius))
