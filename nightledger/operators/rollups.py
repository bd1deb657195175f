"""Integration rollups, catalogue counts, facets and metric summaries.

The main results are flat (one row per leaf), which aggregates map-side.  The
nested lists hold distinct filters, rigs or nights of a group: labels already
aggregated, never frames.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nightledger.config import DEFAULTS, Settings
from nightledger.functions.numeric import py_round
from nightledger.functions.text import night
from nightledger.operators.quantiles import global_median_and_mad, grouped_medians
from nightledger.sources.catalog import light_frames

NO_FILTER = "—"  # fixed value: label of frames without a filter


def _secs() -> Column:
    return F.coalesce(F.sum("exptime"), F.lit(0.0))


def _avg(col: str, digits: int, rounded: bool) -> Column:
    mean = F.avg(col)
    return py_round(mean, digits) if rounded else mean


def _filter_label(blank_too: bool = True) -> Column:
    f = F.nullif(F.col("filter"), F.lit("")) if blank_too else F.col("filter")
    return F.coalesce(f, F.lit(NO_FILTER))


# -- per object ---------------------------------------------------------------------


def targets_rollup(frames: DataFrame, rounded: bool = True) -> DataFrame:
    """One row per object over readable light frames."""
    n = night(F.col("date_obs"))
    return light_frames(frames).filter(F.col("object").isNotNull()).groupBy("object").agg(
        F.count(F.lit(1)).alias("frames"),
        _secs().alias("integration_sec"),
        F.count_distinct(n).alias("nights"),
        F.min(n).alias("first_night"),
        F.max(n).alias("last_night"),
        _avg("quality_score", 1, rounded).alias("avg_quality"),
        _avg("median_hfr", 2, rounded).alias("avg_hfr"),
        F.sum(F.coalesce("rejected", F.lit(0))).alias("rejected"),
    )


def targets_by_filter(frames: DataFrame) -> DataFrame:
    return light_frames(frames).groupBy("object", _filter_label().alias("filter")).agg(
        F.count(F.lit(1)).alias("frames"), _secs().alias("integration_sec")
    )


def targets_by_rig(frames: DataFrame) -> DataFrame:
    some = (F.coalesce("telescop", F.lit("")) != "") | (F.coalesce("instrume", F.lit("")) != "")
    return light_frames(frames).filter(some).groupBy("object", "telescop", "instrume").agg(F.count(F.lit(1)).alias("frames"))


def target_totals(rollup: DataFrame) -> DataFrame:
    return rollup.agg(_secs_of().alias("total_integration_sec"), F.count(F.lit(1)).alias("target_count"))


def _secs_of() -> Column:
    return F.coalesce(F.sum("integration_sec"), F.lit(0.0))


def _ordered_list(df: DataFrame, by: list[str], order: list[Column], fields: list[str], name: str) -> DataFrame:
    """Per group, the leaves as an array in the given order."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    packed = df.withColumn("_r", rank).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_r", *fields))).alias(name))
    return packed.withColumn(name, F.transform(name, lambda e: e.dropFields("_r")))


def targets_nested(frames: DataFrame, rounded: bool = True) -> DataFrame:
    """Object totals with their filter list (longest first) and rig list
    (most frames first)."""
    filters = _ordered_list(
        targets_by_filter(frames), ["object"], [F.col("integration_sec").desc(), F.col("filter")],
        ["filter", "frames", "integration_sec"], "filters",
    )
    rigs = _ordered_list(
        targets_by_rig(frames), ["object"], [F.col("frames").desc(), F.col("telescop"), F.col("instrume")],
        ["telescop", "instrume", "frames"], "rigs",
    )
    out = targets_rollup(frames, rounded).join(filters, "object", "left").join(rigs, "object", "left")
    return out.withColumns({c: F.coalesce(c, F.array().cast(out.schema[c].dataType)) for c in ("filters", "rigs")})


TARGET_SORTS = {
    "name": lambda c: [c("object").asc()],
    "recent": lambda c: [F.coalesce(c("last_night"), F.lit("")).desc(), c("object").asc()],
    "quality": lambda c: [F.coalesce(c("avg_quality"), F.lit(-1.0)).desc(), c("object").asc()],
    "integration": lambda c: [c("integration_sec").desc(), c("object").asc()],
}


def sort_targets(rollup: DataFrame, mode: str = "integration", name: str = "object") -> DataFrame:
    order = TARGET_SORTS.get(mode, TARGET_SORTS["integration"])
    return rollup.orderBy(*order(lambda c: F.col(name if c == "object" else c)))


# -- nights --------------------------------------------------------------------------


def night_filter_rollup(rows: DataFrame, by: list[Column | str], rounded: bool = True) -> DataFrame:
    """Leaves of a night breakdown: per (by..., night, filter)."""
    return rows.groupBy(*by, F.coalesce(night(F.col("date_obs")), F.lit("Unknown")).alias("night"), _filter_label().alias("filter")).agg(
        F.count(F.lit(1)).alias("frames"),
        _secs().alias("integration_sec"),
        _avg("median_hfr", 2, rounded).alias("avg_hfr"),
        _avg("eccentricity", 3, rounded).alias("avg_eccentricity"),
        _avg("quality_score", 1, rounded).alias("avg_quality"),
        _avg("altitude", 1, rounded).alias("avg_altitude"),
    )


def target_night_filters(frames: DataFrame, object: str | None = None, rounded: bool = True) -> DataFrame:
    """Night x filter leaves of one object, or of every object at once."""
    rows = light_frames(frames)
    rows = rows.filter(F.col("object").isNotNull() if object is None else F.col("object") == object)
    return night_filter_rollup(rows, ["object"], rounded)


def target_nights(frames: DataFrame, object: str | None = None, rounded: bool = True) -> DataFrame:
    """Nights of an object, newest first.

    Rig and moon phase come from the night's first filter in label order
    (rig: its frame with the lowest id), so they do not depend on row order.
    """
    rows = light_frames(frames)
    rows = rows.filter(F.col("object").isNotNull() if object is None else F.col("object") == object)
    rows = rows.withColumns({"night": F.coalesce(night(F.col("date_obs")), F.lit("Unknown")), "_f": F.coalesce("filter", F.lit(""))})
    leaf = rows.groupBy("object", "night", "_f").agg(
        F.count(F.lit(1)).alias("n"), _secs().alias("s"), F.avg("moon_illum").alias("moon"),
        F.min_by(F.struct("telescop", "instrume"), "id").alias("rig"),
    )
    moon = F.min_by(F.struct("moon"), "_f")["moon"]
    out = leaf.groupBy("object", "night").agg(
        F.sum("n").alias("frames"), F.sum("s").alias("integration_sec"), F.count(F.lit(1)).alias("filters"),
        F.min_by("rig", "_f").alias("_rig"), (py_round(moon, 2) if rounded else moon).alias("moon_illum"),
    )
    out = out.select("object", "night", F.col("_rig.telescop").alias("telescop"), F.col("_rig.instrume").alias("instrume"), "frames", "integration_sec", "filters", "moon_illum")
    return out.orderBy(F.col("night").desc(), F.col("object"))


def target_filter_totals(frames: DataFrame, object: str) -> DataFrame:
    rows = targets_by_filter(frames.filter(F.col("object") == object))
    return rows.orderBy(F.col("integration_sec").desc(), "filter")


def sessions_by_filter(frames: DataFrame, rounded: bool = True) -> DataFrame:
    """Object x night x filter.  Needs a capture time; tombstones stay in."""
    rows = light_frames(frames, tombstones=True).filter(F.col("date_obs").isNotNull())
    leaf = night_filter_rollup(rows, [_object_label().alias("object")], rounded)
    return leaf.drop("avg_altitude")


def _object_label() -> Column:
    return F.coalesce(F.nullif(F.col("object"), F.lit("")), F.lit("Unknown"))


def sessions_rollup(frames: DataFrame) -> DataFrame:
    """Imaging sessions (object x night), newest first, with their filters."""
    rows = light_frames(frames, tombstones=True).filter(F.col("date_obs").isNotNull())
    out = rows.groupBy(_object_label().alias("object"), night(F.col("date_obs")).alias("night")).agg(
        F.count(F.lit(1)).alias("frames"), _secs().alias("integration_sec"),
        F.count_distinct(_filter_label()).alias("filters"), F.min_by(F.struct("telescop", "instrume"), "id").alias("_rig"),
    )
    out = out.select("object", "night", F.col("_rig.telescop").alias("telescop"), F.col("_rig.instrume").alias("instrume"), "frames", "integration_sec", "filters")
    return out.orderBy(F.col("night").desc(), F.col("object"))


def sessions_nested(frames: DataFrame, rounded: bool = True) -> DataFrame:
    filters = _ordered_list(
        sessions_by_filter(frames, rounded), ["object", "night"], [F.col("filter")],
        ["filter", "frames", "integration_sec", "avg_hfr", "avg_eccentricity", "avg_quality"], "filter_list",
    )
    return sessions_rollup(frames).join(filters, ["object", "night"]).orderBy(F.col("night").desc(), F.col("object"))


def nights_overview(sessions: DataFrame) -> DataFrame:
    """Sessions grouped by night."""
    return sessions.groupBy("night").agg(
        F.sum("frames").alias("frames"), F.sum("integration_sec").alias("integration_sec"), F.count(F.lit(1)).alias("sessions")
    ).orderBy(F.col("night").desc())


# -- any set of frames ---------------------------------------------------------------


def frame_set_rollup(rows: DataFrame, by: list[str] | None = None, rounded: bool = True) -> DataFrame:
    """Totals of a frame set, optionally per group."""
    n = F.when(F.coalesce("date_obs", F.lit("")) != "", night(F.col("date_obs")))
    return rows.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("frames"),
        _secs().alias("integration_sec"),
        F.count_distinct(n).alias("nights"),
        F.min(n).alias("first_night"),
        F.max(n).alias("last_night"),
        _avg("quality_score", 1, rounded).alias("avg_quality"),
        _avg("median_hfr", 2, rounded).alias("avg_hfr"),
        F.count_if(F.coalesce("rejected", F.lit(0)) != 0).alias("rejected"),
    )


def object_position(frames: DataFrame, object: str | None = None, cfg: Settings = DEFAULTS) -> DataFrame:
    """Median position per object over its light frames; the solved centre
    wins over the header, each axis on its own."""
    rows = light_frames(frames)
    rows = rows.filter(F.col("object").isNotNull() if object is None else F.col("object") == object)
    rows = rows.select("object", F.coalesce("wcs_ra", "ra").alias("ra"), F.coalesce("wcs_dec", "dec").alias("dec"))
    return grouped_medians(rows, ["object"], ["ra", "dec"], cfg.exact_group_rows)


def target_from_object(frames: DataFrame, object: str, cfg: Settings = DEFAULTS) -> tuple[float, float]:
    """Position for a new user target; an error without any coordinates."""
    row = object_position(frames, object, cfg).first()
    if row is None or row["ra"] is None or row["dec"] is None:
        raise ValueError(f"no frames with coordinates for {object!r}; plate-solve them first")
    return row["ra"], row["dec"]


# -- catalogue counts ------------------------------------------------------------------


def catalog_totals(frames: DataFrame) -> DataFrame:
    return frames.agg(F.count_if(F.col("index_error").isNull()).alias("total"), F.count_if(F.col("index_error").isNotNull()).alias("failed"))


def catalog_counts(frames: DataFrame, top_objects: int = 20) -> DataFrame:
    """Counts per image type, object (top 20) and filter; tombstones included.

    One pass: the three columns are stacked and counted together.
    """
    typ = F.coalesce(F.nullif(F.col("imagetyp"), F.lit("")), F.lit("Unknown"))
    counted = _value_counts(frames, {"imagetyp": typ, "object": F.col("object"), "filter": F.col("filter")})
    rank = F.row_number().over(Window.partitionBy("facet").orderBy(F.col("count").desc(), F.col("value")))
    # The limit is a plain bound on the rank, so Spark drops the rest before the shuffle.
    objects = counted.filter("facet = 'object'").withColumn("_r", rank).filter(F.col("_r") <= top_objects).drop("_r")
    return counted.filter("facet <> 'object'").unionByName(objects)


def distinct_values(frames: DataFrame) -> DataFrame:
    """Distinct labels per facet, sorted."""
    cols = {"imagetypes": "imagetyp", "filters": "filter", "telescopes": "telescop", "instruments": "instrume"}
    counted = _value_counts(frames, {k: F.col(v) for k, v in cols.items()})
    return counted.select("facet", "value").orderBy("facet", "value")


def _value_counts(df: DataFrame, cols: dict[str, Column]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(k).alias("facet"), c.alias("value")) for k, c in cols.items()])
    rows = df.select(F.explode(pairs).alias("p")).select("p.facet", "p.value").filter(F.col("value").isNotNull())
    return rows.groupBy("facet", "value").agg(F.count(F.lit(1)).alias("count"))


def facets(approved: DataFrame, n: int = 40, n_dates: int = 90) -> DataFrame:
    """Most common camera, telescope, object, filter (n each) and night."""
    def named(c: str) -> Column:
        return F.nullif(F.col(c), F.lit(""))

    counted = _value_counts(approved, {
        "instrume": named("instrume"), "telescop": named("telescop"), "object": named("object"), "filter": named("filter"),
        "date": F.nullif(night(F.col("date_obs")), F.lit("")),
    })
    rank = F.row_number().over(Window.partitionBy("facet").orderBy(F.col("count").desc(), F.col("value")))
    # The larger limit for all facets first: a plain bound that Spark applies before the shuffle.
    most = counted.withColumn("rank", rank).filter(F.col("rank") <= max(n, n_dates))
    return most.filter(F.col("rank") <= F.when(F.col("facet") == "date", n_dates).otherwise(n))


def facet_totals(approved: DataFrame) -> DataFrame:
    return approved.agg(F.count(F.lit(1)).alias("frames"), _secs().alias("integration_sec"))


# Metric name -> frame column.
SUMMARY_METRICS = {
    "hfr": "median_hfr", "fwhm": "median_fwhm", "eccentricity": "eccentricity", "stars": "star_count",
    "quality": "quality_score", "altitude": "altitude", "airmass": "airmass", "moon_sep": "moon_sep",
    "moon_illum": "moon_illum", "background": "background_median", "pixel_scale": "pixel_scale", "focal": "focal_length",
    "empty_cells": "empty_cells", "bg_spread": "bg_spread", "bg_dip": "bg_dip", "psf_fwhm": "psf_fwhm",
    "psf_beta": "psf_beta", "star_flux": "star_flux",
}


def metric_summary(rows: DataFrame, metrics: dict[str, str] | None = None, rounded: bool = True, cfg: Settings = DEFAULTS) -> DataFrame:
    """median, mad, mean, std (population), min, max per metric with values."""
    metrics = metrics or SUMMARY_METRICS
    order = _global_stats(rows, metrics, cfg)
    robust = F.create_map(*[x for m, (med, mad) in order.items() for x in (F.lit(m), F.struct(F.lit(med).cast("double").alias("median"), F.lit(mad).cast("double").alias("mad")))])
    parts = {}
    for m, c in metrics.items():
        v = F.col(c).cast("double")
        parts[m] = F.struct(
            F.lit(m).alias("metric"), F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"),
            F.min(v).alias("min"), F.max(v).alias("max"),
        )
    one = rows.agg(F.array(*parts.values()).alias("m")).select(F.inline("m")).filter(F.col("n") > 0)
    out = one.withColumn("_r", robust[F.col("metric")])
    vals = {"median": F.col("_r.median"), "mad": F.col("_r.mad"), "mean": F.col("mean"), "std": F.col("std"), "min": F.col("min"), "max": F.col("max")}
    return out.select("metric", *[(py_round(c, 3) if rounded else c).alias(n) for n, c in vals.items()])


def _global_stats(rows: DataFrame, metrics: dict[str, str], cfg: Settings) -> dict:
    return global_median_and_mad(rows, {m: F.col(c).cast("double") for m, c in metrics.items()}, cfg.exact_group_rows)
