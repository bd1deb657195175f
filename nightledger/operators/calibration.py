"""Which light setups have darks, flats and bias frames that fit them.

Everything heavy is reduced map-side first: one aggregate by frame type,
matching keys and night.  Its rows are matched by windows over the keys that
two types share, so the report reads the frames once and joins nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nightledger.config import DEFAULTS, Settings
from nightledger.functions.numeric import nonzero, py_round
from nightledger.functions.text import night_date
from nightledger.sources.catalog import ok_frames

# The frame types that take part.
FRAME_TYPES = ["Light Frame", "Dark Frame", "Flat Frame", "Bias Frame"]

OPTICS = ["camera", "binning", "filter"]
READOUT = ["camera", "binning", "gain", "cam_offset"]
DARK_KEY = [*READOUT, "exposure_s"]
SETUP = [*DARK_KEY, "filter", "sensor_temp_c"]


def _keyed(frames: DataFrame) -> DataFrame:
    """Frames reduced to the matching keys."""
    return ok_frames(frames).filter(F.col("imagetyp").isin(FRAME_TYPES)).select(
        "imagetyp", "object", "exptime", "ccd_temp",
        F.coalesce(F.nullif(F.col("instrume"), F.lit("")), F.lit("Unknown camera")).alias("camera"),
        F.coalesce(nonzero(F.col("xbinning")), F.lit(1)).alias("binning"),
        py_round(F.col("gain"), 1).alias("gain"),
        F.rint(F.col("cam_offset").cast("double")).alias("cam_offset"),
        py_round(F.col("exptime"), 2).alias("exposure_s"),
        F.coalesce("filter", F.lit("")).alias("filter"),
        night_date(F.col("date_obs")).alias("night"),
    )


def _attach(left: DataFrame, right: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    r = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *values)
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return left.join(r, cond, "left").drop(*[f"_r_{k}" for k in keys])


def light_setups(frames: DataFrame) -> DataFrame:
    """Lights grouped by camera, binning, gain, offset, exposure, filter and
    sensor temperature (nearest degree)."""
    rows = _lights(frames)
    return rows.groupBy(*SETUP).agg(
        F.count(F.lit(1)).alias("frames"),
        F.sum(F.coalesce("exptime", F.lit(0.0))).alias("integration_sec"),
        F.count_distinct("night").alias("nights"),
        F.min("night").alias("first_night"),
        F.max("night").alias("last_night"),
    )


def _lights(frames: DataFrame) -> DataFrame:
    rows = _keyed(frames).filter(F.col("imagetyp") == "Light Frame")
    return rows.withColumn("sensor_temp_c", F.floor(F.rint("ccd_temp")))


def setup_objects(frames: DataFrame, top: int = 3) -> DataFrame:
    """The most photographed objects of each setup, ranked."""
    counted = _lights(frames).filter(F.coalesce("object", F.lit("")) != "").groupBy(*SETUP, "object").agg(F.count(F.lit(1)).alias("frames"))
    rank = F.row_number().over(Window.partitionBy(*SETUP).orderBy(F.col("frames").desc(), F.col("object")))
    return counted.withColumn("rank", rank).filter(F.col("rank") <= top)


# -- pools of calibration frames ----------------------------------------------------


def dark_pool(frames: DataFrame) -> DataFrame:
    """Darks per readout, exposure and exact sensor temperature."""
    rows = _keyed(frames).filter(F.col("imagetyp") == "Dark Frame")
    return rows.groupBy(*DARK_KEY, "ccd_temp").agg(F.count(F.lit(1)).alias("n"))


def flat_pool(frames: DataFrame) -> DataFrame:
    rows = _keyed(frames).filter(F.col("imagetyp") == "Flat Frame")
    return rows.groupBy(*OPTICS).agg(F.count(F.lit(1)).alias("flats"), F.count_distinct("night").alias("flat_nights"))


def bias_pool(frames: DataFrame) -> DataFrame:
    rows = _keyed(frames).filter(F.col("imagetyp") == "Bias Frame")
    return rows.groupBy(*READOUT).agg(F.count(F.lit(1)).alias("bias"))


# -- matching ------------------------------------------------------------------------


def with_darks(setups: DataFrame, darks: DataFrame, tolerance: float = DEFAULTS.cal_temp_tolerance) -> DataFrame:
    """Count the darks within the temperature tolerance of each setup.

    Setup temperatures are whole degrees, so each dark temperature lists the
    few whole degrees it fits and the range test becomes an equi-join.  A
    dark or a setup without a temperature fits any.
    """
    totals = darks.groupBy(*DARK_KEY).agg(F.sum("n").alias("_all"), F.sum(F.when(F.col("ccd_temp").isNull(), F.col("n"))).alias("_any"))
    t = F.col("ccd_temp")
    degrees = F.sequence(F.floor(t - tolerance), F.ceil(t + tolerance))
    fitting = darks.filter(t.isNotNull()).select(*DARK_KEY, "n", "ccd_temp", F.explode(degrees).alias("sensor_temp_c"))
    fitting = fitting.filter(F.abs(F.col("ccd_temp") - F.col("sensor_temp_c")) <= tolerance)
    at_degree = fitting.groupBy(*DARK_KEY, "sensor_temp_c").agg(F.sum("n").alias("_at"))
    out = _attach(_attach(setups, totals, DARK_KEY, ["_all", "_any"]), at_degree, [*DARK_KEY, "sensor_temp_c"], ["_at"])
    zero = F.lit(0).cast("long")
    near = F.coalesce("_at", zero) + F.coalesce("_any", zero)
    n = F.when(F.col("sensor_temp_c").isNull(), F.coalesce("_all", zero)).otherwise(near)
    return out.withColumn("darks", n).drop("_all", "_any", "_at")


def reduced(frames: DataFrame) -> DataFrame:
    """One row per frame type, the keys that matter to it, temperature and night; the other keys are NULL.

    Temperatures are whole degrees for lights and exact for darks.
    """
    rows, kind = _keyed(frames), F.col("imagetyp")
    light, dark, flat = (kind == t for t in FRAME_TYPES[:3])
    kept = {
        "gain": ~flat, "cam_offset": ~flat, "exposure_s": light | dark, "filter": light | flat, "night": light | flat,
        "sensor_temp_c": light, "dark_temp": dark, "exptime": light,
    }
    rows = rows.withColumns({"sensor_temp_c": F.floor(F.rint("ccd_temp")), "dark_temp": F.col("ccd_temp")})
    rows = rows.withColumns({c: F.when(use, F.col(c)) for c, use in kept.items()})
    return rows.groupBy("imagetyp", *SETUP, "dark_temp", "night").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("exptime", F.lit(0.0))).alias("integration_sec")
    )


def _with_flats(rows: DataFrame) -> DataFrame:
    """Adds to every light night of `reduced` rows the flats of its optical
    train and the days to the nearest night that has any.

    Nearest in both directions as the latest night so far and the earliest
    still to come; no pair of nights is ever formed.  One train's nights meet
    in one task, as many as the calendar and its setups make.
    """
    flat = F.col("imagetyp") == FRAME_TYPES[2]
    train = Window.partitionBy(*OPTICS)
    order = train.orderBy("night")
    flat_night = F.when(flat, F.col("night"))
    before = F.max(flat_night).over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    after = F.min(flat_night).over(order.rangeBetween(Window.currentRow, Window.unboundedFollowing))
    return rows.withColumns({
        "flats": F.coalesce(F.sum(F.when(flat, F.col("n"))).over(train), F.lit(0)),
        "_gap": F.least(F.date_diff(F.col("night"), before), F.date_diff(after, F.col("night"))),
    })


def flat_gaps(frames: DataFrame) -> DataFrame:
    """Per setup, the worst gap in days from a light night to its nearest flat."""
    nights = _with_flats(reduced(frames)).filter((F.col("imagetyp") == FRAME_TYPES[0]) & F.col("night").isNotNull())
    return nights.groupBy(*SETUP).agg(F.max("_gap").alias("flat_gap_days"))


def _with_bias_and_darks(rows: DataFrame, tolerance: float) -> DataFrame:
    """Adds to rows of lights, darks and bias frames the bias frames of their
    readout and the darks within the temperature tolerance.

    Each dark temperature lists the few whole degrees it fits, beside one row
    for setups without a temperature.  Both windows share the partitioning.
    """
    kind, t = F.col("imagetyp"), F.col("dark_temp")
    dark = kind == FRAME_TYPES[1]
    fits = F.filter(F.sequence(F.floor(t - tolerance), F.ceil(t + tolerance)), lambda d: F.abs(t - d) <= tolerance)
    degrees = F.when(dark, F.concat(F.array(F.lit(None).cast("long")), F.coalesce(fits, F.array().cast("array<bigint>"))))
    rows = rows.withColumn("sensor_temp_c", F.explode(F.coalesce(degrees, F.array("sensor_temp_c"))))
    whole = dark & F.col("sensor_temp_c").isNull()
    keyed = Window.partitionBy(*DARK_KEY)
    counted = {
        "bias": F.sum(F.when(kind == FRAME_TYPES[3], F.col("n"))).over(Window.partitionBy(*READOUT)),
        "_all": F.sum(F.when(whole, F.col("n"))).over(keyed), "_any": F.sum(F.when(whole & t.isNull(), F.col("n"))).over(keyed),
        "_at": F.sum(F.when(dark & ~whole, F.col("n"))).over(Window.partitionBy(*DARK_KEY, "sensor_temp_c")),
    }
    # Spread by the readout, whose keys all three windows hold: one shuffle for all of them.
    rows = rows.repartition(*READOUT).withColumns(counted)
    rows = rows.withColumns({c: F.coalesce(c, F.lit(0)) for c in counted})
    near = F.when(F.col("sensor_temp_c").isNull(), F.col("_all")).otherwise(F.col("_at") + F.col("_any"))
    return rows.withColumn("darks", near).drop("_all", "_any", "_at")


def calibration_setups(frames: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    """One row per light setup with what fits it; problems first, then the
    longest integration."""
    rows = _with_flats(reduced(frames)).groupBy("imagetyp", *SETUP, "dark_temp").agg(
        F.sum("n").alias("n"), F.sum("integration_sec").alias("integration_sec"), F.count("night").alias("nights"),
        F.min("night").alias("first_night"), F.max("night").alias("last_night"),
        F.max("flats").alias("flats"), F.max("_gap").alias("flat_gap_days"),
    )
    rows = _with_bias_and_darks(rows, cfg.cal_temp_tolerance).filter(F.col("imagetyp") == FRAME_TYPES[0])
    s = rows.select(*SETUP, F.col("n").alias("frames"), "integration_sec", "nights", "first_night", "last_night", "darks", "flats", "bias", "flat_gap_days")
    stale = F.coalesce(F.col("flat_gap_days") > cfg.cal_flat_max_days, F.lit(False))
    s = s.withColumns({
        "stale_flats": stale, "missing_darks": F.col("darks") == 0, "missing_flats": F.col("flats") == 0,
        "filter": F.nullif(F.col("filter"), F.lit("")),
    })
    fine = ~(F.col("missing_darks") | F.col("missing_flats") | F.col("stale_flats"))
    return s.orderBy(fine.asc(), F.col("integration_sec").desc(), *SETUP)


def problems_only(setups: DataFrame) -> DataFrame:
    return setups.filter(F.col("missing_darks") | F.col("missing_flats") | F.col("stale_flats"))


def with_missing_list(setups: DataFrame) -> DataFrame:
    names = F.array(F.when(F.col("missing_darks"), F.lit("darks")), F.when(F.col("missing_flats"), F.lit("flats")))
    return setups.withColumn("missing", F.array_compact(names))


def calibration_summary(setups: DataFrame) -> DataFrame:
    missing = F.col("missing_darks") | F.col("missing_flats")
    return setups.agg(
        F.count(F.lit(1)).alias("setups"),
        F.count_if(~missing & ~F.col("stale_flats")).alias("complete"),
        F.count_if("missing_darks").alias("missing_darks"),
        F.count_if("missing_flats").alias("missing_flats"),
        F.count_if("stale_flats").alias("stale_flats"),
        F.coalesce(F.sum(F.when(missing, F.col("integration_sec"))), F.lit(0.0)).alias("uncalibrated_integration_sec"),
    )


def calibration_frame_counts(frames: DataFrame) -> DataFrame:
    t = F.col("imagetyp")
    return ok_frames(frames).agg(
        F.count_if(t == "Dark Frame").alias("darks"), F.count_if(t == "Flat Frame").alias("flats"), F.count_if(t == "Bias Frame").alias("bias")
    )
