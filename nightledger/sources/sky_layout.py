"""The catalogue laid out by sky position, so that cones and point tests read few row groups.

The layout stores the effective position of a frame, the level of its field (as target matching has it) and its place on
a space-filling curve, and is clustered by level and curve.  Searches filter on the stored columns, which reach the scan,
and then apply the exact test to what is left, so the layout never changes a result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nightledger.config import DEFAULTS, Settings
from nightledger.functions.numeric import floor_mod
from nightledger.functions.scoring import effective_fov
from nightledger.functions.spatial import angsep, contains
from nightledger.schema import FRAME_SCHEMA

CURVE_BITS = 16
#: More than rounding can move a stored position.
_SLACK = 1e-6


def _position() -> tuple[Column, Column]:
    return F.coalesce("wcs_ra", "ra"), F.coalesce("wcs_dec", "dec")


def _field() -> tuple[Column, Column]:
    return effective_fov("fov_w", "naxis1", zero_is_missing=False), effective_fov("fov_h", "naxis2", zero_is_missing=False)


def _steps(x: Column, span: float) -> Column:
    """x in [0, span] as a whole number of CURVE_BITS bits; what lies outside goes to the ends."""
    last = (1 << CURVE_BITS) - 1
    return F.greatest(F.lit(0), F.least(F.lit(last), F.floor(x / span * (last + 1)))).cast("long")


def sky_curve(ra: Column, dec: Column) -> Column:
    """Place on the Z-order curve through right ascension and declination; NULL without a position."""
    x, y = _steps(ra, 360.0), _steps(dec + 90.0, 180.0)
    code = F.lit(0).cast("long")
    for bit in range(CURVE_BITS):
        for shift, axis in ((bit, x), (bit + 1, y)):
            code = code.bitwiseOR(F.shiftleft(axis.bitwiseAND(F.lit(1 << bit)), shift))
    return F.when(ra.isNotNull() & dec.isNotNull(), code)


def with_sky(frames: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    """Adds sky_ra (0 to 360), sky_dec, field_level and sky_curve.

    A level's fields reach at most its size from their centre, the last level's any distance; an unknown field or position
    has no level.
    """
    (ra, dec), (w, h) = _position(), _field()
    reach = F.sqrt(w * w + h * h) / 2
    level = F.coalesce(*[F.when(reach <= size, F.lit(i)) for i, size in enumerate(cfg.sky_levels_deg[:-1])], F.lit(len(cfg.sky_levels_deg) - 1))
    out = frames.withColumns({"sky_ra": floor_mod(ra, 360.0), "sky_dec": dec})
    return out.withColumns({
        "field_level": F.when(reach.isNotNull() & F.col("sky_ra").isNotNull() & F.col("sky_dec").isNotNull(), level),
        "sky_curve": sky_curve(F.col("sky_ra"), F.col("sky_dec")),
    })


def write_by_sky(frames: DataFrame, path: str, files: int | None = None, mode: str = "overwrite", cfg: Settings = DEFAULTS) -> None:
    """Write the catalogue clustered by sky.  Range partitioning splits a much visited field over several files; the id keeps
    equal places apart."""
    by = ["field_level", "sky_curve", "id"]
    staged = with_sky(frames, cfg)
    staged = staged.repartitionByRange(files, *by) if files else staged.repartitionByRange(*by)
    staged.sortWithinPartitions(*by).write.mode(mode).parquet(path)


def read_by_sky(spark: SparkSession, path: str) -> DataFrame:
    extra = "sky_ra double, sky_dec double, field_level int, sky_curve bigint"
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in FRAME_SCHEMA.fields), extra])
    return spark.read.schema(schema).parquet(path)


def _near(ra: float, dec: float, dec_reach: float, ra_reach: float) -> Column:
    """Stored positions within a box around a position; a test of plain comparisons, which the scan understands."""
    test = F.col("sky_dec").between(dec - dec_reach, dec + dec_reach)
    if ra_reach >= 180:
        return test
    # At the seam 360 itself may be what a tiny negative angle was rounded to.
    low, high, stored = (ra - ra_reach) % 360, (ra + ra_reach) % 360, F.col("sky_ra")
    inside = stored.between(low, high) if low <= high else (stored >= low) | (stored <= high)
    return test & inside


def _ra_reach(dec: float, reach: float) -> float:
    edge = abs(dec) + reach
    return 180.0 if edge >= 89.9 else reach / math.cos(math.radians(edge))


def stored_cone(sky: DataFrame, ra: float, dec: float, radius: float) -> DataFrame:
    """Frames whose effective centre lies within the radius, from a table with sky columns."""
    reach = radius + _SLACK
    return sky.filter(_near(ra, dec, reach, _ra_reach(dec, reach))).filter(angsep(*_position(), ra, dec) <= radius)


def stored_covering(sky: DataFrame, ra: float, dec: float, cfg: Settings = DEFAULTS) -> DataFrame:
    """Frames whose field covers the position, from a table with sky columns: each level is searched as far as its fields reach."""
    sizes = cfg.sky_levels_deg
    test = F.col("field_level") == len(sizes) - 1
    for i, size in enumerate(sizes[:-1]):
        reach = size + _SLACK
        test = test | ((F.col("field_level") == i) & _near(ra, dec, reach, _ra_reach(dec, reach)))
    return sky.filter(test).filter(contains(*_position(), *_field(), F.col("wcs_rotation"), ra, dec))
