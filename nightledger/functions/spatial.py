"""Sky geometry as column math (degrees in, degrees out)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from nightledger.functions.numeric import floor_mod, py_round


def _c(v) -> Column:
    return v if isinstance(v, Column) else F.lit(float(v))


def angsep(ra1, dec1, ra2, dec2) -> Column:
    """Great-circle separation by the haversine formula."""
    ra1, dec1, ra2, dec2 = map(_c, (ra1, dec1, ra2, dec2))
    d1, d2 = F.radians(dec1), F.radians(dec2)
    hav = F.pow(F.sin((d2 - d1) / 2), F.lit(2.0)) + F.cos(d1) * F.cos(d2) * F.pow(
        F.sin((F.radians(ra2) - F.radians(ra1)) / 2), F.lit(2.0)
    )
    # least() skips NULL, so unknown inputs are ruled out by name.
    known = ra1.isNotNull() & dec1.isNotNull() & ra2.isNotNull() & dec2.isNotNull()
    return F.when(known, F.degrees(2 * F.asin(F.sqrt(F.least(F.lit(1.0), hav)))))


def coord_sep_arcmin(ra1, dec1, ra2, dec2) -> Column:
    """Separation in arcminutes, three decimals; NULL when any input is."""
    return py_round(angsep(ra1, dec1, ra2, dec2) * 60.0, 3)


def contains(ra, dec, fov_w, fov_h, rotation, ra0, dec0) -> Column:
    """Does the (possibly rotated) field of view cover the position?

    Offsets are taken in the plane tangent at the frame: RA wraps at 180
    degrees and shrinks with the frame's own declination.  No rotation means
    axis-aligned; an unknown field of view never covers anything.
    """
    ra, dec, ra0, dec0 = map(_c, (ra, dec, ra0, dec0))
    dra = (floor_mod(ra0 - ra + 180.0, 360.0) - 180.0) * F.cos(F.radians(dec))
    ddec = dec0 - dec
    rot = F.radians(F.coalesce(rotation, F.lit(0.0)))
    x = dra * F.cos(rot) + ddec * F.sin(rot)
    y = -dra * F.sin(rot) + ddec * F.cos(rot)
    return F.coalesce((F.abs(x) <= fov_w / 2) & (F.abs(y) <= fov_h / 2), F.lit(False))


# -- sky grid --------------------------------------------------------------
#
# Cells are dec bands of `band` degrees, each cut into as many RA cells as
# keep a cell about `band` degrees wide at the band edge nearer the equator.


def _band(dec: Column, band: float) -> Column:
    return F.floor(dec / F.lit(band)).cast("long")


def _ra_cells(b: Column, band: float) -> Column:
    near = F.least(F.abs(b * F.lit(band)), F.abs((b + 1) * F.lit(band)))
    return F.greatest(F.lit(1), F.floor(360.0 * F.cos(F.radians(F.least(near, F.lit(90.0)))) / band)).cast("long")


def sky_cell(ra: Column, dec: Column, band: float) -> Column:
    """Grid cell of a position, as (band, cell) packed in one long."""
    b = _band(dec, band)
    n = _ra_cells(b, band)
    k = F.floor(floor_mod(ra, 360.0) * n / 360.0).cast("long")
    return b * F.lit(1 << 20) + F.least(k, n - 1)


def sky_cells_around(ra: Column, dec: Column, dec_reach: Column, ra_reach: Column, band: float) -> Column:
    """Every cell meeting the box dec +- dec_reach, ra +- ra_reach.

    A reach of 180 degrees or more in RA takes the whole band.  The array is
    bounded by the number of cells on the sky.
    """
    lo = F.greatest(F.floor((dec - dec_reach) / band), F.floor(F.lit(-90.0 / band))).cast("long")
    hi = F.least(F.floor((dec + dec_reach) / band), F.floor(F.lit(90.0 / band))).cast("long")
    ra_in = floor_mod(ra, 360.0)

    def one_band(b: Column) -> Column:
        n = _ra_cells(b, band)
        width = F.lit(360.0) / n
        first = F.floor((ra_in - ra_reach) / width).cast("long")
        last = F.floor((ra_in + ra_reach) / width).cast("long")
        everything = (ra_reach >= 180.0) | (last - first + 1 >= n)
        first = F.when(everything, F.lit(0).cast("long")).otherwise(first)
        last = F.when(everything, n - 1).otherwise(last)
        return F.transform(F.sequence(first, last), lambda k: b * F.lit(1 << 20) + F.pmod(k, n))

    # A centre beyond the poles' bands (bad declination) reaches no cell.
    return F.when(hi >= lo, F.flatten(F.transform(F.sequence(lo, F.greatest(lo, hi)), one_band)))
