"""Declared schemas.  Field descriptions travel in the column metadata.

`cam_offset` is the camera's OFFSET setting; the plain word is reserved in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_L, _D, _S, _I, _TS = T.LongType(), T.DoubleType(), T.StringType(), T.IntegerType(), T.TimestampNTZType()

# name, type, description
_FRAME_FIELDS = [
    ("id", _L, "stable frame id"),
    ("path", _S, "full path of the image file"),
    ("filename", _S, "file name"),
    ("watched_path_id", _L, "library root the file was found under"),
    ("file_size", _L, "bytes"),
    ("indexed_at", _TS, "when the row was written, UTC"),
    ("file_mtime", _D, "file modification time, epoch seconds"),
    ("thumbnail", _S, "thumbnail file name"),
    ("index_error", _S, "set on tombstones: why the file could not be read"),
    ("star_count", _L, "detected sources"),
    ("median_hfr", _D, "median half-flux radius, px"),
    ("median_fwhm", _D, "median FWHM, px"),
    ("fwhm_arcsec", _D, "median FWHM, arcsec"),
    ("eccentricity", _D, "median eccentricity, 0 = round"),
    ("trail_score", _D, "coherent trailing, 0-1"),
    ("background_median", _D, "median background level"),
    ("pixel_scale", _D, "arcsec per px from the header optics"),
    ("quality_score", _D, "heuristic grade, 0-100"),
    ("empty_cells", _D, "share of the grid in the largest starless patch"),
    ("bg_spread", _D, "p90-p10 of the cell backgrounds, in background rms"),
    ("bg_dip", _D, "deepest soft dark patch, fraction of the background"),
    ("psf_fwhm", _D, "median profile-fit FWHM, px"),
    ("psf_beta", _D, "median profile-fit wing exponent"),
    ("star_flux", _D, "typical flux of the brighter stars"),
    ("streaks", _I, "satellite or aircraft streaks"),
    ("diagnostics_json", _S, "per-star and per-cell diagnostics"),
    ("altitude", _D, "target altitude, deg"),
    ("azimuth", _D, "target azimuth, deg"),
    ("airmass", _D, "airmass"),
    ("moon_sep", _D, "moon separation, deg"),
    ("moon_illum", _D, "illuminated fraction of the moon"),
    ("moon_alt", _D, "moon altitude, deg"),
    ("solved", _I, "1 when plate-solved"),
    ("wcs_ra", _D, "solved centre RA, deg"),
    ("wcs_dec", _D, "solved centre dec, deg"),
    ("wcs_scale", _D, "solved scale, arcsec per px"),
    ("wcs_rotation", _D, "solved rotation, deg"),
    ("fov_w", _D, "solved field width, deg"),
    ("fov_h", _D, "solved field height, deg"),
    ("coord_sep_arcmin", _D, "solved centre vs. header pointing, arcmin"),
    ("bayer", _S, "colour-filter pattern, empty for mono"),
    ("rejected", _I, "grade: 1 rejected, 0 accepted, NULL unmarked"),
    ("object", _S, "target name"),
    ("imagetyp", _S, "Light Frame, Dark Frame, Flat Frame, Bias Frame, ..."),
    ("date_obs", _S, "exposure start, ISO text as written by the camera"),
    ("exptime", _D, "exposure, s"),
    ("focal_length", _D, "mm"),
    ("telescop", _S, "telescope"),
    ("instrume", _S, "camera"),
    ("filter", _S, "filter"),
    ("ra", _D, "header pointing RA, deg"),
    ("dec", _D, "header pointing dec, deg"),
    ("gain", _D, "camera gain"),
    ("cam_offset", _I, "camera offset"),
    ("ccd_temp", _D, "sensor temperature, C"),
    ("set_temp", _D, "cooler setpoint, C"),
    ("xbinning", _I, "binning, x"),
    ("ybinning", _I, "binning, y"),
    ("naxis1", _I, "width, px"),
    ("naxis2", _I, "height, px"),
    ("header_json", _S, "every header card as a JSON object"),
]

FRAME_SCHEMA = T.StructType(
    [T.StructField(n, t, True, {"description": d}) for n, t, d in _FRAME_FIELDS]
)
FRAME_COLUMNS = FRAME_SCHEMA.fieldNames()

# Smaller tables, as DDL text.
TARGET_SCHEMA = "id long, name string, ra double, dec double, radius_deg double, notes string"
GRADE_SCHEMA = "frame_id long, grade int, ts timestamp_ntz"
SAVED_QUERY_SCHEMA = "id long, name string, folder string, query_json string"
LISTING_SCHEMA = "path string, mtime double, length long"
HEADER_SCHEMA = "path string, mtime double, length long, cards map<string,string>, error string"

METRIC_COLUMNS = [f.name for f in FRAME_SCHEMA if isinstance(f.dataType, T.DoubleType)]


def conform(df: DataFrame) -> DataFrame:
    """Bring any frame table to the declared schema: missing columns become
    NULL, types are cast, NaN becomes NULL."""
    have = set(df.columns)
    cols = []
    for f in FRAME_SCHEMA:
        if f.name not in have:
            c = F.lit(None).cast(f.dataType)
        else:
            c = F.col(f.name)
            if df.schema[f.name].dataType != f.dataType:
                c = c.cast(f.dataType)
            if isinstance(f.dataType, T.DoubleType) and df.schema[f.name].dataType in (T.DoubleType(), T.FloatType()):
                c = F.when(~F.isnan(c), c)
        cols.append(c.alias(f.name, metadata=f.metadata))
    return df.select(*cols)
