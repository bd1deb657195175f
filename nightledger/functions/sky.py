"""Observing conditions from time, position and site, as column math.

Low-precision published series (Astronomical Almanac style): the Sun to about
0.01 degree, the Moon to a few tenths, which is ample for screening frames.
No nutation, refraction or aberration.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nightledger.functions.numeric import floor_mod, py_round
from nightledger.functions.spatial import angsep
from nightledger.functions.text import capture_time

# Moon series terms (amplitude, phase at J2000, degrees per century).
MOON_LON = [
    (6.29, 135.0, 477198.87), (-1.27, 259.3, -413335.36), (0.66, 235.7, 890534.22),
    (0.21, 269.9, 954397.74), (-0.19, 357.5, 35999.05), (-0.11, 186.5, 966404.03),
]
MOON_LAT = [(5.13, 93.3, 483202.02), (0.28, 228.2, 960400.89), (-0.28, 318.3, 6003.15), (-0.17, 217.6, -407332.21)]
MOON_PARALLAX = [(0.0518, 135.0, 477198.87), (0.0095, 259.3, -413335.36), (0.0078, 235.7, 890534.22), (0.0028, 269.9, 954397.74)]


def _sin(x: Column) -> Column:
    return F.sin(F.radians(x))


def _cos(x: Column) -> Column:
    return F.cos(F.radians(x))


def _equatorial(lon: Column, lat: Column, eps: Column) -> tuple[Column, Column]:
    x, y, z = _cos(lat) * _cos(lon), _cos(lat) * _sin(lon), _sin(lat)
    ye, ze = y * _cos(eps) - z * _sin(eps), y * _sin(eps) + z * _cos(eps)
    return floor_mod(F.degrees(F.atan2(ye, x)), 360.0), F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), ze))))


def _altaz(ra: Column, dec: Column, lst: Column, lat: Column) -> tuple[Column, Column]:
    ha = lst - ra
    s = _sin(lat) * _sin(dec) + _cos(lat) * _cos(dec) * _cos(ha)
    alt = F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), s))))
    az = F.degrees(F.atan2(-_cos(dec) * _sin(ha), _sin(dec) * _cos(lat) - _cos(dec) * _sin(lat) * _cos(ha)))
    return alt, floor_mod(az, 360.0)


def with_sky_geometry(df: DataFrame, site: dict | None = None) -> DataFrame:
    """Fill altitude, azimuth, airmass, moon_sep, moon_illum and moon_alt.

    Uses site_lat / site_lon columns where present, else `site` (lat, lon).
    Any missing input leaves all six NULL.
    """
    site = site or {}

    def where(col: str, key: str) -> Column:
        fallback = F.lit(site.get(key)).cast("double")
        return F.coalesce(F.col(col), fallback) if col in df.columns else fallback

    work = df.withColumn("_t", capture_time(F.col("date_obs"))).withColumn("_lat", where("site_lat", "lat"))
    work = work.withColumn("_lon", where("site_lon", "lon"))
    epoch = F.lit("2000-01-01 12:00:00").cast("timestamp_ntz")
    days = F.timestamp_diff("MICROSECOND", epoch, F.col("_t")) / 86_400_000_000.0
    known = F.col("_t").isNotNull() & F.col("ra").isNotNull() & F.col("dec").isNotNull() & F.col("_lat").isNotNull() & F.col("_lon").isNotNull()
    work = work.withColumn("_d", F.when(known, days))

    # One withColumns per dependency level keeps every step inside codegen
    # without repeating the long series in each output.
    cent = F.col("_d") / 36525.0
    lst = floor_mod(280.46061837 + 360.98564736629 * F.col("_d") + F.col("_lon"), 360.0)
    # Stored positions are J2000; the hour angle wants the equinox of date.
    prec_ra = F.col("ra") + cent * (1.2812323 + 0.5567530 * _sin(F.col("ra")) * F.tan(F.radians(F.col("dec"))))
    prec_dec = F.col("dec") + cent * 0.5567530 * _cos(F.col("ra"))
    g = 357.528 + 0.9856003 * F.col("_d")
    sun_lon = 280.460 + 0.9856474 * F.col("_d") + 1.915 * _sin(g) + 0.020 * _sin(2 * g)

    def series(terms, fn) -> Column:
        total = F.lit(0.0)
        for amp, phase, rate in terms:
            total = total + amp * fn(phase + rate * cent)
        return total

    moon_lon = 218.32 + 481267.881 * cent + series(MOON_LON, _sin)
    work = work.withColumns({
        "_lst": lst, "_ra": prec_ra, "_dec": prec_dec, "_eps": 23.439 - 0.0000004 * F.col("_d"),
        "_sun": sun_lon, "_mlon": moon_lon, "_mlat": series(MOON_LAT, _sin),
        "_par": 0.9508 + series(MOON_PARALLAX, _cos),
    })
    sun_ra, sun_dec = _equatorial(F.col("_sun"), F.lit(0.0), F.col("_eps"))
    m_ra, m_dec = _equatorial(F.col("_mlon"), F.col("_mlat"), F.col("_eps"))
    work = work.withColumns({"_sra": sun_ra, "_sdec": sun_dec, "_mra": m_ra, "_mdec": m_dec})
    alt, az = _altaz(F.col("_ra"), F.col("_dec"), F.col("_lst"), F.col("_lat"))
    m_alt, _ = _altaz(F.col("_mra"), F.col("_mdec"), F.col("_lst"), F.col("_lat"))
    work = work.withColumns({"_alt": alt, "_az": az, "_malt": m_alt - F.col("_par") * _cos(m_alt)})
    airmass = F.when(F.col("_alt") > 3, 1.0 / _sin(F.col("_alt")))
    elongation = angsep(F.col("_sra"), F.col("_sdec"), F.col("_mra"), F.col("_mdec"))
    # Clamps inside the formulas skip NULL, so the inputs decide explicitly.
    values = {
        "altitude": py_round(F.col("_alt"), 2),
        "azimuth": py_round(F.col("_az"), 2),
        "airmass": F.when(airmass.between(0, 40), py_round(airmass, 3)),
        "moon_sep": py_round(angsep(F.col("_ra"), F.col("_dec"), F.col("_mra"), F.col("_mdec")), 2),
        "moon_illum": py_round((1.0 - _cos(elongation)) / 2.0, 3),
        "moon_alt": py_round(F.col("_malt"), 2),
    }
    out = work.withColumns({n: F.when(F.col("_d").isNotNull(), v) for n, v in values.items()})
    return out.drop(*[c for c in out.columns if c.startswith("_") and c not in df.columns])
