"""Plate solution from header keywords, for the tangent-plane projection.

Reads CRPIX1/2, CRVAL1/2 and either CD1_1..CD2_2 or CDELT1/2 with PC1_1..PC2_2
or CROTA2 (standard FITS celestial WCS, no distortion terms).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nightledger.functions.numeric import floor_mod, nonzero, py_round

_NUMBERS = [
    "CRPIX1", "CRPIX2", "CRVAL1", "CRVAL2", "CD1_1", "CD1_2", "CD2_1", "CD2_2", "CDELT1", "CDELT2",
    "PC1_1", "PC1_2", "PC2_1", "PC2_2", "CROTA2",
]
SOLUTION = ["solved", "wcs_ra", "wcs_dec", "wcs_scale", "wcs_rotation", "fov_w", "fov_h"]


def with_plate_solution(df: DataFrame) -> DataFrame:
    """Add the solution columns to a table with `cards`, naxis1 and naxis2.

    `solved` is 0 and the rest NULL without a usable solution.  Each step is
    a projection of its own, so no formula is repeated inside the next one.
    """
    c = F.col
    cards = c("cards")
    before = df.columns
    d = df.withColumns({f"_{k}": F.trim(cards[k]).try_cast("double") for k in _NUMBERS})
    celestial = F.upper(cards["CTYPE1"]).rlike("^(RA---|DEC--)") & F.upper(cards["CTYPE2"]).rlike("^(RA---|DEC--)")
    any_cd = F.coalesce(*[c(f"_{k}") for k in ("CD1_1", "CD1_2", "CD2_1", "CD2_2")]).isNotNull()
    any_pc = F.coalesce(*[c(f"_{k}") for k in ("PC1_1", "PC1_2", "PC2_1", "PC2_2")]).isNotNull()
    d = d.withColumns({
        "_celestial": F.coalesce(celestial, F.lit(False)), "_cd": any_cd, "_turned": ~any_pc & c("_CROTA2").isNotNull(),
        "_d1": F.coalesce("_CDELT1", F.lit(1.0)), "_d2": F.coalesce("_CDELT2", F.lit(1.0)), "_rot": F.radians("_CROTA2"),
        "_nx": nonzero(c("naxis1")), "_ny": nonzero(c("naxis2")),
    })

    def element(row: int, col: int, turned: Column) -> Column:
        step, unit = c(f"_d{row}"), F.lit(1.0 if row == col else 0.0)
        linear = F.when(c("_turned"), turned).otherwise(F.coalesce(c(f"_PC{row}_{col}"), unit) * step)
        return F.when(c("_cd"), F.coalesce(c(f"_CD{row}_{col}"), F.lit(0.0))).otherwise(linear)

    d = d.withColumns({
        "_m11": element(1, 1, c("_d1") * F.cos("_rot")), "_m12": element(1, 2, -c("_d2") * F.sin("_rot")),
        "_m21": element(2, 1, c("_d1") * F.sin("_rot")), "_m22": element(2, 2, c("_d2") * F.cos("_rot")),
        "_sized": c("_nx").isNotNull() & c("_ny").isNotNull(),
    })

    # The centre is looked up at pixel (n+1)/2 counted from zero, one past the
    # one-based middle; stored solutions follow that convention.
    def offset(n: str, ref: str) -> Column:
        at = F.when(c("_sized"), (c(n) + 1) / 2.0).otherwise(F.coalesce(c(ref), F.lit(1.0)))
        return at + 1.0 - F.coalesce(c(ref), F.lit(0.0))

    d = d.withColumns({"_px": offset("_nx", "_CRPIX1"), "_py": offset("_ny", "_CRPIX2")})
    d = d.withColumns({
        "_xi": F.radians(c("_m11") * c("_px") + c("_m12") * c("_py")), "_eta": F.radians(c("_m21") * c("_px") + c("_m22") * c("_py")),
        "_dec0": F.radians("_CRVAL2"),
        "_sx": F.sqrt(c("_m11") * c("_m11") + c("_m21") * c("_m21")), "_sy": F.sqrt(c("_m12") * c("_m12") + c("_m22") * c("_m22")),
    })
    # Inverse gnomonic projection about CRVAL.
    d = d.withColumn("_den", F.cos("_dec0") - c("_eta") * F.sin("_dec0"))
    d = d.withColumns({
        "_ra": floor_mod(c("_CRVAL1") + F.degrees(F.atan2("_xi", "_den")), 360.0),
        "_dec": F.degrees(F.atan2(F.sin("_dec0") + c("_eta") * F.cos("_dec0"), F.sqrt(c("_xi") * c("_xi") + c("_den") * c("_den")))),
        "_scale": (c("_sx") + c("_sy")) / 2.0 * 3600.0,
        "_pa": floor_mod(F.degrees(F.atan2("_m12", "_m22")), 360.0),
    })
    sound = ~F.isnan("_ra") & ~F.isnan("_dec") & (c("_scale") > 0) & (c("_scale") <= 3600)
    d = d.withColumn("_ok", c("_celestial") & F.coalesce(sound, F.lit(False)) & c("_ra").isNotNull() & c("_dec").isNotNull())

    def solved(value: Column) -> Column:
        return F.when(c("_ok"), value)

    return d.select(
        *[c(n) for n in before if n not in SOLUTION],
        F.when(c("_ok"), 1).otherwise(0).alias("solved"),
        solved(py_round(c("_ra"), 6)).alias("wcs_ra"),
        solved(py_round(c("_dec"), 6)).alias("wcs_dec"),
        solved(py_round(c("_scale"), 4)).alias("wcs_scale"),
        solved(py_round(c("_pa"), 3)).alias("wcs_rotation"),
        F.when(c("_ok") & c("_sized"), py_round(c("_sx") * c("_nx"), 5)).alias("fov_w"),
        F.when(c("_ok") & c("_sized"), py_round(c("_sy") * c("_ny"), 5)).alias("fov_h"),
    )
