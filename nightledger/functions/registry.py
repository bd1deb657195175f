"""The spatial and robust helpers as SQL functions, for text predicates."""

from __future__ import annotations

from pyspark.sql import SparkSession

# SQL bodies mirror functions.spatial; they inline into the plan like any
# expression, so nothing leaves the JVM.
_SQL_FUNCTIONS = {
    "angsep": (
        "ra1 DOUBLE, dec1 DOUBLE, ra2 DOUBLE, dec2 DOUBLE",
        "degrees(2 * asin(sqrt(least(1D, greatest(0D, power(sin((radians(dec2) - radians(dec1)) / 2), 2) + "
        "cos(radians(dec1)) * cos(radians(dec2)) * power(sin((radians(ra2) - radians(ra1)) / 2), 2))))))",
        "DOUBLE",
    ),
    "mad": (
        "v ARRAY<DOUBLE>",
        # Median of the distances from the median; NULL elements do not count.
        "CASE WHEN size(filter(v, x -> x IS NOT NULL)) > 0 THEN element_at(transform(array(sort_array(filter(v, x -> x IS NOT NULL))), s -> "
        "element_at(transform(array(sort_array(transform(s, x -> abs(x - (s[(size(s) - 1) div 2] + s[size(s) div 2]) / 2)))), d -> (d[(size(d) - 1) div 2] + d[size(d) div 2]) / 2), 1)), 1) END",
        "DOUBLE",
    ),
    "wrap_ra": ("delta DOUBLE", "delta + 180 - 360 * floor((delta + 180) / 360) - 180", "DOUBLE"),
    "fov_contains": (
        "ra DOUBLE, dec DOUBLE, fov_w DOUBLE, fov_h DOUBLE, rotation DOUBLE, ra0 DOUBLE, dec0 DOUBLE",
        "coalesce("
        "abs((ra0 - ra + 180 - 360 * floor((ra0 - ra + 180) / 360) - 180) * cos(radians(dec)) * cos(radians(coalesce(rotation, 0D))) + (dec0 - dec) * sin(radians(coalesce(rotation, 0D)))) <= fov_w / 2 AND "
        "abs(-(ra0 - ra + 180 - 360 * floor((ra0 - ra + 180) / 360) - 180) * cos(radians(dec)) * sin(radians(coalesce(rotation, 0D))) + (dec0 - dec) * cos(radians(coalesce(rotation, 0D)))) <= fov_h / 2"
        ", false)",
        "BOOLEAN",
    ),
}


def register_sql_functions(spark: SparkSession) -> list[str]:
    """Create the functions for this session; returns their names."""
    for name, (params, body, result) in _SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({params}) RETURNS {result} RETURN {body}")
    return list(_SQL_FUNCTIONS)
