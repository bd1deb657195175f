"""Frame-domain tables derived from the given test tables.

Each view is one list of (column, expression) whose text runs unchanged in
Spark and in DuckDB, so a query and its oracle start from equal rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nightledger.schema import TARGET_SCHEMA

_MEASURED = "event_id % 29 <> 0"


def _if_measured(expr: str) -> str:
    return f"CASE WHEN {_MEASURED} THEN {expr} END"


_RA = "CASE WHEN user_id % 4 = 0 THEN 359.5 ELSE CAST((user_id % 4) * 40 AS DOUBLE) END + CAST(event_id % 100 AS DOUBLE) / 200 - 0.25"
_DEC = "CAST((user_id % 4) * 20 - 10 AS DOUBLE) + CAST(event_id % 70 AS DOUBLE) / 100"
_HFR = "2 + CAST((event_id * 13) % 40 AS DOUBLE) / 100 + CASE WHEN event_id % 41 = 0 THEN 1.5 ELSE 0 END"

FRAME_EXPRESSIONS = [
    ("id", "event_id"),
    ("path", "concat('/lib/', event_type, CASE WHEN event_id % 17 = 0 THEN '/Reject/' ELSE '/good/' END, 'f', CAST(event_id AS STRING), CASE WHEN event_id % 5 = 0 THEN '.xisf' ELSE '.fits' END)"),
    ("filename", "concat('f', CAST(event_id AS STRING), CASE WHEN event_id % 5 = 0 THEN '.xisf' ELSE '.fits' END)"),
    ("watched_path_id", "CAST(event_id % 3 + 1 AS BIGINT)"),
    ("file_size", "CAST(1000 + event_id * 7 AS BIGINT)"),
    ("indexed_at", "ts"),
    ("file_mtime", "CASE WHEN event_id % 83 <> 0 THEN CAST(1700000000 + event_id AS DOUBLE) END"),
    ("thumbnail", "CASE WHEN event_id % 7 = 0 THEN concat('t', CAST(event_id AS STRING), '.jpg') END"),
    ("index_error", "CASE WHEN event_id % 101 = 0 THEN 'OSError: truncated' END"),
    ("imagetyp", "CASE WHEN event_id % 10 = 0 THEN 'Dark Frame' WHEN event_id % 10 = 1 THEN 'Flat Frame' WHEN event_id % 10 = 2 THEN 'Bias Frame' ELSE 'Light Frame' END"),
    ("object", "CASE WHEN event_id % 97 <> 0 THEN concat('OBJ ', CAST(user_id % 4 AS STRING)) END"),
    ("filter", "CASE event_type WHEN 'click' THEN 'L' WHEN 'view' THEN 'R' WHEN 'error' THEN 'Ha' WHEN 'signup' THEN 'OIII' END"),
    ("telescop", "concat('scope', CAST(user_id % 2 AS STRING))"),
    ("instrume", "concat('cam', CAST(user_id % 2 AS STRING))"),
    ("date_obs", "CASE WHEN event_id % 89 <> 0 THEN replace(CAST(ts AS STRING), ' ', 'T') END"),
    ("exptime", "CAST(CASE WHEN user_id % 4 < 2 THEN 300 ELSE 60 END AS DOUBLE)"),
    ("focal_length", "CAST(400 + user_id % 2 * 200 AS DOUBLE)"),
    ("gain", "CAST(100 AS DOUBLE)"),
    ("cam_offset", "CAST(50 AS INT)"),
    ("ccd_temp", "CASE WHEN event_id % 31 <> 0 THEN CAST(-10 + event_id % 5 AS DOUBLE) END"),
    ("set_temp", "CAST(-10 AS DOUBLE)"),
    ("xbinning", "CAST(1 AS INT)"),
    ("ybinning", "CAST(1 AS INT)"),
    ("naxis1", "CAST(6000 AS INT)"),
    ("naxis2", "CAST(4000 AS INT)"),
    ("bayer", "CASE WHEN user_id % 2 = 1 THEN 'RGGB' END"),
    ("star_count", "CAST(CASE WHEN event_id % 23 = 0 THEN 90 WHEN event_id % 29 <> 0 THEN 400 + (event_id * 37) % 50 END AS BIGINT)"),
    ("median_hfr", _if_measured(_HFR)),
    ("median_fwhm", f"CASE WHEN event_id % 29 <> 0 AND event_id % 43 <> 0 THEN ({_HFR}) * 1.5 END"),
    ("fwhm_arcsec", f"CASE WHEN event_id % 29 <> 0 AND event_id % 43 <> 0 THEN ({_HFR}) * 3 END"),
    ("eccentricity", _if_measured("0.3 + CAST((event_id * 7) % 50 AS DOUBLE) / 100")),
    ("trail_score", _if_measured("CAST((event_id * 11) % 60 AS DOUBLE) / 1000")),
    ("background_median", _if_measured("1000 + value")),
    ("pixel_scale", "2.0 + 0 * value"),
    ("quality_score", _if_measured("CAST(40 + CAST((event_id * 17) % 600 AS DOUBLE) / 10 AS DOUBLE)")),
    ("empty_cells", _if_measured("CAST((event_id * 3) % 20 AS DOUBLE) / 100")),
    ("bg_spread", _if_measured("3 + value / 100")),
    ("bg_dip", _if_measured("CAST((event_id * 7) % 30 AS DOUBLE) / 1000")),
    ("psf_fwhm", f"CASE WHEN event_id % 29 <> 0 AND event_id % 6 <> 0 THEN ({_HFR}) * 1.4 END"),
    ("psf_beta", "CASE WHEN event_id % 29 <> 0 AND event_id % 6 <> 0 THEN 2.5 + CAST(event_id % 20 AS DOUBLE) / 10 END"),
    ("star_flux", _if_measured("50000 - value * 20")),
    ("streaks", _if_measured("CAST(CASE WHEN event_id % 37 = 0 THEN 1 ELSE 0 END AS INT)")),
    ("altitude", "CASE WHEN event_id % 19 <> 0 THEN CAST(20 + event_id % 60 AS DOUBLE) END"),
    ("azimuth", "CASE WHEN event_id % 19 <> 0 THEN CAST(event_id % 360 AS DOUBLE) END"),
    ("airmass", "CASE WHEN event_id % 19 <> 0 THEN 1 + CAST(event_id % 90 AS DOUBLE) / 100 END"),
    ("moon_sep", "CASE WHEN event_id % 19 <> 0 THEN CAST(event_id % 180 AS DOUBLE) END"),
    ("moon_illum", "CASE WHEN event_id % 19 <> 0 THEN CAST(event_id % 101 AS DOUBLE) / 100 END"),
    ("moon_alt", "CASE WHEN event_id % 19 <> 0 THEN CAST(event_id % 120 AS DOUBLE) - 60 END"),
    ("solved", "CAST(CASE WHEN event_id % 3 <> 0 THEN 1 WHEN event_id % 6 = 0 THEN 0 END AS INT)"),
    ("wcs_ra", f"CASE WHEN event_id % 3 <> 0 THEN ({_RA}) + 0.0078125 END"),
    ("wcs_dec", f"CASE WHEN event_id % 3 <> 0 THEN ({_DEC}) - 0.0078125 END"),
    ("wcs_scale", "CASE WHEN event_id % 3 <> 0 THEN CAST(1.96875 AS DOUBLE) END"),
    ("wcs_rotation", "CASE WHEN event_id % 3 <> 0 THEN CAST(event_id % 360 AS DOUBLE) END"),
    ("fov_w", "CASE WHEN event_id % 3 = 1 THEN CAST(3.28125 AS DOUBLE) WHEN event_id % 33 = 0 THEN CAST(0 AS DOUBLE) END"),
    ("fov_h", "CASE WHEN event_id % 3 = 1 THEN CAST(2.1875 AS DOUBLE) WHEN event_id % 33 = 0 THEN CAST(0 AS DOUBLE) END"),
    ("coord_sep_arcmin", "CASE WHEN event_id % 3 <> 0 THEN CAST(event_id % 25 AS DOUBLE) / 2 END"),
    ("ra", _RA),
    ("dec", _DEC),
    ("rejected", "CAST(CASE WHEN event_id % 53 = 0 THEN 1 WHEN event_id % 59 = 0 THEN 0 END AS INT)"),
    ("header_json", "CASE WHEN event_id % 71 <> 0 THEN concat('{\"OBJECT\": \"OBJ ', CAST(user_id % 4 AS STRING), '\", \"SET-TEMP\": ', CASE WHEN event_id % 4 = 0 THEN '\"-10\"' WHEN event_id % 4 = 1 THEN '-10.5' ELSE '-15' END, ', \"EXPTIME\": ', CAST(event_id % 300 AS STRING), '}') END"),
    ("diagnostics_json", "CASE WHEN event_id % 13 = 0 THEN NULL WHEN event_id % 11 = 0 THEN '{\"v\":1,\"sample\":3}' ELSE concat('{\"v\":2,\"width\":6000,\"height\":4000,\"sample\":', CAST(event_id % 50 AS STRING), ',\"stars\":[[', CAST(event_id % 6000 AS STRING), ',10.5,2.0,1.5,30,0,1],[20.0,30.0,2.5,2.0,-10,3,0]]}') END"),
]

DETECTION_EXPRESSIONS = [
    ("frame_id", "l_suppkey"),
    ("x", "CAST((l_orderkey * 13 + l_partkey * 37 + l_linenumber * 911) % 6000 AS DOUBLE) + 0.5"),
    ("y", "CAST((l_orderkey * 7 + l_partkey * 101 + l_linenumber * 13) % 4000 AS DOUBLE) + 0.25"),
    ("a", "2 + l_discount * 10 + CASE WHEN l_linenumber = 7 THEN 3 ELSE 0 END"),
    ("b", "CASE WHEN l_linenumber = 7 THEN 1.5 ELSE (2 + l_discount * 10) / (1 + l_tax * 5) END"),
    ("theta", "CASE WHEN l_linenumber = 7 AND l_suppkey % 3 = 0 THEN 0.3 ELSE CAST((l_orderkey * 3 + l_linenumber * 29) % 314 AS DOUBLE) / 100 - 1.57 END"),
    ("flux", "CASE WHEN l_orderkey % 211 = 0 THEN -1.0 ELSE l_extendedprice END"),
    ("peak", "l_extendedprice / 2"),
    ("flag", "CAST(CASE WHEN l_quantity > 47 THEN 1 WHEN l_quantity = 1 THEN 2 ELSE 0 END AS INT)"),
    ("hfr", "CASE WHEN l_linenumber <> 3 THEN 1.5 + l_discount * 5 END"),
    ("hfr_flag", "CAST(CASE WHEN l_linenumber = 5 THEN 1 ELSE 0 END AS INT)"),
    ("psf_fwhm", "CASE WHEN l_linenumber % 2 = 0 THEN 3 + l_tax * 5 END"),
    ("psf_beta", "CASE WHEN l_linenumber % 2 = 0 THEN 2.5 + l_discount END"),
]

FRAME_INFO_EXPRESSIONS = [
    ("frame_id", "s_suppkey"),
    ("width", "CAST(6000 AS INT)"),
    ("height", "CAST(4000 AS INT)"),
    ("rms", "CASE WHEN s_suppkey % 13 = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(10 + s_nationkey AS DOUBLE) END"),
    ("sat_level", "CAST(30000 + (s_suppkey % 7) * 5000 AS DOUBLE)"),
    ("back_level", "CAST(1000 AS DOUBLE)"),
    ("back_median", "CAST(1000 + s_nationkey AS DOUBLE)"),
    ("streaks", "CAST(s_nationkey % 3 AS INT)"),
    ("bayer", "CASE WHEN s_nationkey % 2 = 1 THEN 'rggb ' END"),
    ("exptime", "CASE WHEN s_suppkey % 11 = 0 THEN 0.5 ELSE CAST(300 AS DOUBLE) END"),
    ("focal_length", "CAST(500 AS DOUBLE)"),
    ("xbinning", "CAST(1 AS INT)"),
    ("pixsz", "CASE WHEN s_suppkey % 17 = 0 THEN NULL ELSE CAST(3.75 AS DOUBLE) END"),
]

# One row per grid cell of each frame; i is the cell number.
BG_CELL_EXPRESSIONS = [
    ("frame_id", "s_suppkey"),
    ("row", "CAST(floor(i / 8) AS INT)"),
    ("col", "CAST(i % 8 AS INT)"),
    ("level", "CAST(1000 + (s_suppkey * 31 + i * 17) % 50 + i + CASE WHEN i = s_suppkey % 48 THEN 400 ELSE 0 END AS DOUBLE)"),
]

# Raw header cards per file, with the spellings cameras really write.
CARD_EXPRESSIONS = [
    ("IMAGETYP", "CASE WHEN event_id % 9 = 8 THEN '' WHEN event_id % 10 = 0 THEN 'DARK' WHEN event_id % 10 = 1 THEN 'Sky Flat' WHEN event_id % 10 = 2 THEN 'zero' WHEN event_id % 10 = 3 THEN ' Science ' WHEN event_id % 10 = 4 THEN 'Tri-Color' ELSE 'Light Frame' END"),
    ("FRAME", "CASE WHEN event_id % 9 = 8 THEN 'lframe' END"),
    ("FILTER", "CASE WHEN event_id % 8 = 0 THEN 'Luminance' WHEN event_id % 8 = 1 THEN 'h-alpha' WHEN event_id % 8 = 2 THEN 'O3' WHEN event_id % 8 = 3 THEN '4' WHEN event_id % 8 = 4 THEN ' ' WHEN event_id % 8 = 5 THEN 'SII' ELSE NULL END"),
    ("FILTER1", "CASE WHEN event_id % 8 = 7 THEN 'green' END"),
    ("EXPOSURE", "CASE WHEN event_id % 6 = 0 THEN 'abc' ELSE CAST(event_id % 600 AS STRING) END"),
    ("XBINNING", "CASE WHEN event_id % 5 = 0 THEN 'x' ELSE CAST(event_id % 3 AS STRING) END"),
    ("XPIXSZ", "CASE WHEN event_id % 7 = 0 THEN '0' ELSE '3.75' END"),
    ("FOCALLEN", "CASE WHEN event_id % 12 = 0 THEN NULL ELSE '500' END"),
    ("CCD-TEMP", "CASE WHEN event_id % 4 = 0 THEN NULL ELSE '-9.5' END"),
    ("SET-TEMP", "'-10'"),
    ("CTYPE1", "CASE WHEN event_id % 14 = 0 THEN NULL ELSE 'RA---TAN' END"),
    ("CTYPE2", "'DEC--TAN'"),
    ("CRPIX1", "'3000'"),
    ("CRPIX2", "'2000'"),
    ("CRVAL1", "CAST(event_id % 360 AS STRING)"),
    ("CRVAL2", "CAST(event_id % 140 - 70 AS STRING)"),
    ("CD1_1", "'-0.0008'"),
    ("CD1_2", "'0.0001'"),
    ("CD2_1", "'0.0001'"),
    ("CD2_2", "'0.0008'"),
    ("NAXIS1", "CASE WHEN event_id % 15 = 0 THEN NULL ELSE '6001' END"),
    ("NAXIS2", "CASE WHEN event_id % 15 = 0 THEN NULL ELSE '4001' END"),
]

# Runs: one per file, repeat and variant, from grouped line items.
RUN_EXPRESSIONS = [
    ("file", "concat('f', CAST(l_suppkey AS STRING))"),
    ("repeat", "l_linenumber"),
    ("variant", "CASE WHEN l_linestatus = 'O' THEN 'float32' ELSE 'float64' END"),
]

USER_TARGETS = [
    (1, "A", 359.9, -9.6, None),
    (2, "B", 0.1, -9.6, None),
    (3, "C", 40.0, 10.3, 1.5),
    (4, "D", 84.0, 33.0, 5.0),
    (5, "E", 200.0, -80.0, None),
]


def sql_view(expressions: list[tuple[str, str]], source: str) -> str:
    cols = ", ".join(f'{e} AS "{n}"' for n, e in expressions)
    return f"SELECT {cols} FROM {source}"


FRAMES_SQL = sql_view(FRAME_EXPRESSIONS, "events")
DETECTIONS_SQL = sql_view(DETECTION_EXPRESSIONS, "lineitem")
FRAME_INFO_SQL = sql_view(FRAME_INFO_EXPRESSIONS, "supplier")
BG_CELLS_SQL = sql_view(BG_CELL_EXPRESSIONS, "supplier, (SELECT range AS i FROM range(48)) AS cells")
CARDS_SQL = "SELECT event_id AS id, " + sql_view(CARD_EXPRESSIONS, "events")[7:]
TARGETS_SQL = " UNION ALL ".join(
    f"SELECT CAST({i} AS BIGINT) AS tid, '{n}' AS name, CAST({ra} AS DOUBLE) AS tra, CAST({dec} AS DOUBLE) AS tdec, CAST({'NULL' if r is None else r} AS DOUBLE) AS radius"
    for i, n, ra, dec, r in USER_TARGETS
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _derive(df: DataFrame, expressions: list[tuple[str, str]]) -> DataFrame:
    return df.selectExpr(*[f"{e} AS `{n}`" for n, e in expressions])


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The declared frame columns, all of them and in their types."""
    return _derive(table(spark, sf_dir, "events"), FRAME_EXPRESSIONS)


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derive(table(spark, sf_dir, "lineitem"), DETECTION_EXPRESSIONS)


def frame_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derive(table(spark, sf_dir, "supplier"), FRAME_INFO_EXPRESSIONS)


def bg_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = table(spark, sf_dir, "supplier").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(47))))
    return _derive(cells, BG_CELL_EXPRESSIONS)


def bg_blocks(spark: SparkSession, sf_dir: str, rows: int = 37, cols: int = 50) -> DataFrame:
    """Background maps of 800 x 600 frames: a gradient, and on every third
    frame a soft dark patch."""
    s = table(spark, sf_dir, "supplier")
    grid = s.withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(rows - 1)))).withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(cols - 1))))
    gx, gy = (F.col("col") - 22) / 8.0, (F.col("row") - 17) / 6.0
    patch = F.when(F.col("s_suppkey") % 3 == 0, 0.04 * F.exp(-(gx * gx) - gy * gy)).otherwise(0.0)
    noise = ((F.col("s_suppkey") * 7 + F.col("row") * 31 + F.col("col") * 17) % 11 - 5) * 0.2
    level = (1000 + 2.0 * F.col("col") + 1.0 * F.col("row")) * (1 - patch) + noise
    return grid.select(F.col("s_suppkey").alias("frame_id"), "row", "col", level.alias("level"))


def block_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame_info(spark, sf_dir).withColumns({"width": F.lit(800), "height": F.lit(600), "rms": F.lit(10.0)})


def headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = [x for n, e in CARD_EXPRESSIONS for x in (F.lit(n), F.expr(e))]
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.expr(FRAME_EXPRESSIONS[1][1]).alias("path"),
        (1700000000 + F.col("event_id")).cast("double").alias("mtime"), F.lit(1000).cast("long").alias("length"),
        F.create_map(*pairs).alias("cards"), F.lit(None).cast("string").alias("error"),
    )


def user_targets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(*t, None) for t in USER_TARGETS], TARGET_SCHEMA)


_RUN_METRICS = [
    ("star_count", "CAST(count(*) AS DOUBLE)"), ("median_hfr", "2 + avg(l_discount)"), ("median_fwhm", "4 + avg(l_tax)"),
    ("eccentricity", "0.5 + avg(l_tax)"), ("background_median", "avg(l_quantity) * 0 + 1000"),
]
_RUN_PHASES = [("read", "avg(l_quantity) / 100"), ("quality", "avg(l_extendedprice) / 1000"), ("total", "avg(l_extendedprice) / 900")]
_RUN_GROUPS = "l_suppkey, l_linenumber, l_linestatus"
RUNS_SQL = "SELECT " + ", ".join(f"{e} AS {n}" for n, e in [*RUN_EXPRESSIONS, *_RUN_METRICS, *_RUN_PHASES]) + f" FROM lineitem GROUP BY {_RUN_GROUPS}"


def bench_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_linenumber", "l_linestatus").agg(
        *[F.expr(e).alias(n) for n, e in [*_RUN_METRICS, *_RUN_PHASES]]
    )

    def as_map(names):
        return F.create_map(*[x for n, _ in names for x in (F.lit(n), F.col(n))])

    return flat.select(
        *[F.expr(e).alias(n) for n, e in RUN_EXPRESSIONS], as_map(_RUN_PHASES).alias("phase"), as_map(_RUN_METRICS).alias("metrics"),
        F.lit(False).alias("skipped"), F.lit(None).cast("string").alias("error"),
    )
