"""Queries: listing and upkeep, derived columns, documents, paging, sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nightledger.functions import scoring, sky, text
from nightledger.functions.spatial import coord_sep_arcmin
from nightledger.operators import fields, paging
from nightledger.operators.selector import candidates, select_frames
from nightledger.plans import portable
from nightledger.plans.registry import frames_query, longs, query, r6, rounded, with_ctes, with_frames
from nightledger.schema import SAVED_QUERY_SCHEMA
from nightledger.sources import catalog, headers, library, sinks

LIGHT = "imagetyp = 'Light Frame'"


# -- scans and listing --------------------------------------------------------------------


@frames_query("catalogue_list_view", " SELECT id, path, object, CAST(star_count AS DOUBLE) AS star_count, round(quality_score, 6) AS quality_score FROM frames WHERE index_error IS NULL")
def _list_view(frames):
    rows = catalog.list_view(catalog.ok_frames(frames))
    return rows.select("id", "path", "object", F.col("star_count").cast("double").alias("star_count"), r6("quality_score", "quality_score"))


# The listing sees most known files, some touched since, and some new ones.
_LISTING = [
    ("path", "CASE WHEN event_id % 20 = 3 THEN concat('/lib/new/f', CAST(event_id AS STRING), '.fits') ELSE " + portable.FRAME_EXPRESSIONS[1][1] + " END"),
    ("mtime", "CAST(1700000000 + event_id AS DOUBLE) + CASE WHEN event_id % 9 = 1 THEN 0.75 WHEN event_id % 9 = 2 THEN 5 ELSE 0 END"),
    ("length", "CAST(1000 + event_id * 7 AS BIGINT)"),
]
_LISTING_SQL = portable.sql_view(_LISTING, "events WHERE event_id % 25 <> 7")
_CHANGE = "CASE WHEN f.path IS NULL THEN 'new' WHEN coalesce(f.file_mtime, 0) <> 0 AND abs(l.mtime - f.file_mtime) > 1 THEN 'changed' ELSE 'unchanged' END"


def _listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = portable.table(spark, sf_dir, "events").filter("event_id % 25 <> 7")
    return rows.select(*[F.expr(e).alias(n) for n, e in _LISTING])


@query("listing_changes", with_frames(f"SELECT l.path, {_CHANGE} AS change FROM listing l LEFT JOIN frames f ON f.path = l.path", ("listing", _LISTING_SQL)))
def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.diff_listing(_listing(spark, sf_dir), portable.frames(spark, sf_dir)).select("path", "change")


@query("prune_missing", with_frames("SELECT id FROM frames WHERE path IN (SELECT path FROM listing)", ("listing", _LISTING_SQL)))
def _prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.prune_missing(portable.frames(spark, sf_dir), _listing(spark, sf_dir)).select("id")


@query(
    "reindex_merge",
    with_frames(
        f"SELECT f.path, f.file_mtime, 'kept' AS origin FROM frames f WHERE f.path NOT IN (SELECT path FROM d WHERE change <> 'unchanged') UNION ALL SELECT path, max(mtime), 'read' FROM d WHERE change <> 'unchanged' GROUP BY path",
        ("listing", _LISTING_SQL), ("d", f"SELECT l.path, l.mtime, {_CHANGE} AS change FROM listing l LEFT JOIN frames f ON f.path = l.path"),
    ),
)
def _merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = portable.frames(spark, sf_dir)
    due = library.to_index(library.diff_listing(_listing(spark, sf_dir), old))
    fresh = library.tombstones(due.withColumn("error", F.lit("read again")))
    # A batch delivered twice leaves one row per path.
    twice = fresh.withColumn("delivery", F.explode(F.array(F.lit(1), F.lit(2)))).drop("delivery")
    merged = library.merge_frames(old, twice)
    return merged.select("path", "file_mtime", F.when(F.col("index_error") == "read again", "read").otherwise("kept").alias("origin"))


@frames_query("tombstone_rows", " SELECT path, substr(repeat(concat('bad ', path, ' '), 60), 1, 500) AS index_error FROM frames WHERE index_error IS NOT NULL")
def _tombstones(frames):
    bad = frames.filter(F.col("index_error").isNotNull())
    error = F.repeat(F.concat(F.lit("bad "), "path", F.lit(" ")), F.lit(60))
    return library.tombstones(bad.select("path", F.col("file_mtime").alias("mtime"), error.alias("error"))).select("path", "index_error")


@frames_query("refused_duplicates", " SELECT path, count(*) - 1 AS refused FROM (SELECT path FROM frames UNION ALL SELECT path FROM frames WHERE id % 7 = 0) GROUP BY path HAVING count(*) > 1")
def _refused(frames):
    return library.unique_paths(frames.unionByName(frames.filter(F.col("id") % 7 == 0)))[1]


@frames_query(
    "refused_known_paths",
    " SELECT path, n - CASE WHEN known THEN 0 ELSE 1 END AS refused FROM (SELECT n.path, count(*) AS n, bool_or(n.path IN (SELECT path FROM frames WHERE id % 5 = 0)) AS known "
    "FROM (SELECT path FROM frames WHERE id % 2 = 0 UNION ALL SELECT path FROM frames WHERE id % 6 = 0) n GROUP BY n.path) WHERE n > 1 OR known",
)
def _refused_known(frames):
    """A batch with repeated paths, appended to a catalogue that has some of them."""
    batch = frames.filter(F.col("id") % 2 == 0).unionByName(frames.filter(F.col("id") % 6 == 0))
    return library.refused_rows(batch, frames.filter(F.col("id") % 5 == 0))


@frames_query(
    "set_temp_backfill",
    " SELECT id, CASE WHEN id % 3 = 0 THEN -10.0 WHEN json_type(header_json, '$.\"SET-TEMP\"') IN ('BIGINT', 'UBIGINT', 'DOUBLE') THEN CAST(json_extract_string(header_json, '$.\"SET-TEMP\"') AS DOUBLE) END AS set_temp FROM frames",
)
def _backfill(frames):
    blank = frames.withColumn("set_temp", F.when(F.col("id") % 3 == 0, F.lit(-10.0)))
    return catalog.backfill_set_temp(blank).select("id", "set_temp")


@frames_query("evolve_schema", " SELECT id, CASE WHEN id % 2 = 1 THEN bg_dip END AS bg_dip FROM frames")
def _evolve(frames):
    old = frames.filter(F.col("id") % 2 == 0).drop("bg_dip")
    return catalog.evolve(old, frames.filter(F.col("id") % 2 == 1)).select("id", "bg_dip")


@frames_query("needs_analysis", f" SELECT id FROM frames WHERE {LIGHT} AND (median_hfr IS NULL OR altitude IS NULL OR trail_score IS NULL OR diagnostics_json IS NULL OR diagnostics_json NOT LIKE '{{\"v\":2,%')")
def _needs(frames):
    return catalog.needs_analysis(frames).select("id")


@frames_query("unsolved_frames", f" SELECT id FROM frames WHERE {LIGHT} AND coalesce(solved, 0) = 0")
def _unsolved(frames):
    return catalog.unsolved(frames).select("id")


@frames_query("metric_update", " SELECT id, CASE WHEN id % 5 = 0 THEN CASE WHEN id % 10 = 0 THEN NULL ELSE 9.5 END ELSE round(median_hfr, 6) END AS median_hfr, star_count FROM frames")
def _update(frames):
    new = frames.filter(F.col("id") % 5 == 0).select("id", F.when(F.col("id") % 10 != 0, F.lit(9.5)).alias("median_hfr"))
    return rounded(catalog.update_metrics(frames, new).select("id", "median_hfr", F.col("star_count")), "median_hfr").withColumn("star_count", F.col("star_count").cast("double"))


@query("random_lights", with_frames(
    f"SELECT path FROM frames WHERE {LIGHT} AND path IN (SELECT path FROM listing) ORDER BY md5(concat('0', path)), path LIMIT 10", ("listing", _LISTING_SQL)
))
def _random(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.random_lights(portable.frames(spark, sf_dir), _listing(spark, sf_dir), 10)


@frames_query("drop_library_root", " SELECT id FROM frames WHERE watched_path_id <> 2")
def _drop(frames):
    gone = frames.select(F.col("watched_path_id").alias("id")).distinct().filter("id = 2")
    return catalog.drop_roots(frames, gone).select("id")


# Three rounds of grading; the last word of a frame may be "unmark" (NULL).
_GRADES = (
    "SELECT event_id AS frame_id, CAST(1 AS INT) AS grade, ts FROM events WHERE event_id % 4 = 0 UNION ALL "
    "SELECT event_id, CAST(0 AS INT), ts + INTERVAL 1 DAY FROM events WHERE event_id % 6 = 0 UNION ALL "
    "SELECT event_id, CAST(NULL AS INT), ts + INTERVAL 2 DAY FROM events WHERE event_id % 24 = 0"
)


@query(
    "graded_frames",
    with_frames(
        "SELECT f.id, CAST(CASE WHEN g.frame_id IS NOT NULL THEN g.grade ELSE f.rejected END AS DOUBLE) AS rejected FROM frames f LEFT JOIN last g ON g.frame_id = f.id",
        ("grades", _GRADES), ("last", "SELECT * FROM grades QUALIFY row_number() OVER (PARTITION BY frame_id ORDER BY ts DESC) = 1"),
    ),
)
def _graded(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = portable.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "ts")
    day = F.expr("INTERVAL 1 DAY")
    log = catalog.grade_event(e.filter("id % 4 = 0").select("id", "ts"), "rejected", F.col("ts"))
    log = log.unionByName(catalog.grade_event(e.filter("id % 6 = 0"), "accepted", F.col("ts") + day))
    log = log.unionByName(catalog.grade_event(e.filter("id % 24 = 0"), None, F.col("ts") + day + day))
    out = catalog.apply_grades(portable.frames(spark, sf_dir), log)
    return out.select("id", F.col("rejected").cast("double").alias("rejected"))


# -- headers ------------------------------------------------------------------------------------

# Fixed values, written out here so that the check does not lean on the code's own tables.
_TYPE_NAMES = [
    ("light", "Light Frame"),
    ("light frame", "Light Frame"),
    ("lframe", "Light Frame"),
    ("science", "Light Frame"),
    ("dark", "Dark Frame"),
    ("dark frame", "Dark Frame"),
    ("dframe", "Dark Frame"),
    ("flat", "Flat Frame"),
    ("flat frame", "Flat Frame"),
    ("flat field", "Flat Frame"),
    ("sky flat", "Flat Frame"),
    ("bias", "Bias Frame"),
    ("bias frame", "Bias Frame"),
    ("offset", "Bias Frame"),
    ("zero", "Bias Frame"),
]
_FILTER_NAMES = [
    ("l", "L"),
    ("lum", "L"),
    ("luminance", "L"),
    ("r", "R"),
    ("red", "R"),
    ("g", "G"),
    ("green", "G"),
    ("b", "B"),
    ("blue", "B"),
    ("h", "Ha"),
    ("ha", "Ha"),
    ("halpha", "Ha"),
    ("h-alpha", "Ha"),
    ("h_alpha", "Ha"),
    ("h-a", "Ha"),
    ("o", "OIII"),
    ("o3", "OIII"),
    ("oiii", "OIII"),
    ("o-iii", "OIII"),
    ("s", "SII"),
    ("s2", "SII"),
    ("sii", "SII"),
    ("s-ii", "SII"),
    ("clear", "Clear"),
]
_TYPE = (
    "CASE lower(trim(t)) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _TYPE_NAMES) + " ELSE trim(t) END"
)
_FILTER = "CASE lower(trim(f)) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _FILTER_NAMES) + " ELSE nullif(trim(f), '') END"


@query(
    "header_fields",
    with_ctes(
        f"SELECT id, {_TYPE} AS imagetyp, {_FILTER} AS filter, TRY_CAST(\"EXPOSURE\" AS DOUBLE) AS exptime, CAST(TRY_CAST(\"XBINNING\" AS INT) AS DOUBLE) AS xbinning, "
        "CAST(coalesce(\"CCD-TEMP\", \"SET-TEMP\") AS DOUBLE) AS ccd_temp, CAST(\"SET-TEMP\" AS DOUBLE) AS set_temp, CAST(\"CRVAL1\" AS DOUBLE) AS ra, CAST(\"CRVAL2\" AS DOUBLE) AS dec "
        "FROM (SELECT *, coalesce(nullif(\"IMAGETYP\", ''), \"FRAME\") AS t, coalesce(nullif(\"FILTER\", ''), \"FILTER1\") AS f FROM c)",
        ("c", portable.CARDS_SQL),
    ),
)
def _header_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = headers.normalize_headers(portable.headers(spark, sf_dir))
    return out.select("id", "imagetyp", "filter", "exptime", F.col("xbinning").cast("double").alias("xbinning"), "ccd_temp", "set_temp", "ra", "dec")


@query(
    "header_pixel_scale",
    with_ctes(
        "SELECT id, round(CASE WHEN CAST(\"XPIXSZ\" AS DOUBLE) <> 0 THEN 206.265 * CAST(\"XPIXSZ\" AS DOUBLE) * coalesce(nullif(TRY_CAST(\"XBINNING\" AS INT), 0), 1) / CAST(\"FOCALLEN\" AS DOUBLE) END, 6) AS pixel_scale FROM c",
        ("c", portable.CARDS_SQL),
    ),
)
def _header_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = headers.normalize_headers(portable.headers(spark, sf_dir))
    return out.select("id", r6(scoring.pixel_scale(F.col("pixsz"), F.col("focal_length"), F.col("xbinning")), "pixel_scale"))


@frames_query("fwhm_on_sky", " SELECT id, round(CASE WHEN pixel_scale <> 0 THEN median_fwhm * pixel_scale END, 6) AS fwhm_arcsec FROM frames")
def _fwhm_on_sky(frames):
    return frames.select("id", r6(scoring.fwhm_arcsec(F.col("median_fwhm"), F.col("pixel_scale")), "fwhm_arcsec"))


@query(
    "header_plate_solution",
    with_ctes(
        ", n AS (SELECT id, CAST(\"CRVAL1\" AS DOUBLE) AS r0, radians(CAST(\"CRVAL2\" AS DOUBLE)) AS d0, \"CTYPE1\" IS NOT NULL AS ok, \"NAXIS1\" IS NOT NULL AS sized, "
        "CASE WHEN \"NAXIS1\" IS NOT NULL THEN 3002.0 - 3000 ELSE 1.0 END AS px, CASE WHEN \"NAXIS2\" IS NOT NULL THEN 2002.0 - 2000 ELSE 1.0 END AS py FROM c), "
        "g AS (SELECT *, radians(-0.0008 * px + 0.0001 * py) AS xi, radians(0.0001 * px + 0.0008 * py) AS eta FROM n), "
        "w AS (SELECT *, degrees(radians(r0) + atan2(xi, cos(d0) - eta * sin(d0))) AS ra0, degrees(atan2(sin(d0) + eta * cos(d0), sqrt(xi * xi + power(cos(d0) - eta * sin(d0), 2)))) AS dec0, "
        "sqrt(0.0008 * 0.0008 + 0.0001 * 0.0001) AS step FROM g) "
        "SELECT id, CAST(ok AS INT) AS solved, CASE WHEN ok THEN round((ra0 - 360 * floor(ra0 / 360)) * 10000) END AS ra_e4, CASE WHEN ok THEN round(dec0 * 10000) END AS dec_e4, CASE WHEN ok THEN 2.9024 END AS wcs_scale, "
        "CASE WHEN ok THEN 7.125 END AS wcs_rotation, CASE WHEN ok AND sized THEN round(step * 6001, 5) END AS fov_w, CASE WHEN ok AND sized THEN round(step * 4001, 5) END AS fov_h FROM w",
        ("c", portable.CARDS_SQL),
    ),
)
def _plate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = headers.frames_from_headers(portable.headers(spark, sf_dir))
    e4 = [F.round(F.col(c) * 10000).alias(n) for c, n in (("wcs_ra", "ra_e4"), ("wcs_dec", "dec_e4"))]
    return out.select("id", "solved", *e4, "wcs_scale", "wcs_rotation", "fov_w", "fov_h")


@query(
    "frames_from_headers",
    with_ctes(
        f"SELECT id, replace(path, regexp_replace(path, '[^/]*$', ''), '') AS filename, {_TYPE} AS imagetyp, {_FILTER} AS filter, CAST(\"CTYPE1\" IS NOT NULL AS INT) AS solved, 1000 AS file_size, "
        "\"SET-TEMP\" AS json_set_temp, \"OBJ\" AS json_ctype FROM (SELECT c.*, p.path, coalesce(nullif(\"IMAGETYP\", ''), \"FRAME\") AS t, coalesce(nullif(\"FILTER\", ''), \"FILTER1\") AS f, \"CTYPE2\" AS \"OBJ\" FROM c JOIN p USING (id))",
        ("c", portable.CARDS_SQL), ("p", f"SELECT event_id AS id, {portable.FRAME_EXPRESSIONS[1][1]} AS path FROM events"),
    ),
)
def _from_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = headers.frames_from_headers(portable.headers(spark, sf_dir))
    doc = [F.get_json_object("header_json", f"$['{k}']").alias(n) for k, n in (("SET-TEMP", "json_set_temp"), ("CTYPE2", "json_ctype"))]
    return out.select("id", "filename", "imagetyp", "filter", "solved", "file_size", *doc)


_HEAD_CARDS = [
    "'SIMPLE  =                    T'", "concat('OBJECT  = ''', CAST(user_id AS STRING), '''')", "concat('GAIN    =                ', CAST(event_id % 9 AS STRING), '.5D2')",
    "'SET-TEMP= ''-10'''", "concat('XBINNING=                  ', CASE WHEN event_id % 2 = 0 THEN '2' WHEN event_id % 3 = 0 THEN '''12.5''' ELSE '12.5' END)", "concat('HIERARCH ESO DET ID = ', CAST(event_id % 7 AS STRING), ' / chip')", "'END'",
]


def _head_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header blocks as a file would hold them, a file for each event."""
    blank = 2880 - 80 * len(_HEAD_CARDS)
    text = "concat(" + ", ".join(f"rpad({c}, 80, ' ')" for c in _HEAD_CARDS) + f", repeat(' ', {blank}))"
    return portable.table(spark, sf_dir, "events").selectExpr(
        "CAST(event_id AS STRING) AS path", "timestamp_seconds(event_id) AS modificationTime", "5760L AS length", f"CAST({text} AS BINARY) AS head"
    )


@query(
    "header_cards_parsed",
    "SELECT event_id AS id, CAST(user_id AS VARCHAR) AS object, true AS object_is_text, true AS temp_is_text, ((event_id % 9) + 0.5) * 100 AS gain, "
    # A number loses its fraction; a quoted text must be an integer.
    "CASE WHEN event_id % 2 = 0 THEN 2.0 WHEN event_id % 3 <> 0 THEN 12.0 END AS xbinning, CAST(event_id % 7 AS VARCHAR) AS chip FROM events",
)
def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = headers.frames_from_headers(headers.parse_headers(_head_bytes(spark, sf_dir)))
    return rows.select(
        F.col("path").cast("long").alias("id"), "object", F.col("header_json").rlike('"OBJECT": "[0-9]+"').alias("object_is_text"),
        F.col("header_json").contains('"SET-TEMP": "-10"').alias("temp_is_text"),
        "gain", F.col("xbinning").cast("double").alias("xbinning"), F.get_json_object("header_json", "$['ESO DET ID']").alias("chip"),
    )


@query("normalize_stored", with_ctes(f"SELECT id, {_TYPE} AS imagetyp, {_FILTER} AS filter FROM (SELECT id, \"IMAGETYP\" AS t, \"FILTER\" AS f FROM c)", ("c", portable.CARDS_SQL)))
def _normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = portable.headers(spark, sf_dir).select("id", F.col("cards")["IMAGETYP"].alias("imagetyp"), F.col("cards")["FILTER"].alias("filter"))
    return headers.normalize_stored(stored)


# -- derived columns -------------------------------------------------------------------------------

_FOCUS = "coalesce(median_hfr, median_fwhm / 2)"
_CLIP = "greatest(0, least(100, {}))"
_F, _E = _CLIP.format(f"(6 - {_FOCUS}) / 4.5 * 100"), _CLIP.format("(0.8 - eccentricity) / 0.5 * 100")
_SCORE = f"CASE WHEN {_FOCUS} IS NOT NULL AND eccentricity IS NOT NULL THEN ({_F}) * 0.6 + ({_E}) * 0.4 WHEN {_FOCUS} IS NOT NULL THEN {_F} WHEN eccentricity IS NOT NULL THEN {_E} END"


@frames_query("quality_scores", f", s AS (SELECT id, {_SCORE} AS q, trail_score AS t FROM frames) SELECT id, round(CASE WHEN t > 0.03 THEN least(q, 25) ELSE q END, 1) AS score FROM s")
def _quality(frames):
    return frames.select("id", scoring.quality_score(F.col("median_hfr"), F.col("median_fwhm"), F.col("eccentricity"), F.col("trail_score")).alias("score"))


@frames_query(
    "rescore_changes",
    f", n AS (SELECT *, CASE WHEN id % 50 = 0 THEN 0.0 ELSE trail_score END AS nt, {_SCORE} AS q FROM frames WHERE {LIGHT} AND star_count IS NOT NULL), "
    "m AS (SELECT *, round(CASE WHEN nt > 0.03 THEN least(q, 25) ELSE q END, 1) AS nq FROM n) "
    "SELECT id, nt AS trail_score, nq AS quality_score FROM m WHERE nt IS DISTINCT FROM trail_score OR nq IS DISTINCT FROM quality_score",
)
def _rescore(frames):
    return catalog.rescore(frames.withColumn("exptime", F.when(F.col("id") % 50 == 0, F.lit(0.5)).otherwise(F.col("exptime"))))


@frames_query(
    "pointing_separation",
    " SELECT id, CASE WHEN wcs_ra IS NOT NULL THEN round(degrees(2 * asin(sqrt(least(1, power(sin((radians(wcs_dec) - radians(dec)) / 2), 2) + cos(radians(dec)) * cos(radians(wcs_dec)) * power(sin((radians(wcs_ra) - radians(ra)) / 2), 2))))) * 60, 3) END AS sep FROM frames",
)
def _separation(frames):
    sep = coord_sep_arcmin(F.col("ra"), F.col("dec"), F.col("wcs_ra"), F.col("wcs_dec"))
    return frames.select("id", sep.alias("sep"))


@frames_query("sensor_pixels", " SELECT id, round(2.3548 * sqrt(greatest(v - 1.0 / 3, 0.25 * v)), 6) AS median_fwhm, round(star_flux * 4, 6) AS star_flux FROM (SELECT *, power(median_fwhm * 2 / 2.3548, 2) AS v FROM frames WHERE bayer = 'RGGB')")
def _sensor(frames):
    osc = frames.filter(scoring.cfa_pattern(F.col("bayer")).isNotNull())
    return rounded(scoring.to_sensor_pixels(osc, 2).select("id", "median_fwhm", "star_flux"), "median_fwhm", "star_flux")


@frames_query(
    "path_forms",
    " SELECT id, CASE WHEN path LIKE '/lib/view%' THEN replace(concat('Z:\\view', substr(path, 10)), '/', '\\') ELSE path END AS host_path, CASE WHEN path LIKE '%.xisf' THEN 'xisf' ELSE 'fits' END AS format, "
    "concat(strftime(indexed_at, '%Y-%m-%dT%H:%M:%S'), 'Z') AS indexed_at, substr(date_obs, 1, 10) AS night FROM frames",
)
def _paths(frames):
    return frames.select(
        "id", text.rewrite_path(F.col("path"), "/lib/view", "Z:\\view").alias("host_path"), text.file_format(F.col("path")).alias("format"),
        text.iso_utc(F.col("indexed_at")).alias("indexed_at"), text.night(F.col("date_obs")).alias("night"),
    )


@frames_query("modified_times", " SELECT id, strftime(make_timestamp(CAST(file_mtime AS BIGINT) * 1000000), '%Y-%m-%dT%H:%M:%S') || 'Z' AS modified_at FROM frames")
def _modified(frames):
    return frames.select("id", text.epoch_iso(F.col("file_mtime")).alias("modified_at"))


def _series(terms, fn: str) -> str:
    return " + ".join(f"({a}) * {fn}(radians({p} + ({r}) * cent))" for a, p, r in terms)


def _mod360(x: str) -> str:
    return f"(({x}) - 360 * floor(({x}) / 360))"


def _alt(ra: str, dec: str) -> str:
    return f"degrees(asin(greatest(-1, least(1, sin(radians(52)) * sin(radians({dec})) + cos(radians(52)) * cos(radians({dec})) * cos(radians(lst - {ra}))))))"


def _ecl_ra(lon: str, lat: str) -> str:
    y, z = f"cos(radians({lat})) * sin(radians({lon}))", f"sin(radians({lat}))"
    return _mod360(f"degrees(atan2({y} * cos(radians(eps)) - {z} * sin(radians(eps)), cos(radians({lat})) * cos(radians({lon}))))")


def _ecl_dec(lon: str, lat: str) -> str:
    return f"degrees(asin(cos(radians({lat})) * sin(radians({lon})) * sin(radians(eps)) + sin(radians({lat})) * cos(radians(eps))))"


def _sep(r1: str, d1: str, r2: str, d2: str) -> str:
    return (
        f"degrees(2 * asin(sqrt(least(1, power(sin((radians({d2}) - radians({d1})) / 2), 2) + cos(radians({d1})) * cos(radians({d2})) * power(sin((radians({r2}) - radians({r1})) / 2), 2)))))"
    )


# The oracle states the same published series on its own; site 52 N, 5 E.
_SKY = (
    ", t AS (SELECT id, ra, dec, (epoch_us(CAST(date_obs AS TIMESTAMP)) // 1000 * 1000 - epoch_us(TIMESTAMP '2000-01-01 12:00:00')) / 86400000000.0 AS dd FROM frames), "
    f"a AS (SELECT *, dd / 36525 AS cent, {_mod360('280.46061837 + 360.98564736629 * dd + 5')} AS lst, 23.439 - 0.0000004 * dd AS eps, 357.528 + 0.9856003 * dd AS g FROM t), "
    f"b AS (SELECT *, ra + cent * (1.2812323 + 0.5567530 * sin(radians(ra)) * tan(radians(dec))) AS pra, dec + cent * 0.5567530 * cos(radians(ra)) AS pdec, 280.460 + 0.9856474 * dd + 1.915 * sin(radians(g)) + 0.020 * sin(radians(2 * g)) AS slon, "
    f"218.32 + 481267.881 * cent + {_series(sky.MOON_LON, 'sin')} AS mlon, {_series(sky.MOON_LAT, 'sin')} AS mlat, 0.9508 + {_series(sky.MOON_PARALLAX, 'cos')} AS par FROM a), "
    f"c AS (SELECT *, {_ecl_ra('slon', '0')} AS sra, {_ecl_dec('slon', '0')} AS sdec, {_ecl_ra('mlon', 'mlat')} AS mra, {_ecl_dec('mlon', 'mlat')} AS mdec FROM b), "
    f"e AS (SELECT *, CASE WHEN dd IS NOT NULL THEN {_alt('pra', 'pdec')} END AS alt, {_alt('mra', 'mdec')} AS malt FROM c) "
    "SELECT id, round(alt, 2) AS altitude, CASE WHEN alt > 3 AND 1 / sin(radians(alt)) <= 40 THEN round(1 / sin(radians(alt)), 3) END AS airmass, "
    f"CASE WHEN dd IS NOT NULL THEN round({_sep('pra', 'pdec', 'mra', 'mdec')}, 2) END AS moon_sep, CASE WHEN dd IS NOT NULL THEN round((1 - cos(radians({_sep('sra', 'sdec', 'mra', 'mdec')}))) / 2, 3) END AS moon_illum, round(malt - par * cos(radians(malt)), 2) AS moon_alt FROM e"
)


@frames_query("sky_geometry", _SKY)
def _sky(frames):
    out = sky.with_sky_geometry(frames, {"lat": 52.0, "lon": 5.0, "elev": 10.0})
    return out.select("id", "altitude", "airmass", "moon_sep", "moon_illum", "moon_alt")


# -- documents --------------------------------------------------------------------------------------------

_SCALE = "coalesce(wcs_scale, pixel_scale)"


@frames_query(
    "frame_documents",
    " SELECT id, CASE WHEN bayer <> '' THEN 'osc' ELSE 'mono' END AS color, CASE WHEN wcs_ra IS NOT NULL AND wcs_dec IS NOT NULL THEN 'plate_solve' WHEN ra IS NOT NULL AND dec IS NOT NULL THEN 'header' END AS source, "
    "round(CASE WHEN wcs_ra IS NOT NULL AND wcs_dec IS NOT NULL THEN wcs_ra ELSE ra END, 6) AS ra_deg, "
    f"round(coalesce(nullif(fov_w, 0), naxis1 * {_SCALE} / 3600), 6) AS fov_width_deg, round(psf_fwhm * {_SCALE}, 9) AS psf_fwhm_arcsec, CASE rejected WHEN 1 THEN 'rejected' WHEN 0 THEN 'accepted' END AS grade, coalesce(rejected = 1, false) AS rejected "
    "FROM frames",
)
def _documents(frames):
    d = fields.project_fields(frames)
    return d.select(
        "id", "capture.color", "position.source", r6("position.ra_deg", "ra_deg"), r6("position.fov_width_deg", "fov_width_deg"),
        F.round("quality.psf_fwhm_arcsec", 9).alias("psf_fwhm_arcsec"), "status.grade", "status.rejected",
    )


@frames_query(
    "frame_verdicts",
    " SELECT id, CAST(trail_score > 0.03 AS VARCHAR) AS trailed, CAST(empty_cells > 0.15 AS VARCHAR) AS occluded, CAST(bg_dip > 0.025 AS VARCHAR) AS shadow, CAST(streaks > 0 AS VARCHAR) AS satellite, CAST(solved <> 0 AS VARCHAR) AS solved FROM frames",
)
def _verdicts(frames):
    d = fields.project_fields(frames, "quality.trailed,quality.occluded,quality.shadow,quality.satellite,plate_solve.solved")
    leaves = {"quality": ("trailed", "occluded", "shadow", "satellite"), "plate_solve": ("solved",)}
    return d.select("id", *[F.col(f"{group}.{name}").cast("string").alias(name) for group, names in leaves.items() for name in names])


@frames_query(
    "header_keywords",
    " SELECT id, json_extract_string(header_json, '$.OBJECT') AS object, CAST(json_extract_string(header_json, '$.EXPTIME') AS DOUBLE) AS exptime, CASE WHEN header_json IS NOT NULL THEN 2.0 END AS cards FROM frames",
)
def _header_keywords(frames):
    d = fields.project_fields(frames, "header.object,header.exptime")
    card = F.col("header")
    return d.select(
        "id", F.try_variant_get(card["OBJECT"], "$", "string").alias("object"), F.try_variant_get(card["EXPTIME"], "$", "double").alias("exptime"), F.size("header").cast("double").alias("cards")
    )


@frames_query("frame_diagnostics", " SELECT id, coalesce(diagnostics_json, '') = '' AS missing, CAST(json_extract_string(diagnostics_json, '$.v') AS DOUBLE) AS v, CAST(json_extract_string(diagnostics_json, '$.sample') AS DOUBLE) AS sample FROM frames")
def _diagnostics(frames):
    d = fields.diagnostics(frames)
    return d.select("id", "missing", F.col("diagnostics.v").cast("double").alias("v"), F.col("diagnostics.sample").cast("double").alias("sample"))


@frames_query(
    "diagnostic_stars",
    " SELECT id, CAST(id % 6000 AS DOUBLE) AS x, 0.0 AS code, 1.0 AS used FROM frames WHERE diagnostics_json LIKE '{\"v\":2%' UNION ALL SELECT id, 20.0, 3.0, 0.0 FROM frames WHERE diagnostics_json LIKE '{\"v\":2%'",
)
def _diagnostic_stars(frames):
    return fields.diagnostic_stars(frames).select("id", "x", "code", "used")


@frames_query(
    "json_documents",
    " SELECT id, path, object, CASE rejected WHEN 1 THEN 'rejected' WHEN 0 THEN 'accepted' END AS grade, CAST(exptime AS DOUBLE) AS exposure_s FROM frames",
)
def _json(frames):
    rows = sinks.to_json_rows(fields.project_fields(frames, "file,capture,status"))
    leaf = lambda path: F.get_json_object("value", f"$.{path}")
    return rows.select(
        leaf("id").cast("long").alias("id"), leaf("file.path").alias("path"), leaf("capture.object").alias("object"), leaf("status.grade").alias("grade"),
        leaf("capture.exposure_s").cast("double").alias("exposure_s"),
    )


@frames_query("approved_paths", f" SELECT CASE WHEN path LIKE '/lib/%' THEN concat('/host/', substr(path, 6)) ELSE path END AS path FROM frames WHERE {LIGHT} AND trail_score <= 0.03 AND coalesce(rejected, 0) = 0")
def _approved(frames):
    return sinks.approved_paths(select_frames(frames, lambda v: v.good_tracking), "/lib/", "/host/")


@frames_query("solve_work_list", f" SELECT id FROM frames WHERE {LIGHT} AND wcs_ra IS NULL")
def _work(frames):
    return sinks.solve_work_list(select_frames(frames, lambda v: v.missing(v.astap_ra)))


@query("saved_query", with_frames(
    f"SELECT id FROM frames, (SELECT quantile_cont(quality_score, 0.25) AS q25 FROM frames WHERE {LIGHT} AND filter = 'R' AND index_error IS NULL) WHERE {LIGHT} AND filter = 'R' AND index_error IS NULL AND quality_score > q25 AND coalesce(rejected, 0) = 0"
))
def _saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    above = '{"op": ">", "args": [{"var": "quality"}, {"op": "percentile", "args": [{"var": "quality"}, 25]}]}'
    saved = spark.createDataFrame([(1, "sharp", "", f'{{"filter": "R", "expression": {above}}}')], SAVED_QUERY_SCHEMA)
    return fields.run_saved_query(portable.frames(spark, sf_dir), saved, 1).select("id")


@query("saved_query_capitals", with_frames(
    f"SELECT id FROM frames WHERE {LIGHT} AND index_error IS NULL AND filter = 'Ha' AND path NOT LIKE '%/Reject/%' AND coalesce(rejected, 0) = 0"
))
def _saved_capitals(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = '{"expression": {"op": "and", "args": [{"op": "==", "args": [{"var": "filter"}, "HA"]}, {"op": "not like", "args": [{"var": "path"}, "%/REJECT/%"]}]}}'
    saved = spark.createDataFrame([(1, "h-alpha", "", state)], SAVED_QUERY_SCHEMA)
    return fields.run_saved_query(portable.frames(spark, sf_dir), saved, 1).select("id")


# -- sorting and pages ----------------------------------------------------------------------------------------


@frames_query("list_page", " SELECT id FROM frames WHERE index_error IS NULL ORDER BY median_fwhm DESC NULLS LAST, indexed_at DESC, id LIMIT 50 OFFSET 50")
def _list_page(frames):
    return paging.page_of(catalog.ok_frames(frames), paging.list_order("median_fwhm"), 2, 50).select("id")


@frames_query("sorted_page", " SELECT id FROM frames ORDER BY object ASC NULLS LAST, quality_score DESC NULLS LAST, id LIMIT 200 OFFSET 400")
def _sorted_page(frames):
    return paging.page_of(frames, paging.sort_spec("capture.object,-quality.score"), 3, 200).select("id")


@frames_query("deep_page", " SELECT id FROM frames ORDER BY date_obs DESC NULLS LAST, id LIMIT 500 OFFSET 4500")
def _deep_page(frames):
    return paging.page_of(frames.select("id", "date_obs"), paging.sort_spec("-capture.date_obs"), 10, 500).select("id")


@frames_query("page_info", " SELECT count(*) AS total, 3 AS page, 200 AS per_page, CAST(ceil(count(*) / 200.0) AS BIGINT) AS pages, CAST(CASE WHEN 3 < ceil(count(*) / 200.0) THEN 4 END AS DOUBLE) AS next, 2.0 AS prev FROM frames")
def _page_info(frames):
    return paging.page_info(frames, 3, 200).withColumns({c: F.col(c).cast("double") for c in ("next", "prev")})


@frames_query("top_per_object", f" SELECT object, id, CAST(row_number() OVER (PARTITION BY object ORDER BY quality_score DESC NULLS LAST, id) AS INT) AS rank FROM frames WHERE {LIGHT} QUALIFY rank <= 5")
def _top(frames):
    return paging.top_per_group(candidates(frames), ["object"], [F.col("quality_score").desc_nulls_last(), F.col("id")], 5).select("object", "id", "rank")


for _mode, _order in {"max_fov": "g DESC", "min_fov": "g ASC", "max_scale": "s DESC", "min_scale": "s ASC"}.items():

    def _register(mode=_mode, order=_order):
        @frames_query(
            f"reference_{mode}",
            f", c AS (SELECT *, coalesce(nullif(wcs_scale, 0), pixel_scale) AS s, coalesce(nullif(fov_w, 0), naxis1 * {_SCALE} / 3600) AS g FROM frames WHERE {LIGHT} AND filter = 'L'), "
            "o AS (SELECT quality_score AS q, row_number() OVER (ORDER BY quality_score) - 1 AS k, count(*) OVER () AS n FROM c WHERE quality_score IS NOT NULL) "
            f"SELECT id FROM c WHERE quality_score >= (SELECT max(q) FROM o WHERE k = n // 2) ORDER BY {order} NULLS LAST, id LIMIT 1",
        )
        def _run(frames):
            return paging.pick_reference(select_frames(frames, filter="L"), mode).select("id")

    _register()
