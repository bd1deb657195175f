"""Queries: rollups, catalogue counts, user targets, calibration, sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nightledger.operators import calibration as cal
from nightledger.operators import rollups, screening, sessions, targets
from nightledger.operators.selector import select_frames
from nightledger.plans import portable
from nightledger.plans.registry import frames_query, longs, query, r6, rounded, with_frames
from nightledger.plans.sequence_sql import ROUNDED, verdict_ctes

LIGHT = "imagetyp = 'Light Frame'"
OK_LIGHT = f"{LIGHT} AND index_error IS NULL"
NIGHT = "substr(date_obs, 1, 10)"
FILTER = "coalesce(nullif(filter, ''), '—')"
AVGS = "round(avg(quality_score), 6) AS avg_quality, round(avg(median_hfr), 6) AS avg_hfr"


@frames_query(
    "targets_rollup",
    f" SELECT object, count(*) AS frames, sum(exptime) AS integration_sec, count(DISTINCT {NIGHT}) AS nights, min({NIGHT}) AS first_night, max({NIGHT}) AS last_night, "
    f"{AVGS}, CAST(sum(coalesce(rejected, 0)) AS BIGINT) AS rejected FROM frames WHERE {OK_LIGHT} AND object IS NOT NULL GROUP BY object",
)
def _targets(frames):
    return rounded(rollups.targets_rollup(frames, rounded=False), "avg_quality", "avg_hfr")


@frames_query("targets_by_filter", f" SELECT object, {FILTER} AS filter, count(*) AS frames, sum(exptime) AS integration_sec FROM frames WHERE {OK_LIGHT} GROUP BY ALL")
def _by_filter(frames):
    return rollups.targets_by_filter(frames)


@frames_query("targets_by_rig", f" SELECT object, telescop, instrume, count(*) AS frames FROM frames WHERE {OK_LIGHT} AND (telescop <> '' OR instrume <> '') GROUP BY ALL")
def _by_rig(frames):
    return rollups.targets_by_rig(frames)


@frames_query("target_totals", f" SELECT sum(exptime) AS total_integration_sec, count(DISTINCT object) AS target_count FROM frames WHERE {OK_LIGHT} AND object IS NOT NULL")
def _totals(frames):
    return rollups.target_totals(rollups.targets_rollup(frames))


@frames_query(
    "targets_nested_first_filter",
    f", f AS (SELECT object, {FILTER} AS filter, sum(exptime) AS s, count(*) AS n FROM frames WHERE {OK_LIGHT} AND object IS NOT NULL GROUP BY ALL), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY object ORDER BY s DESC, filter) AS k, count(*) OVER (PARTITION BY object) AS filters FROM f), "
    f"g AS (SELECT object, count(DISTINCT (telescop, instrume)) AS rigs FROM frames WHERE {OK_LIGHT} GROUP BY object) "
    "SELECT object, filter AS top_filter, n AS top_frames, filters, rigs FROM r JOIN g USING (object) WHERE k = 1",
)
def _nested(frames):
    n = rollups.targets_nested(frames)
    first = F.element_at("filters", 1)
    return longs(n.select("object", first["filter"].alias("top_filter"), first["frames"].alias("top_frames"), F.size("filters").alias("filters"), F.size("rigs").alias("rigs")), "filters", "rigs")


@frames_query("targets_sorted_by_name", f" SELECT object, count(*) AS frames FROM frames WHERE {OK_LIGHT} AND object IS NOT NULL GROUP BY object ORDER BY object")
def _sorted(frames):
    return rollups.sort_targets(rollups.targets_rollup(frames), "name").select("object", "frames")


_LEAF = "count(*) AS frames, sum(exptime) AS integration_sec, round(avg(median_hfr), 6) AS avg_hfr, round(avg(eccentricity), 6) AS avg_eccentricity, round(avg(quality_score), 6) AS avg_quality"


@frames_query(
    "target_night_filters",
    f" SELECT object, coalesce({NIGHT}, 'Unknown') AS night, {FILTER} AS filter, {_LEAF}, round(avg(altitude), 6) AS avg_altitude FROM frames WHERE {OK_LIGHT} AND object IS NOT NULL GROUP BY ALL",
)
def _night_filters(frames):
    return rounded(rollups.target_night_filters(frames, rounded=False), "avg_hfr", "avg_eccentricity", "avg_quality", "avg_altitude")


@frames_query(
    "target_nights",
    f", l AS (SELECT object, coalesce({NIGHT}, 'Unknown') AS night, coalesce(filter, '') AS f, count(*) AS n, sum(exptime) AS s, avg(moon_illum) AS moon, "
    f"arg_min(telescop, id) AS telescop, arg_min(instrume, id) AS instrume FROM frames WHERE {OK_LIGHT} AND object = 'OBJ 1' GROUP BY ALL), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY object, night ORDER BY f) AS k FROM l) "
    "SELECT object, night, max(telescop) FILTER (WHERE k = 1) AS telescop, max(instrume) FILTER (WHERE k = 1) AS instrume, CAST(sum(n) AS BIGINT) AS frames, sum(s) AS integration_sec, count(*) AS filters, "
    "round(max(moon) FILTER (WHERE k = 1), 6) AS moon_illum FROM r GROUP BY object, night",
)
def _nights(frames):
    return rounded(rollups.target_nights(frames, "OBJ 1", rounded=False), "moon_illum")


@frames_query("target_filter_totals", f" SELECT object, {FILTER} AS filter, count(*) AS frames, sum(exptime) AS integration_sec FROM frames WHERE {OK_LIGHT} AND object = 'OBJ 2' GROUP BY ALL")
def _filter_totals(frames):
    return rollups.target_filter_totals(frames, "OBJ 2")


@frames_query(
    "sessions_by_filter",
    f" SELECT coalesce(object, 'Unknown') AS object, {NIGHT} AS night, {FILTER} AS filter, {_LEAF} FROM frames WHERE {LIGHT} AND date_obs IS NOT NULL GROUP BY ALL",
)
def _sessions_by_filter(frames):
    return rounded(rollups.sessions_by_filter(frames, rounded=False), "avg_hfr", "avg_eccentricity", "avg_quality")


@frames_query(
    "sessions_rollup",
    f" SELECT coalesce(object, 'Unknown') AS object, {NIGHT} AS night, arg_min(telescop, id) AS telescop, arg_min(instrume, id) AS instrume, count(*) AS frames, sum(exptime) AS integration_sec, "
    f"count(DISTINCT {FILTER}) AS filters FROM frames WHERE {LIGHT} AND date_obs IS NOT NULL GROUP BY ALL",
)
def _sessions(frames):
    return rollups.sessions_rollup(frames)


@frames_query(
    "nights_overview",
    f" SELECT {NIGHT} AS night, count(*) AS frames, sum(exptime) AS integration_sec, count(DISTINCT coalesce(object, 'Unknown')) AS sessions FROM frames WHERE {LIGHT} AND date_obs IS NOT NULL GROUP BY 1",
)
def _overview(frames):
    return rollups.nights_overview(rollups.sessions_rollup(frames))


@frames_query(
    "frame_set_rollup",
    f" SELECT count(*) AS frames, sum(exptime) AS integration_sec, count(DISTINCT {NIGHT}) AS nights, min({NIGHT}) AS first_night, max({NIGHT}) AS last_night, {AVGS}, "
    f"count(*) FILTER (WHERE rejected = 1) AS rejected FROM frames WHERE {LIGHT} AND filter = 'Ha'",
)
def _set(frames):
    return rounded(rollups.frame_set_rollup(select_frames(frames, filter="Ha"), rounded=False), "avg_quality", "avg_hfr")


@frames_query(
    "object_position",
    f" SELECT object, round(median(coalesce(wcs_ra, ra)), 6) AS ra, round(median(coalesce(wcs_dec, dec)), 6) AS dec FROM frames WHERE {OK_LIGHT} AND object IS NOT NULL GROUP BY object",
)
def _position(frames):
    return rounded(rollups.object_position(frames), "ra", "dec")


@frames_query("catalog_totals", " SELECT count(*) FILTER (WHERE index_error IS NULL) AS total, count(*) FILTER (WHERE index_error IS NOT NULL) AS failed FROM frames")
def _catalog_totals(frames):
    return rollups.catalog_totals(frames)


@frames_query(
    "catalog_counts",
    ", c AS (SELECT 'imagetyp' AS facet, coalesce(imagetyp, 'Unknown') AS value FROM frames UNION ALL SELECT 'object', object FROM frames UNION ALL SELECT 'filter', filter FROM frames), "
    "n AS (SELECT facet, value, count(*) AS count FROM c WHERE value IS NOT NULL GROUP BY ALL) "
    "SELECT facet, value, count FROM n QUALIFY facet <> 'object' OR row_number() OVER (PARTITION BY facet ORDER BY count DESC, value) <= 20",
)
def _catalog_counts(frames):
    return rollups.catalog_counts(frames)


@frames_query(
    "distinct_values",
    " SELECT DISTINCT facet, value FROM (SELECT 'imagetypes' AS facet, imagetyp AS value FROM frames UNION ALL SELECT 'filters', filter FROM frames "
    "UNION ALL SELECT 'telescopes', telescop FROM frames UNION ALL SELECT 'instruments', instrume FROM frames) WHERE value IS NOT NULL",
)
def _distinct(frames):
    return rollups.distinct_values(frames)


@frames_query("facet_totals", f" SELECT count(*) AS frames, sum(exptime) AS integration_sec FROM frames WHERE {LIGHT} AND trail_score <= 0.03")
def _facet_totals(frames):
    return rollups.facet_totals(select_frames(frames, lambda v: v.good_tracking))


# -- user targets -----------------------------------------------------------------------------

_S = "coalesce(wcs_scale, pixel_scale)"
_MATCH = (
    "t AS (" + portable.TARGETS_SQL + "), "
    f"p AS (SELECT *, coalesce(wcs_ra, ra) AS r, coalesce(wcs_dec, dec) AS d, coalesce(nullif(fov_w, 0), naxis1 * {_S} / 3600) AS w, coalesce(nullif(fov_h, 0), naxis2 * {_S} / 3600) AS h, "
    f"radians(coalesce(wcs_rotation, 0)) AS rot FROM frames WHERE {OK_LIGHT}), "
    "q AS (SELECT t.*, p.*, ((tra - r + 180 - 360 * floor((tra - r + 180) / 360)) - 180) * cos(radians(d)) AS dx, tdec - d AS dy FROM p, t), "
    "hit AS (SELECT * FROM q WHERE (abs(dx * cos(rot) + dy * sin(rot)) <= w / 2 AND abs(-dx * sin(rot) + dy * cos(rot)) <= h / 2) OR "
    "(coalesce(radius, 0) <> 0 AND degrees(acos(greatest(-1, least(1, sin(radians(d)) * sin(radians(tdec)) + cos(radians(d)) * cos(radians(tdec)) * cos(radians(r - tra)))))) <= radius))"
)


@query("user_target_matches", with_frames(f", {_MATCH} SELECT tid AS target_id, id FROM hit"))
def _matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return targets.match_targets(portable.frames(spark, sf_dir), portable.user_targets(spark)).select("target_id", "id")


@query(
    "user_targets_rollup",
    with_frames(
        f", {_MATCH}, g AS (SELECT tid, count(*) AS frames, sum(exptime) AS integration_sec, count(DISTINCT {NIGHT}) AS nights, min({NIGHT}) AS first_night, max({NIGHT}) AS last_night, {AVGS}, "
        "count(*) FILTER (WHERE rejected = 1) AS rejected FROM hit GROUP BY tid) "
        "SELECT t.tid AS id, name, coalesce(frames, 0) AS frames, coalesce(integration_sec, 0) AS integration_sec, coalesce(nights, 0) AS nights, first_night, last_night, avg_quality, avg_hfr, coalesce(rejected, 0) AS rejected "
        "FROM t LEFT JOIN g ON t.tid = g.tid"
    ),
)
def _user_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = targets.user_targets_rollup(portable.frames(spark, sf_dir), portable.user_targets(spark), rounded=False)
    return rounded(out.drop("ra", "dec", "radius_deg", "notes"), "avg_quality", "avg_hfr")


@query("user_target_night_filters", with_frames(f", {_MATCH} SELECT tid AS target_id, coalesce({NIGHT}, 'Unknown') AS night, {FILTER} AS filter, {_LEAF}, round(avg(altitude), 6) AS avg_altitude FROM hit GROUP BY ALL"))
def _user_nights(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = targets.user_target_night_filters(portable.frames(spark, sf_dir), portable.user_targets(spark), rounded=False)
    return rounded(out, "avg_hfr", "avg_eccentricity", "avg_quality", "avg_altitude")


@query(
    "user_target_nights",
    with_frames(
        f", {_MATCH} SELECT tid AS target_id, coalesce({NIGHT}, 'Unknown') AS night, count(*) AS frames, sum(exptime) AS integration_sec, arg_min(telescop, id) AS telescop, arg_min(instrume, id) AS instrume, "
        "any_value(m) AS moon_illum FROM (SELECT *, first_value(moon_illum) OVER (PARTITION BY tid, coalesce(substr(date_obs, 1, 10), 'Unknown') ORDER BY id) AS m FROM hit) GROUP BY 1, 2"
    ),
)
def _user_target_nights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return targets.user_target_nights(portable.frames(spark, sf_dir), portable.user_targets(spark))


@frames_query(
    "cone_search",
    " SELECT id FROM frames WHERE degrees(2 * asin(sqrt(least(1, power(sin((radians(10.0) - radians(coalesce(wcs_dec, dec))) / 2), 2) + cos(radians(coalesce(wcs_dec, dec))) * cos(radians(10.0)) * "
    "power(sin((radians(40.1) - radians(coalesce(wcs_ra, ra))) / 2), 2))))) <= 0.3",
)
def _cone(frames):
    return targets.cone(frames, 40.1, 10.0, 0.3).select("id")


# -- calibration ----------------------------------------------------------------------------------

_KEYED = (
    "k AS (SELECT imagetyp, object, exptime, ccd_temp, coalesce(nullif(instrume, ''), 'Unknown camera') AS camera, coalesce(nullif(xbinning, 0), 1) AS binning, gain, CAST(cam_offset AS DOUBLE) AS cam_offset, "
    "exptime AS exposure_s, coalesce(filter, '') AS filter, TRY_CAST(substr(date_obs, 1, 10) AS DATE) AS night FROM frames WHERE index_error IS NULL), "
    "s AS (SELECT camera, binning, gain, cam_offset, exposure_s, filter, round_even(ccd_temp, 0) AS sensor_temp_c, count(*) AS frames, sum(exptime) AS integration_sec, count(DISTINCT night) AS nights, "
    "min(night) AS first_night, max(night) AS last_night FROM k WHERE imagetyp = 'Light Frame' GROUP BY camera, binning, gain, cam_offset, exposure_s, filter, round_even(ccd_temp, 0))"
)
_SAME_READOUT = "x.camera = s.camera AND x.binning = s.binning AND x.gain IS NOT DISTINCT FROM s.gain AND x.cam_offset IS NOT DISTINCT FROM s.cam_offset"
_SETUP = ["camera", "binning", "gain", "cam_offset", "exposure_s", "filter", "sensor_temp_c"]
_TEXT_NIGHTS = "CAST(first_night AS VARCHAR) AS first_night, CAST(last_night AS VARCHAR) AS last_night"


def _plain(df: DataFrame) -> DataFrame:
    """Dates as text and integers that may be NULL as doubles, which compare
    alike in both engines."""
    kinds = {"first_night": "string", "last_night": "string", "sensor_temp_c": "double", "flat_gap_days": "double"}
    return df.withColumns({n: F.col(n).cast(t) for n, t in kinds.items() if n in df.columns})


@frames_query("light_setups", f", {_KEYED} SELECT * EXCLUDE (first_night, last_night), {_TEXT_NIGHTS} FROM s")
def _setups(frames):
    return _plain(cal.light_setups(frames))


@frames_query(
    "setup_objects",
    f", {_KEYED}, c AS (SELECT camera, binning, gain, cam_offset, exposure_s, filter, round_even(ccd_temp, 0) AS sensor_temp_c, object, count(*) AS frames FROM k WHERE imagetyp = 'Light Frame' AND object <> '' GROUP BY ALL) "
    "SELECT *, CAST(row_number() OVER (PARTITION BY camera, binning, gain, cam_offset, exposure_s, filter, sensor_temp_c ORDER BY frames DESC, object) AS INT) AS rank FROM c QUALIFY rank <= 3",
)
def _setup_objects(frames):
    return _plain(cal.setup_objects(frames))


@frames_query(
    "setup_darks",
    f", {_KEYED} SELECT {', '.join('s.' + c for c in _SETUP)}, (SELECT count(*) FROM k x WHERE x.imagetyp = 'Dark Frame' AND {_SAME_READOUT} AND x.exposure_s IS NOT DISTINCT FROM s.exposure_s "
    "AND (x.ccd_temp IS NULL OR s.sensor_temp_c IS NULL OR abs(x.ccd_temp - s.sensor_temp_c) <= 2)) AS darks FROM s",
)
def _darks(frames):
    return _plain(cal.with_darks(cal.light_setups(frames), cal.dark_pool(frames)).select(*_SETUP, "darks"))


_GAPS = (
    "ln AS (SELECT DISTINCT camera, binning, gain, cam_offset, exposure_s, filter, round_even(ccd_temp, 0) AS sensor_temp_c, night FROM k WHERE imagetyp = 'Light Frame' AND night IS NOT NULL), "
    "fn AS (SELECT DISTINCT camera, binning, filter, night FROM k WHERE imagetyp = 'Flat Frame' AND night IS NOT NULL), "
    "gp AS (SELECT ln.*, (SELECT min(abs(date_diff('day', fn.night, ln.night))) FROM fn WHERE fn.camera = ln.camera AND fn.binning = ln.binning AND fn.filter = ln.filter) AS gap FROM ln), "
    "wg AS (SELECT camera, binning, gain, cam_offset, exposure_s, filter, sensor_temp_c, CAST(max(gap) AS DOUBLE) AS flat_gap_days FROM gp GROUP BY ALL)"
)


@frames_query("setup_flat_gaps", f", {_KEYED}, {_GAPS} SELECT * FROM wg")
def _gaps(frames):
    return _plain(cal.flat_gaps(frames))


@frames_query("flat_pool", f", {_KEYED} SELECT camera, binning, filter, count(*) AS flats, count(DISTINCT night) AS flat_nights FROM k WHERE imagetyp = 'Flat Frame' GROUP BY ALL")
def _flat_pool(frames):
    return cal.flat_pool(frames)


@frames_query("bias_pool", f", {_KEYED} SELECT camera, binning, gain, cam_offset, count(*) AS bias FROM k WHERE imagetyp = 'Bias Frame' GROUP BY ALL")
def _bias_pool(frames):
    return cal.bias_pool(frames)


_REPORT = (
    f"{_KEYED}, {_GAPS}, "
    "rep AS (SELECT s.*, "
    f"(SELECT count(*) FROM k x WHERE x.imagetyp = 'Dark Frame' AND {_SAME_READOUT} AND x.exposure_s IS NOT DISTINCT FROM s.exposure_s AND (x.ccd_temp IS NULL OR s.sensor_temp_c IS NULL OR abs(x.ccd_temp - s.sensor_temp_c) <= 2)) AS darks, "
    "(SELECT count(*) FROM k x WHERE x.imagetyp = 'Flat Frame' AND x.camera = s.camera AND x.binning = s.binning AND x.filter = s.filter) AS flats, "
    f"(SELECT count(*) FROM k x WHERE x.imagetyp = 'Bias Frame' AND {_SAME_READOUT}) AS bias, "
    "(SELECT max(flat_gap_days) FROM wg WHERE wg.camera = s.camera AND wg.binning = s.binning AND wg.gain IS NOT DISTINCT FROM s.gain AND wg.cam_offset IS NOT DISTINCT FROM s.cam_offset AND "
    "wg.exposure_s IS NOT DISTINCT FROM s.exposure_s AND wg.filter = s.filter AND wg.sensor_temp_c IS NOT DISTINCT FROM s.sensor_temp_c) AS flat_gap_days FROM s)"
)


@frames_query(
    "calibration_setups",
    f", {_REPORT} SELECT * EXCLUDE (first_night, last_night, filter), nullif(filter, '') AS filter, {_TEXT_NIGHTS}, coalesce(flat_gap_days > 30, false) AS stale_flats, darks = 0 AS missing_darks, flats = 0 AS missing_flats FROM rep",
)
def _report(frames):
    return _plain(cal.calibration_setups(frames))


@frames_query(
    "calibration_summary",
    f", {_REPORT} SELECT count(*) AS setups, count(*) FILTER (WHERE darks > 0 AND flats > 0 AND NOT coalesce(flat_gap_days > 30, false)) AS complete, count(*) FILTER (WHERE darks = 0) AS missing_darks, "
    "count(*) FILTER (WHERE flats = 0) AS missing_flats, count(*) FILTER (WHERE flat_gap_days > 30) AS stale_flats, coalesce(sum(integration_sec) FILTER (WHERE darks = 0 OR flats = 0), 0) AS uncalibrated_integration_sec FROM rep",
)
def _cal_summary(frames):
    return cal.calibration_summary(cal.calibration_setups(frames))


@frames_query(
    "calibration_problems",
    f", {_REPORT} SELECT {', '.join(c for c in _SETUP if c != 'filter')}, nullif(filter, '') AS filter, darks, flats FROM rep WHERE darks = 0 OR flats = 0 OR flat_gap_days > 0",
)
def _problems(frames):
    from nightledger.config import Settings

    return cal.problems_only(cal.calibration_setups(frames, Settings(cal_flat_max_days=0))).transform(_plain).select(*_SETUP, "darks", "flats")


@frames_query(
    "calibration_frame_counts",
    " SELECT count(*) FILTER (WHERE imagetyp = 'Dark Frame') AS darks, count(*) FILTER (WHERE imagetyp = 'Flat Frame') AS flats, count(*) FILTER (WHERE imagetyp = 'Bias Frame') AS bias FROM frames WHERE index_error IS NULL",
)
def _cal_counts(frames):
    return cal.calibration_frame_counts(frames)


# -- sessions and screening ----------------------------------------------------------------------------

_MS = "(epoch_us(CAST(date_obs AS TIMESTAMP)) // 1000)"


def _islands(source: str, key: str) -> str:
    return (
        f"b AS (SELECT *, {_MS} AS t_ms FROM {source} WHERE date_obs IS NOT NULL), "
        f"g AS (SELECT *, CASE WHEN t_ms - lag(t_ms) OVER (PARTITION BY {key} ORDER BY t_ms, id) <= 10800000 THEN 0 ELSE 1 END AS fresh FROM b), "
        f"i AS (SELECT *, sum(fresh) OVER (PARTITION BY {key} ORDER BY t_ms, id ROWS UNBOUNDED PRECEDING) AS island FROM g), "
        f"z AS (SELECT *, min(t_ms) OVER (PARTITION BY {key}, island) AS session_start, count(*) OVER (PARTITION BY {key}, island) AS session_frames, count(star_count) OVER (PARTITION BY {key}, island) AS session_counted FROM i)"
    )


_KEY = "lower(coalesce(object, '')), lower(coalesce(filter, '')), instrume, telescop, exptime"
_SRC = f"src AS (SELECT * FROM frames WHERE {OK_LIGHT})"


@frames_query("frame_sessions", f", {_SRC}, {_islands('src', _KEY)} SELECT id, t_ms, session_start, session_frames, session_counted FROM z")
def _frame_sessions(frames):
    from nightledger.sources.catalog import light_frames

    return sessions.frame_sessions(light_frames(frames)).select("id", "t_ms", "session_start", "session_frames", "session_counted")


@query(
    "user_sessions",
    "WITH b AS (SELECT event_id, user_id, epoch_us(ts) // 1000 AS t_ms FROM events), g AS (SELECT *, CASE WHEN t_ms - lag(t_ms) OVER (PARTITION BY user_id ORDER BY t_ms, event_id) <= 1800000 THEN 0 ELSE 1 END AS fresh FROM b), "
    "i AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY t_ms, event_id ROWS UNBOUNDED PRECEDING) AS island FROM g) SELECT user_id, min(t_ms) AS session_start, count(*) AS rows FROM i GROUP BY user_id, island",
)
def _user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sessions.sessionize(portable.table(spark, sf_dir, "events"), ["user_id"], F.col("ts"), 0.5)
    return s.groupBy(F.col("session_key.user_id").alias("user_id"), "session_start").agg(F.count(F.lit(1)).alias("rows"))


@frames_query(
    "session_medians",
    f", {_SRC}, {_islands('src', _KEY)} SELECT lower(coalesce(object, '')) AS object, lower(coalesce(filter, '')) AS filter, instrume, exptime, session_start, round(median(star_count), 6) AS stars, round(median(median_hfr), 6) AS hfr, "
    "round(median(empty_cells), 6) AS empty, round(median(bg_spread), 6) AS spread, round(median(star_flux), 6) AS flux, round(median(bg_dip), 6) AS dip FROM z WHERE star_count IS NOT NULL AND session_counted >= 3 "
    "GROUP BY 1, 2, 3, telescop, 4, session_start",
)
def _session_medians(frames):
    from nightledger.sources.catalog import light_frames

    m = sessions.session_medians(light_frames(frames))
    return m.select("session_key.object", "session_key.filter", "session_key.instrume", "session_key.exptime", "session_start", *[r6(c, c) for c in sessions.SERIES])


def _recursive(sql: str) -> str:
    return with_frames(sql).replace("WITH ", "WITH RECURSIVE ", 1)


_SCREENED = f", {_SRC}, {_islands('src', _KEY)}, {verdict_ctes(_KEY)}"


@query("screen_sessions", _recursive(f"{_SCREENED} SELECT id, {ROUNDED}, flagged AS seq_anomaly FROM verdicts"))
def _screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    from nightledger.sources.catalog import light_frames

    return rounded(screening.screen_sessions(light_frames(portable.frames(spark, sf_dir))), *screening.DEVIATIONS)


_TYPED = "coalesce(imagetyp, ''), " + _KEY


@query(
    "sequence_group",
    _recursive(
        f", src AS (SELECT * FROM frames WHERE index_error IS NULL), {_islands('src', _TYPED)}, {verdict_ctes(_TYPED)} "
        f"SELECT f.id, flagged IS NOT NULL AS judged, flagged AS anomaly, {ROUNDED}, round(1.0 - flux_drop, 6) AS transparency FROM frames f LEFT JOIN verdicts USING (id) WHERE f.filter = 'Ha' AND {OK_LIGHT}"
    ),
)
def _sequence_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = portable.frames(spark, sf_dir)
    wanted = select_frames(frames, filter="Ha").filter(F.col("index_error").isNull())
    return rounded(screening.sequence_for(frames, wanted), *screening.DEVIATIONS, "transparency")


# A selection runs over all light frames, also those that could not be indexed.
_SELECTED = _SCREENED.replace(_SRC, f"src AS (SELECT * FROM frames WHERE {LIGHT})")


@query("select_steady_sessions", _recursive(f"{_SELECTED} SELECT id FROM verdicts WHERE NOT flagged AND 1.0 - flux_drop >= 0.99"))
def _steady(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select_frames(portable.frames(spark, sf_dir), lambda v: ~v.seq_anomaly & (v.transparency >= 0.99)).select("id")
