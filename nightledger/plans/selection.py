"""Queries: search filters and selection predicates."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nightledger.functions.registry import register_sql_functions
from nightledger.functions.text import date_between, path_like
from nightledger.operators import search, selector
from nightledger.operators.selector import PRESETS, THRESHOLDS, all_of, candidates, select_frames
from nightledger.plans.registry import frames_query, r6, rounded
from nightledger.sources import sky_layout

LIGHT = "imagetyp = 'Light Frame'"


def _ids(df: DataFrame) -> DataFrame:
    return df.select("id")


# -- flagship: outliers by robust statistics ---------------------------------------

_HFR_STATS = (
    f"m AS (SELECT median(median_hfr) AS med FROM frames WHERE {LIGHT}), "
    f"d AS (SELECT median(abs(median_hfr - med)) AS mad FROM frames, m WHERE {LIGHT})"
)


def hfr_and_roundness(v):
    return (v.hfr < v.median(v.hfr) + 2 * v.mad(v.hfr)) & (v.eccentricity < 0.6)


@frames_query(
    "select_hfr_outliers",
    f", {_HFR_STATS} SELECT id, path, round(median_hfr, 6) AS median_hfr, round(eccentricity, 6) AS eccentricity "
    f"FROM frames, m, d WHERE {LIGHT} AND median_hfr < med + 2 * mad AND eccentricity < 0.6",
)
def _flagship(frames):
    df = select_frames(frames, hfr_and_roundness)
    return df.select("id", "path", r6("median_hfr", "median_hfr"), r6("eccentricity", "eccentricity"))


@frames_query(
    "select_by_sql_text",
    f", {_HFR_STATS} SELECT id FROM frames, m, d WHERE {LIGHT} AND median_hfr < med + 2 * mad AND NOT (coalesce(trail_score, 0) > 0.03) "
    "AND lower(coalesce(path, '')) NOT LIKE '%reject%'",
)
def _as_data(frames):
    hfr = {"var": "hfr"}
    limit = {"op": "+", "args": [{"op": "median", "args": [hfr]}, {"op": "*", "args": [2, {"op": "mad", "args": [hfr]}]}]}
    return _ids(select_frames(frames, {"op": "and", "args": [
        {"op": "<", "args": [hfr, limit]}, {"op": "not", "args": [{"var": "trailed"}]}, {"op": "not like", "args": [{"var": "path"}, "%reject%"]},
    ]}))


@frames_query("text_filter_capitals", f" SELECT id FROM frames WHERE {LIGHT} AND filter = 'Ha'")
def _capitals(frames):
    return _ids(select_frames(frames, {"op": "==", "args": [{"var": "filter"}, "Ha"]}))


@frames_query("text_path_capitals", f" SELECT id FROM frames WHERE {LIGHT} AND path NOT LIKE '%/Reject/%'")
def _path_capitals(frames):
    return _ids(select_frames(frames, {"op": "not like", "args": [{"var": "path"}, "%/Reject/%"]}))


@frames_query("text_unknown_not_equal", f" SELECT id FROM frames WHERE {LIGHT} AND star_flux IS DISTINCT FROM 0")
def _unknown_not_equal(frames):
    return _ids(select_frames(frames, {"op": "!=", "args": [{"var": "star_flux"}, 0]}))


@frames_query(
    "sql_functions",
    f", s AS (SELECT object, filter, median(median_hfr) AS m, avg(ra) AS ra, avg(dec) AS dec FROM frames WHERE {LIGHT} GROUP BY ALL), "
    f"d AS (SELECT s.object, s.filter, median(abs(median_hfr - m)) AS mad FROM frames f, s WHERE {LIGHT} AND f.object IS NOT DISTINCT FROM s.object AND f.filter IS NOT DISTINCT FROM s.filter GROUP BY ALL) "
    "SELECT coalesce(s.object, '') AS object, coalesce(s.filter, '') AS filter, round(mad, 6) AS mad, round(s.ra - 40 + 180 - 360 * floor((s.ra - 40 + 180) / 360) - 180, 6) AS turn, "
    "round(degrees(2 * asin(sqrt(least(1, power(sin(radians(10 - s.dec) / 2), 2) + cos(radians(s.dec)) * cos(radians(10)) * power(sin(radians(40 - s.ra) / 2), 2))))), 6) AS away "
    "FROM s JOIN d ON s.object IS NOT DISTINCT FROM d.object AND s.filter IS NOT DISTINCT FROM d.filter",
)
def _sql_functions(frames):
    register_sql_functions(frames.sparkSession)
    groups = candidates(frames).groupBy("object", "filter").agg(F.collect_list("median_hfr").alias("hfr"), F.avg("ra").alias("ra"), F.avg("dec").alias("dec"))
    return groups.selectExpr(
        "coalesce(object, '') AS object", "coalesce(filter, '') AS filter", "round(mad(hfr), 6) AS mad", "round(wrap_ra(ra - 40), 6) AS turn", "round(angsep(ra, dec, 40D, 10D), 6) AS away",
    )


# -- every statistic as a one-row query -----------------------------------------------

def _stat(name: str, sql: str, predicate_stat):
    """The frames whose HFR is at or above a statistic: ids."""

    @frames_query(f"stat_{name}", f", s AS (SELECT {sql} AS v FROM frames WHERE {LIGHT}) SELECT id FROM frames, s WHERE {LIGHT} AND star_flux >= v")
    def _run(frames):
        return _ids(select_frames(frames, lambda v: v.star_flux >= predicate_stat(v)))


_stat("median", "median(star_flux)", lambda v: v.median(v.star_flux))
_stat("mean", "avg(star_flux)", lambda v: v.mean(v.star_flux))
_stat("std", "avg(star_flux) + stddev_pop(star_flux)", lambda v: v.mean(v.star_flux) + v.std(v.star_flux))
_stat("min_max", "(min(star_flux) + max(star_flux)) / 2", lambda v: (v.min(v.star_flux) + v.max(v.star_flux)) / 2)
_stat("sum_count", "sum(star_flux) / count(star_flux)", lambda v: v.sum(v.star_flux) / v.count(v.star_flux))
_stat("percentile", "quantile_cont(star_flux, 0.9)", lambda v: v.percentile(v.star_flux, 90))


@frames_query(
    "stat_madstd",
    f", m AS (SELECT median(star_flux) AS med FROM frames WHERE {LIGHT}), d AS (SELECT 1.4826 * median(abs(star_flux - med)) AS ms FROM frames, m WHERE {LIGHT}) "
    f"SELECT id FROM frames, m, d WHERE {LIGHT} AND abs(star_flux - med) <= ms",
)
def _madstd(frames):
    return _ids(select_frames(frames, lambda v: abs(v.star_flux - v.median(v.star_flux)) <= v.madstd(v.star_flux)))


# -- predicate elements -----------------------------------------------------------------

_PREDICATES = {
    "pred_missing": (lambda v: v.missing(v.astap_ra) & v.present(v.hfr), "wcs_ra IS NULL AND median_hfr IS NOT NULL"),
    "pred_between": (lambda v: v.hfr.between(2.1, 2.3), "median_hfr BETWEEN 2.1 AND 2.3"),
    "pred_not_between": (lambda v: v.hfr.not_between(2.1, 2.3), "median_hfr < 2.1 OR median_hfr > 2.3"),
    "pred_like": (lambda v: v.path.like("%/REJECT/%") | v.filename.like("f1_.fits"), "lower(path) LIKE '%/reject/%' OR filename LIKE 'f1_.fits'"),
    "pred_not_like": (lambda v: v.path.not_like("%reject%"), "NOT (lower(path) LIKE '%reject%')"),
    "pred_unknown_not_equal": (lambda v: v.star_flux != 0, "star_flux IS NULL OR star_flux <> 0"),
    "pred_negation_of_unknown": (lambda v: ~v.trailed, "NOT coalesce(trail_score > 0.03, false)"),
    "pred_number_as_condition": (lambda v: selector.as_flag(v.streaks), "coalesce(streaks <> 0, true)"),
    "pred_text_equality": (lambda v: (v.filter == "HA") | (v.object == "obj 3"), "lower(filter) = 'ha' OR lower(object) = 'obj 3'"),
    "pred_text_missing_is_empty": (lambda v: v.object == "", "object IS NULL"),
    "pred_arithmetic": (
        lambda v: (v.hfr * 2 - v.eccentricity) / v.eccentricity > 7.25,
        "(median_hfr * 2 - eccentricity) / eccentricity > 7.25",
    ),
    "pred_divide_by_zero": (lambda v: v.star_flux / v.streaks > 1e9, "streaks = 0 AND star_flux > 0"),
    "pred_modulo_floored": (lambda v: (v.moon_alt % 7) < 2, "moon_alt - 7 * floor(moon_alt / 7) < 2"),
    "pred_sqrt_log": (
        lambda v: (v.sqrt(v.star_flux) > 215) & (v.log10(v.star_flux) < 4.68) & (v.log(v.trail_score) < -3),
        "sqrt(star_flux) > 215 AND log10(star_flux) < 4.68 AND (trail_score = 0 OR ln(nullif(trail_score, 0)) < -3)",
    ),
    "pred_date_day": (lambda v: v.date == "2024-01-15", "substr(date_obs, 1, 10) = '2024-01-15'"),
    "pred_date_range": (
        lambda v: v.date.between("2024-01-10", "2024-01-12 06:30"),
        "substr(date_obs, 1, 10) >= '2024-01-10' AND substr(date_obs, 1, 16) <= '2024-01-12T06:30'",
    ),
    "pred_date_month": (lambda v: ~(v.date < "2024-01") & (v.date <= "2024-01"), "substr(date_obs, 1, 7) = '2024-01'"),
    "pred_hour": (
        lambda v: (v.hour >= 22.5) | (v.hour < 1.25),
        "((epoch_us(CAST(date_obs AS TIMESTAMP)) // 1000) % 86400000) / 3600000.0 >= 22.5 OR ((epoch_us(CAST(date_obs AS TIMESTAMP)) // 1000) % 86400000) / 3600000.0 < 1.25",
    ),
    "pred_flags": (
        lambda v: v.light & v.osc & v.accepted | v.mono & v.rejected,
        "(coalesce(bayer, '') <> '' AND rejected = 0) OR (coalesce(bayer, '') = '' AND rejected = 1)",
    ),
    "pred_verdicts": (
        lambda v: v.good_tracking & ~v.occluded & ~v.satellite & ~v.shadow,
        "trail_score <= 0.03 AND NOT coalesce(empty_cells > 0.15, false) AND NOT coalesce(streaks > 0, false) AND NOT coalesce(bg_dip > 0.025, false)",
    ),
    "pred_off_setpoint": (lambda v: v.off_setpoint & (v.temp_delta < 4), "abs(ccd_temp - set_temp) > 1 AND ccd_temp - set_temp < 4"),
    "pred_effective_scale": (lambda v: (v.pixel_scale < 1.99) & (v.psf_fwhm_arcsec < 6.1), "coalesce(wcs_scale, pixel_scale) < 1.99 AND psf_fwhm * coalesce(wcs_scale, pixel_scale) < 6.1"),
    "pred_effective_fov": (lambda v: (v.fov > 3.3) | (v.fov_h <= 0), "greatest(coalesce(fov_w, naxis1 * coalesce(wcs_scale, pixel_scale) / 3600), coalesce(fov_h, naxis2 * coalesce(wcs_scale, pixel_scale) / 3600)) > 3.3 OR coalesce(fov_h, 1) <= 0"),
    "pred_effective_position": (lambda v: (v.ra > 40) & (v.dec < 10.2), "coalesce(wcs_ra, ra) > 40 AND coalesce(wcs_dec, dec) < 10.2"),
}

for _name, (_pred, _sql) in _PREDICATES.items():

    def _register(name=_name, pred=_pred, sql=_sql):
        @frames_query(name, f" SELECT id FROM frames WHERE {LIGHT} AND ({sql})")
        def _run(frames):
            return _ids(select_frames(frames, pred))

    _register()

_HAV = (
    "degrees(2 * asin(sqrt(least(1, power(sin((radians({d0}) - radians({d})) / 2), 2) + cos(radians({d})) * cos(radians({d0})) * "
    "power(sin((radians({r0}) - radians({r})) / 2), 2)))))"
)
_RA, _DEC = "coalesce(wcs_ra, ra)", "coalesce(wcs_dec, dec)"
_SCALE = "coalesce(wcs_scale, pixel_scale)"


def contains_sql(ra: str, dec: str, ra0: str, dec0: str, w: str, h: str) -> str:
    dra = f"(({ra0} - {ra} + 180 - 360 * floor(({ra0} - {ra} + 180) / 360)) - 180) * cos(radians({dec}))"
    dd, rot = f"({dec0} - {dec})", "radians(coalesce(wcs_rotation, 0))"
    return (
        f"coalesce(abs({dra} * cos({rot}) + {dd} * sin({rot})) <= {w} / 2 AND abs(-({dra}) * sin({rot}) + {dd} * cos({rot})) <= {h} / 2, false)"
    )


_W = f"coalesce(fov_w, naxis1 * {_SCALE} / 3600)"
_H = f"coalesce(fov_h, naxis2 * {_SCALE} / 3600)"


@frames_query("pred_angsep", f" SELECT id FROM frames WHERE {LIGHT} AND {_HAV.format(r=_RA, d=_DEC, r0='359.9', d0='(-9.6)')} <= 0.35")
def _angsep(frames):
    return _ids(select_frames(frames, lambda v: v.angsep(359.9, -9.6) <= 0.35))


@frames_query("pred_contains", f" SELECT id FROM frames WHERE {LIGHT} AND {contains_sql(_RA, _DEC, '0.6', '(-9.1)', _W, _H)}")
def _contains(frames):
    return _ids(select_frames(frames, lambda v: v.contains(0.6, -9.1)))


@frames_query("pred_custom_function", f" SELECT id FROM frames WHERE {LIGHT} AND median_hfr * eccentricity < 1.2")
def _custom(frames):
    return _ids(select_frames(frames, lambda v: v.blur(v.hfr) < 1.2, funcs={"blur": lambda v, x: x * v.eccentricity}))


@frames_query("select_everything", f" SELECT count(*) AS n FROM frames WHERE {LIGHT}")
def _everything(frames):
    return select_frames(frames).agg(F.count(F.lit(1)).alias("n"))


# -- presets and clause builder -------------------------------------------------------------


@frames_query(
    "presets_combined",
    f", q AS (SELECT quantile_cont(quality_score, 0.25) AS q25 FROM frames WHERE {LIGHT}) SELECT id FROM frames, q WHERE {LIGHT} AND quality_score > q25 "
    "AND trail_score <= 0.03 AND solved = 1 AND NOT coalesce(rejected = 1, false) AND coalesce(bayer, '') = '' AND NOT coalesce(abs(ccd_temp - set_temp) > 1, false) "
    "AND lower(path) NOT LIKE '%reject%'",
)
def _presets(frames):
    wanted = ["quality_above_lower_quartile", "tracked_well", "has_plate_solution", "not_rejected", "mono_camera", "cooled_to_setpoint", "path_without_reject"]
    return _ids(select_frames(frames, all_of(*[PRESETS[n] for n in wanted])))


@frames_query(
    "threshold_clauses",
    f" SELECT id FROM frames WHERE {LIGHT} AND median_hfr < 2.35 AND eccentricity < 0.7 AND star_count > 410 AND altitude > 25 AND airmass < 1.8 "
    f"AND moon_sep > 15 AND moon_illum < 0.9 AND {_SCALE} < 2.5 AND focal_length > 399 AND focal_length < 601 AND greatest({_W}, {_H}) > 1",
)
def _thresholds(frames):
    limits = {
        "hfr_max": 2.35, "ecc_max": 0.7, "stars_min": 410, "alt_min": 25, "airmass_max": 1.8, "moonsep_min": 15, "moonillum_max": 0.9,
        "pixscale_max": 2.5, "focal_min": 399, "focal_max": 601, "fov_min": 1,
    }
    return _ids(select_frames(frames, all_of(*[THRESHOLDS[k](x) for k, x in limits.items()])))


# -- base filters and search -------------------------------------------------------------------

_SEARCHES = {
    "search_tombstones": (dict(indexing="failed"), "index_error IS NOT NULL"),
    "search_object_contains": (dict(object="bj 2"), "index_error IS NULL AND object ILIKE '%bj 2%'"),
    "search_exact_lists": (
        dict(image_type="Light Frame, Dark Frame", filter="Ha,OIII", telescope="scope1", camera="cam1"),
        "index_error IS NULL AND imagetyp IN ('Light Frame', 'Dark Frame') AND filter IN ('Ha', 'OIII') AND telescop = 'scope1' AND instrume = 'cam1'",
    ),
    "search_dates": (dict(date_from="2024-01-05", date_to="2024-01-07"), "index_error IS NULL AND date_obs >= '2024-01-05' AND date_obs <= '2024-01-07T23:59:59.999999999'"),
    "search_ranges": (
        dict(exposure_min=100, exposure_max=400, focal_length_min=500, focal_length_max=700, hfr_max=2.3, fwhm_max=3.4, eccentricity_max=0.6, trail_score_max=0.05, stars_min=405, quality_min=50),
        "index_error IS NULL AND exptime BETWEEN 100 AND 400 AND focal_length BETWEEN 500 AND 700 AND median_hfr <= 2.3 AND median_fwhm <= 3.4 AND eccentricity <= 0.6 AND trail_score <= 0.05 AND star_count >= 405 AND quality_score >= 50",
    ),
    "search_ranges_grid": (dict(psf_fwhm_max=3.2, empty_cells_max=0.1, background_dip_max=0.02), "index_error IS NULL AND psf_fwhm <= 3.2 AND empty_cells <= 0.1 AND bg_dip <= 0.02"),
    "search_verdicts_true": (dict(good_tracking=True, shadow=True, satellite=False), "index_error IS NULL AND trail_score <= 0.03 AND bg_dip > 0.025 AND streaks = 0"),
    "search_occluded": (dict(occluded=True, fwhm_max=3.3), "index_error IS NULL AND empty_cells > 0.15 AND median_fwhm <= 3.3"),
    "search_verdicts_false": (dict(good_tracking=False, occluded=False, shadow=False, satellite=True), "index_error IS NULL AND trail_score > 0.03 AND empty_cells <= 0.15 AND bg_dip <= 0.025 AND streaks > 0"),
    "search_grades": (dict(grade="accepted,unmarked"), "index_error IS NULL AND (rejected = 0 OR rejected IS NULL)"),
    "search_rejected": (dict(rejected=True), "index_error IS NULL AND rejected = 1"),
    "search_not_solved": (dict(solved=False, indexing="all"), "solved IS NULL OR solved <> 1"),
    "search_colour": (dict(color="osc"), "index_error IS NULL AND coalesce(bayer, '') <> ''"),
    "search_mono": (dict(color="mono"), "index_error IS NULL AND coalesce(bayer, '') = ''"),
    "search_format": (dict(file_format="xisf"), "index_error IS NULL AND lower(path) LIKE '%.xisf'"),
    "search_paths": (dict(path_like_="\\GOOD\\", path_not_like="%/view/%"), "index_error IS NULL AND path ILIKE '%/good/%' AND NOT (path ILIKE '%/view/%')"),
    "search_ids": (dict(ids="1,2,3,500,9999999"), "index_error IS NULL AND id IN (1, 2, 3, 500, 9999999)"),
    "search_library_root": (dict(watched_path_id=2), "index_error IS NULL AND watched_path_id = 2"),
    "search_indexed_since": (dict(indexed_since=datetime(2024, 1, 20, 12)), "index_error IS NULL AND indexed_at >= TIMESTAMP '2024-01-20 12:00:00'"),
    "search_cone": (dict(near=(0.1, -9.6, 0.4)), f"index_error IS NULL AND {_HAV.format(r=_RA, d=_DEC, r0='0.1', d0='(-9.6)')} <= 0.4"),
    "search_covers": (dict(covers=(40.9, 10.9)), f"index_error IS NULL AND {contains_sql(_RA, _DEC, '40.9', '10.9', _W, _H)}"),
}


@frames_query("stored_cone", f" SELECT id FROM frames WHERE {_HAV.format(r=_RA, d=_DEC, r0='0.1', d0='(-9.6)')} <= 0.4")
def _stored_cone(frames):
    return _ids(sky_layout.stored_cone(sky_layout.with_sky(frames), 0.1, -9.6, 0.4))


@frames_query("stored_covers", f" SELECT id FROM frames WHERE {contains_sql(_RA, _DEC, '40.9', '10.9', _W, _H)}")
def _stored_covers(frames):
    return _ids(sky_layout.stored_covering(sky_layout.with_sky(frames), 40.9, 10.9))


for _name, (_args, _sql) in _SEARCHES.items():

    def _register_search(name=_name, args=_args, sql=_sql):
        @frames_query(name, f" SELECT id FROM frames WHERE {sql}")
        def _run(frames):
            return _ids(search.search_frames(frames, **args))

    _register_search()


@frames_query(
    "search_where_after_filters",
    f", b AS (SELECT * FROM frames WHERE index_error IS NULL AND {LIGHT} AND filter = 'Ha'), m AS (SELECT median(star_flux) AS med FROM b) "
    f"SELECT id FROM b, m WHERE star_flux < med AND {_HAV.format(r=_RA, d=_DEC, r0='40', d0='10')} <= 1",
)
def _where(frames):
    return _ids(search.search_frames(frames, image_type="Light Frame", filter="Ha", near=(40.0, 10.0, 1.0), where=lambda v: v.star_flux < v.median(v.star_flux)))


@frames_query("selector_base_filters", " SELECT id FROM frames WHERE imagetyp = 'Light Frame' AND object ILIKE '%OBJ 1%' AND filter = 'L' AND telescop = 'scope1' AND date_obs >= '2024-01-03' AND date_obs <= '2024-01-20T23:59:59.999999999'")
def _base(frames):
    return _ids(selector.candidates(frames, object="OBJ 1", filter="L", telescop="scope1", date_from="2024-01-03", date_to="2024-01-20"))


@frames_query("facet_drilldown", " SELECT id FROM frames WHERE imagetyp = 'Light Frame' AND date_obs >= '2024-01-09' AND date_obs <= '2024-01-09T23:59:59.999999999'")
def _drill(frames):
    return _ids(select_frames(frames, date_from="2024-01-09", date_to="2024-01-09"))


@frames_query("date_and_path_predicates", " SELECT count(*) AS n FROM frames WHERE date_obs >= '2024-01-02' AND date_obs <= '2024-01-02T11:59:59.999999999' AND path ILIKE '%/f1%'")
def _dp(frames):
    cond = date_between(F.col("date_obs"), "2024-01-02", "2024-01-02 11") & path_like(F.col("path"), "/f1")
    return frames.filter(cond).agg(F.count(F.lit(1)).alias("n"))


# -- the query result --------------------------------------------------------------------------

_APPROVED = f", {_HFR_STATS}, c AS (SELECT * FROM frames WHERE {LIGHT}), ap AS (SELECT c.* FROM c, m, d WHERE median_hfr < med + 2 * mad AND eccentricity < 0.6)"


@frames_query("query_counts", _APPROVED + " SELECT (SELECT count(*) FROM c) AS total, (SELECT count(*) FROM ap) AS approved, (SELECT count(*) FROM c) - (SELECT count(*) FROM ap) AS rejected, CAST(greatest(1, ceil((SELECT count(*) FROM ap) / 50.0)) AS BIGINT) AS pages")
def _counts(frames):
    return selector.run_query(frames, hfr_and_roundness).counts


@frames_query(
    "query_facets",
    _APPROVED + ", v AS (SELECT 'instrume' AS facet, instrume AS value FROM ap UNION ALL SELECT 'telescop', telescop FROM ap UNION ALL SELECT 'object', object FROM ap "
    "UNION ALL SELECT 'filter', filter FROM ap UNION ALL SELECT 'date', substr(date_obs, 1, 10) FROM ap), n AS (SELECT facet, value, count(*) AS count FROM v WHERE value <> '' GROUP BY ALL), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY facet ORDER BY count DESC, value) AS rank FROM n) "
    "SELECT facet, value, count, CAST(rank AS INT) AS rank FROM r WHERE rank <= CASE WHEN facet = 'date' THEN 90 ELSE 40 END",
)
def _facets(frames):
    return selector.run_query(frames, hfr_and_roundness).facets


@frames_query("query_page", _APPROVED + " SELECT id FROM ap ORDER BY id LIMIT 50 OFFSET 100")
def _page(frames):
    return _ids(selector.run_query(frames, hfr_and_roundness, page=3).items)


_METRIC_SQL = " UNION ALL ".join(
    f"SELECT '{m}' AS metric, CAST({c} AS DOUBLE) AS v FROM frames WHERE {LIGHT}" for m, c in
    [("hfr", "median_hfr"), ("fwhm", "median_fwhm"), ("eccentricity", "eccentricity"), ("stars", "star_count"), ("quality", "quality_score"),
     ("altitude", "altitude"), ("airmass", "airmass"), ("moon_sep", "moon_sep"), ("moon_illum", "moon_illum"), ("background", "background_median"),
     ("pixel_scale", "pixel_scale"), ("focal", "focal_length"), ("empty_cells", "empty_cells"), ("bg_spread", "bg_spread"), ("bg_dip", "bg_dip"),
     ("psf_fwhm", "psf_fwhm"), ("psf_beta", "psf_beta"), ("star_flux", "star_flux")]
)


@frames_query(
    "metric_summary",
    f", v AS (SELECT * FROM ({_METRIC_SQL}) WHERE v IS NOT NULL), m AS (SELECT metric, median(v) AS med FROM v GROUP BY metric), "
    "d AS (SELECT metric, median(abs(v - med)) AS mad FROM v JOIN m USING (metric) GROUP BY metric) "
    "SELECT metric, round(any_value(med), 6) AS median, round(any_value(mad), 6) AS mad, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, round(min(v), 6) AS min, round(max(v), 6) AS max "
    "FROM v JOIN m USING (metric) JOIN d USING (metric) GROUP BY metric",
)
def _summary(frames):
    from nightledger.operators.rollups import metric_summary

    return rounded(metric_summary(selector.candidates(frames), rounded=False), "median", "mad", "mean", "std", "min", "max")
