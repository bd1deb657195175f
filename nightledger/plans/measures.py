"""Queries: star tables, background maps, run comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nightledger.operators import analysis, background, compare, stars
from nightledger.plans import portable
from nightledger.plans.registry import ORACLES, longs, query, r6, rounded, with_ctes

_D = ("d", portable.DETECTIONS_SQL)
_I = ("i", portable.FRAME_INFO_SQL)
_C = ("c", portable.BG_CELLS_SQL)
_VALID = "a > 0 AND b > 0 AND flux > 0"
_CODE = (
    "SELECT d.*, CASE WHEN peak + back_level >= 0.95 * sat_level THEN 1 WHEN x < 16 OR y < 16 OR x > width - 17 OR y > height - 17 OR (flag & 10) <> 0 THEN 2 "
    "WHEN (flag & 1) <> 0 THEN 3 ELSE 0 END AS code FROM d JOIN i USING (frame_id)"
)
_ORDER = "PARTITION BY frame_id ORDER BY flux DESC, x, y, a, b"
_SAMPLE = (
    f"n AS (SELECT frame_id, count(*) FILTER (WHERE code = 0) AS clean, count(*) FILTER (WHERE code IN (0, 3)) AS unclipped FROM k WHERE {_VALID} GROUP BY frame_id), "
    "u AS (SELECT frame_id, CASE WHEN (CASE WHEN clean >= 30 THEN clean ELSE unclipped END) < 5 THEN 'all' WHEN clean >= 30 THEN 'clean' ELSE 'unclipped' END AS use FROM n), "
    f"s AS (SELECT k.*, use, row_number() OVER ({_ORDER}) AS rank FROM k JOIN u USING (frame_id) WHERE {_VALID} AND (use = 'all' OR (use = 'clean' AND code = 0) OR (use = 'unclipped' AND code IN (0, 3))) QUALIFY rank <= 200)"
)


def _classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stars.classify_sources(portable.detections(spark, sf_dir), portable.frame_info(spark, sf_dir))


@query("star_counts", with_ctes("SELECT frame_id, count(*) AS star_count FROM d GROUP BY frame_id", _D))
def _counts(spark, sf_dir):
    return stars.star_counts(portable.detections(spark, sf_dir))


@query("source_codes", with_ctes(f"SELECT frame_id, CAST(code AS BIGINT) AS code, count(*) AS n FROM ({_CODE}) WHERE {_VALID} GROUP BY ALL", _D, _I))
def _codes(spark, sf_dir):
    return longs(stars.valid_sources(_classified(spark, sf_dir)).groupBy("frame_id", "code").agg(F.count(F.lit(1)).alias("n")), "code")


@query("shape_sample", with_ctes(f", k AS ({_CODE}), {_SAMPLE} SELECT frame_id, CAST(rank AS INT) AS rank, round(flux, 6) AS flux, use <> 'all' AS clean_sample FROM s", _D, _I))
def _sample(spark, sf_dir):
    return rounded(stars.shape_sample(_classified(spark, sf_dir)).select("frame_id", "rank", "flux", "clean_sample"), "flux")


@query(
    "shape_metrics",
    with_ctes(
        f", k AS ({_CODE}), {_SAMPLE} SELECT frame_id, round(median(2.3548 * sqrt(a * b)), 6) AS median_fwhm, round(median(sqrt(greatest(0, least(1, 1 - (b / a) * (b / a))))), 6) AS eccentricity, "
        "round(median(hfr) FILTER (WHERE hfr > 0 AND hfr_flag = 0), 6) AS median_hfr, "
        "CASE WHEN count(psf_fwhm) FILTER (WHERE rank <= 40 AND use <> 'all') >= 5 THEN round(median(psf_fwhm) FILTER (WHERE rank <= 40 AND use <> 'all'), 6) END AS psf_fwhm, "
        "CASE WHEN count(psf_fwhm) FILTER (WHERE rank <= 40 AND use <> 'all') >= 5 THEN round(median(psf_beta) FILTER (WHERE rank <= 40 AND use <> 'all' AND psf_fwhm IS NOT NULL), 6) END AS psf_beta FROM s GROUP BY frame_id",
        _D, _I,
    ),
)
def _shape(spark, sf_dir):
    return rounded(stars.shape_metrics(_classified(spark, sf_dir)), "median_fwhm", "eccentricity", "median_hfr", "psf_fwhm", "psf_beta")


@query(
    "star_flux",
    with_ctes(
        f"SELECT frame_id, CASE WHEN count(*) >= 40 THEN round(median(flux) FILTER (WHERE rank BETWEEN 21 AND 200), 6) END AS star_flux FROM (SELECT frame_id, flux, row_number() OVER ({_ORDER}) AS rank FROM d WHERE {_VALID}) GROUP BY frame_id",
        _D,
    ),
)
def _flux(spark, sf_dir):
    return rounded(stars.star_flux(portable.detections(spark, sf_dir)), "star_flux")


_RADIANS_15 = "0.2617993877991494"
_STREAKS = (
    f"t AS (SELECT *, CAST(row_number() OVER ({_ORDER}) AS INT) AS rank FROM d WHERE {_VALID} QUALIFY rank <= 200), "
    "e AS (SELECT frame_id, rank, x, y, theta, a * sqrt(12) AS len, b FROM t WHERE a / b > 2), "
    "g AS (SELECT p.frame_id, p.rank AS i, q.rank AS j, p.len + q.len AS len, p.b + q.b AS wid, q.x - p.x AS gx, q.y - p.y AS gy, p.theta - q.theta AS turn, "
    "atan2(sin(2 * p.theta) + sin(2 * q.theta), cos(2 * p.theta) + cos(2 * q.theta)) / 2 AS dir FROM e p JOIN e q ON p.frame_id = q.frame_id AND p.rank <> q.rank), "
    f"l AS (SELECT frame_id, i, j FROM g WHERE abs(turn + pi() / 2 - pi() * floor((turn + pi() / 2) / pi()) - pi() / 2) < {_RADIANS_15} "
    f"AND abs(gy * cos(dir) - gx * sin(dir)) < least(15, wid / 2 + abs(gx * cos(dir) + gy * sin(dir)) * tan({_RADIANS_15})) AND abs(gx * cos(dir) + gy * sin(dir)) <= 3 * len / 2), "
    "r AS (SELECT frame_id, rank AS i, rank AS j FROM e UNION SELECT r.frame_id, r.i, l.j FROM r JOIN l ON l.frame_id = r.frame_id AND l.i = r.j), "
    "m AS (SELECT frame_id, i AS rank, true AS hit FROM r GROUP BY frame_id, i HAVING count(*) >= 3), "
    "f AS (SELECT t.*, coalesce(hit, false) AS fragment FROM t LEFT JOIN m USING (frame_id, rank))"
)


def _with_streaks(select: str) -> str:
    return f"WITH RECURSIVE d AS ({portable.DETECTIONS_SQL}), {_STREAKS} {select}"


@query("streak_fragments", _with_streaks("SELECT frame_id, rank, fragment FROM f"))
def _fragments(spark, sf_dir):
    f = stars.streak_fragments(portable.detections(spark, sf_dir))
    return f.select("frame_id", "rank", "fragment")


@query("trail_scores", _with_streaks(
    "SELECT frame_id, CASE WHEN count(*) FILTER (WHERE NOT fragment) >= 5 THEN round(greatest(0, (avg(CASE WHEN a / b > 2 AND off < 15 THEN 1.0 ELSE 0.0 END) FILTER (WHERE NOT fragment) "
    "- avg(CASE WHEN a / b > 2 THEN 1.0 ELSE 0.0 END) FILTER (WHERE NOT fragment) / 6) / (5.0 / 6)), 6) END AS trail_score FROM ("
    "SELECT f.*, abs(degrees(theta - axis) + 90 - 180 * floor((degrees(theta - axis) + 90) / 180) - 90) AS off FROM f JOIN ("
    "SELECT frame_id, atan2(avg((1 - b / a) * sin(2 * theta)) FILTER (WHERE NOT fragment), avg((1 - b / a) * cos(2 * theta)) FILTER (WHERE NOT fragment)) / 2 AS axis FROM f GROUP BY frame_id) USING (frame_id)) GROUP BY frame_id"
))
def _trails(spark, sf_dir):
    return rounded(stars.trail_scores(portable.detections(spark, sf_dir)), "trail_score")


@query("overlay_stars", with_ctes(
    f", k AS ({_CODE}), {_SAMPLE}, rest AS (SELECT k.frame_id, k.flux, row_number() OVER (PARTITION BY k.frame_id ORDER BY k.flux DESC, k.x, k.y, k.a, k.b) AS rk FROM k "
    "LEFT JOIN s ON s.frame_id = k.frame_id AND s.flux = k.flux AND s.x = k.x AND s.y = k.y AND s.a = k.a AND s.b = k.b AND s.theta = k.theta WHERE s.frame_id IS NULL AND k.a > 0 AND k.b > 0 AND k.flux > 0 QUALIFY rk <= 100) "
    "SELECT frame_id, CAST(rank AS INT) AS rank, 1 AS used FROM s UNION ALL SELECT frame_id, CAST(rk AS INT), 0 FROM rest",
    _D, _I,
))
def _overlay(spark, sf_dir):
    return stars.overlay_stars(_classified(spark, sf_dir)).select("frame_id", "rank", "used")


# -- grid and background -------------------------------------------------------------------------------

_CELL = "least(5, CAST(floor(y * 6 / height) AS INT)) * 8 + least(7, CAST(floor(x * 8 / width) AS INT))"


@query("grid_cell_counts", with_ctes(f"SELECT frame_id, CAST({_CELL} AS BIGINT) AS cell, count(*) AS stars FROM d JOIN i USING (frame_id) GROUP BY ALL", _D, _I))
def _cells(spark, sf_dir):
    c = background.cell_counts(portable.detections(spark, sf_dir), portable.frame_info(spark, sf_dir))
    flat = c.select("frame_id", F.posexplode("cell_stars").alias("cell", "stars"))
    return longs(flat.filter("stars > 0"), "cell")


_SPARSE = "SELECT * FROM d WHERE NOT (x < 1600 AND frame_id % 2 = 0)"


@query(
    "empty_patches",
    "WITH RECURSIVE " + ", ".join(f"{n} AS ({q})" for n, q in (
        _D, _I, ("sd", _SPARSE), ("n", f"SELECT frame_id, {_CELL} AS cell, count(*) AS stars FROM sd JOIN i USING (frame_id) GROUP BY ALL"),
        ("grid", "SELECT frame_id, g.cell, coalesce(stars, 0) AS stars FROM i CROSS JOIN (SELECT range AS cell FROM range(48)) AS g LEFT JOIN n USING (frame_id, cell)"),
        ("mid", "SELECT frame_id, median(stars) AS m FROM grid GROUP BY frame_id"),
        ("e", "SELECT frame_id, cell FROM grid JOIN mid USING (frame_id) WHERE m >= 5 AND stars < 0.2 * m"),
        ("reach", "SELECT frame_id, cell AS root, cell FROM e UNION SELECT r.frame_id, r.root, e.cell FROM reach r JOIN e ON e.frame_id = r.frame_id AND (abs(e.cell - r.cell) = 8 OR (abs(e.cell - r.cell) = 1 AND e.cell // 8 = r.cell // 8))"),
        ("sizes", "SELECT frame_id, max(s) AS s FROM (SELECT frame_id, root, count(*) AS s FROM reach GROUP BY ALL) GROUP BY frame_id"),
    )) + " SELECT frame_id, CASE WHEN m >= 5 THEN round(coalesce(s, 0) / 48.0, 6) END AS empty_cells, CAST(coalesce(s, 0) AS BIGINT) AS cluster FROM mid LEFT JOIN sizes USING (frame_id)",
)
def _patches(spark, sf_dir):
    sparse = portable.detections(spark, sf_dir).filter("NOT (x < 1600 AND frame_id % 2 = 0)")
    p = background.empty_patches(background.cell_counts(sparse, portable.frame_info(spark, sf_dir)))
    return longs(p.select("frame_id", r6("empty_cells", "empty_cells"), F.size("empty_cluster").alias("cluster")), "cluster")


@query(
    "background_spread",
    with_ctes("SELECT frame_id, round((quantile_cont(level, 0.9) - quantile_cont(level, 0.1)) / nullif(any_value(rms), 0), 6) AS bg_spread FROM c JOIN i USING (frame_id) GROUP BY frame_id", _C, _I),
)
def _spread(spark, sf_dir):
    return rounded(background.background_spread(portable.bg_cells(spark, sf_dir), portable.frame_info(spark, sf_dir)).select("frame_id", "bg_spread"), "bg_spread")


@query(
    "bright_cells",
    with_ctes(
        ", m AS (SELECT frame_id, median(level) AS mid FROM c GROUP BY frame_id), o AS (SELECT frame_id, row, col, (level - mid) / rms AS offs FROM c JOIN m USING (frame_id) JOIN i USING (frame_id) WHERE rms > 0), "
        "q AS (SELECT frame_id, list_sort(list(offs)) AS l FROM o GROUP BY frame_id), t AS (SELECT frame_id, greatest(3, l[37] + 1.5 * (l[37] - l[13])) AS lim FROM q) "
        "SELECT frame_id, row, col, round(offs, 6) AS \"offset\" FROM o JOIN t USING (frame_id) WHERE offs > lim",
        _C, _I,
    ),
)
def _bright(spark, sf_dir):
    offsets = background.cell_offsets(portable.bg_cells(spark, sf_dir), portable.frame_info(spark, sf_dir)).filter(F.col("offset").isNotNull())
    return rounded(background.bright_cells(offsets), "offset")


@query("background_dips")
def _dips(spark, sf_dir):
    return rounded(background.background_dips(portable.bg_blocks(spark, sf_dir), portable.block_info(spark, sf_dir)).drop("dip_box"), "bg_dip")


@query("frame_metrics")
def _metrics(spark, sf_dir):
    m = analysis.frame_metrics(
        portable.detections(spark, sf_dir), portable.bg_cells(spark, sf_dir), portable.bg_blocks(spark, sf_dir), portable.frame_info(spark, sf_dir),
        block_info=portable.block_info(spark, sf_dir),
    )
    return rounded(m, *[f.name for f in m.schema if f.dataType.simpleString() == "double"])


def _unrounded(name: str) -> str:
    """An oracle of one measure, to be scaled before it is rounded."""
    return f"({ORACLES[name].replace(', 6)', ', 15)')})"


def _widened(name: str, sigmas: float) -> str:
    """A size on 2 x 2 bins in sensor pixels: the box variance comes off in quadrature."""
    return f"CASE WHEN mosaic THEN {sigmas} * sqrt(greatest(pow({name} * 2 / {sigmas}, 2) - 4 / 12.0, 0.25 * pow({name} * 2 / {sigmas}, 2))) ELSE {name} END"


@query(
    "frame_star_quality",
    with_ctes(
        f", j AS (SELECT *, coalesce(regexp_matches(upper(trim(bayer)), '^[RGB]{{4}}$'), false) AS mosaic, 206.265 * pixsz * xbinning / focal_length AS scale FROM i LEFT JOIN {_unrounded('star_counts')} USING (frame_id) "
        f"LEFT JOIN {_unrounded('shape_metrics')} USING (frame_id) LEFT JOIN {_unrounded('star_flux')} USING (frame_id) LEFT JOIN {_unrounded('trail_scores')} USING (frame_id) "
        f"LEFT JOIN {_unrounded('empty_patches').replace(_SPARSE, 'SELECT * FROM d')} USING (frame_id) LEFT JOIN {_unrounded('background_spread')} USING (frame_id)), "
        f"p AS (SELECT *, {_widened('median_fwhm', 2.3548)} AS fwhm, {_widened('median_hfr', 1.1774)} AS hfr, {_widened('psf_fwhm', 2.3548)} AS psf FROM j) "
        "SELECT frame_id, coalesce(star_count, 0) AS star_count, round(hfr, 6) AS median_hfr, round(fwhm, 6) AS median_fwhm, round(nullif(fwhm, 0) * nullif(scale, 0), 6) AS fwhm_arcsec, round(eccentricity, 6) AS eccentricity, "
        "round(CASE WHEN exptime < 1 THEN 0 ELSE trail_score END, 6) AS trail_score, round(back_median, 6) AS background_median, round(scale, 6) AS pixel_scale, round(empty_cells, 6) AS empty_cells, "
        "round(bg_spread, 6) AS bg_spread, round(psf, 6) AS psf_fwhm, round(psf_beta, 6) AS psf_beta, round(CASE WHEN mosaic THEN star_flux * 4 ELSE star_flux END, 6) AS star_flux, streaks FROM p",
        _I,
    ),
)
def _star_quality(spark, sf_dir):
    """The assembled columns that SQL can express: all but the dips and the score, which `quality_scores` checks."""
    m = analysis.frame_metrics(
        portable.detections(spark, sf_dir), portable.bg_cells(spark, sf_dir), portable.bg_blocks(spark, sf_dir), portable.frame_info(spark, sf_dir),
        block_info=portable.block_info(spark, sf_dir),
    ).drop("bg_dip", "quality_score")
    return rounded(m, *[f.name for f in m.schema if f.dataType.simpleString() == "double"])


@query("diagnostics_documents")
def _documents(spark, sf_dir):
    info = portable.frame_info(spark, sf_dir)
    grid = background.grid_metrics(portable.detections(spark, sf_dir), portable.bg_cells(spark, sf_dir), info)
    dips = background.background_dips(portable.bg_blocks(spark, sf_dir), portable.block_info(spark, sf_dir))
    return stars.diagnostics_rows(_classified(spark, sf_dir), grid, info, dips=dips)


# -- paired runs ------------------------------------------------------------------------------------------

_R = ("r", portable.RUNS_SQL)
_NAMES = list(compare.TOLERANCES)
_LONG = " UNION ALL ".join(f"SELECT file, repeat, variant, '{m}' AS metric, {m} AS v FROM r" for m in _NAMES)
_PAIRS = (
    f", l AS ({_LONG}), p AS (SELECT x.file, x.repeat, x.metric, x.v AS va, y.v AS vb, abs(x.v - y.v) AS diff, CASE WHEN y.v <> 0 THEN abs(x.v - y.v) / abs(y.v) WHEN x.v = y.v THEN 0 ELSE 1 END AS rel "
    "FROM l x JOIN l y ON x.file = y.file AND x.repeat = y.repeat AND x.metric = y.metric AND x.variant = 'float32' AND y.variant = 'float64')"
)


@query("paired_metrics", with_ctes(
    f", l AS ({_LONG}), p AS (SELECT file, repeat, metric, max(v) FILTER (WHERE variant = 'float32') AS va, max(v) FILTER (WHERE variant = 'float64') AS vb FROM l GROUP BY ALL) "
    "SELECT file, repeat, metric, round(abs(va - vb), 9) AS abs_diff, round(CASE WHEN vb <> 0 THEN abs(va - vb) / abs(vb) WHEN va = vb THEN 0 ELSE 1 END, 9) AS rel_diff FROM p WHERE va IS NOT NULL AND vb IS NOT NULL",
    _R,
))
def _pairs(spark, sf_dir):
    p = compare.metric_pairs(portable.bench_runs(spark, sf_dir))
    return p.select("file", "repeat", "metric", F.round("abs_diff", 9).alias("abs_diff"), F.round("rel_diff", 9).alias("rel_diff"))


_LIMITS = [("star_count", 0.005), ("median_hfr", 0.01), ("median_fwhm", 0.01), ("eccentricity", 0.01), ("background_median", 0.01)]  # fixed values
_TOL = "CASE metric " + " ".join(f"WHEN '{m}' THEN {t}" for m, t in _LIMITS) + " END"


@query(
    "compare_runs",
    with_ctes(
        f"{_PAIRS}, w AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY rel DESC, file, repeat) AS k FROM p) "
        "SELECT metric, count(*) AS n, round(max(rel) * 100, 6) AS max_rel_pct, round(max(diff) FILTER (WHERE k = 1 AND rel > 0), 6) AS max_abs, max(file) FILTER (WHERE k = 1 AND rel > 0) AS worst_file, "
        f"max(rel) > {_TOL} AS flagged FROM w GROUP BY metric HAVING max(rel) > 0",
        _R,
    ),
)
def _compare(spark, sf_dir):
    c = compare.compare_runs(portable.bench_runs(spark, sf_dir), rounded=False).filter("max_rel_pct > 0")
    return rounded(c.drop("tol_pct"), "max_rel_pct", "max_abs")


@query(
    "phase_means",
    with_ctes(
        ", both_ran AS (SELECT file, repeat FROM r GROUP BY ALL HAVING count(DISTINCT variant) = 2), t AS (SELECT variant, read, quality, total FROM r JOIN both_ran USING (file, repeat)), "
        "f AS (SELECT variant, 'read' AS phase, read AS s FROM t UNION ALL SELECT variant, 'quality', quality FROM t UNION ALL SELECT variant, 'total', total FROM t), "
        "m AS (SELECT phase, avg(s) FILTER (WHERE variant = 'float32') AS a, avg(s) FILTER (WHERE variant = 'float64') AS b FROM f GROUP BY phase) "
        "SELECT phase, round(a, 6) AS mean_a, round(b, 6) AS mean_b, round(b / a, 6) AS speedup FROM m",
        _R,
    ),
)
def _phases(spark, sf_dir):
    return rounded(compare.phase_means(portable.bench_runs(spark, sf_dir), rounded=False), "mean_a", "mean_b", "speedup")


@query("run_counts", with_ctes("SELECT count(*) AS runs, 0 AS skipped, 0 AS errors FROM r", _R))
def _run_counts(spark, sf_dir):
    return compare.run_counts(portable.bench_runs(spark, sf_dir))
