
import pytest
from pyspark.sql import functions as F

from nightledger.operators.predicates import date_span
from nightledger.operators.selector import PRESETS, filter_view, run_query, select_frames
from nightledger.operators.search import search_frames
from nightledger.operators.fields import parse_fields, project_fields, run_saved_query
from nightledger.operators.paging import sort_spec
from tests.conftest import ids


def approved(df, predicate):
    return ids(filter_view(df, predicate))


def test_statistics(make_frames):
    df = make_frames(*[{"median_hfr": h} for h in (2.0, 2.5, 8.0, 2.2, 3.0)])
    assert approved(df, lambda v: v.hfr < 3) == [1, 2, 4]
    assert approved(df, lambda v: v.hfr < v.median(v.hfr) + 2 * v.mad(v.hfr)) == [1, 2, 4, 5]
    assert approved(df, {"op": "<", "args": [{"var": "hfr"}, {"op": "+", "args": [{"op": "median", "args": [{"var": "hfr"}]}, {"op": "*", "args": [2, {"op": "mad", "args": [{"var": "hfr"}]}]}]}]}) == [1, 2, 4, 5]
    assert approved(df, lambda v: v.hfr <= v.percentile(v.hfr, 25)) == [1, 4]
    # A statistic of an expression that itself uses one.
    assert approved(df, lambda v: abs(v.hfr - v.median(v.hfr)) <= v.median(abs(v.hfr - v.median(v.hfr)))) == [1, 2, 4, 5]


def test_unknown_values(make_frames):
    df = make_frames({"median_hfr": 2.0}, {"median_hfr": None}, {"median_hfr": float("nan")}, {"median_hfr": 2.5})
    from nightledger.schema import conform

    df = conform(df)
    assert approved(df, lambda v: v.hfr < 3) == [1, 4]
    assert approved(df, lambda v: ~(v.hfr < 2.2)) == [2, 3, 4]
    assert approved(df, lambda v: v.hfr != 2.0) == [2, 3, 4]
    assert approved(df, lambda v: v.hfr.not_between(2.2, 3)) == [1]
    assert approved(df, lambda v: v.missing(v.hfr)) == [2, 3]
    assert approved(df, lambda v: v.present(v.hfr)) == [1, 4]
    assert approved(df, lambda v: v.hfr.between(1.5, v.median(v.hfr))) == [1]
    assert approved(df, lambda v: v.hfr < v.median(v.fwhm)) == []
    assert approved(df, lambda v: v.sum(v.fwhm) + v.count(v.hfr) >= v.stars * 0 + 2) == []
    assert approved(df, lambda v: v.hfr.like("%2%")) == []


def test_arithmetic(make_frames):
    df = make_frames({"star_flux": 6.0, "streaks": 0}, {"star_flux": 0.0, "streaks": 0}, {"star_flux": -7.0, "streaks": 3}, {"star_flux": 7.0, "streaks": -3})
    assert approved(df, lambda v: v.star_flux / v.streaks > 1e300) == [1]
    assert approved(df, lambda v: ~(v.star_flux / v.streaks <= 0)) == [1, 2]
    assert approved(df, lambda v: (v.star_flux % v.streaks) == 2) == [3]      # sign of the divisor
    assert approved(df, lambda v: (v.star_flux % v.streaks) == -2) == [4]
    assert approved(df, lambda v: v.sqrt(v.star_flux) >= 0) == [1, 2, 4]
    assert approved(df, lambda v: v.log(v.star_flux) < -1e300) == [2]
    assert approved(df, lambda v: v.star_flux ** 2 == 49) == [3, 4]
    with pytest.raises(TypeError):
        approved(df, lambda v: 1 < v.star_flux < 5)


def test_text(make_frames):
    df = make_frames({"path": "/A/M31/Reject/1.fits"}, {"path": "C:\\a\\m31\\good\\2.fits"}, {"path": "/a/m33/3.fits", "filter": "Ha"}, {"path": "/x/a!b&&c.fits"})
    assert approved(df, lambda v: v.path.like("%reject%")) == [1]
    assert approved(df, lambda v: v.path.not_like("%reject%")) == [2, 3, 4]
    assert approved(df, lambda v: v.path.like("%/M3_/%")) == [1, 2, 3]
    assert approved(df, lambda v: v.path.like("%\\good\\%")) == [2]
    assert approved(df, lambda v: v.path.like("%!b&&%")) == [4]
    assert approved(df, lambda v: v.filter == "HA") == [3]
    assert approved(df, lambda v: v.filter == "") == [1, 2, 4]
    with pytest.raises(TypeError):
        approved(df, lambda v: v.path.like(3))


def test_dates(make_frames):
    df = make_frames({"date_obs": "2026-05-13T04:00:00.1234567"}, {"date_obs": "2026-05-31T23:10:00Z"}, {}, {"date_obs": "garbage"})
    assert approved(df, lambda v: v.date == "2026-05-13") == [1]
    assert approved(df, lambda v: v.date.between("2026-05-01", "2026-05-31")) == [1, 2]
    assert approved(df, lambda v: v.date.between("2026-05-14", "2026-05")) == [2]
    assert approved(df, lambda v: v.date.not_between("2026-05-14", "2026-05")) == [1]
    assert approved(df, lambda v: (v.date >= "2026-05-31 23:10") & (v.date > "2026-05-31t23:05")) == [2]
    assert approved(df, lambda v: v.missing(v.date)) == [3, 4]
    assert approved(df, lambda v: v.date != "2026-05-13") == [2, 3, 4]
    assert approved(df, lambda v: (v.hour > 4) & (v.hour < 4.1)) == [1]
    with pytest.raises(ValueError):
        approved(df, lambda v: v.date < "last tuesday")
    lo, hi = date_span("2024-12")
    assert (hi.year, hi.month) == (2025, 1)


def test_unknown_variable(make_frames):
    df = make_frames({})
    with pytest.raises(AttributeError):
        approved(df, lambda v: v.nope > 1)


def test_flags(make_frames):
    df = make_frames(
        {"bg_dip": 0.05, "ccd_temp": -8.0, "set_temp": -10.0, "empty_cells": 0.2, "rejected": 1, "trail_score": 0.2, "streaks": 2},
        {"bg_dip": 0.01, "ccd_temp": -10.0, "set_temp": -10.0, "empty_cells": 0.0, "rejected": 0, "trail_score": 0.01, "streaks": 0},
        {},
    )
    want = {
        "shadow": [1], "off_setpoint": [1], "occluded": [1], "rejected": [1], "accepted": [2], "trailed": [1], "good_tracking": [2], "satellite": [1],
        "light": [1, 2, 3], "mono": [1, 2, 3], "osc": [],
    }
    for name, rows in want.items():
        assert approved(df, lambda v: v[name]) == rows, name
        assert approved(df, lambda v: ~v[name]) == sorted({1, 2, 3} - set(rows)), name


def test_every_preset_runs(make_frames):
    df = make_frames({"median_hfr": 2.0, "date_obs": "2026-05-13T04:00:00", "quality_score": 50.0}, {"median_hfr": 3.0})
    for name, predicate in PRESETS.items():
        assert len(approved(df, predicate)) <= 2, name


def test_query_result(make_frames):
    df = make_frames(
        {"exptime": 300.0, "instrume": "cam", "object": "M 31", "date_obs": "2026-05-13T04:00:00", "median_hfr": 2.0},
        {"exptime": 300.0, "instrume": "cam", "object": "M 31", "date_obs": "2026-05-14T04:00:00", "median_hfr": 3.0},
        {"exptime": 180.0, "instrume": "other", "object": "", "median_hfr": 9.0},
    )
    q = run_query(df, lambda v: v.hfr < 5, per_page=1)
    assert q.counts.first().asDict() == {"total": 3, "approved": 2, "rejected": 1, "pages": 2}
    assert q.facet_totals.first()["integration_sec"] == 600
    facets = {(r["facet"], r["value"]): r["count"] for r in q.facets.collect()}
    assert facets[("instrume", "cam")] == 2 and ("object", "") not in facets and facets[("date", "2026-05-14")] == 1
    assert [r["id"] for r in q.items.collect()] == [1]
    stats = {r["metric"]: r for r in q.stats.collect()}
    assert set(stats) == {"hfr"} and stats["hfr"]["median"] == 3.0 and stats["hfr"]["mad"] == 1.0
    nothing = run_query(df, lambda v: v.hfr > 99)
    assert nothing.counts.first()["pages"] == 1


def test_search_errors(make_frames):
    df = make_frames({})
    for bad in (dict(grade="great"), dict(ids="1,x"), dict(near=(1, 2)), dict(covers=(1,)), dict(file_format="png"), dict(indexing="some"), dict(nope=1)):
        with pytest.raises(ValueError):
            search_frames(df, **bad)
    with pytest.raises(ValueError, match="bad_one"):
        parse_fields("bad_one,capture")
    with pytest.raises(ValueError):
        parse_fields(None, "everything")
    with pytest.raises(ValueError):
        sort_spec("-quality.nope")


def test_field_selection(make_frames):
    df = make_frames({"median_hfr": 2.5, "header_json": '{"EXPTIME": 300.0, "BAD": NaN, "NOTE": "x"}', "path": "/lib/a.XISF"})
    d = project_fields(df, "quality.hfr_px,header.exptime,header.bad,file.format")
    assert d.columns == ["id", "file", "quality", "header"]
    row = d.select("quality.*", "file.format", F.size("header").alias("n"), F.try_variant_get(F.col("header")["EXPTIME"], "$", "double").alias("e")).first()
    assert row.asDict() == {"hfr_px": 2.5, "format": "xisf", "n": 2, "e": 300.0}
    assert set(project_fields(df).columns) == {"id", "file", "capture", "pointing", "plate_solve", "position", "quality", "conditions", "status", "thumbnail", "links"}
    broken = make_frames({"header_json": "{oops"})
    assert project_fields(broken, "header").select(F.col("header").isNull().alias("n")).first()["n"]


def test_saved_query(spark, make_frames):
    df = make_frames({"filter": "R", "median_hfr": 2.0}, {"filter": "R", "median_hfr": 2.0, "rejected": 1}, {"filter": "R", "median_hfr": 2.0, "index_error": "x"}, {"filter": "G", "median_hfr": 2.0})
    saved = spark.createDataFrame([(7, "q", None, '{"filter": "R", "expression": {"op": "<", "args": [{"var": "hfr"}, 3]}}')], "id long, name string, folder string, query_json string")
    assert ids(run_saved_query(df, saved, 7)) == [1]
    assert ids(run_saved_query(df, saved, 7, include_rejected=True)) == [1, 2]
    with pytest.raises(ValueError):
        run_saved_query(df, saved, 8)


def test_conditions_as_data(make_frames):
    df = make_frames({"filter": "Ha", "path": "/a/Reject/x.fits", "star_flux": 0.0}, {"filter": "HA", "path": "/a/b.fits"}, {"filter": "R", "path": "/a/c.fits", "star_flux": 4.0})
    op = lambda name, *args: {"op": name, "args": list(args)}
    var = lambda name: {"var": name}
    assert ids(filter_view(df, op("==", var("filter"), "ha"))) == [1, 2]
    assert ids(filter_view(df, op("not like", var("path"), "%/reject/%"))) == [2, 3]
    assert ids(filter_view(df, op("!=", var("star_flux"), 0))) == [2, 3]
    assert ids(filter_view(df, op("or", op("missing", var("star_flux")), op(">", var("star_flux"), op("mean", var("star_flux")))))) == [2, 3]
    assert ids(filter_view(df, op("not", op("<", var("star_flux"), op("-", op("**", 2, 3), 7))))) == [2, 3]
    assert ids(filter_view(df, op("in", var("filter"), "R", "G"))) == [3] and ids(filter_view(df, {})) == [1, 2, 3]
    for bad in (op("drop", var("hfr")), {"var": "nope"}, op("<", var("hfr"), [1]), op("+", var("hfr"), "x"), {"op": "and"}):
        with pytest.raises((ValueError, TypeError)):
            filter_view(df, bad)


def test_base_filters_limit_statistics(make_frames):
    df = make_frames({"filter": "R", "median_hfr": 2.0}, {"filter": "R", "median_hfr": 4.0}, {"filter": "G", "median_hfr": 100.0})
    assert ids(select_frames(df, lambda v: v.hfr >= v.mean(v.hfr), filter="R")) == [2]
