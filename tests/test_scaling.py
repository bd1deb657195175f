"""The forms meant for data of any size give the same answers as the plain ones."""

import random

import pytest
from pyspark.sql import functions as F

from nightledger.config import Settings
from nightledger.operators import paging, targets
from nightledger.operators.calibration import calibration_setups
from nightledger.operators.quantiles import global_quantiles, grouped_medians
from nightledger.plans import portable
from tests.conftest import SMALL


def exact(values, q):
    vals = sorted(values)
    pos = q * (len(vals) - 1)
    k = int(pos)
    return vals[k] if k + 1 == len(vals) else vals[k] + (vals[k + 1] - vals[k]) * (pos - k)


@pytest.mark.parametrize("kind", ["normal", "outliers", "few", "wide", "close"])
def test_global_quantiles_by_refinement(spark, kind):
    rng = random.Random(5)
    n = 4001
    values = {
        "normal": [rng.gauss(0, 1) for _ in range(n)],
        "outliers": [rng.gauss(0, 1) for _ in range(n)] + [1e300, -1e300, 1e12],
        "few": [rng.choice([1.0, 2.0, 2.5]) for _ in range(n)],
        "wide": [rng.choice([-1, 1]) * 10 ** rng.uniform(-300, 300) for _ in range(n)],
        "close": [359.5 + rng.random() * 1e-9 for _ in range(n)],
    }[kind]
    df = spark.createDataFrame([(v,) for v in values] + [(None,), (float("nan"),)], "v double")
    wanted = {f"q{q}": (F.col("v"), q) for q in (0.0, 0.25, 0.5, 0.9, 1.0)}
    got = global_quantiles(df, wanted, bound=100)
    for q in (0.0, 0.25, 0.5, 0.9, 1.0):
        assert got[f"q{q}"] == pytest.approx(exact(values, q), rel=1e-12, abs=1e-300)
    assert global_quantiles(df.filter("v IS NULL"), {"m": (F.col("v"), 0.5)}, bound=0) == {"m": None}


def test_grouped_medians_any_size(spark):
    rng = random.Random(6)
    rows = [(k, rng.gauss(0, 3) if rng.random() < 0.95 else None, rng.choice([-2.0, 0.0, 7.0])) for k, n in (("a", 1500), (None, 800), ("c", 3), ("d", 1)) for _ in range(n)]
    df = spark.createDataFrame(rows, "k string, x double, y double")
    plain = {r["k"]: (r["x"], r["y"]) for r in df.groupBy("k").agg(F.median("x").alias("x"), F.median("y").alias("y")).collect()}
    for bound in (0, 100, 10_000):
        got = {r["k"]: (r["x"], r["y"]) for r in grouped_medians(df, ["k"], ["x", "y"], bound).collect()}
        assert got.keys() == plain.keys()
        for k in plain:
            assert got[k] == pytest.approx(plain[k]), (bound, k)


def test_deep_pages(spark):
    df = portable.frames(spark, SMALL).select("id", "date_obs", "object")
    order = paging.sort_spec("capture.object,-capture.date_obs")
    everything = [r["id"] for r in df.orderBy(*order).collect()]
    for page in (1, 3, 10, 11):
        assert [r["id"] for r in paging.page_of(df, order, page, 97).collect()] == everything[97 * (page - 1) : 97 * page]
    with pytest.raises(ValueError):
        paging.page_of(df, order, 0)


def test_equal_bits_at_any_bound(spark):
    """A statistic does not depend on where the multi-stage form begins."""
    rng = random.Random(8)
    df = spark.createDataFrame([(i % 3, rng.gauss(850, 60)) for i in range(1501)], "k int, v double")
    wanted = {f"q{q}": (F.col("v"), q) for q in (0.1, 0.25, 0.5, 0.731, 0.9, 0.999)}
    forms = [global_quantiles(df, wanted, bound=bound) for bound in (10, 1000, 10**6)]
    assert forms[0] == forms[1] == forms[2]
    medians = [{r["k"]: r["v"] for r in grouped_medians(df, ["k"], ["v"], bound).collect()} for bound in (10, 10**6)]
    assert medians[0] == medians[1]


@pytest.mark.parametrize("levels", [(0.5, 2.0, 8.0, 32.0, 180.0), (0.3, 180.0), (4.0, 45.0, 180.0), (180.0,)])
def test_target_cells_lose_nothing(spark, make_frames, levels):
    rng = random.Random(7)
    rows, sky = [], []
    for i in range(300):
        dec = rng.choice([rng.uniform(-90, 90), rng.uniform(88, 90), -89.9, 0.0])
        ra = rng.choice([rng.uniform(0, 360), 359.9, 0.05, -0.1, 360.2])
        w, h, rot = rng.choice([0.5, 3.0, 12.0, 70.0]), rng.choice([0.4, 2.0, None]), rng.choice([None, rng.uniform(0, 360)])
        rows.append({"id": i, "ra": ra, "dec": dec, "fov_w": w, "fov_h": h, "wcs_rotation": rot})
    for j in range(60):
        base = rng.choice(rows)
        sky.append((j, f"t{j}", (base["ra"] + rng.uniform(-2, 2)) % 360, max(-90.0, min(90.0, base["dec"] + rng.uniform(-2, 2))), rng.choice([None, 0.0, 0.3, 1.5, 20.0, 95.0]), None))
    frames = make_frames(*rows)
    t = spark.createDataFrame(sky, "id long, name string, ra double, dec double, radius_deg double, notes string")
    got = [(r["target_id"], r["id"]) for r in targets.match_targets(frames, t, Settings(sky_levels_deg=levels)).select("target_id", "id").collect()]
    assert len(got) == len(set(got))

    from nightledger.functions.spatial import contains
    from nightledger.operators.targets import _spherical_sep

    pairs = frames.select("id", "ra", "dec", "fov_w", "fov_h", "wcs_rotation").join(t.select(F.col("id").alias("t"), F.col("ra").alias("tr"), F.col("dec").alias("td"), "radius_deg"))
    inside = contains(F.col("ra"), F.col("dec"), F.col("fov_w"), F.col("fov_h"), F.col("wcs_rotation"), F.col("tr"), F.col("td"))
    near = F.coalesce((F.col("radius_deg") != 0) & (_spherical_sep(F.col("ra"), F.col("dec"), F.col("tr"), F.col("td")) <= F.col("radius_deg")), F.lit(False))
    want = {(r["t"], r["id"]) for r in pairs.filter(inside | near).select("t", "id").collect()}
    assert set(got) == want and len(want) > 100


def test_pushdown_and_pruning(spark, tmp_path):
    from nightledger.operators.selector import select_frames
    from nightledger.sources.catalog import read_frames, write_frames

    path = str(tmp_path / "catalogue")
    write_frames(portable.frames(spark, SMALL), path)
    frames = read_frames(spark, path)
    spark.conf.set("spark.sql.maxMetadataStringLength", 4000)
    plan = select_frames(frames, lambda v: (v.hfr < v.median(v.hfr)) & v.good_tracking).select("id")._jdf.queryExecution().executedPlan().toString()
    assert "LessThan(median_hfr" in plan and "LessThanOrEqual(trail_score,0.03)" in plan and "PartitionFilters: [isnotnull(imagetyp" in plan
    assert "header_json" not in plan and "diagnostics_json" not in plan
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert frames.count() == portable.frames(spark, SMALL).count()


def test_calibration_counts_equal_brute_force(make_frames):
    """Darks, flats, bias frames and gaps of every setup, with unknown temperatures, gains and nights."""
    rng = random.Random(11)
    kinds = ["Light Frame", "Dark Frame", "Flat Frame", "Bias Frame"]
    rows = [
        dict(imagetyp=rng.choice(kinds), instrume=rng.choice(["a", None]), xbinning=1, gain=rng.choice([100.0, None]), cam_offset=50, filter=rng.choice(["L", None]),
             exptime=rng.choice([60.0, 300.0]), ccd_temp=rng.choice([None, rng.uniform(-14, -6), -10.0, -12.0]), date_obs=rng.choice([None, f"2026-05-{rng.randint(1, 28):02d}T01:00:00"]))
        for _ in range(600)
    ]
    got = {(r["camera"], r["gain"], r["exposure_s"], r["filter"], r["sensor_temp_c"]): (r["frames"], r["nights"], r["darks"], r["flats"], r["bias"], r["flat_gap_days"]) for r in calibration_setups(make_frames(*rows)).collect()}

    def of(kind, *keys):
        return lambda setup: [r for r in rows if r["imagetyp"] == kind and all(r[k] == setup[k] for k in keys)]

    readout = ("instrume", "gain")
    bias, darks, flats = of(kinds[3], *readout), of(kinds[1], *readout, "exptime"), of(kinds[2], "instrume", "filter")
    want = {}
    groups = {}
    for r in rows:
        if r["imagetyp"] == kinds[0]:
            degree = None if r["ccd_temp"] is None else round(r["ccd_temp"])
            groups.setdefault((r["instrume"] or "Unknown camera", r["gain"], r["exptime"], r["filter"], degree), []).append(r)
    for key, lights in groups.items():
        fit = [d for d in darks(lights[0]) if key[4] is None or d["ccd_temp"] is None or abs(d["ccd_temp"] - key[4]) <= 2]
        nights = {int(x["date_obs"][8:10]) for x in lights if x["date_obs"]}
        flat_nights = {int(x["date_obs"][8:10]) for x in flats(lights[0]) if x["date_obs"]}
        gap = max((min(abs(n - m) for m in flat_nights) for n in nights), default=None) if flat_nights else None
        want[key] = (len(lights), len(nights), len(fit), len(flats(lights[0])), len(bias(lights[0])), gap)
    assert got == want and len(want) > 60
