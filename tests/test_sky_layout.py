"""The catalogue laid out by sky: the same frames as a plain search, from few row groups."""

import random

import pytest

from nightledger.operators.search import search_frames
from nightledger.operators.targets import cone
from nightledger.sources.sky_layout import read_by_sky, stored_cone, stored_covering, write_by_sky

# Small files stand for the row groups of a large catalogue; four levels of fields share them.
FILES = 96


def rows_scanned(df):
    """Result ids and the rows that the scan handed on after skipping row groups and pages."""
    ids = sorted(r["id"] for r in df.select("id").collect())
    leaf = df.select("id")
    leaf.collect()
    scan = leaf._jdf.queryExecution().executedPlan().collectLeaves().head()
    return ids, scan.metrics().apply("numOutputRows").value()


@pytest.fixture(scope="module")
def sky(spark, make_frames, tmp_path_factory):
    rng = random.Random(3)
    rows = []
    for i in range(6000):
        ra, dec = rng.choice([(rng.uniform(0, 360), rng.uniform(-90, 90)), (rng.gauss(83.8, 0.5), rng.gauss(-5.4, 0.5)), (rng.uniform(-0.5, 0.5), rng.uniform(-1, 1)), (rng.uniform(0, 360), rng.uniform(88, 90))])
        row = {"id": i, "ra": ra, "dec": dec, "fov_w": rng.choice([0.5, 1.0, 3.0]), "fov_h": rng.choice([0.4, 2.0, None]), "wcs_rotation": rng.choice([None, 30.0])}
        if i % 500 == 0:
            row |= {"fov_w": 90.0, "fov_h": 60.0}
        if i % 7 == 0:
            row |= {"wcs_ra": ra + 0.2, "wcs_dec": min(90.0, dec + 0.1)}
        if i % 211 == 0:
            row["ra"] = row["wcs_ra"] = None
        rows.append(row)
    frames = make_frames(*rows)
    path = str(tmp_path_factory.mktemp("sky") / "frames")
    write_by_sky(frames, path, FILES)
    return frames.cache(), read_by_sky(spark, path)


@pytest.mark.parametrize("ra, dec, radius", [(83.8, -5.4, 0.7), (0.0, 0.0, 0.4), (359.9, 0.2, 0.5), (200.0, 89.5, 1.0), (10.0, -89.99, 2.0), (120.0, 40.0, 5.0), (40.0, 10.0, 120.0), (83.8, -5.4, 0.0)])
def test_stored_cone(sky, ra, dec, radius):
    frames, table = sky
    got, scanned = rows_scanned(stored_cone(table, ra, dec, radius))
    assert got == sorted(r["id"] for r in cone(frames, ra, dec, radius).select("id").collect())
    if radius <= 0.7:
        assert scanned < 0.5 * 6000


@pytest.mark.parametrize("ra, dec", [(83.8, -5.4), (0.0, 0.0), (359.95, 0.3), (150.0, 89.9), (120.0, -40.0), (-0.05, 0.0)])
def test_stored_covering(sky, ra, dec):
    frames, table = sky
    got, scanned = rows_scanned(stored_covering(table, ra, dec))
    assert got == sorted(r["id"] for r in search_frames(frames, covers=(ra, dec), indexing="all").select("id").collect())
    assert scanned < 0.5 * 6000


def test_a_rare_position_reads_few_row_groups(sky):
    """Away from the crowded fields one search touches a small part of the files."""
    _, table = sky
    assert rows_scanned(stored_cone(table, 250.0, -50.0, 0.3))[1] <= 6000 * 8 / FILES
    assert "PushedFilters: [" in stored_cone(table, 250.0, -50.0, 0.3)._jdf.queryExecution().executedPlan().toString()
