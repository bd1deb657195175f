"""Sessions and sequence screening against known cases and a plain replay."""

import datetime as dt
import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from nightledger.config import Settings
from nightledger.operators import screening
from nightledger.operators.selector import filter_view
from nightledger.operators.sessions import frame_sessions
from tests.conftest import ids

START = dt.datetime(2026, 5, 13, 4)


def night_of(stars, hfr=None, flux=None, dip=None, start=START, step=5, first_id=1, **common):
    n = len(stars)
    rows = []
    for i in range(n):
        rows.append({
            "id": first_id + i, "object": "M 31", "exptime": 300.0, "date_obs": (start + dt.timedelta(minutes=step * i)).isoformat(),
            "star_count": None if stars[i] is None else int(round(stars[i])), "median_hfr": (hfr or [2.0] * n)[i], "empty_cells": 0.0, "bg_spread": 4.0,
            "star_flux": flux[i] if flux else None, "bg_dip": dip[i] if dip else None, **common,
        })
    return rows


def flags(make_frames, rows):
    got = {r["id"]: r for r in screening.screen_sessions(make_frames(*rows)).collect()}
    return [got[r["id"]]["seq_anomaly"] if r["id"] in got else None for r in rows], got


F_, T_ = False, True


@pytest.mark.parametrize("case, kwargs, want", [
    ("steady", dict(stars=[500, 510, 495, 505, 500, 498, 502, 507, 499, 503]), [F_] * 10),
    ("cloud", dict(stars=[500, 510, 495, 505, 200, 150, 480, 500, 505, 498]), [F_] * 4 + [T_, T_] + [F_] * 4),
    ("soft", dict(stars=[500] * 10, hfr=[2.0] * 5 + [2.8] + [2.0] * 4), [F_] * 5 + [T_] + [F_] * 4),
    ("veil", dict(stars=[500] * 10, flux=[50000.0] * 5 + [32000.0] + [50000.0] * 4), [F_] * 5 + [T_] + [F_] * 4),
    ("new regime", dict(stars=[800] * 6 + [400] * 14), [F_] * 6 + [T_] * 10 + [F_] * 4),
    ("frost", dict(stars=[500] * 10, dip=[0.008, 0.009, 0.007, 0.008, 0.008, 0.009, 0.012, 0.02, 0.035, 0.05]), [F_] * 8 + [T_, T_]),
    ("frost at dusk", dict(stars=[500] * 10, dip=[0.06, 0.04, 0.03] + [0.008] * 7), [T_] * 3 + [F_] * 7),
    ("too short", dict(stars=[500, 100]), [None, None]),
    ("no star count", dict(stars=[500, None, 500, 510]), [F_, None, F_, F_]),
])
def test_known_cases(make_frames, case, kwargs, want):
    got, rows = flags(make_frames, night_of(**kwargs))
    assert got == want
    if case == "cloud":
        assert rows[6]["star_drop"] == pytest.approx(0.70, abs=0.01)
    if case == "frost":
        assert rows[10]["dip_rise"] == pytest.approx(0.041, abs=0.001)
    if case == "steady":
        assert rows[1]["flux_drop"] is None or math.isnan(rows[1]["flux_drop"])


def test_gap_is_exclusive(make_frames):
    rows = night_of([500] * 3) + night_of([500] * 3, start=START + dt.timedelta(minutes=10, hours=3), first_id=4) + night_of([500] * 3, start=START + dt.timedelta(minutes=20, hours=6, milliseconds=1), first_id=7)
    s = {r["id"]: r["session_frames"] for r in frame_sessions(make_frames(*rows)).collect()}
    assert s == {1: 6, 2: 6, 3: 6, 4: 6, 5: 6, 6: 6, 7: 3, 8: 3, 9: 3}


def replay(rows, limits, size=5, gap=3 * 3600):
    """Plain restatement of the rules, one frame at a time."""
    out = {}
    groups = {}
    for r in rows:
        if r["date_obs"]:
            key = ((r["object"] or "").lower(), (r.get("filter") or "").lower(), r.get("instrume"), r.get("telescop"), r["exptime"])
            groups.setdefault(key, []).append(r)
    names = ["star_count", "median_hfr", "empty_cells", "bg_spread", "star_flux", "bg_dip"]
    better = [max, min, min, min, max, min]

    def med(rs):
        return [statistics.median(v) if (v := [r[n] for r in rs if r[n] is not None]) else None for n in names]

    for g in groups.values():
        g.sort(key=lambda r: (dt.datetime.fromisoformat(r["date_obs"]), r["id"]))
        runs = [[g[0]]]
        for a, b in zip(g, g[1:]):
            apart = (dt.datetime.fromisoformat(b["date_obs"]) - dt.datetime.fromisoformat(a["date_obs"])).total_seconds()
            runs.append([b]) if apart > gap else runs[-1].append(b)
        for run in runs:
            run = [r for r in run if r["star_count"] is not None]
            if len(run) < 3:
                continue
            seed, window, bad_run = med(run), [], []
            for r in run:
                roll = med(window) if len(window) >= min(3, size) else [None] * 6
                ref = [f([x for x in (s, q) if x is not None]) if s is not None or q is not None else None for f, s, q in zip(better, seed, roll)]
                bad = False
                for i, n in enumerate(names):
                    if ref[i] is None or r[n] is None:
                        continue
                    if i in (2, 5):
                        d = r[n] - ref[i]
                    elif ref[i] > 0:
                        d = 1 - r[n] / ref[i] if better[i] is max else r[n] / ref[i] - 1
                    else:
                        continue
                    bad |= d > limits[i]
                out[r["id"]] = bad
                if bad:
                    bad_run.append(r)
                    if len(bad_run) >= 2 * size:
                        window, seed, bad_run = bad_run[-size:], med(bad_run[-size:]), []
                else:
                    window, bad_run = (window + [r])[-size:], []
    return out


def noisy(n=900, seed=3):
    rng = random.Random(seed)
    rows, t, level = [], START, 500.0
    for i in range(n):
        t += dt.timedelta(minutes=rng.choice([1, 5, 5, 5, 30, 200]))
        level = rng.choice([level] * 30 + [level * 0.4, 800.0])
        pick = lambda v: v if rng.random() < 0.93 else None
        rows.append({
            "id": i, "object": rng.choice(["M 31", "m 31", "M 33"]), "filter": rng.choice(["Ha", None]), "instrume": "cam", "telescop": rng.choice(["s", None]),
            "exptime": rng.choice([300.0, 60.0]), "date_obs": pick(t.isoformat()), "star_count": pick(int(level * rng.uniform(0.75, 1.2))),
            "median_hfr": pick(rng.uniform(1.9, 2.6)), "empty_cells": pick(rng.choice([0.0, 0.0, 0.2])), "bg_spread": pick(rng.choice([4.0, 4.5, 9.0])),
            "star_flux": pick(level * rng.uniform(80, 120)), "bg_dip": pick(rng.choice([0.0, 0.01, 0.03])),
        })
    return rows


def test_matches_plain_replay(make_frames):
    rows = noisy()
    want = replay(rows, screening.limits_of(Settings()))
    got = {r["id"]: r["seq_anomaly"] for r in screening.screen_sessions(make_frames(*rows)).collect()}
    assert got == want and 30 < sum(want.values()) < len(want)


def test_one_long_session_among_short_ones(make_frames):
    rows = noisy(1500, seed=9)
    for r in rows:  # one long session and several short ones
        r["exptime"], r["filter"], r["telescop"] = 300.0, None, None
    cfg = Settings(seq_gap_hours=5.0)
    want = replay(rows, screening.limits_of(cfg), gap=5 * 3600)
    got = {r["id"]: r["seq_anomaly"] for r in screening.screen_sessions(make_frames(*rows), cfg).collect()}
    assert got == want


def test_sequence_group(make_frames):
    rows = night_of([500, 510, 490, 150, 505]) + [{"id": 50, "object": "lone", "date_obs": START.isoformat(), "star_count": 10}]
    rows += night_of([100] * 5, first_id=20, imagetyp="Dark Frame")
    df = make_frames(*rows)
    wanted = df.filter("id IN (4, 5, 50)")
    got = {r["id"]: r for r in screening.sequence_for(df, wanted).collect()}
    assert got[4]["anomaly"] and got[4]["judged"] and got[5]["anomaly"] is False
    assert got[50]["judged"] is False and got[50]["anomaly"] is None and got[50]["star_drop"] is None


def test_selection_by_sequence(make_frames):
    df = make_frames(*night_of([500, 510, 495, 505, 200, 150, 480], flux=[50000.0] * 7), {"id": 99, "star_count": 5})
    assert ids(filter_view(df, lambda v: ~v.seq_anomaly)) == [1, 2, 3, 4, 7, 99]
    assert ids(filter_view(df, lambda v: v.seq_ok & (v.transparency >= 1))) == [1, 2, 3, 4, 7]
    assert ids(filter_view(df, {"op": "and", "args": [{"op": "not", "args": [{"var": "seq_anomaly"}]}, {"op": ">", "args": [{"var": "star_drop"}, 0.04]}]})) == [7]
    assert ids(filter_view(df, lambda v: v.star_drop >= v.max(v.star_drop))) == [6]


def test_only_wanted_sessions_are_screened(make_frames):
    """Peers are whole sessions of the wanted frames: a neighbour over several hours too, but no other night, key or type."""
    night = night_of([500] * 6 + [200] * 2, step=170)                                       # a session of many time buckets
    rows = night + night_of([500] * 5, start=START + dt.timedelta(days=300), first_id=20) + night_of([500] * 5, first_id=40, filter="Ha") + night_of([500] * 5, first_id=60, imagetyp="Flat Frame")
    frames = make_frames(*rows)
    wanted = frames.filter("id in (1, 8)")
    got = {r["id"]: r for r in screening.screen_sessions(frames, with_type=True, only_of=wanted).collect()}
    every = {r["id"]: r for r in screening.screen_sessions(frames, with_type=True).collect()}
    assert sorted(got) == list(range(1, 9)) and all(got[i] == every[i] for i in got) and len(every) == 23
    of = {r["id"]: r["anomaly"] for r in screening.sequence_for(frames, wanted).collect()}
    assert of == {1: False, 8: True}
