"""Filter-style search over the catalogue (SQL three-valued logic)."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nightledger.config import DEFAULTS, Settings
from nightledger.functions.scoring import one_shot_colour, verdict
from nightledger.functions.text import FILE_FORMATS, date_between, path_like

GRADES = {"accepted", "rejected", "unmarked"}

# Filter name -> (column, side of the range).
_RANGES = {
    "exposure_min": ("exptime", "lo"), "exposure_max": ("exptime", "hi"),
    "focal_length_min": ("focal_length", "lo"), "focal_length_max": ("focal_length", "hi"),
    "hfr_max": ("median_hfr", "hi"), "fwhm_max": ("median_fwhm", "hi"), "eccentricity_max": ("eccentricity", "hi"),
    "trail_score_max": ("trail_score", "hi"), "psf_fwhm_max": ("psf_fwhm", "hi"), "empty_cells_max": ("empty_cells", "hi"),
    "background_dip_max": ("bg_dip", "hi"), "stars_min": ("star_count", "lo"), "quality_min": ("quality_score", "lo"),
}
_LISTS = {"image_type": "imagetyp", "filter": "filter", "telescope": "telescop", "camera": "instrume"}
_VERDICTS = ("good_tracking", "occluded", "satellite", "shadow")


def _values(v: str | Iterable[str]) -> list[str]:
    parts = v.split(",") if isinstance(v, str) else list(v)
    return [p.strip() for p in parts if p and p.strip()]


def indexing_state(state: str) -> Column:
    """ok: readable frames, failed: tombstones, all: both."""
    error = F.col("index_error")
    states = {"ok": error.isNull(), "failed": error.isNotNull(), "all": F.lit(True)}
    if state not in states:
        raise ValueError(f"indexing takes ok, failed or all, not {state!r}")
    return states[state]


def object_contains(text: str) -> Column:
    return F.col("object").ilike(f"%{text}%")


def grade_in(grades: str | Iterable[str]) -> Column:
    """Any of accepted, rejected, unmarked."""
    wanted = set(_values(grades))
    if not wanted or wanted - GRADES:
        raise ValueError(f"grade takes accepted, rejected and/or unmarked; unknown: {sorted(wanted - GRADES)}")
    tests = {"accepted": F.col("rejected") == 0, "rejected": F.col("rejected") == 1, "unmarked": F.col("rejected").isNull()}
    cond = F.lit(False)
    for g in sorted(wanted):
        cond = cond | tests[g]
    return cond


def format_is(name: str) -> Column:
    exts = [e for e, f in FILE_FORMATS.items() if f == name]
    if not exts:
        raise ValueError(f"unknown file format: {name}")
    cond = F.lit(False)
    for e in exts:
        cond = cond | F.lower("path").endswith(e)
    return cond


def id_list(ids: str | Iterable) -> list[int]:
    try:
        return [int(i) for i in (ids.split(",") if isinstance(ids, str) else ids) if str(i).strip()]
    except ValueError:
        raise ValueError("ids must be integers") from None


def search_frames(
    frames: DataFrame,
    *,
    indexing: str = "ok",
    ids=None,
    object: str | None = None,
    color: str | None = None,
    date_from: str | None = None,
    date_to: str | None = None,
    grade=None,
    file_format: str | None = None,
    solved: bool | None = None,
    rejected: bool | None = None,
    path_like_: str | None = None,
    path_not_like: str | None = None,
    watched_path_id: int | None = None,
    indexed_since: datetime | None = None,
    near: tuple[float, float, float] | None = None,
    covers: tuple[float, float] | None = None,
    where=None,
    cfg: Settings = DEFAULTS,
    **filters,
) -> DataFrame:
    """All search filters, ANDed.

    `filters` takes image_type, filter, telescope, camera (text lists), the
    numeric bounds (hfr_max, stars_min, ...) and the verdicts good_tracking,
    occluded, satellite, shadow (True or False; unanalyzed frames match
    neither).  `near` is (ra, dec, radius), `covers` is (ra, dec), `where` is
    a selection predicate or a condition as data: these three see only the rows passing the rest.
    """
    conds = [indexing_state(indexing)] if indexing != "all" else []
    wanted_ids = id_list(ids) if ids is not None else []
    if wanted_ids:
        conds.append(F.col("id").isin(wanted_ids))
    if object:
        conds.append(object_contains(object))
    if color == "osc":
        conds.append(one_shot_colour(F.col("bayer")))
    elif color == "mono":
        conds.append(~one_shot_colour(F.col("bayer")))
    elif color is not None:
        raise ValueError("color takes osc or mono")
    if date_from or date_to:
        conds.append(date_between(F.col("date_obs"), date_from, date_to))
    if grade:
        conds.append(grade_in(grade))
    if file_format:
        conds.append(format_is(file_format))
    if solved is not None:
        is_solved = F.col("solved") == 1
        conds.append(is_solved if solved else ~F.coalesce(is_solved, F.lit(False)))
    if rejected is not None:
        is_rejected = F.col("rejected") == 1
        conds.append(is_rejected if rejected else ~F.coalesce(is_rejected, F.lit(False)))
    if path_like_ and path_like_.strip():
        conds.append(path_like(F.col("path"), path_like_))
    if path_not_like and path_not_like.strip():
        conds.append(~path_like(F.col("path"), path_not_like))
    if watched_path_id is not None:
        conds.append(F.col("watched_path_id") == watched_path_id)
    if indexed_since is not None:
        if indexed_since.tzinfo is not None:
            indexed_since = indexed_since.astimezone(timezone.utc).replace(tzinfo=None)
        conds.append(F.col("indexed_at") >= F.lit(indexed_since.isoformat(sep=" ")).cast("timestamp_ntz"))
    for name, value in filters.items():
        if value is None:
            continue
        if name in _RANGES:
            col, side = _RANGES[name]
            conds.append(F.col(col) >= value if side == "lo" else F.col(col) <= value)
        elif name in _LISTS:
            vals = _values(value)
            if vals:
                conds.append(F.col(_LISTS[name]) == vals[0] if len(vals) == 1 else F.col(_LISTS[name]).isin(vals))
        elif name in _VERDICTS:
            conds.append(verdict(name, cfg) if value else ~verdict(name, cfg))
        else:
            raise ValueError(f"unknown filter: {name}")
    out = frames
    for c in conds:
        out = out.filter(c)
    if near is None and covers is None and where is None:
        return out

    from nightledger.operators.conditions import predicate_of
    from nightledger.operators.predicates import as_flag
    from nightledger.operators.selector import Vars, filter_view

    def spatial(v: Vars):
        cond = None
        for part in (
            as_flag(where(v)) if where is not None else None,
            v.angsep(near[0], near[1]) <= near[2] if near is not None else None,
            v.contains(*covers) if covers is not None else None,
        ):
            if part is not None:
                cond = part if cond is None else cond & part
        return cond

    if isinstance(where, dict):
        where = predicate_of(where)
    if near is not None and len(near) != 3:
        raise ValueError("a cone search needs ra, dec and radius together")
    if covers is not None and len(covers) != 2:
        raise ValueError("covers needs ra and dec together")
    return filter_view(out, spatial, cfg)
