"""Frame selection: base filters, named variables, robust statistics,
predicates, and the query result built from them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nightledger.config import DEFAULTS, Settings
from nightledger.functions import scoring, spatial
from nightledger.functions.text import capture_time, date_between, folded_path, hour_of_day
from nightledger.operators.conditions import predicate_of
from nightledger.operators.predicates import Flag, Num, Text, When, as_flag
from nightledger.operators.paging import page_of
from nightledger.operators.quantiles import global_quantiles
from nightledger.operators.rollups import facet_totals, facets, metric_summary
from nightledger.operators.screening import DEVIATIONS, screen_sessions, with_screening
from nightledger.operators.search import object_contains

# Variable name -> frame column.
NUMBERS = {
    "hfr": "median_hfr", "fwhm": "median_fwhm", "fwhm_arcsec": "fwhm_arcsec", "ecc": "eccentricity",
    "eccentricity": "eccentricity", "trail": "trail_score", "trail_score": "trail_score", "empty_cells": "empty_cells",
    "bg_spread": "bg_spread", "bg_dip": "bg_dip", "psf_fwhm": "psf_fwhm", "psf_beta": "psf_beta", "beta": "psf_beta",
    "star_flux": "star_flux", "streaks": "streaks", "stars": "star_count", "starcount": "star_count",
    "quality": "quality_score", "background": "background_median", "exptime": "exptime", "ccd_temp": "ccd_temp",
    "set_temp": "set_temp", "focal": "focal_length", "focal_length": "focal_length", "pixscale": "pixel_scale",
    "acquisition_ra": "ra", "acquisition_dec": "dec", "astap_ra": "wcs_ra", "astap_dec": "wcs_dec",
    "coord_sep": "coord_sep_arcmin", "width": "naxis1", "height": "naxis2", "solved": "solved",
    "wcs_scale": "wcs_scale", "wcs_rotation": "wcs_rotation", "altitude": "altitude", "alt": "altitude",
    "azimuth": "azimuth", "airmass": "airmass", "moonsep": "moon_sep", "moon_sep": "moon_sep",
    "moonillum": "moon_illum", "moon_illum": "moon_illum", "moonalt": "moon_alt", "moon_alt": "moon_alt",
}
TEXTS = ["filter", "imagetyp", "object", "telescop", "instrume", "bayer", "filename"]
SEQUENCE_NUMBERS = [*DEVIATIONS, "transparency"]
SEQUENCE_FLAGS = ["seq_anomaly", "seq_ok"]


def number_column(name: str) -> Column | None:
    """The column of a numeric variable; None for an unknown name."""
    if name in ("ra", "dec"):
        return F.coalesce(f"wcs_{name}", name)
    if name == "pixel_scale":
        return scoring.effective_scale()
    if name == "psf_fwhm_arcsec":
        return F.col("psf_fwhm") * scoring.effective_scale()
    if name == "fov_w":
        return scoring.effective_fov("fov_w", "naxis1", zero_is_missing=False)
    if name == "fov_h":
        return scoring.effective_fov("fov_h", "naxis2", zero_is_missing=False)
    if name == "fov":
        return F.greatest(number_column("fov_w"), number_column("fov_h"))
    if name == "temp_delta":
        return F.col("ccd_temp") - F.col("set_temp")
    if name == "hour":
        return hour_of_day(capture_time(F.col("date_obs")))
    return F.col(NUMBERS[name]).cast("double") if name in NUMBERS else None


NUMBER_NAMES = [*NUMBERS, "ra", "dec", "pixel_scale", "psf_fwhm_arcsec", "fov_w", "fov_h", "fov", "temp_delta", "hour"]


def text_column(name: str) -> Column | None:
    if name == "path":
        return F.lower(folded_path(F.coalesce(F.col("path"), F.lit(""))))
    return F.lower(F.coalesce(F.col(name), F.lit(""))) if name in TEXTS else None


TEXT_NAMES = [*TEXTS, "path"]
KINDS = ["light", "dark", "flat", "bias"]
FLAG_NAMES = [*KINDS, "osc", "mono", "rejected", "accepted", *scoring.VERDICTS]


def flag_column(name: str, cfg: Settings = DEFAULTS) -> Column | None:
    """A condition; NULL (unknown) counts as false."""
    if name in KINDS:
        return F.lower(F.col("imagetyp")) == f"{name} frame"
    if name in ("osc", "mono"):
        colour = scoring.one_shot_colour(F.col("bayer"))
        return colour if name == "osc" else ~colour
    if name in ("rejected", "accepted"):
        return F.col("rejected") != 0 if name == "rejected" else F.col("rejected") == 0
    return scoring.verdict(name, cfg) if name in scoring.VERDICTS else None


def selector_view(frames: DataFrame, cfg: Settings = DEFAULTS, sequence: bool = False) -> DataFrame:
    """Every selection variable as a column, beside the frame itself in the
    struct `frame`.  Unread variables cost nothing: Catalyst prunes them."""
    extra: list[Column] = []
    if sequence:
        frames = with_screening(frames, screen_sessions(frames, cfg))
        extra = [F.col(n) for n in SEQUENCE_NUMBERS + SEQUENCE_FLAGS]
    own = [c for c in frames.columns if c not in SEQUENCE_NUMBERS + SEQUENCE_FLAGS]
    date = capture_time(F.col("date_obs"))
    cols = {**{n: number_column(n) for n in NUMBER_NAMES}, **{n: text_column(n) for n in TEXT_NAMES}, "date": date, "date_obs": date}
    flags = {n: F.coalesce(flag_column(n, cfg), F.lit(False)) for n in FLAG_NAMES}
    return frames.select(F.struct(*own).alias("frame"), *[c.alias(n) for n, c in {**cols, **flags}.items()], *extra)


AGGREGATES = ("median", "mean", "avg", "std", "sigma", "min", "max", "sum", "count", "mad", "madstd")


class Vars:
    """Variables, functions and statistics a predicate may use.

    Statistics are over all candidate frames.  They are gathered first and
    computed together in shared passes, then enter the filter as constants,
    so the scan can use them for pushdown.
    """

    def __init__(self, cfg: Settings, funcs: dict[str, Callable] | None = None):
        self._cfg = cfg
        self._funcs = funcs or {}
        self._stats: dict[tuple, float | None] = {}
        self._wanted: dict[tuple, tuple[str, Column, float]] = {}
        self._sequence = False

    def __getattr__(self, name: str):
        key = name.lower()
        if key.startswith("_"):
            raise AttributeError(name)
        for kind, col in ((Num, number_column(key)), (Text, text_column(key)), (Flag, flag_column(key, self._cfg))):
            if col is not None:
                return kind(col)
        if key in ("date", "date_obs"):
            return When(capture_time(F.col("date_obs")))
        if key in SEQUENCE_NUMBERS or key in SEQUENCE_FLAGS:
            self._sequence = True
            return Num(F.col(key)) if key in SEQUENCE_NUMBERS else Flag(F.col(key))
        if key in self._funcs:
            return lambda *args: self._funcs[key](self, *args)
        if key in AGGREGATES:
            return lambda x: self._stat(key, x)
        raise AttributeError(f"unknown variable: {name}")

    __getitem__ = __getattr__

    # Elementwise functions.
    def abs(self, x):
        return abs(x)

    def sqrt(self, x):
        return Num(F.when(x.col >= 0, F.sqrt(x.col)))

    def log(self, x):
        return Num(F.when(x.col > 0, F.ln(x.col)).when(x.col == 0, F.lit(float("-inf"))))

    def log10(self, x):
        return Num(F.when(x.col > 0, F.log10(x.col)).when(x.col == 0, F.lit(float("-inf"))))

    def missing(self, x):
        return x.missing()

    isnan = missing

    def present(self, x):
        return x.present()

    def between(self, x, lo, hi):
        return x.between(lo, hi)

    def like(self, x, pattern):
        return x.like(pattern)

    def percentile(self, x, q: float):
        """Linear-interpolated percentile, q in 0..100."""
        return self._stat("percentile", x, float(q))

    def angsep(self, ra: float, dec: float):
        """Degrees from the frame centre."""
        return Num(spatial.angsep(number_column("ra"), number_column("dec"), ra, dec))

    def contains(self, ra: float, dec: float):
        """Does the field of view cover the position?"""
        frame = [number_column(n) for n in ("ra", "dec", "fov_w", "fov_h", "wcs_rotation")]
        return Flag(spatial.contains(*frame, ra, dec))

    # Statistics.
    def _stat(self, kind: str, x, q: float = 0.0) -> Num:
        col = x.strict().cast("double") if isinstance(x, Flag) else x.col
        key = (kind, str(col), q)
        if key in self._stats:
            return Num(F.lit(self._stats[key]).cast("double"))
        if _PENDING not in str(col):
            self._wanted[key] = (kind, col, q)
        return Num(F.lit(_PENDING).cast("double"))

    def _compute(self, df: DataFrame, cfg: Settings) -> None:
        wanted, self._wanted = self._wanted, {}
        plain = {"mean": F.avg, "avg": F.avg, "std": F.stddev_pop, "sigma": F.stddev_pop, "min": F.min, "max": F.max}
        aggs, ranks = {}, {}
        for i, (key, (kind, col, q)) in enumerate(wanted.items()):
            value = F.when(~F.isnan(col.cast("double")), col.cast("double"))
            if kind in plain:
                aggs[key] = plain[kind](value)
            elif kind == "sum":
                aggs[key] = F.coalesce(F.sum(value), F.lit(0.0))
            elif kind == "count":
                aggs[key] = F.count(F.when(F.abs(value) < float("inf"), value)).cast("double")
            else:
                ranks[str(i)] = (key, col, q / 100.0 if kind == "percentile" else 0.5)
        if aggs:
            row = df.agg(*[c.alias(f"s{i}") for i, c in enumerate(aggs.values())]).first()
            for i, key in enumerate(aggs):
                self._stats[key] = row[f"s{i}"]
        if not ranks:
            return
        rows = df.count()
        first = global_quantiles(df, {n: (c, q) for n, (_, c, q) in ranks.items()}, cfg.exact_group_rows, rows)
        spread = {n: (F.abs(c - F.lit(first[n])), 0.5) for n, (k, c, _) in ranks.items() if k[0] in ("mad", "madstd") and first[n] is not None}
        second = global_quantiles(df, spread, cfg.exact_group_rows, rows)
        for n, (key, _, _) in ranks.items():
            value = second.get(n) if key[0] in ("mad", "madstd") else first[n]
            self._stats[key] = 1.4826 * value if key[0] == "madstd" and value is not None else value


_PENDING = "statistic not computed yet"

Predicate = Callable[[Vars], object]


def filter_view(frames: DataFrame, predicate: Predicate | dict | None, cfg: Settings = DEFAULTS, funcs: dict[str, Callable] | None = None) -> DataFrame:
    """Frames meeting the predicate (all of them without one).

    A callable gets the variables; a dict is a condition as data (see `conditions`) with the same meaning.
    """
    if predicate is None or predicate == {}:
        return frames
    if isinstance(predicate, dict):
        predicate = predicate_of(predicate)
    v = Vars(cfg, funcs)
    base = frames
    joined = False
    while True:
        cond = as_flag(predicate(v))
        if v._sequence and not joined:
            base, joined = with_screening(frames, screen_sessions(frames, cfg)), True
        if not v._wanted:
            break
        v._compute(base, cfg)
    return base.filter(cond.col).select(*[F.col(c) for c in frames.columns])


def candidates(
    frames: DataFrame,
    imagetyp: str | None = "Light Frame",
    object: str | None = None,
    filter: str | None = None,
    telescop: str | None = None,
    instrume: str | None = None,
    date_from: str | None = None,
    date_to: str | None = None,
) -> DataFrame:
    """Base filters of a selection.  Tombstones stay in."""
    out = frames
    for name, value in (("imagetyp", imagetyp), ("filter", filter), ("telescop", telescop), ("instrume", instrume)):
        if value:
            out = out.filter(F.col(name) == value)
    if object:
        out = out.filter(object_contains(object))
    if date_from or date_to:
        out = out.filter(date_between(F.col("date_obs"), date_from, date_to))
    return out


def select_frames(frames: DataFrame, predicate: Predicate | dict | None = None, cfg: Settings = DEFAULTS, funcs: dict[str, Callable] | None = None, **base) -> DataFrame:
    """Approved frames: base filters, then the predicate over what is left."""
    return filter_view(candidates(frames, **base), predicate, cfg, funcs)


@dataclass
class QueryResult:
    """Result of a selection.  Each part is a DataFrame made when asked for;
    the statistics in the predicate are computed once for all of them."""

    candidates: DataFrame
    approved: DataFrame
    page: int
    per_page: int
    cfg: Settings

    @cached_property
    def counts(self) -> DataFrame:
        flagged = self.candidates.select(F.lit(0).alias("a")).unionByName(self.approved.select(F.lit(1).alias("a")))
        counted = flagged.agg(F.count_if(F.col("a") == 0).alias("total"), F.count_if(F.col("a") == 1).alias("approved"))
        return counted.select(
            "total", "approved", (F.col("total") - F.col("approved")).alias("rejected"),
            F.greatest(F.lit(1).cast("long"), F.ceil(F.col("approved") / self.per_page)).alias("pages"),
        )

    @cached_property
    def stats(self) -> DataFrame:
        """Metric summary over the candidates."""
        return metric_summary(self.candidates, cfg=self.cfg)

    @cached_property
    def facets(self) -> DataFrame:
        """Common values over the approved set."""
        return facets(self.approved)

    @cached_property
    def facet_totals(self) -> DataFrame:
        return facet_totals(self.approved)

    @cached_property
    def items(self) -> DataFrame:
        """One page of approved frames by id."""
        return page_of(self.approved, [F.col("id").asc()], self.page, self.per_page)


def run_query(frames: DataFrame, predicate: Predicate | dict | None = None, page: int = 1, per_page: int = 50, cfg: Settings = DEFAULTS, **base) -> QueryResult:
    """Counts, metric summary over the candidates, facets over the approved
    set and one page of approved frames.

    The approved set is a narrow scan filtered by constants, so the parts
    re-read it rather than pinning it in executor memory.
    """
    rows = candidates(frames, **base)
    return QueryResult(rows, filter_view(rows, predicate, cfg), page, per_page, cfg)


# -- presets ----------------------------------------------------------------------

# Threshold clauses of the query builder: name -> predicate factory.
THRESHOLDS: dict[str, Callable[[float], Predicate]] = {
    "hfr_max": lambda x: lambda v: v.hfr < x,
    "fwhm_max": lambda x: lambda v: v.fwhm < x,
    "ecc_max": lambda x: lambda v: v.eccentricity < x,
    "stars_min": lambda x: lambda v: v.stars > x,
    "alt_min": lambda x: lambda v: v.altitude > x,
    "airmass_max": lambda x: lambda v: v.airmass < x,
    "moonsep_min": lambda x: lambda v: v.moonsep > x,
    "moonillum_max": lambda x: lambda v: v.moonillum < x,
    "pixscale_max": lambda x: lambda v: v.pixel_scale < x,
    "focal_min": lambda x: lambda v: v.focal > x,
    "focal_max": lambda x: lambda v: v.focal < x,
    "fov_min": lambda x: lambda v: v.fov > x,
}


def _below_outliers(name: str) -> Predicate:
    return lambda v: v[name] < v.median(v[name]) + 2 * v.mad(v[name])


#: Ready-made conditions, by what they test; the names are this library's own.
PRESETS: dict[str, Predicate] = {
    # The row's state in the catalogue.
    "not_rejected": lambda v: ~v.rejected,
    "accepted": lambda v: v.accepted,
    "path_without_reject": lambda v: v.path.not_like("%reject%"),
    "mono_camera": lambda v: v.mono,
    "colour_camera": lambda v: v.osc,
    "cooled_to_setpoint": lambda v: ~v.off_setpoint,
    # Where the frame points.
    "has_plate_solution": lambda v: v.solved == 1,
    "external_solution_missing": lambda v: v.missing(v.astap_ra),
    "header_ra_missing": lambda v: v.isnan(v.ra),
    "header_off_solution": lambda v: v.coord_sep > 10,
    # What the pixels say.
    "tracked_well": lambda v: v.good_tracking,
    "unobstructed": lambda v: ~v.occluded,
    "without_streaks": lambda v: ~v.satellite,
    "without_shadow": lambda v: ~v.shadow,
    "quality_above_lower_quartile": lambda v: v.quality > v.percentile(v.quality, 25),
    **{f"{name}_within_2_mad": _below_outliers(name) for name in ("eccentricity", "fwhm", "hfr", "psf_fwhm")},
    # How the frame compares with its session.
    "clear_sky": lambda v: v.transparency >= 0.8,
    "like_its_session": lambda v: ~v.seq_anomaly,
}


def all_of(*predicates: Predicate) -> Predicate:
    """AND of presets and clauses."""

    def both(v: Vars):
        cond = as_flag(True)
        for p in predicates:
            cond = cond & as_flag(p(v))
        return cond

    return both
