"""Capture sessions: gap-and-island grouping that never sorts a whole key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nightledger.config import DEFAULTS, Settings
from nightledger.functions.numeric import py_round
from nightledger.functions.text import capture_time
from nightledger.operators.quantiles import grouped_medians


def session_key(with_type: bool) -> Column:
    """Frames of one setup: (type,) target, filter, camera, telescope, exposure."""
    parts = [F.coalesce(F.col("imagetyp"), F.lit("")).alias("imagetyp")] if with_type else []
    parts += [
        F.lower(F.coalesce("object", F.lit(""))).alias("object"),
        F.lower(F.coalesce("filter", F.lit(""))).alias("filter"),
        F.col("instrume"),
        F.col("telescop"),
        py_round(F.col("exptime"), 1).alias("exptime"),
    ]
    return F.struct(*parts)


def epoch_ms(ts: Column) -> Column:
    epoch = F.lit("1970-01-01").cast("timestamp_ntz")
    return F.timestamp_diff("MILLISECOND", epoch, ts)


def _timed(df: DataFrame, keys: Sequence[str | Column], time: Column, gap_ms: int) -> DataFrame:
    cols = [F.col(k) if isinstance(k, str) else k for k in keys]
    key = cols[0] if len(cols) == 1 and not isinstance(keys[0], str) else F.struct(*cols)
    timed = df.withColumns({"session_key": key, "t_ms": epoch_ms(time)}).filter(F.col("t_ms").isNotNull())
    return timed.withColumn("_bucket", F.floor(F.col("t_ms") / gap_ms) if gap_ms > 0 else F.col("t_ms"))


def session_buckets(timed: DataFrame, gap_ms: int, count_if: Column | None = None) -> DataFrame:
    """Per key and time bucket: the session it belongs to and that session's
    sizes (all rows, and rows meeting `count_if`).

    A bucket is as wide as the gap.  Rows of one bucket can never be more than
    a gap apart, so sessions only break between buckets, and (first, last,
    count) per key and bucket decide everything.  Those aggregate map-side:
    a key holding a third of all rows shrinks to one row per bucket before
    any shuffle, and the window runs over buckets, which the calendar bounds.
    """
    counted = F.count(F.lit(1)) if count_if is None else F.count_if(count_if)
    buckets = timed.groupBy("session_key", "_bucket").agg(
        F.min("t_ms").alias("first"), F.max("t_ms").alias("last"), F.count(F.lit(1)).alias("n"), counted.alias("c")
    )
    order = Window.partitionBy("session_key").orderBy("_bucket")
    previous = F.lag("last").over(order)
    starts = F.when(previous.isNull() | (F.col("first") - previous > gap_ms), F.col("first"))
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    buckets = buckets.withColumn("_start", starts).withColumn("session_start", F.last("_start", ignorenulls=True).over(so_far))
    session = Window.partitionBy("session_key", "session_start")
    return buckets.select(
        "session_key", "_bucket", "session_start",
        F.sum("n").over(session).alias("session_frames"),
        F.sum("c").over(session).alias("session_counted"),
    )


def sessionize(
    df: DataFrame, keys: Sequence[str | Column], time: Column, gap_hours: float = DEFAULTS.seq_gap_hours, count_if: Column | None = None, only_of: DataFrame | None = None
) -> DataFrame:
    """Split each key's rows into sessions at gaps longer than `gap_hours`.

    Adds session_key, t_ms (time in ms), session_start (ms of the session's
    first row), session_frames and session_counted (rows meeting `count_if`).
    Rows without a time are left out.  The rows are only joined to the small
    bucket table; no key is ever sorted as a whole.  With `only_of`, some of the
    rows, just the sessions these lie in are kept: the bucket table is cut to
    them before any row is joined.
    """
    gap_ms = int(gap_hours * 3_600_000)
    timed = _timed(df, keys, time, gap_ms)
    buckets = session_buckets(timed, gap_ms, count_if)
    if only_of is not None:
        touched = _timed(only_of, keys, time, gap_ms).select("session_key", "_bucket").distinct()
        sessions = buckets.join(touched, ["session_key", "_bucket"]).select("session_key", "session_start").distinct()
        buckets = buckets.join(sessions, ["session_key", "session_start"])
    return timed.join(buckets, ["session_key", "_bucket"]).drop("_bucket")


def frame_sessions(frames: DataFrame, cfg: Settings = DEFAULTS, with_type: bool = False, only_of: DataFrame | None = None) -> DataFrame:
    """Frames with their session; session_counted is the frames with a star count."""
    return sessionize(
        frames, [session_key(with_type)], capture_time(F.col("date_obs")), cfg.seq_gap_hours, F.col("star_count").isNotNull(), only_of
    )


def session_size(frames: DataFrame, enough: int, cfg: Settings = DEFAULTS, with_type: bool = False) -> int:
    """An upper bound on the frames with a star count in any session.

    The table's own size will do when it is no more than `enough`; otherwise
    the sessions are measured, reading keys and times only.
    """
    counted = frames.filter(F.col("star_count").isNotNull())
    rows = counted.count()
    if rows <= enough:
        return rows
    gap_ms = int(cfg.seq_gap_hours * 3_600_000)
    timed = _timed(frames, [session_key(with_type)], capture_time(F.col("date_obs")), gap_ms)
    return session_buckets(timed, gap_ms, F.col("star_count").isNotNull()).agg(F.max("session_counted")).first()[0] or 0


# Series name -> (frame column, higher is better).
SERIES = {
    "stars": ("star_count", True), "hfr": ("median_hfr", False), "empty": ("empty_cells", False),
    "spread": ("bg_spread", False), "flux": ("star_flux", True), "dip": ("bg_dip", False),
}


def session_medians(frames: DataFrame, cfg: Settings = DEFAULTS, with_type: bool = False) -> DataFrame:
    """Median of the six screening metrics per session, over frames with a
    star count; sessions with fewer than three such frames are not judged."""
    rows = frame_sessions(frames, cfg, with_type).filter(F.col("star_count").isNotNull() & (F.col("session_counted") >= 3))
    rows = rows.select("session_key", "session_start", "session_counted", *[F.col(c).cast("double").alias(m) for m, (c, _) in SERIES.items()])
    return grouped_medians(rows, ["session_key", "session_start"], list(SERIES), cfg.exact_group_rows, "session_counted", session_size(frames, cfg.exact_group_rows, cfg, with_type))
