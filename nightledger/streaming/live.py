"""Live screening of sessions while they are captured, and their final verdicts once they have ended.

A session's frames are kept as state of its key.  A frame gets a provisional verdict when it arrives, against the rolling
reference and the session's first frames, because the median of the whole session is not known yet.  An event-time timer
closes the session when no frame can join it any more; then every frame gets the verdict that `screen_sessions` gives for
the same frames.  Times are milliseconds of the camera's own clock text, whatever the session's time zone is.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from nightledger.config import DEFAULTS, Settings
from nightledger.functions.text import capture_time
from nightledger.operators.screening import DEVIATIONS, METRICS, Replay, limits_of, medians
from nightledger.operators.sessions import SERIES, epoch_ms, session_key

OUT_SCHEMA = "id long, session_key string, session_start long, final boolean, judged boolean, " + ", ".join(f"{d} double" for d in DEVIATIONS) + ", anomaly boolean"
COLUMNS = [field.strip().split()[0] for field in OUT_SCHEMA.split(",")]
STATE_SCHEMA = "t_ms long, id long, counted boolean, " + ", ".join(f"{m} double" for m in METRICS)
#: Typed state and timers need this store.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Frames a session needs before it is judged.
LEAST_FRAMES = 3
_NOTHING = [None] * len(DEVIATIONS)
Frame = tuple  # t_ms, id, counted and the metrics, as the state has them


def split_sessions(frames: list[Frame], gap_ms: int) -> list[list[Frame]]:
    """Frames of one key in order of time and id, parted where a pause is longer than the gap."""
    sessions: list[list[Frame]] = []
    for frame in sorted(frames, key=lambda f: f[:2]):
        if sessions and frame[0] - sessions[-1][-1][0] <= gap_ms:
            sessions[-1].append(frame)
        else:
            sessions.append([frame])
    return sessions


def _verdict(state: Replay, frame: Frame) -> list:
    deviations, flagged = state.step(tuple(float("nan") if v is None else v for v in frame[3:]))
    return [True, *(d if d == d else None for d in deviations), flagged]


def final_verdicts(session: list[Frame], size: int, limits: list) -> list[tuple[int, list]]:
    """(id, verdict) of every frame of a session that has ended."""
    counted = [f for f in session if f[2]]
    out = [(f[1], [False, *_NOTHING, None]) for f in session if not f[2] or len(counted) < LEAST_FRAMES]
    if len(counted) >= LEAST_FRAMES:
        state = Replay(medians([f[3:] for f in counted]), size, limits)
        out += [(f[1], _verdict(state, f)) for f in counted]
    return out


def provisional_verdicts(session: list[Frame], size: int, limits: list) -> list[tuple[int, list]]:
    """The same for one that goes on: its first frames stand for its median, and are not judged themselves."""
    warm = min(LEAST_FRAMES, size)
    counted = [f for f in session if f[2]]
    first = [f[3:] for f in counted[:warm]]
    state = Replay(medians(first), size, limits, first)
    unknown = [*(f for f in session if not f[2]), *counted[:warm]]
    return [(f[1], [False, *_NOTHING, None]) for f in unknown] + [(f[1], _verdict(state, f)) for f in counted[warm:]]


class Screening(StatefulProcessor):
    """State of a session key: the frames of its sessions that have not ended."""

    def __init__(self, cfg: Settings):
        self.size, self.limits, self.gap_ms = cfg.seq_baseline_frames, limits_of(cfg), int(cfg.seq_gap_hours * 3_600_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.frames = handle.getListState("frames", STATE_SCHEMA)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new: list[Frame] = []
        for pdf in rows:
            metrics = [pdf[m].astype("float64").tolist() for m in METRICS]
            new += zip(pdf["t_ms"].astype("int64").tolist(), pdf["id"].tolist(), pdf["counted"].tolist(), *metrics)
        if not new:
            return
        held = self._held()
        self.frames.appendList(new)
        fresh = {(f[0], f[1]) for f in new}
        for session in split_sessions(held + new, self.gap_ms):
            arrived = {f[1] for f in session if (f[0], f[1]) in fresh}
            if arrived:
                self.handle.registerTimer(session[-1][0] + self.gap_ms + 1)
                yield self._table(key, session, False, [v for v in provisional_verdicts(session, self.size, self.limits) if v[0] in arrived])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Sessions that the watermark has left behind get their final verdicts; the others stay."""
        now, stay = timerValues.getCurrentWatermarkInMs(), []
        for session in split_sessions(self._held(), self.gap_ms):
            if session[-1][0] + self.gap_ms < now:
                yield self._table(key, session, True, final_verdicts(session, self.size, self.limits))
            else:
                stay += session
        if stay:
            self.frames.put(stay)
        else:
            self.frames.clear()

    def close(self) -> None:
        pass

    def _held(self) -> list[Frame]:
        return [tuple(f) for f in self.frames.get()]

    def _table(self, key, session: list[Frame], final: bool, verdicts: list[tuple[int, list]]) -> pd.DataFrame:
        rows = [(id_, key[0], session[0][0], final, *verdict) for id_, verdict in verdicts]
        return pd.DataFrame(rows, columns=COLUMNS).astype({d: "float64" for d in DEVIATIONS})


def live_screening(frames: DataFrame, cfg: Settings = DEFAULTS, delay: str = "10 minutes") -> DataFrame:
    """Streaming frames -> a provisional row for each frame as it arrives, and a final one when its session has ended.

    session_start is in milliseconds.  A session ends once the watermark (the newest time less `delay`) is more than the
    session gap behind its last frame.  Frames without a capture time are left out; those without a star count are not
    judged but keep their session going.
    """
    frames.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)

    def known(name: str):
        value = F.col(name).cast("double")
        return F.when(~F.isnan(value), value)

    rows = frames.select(
        "id", F.to_json(session_key(True)).alias("session_key"), epoch_ms(capture_time(F.col("date_obs"))).alias("t_ms"),
        F.col("star_count").isNotNull().alias("counted"), *[known(c).alias(m) for m, (c, _) in SERIES.items()],
    ).filter(F.col("t_ms").isNotNull())
    timed = rows.withColumn("t", F.timestamp_millis("t_ms")).withWatermark("t", delay)
    return timed.groupBy("session_key").transformWithStateInPandas(Screening(cfg), OUT_SCHEMA, "Append", "EventTime")
