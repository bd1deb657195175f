"""Sequence screening: judge each frame against its own session.

A frame is compared, in capture order, with the better of two references: the
median of the last few unflagged frames and the session median.  Flagged
frames never enter the rolling reference; a long run of flagged frames means
conditions changed for good, and both references start over from its end.

The verdicts feed back into the reference, so a session is replayed in order.
Sessions are independent and packed many to a task; a session is one camera's
run without a pause of hours, and six numbers a frame are held.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nightledger.config import DEFAULTS, Settings
from nightledger.operators.sessions import SERIES, frame_sessions

METRICS = list(SERIES)
HIGHER_IS_BETTER = [better for _, better in SERIES.values()]
DEVIATIONS = ["star_drop", "hfr_rise", "empty_rise", "spread_rise", "flux_drop", "dip_rise"]
OUT_COLUMNS = ["id", *DEVIATIONS, "seq_anomaly"]
OUT_SCHEMA = "id long, " + ", ".join(f"{d} double" for d in DEVIATIONS) + ", seq_anomaly boolean"
_NAN = float("nan")


def limits_of(cfg: Settings) -> list[float]:
    return [cfg.seq_star_drop, cfg.seq_hfr_rise, cfg.seq_empty_rise, cfg.seq_spread_rise, cfg.seq_flux_drop, cfg.seq_dip_rise]


def _middle(values: list[float]) -> float:
    vals = sorted(v for v in values if v == v)
    n = len(vals)
    if not n:
        return _NAN
    return vals[n // 2] if n % 2 else (vals[n // 2 - 1] + vals[n // 2]) / 2.0


def medians(rows: list[tuple]) -> tuple:
    return tuple(_middle([r[m] for r in rows]) for m in range(len(METRICS)))


@dataclass
class Replay:
    """State carried along a session: the two references and the flagged run."""

    seed: tuple
    size: int
    limits: list
    window: list = field(default_factory=list)
    run: list = field(default_factory=list)
    _known: list | None = None  # reference of the current seed and window

    def reference(self) -> list[float]:
        if self._known is not None:
            return self._known
        rolling = medians(self.window) if len(self.window) >= min(3, self.size) else (_NAN,) * len(METRICS)
        out = []
        for m, higher in enumerate(HIGHER_IS_BETTER):
            known = [v for v in (self.seed[m], rolling[m]) if math.isfinite(v)]
            out.append((max if higher else min)(known) if known else _NAN)
        self._known = out
        return out

    def step(self, row: tuple) -> tuple[list[float], bool]:
        ref = self.reference()
        dev = []
        for m, name in enumerate(DEVIATIONS):
            if name in ("empty_rise", "dip_rise"):
                dev.append(row[m] - ref[m])
            elif not ref[m] > 0:
                dev.append(_NAN)
            elif HIGHER_IS_BETTER[m]:
                dev.append(1.0 - row[m] / ref[m])
            else:
                dev.append(row[m] / ref[m] - 1.0)
        flagged = any(math.isfinite(d) and d > lim for d, lim in zip(dev, self.limits))
        if flagged:
            self.run.append(row)
            if len(self.run) >= 2 * self.size:
                self.window = self.run[-self.size:]
                self.seed = medians(self.window)
                self.run = []
                self._known = None
        else:
            self.window = (self.window + [row])[-self.size:]
            self.run = []
            self._known = None
        return dev, flagged


def _metric_rows(pdf: pd.DataFrame) -> list[tuple]:
    return list(zip(*[pdf[m].astype(float).tolist() for m in METRICS]))


def _emit(ids: list, out: list) -> pd.DataFrame:
    pdf = pd.DataFrame([d for d, _ in out], columns=DEVIATIONS, dtype=float)
    pdf.insert(0, "id", ids)
    pdf["seq_anomaly"] = [f for _, f in out]
    return pdf


def _whole_sessions(batches: Iterator[pd.DataFrame], size: int, limits: list) -> Iterator[pd.DataFrame]:
    """Sorted rows of many sessions -> verdicts.

    A session is replayed in order, so it is one task's work; it is one
    camera's run without a pause of hours, and six numbers a frame are held.
    """
    held: list[pd.DataFrame] = []

    def replay() -> pd.DataFrame:
        pdf = pd.concat(held, ignore_index=True)
        rows = _metric_rows(pdf)
        out = []
        cuts = [0, *_breaks(pdf), len(rows)]
        for a, b in zip(cuts, cuts[1:]):
            state = Replay(medians(rows[a:b]), size, limits)
            out.extend(state.step(r) for r in rows[a:b])
        held.clear()
        return _emit(pdf["id"].tolist(), out)

    for pdf in batches:
        if pdf.empty:
            continue
        joint = [held[-1].tail(1), pdf] if held else [pdf]
        breaks = _breaks(pd.concat(joint, ignore_index=True))
        shift = len(joint) - 1
        if breaks:
            # Everything before the last break is complete.
            done = breaks[-1] - shift
            held.append(pdf.iloc[:done])
            yield replay()
            pdf = pdf.iloc[done:]
        held.append(pdf)
    if held:
        yield replay()


def _breaks(pdf: pd.DataFrame) -> list[int]:
    """Row numbers at which another session begins."""
    name, start = pdf["_session"].to_numpy(), pdf["session_start"].to_numpy()
    return (((name[1:] != name[:-1]) | (start[1:] != start[:-1])).nonzero()[0] + 1).tolist()


def screen_sessions(frames: DataFrame, cfg: Settings = DEFAULTS, with_type: bool = False, only_of: DataFrame | None = None) -> DataFrame:
    """Verdicts per judged frame: id, six deviations, seq_anomaly.

    Judged are frames with a capture time and a star count whose session has
    at least three such frames.  Ties in time go by id.  With `only_of`, some
    of the frames, only the sessions they lie in are screened.
    """
    rows = frame_sessions(frames, cfg, with_type, only_of).filter(F.col("star_count").isNotNull() & (F.col("session_counted") >= 3))
    rows = rows.select(
        "id", "t_ms", "session_key", "session_start", "session_counted",
        *[F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).alias(m) for m, (c, _) in SERIES.items()],
    )
    return _replayed(rows, cfg)


def _replayed(rows: DataFrame, cfg: Settings) -> DataFrame:
    size, limits = cfg.seq_baseline_frames, limits_of(cfg)
    # Hash and start time name a session in the Arrow batches; the full key
    # decides the task.  (Equal hashes would also need equal start times.)
    tagged = rows.withColumn("_session", F.xxhash64("session_key", "session_start"))
    packed = tagged.repartition("session_key", "session_start").sortWithinPartitions("_session", "session_start", "t_ms", "id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return _whole_sessions(batches, size, limits)

    return packed.select("id", "_session", "session_start", *METRICS).mapInPandas(run, OUT_SCHEMA)


def with_screening(frames: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Attach verdicts by id.  Frames that could not be judged are neither
    anomalous nor ok, and their deviations are unknown."""
    out = frames.join(verdicts.withColumn("_judged", F.lit(True)), "id", "left")
    judged = F.coalesce(F.col("_judged"), F.lit(False))
    anomaly = F.coalesce(F.col("seq_anomaly"), F.lit(False))
    return out.withColumns({
        "seq_anomaly": anomaly,
        "seq_ok": judged & ~anomaly,
        "transparency": 1.0 - F.col("flux_drop"),
    }).drop("_judged")


def sequence_for(all_frames: DataFrame, wanted: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    """Sequence group of the wanted frames, screened against every indexed
    frame of their sessions: id, judged, anomaly, the deviations, transparency.
    """
    indexed = F.col("index_error").isNull()
    verdicts = screen_sessions(all_frames.filter(indexed), cfg, with_type=True, only_of=wanted.filter(indexed))
    joined = wanted.select("id").join(verdicts, "id", "left")
    values = [F.when(F.abs(F.col(d)) < float("inf"), F.col(d)).alias(d) for d in DEVIATIONS]
    return joined.select(
        "id", F.col("seq_anomaly").isNotNull().alias("judged"), F.col("seq_anomaly").alias("anomaly"), *values,
    ).withColumn("transparency", 1.0 - F.col("flux_drop"))
