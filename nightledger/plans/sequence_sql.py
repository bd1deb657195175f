"""Sequence screening as SQL: a recursive query that walks all sessions at once, frame by frame, with its state as lists."""

from __future__ import annotations

_METRICS = ["star_count", "median_hfr", "empty_cells", "bg_spread", "star_flux", "bg_dip"]
DEVIATIONS = ["star_drop", "hfr_rise", "empty_rise", "spread_rise", "flux_drop", "dip_rise"]
_FALLS, _DIFFERENCES = (1, 5), (3, 6)
_LIMITS = [0.3, 0.25, 0.15, 1.0, 0.3, 0.015]
_FRAMES = 5  # of the rolling reference; twice as many flagged ones start it over
_NONE = "CAST([] AS DOUBLE[][])"


def _middles(rows: str) -> str:
    return "[" + ", ".join(f"list_median([x[{k}] FOR x IN {rows}])" for k in range(1, 7)) + "]"


def _deviation(k: int) -> str:
    if k in _DIFFERENCES:
        return f"v[{k}] - ref[{k}]"
    ratio = f"v[{k}] / ref[{k}]"
    return f"CASE WHEN ref[{k}] > 0 THEN " + (f"1 - {ratio}" if k in _FALLS else f"{ratio} - 1") + " END"


def verdict_ctes(key: str) -> str:
    """CTEs up to `verdicts` (id, the deviations, flagged), from the rows z of the sessions of a key."""
    reference = ", ".join(f"{'greatest' if k in _FALLS else 'least'}(seed[{k}], rolling[{k}])" for k in range(1, 7))
    flagged = " OR ".join(f"coalesce(dev[{k}] > {limit}, false)" for k, limit in enumerate(_LIMITS, 1))
    return (
        f"m AS (SELECT id, [{', '.join(f'CAST({c} AS DOUBLE)' for c in _METRICS)}] AS v, dense_rank() OVER (ORDER BY {key}, session_start) AS s, "
        f"row_number() OVER (PARTITION BY {key}, session_start ORDER BY t_ms, id) AS i FROM z WHERE star_count IS NOT NULL AND session_counted >= 3), "
        f"w AS (SELECT s, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS id, CAST(NULL AS DOUBLE[]) AS dev, CAST(NULL AS BOOLEAN) AS flagged, "
        f"[{', '.join(f'median(v[{k}])' for k in range(1, 7))}] AS seed, {_NONE} AS recent, {_NONE} AS run FROM m GROUP BY s UNION ALL "
        f"SELECT s, i, id, dev, flagged, CASE WHEN over THEN {_middles('last')} ELSE seed END, CASE WHEN over THEN last WHEN flagged THEN recent ELSE list_append(recent, v)[-{_FRAMES}:] END, "
        f"CASE WHEN over OR NOT flagged THEN {_NONE} ELSE more END FROM ("
        f"SELECT *, flagged AND len(more) >= {2 * _FRAMES} AS over, more[-{_FRAMES}:] AS last FROM ("
        f"SELECT *, {flagged} AS flagged, list_append(run, v) AS more FROM ("
        f"SELECT s, i, id, v, seed, recent, run, [{', '.join(_deviation(k) for k in range(1, 7))}] AS dev FROM ("
        f"SELECT *, [{reference}] AS ref FROM ("
        f"SELECT w.s, m.i, m.id, m.v, w.seed, w.recent, w.run, CASE WHEN len(w.recent) >= 3 THEN {_middles('w.recent')} ELSE [CAST(NULL AS DOUBLE), NULL, NULL, NULL, NULL, NULL] END AS rolling "
        f"FROM w JOIN m ON m.s = w.s AND m.i = w.i + 1)))))), "
        f"verdicts AS (SELECT id, flagged, {', '.join(f'dev[{k}] AS {d}' for k, d in enumerate(DEVIATIONS, 1))} FROM w WHERE i > 0)"
    )


ROUNDED = ", ".join(f"round({d}, 6) AS {d}" for d in DEVIATIONS)
