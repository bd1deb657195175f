"""Paired comparison of processing runs.

`runs`: file, repeat, variant, phase map<string,double>, metrics
map<string,double>, skipped boolean, error string.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nightledger.functions.numeric import py_round

# Phases reported and relative tolerance per metric.
PHASES = ["read", "thumb", "wcs", "quality", "sep_bg", "sep_extract", "sep_hfr", "sky", "total"]
TOLERANCES = {"star_count": 0.005, "median_hfr": 0.01, "median_fwhm": 0.01, "eccentricity": 0.01, "background_median": 0.01}


def metric_pairs(runs: DataFrame, a: str = "float32", b: str = "float64", tolerances: dict[str, float] | None = None) -> DataFrame:
    """One row per file, repeat and metric known in both variants, with the
    absolute and relative difference.

    Both variants of a pair share (file, repeat), so a grouped maximum pairs
    them in one shuffle; a self-join would shuffle twice.
    """
    tol = tolerances or TOLERANCES
    rows = runs.filter(F.col("metrics").isNotNull() & F.col("variant").isin(a, b))
    flat = rows.select("file", "repeat", "variant", F.explode("metrics").alias("metric", "value")).filter(F.col("metric").isin(list(tol)))
    paired = flat.groupBy("file", "repeat", "metric").agg(
        F.max(F.when(F.col("variant") == a, F.col("value"))).alias("va"), F.max(F.when(F.col("variant") == b, F.col("value"))).alias("vb")
    ).filter(F.col("va").isNotNull() & F.col("vb").isNotNull())
    diff = F.abs(F.col("va") - F.col("vb"))
    rel = F.when(F.col("vb") != 0, diff / F.abs("vb")).when(diff == 0, 0.0).otherwise(1.0)
    return paired.withColumns({"abs_diff": diff, "rel_diff": rel})


def compare_runs(runs: DataFrame, a: str = "float32", b: str = "float64", tolerances: dict[str, float] | None = None, rounded: bool = True) -> DataFrame:
    """Per metric: pairs, largest relative difference, the file it occurs on,
    and whether it exceeds the tolerance.

    The worst file is the one of the largest difference, the first by name
    among equals; NULL while nothing differs.
    """
    tol = tolerances or TOLERANCES
    p = metric_pairs(runs, a, b, tol)
    worst = F.min_by(F.struct("file", "abs_diff"), F.struct((-F.col("rel_diff")).alias("r"), "file", "repeat"))
    limit = F.create_map(*[x for m, t in tol.items() for x in (F.lit(m), F.lit(t))])[F.col("metric")]
    out = p.groupBy("metric").agg(F.count(F.lit(1)).alias("n"), F.max("rel_diff").alias("_rel"), worst.alias("_w"))
    pct, diff = F.col("_rel") * 100.0, F.when(F.col("_rel") > 0, F.col("_w.abs_diff")).otherwise(0.0)
    out = out.select(
        "metric", "n", (py_round(pct, 4) if rounded else pct).alias("max_rel_pct"), (py_round(diff, 6) if rounded else diff).alias("max_abs"),
        F.when(F.col("_rel") > 0, F.col("_w.file")).alias("worst_file"), py_round(limit * 100.0, 3).alias("tol_pct"), limit.alias("_t"),
    )
    return out.withColumn("flagged", F.col("max_rel_pct") > F.col("_t") * 100.0).drop("_t")


def phase_means(runs: DataFrame, a: str = "float32", b: str = "float64", rounded: bool = True) -> DataFrame:
    """Mean seconds per phase and variant over the (file, repeat) pairs that
    every variant completed, and the speed-up b / a."""
    timed = runs.filter(F.col("phase").isNotNull()).select("file", "repeat", "variant", "phase")
    # Both variants of a pair meet in one group; with only one variant in the
    # data every key is common.
    pairs = timed.groupBy("file", "repeat").agg(
        F.count_if(F.col("variant") == a).alias("na"), F.count_if(F.col("variant") == b).alias("nb"),
    )
    have = timed.agg(F.count_if(F.col("variant") == a).alias("a"), F.count_if(F.col("variant") == b).alias("b")).first()
    need_a, need_b = F.lit(have["a"] == 0) | (F.col("na") > 0), F.lit(have["b"] == 0) | (F.col("nb") > 0)
    common = pairs.filter(need_a & need_b).select("file", "repeat")
    flat = timed.join(common, ["file", "repeat"], "left_semi").select("variant", F.explode("phase").alias("phase", "sec"))
    means = flat.groupBy("phase").agg(
        F.avg(F.when(F.col("variant") == a, F.col("sec"))).alias("mean_a"), F.avg(F.when(F.col("variant") == b, F.col("sec"))).alias("mean_b")
    )
    if rounded:
        means = means.withColumns({"mean_a": py_round(F.col("mean_a"), 3), "mean_b": py_round(F.col("mean_b"), 3)})
    ratio = F.when((F.col("mean_a") != 0) & (F.col("mean_b") != 0), F.col("mean_b") / F.col("mean_a"))
    return means.filter(F.col("phase").isin(PHASES)).withColumn("speedup", py_round(ratio, 2) if rounded else ratio)


def run_counts(runs: DataFrame) -> DataFrame:
    return runs.agg(
        F.count(F.lit(1)).alias("runs"), F.count_if(F.coalesce("skipped", F.lit(False))).alias("skipped"),
        F.count_if(F.coalesce("error", F.lit("")) != "").alias("errors"),
    )
