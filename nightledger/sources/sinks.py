"""Outputs: path lists, JSON pages, work lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nightledger.functions.text import rewrite_path


def approved_paths(approved: DataFrame, src: str | None = None, dst: str | None = None) -> DataFrame:
    """Paths to stack: approved and not rejected, prefix rewritten."""
    keep = F.coalesce(F.col("rejected"), F.lit(0)) == 0
    return approved.filter(keep).select(rewrite_path(F.col("path"), src, dst).alias("path"))


def write_path_list(paths: DataFrame, out: str, single_file: bool = False) -> None:
    """One path per line.  A single file funnels the list through one task, so
    it is only made on request."""
    (paths.coalesce(1) if single_file else paths).write.mode("overwrite").text(out)


def solve_work_list(approved: DataFrame) -> DataFrame:
    return approved.select("id")


def to_json_rows(nested: DataFrame) -> DataFrame:
    """Nested frames as one JSON document per row; unknown leaves stay visible."""
    return nested.select(F.to_json(F.struct(*nested.columns), {"ignoreNullFields": "false"}).alias("value"))


def write_json(nested: DataFrame, out: str) -> None:
    nested.write.mode("overwrite").option("ignoreNullFields", False).json(out)
