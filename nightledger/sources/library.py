"""Library listing, change detection and the merge of a rescan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nightledger.config import DEFAULTS
from nightledger.functions.text import file_format, file_name
from nightledger.schema import FRAME_SCHEMA


def list_library(spark: SparkSession, *roots: str) -> DataFrame:
    """Image files below the roots: path, mtime, length.

    The listing runs through the file source, so big folders are listed in
    parallel and no file is opened.  Dot-folders are skipped; the extension
    test ignores case.
    """
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).load(list(roots))
        .select("path", "modificationTime", "length")
    )
    plain = F.regexp_replace(F.col("path"), "^file:/*", "/")
    return (
        files.select(
            plain.alias("path"),
            (F.unix_micros("modificationTime") / 1e6).alias("mtime"),
            "length",
        )
        .filter(file_format(F.col("path")).isNotNull())
        .filter(~F.col("path").rlike(r"/\.[^/]*/"))
    )


def diff_listing(listing: DataFrame, frames: DataFrame, tolerance_s: float = DEFAULTS.mtime_tolerance_s) -> DataFrame:
    """Listing with a `change` column: new, changed or unchanged.

    A known file without a stored time (or time 0) is never reindexed.
    """
    known = frames.select("path", F.col("file_mtime").alias("_stored"), F.lit(True).alias("_known"))
    known = known.groupBy("path").agg(F.max("_stored").alias("_stored"), F.max("_known").alias("_known"))
    moved = (F.coalesce(F.col("_stored"), F.lit(0.0)) != 0) & (F.abs(F.col("mtime") - F.col("_stored")) > tolerance_s)
    change = F.when(F.col("_known").isNull(), "new").when(moved, "changed").otherwise("unchanged")
    return listing.join(known, "path", "left").withColumn("change", change).drop("_stored", "_known")


def to_index(diff: DataFrame) -> DataFrame:
    return diff.filter(F.col("change") != "unchanged")


def unique_paths(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One row per path, and the surplus rows that a unique path refuses.

    The kept row is the newest.  The first of a ranking is chosen before the shuffle too, so a path repeated a billion
    times still reaches its reducer as a few rows; and only the columns that are asked for are ranked, not whole rows.
    """
    order = Window.partitionBy("path").orderBy(F.col("_time").desc(), F.col("_hash").desc())
    ranked = rows.withColumns({"_time": F.coalesce(F.col("file_mtime"), F.lit(float("-inf"))), "_hash": F.xxhash64(*[F.col(c) for c in rows.columns])})
    kept = ranked.withColumn("_rank", F.row_number().over(order)).filter("_rank = 1").select(*rows.columns)
    surplus = rows.groupBy("path").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1).select("path", (F.col("n") - 1).alias("refused"))
    return kept, surplus


def refused_rows(new: DataFrame, frames: DataFrame) -> DataFrame:
    """(path, refused): rows of a plain append that unique paths refuse, because the catalogue has the path or another row of `new` does."""
    counted = new.groupBy("path").agg(F.count(F.lit(1)).alias("n"))
    known = frames.select("path").distinct().withColumn("_known", F.lit(1))
    refused = F.col("n") - F.when(F.col("_known").isNull(), 1).otherwise(0)
    return counted.join(known, "path", "left").select("path", refused.alias("refused")).filter("refused > 0")


def merge_frames(old: DataFrame, new: DataFrame) -> DataFrame:
    """Catalogue after a rescan: rows of re-read paths replaced, others kept."""
    kept, _ = unique_paths(new)
    return old.join(new.select("path").distinct(), "path", "left_anti").unionByName(kept, allowMissingColumns=True).select(*old.columns)


def prune_missing(frames: DataFrame, listing: DataFrame) -> DataFrame:
    """Rows whose file still exists."""
    return frames.join(listing.select("path"), "path", "left_semi")


def tombstones(failures: DataFrame, max_text: int = DEFAULTS.error_text_max) -> DataFrame:
    """Frame rows for unreadable files (path, mtime, error), so that later
    scans skip them."""
    base = failures.select(
        "path",
        file_name(F.col("path")).alias("filename"),
        F.col("mtime").alias("file_mtime"),
        F.substring("error", 1, max_text).alias("index_error"),
    )
    rest = [F.lit(None).cast(f.dataType).alias(f.name) for f in FRAME_SCHEMA if f.name not in base.columns]
    return base.select("*", *rest).select(*[f.name for f in FRAME_SCHEMA])
