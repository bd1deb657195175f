"""Reading and maintaining the frame table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nightledger.config import DEFAULTS, Settings
from nightledger.functions.scoring import with_scores
from nightledger.functions.text import night
from nightledger.schema import FRAME_COLUMNS, FRAME_SCHEMA, conform

# Heavy text columns a list view never needs.
HEAVY_COLUMNS = ["header_json", "diagnostics_json"]


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """Scan the catalogue.  Older files lack newer columns; the declared schema
    fills them with NULL, so added columns need no rewrite."""
    return spark.read.schema(FRAME_SCHEMA).parquet(path).select(*FRAME_COLUMNS)


def list_view(frames: DataFrame) -> DataFrame:
    """Every column but the heavy ones, so the scan never reads them."""
    return frames.drop(*[c for c in HEAVY_COLUMNS if c in frames.columns])


def write_frames(frames: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write the catalogue laid out for its queries.

    Partitioned by image type; inside, rows are range-clustered by night and
    target so that file statistics prune date and object filters.  Range
    partitioning splits a hot object over several files instead of one task.
    """
    staged = frames.withColumn("_night", night(F.col("date_obs")))
    (
        staged.repartitionByRange(F.col("imagetyp"), F.col("_night"), F.col("object"), F.col("id"))
        .sortWithinPartitions("imagetyp", "object", "filter", "date_obs")
        .drop("_night")
        .write.mode(mode)
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("imagetyp")
        .parquet(path)
    )


def evolve(old: DataFrame, new: DataFrame) -> DataFrame:
    """Stack two generations of the table; columns missing on one side are NULL."""
    return old.unionByName(new, allowMissingColumns=True)


def ok_frames(frames: DataFrame) -> DataFrame:
    return frames.filter(F.col("index_error").isNull())


def light_frames(frames: DataFrame, tombstones: bool = False) -> DataFrame:
    """Light frames; tombstones are left out unless asked for."""
    lights = frames.filter(F.col("imagetyp") == "Light Frame")
    return lights if tombstones else ok_frames(lights)


# -- reanalysis and upkeep -------------------------------------------------------


def needs_analysis(frames: DataFrame, version: int = DEFAULTS.diagnostics_version) -> DataFrame:
    """Light frames never analyzed, without sky geometry, or analyzed by an
    older version (which leads the stored diagnostics)."""
    c = F.col
    current = c("diagnostics_json").startswith(f'{{"v":{version},')
    return frames.filter(c("imagetyp") == "Light Frame").filter(
        c("median_hfr").isNull() | c("altitude").isNull() | c("trail_score").isNull()
        | c("diagnostics_json").isNull() | ~current
    )


def unsolved(frames: DataFrame) -> DataFrame:
    return frames.filter((F.col("imagetyp") == "Light Frame") & (F.coalesce(F.col("solved"), F.lit(0)) == 0))


def update_metrics(frames: DataFrame, updates: DataFrame, key: str = "id") -> DataFrame:
    """Replace the columns of `updates` on the rows it names, keep the rest.

    A row named in `updates` takes its values even where they are NULL.
    """
    cols = [c for c in updates.columns if c != key]
    new = updates.select(F.col(key), F.struct(*cols).alias("_new"))
    joined = frames.join(new, key, "left")
    out = [
        F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) if c in cols else F.col(c)
        for c in frames.columns
    ]
    return joined.select(*out)


def rescore(frames: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    """Analyzed light frames whose trail score or quality changes under the
    current rules, with the new values; empty once applied."""
    base = frames.filter((F.col("imagetyp") == "Light Frame") & F.col("star_count").isNotNull())
    old = base.withColumns({"_t": F.col("trail_score"), "_q": F.col("quality_score")})
    new = with_scores(old, cfg)
    changed = ~F.col("trail_score").eqNullSafe(F.col("_t")) | ~F.col("quality_score").eqNullSafe(F.col("_q"))
    return new.filter(changed).select("id", "trail_score", "quality_score")


def backfill_set_temp(frames: DataFrame) -> DataFrame:
    """Fill a missing cooler setpoint from the stored header.

    Only a JSON *number* counts: the text "-10" stays unknown.
    """
    header = F.try_parse_json(F.col("header_json"))

    def number(key: str) -> Column:
        path = f"$['{key}']"
        typed = F.schema_of_variant(F.try_variant_get(header, path, "variant"))
        value = F.try_variant_get(header, path, "double")
        return F.when(typed.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), value)

    found = F.coalesce(*[number(k) for k in ("SET-TEMP", "SET_TEMP", "SETTEMP")])
    return frames.withColumn("set_temp", F.coalesce(F.col("set_temp"), found))


def random_lights(frames: DataFrame, listing: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n random light-frame paths that still exist.  The order key hashes the
    path, so a retried task draws the same sample."""
    alive = frames.filter(F.col("imagetyp") == "Light Frame").select("path").join(listing.select("path"), "path", "left_semi")
    return alive.orderBy(F.md5(F.concat(F.lit(str(seed)), F.col("path")).cast("binary")), F.col("path")).limit(n)


def drop_roots(frames: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows left after deleting library roots (column `id`), which cascades."""
    gone = roots.select(F.col("id").alias("watched_path_id"))
    # A root holds a large part of the frames: a list of roots of checked size leaves the frames where they are.
    if gone.limit(_FEW_ROOTS + 1).count() <= _FEW_ROOTS:
        gone = F.broadcast(gone)
    return frames.join(gone, "watched_path_id", "left_anti").select(*frames.columns)


_FEW_ROOTS = 100_000


# -- grades ---------------------------------------------------------------------


def latest_grades(grades: DataFrame) -> DataFrame:
    """Last word per frame from the append-only grade log; NULL unmarks.

    Equal times fall to the larger grade, so the outcome never depends on
    row order.
    """
    key = F.struct(F.col("ts"), F.coalesce(F.col("grade"), F.lit(-1)))
    return grades.groupBy("frame_id").agg(F.max_by(F.struct("grade"), key).alias("g")).select("frame_id", F.col("g.grade").alias("grade"))


def apply_grades(frames: DataFrame, grades: DataFrame) -> DataFrame:
    """Overlay the grade log on the stored grade."""
    latest = latest_grades(grades).select(F.col("frame_id").alias("id"), F.struct("grade").alias("_g"))
    graded = frames.join(latest, "id", "left")
    value = F.when(F.col("_g").isNotNull(), F.col("_g.grade")).otherwise(F.col("rejected"))
    return graded.withColumn("rejected", value).select(*frames.columns)


GRADE_VALUES = {"rejected": 1, "accepted": 0, None: None}


def grade_event(frame_ids: DataFrame, grade: str | None, ts: Column) -> DataFrame:
    """Rows for the grade log.  `grade` is accepted, rejected or None."""
    if grade not in GRADE_VALUES:
        raise ValueError(f"unknown grade: {grade}")
    return frame_ids.select(
        F.col("id").alias("frame_id"), F.lit(GRADE_VALUES[grade]).cast("int").alias("grade"), ts.cast("timestamp_ntz").alias("ts")
    )


def conform_frames(df: DataFrame) -> DataFrame:
    return conform(df).select(*FRAME_COLUMNS)
