"""A frame catalogue in generations: buckets by path that are copied on write, and a manifest of the copies that count.

    <catalog>/data/generation=<g>/bucket=<b>/    rows of a bucket as generation g left them; never changed afterwards
    <catalog>/manifest/generation=<g>/           one row per bucket that has rows: the generation that wrote it
    <catalog>/incoming/generation=<g>/           the rows of a batch, before they are merged

A batch writes anew only the buckets its paths fall into.  The manifest is one small file and is written last, so readers
see a batch whole or not at all.  A read lists the folders of the newest manifest and takes their rows as they are:
nothing is grouped or compared.  One writer at a time; folders that `unused_folders` names may be deleted.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nightledger.schema import FRAME_COLUMNS, FRAME_SCHEMA, conform
from nightledger.sources.library import unique_paths

#: Buckets of a new catalogue, unless told otherwise: one should hold some hundred MB when the catalogue is full.
BUCKETS = 64
_MANIFEST = "bucket int, written bigint, buckets int, done map<string,bigint>, generation bigint"


@dataclass(frozen=True)
class Manifest:
    """What a generation consists of; `done` has the last batch of each source."""

    generation: int = 0
    buckets: int = 0
    written: dict[int, int] = field(default_factory=dict)
    done: dict[str, int] = field(default_factory=dict)


def _rows(spark: SparkSession, folder: str, schema: str | None = None) -> DataFrame | None:
    try:
        reader = spark.read.schema(schema) if schema else spark.read
        return reader.parquet(folder)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def manifest(spark: SparkSession, catalog: str, generation: int | None = None) -> Manifest:
    """The newest manifest, or that of an earlier generation; an empty one where there is none."""
    rows = _rows(spark, f"{catalog}/manifest", _MANIFEST)
    if rows is None:
        return Manifest()
    newest = rows.agg(F.max("generation")).first()[0] if generation is None else generation
    found = rows.where(F.col("generation") == newest).collect()  # a row for each bucket
    if not found:
        return Manifest()
    written = {r["bucket"]: r["written"] for r in found if r["bucket"] is not None}
    return Manifest(newest, found[0]["buckets"], written, dict(found[0]["done"]))


def bucket_of(path: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(path), F.lit(buckets)).cast("int")


def _folder(catalog: str, generation: int, bucket: int) -> str:
    return f"{catalog}/data/generation={generation}/bucket={bucket}"


def _read(spark: SparkSession, catalog: str, written: dict[int, int]) -> DataFrame:
    folders = [_folder(catalog, g, b) for b, g in sorted(written.items())]
    return spark.read.schema(FRAME_SCHEMA).parquet(*folders) if folders else spark.createDataFrame([], FRAME_SCHEMA)


def read_current(spark: SparkSession, catalog: str, generation: int | None = None) -> DataFrame:
    """The catalogue as the newest (or an earlier) generation has it: one row a path, that of its last writer."""
    return _read(spark, catalog, manifest(spark, catalog, generation).written)


def read_paths(spark: SparkSession, catalog: str, paths: list[str]) -> DataFrame:
    """The rows of a few paths; only their buckets are read."""
    now = manifest(spark, catalog)
    wanted = spark.createDataFrame([(p,) for p in paths], "path string")
    buckets = {r[0] for r in wanted.select(bucket_of(F.col("path"), now.buckets or 1)).collect()}
    return _read(spark, catalog, {b: g for b, g in now.written.items() if b in buckets}).where(F.col("path").isin(paths))


def commit(spark: SparkSession, catalog: str, rows: DataFrame, removed: DataFrame | None = None, source: str = "", batch: int | None = None, buckets: int = BUCKETS) -> int:
    """Take `rows` in, each in place of its path's row, and drop the paths of `removed`; the generation that has them.

    The writer that comes last wins, whatever the times of the files say; of rows of one path in one batch, the newest.
    A batch number that its source has committed before changes nothing, so a stream may replay.  A batch that failed
    half-way left no manifest and is written over.
    """
    now = manifest(spark, catalog)
    if batch is not None and now.done.get(source, -1) >= batch:
        return now.generation
    generation, n = now.generation + 1, now.buckets or buckets
    incoming = f"{catalog}/incoming/generation={generation}"
    bucket = bucket_of(F.col("path"), n)
    gone = spark.createDataFrame([], "path string") if removed is None else removed.select("path")
    conform(unique_paths(conform(rows))[0]).withColumn("bucket", bucket).write.mode("overwrite").parquet(f"{incoming}/rows")
    gone.distinct().withColumn("bucket", bucket).write.mode("overwrite").parquet(f"{incoming}/gone")
    fresh, gone = spark.read.parquet(f"{incoming}/rows"), spark.read.parquet(f"{incoming}/gone")
    changed = fresh.select("path", "bucket").unionByName(gone)
    touched = {r[0] for r in changed.select("bucket").distinct().collect()}
    old = _read(spark, catalog, {b: g for b, g in now.written.items() if b in touched})
    kept = old.join(changed.select("path"), "path", "left_anti").withColumn("bucket", bucket)
    merged = kept.select(*FRAME_COLUMNS, "bucket").unionByName(fresh.select(*FRAME_COLUMNS, "bucket"))
    data = f"{catalog}/data/generation={generation}"
    merged.repartition(max(1, len(touched)), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(data)
    left = _rows(spark, data, "path string, bucket int")
    with_rows = {r[0] for r in left.select("bucket").distinct().collect()} if left is not None else set()
    written = {b: g for b, g in now.written.items() if b not in touched} | dict.fromkeys(with_rows, generation)
    done = now.done | ({source: batch} if batch is not None else {})
    table = [(b, g, n, done) for b, g in sorted(written.items())] or [(None, None, n, done)]
    spark.createDataFrame(table, _MANIFEST.removesuffix(", generation bigint")).coalesce(1).write.mode("overwrite").parquet(f"{catalog}/manifest/generation={generation}")
    return generation


def unused_folders(spark: SparkSession, catalog: str, keep: int = 2) -> list[str]:
    """Folders that none of the `keep` newest generations reads, and merged batches; nothing is deleted here."""
    rows = _rows(spark, f"{catalog}/manifest", _MANIFEST)
    if rows is None:
        return []
    newest = rows.agg(F.max("generation")).first()[0]
    stale = rows.where(F.col("bucket").isNotNull()).groupBy("bucket", "written").agg(F.max("generation").alias("last")).where(F.col("last") <= newest - keep)
    folders = [_folder(catalog, r["written"], r["bucket"]) for r in stale.collect()]
    return sorted(folders) + [f"{catalog}/incoming/generation={g}" for g in range(1, newest + 1)]
