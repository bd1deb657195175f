"""Incremental header ingest: new and changed files of a library as one stream into the catalogue's generations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from nightledger.schema import conform
from nightledger.sources.generations import BUCKETS, commit, read_current
from nightledger.sources.header_source import FrameHeaders
from nightledger.sources.headers import frames_from_headers, parse_headers


def header_stream(spark: SparkSession, root: str, state: str, files_per_batch: int = 10_000) -> DataFrame:
    """New and changed image files below the root with their header blocks; `state` keeps the listings between runs."""
    spark.dataSource.register(FrameHeaders)
    options = {"path": root, "state": state, "files_per_batch": str(files_per_batch)}
    return spark.readStream.format("frame_headers").options(**options).load()


def frame_rows(heads: DataFrame) -> DataFrame:
    """Catalogue rows of header blocks; unreadable files become tombstones."""
    return conform(frames_from_headers(parse_headers(heads)).withColumn("id", F.xxhash64("path")))


def ingest(spark: SparkSession, root: str, catalog: str, checkpoint: str, files_per_batch: int = 10_000, buckets: int = BUCKETS) -> StreamingQuery:
    """Start taking new and changed files into the catalogue, batch by batch; it goes on until it is stopped.

    A batch replayed after a failure is recognised by its number and changes nothing.
    """

    def write(batch: DataFrame, number: int) -> None:
        commit(batch.sparkSession, catalog, frame_rows(batch), source=checkpoint, batch=number, buckets=buckets)

    stream = header_stream(spark, root, f"{checkpoint}/listing", files_per_batch)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{checkpoint}/query").start()


def catch_up(spark: SparkSession, root: str, catalog: str, checkpoint: str, files_per_batch: int = 10_000, buckets: int = BUCKETS) -> DataFrame:
    """Take in all that is new or changed now, then stop; the catalogue."""
    query = ingest(spark, root, catalog, checkpoint, files_per_batch, buckets)
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return read_current(spark, catalog)
