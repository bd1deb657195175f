"""What the corpus operators share: tables in the shared folder, joins that survive a hot key, connected components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key with more than this share of all rows counts as hot; there are at most 1 / HOT_SHARE such keys.
HOT_SHARE = 1 / 500


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir; a temporary one only where it is unset (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="corpus-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage, and lost executors cost no recomputation."""
    path = new_path(df.sparkSession, name)
    df.write.partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def given_back(batches):
    """The batches of a task; after the last, the memory that its worker's allocators hold but do not use goes back to the machine."""
    yield from batches
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library: only the pool is trimmed


def attach(rows: DataFrame, groups: DataFrame, key: str, weight: str, total: int, how: str = "inner") -> DataFrame:
    """Join `groups` (one row per key; `weight` rows of `rows` have it) to `rows`.

    Hot keys, of which there are at most 1 / HOT_SHARE, are broadcast, so that their rows stay where they are; no
    other key holds more than that share of the rows, and those are joined by a shuffle.  Rows with a NULL key match nothing.
    """
    limit = max(1, int(total * HOT_SHARE))
    hot = groups.where(F.col(weight) > limit)
    marked = rows.join(F.broadcast(hot.select(F.col(key).alias("_hot"))), F.col(key) == F.col("_hot"), "left")
    first = marked.where(F.col("_hot").isNotNull()).drop("_hot").join(F.broadcast(hot), key)
    rest = marked.where(F.col("_hot").isNull()).drop("_hot").join(groups.where(F.col(weight) <= limit), key, how)
    return first.unionByName(rest)


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node that an edge touches; root is the smallest node of the component.

    Each round hooks every root to its smallest neighbour, follows the pointers twice and contracts the edges, so the
    number of roots at least halves and the rounds are logarithmic in the longest path.
    """
    both = edges.select(F.col(a).alias("src"), F.col(b).alias("dst"))
    both = written(both.union(both.select("dst", "src")).where("src <> dst").distinct(), "edges")
    roots = written(both.select(F.col("src").alias("node"), F.col("src").alias("root")).distinct(), "roots")
    while not both.isEmpty():
        hop = both.groupBy("src").agg(F.least(F.col("src"), F.min("dst")).alias("to"))
        for _ in range(2):
            far = hop.select(F.col("src").alias("mid"), F.col("to").alias("far"))
            hop = hop.join(far, hop["to"] == far["mid"], "left").select("src", F.coalesce("far", "to").alias("to"))
        hop = written(hop, "hops")
        head, tail = (hop.select(F.col("src").alias(x), F.col("to").alias(f"{x}_to")) for x in ("src", "dst"))
        roots = written(roots.join(head, roots["root"] == head["src"], "left").select("node", F.coalesce("src_to", "root").alias("root")), "roots")
        both = both.join(head, "src").join(tail, "dst").select(F.col("src_to").alias("src"), F.col("dst_to").alias("dst"))
        both = written(both.where("src <> dst").distinct(), "edges")
    return roots
