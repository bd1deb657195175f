"""Exact dedup by two-pass Bloom filtering; DataFrame functions only.

Pass one sets each text's cells in a bit array and keeps the cells that were set at least twice.  Pass two tests every
row against that second filter: rows with a cell set only once cannot have a copy and pass straight through; only the
others shuffle, by the text's SHA-256.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import attach, written

#: Cells per row and of each row.  With 16 and 2, about 1.4 % of the rows without a copy are tested in vain.
CELLS_PER_ROW, CELLS_OF_ROW = 16, 2
#: A second filter of more 64-cell words than this (16 bytes each) is joined by a shuffle of narrow rows, not broadcast.
BROADCAST_WORDS = 2_000_000


def _cells(digest: Column, cells: int) -> list[Column]:
    return [F.pmod(F.xxhash64(digest, F.lit(i)), F.lit(cells)) for i in range(CELLS_OF_ROW)]


def bit_count(rows: int) -> int:
    """Cells for so many rows: a power of two."""
    return 1 << max(10, math.ceil(math.log2(CELLS_PER_ROW * max(1, rows))))


def set_cells(rows: DataFrame, digest: str, cells: int, times: int) -> DataFrame:
    """(word, bits): the cells that at least so many rows set, 64 to a word."""
    hit = rows.select(F.explode(F.array(*_cells(F.col(digest), cells))).alias("cell")).groupBy("cell").count().where(F.col("count") >= times)
    bit = F.expr("shiftleft(1L, cast(cell & 63 as int))")
    return written(hit.groupBy(F.shiftright("cell", 6).alias("word")).agg(F.bit_or(bit).alias("bits")), "cells")


def tested(rows: DataFrame, digest: str, cells: int, words: DataFrame) -> DataFrame:
    """`rows` with a boolean `maybe`: whether all cells of the digest are among the words' bits."""
    small = words.count() <= BROADCAST_WORDS
    maybe = F.lit(True)
    for i, cell in enumerate(_cells(F.col(digest), cells)):
        rows = rows.withColumn(f"_cell{i}", cell)
        side = words.select(F.col("word").alias(f"_word{i}"), F.col("bits").alias(f"_bits{i}"))
        rows = rows.join(F.broadcast(side) if small else side, F.shiftright(f"_cell{i}", 6) == F.col(f"_word{i}"), "left")
        maybe = maybe & (F.expr(f"shiftright(coalesce(_bits{i}, 0L), cast(_cell{i} & 63 as int)) & 1L") == 1)
    return rows.withColumn("maybe", maybe).drop(*(f"_{x}{i}" for i in range(CELLS_OF_ROW) for x in ("cell", "word", "bits")))


def possibly_repeated(rows: DataFrame, digest: str, cells: int) -> DataFrame:
    """`rows` with a boolean `maybe`: false only if no other row has the same digest."""
    return tested(rows, digest, cells, set_cells(rows, digest, cells, 2))


def exact_dedup(docs: DataFrame) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256.

    Equal texts form a group (NULL counts as empty); its largest doc_id stays.  Rows that repeat a doc_id and its text
    share their verdict.  A NULL doc_id is smaller than any other.  Other columns are ignored; an empty table gives none.
    """
    rows = docs.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))
    total = docs.count()
    found = possibly_repeated(rows.withColumn("_digest", F.xxhash64("text_sha256")), "_digest", bit_count(total)).drop("_digest")
    alone = found.where(~F.col("maybe")).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    again = found.where("maybe").drop("maybe")
    groups = written(again.groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "groups")
    copies = attach(again, groups, "text_sha256", "group_size", total)
    return alone.unionByName(copies.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"))
