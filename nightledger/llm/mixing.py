"""Mixing sources to target weights by the cube method.

A source's documents are wanted floor(f) times for sure and once more with probability f - floor(f), where f is its target
over its size.  The cube method settles these probabilities to 0 or 1 while it keeps, in each source, the sums of documents and
words: as long as three documents are open, it walks along the null space of both sums until one of them is settled.
Blocks of a source are settled in parallel; the few open documents of all its blocks form new blocks, until a source
has one block.  The walk keeps HELD documents of each block back, so that the landing has enough of them to hit the source's
words: it takes the best of all subsets of the last open documents (HELD and two at most).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

WEIGHTS = (5, 2, 1)
MOST = 3
#: Documents of a source that one task settles at a time.
BLOCK = 4000
#: Documents that the walk leaves to the landing, which looks at all their subsets.
HELD = 12
#: Share of the target below which an error in words counts less than one in documents.
NEAR = 0.001
SEED = 20
BROADCAST_SOURCES = 500_000
_OPEN = 1e-9


def words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def unit_key() -> Column:
    return F.xxhash64("doc_id", "source", "text")


def targets(sources: DataFrame) -> DataFrame:
    """Adds rank, weight, target to `sources` (source, source_size): shares of all sizes, none above MOST times its size.

    With the sources in order of MOST * size / weight, the first one whose share fits settles the level of the rest.
    The table has one row per source.
    """
    last = F.col("source").isNull()
    ranked = sources.withColumn("rank", F.row_number().over(Window.orderBy(last, "source")) - 1)
    ranked = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("rank") % len(WEIGHTS) + 1).cast("int")))
    cap = (MOST * F.col("source_size")).cast("double")
    order = Window.orderBy("_ratio", "rank")
    all_ = Window.partitionBy()
    level = (F.sum("source_size").over(all_) - F.coalesce(F.sum(cap).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))) / F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    ranked = ranked.withColumn("_ratio", cap / F.col("weight")).withColumn("_level", level)
    ranked = ranked.withColumn("_level", F.min(F.when(F.col("_ratio") >= F.col("_level"), F.struct("_ratio", "rank", "_level"))).over(all_)["_level"])
    return ranked.withColumn("target", F.least(cap, F.coalesce(F.col("_level") * F.col("weight"), cap))).drop("_ratio", "_level")


def flight(share: np.ndarray, size: np.ndarray, random: np.random.Generator, held: int = 0) -> np.ndarray:
    """Settle shares until at most two are open, beside `held` ones that are left alone: the longest third and the last."""
    share, size = np.where((share < _OPEN) | (share > 1 - _OPEN), np.round(share), share).tolist(), size.tolist()
    open_ = [i for i in range(len(share)) if 0 < share[i] < 1]
    longest = set(sorted(open_, key=lambda i: size[i])[max(0, len(open_) - held // 3) :])
    others = [i for i in open_ if i not in longest]
    active, waiting = [], iter(others[: max(0, len(others) - (held - len(longest)))])
    while True:
        while len(active) < 3 and (i := next(waiting, None)) is not None:
            active.append(i)
        if len(active) == 3:
            a, b, c = (size[i] for i in active)
            step = (c - b, a - c, b - a) if not a == b == c else (1, -1, 0)
        elif len(active) == 2 and size[active[0]] == size[active[1]]:
            step = (1, -1)
        else:
            return np.array(share)
        up = min((1 - share[i]) / u if u > 0 else share[i] / -u for i, u in zip(active, step) if u)
        down = min(share[i] / u if u > 0 else (1 - share[i]) / -u for i, u in zip(active, step) if u)
        go = up if random.random() * (up + down) < down else -down
        for i, u in zip(active, step):
            share[i] += go * u
            if share[i] < _OPEN or share[i] > 1 - _OPEN:
                share[i] = float(round(share[i]))
        active = [i for i in active if 0 < share[i] < 1]


def landing(share: np.ndarray, size: np.ndarray, near: float = 0.0) -> np.ndarray:
    """Settle the last open shares by the best of all their subsets.

    Best is what comes within `near` words of those the shares stand for, or else nearest to it; then nearest to their documents,
    then to the words.
    """
    left = np.flatnonzero((share > 0) & (share < 1))
    subsets = np.arange(1 << len(left))[:, None] >> np.arange(len(left)) & 1
    words = np.abs(subsets @ size[left] - share[left] @ size[left])
    docs = np.abs(subsets.sum(axis=1) - share[left].sum())
    share = share.copy()
    share[left] = subsets[np.lexsort((words, docs, np.maximum(words - near, 0)))[0]]
    return share


def _settle(block: pd.DataFrame) -> pd.DataFrame:
    """One block of a source: the flight, and the landing where it is the source's only one."""
    block = block.sort_values(["turn", "doc_id", "size", "copy"], na_position="first")
    first = block.iloc[0]
    random = np.random.default_rng([SEED, int(first["rank"]), int(first["block"]), int(first["round"])])
    # Small blocks hold less back, so that every round leaves fewer documents open.
    last, size = first["blocks"] == 1, block["size"].to_numpy()
    share = flight(block["share"].to_numpy(), size, random, HELD if last else min(HELD, len(block) // 4))
    return block.assign(share=landing(share, size, NEAR * first["target"]) if last else share)


def mixed(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies, source, key, copy for every row of docs (doc_id, text, source).

    key names rows with the same doc_id, text and source, and copy numbers them from 1.
    Sizes count words; NULL texts and wordless ones have size 0 and take nothing.  A NULL source is a source, the last.
    Repeated rows are documents of their own.  The same rows give the same mix on every run, however they are partitioned.
    Other columns are ignored; an empty table gives an empty result.
    """
    rows = docs.select(unit_key().alias("key"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), words(F.col("text")).alias("size"))
    rows = written(rows.groupBy("key", "doc_id", "source", "size").count(), "sizes")
    sources = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("count")).alias("source_size"), F.sum("count").alias("docs"))
    sources = written(targets(sources), "sources")
    factor = F.when(F.col("source_size") > 0, F.least(F.lit(float(MOST)), F.col("target") / F.col("source_size"))).otherwise(0.0)
    # One row a source: broadcast up to a checked number of them, so that no source's documents meet in one task.
    few = F.broadcast if sources.count() <= BROADCAST_SOURCES else (lambda table: table)
    units = rows.withColumnRenamed("source", "_source").join(few(sources), F.col("source").eqNullSafe(F.col("_source")))
    units = units.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("count")))).withColumn("_f", factor)
    units = units.withColumns({"sure": F.floor("_f").cast("long"), "share": F.col("_f") - F.floor("_f"), "turn": F.xxhash64("key", "copy", F.lit(SEED))})
    facts = ["key", "doc_id", "source", "copy", "rank", "size", "source_size", "target", "sure", "turn", "share"]
    open_, done, turn = units.select(*facts), None, 0
    while True:
        counts = open_.groupBy("rank").agg(F.ceil(F.count(F.lit(1)) / block).cast("long").alias("blocks"))
        dealt = open_.join(few(counts), "rank").withColumns({"round": F.lit(turn), "block": F.pmod(F.xxhash64("turn", F.lit(turn)), F.col("blocks"))})
        settled = written(dealt.repartition("rank", "block").groupBy("rank", "block").applyInPandas(_settle, dealt.schema), "settled")
        ends = settled.where("share = 0 or share = 1").select(*facts)
        done = ends if done is None else done.unionByName(ends)
        open_, turn = settled.where("share > 0 and share < 1").select(*facts), turn + 1
        if open_.isEmpty():
            break
    copies = F.col("sure") + F.col("share").cast("long")
    return done.select("doc_id", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.alias("copies"), "source", "key", "copy")
