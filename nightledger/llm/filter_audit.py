"""How filters interact: every document is a truth table of the filter subsets it survives.

Bit S of a document's 32-bit word is set if the document passes all filters of subset S.  The words of a part and label
are summed bit by bit with carry-save adders, which gives the survivors of every subset; each figure of every order of
the filters is a difference of two of them.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import attach, written

FILTERS = "ABCDE"
SUBSETS = 1 << len(FILTERS)
#: White space that separates words.
GAP = r"[\x20\x09-\x0D]+"
#: Groups a task sums up before it hands them on.
GROUPS_AT_A_TIME = 4096


def positional_popcount(words: np.ndarray) -> np.ndarray:
    """How many of the 32-bit words have each bit: full adders turn three rows of words into a sum and a carry until two are left."""
    lanes = max(1, int(len(words) ** 0.5))
    rows = np.pad(np.asarray(words, np.uint32), (0, -len(words) % lanes)).reshape(-1, lanes)
    total, weight = np.zeros(32, np.int64), 1
    while len(rows):
        carries = [rows[:0]]
        while len(rows) >= 3:
            n = len(rows) // 3
            a, b, c = rows[:n], rows[n : 2 * n], rows[2 * n : 3 * n]
            half = a ^ b
            carries.append(a & b | half & c)
            rows = np.concatenate([half ^ c, rows[3 * n :]])
        bits = np.unpackbits(np.ascontiguousarray(rows, "<u4").view(np.uint8), bitorder="little")
        total += weight * bits.reshape(-1, 32).sum(0, dtype=np.int64)
        rows, weight = np.concatenate(carries), 2 * weight
    return total


def failures(text: Column) -> dict[str, Column]:
    """The conditions that a text alone decides: under which it fails a filter."""
    words = F.array_remove(F.split(text, GAP), "")
    n = F.size(words)
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {"A": n < 100, "B": F.size(F.array_distinct(words)) * 100 < n * 80, "C": capitals * 100 > F.length(text) * 10, "D": text.rlike("[#$%&*|]")}


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, good, toxic and the failed filters (bit i: filter i) of every row of docs."""
    text = F.coalesce("text", F.lit(""))
    bits = [F.when(fails, 1 << FILTERS.index(name)).otherwise(0) for name, fails in failures(F.col("_text")).items()]
    rows = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), text.alias("_text"))
    rows = written(rows.select("doc_id", "part", F.sha2("_text", 256).alias("digest"), sum(bits[1:], bits[0]).alias("own")), "judged")
    copies = rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    copied = F.when(F.col("doc_id") > F.col("first"), 1 << FILTERS.index("E")).otherwise(0)
    rows = attach(rows, written(copies, "copies"), "digest", "n", rows.count(), "left")
    known = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    return rows.join(known, "doc_id", "left").select("part", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"), F.col("own").bitwiseOR(copied).alias("failed"))


def survival_word(failed: Column) -> Column:
    """Bit S: no failed filter is in S.  Each filter allows the subsets without it."""
    word = F.lit((1 << SUBSETS) - 1)
    for i in range(len(FILTERS)):
        without = sum(1 << s for s in range(SUBSETS) if not s >> i & 1)
        word = word.bitwiseAND(F.when(failed.bitwiseAND(F.lit(1 << i)) != 0, F.lit(without)).otherwise(F.lit((1 << SUBSETS) - 1)))
    return word


def survivors(rows: DataFrame) -> DataFrame:
    """part and the arrays kept, kept_good, kept_toxic: documents of the part that survive each subset."""

    def summed(batches):
        sums: dict[tuple[str, int], np.ndarray] = {}

        def table():
            keys = list(sums)
            columns = [pa.array(np.repeat([p for p, _ in keys], SUBSETS).tolist(), pa.string()), pa.array(np.repeat([c for _, c in keys], SUBSETS), pa.int32())]
            columns += [pa.array(np.tile(np.arange(SUBSETS), len(keys)), pa.int32()), pa.array(np.concatenate(list(sums.values())), pa.int64())]
            return pa.RecordBatch.from_arrays(columns, ["part", "label", "subset", "n"])

        for batch in batches:
            coded = batch["part"].dictionary_encode()
            key = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) * 4 + batch["label"].to_numpy(zero_copy_only=False)
            words = batch["word"].to_numpy(zero_copy_only=False).astype(np.uint32)
            order = np.argsort(key, kind="stable")
            kinds, starts = np.unique(key[order], return_index=True)
            for kind, some in zip(kinds.tolist(), np.split(words[order], starts[1:])):
                name = coded.dictionary[kind // 4].as_py(), kind % 4
                sums[name] = sums.get(name, 0) + positional_popcount(some)
            if len(sums) >= GROUPS_AT_A_TIME:
                yield table()
                sums.clear()
        if sums:
            yield table()

    words = rows.select("part", (F.col("good") + F.col("toxic") * 2).alias("label"), survival_word(F.col("failed")).alias("word"))
    counts = words.mapInArrow(summed, "part string, label int, subset int, n bigint")
    own = [F.sum(F.when(F.col("label").bitwiseAND(F.lit(bit)) == bit, F.col("n")).otherwise(0)) for bit in (0, 1, 2)]
    sums = counts.groupBy("part", "subset").agg(*(c.alias(n) for c, n in zip(own, ("kept", "good", "toxic"))))
    # One row for each subset of a part: 32.
    whole = sums.groupBy("part").agg(F.sort_array(F.collect_list(F.struct("subset", "kept", "good", "toxic"))).alias("s"))
    return whole.select("part", F.col("s.kept").alias("kept"), F.col("s.good").alias("kept_good"), F.col("s.toxic").alias("kept_toxic"))


def _orders() -> Column:
    """filter_order, step, bit (the step's filter), before and after (subsets applied) of every step of every order."""
    steps = []
    for order in permutations(range(len(FILTERS))):
        name, before = "".join(FILTERS[i] for i in order), 0
        for step, i in enumerate(order, 1):
            steps.append(f"named_struct('filter_order', '{name}', 'step', {step}, 'bit', {i}, 'before', {before}, 'after', {before | 1 << i})")
            before |= 1 << i
    return F.expr(f"inline(array({', '.join(steps)}))")


def _shapley(i: int) -> Column:
    """Removals by filter i summed over all orders: a subset applied before it stands for all orders of its filters and of the rest."""
    terms = []
    for s in range(SUBSETS):
        if not s >> i & 1:
            orders = factorial(s.bit_count()) * factorial(len(FILTERS) - 1 - s.bit_count())
            terms.append((F.col("kept")[s] - F.col("kept")[s | 1 << i]) * orders)
    return sum(terms[1:], terms[0])


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Every part, order of the filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    A document whose text is NULL has an empty one, one without lang is in the part ''.  A NULL doc_id is neither smaller
    nor larger than another, so such a row fails E never, and has no labels; rows that repeat a doc_id and its text are
    not copies of each other.  A document is good or toxic if any row of `labels` says so.  Other columns are ignored; an
    empty table has no parts.
    """
    whole = survivors(judged(docs, labels))
    whole = whole.withColumn("shapleys", F.array(*(_shapley(i) for i in range(len(FILTERS)))))
    rows = whole.select("*", _orders())

    def lost(kept: str) -> Column:
        return F.col(kept)[F.col("before")] - F.col(kept)[F.col("after")]

    own = F.expr("shiftleft(1, bit)")
    fails = F.col("kept")[0] - F.col("kept")[own]
    alone = F.col("kept")[F.lit(SUBSETS - 1) - own] - F.col("kept")[SUBSETS - 1]
    return rows.select(
        "part", "filter_order", "step", F.col("kept")[F.col("after")].alias("kept"), lost("kept").alias("removed"), (fails - lost("kept")).alias("redundant"),
        alone.alias("unique_fails"), lost("kept_good").alias("good_lost"), lost("kept_toxic").alias("toxic_lost"), F.col("shapleys")[F.col("bit")].alias("shapley"),
    )


#: The same from the definition: the verdicts of every document, and every step's sums over the kinds of verdicts.
SQL = r"""
    WITH texts AS (
        SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS body FROM documents
    ), words AS (
        SELECT *, regexp_extract_all(body, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY body) AS first_id FROM texts
    ), known AS (
        SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id
    ), judged AS (
        SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
               CASE WHEN len(words) < 100 THEN 'A' ELSE '' END
               || CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 'B' ELSE '' END
               || CASE WHEN 100 * length(regexp_replace(body, '[^A-Z]', '', 'g')) > 10 * length(body) THEN 'C' ELSE '' END
               || CASE WHEN regexp_matches(body, '[#$%&*|]') THEN 'D' ELSE '' END
               || CASE WHEN doc_id > first_id THEN 'E' ELSE '' END AS failed
        FROM words LEFT JOIN known USING (doc_id)
    ), kinds AS (
        SELECT part, failed, count(*) AS n, count(*) FILTER (good) AS n_good, count(*) FILTER (toxic) AS n_toxic FROM judged GROUP BY part, failed
    ), letters(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
    orders AS (
        SELECT a.x || b.x || c.x || d.x || e.x AS filter_order
        FROM letters a, letters b, letters c, letters d, letters e
        WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
    ), steps AS (
        SELECT filter_order, step, filter_order[step] AS own, filter_order[1 : step - 1] AS earlier
        FROM orders, (SELECT unnest(range(1, 6)) AS step)
    ), applied AS (
        SELECT part, filter_order, step, own, n, n_good, n_toxic, failed,
               contains(failed, own) AS fails, length(translate(failed, earlier, '')) < length(failed) AS gone
        FROM kinds, steps
    ), summed AS (
        SELECT part, filter_order, step, own,
               coalesce(sum(n) FILTER (NOT gone AND NOT fails), 0) AS kept, coalesce(sum(n) FILTER (NOT gone AND fails), 0) AS removed,
               coalesce(sum(n) FILTER (gone AND fails), 0) AS redundant, coalesce(sum(n) FILTER (failed = own), 0) AS unique_fails,
               coalesce(sum(n_good) FILTER (NOT gone AND fails), 0) AS good_lost, coalesce(sum(n_toxic) FILTER (NOT gone AND fails), 0) AS toxic_lost
        FROM applied GROUP BY ALL
    )
    SELECT part, filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
           unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
           (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
    FROM summed"""
