"""Exact medians and percentiles that do not depend on the size of a group.

Spark's `percentile` keeps every distinct value of a group in one buffer.
That is the fastest exact way for groups of bounded size and is used there.
Beyond the bound:

* one global group: the range holding the wanted rank is cut into bins again
  and again; each round is a scan with map-side combined counts, and only the
  bounded bin counts come back (`global_quantiles`);
* many groups: values are counted, coarse bins locate the bin of the wanted
  rank, and only that bin's values are ranked (`grouped_quantiles`).

Both return the linearly interpolated quantile of all values.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nightledger.config import DEFAULTS

_BINS = 4096


def interpolate(lo: float, hi: float, position: float) -> float:
    """Between the elements below and above a position, in the very terms of
    Spark's `percentile`: equal data give equal bits either way."""
    below = math.floor(position)
    return lo if below == position or lo == hi else (below + 1 - position) * lo + (position - below) * hi


def global_quantiles(
    df: DataFrame,
    wanted: dict[str, tuple[Column, float]],
    bound: int = DEFAULTS.exact_group_rows,
    rows: int | None = None,
) -> dict[str, float | None]:
    """Exact quantiles over the whole table: {name: (column, q in 0..1)}.

    NULL and NaN are ignored; a name with no values gives None.  All names
    share each pass over the data.  `rows` is the row count when known.
    """
    if not wanted:
        return {}
    names = list(wanted)
    values = {n: F.when(~F.isnan(c.cast("double")), c.cast("double")) for n, (c, _) in wanted.items()}
    narrow = df.select(*[values[n].alias(f"v{i}") for i, n in enumerate(names)])
    if (df.count() if rows is None else rows) <= bound:
        row = narrow.agg(
            *[F.percentile(f"v{i}", F.lit(float(wanted[n][1]))).alias(f"q{i}") for i, n in enumerate(names)]
        ).first()
        return {n: row[f"q{i}"] for i, n in enumerate(names)}
    ends = narrow.agg(
        *[F.count(f"v{i}").alias(f"n{i}") for i in range(len(names))],
        *[F.min(f"v{i}").alias(f"lo{i}") for i in range(len(names))],
        *[F.max(f"v{i}").alias(f"hi{i}") for i in range(len(names))],
    ).first()
    counts = [ends[f"n{i}"] for i in range(len(names))]

    # Ranks still to find: (column, rank) -> [lo, hi, rank inside the range].
    open_ranges: dict[tuple[int, int], list] = {}
    found: dict[tuple[int, int], float] = {}
    for i, n in enumerate(names):
        if counts[i] == 0:
            continue
        pos = (counts[i] - 1) * wanted[n][1]
        for rank in {math.floor(pos), min(math.floor(pos) + 1, counts[i] - 1)}:
            open_ranges[(i, rank)] = [ends[f"lo{i}"], ends[f"hi{i}"], rank]
    while open_ranges:
        for key, (lo, hi, _) in list(open_ranges.items()):
            if lo == hi:
                found[key] = lo
                del open_ranges[key]
        if not open_ranges:
            break
        for key, rng in _refine(narrow, open_ranges).items():
            open_ranges[key] = rng
    out: dict[str, float | None] = {}
    for i, n in enumerate(names):
        if counts[i] == 0:
            out[n] = None
            continue
        pos = (counts[i] - 1) * wanted[n][1]
        k = math.floor(pos)
        out[n] = interpolate(found[(i, k)], found[(i, min(k + 1, counts[i] - 1))], pos)
    return out


def _refine(narrow: DataFrame, open_ranges: dict[tuple[int, int], list]) -> dict[tuple[int, int], list]:
    """One scan: bin every open range, return the bin holding each rank."""
    ranges = sorted({(key[0], rng[0], rng[1]) for key, rng in open_ranges.items()})
    picks = []
    for t, (i, lo, hi) in enumerate(ranges):
        v = F.col(f"v{i}")
        # Halving first keeps hi - lo finite over the whole double range.
        share = (v / 2 - lo / 2) / F.lit(hi / 2 - lo / 2)
        bin_no = F.least(F.floor(share * _BINS), F.lit(_BINS - 1)).cast("int")
        picks.append(F.when(v.between(lo, hi), F.struct(F.lit(t).alias("t"), bin_no.alias("b"), v.alias("v"))))
    rows = (
        narrow.select(F.explode(F.array_compact(F.array(*picks))).alias("p"))
        .groupBy("p.t", "p.b")
        .agg(F.count(F.lit(1)).alias("n"), F.min("p.v").alias("lo"), F.max("p.v").alias("hi"))
        .collect()  # at most bins x open ranges rows
    )
    bins: dict[int, list] = {}
    for r in rows:
        bins.setdefault(r["t"], []).append((r["lo"], r["hi"], r["n"]))
    where = {rng: sorted(bins.get(t, [])) for t, rng in enumerate(ranges)}
    out = {}
    for key, (lo, hi, rank) in open_ranges.items():
        seen = 0
        for b_lo, b_hi, n in where[(key[0], lo, hi)]:
            if rank < seen + n:
                out[key] = [b_lo, b_hi, rank - seen]
                break
            seen += n
    return out


def global_median_and_mad(df: DataFrame, cols: dict[str, Column], bound: int = DEFAULTS.exact_group_rows) -> dict[str, tuple[float | None, float | None]]:
    """Median and median absolute deviation of several columns."""
    rows = df.count()
    med = global_quantiles(df, {n: (c, 0.5) for n, c in cols.items()}, bound, rows)
    known = {n: c for n, c in cols.items() if med[n] is not None}
    mad = global_quantiles(df, {n: (F.abs(c - F.lit(med[n])), 0.5) for n, c in known.items()}, bound, rows)
    return {n: (med[n], mad.get(n)) for n in cols}


# -- grouped ---------------------------------------------------------------------


def _coarse(v: Column) -> Column:
    """Monotone bin of a double: 1024 bins per factor of two, either sign."""
    size = F.floor((F.log2(F.abs(v)) + 1100.0) * 1024.0).cast("long")
    return F.when(v > 0, size).when(v < 0, -size).otherwise(F.lit(0).cast("long"))


def grouped_medians(
    df: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str],
    bound: int = DEFAULTS.exact_group_rows,
    group_rows: str | None = None,
    largest: int | None = None,
) -> DataFrame:
    """Exact median of each column per group (keys may be NULL).

    Sizes are checked first: with every group within the bound one
    aggregation does it, otherwise only the groups beyond it go the other
    way.  `largest` is an upper bound on the group sizes when the caller has
    one, `group_rows` a column with the size of the row's group.
    """
    keys = list(keys)
    values = [F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).alias(c) for c in columns]
    if largest is None:
        sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
        largest = sizes.agg(F.max("n")).first()[0] or 0
    if largest <= bound:
        return df.select(*keys, *values).groupBy(*keys).agg(*[F.median(c).alias(c) for c in columns])
    if group_rows is None:
        big = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") > bound)
        big = big.select(*[F.col(k).alias(f"_b_{k}") for k in keys], F.lit(True).alias("_big"))
        same = F.lit(True)
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"_b_{k}"))
        marked = df.join(big, same, "left").withColumn("_big", F.coalesce(F.col("_big"), F.lit(False)))
    else:
        marked = df.withColumn("_big", F.col(group_rows) > bound)
    marked = marked.select(*keys, "_big", *values)
    small = marked.filter(~F.col("_big")).groupBy(*keys).agg(*[F.median(c).alias(c) for c in columns])
    return small.unionByName(_big_group_medians(marked.filter("_big"), keys, list(columns)))


def _big_group_medians(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Medians of groups of any size by counting values.

    The value counts shuffle on (group, value), so one huge group is spread
    over every task; running sums go over bins of a group and over the values
    of one bin, both of which stream in sorted order.
    """
    group = F.struct(*keys)
    long = df.select(
        group.alias("g"),
        F.explode(F.array(*[F.struct(F.lit(c).alias("m"), F.col(c).alias("v")) for c in columns])).alias("e"),
    ).select("g", "e.m", "e.v").filter(F.col("v").isNotNull())
    counted = long.groupBy("g", "m", "v").agg(F.count(F.lit(1)).alias("n")).withColumn("b", _coarse(F.col("v")))
    bins = counted.groupBy("g", "m", "b").agg(F.sum("n").alias("n"))
    run = Window.partitionBy("g", "m").orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("g", "m")
    bins = bins.withColumns({"upto": F.sum("n").over(run), "total": F.sum("n").over(whole)})
    bins = bins.select(
        "g", "m", "b", (F.col("upto") - F.col("n")).alias("before"), "upto",
        F.explode(F.array(F.floor((F.col("total") - 1) / 2), F.floor(F.col("total") / 2))).alias("rank"),
    ).filter((F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("upto")))
    target = bins.groupBy("g", "m", "b").agg(F.first("before").alias("before"), F.collect_set("rank").alias("ranks"))
    inside = Window.partitionBy("g", "m", "b").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    hit = counted.join(target, ["g", "m", "b"]).withColumn("upto", F.sum("n").over(inside) + F.col("before"))
    hit = hit.withColumn("taken", F.size(F.filter("ranks", lambda r: (r >= F.col("upto") - F.col("n")) & (r < F.col("upto")))))
    med = (
        hit.filter("taken > 0").groupBy("g", "m")
        .agg((F.min("v") * 0.5 + F.max("v") * 0.5).alias("q"))
    )
    wide = med.groupBy("g").agg(*[F.max(F.when(F.col("m") == c, F.col("q"))).alias(c) for c in columns])
    empty_too = df.select(group.alias("g")).distinct().join(wide, "g", "left")
    return empty_too.select(*[F.col(f"g.{k}").alias(k) for k in keys], *columns)
