"""Removal of long repeated byte strings with a logarithmic family of suffix arrays.

The arrays are sparse.  Among the GRAM-byte strings of any SPAN places the one with the smallest hash is an anchor, so two
equal strings of LENGTH bytes have their anchor at the same place, and only suffixes that start at an anchor are indexed.
A suffix is held as two fingerprints: of its core (the bytes that every string of this anchor has) and of the union of
all strings of this anchor.  A level is such an array in order of (core, union), equal suffixes summed up.

Documents arrive in batches.  A batch gets its array, which is merge-scanned against every level for cores they share,
and is merged with the levels of its own size, like the carry of a binary counter.  From the shared cores it follows:
* a union that occurs twice repeats all strings of its anchors;
* a core with several unions may repeat some strings: there the bytes themselves are compared, string by string.  Where
  a core has very many unions, the same two rules are first applied to ever smaller blocks of their strings.
All other strings occur once.
"""

from __future__ import annotations

import hashlib
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import attach, given_back, written
from .exact_dedup import bit_count, set_cells, tested

LENGTH = 400
GRAM, SPAN = 16, 256
#: Bytes from an anchor on that are part of every LENGTH-byte string with that anchor.
CORE = LENGTH - SPAN + 1
#: Batches that a table is taken in by.
BATCHES = 3
#: Up to this many different unions of a core are compared inside one task; those of more are counted by a shuffle.
IN_ONE_TASK = 2000
#: An anchor's strings by their distance from it, in blocks of so many strings; what one width leaves open goes on to the next.
WIDTHS = (64, 16, 4, 1)
_random = np.random.default_rng(4)
_BYTES = _random.integers(0, 1 << 63, 256, np.uint64)
_FACTORS = _random.integers(0, 1 << 63, 4, np.uint64) | np.uint64(1)


def anchors(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """lo, hi, at: the LENGTH-byte strings that start from lo to hi have their anchor at `at`."""
    n = len(data) - LENGTH + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 3
    h = _BYTES[np.frombuffer(data, np.uint8)]
    for step, factor in zip((1, 2, 4, 8), _FACTORS):
        h = h[:-step] * factor + h[step:]
    h = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    step = 1
    while step < SPAN:
        h = np.minimum(h[:-step], h[step:])
        step *= 2
    at = (h[:n] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    lo = np.flatnonzero(np.diff(at, prepend=-1))
    return lo, np.append(lo[1:], n) - 1, at[lo]


def _portions(batches, rows: int = 200):
    """Arrow batches in small portions: what Python holds of them at a time stays small, however long the texts."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def suffixes(rows: DataFrame) -> DataFrame:
    """(row, lo, hi, core, full) of every anchor of rows (row, text)."""

    def run(batches):
        digest = xxhash.xxh3_64_intdigest
        for batch in _portions(batches):
            row, los, his, cores, fulls = [], [], [], [], []
            for name, text in zip(batch["row"].to_pylist(), batch["text"].to_pylist()):
                data = _bytes(text)
                lo, hi, at = anchors(data)
                if not len(lo):
                    continue
                row.append(np.full(len(lo), name, np.int64))
                los.append(lo)
                his.append(hi)
                cores += [digest(data[a : a + CORE]) for a in at.tolist()]
                fulls += [digest(data[a : b + LENGTH]) for a, b in zip(lo.tolist(), hi.tolist())]
            if row:
                columns = [np.concatenate(row), np.concatenate(los).astype(np.int32), np.concatenate(his).astype(np.int32), np.array(cores, np.uint64).view(np.int64), np.array(fulls, np.uint64).view(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["row", "lo", "hi", "core", "full"])

    return rows.select("row", "text").mapInArrow(lambda batches: given_back(run(batches)), "row bigint, lo int, hi int, core bigint, full bigint")


def _level(entries: DataFrame) -> DataFrame:
    return entries.groupBy("core", "full").agg(F.sum("n").alias("n"))


class IndexFamily:
    """Levels of suffix arrays; level r holds 2 ** r batches."""

    def __init__(self) -> None:
        self.levels: dict[int, DataFrame] = {}
        self.shared: DataFrame | None = None

    def add(self, batch: DataFrame) -> None:
        """Take in the suffixes of a batch (core, full)."""
        array = written(_level(batch.select("core", "full", F.lit(1).cast("long").alias("n"))).sortWithinPartitions("core", "full"), "array")
        self._share(array.groupBy("core").agg(F.sum("n").alias("n")).where("n > 1"))
        for level in self.levels.values():
            self._share(array.join(level, "core", "left_semi"))
        rank, equal = 0, [array]
        while rank in self.levels:
            equal.append(self.levels.pop(rank))
            rank += 1
        if len(equal) > 1:
            everything = equal[0]
            for level in equal[1:]:
                everything = everything.unionByName(level)
            array = written(_level(everything).sortWithinPartitions("core", "full"), "array")
        self.levels[rank] = array

    def _share(self, found: DataFrame) -> None:
        cores = found.select("core").distinct()
        self.shared = cores if self.shared is None else self.shared.unionByName(cores)

    def repeated(self) -> DataFrame:
        """(core, full, n, kinds) of every suffix whose core occurs twice; kinds counts the core's unions."""
        everything = None
        for level in self.levels.values():
            everything = level if everything is None else everything.unionByName(level)
        entries = written(_level(everything.join(self.shared.distinct(), "core", "left_semi")), "entries")
        kinds = entries.groupBy("core").agg(F.count(F.lit(1)).alias("kinds"))
        return written(attach(entries, kinds, "core", "kinds", entries.count()), "repeated")


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _outcome(data: bytes, spans: list[tuple[int, int]]) -> tuple[int, int, int, str]:
    """n_bytes, n_removed, n_spans and the digest of what remains."""
    kept, at, removed = hashlib.sha256(), 0, 0
    for a, b in spans:
        kept.update(data[at:a])
        at, removed = b, removed + b - a
    kept.update(data[at:])
    return len(data), removed, len(spans), kept.hexdigest()


_SPAN = "array<struct<lo: int, hi: int>>"
_CHECK = "array<struct<lo: int, hi: int, core: bigint, kinds: bigint, twice: boolean>>"
_RESULT = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"


def _visit(batches):
    """Documents with their marks: those that need no comparison are finished, the others keep text, spans and checks."""
    for batch in _portions(batches):
        out: list[list] = [[] for _ in range(9)]
        columns = [batch[c].to_pylist() for c in ("row", "doc_id", "text", "marks")]
        for row, doc_id, text, marks in zip(*columns):
            data = _bytes(text)
            spans = _merged([(m["lo"], m["hi"] + LENGTH) for m in marks or () if m["twice"]])
            checks = [{k: v for k, v in m.items() if k != "check"} for m in marks or () if m["check"]]
            open_ = [m for m in checks if not m["twice"]]
            done = (len(data), 0, 0, None) if open_ else _outcome(data, spans)
            values = (row, doc_id, *done, data if checks else None, [{"lo": a, "hi": b} for a, b in spans] if checks else None, checks or None)
            for column, value in zip(out, values):
                column.append(value)
        span = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))
        check = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32()), ("core", pa.int64()), ("kinds", pa.int64()), ("twice", pa.bool_())]))
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), span, check]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], ["row", "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "data", "spans", "checks"])


def _snippets(batches):
    """(core, kinds, row, lo, twice, snippet) of every suffix to compare; of equal suffixes of a row, one."""
    for batch in _portions(batches):
        out: list[list] = [[] for _ in range(6)]
        for row, data, checks in zip(*(batch[c].to_pylist() for c in ("row", "data", "checks"))):
            seen = set()
            for m in checks:
                snippet = data[m["lo"] : m["hi"] + LENGTH]
                if m["twice"] and (m["core"], snippet) in seen:
                    continue
                if m["twice"]:
                    seen.add((m["core"], snippet))
                for column, value in zip(out, (m["core"], m["kinds"], row, m["lo"], m["twice"], snippet)):
                    column.append(value)
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], ["core", "kinds", "row", "lo", "twice", "snippet"])


def _strings(batch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every LENGTH-byte string of the batch's snippets: fingerprint, number of the snippet, start, and what it counts for."""
    digest, found, sizes = xxhash.xxh3_64_intdigest, [np.zeros(0, np.uint64)], []
    for snippet in batch["snippet"].to_pylist():
        n = len(snippet) - LENGTH + 1
        found.append(np.fromiter((digest(snippet[i : i + LENGTH]) for i in range(n)), np.uint64, n))
        sizes.append(n)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    inside = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes) if sizes else np.zeros(0, np.int64)
    start = np.asarray(batch["lo"]).astype(np.int64)[owner] + inside
    weight = 1 + np.asarray(batch["twice"]).astype(np.int64)[owner]
    return np.concatenate(found), owner, start, weight


_FOUND = pa.schema([("row", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32())])


def _spans_of(batch, owner: np.ndarray, start: np.ndarray, again: np.ndarray):
    """Runs of repeated strings, as byte spans of their rows; suffixes that occur twice are removed already."""
    again = again & ~np.asarray(batch["twice"]).astype(bool)[owner]
    rows = np.asarray(batch["row"])[owner][again]
    start = start[again]
    new = np.ones(len(rows), bool)
    new[1:] = (np.diff(rows) != 0) | (np.diff(start) != 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(rows)) - 1 if len(rows) else first
    return pa.RecordBatch.from_arrays([pa.array(rows[first]), pa.array(start[first].astype(np.int32)), pa.array((start[last] + LENGTH).astype(np.int32))], schema=_FOUND)


def _compare(batches):
    """Batches in order of core, row and lo: all of a core's snippets are compared at once, those of repeated rows once."""

    def compared(some):
        found, owner, start, weight = _strings(some)
        keys = np.rec.fromarrays([np.asarray(some["core"])[owner], found])
        _, which = np.unique(keys, return_inverse=True)
        return _spans_of(some, owner, start, np.bincount(which, weight, minlength=1)[which] > 1)

    held, last = None, None
    for part in _portions(batches, 500):
        keys = np.stack([np.asarray(part[c]).astype(np.int64) for c in ("core", "row", "lo")])
        new = np.ones(part.num_rows, bool)
        new[1:] = (np.diff(keys) != 0).any(axis=0)
        new[0] = last is None or (keys[:, 0] != last).any()
        last, part = keys[:, -1], part.filter(pa.array(new))
        if not part.num_rows:
            continue
        held = part if held is None else pa.Table.from_batches([held, part]).combine_chunks().to_batches()[0]
        cores = np.asarray(held["core"])
        cut = int(np.flatnonzero(cores != cores[-1])[-1]) + 1 if cores[0] != cores[-1] else 0
        if cut:
            yield compared(held.slice(0, cut))
            held = held.slice(cut)
    if held is not None and held.num_rows:
        yield compared(held)


def _blocks(width: int):
    """Every block of the suffixes to compare: what its strings share (part), what they cover together (full), which strings it has."""
    digest = xxhash.xxh3_64_intdigest
    signed = lambda values: np.array(values, np.uint64).view(np.int64)

    def cut(batch):
        for row, data, checks in zip(*(batch[c].to_pylist() for c in ("row", "data", "checks"))):
            for m in checks:
                at = m["lo"] + int(anchors(data[m["lo"] : m["hi"] + LENGTH])[2][0])
                for block in range((at - m["hi"]) // width, (at - m["lo"]) // width + 1):
                    last = at - block * width
                    first = last - width + 1
                    lo, hi = max(m["lo"], first), min(m["hi"], last)
                    yield m["core"], digest(data[last : first + LENGTH], block), digest(data[lo : hi + LENGTH]), row, lo, hi, m["twice"]

    def run(batches):
        for batch in _portions(batches):
            blocks = cut(batch)
            while some := list(islice(blocks, 10_000)):
                core, part, full, row, lo, hi, twice = zip(*some)
                columns = [pa.array(core, pa.int64()), pa.array(signed(part)), pa.array(signed(full)), pa.array(row, pa.int64()), pa.array(lo, pa.int32()), pa.array(hi, pa.int32()), pa.array(twice)]
                yield pa.RecordBatch.from_arrays(columns, ["core", "part", "full", "row", "lo", "hi", "twice"])

    return run


def _compared_by_shuffle(rows: DataFrame) -> DataFrame:
    """(row, lo, hi) of the repeated strings, by the rule of the index: blocks of a suffix's strings are counted, not the strings.

    A block whose full occurs twice repeats all its strings, one whose part has no other full repeats none.  The others are cut
    into the blocks of the next width, together with one block of each repeated full of their part.
    """
    found, total = None, rows.count()
    copies, checks = rows.groupBy("row").agg(F.count(F.lit(1)).alias("copies")), rows
    for width in WIDTHS:
        run = _blocks(width)
        blocks = checks.mapInArrow(lambda batches, run=run: given_back(run(batches)), "core bigint, part bigint, full bigint, row bigint, lo int, hi int, twice boolean")
        blocks = written(blocks.withColumn("key", F.xxhash64("core", "part", "full")), "blocks")
        # What occurs twice counts so in each of its blocks, though one of its rows alone is here.
        fulls = blocks.groupBy("core", "part", "full", "key").agg(F.sum(F.when(F.col("twice"), 2).otherwise(1)).alias("n"), F.count(F.lit(1)).alias("rows"), F.min(F.struct("row", "lo", "hi")).alias("first"))
        fulls = written(fulls.withColumn("part", F.xxhash64("core", "part")), "fulls")
        hit = attach(blocks.where("not twice").select("row", "lo", "hi", "key"), fulls.where("n > 1").select("key", "rows"), "key", "rows", blocks.count())
        hit = hit.select("row", "lo", (F.col("hi") + LENGTH).alias("hi"))
        found = hit if found is None else found.unionByName(hit)
        kinds = written(fulls.groupBy("part").agg(F.count(F.lit(1)).alias("kinds"), F.min("n").alias("least")).where("kinds > 1 and least = 1").select("part", "kinds"), "parts")
        if width == 1 or kinds.isEmpty():
            break
        left = attach(fulls, kinds, "part", "kinds", fulls.count()).select("first.*", "core", (F.col("n") > 1).alias("twice"))
        left = left.groupBy("row").agg(F.collect_list(F.struct("lo", "hi", "core", "twice")).alias("checks"))
        checks = attach(rows.select("row", "data"), left.join(copies, "row"), "row", "copies", total).select("row", "data", "checks")
    return found


def _finish(batches):
    for batch in _portions(batches):
        out: list[list] = [[] for _ in range(5)]
        for doc_id, data, spans, found in zip(*(batch[c].to_pylist() for c in ("doc_id", "data", "spans", "found"))):
            both = _merged([(s["lo"], s["hi"]) for s in [*spans, *(found or ())]])
            for column, value in zip(out, (doc_id, *_outcome(data, both))):
                column.append(value)
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _untouched(text: Column) -> list[Column]:
    return [F.octet_length(text).cast("long").alias("n_bytes"), *(F.lit(0).cast("long").alias(c) for c in ("n_removed", "n_spans")), F.sha2(text, 256).alias("kept_sha256")]


def remove_repeats(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, repeated (whether bytes were removed) for every row of docs (doc_id, text).

    Removes each byte that a LENGTH-byte string covers that also starts anywhere else in docs, the same row included.
    Texts are UTF-8 bytes; NULL is empty, and texts under LENGTH bytes stay whole.  Repeated rows repeat each other's
    strings.  Other columns are ignored; an empty table gives an empty result.
    """
    # A row is named by its doc_id and text: rows with the same name have the same outcome.
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("row", F.xxhash64("doc_id", "text"))
    index = written(suffixes(rows).withColumn("batch", F.pmod(F.xxhash64("row"), F.lit(batches)).cast("int")), "suffixes", "batch")
    family = IndexFamily()
    for i in range(batches):
        family.add(index.where(F.col("batch") == i))
    repeated = family.repeated()
    facts = repeated.select(F.col("core").alias("_core"), F.col("full").alias("_full"), "n", "kinds")
    hot = facts.where(F.col("n") > F.lit(max(1000, index.count() // 500)))
    same = lambda side: (index["core"] == side["_core"]) & (index["full"] == side["_full"])
    rest = index.join(F.broadcast(hot.select("_core", "_full")), same(hot), "left_anti")
    known = index.join(F.broadcast(hot), same(hot)).unionByName(rest.join(facts, (rest["core"] == facts["_core"]) & (rest["full"] == facts["_full"])))
    known = written(known.select("row", "lo", "hi", (F.col("n") > 1).alias("twice"), *(F.when(F.col("kinds") > 1, F.col(c)).alias(c) for c in ("core", "kinds", "full"))), "known")
    # A suffix that occurs twice is compared with the others of its core once, in the row with the smallest name.
    both = F.coalesce(F.col("twice") & (F.col("kinds") > 1), F.lit(False))
    first = known.where(both).groupBy("core", "full").agg(F.min("row").alias("row")).select("core", "full", "row", F.lit(True).alias("first"))
    known = known.where(~both).withColumn("first", F.lit(None).cast("boolean")).unionByName(known.where(both).join(first, ["core", "full", "row"], "left"))
    check = F.col("kinds").isNotNull() & (~F.col("twice") | F.col("first").isNotNull())
    marks = known.groupBy("row").agg(F.collect_set(F.struct("lo", "hi", "twice", check.alias("check"), F.when(check, F.col("core")).alias("core"), F.when(check, F.col("kinds")).alias("kinds"))).alias("marks"))
    # Rows that a Bloom filter of the marked ones leaves out pass straight through; only the others shuffle.
    cells = bit_count(rows.count())
    split = tested(rows, "row", cells, set_cells(known.select("row").distinct(), "row", cells, 1))
    alone = split.where(~F.col("maybe")).select("doc_id", *_untouched(F.col("text")))
    visited = written(split.where("maybe").join(marks, "row", "left").select("row", "doc_id", "text", "marks").mapInArrow(lambda batches: given_back(_visit(batches)), f"row bigint, {_RESULT}, data binary, spans {_SPAN}, checks {_CHECK}"), "visited")
    # Repeated rows have the same marks, and stay here: all their suffixes occur twice, and count so however often they come.
    few, many = (
        visited.select("row", "data", F.filter("checks", wanted).alias("checks")).where(F.size("checks") > 0)
        for wanted in (lambda m: m["kinds"] <= IN_ONE_TASK, lambda m: m["kinds"] > IN_ONE_TASK)
    )
    few = few.mapInArrow(lambda batches: given_back(_snippets(batches)), "core bigint, kinds bigint, row bigint, lo int, twice boolean, snippet binary")
    few = few.repartition("core").sortWithinPartitions("core", "row", "lo").mapInArrow(lambda batches: given_back(_compare(batches)), "row bigint, lo int, hi int")
    many = _compared_by_shuffle(many)
    found = few.unionByName(many).groupBy("row").agg(F.collect_list(F.struct("lo", "hi")).alias("found"))
    open_ = visited.where("kept_sha256 is null").join(found, "row", "left").select("doc_id", "data", "spans", "found").mapInArrow(lambda batches: given_back(_finish(batches)), _RESULT)
    done = visited.where("kept_sha256 is not null").select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    return alone.unionByName(done).unionByName(open_).withColumn("repeated", F.col("n_removed") > 0)
