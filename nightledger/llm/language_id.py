"""Language identification: one interpolated Kneser-Ney character model per language.

Spark counts the character ORDER-grams of all texts that may be learned from, and keeps them all.  The lower orders of
Kneser-Ney need only the different ORDER-grams, so nothing else is counted.  The models lie in arrays sorted by hash, with
a directory of where each hash starts; a text gets the language with the lowest cross-entropy per character.

All that a gram's probability needs, of any order but the lowest, has the gram's last character but one in common.  So the
grams are dealt into slices by that character, each of bounded size, and texts are scored slice by slice, adding up.

Rejection is calibrated: a text is rejected if its cross-entropy exceeds what all but a small part of the texts of its
language have that were set apart and not learned from.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .quality_classifier import fold

ORDER = 4
#: Different grams times languages in a slice, unless a single character has more: 64 MB of probabilities.
SLICE_CELLS = 1 << 24
DISCOUNT = 0.75
#: One of so many texts that may be learned from is set apart for the thresholds, and the part of a language's texts that
#: may be rejected: fewer than 1 / REJECTED_SHARE - 1 texts set apart cannot tell where that part begins, and reject nothing.
SET_APART, REJECTED_SHARE = 20, 0.005
#: A text's evidence counts for this many characters at most when its score is worked out.
EVIDENCE = 40
UNDETERMINED = "und"
#: Characters that are looked up at a time.
AT_A_TIME = 1 << 20
_MIX = np.uint64(0x9E3779B97F4A7C15)
_SPACE = 32
_letters = np.zeros(0, bool)


def letters() -> np.ndarray:
    """Whether a code point is a letter; built once in a worker."""
    global _letters
    if not len(_letters):
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _letters


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The ORDER-grams of the texts, 16 bits a character, and the number of each text's.

    Lower case; anything but letters becomes one space; ORDER - 1 spaces stand before a text.
    """
    pad = " " * (ORDER - 1)
    lower = [pad + t.lower() for t in texts]
    codes = np.frombuffer("".join(lower).encode("utf-32-le", "surrogatepass"), "<u4")
    sizes = np.fromiter(map(len, lower), np.int64, len(lower))
    starts = np.cumsum(sizes) - sizes
    letter = letters()[codes]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    head = (starts[:, None] + np.arange(ORDER - 1)).ravel()
    keep[head] = True
    # A text's first space after the padding would follow a space; a letter before it is the last text's.
    first = starts + ORDER - 1
    first = first[first < starts + sizes]
    keep[first] = letter[first]
    codes = np.where(letter, (codes ^ (codes >> 16)) & 0xFFFF, _SPACE).astype(np.uint64)
    ends = np.cumsum(keep)[starts + sizes - 1]
    codes = codes[keep]
    found = codes.copy()
    for back in range(1, ORDER):
        found[back:] |= codes[:-back] << np.uint64(16 * back)
    counts = np.diff(ends, prepend=0) - (ORDER - 1)
    real = np.ones(len(codes), bool)
    real[(np.concatenate(([0], ends[:-1]))[:, None] + np.arange(ORDER - 1)).ravel()] = False
    return found[real], counts


def counted(docs: DataFrame) -> DataFrame:
    """(lang, gram, n): ORDER-grams of the rows of docs (text, lang), summed over all of them."""

    def run(batches):
        for batch in batches:
            by_lang: dict[str, list[str]] = {}
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist()):
                by_lang.setdefault(lang, []).append(text)
            for lang, texts in by_lang.items():
                for some in _portions(texts):
                    found, n = np.unique(grams(some)[0], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(found.view(np.int64)), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])

    rows = docs.where("text is not null and lang is not null").select("lang", "text").mapInArrow(run, "lang string, gram bigint, n bigint")
    return rows.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _portions(texts: list[str]):
    part, size = [], 0
    for text in texts:
        part.append(text)
        size += len(text)
        if size >= AT_A_TIME:
            yield part
            part, size = [], 0
    if part:
        yield part


class HashArray:
    """Rows of numbers under 64-bit keys, in order of the keys' hashes."""

    def __init__(self, keys: np.ndarray, rows: np.ndarray):
        self.bits = max(8, int(len(keys)).bit_length() + 1)
        hashes = self.hash(keys)
        order = np.argsort(hashes, kind="stable")
        self.keys, self.rows = keys[order], rows[order]
        self.starts = np.searchsorted(hashes[order], np.arange((1 << self.bits) + 1))
        self.longest = int(np.diff(self.starts).max(initial=0))

    def hash(self, keys: np.ndarray) -> np.ndarray:
        return (keys * _MIX) >> np.uint64(64 - self.bits)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, -1 where there is none."""
        hashes = self.hash(keys)
        at, end = self.starts[hashes], self.starts[hashes + np.uint64(1)]
        found = np.full(len(keys), -1)
        for _ in range(self.longest):
            open_ = np.flatnonzero(at < end)
            if not len(open_):
                break
            hit = self.keys[at[open_]] == keys[open_]
            found[open_[hit]] = at[open_[hit]]
            at[open_] += 1
            at[open_[hit]] = end[open_[hit]]
        return found


@dataclass
class Models:
    langs: list[str]
    grams: list[HashArray]  # by order, from ORDER down to 1: log2 of the interpolated probability, a column a language
    contexts: list[HashArray]  # by order, from ORDER down to 2: log2 of the weight given to the lower order
    unseen: float  # log2 of a character's probability where no model has it

    def log_probabilities(self, found: np.ndarray) -> np.ndarray:
        """(n, languages): log2 of each gram's last character given the ones before."""
        out = np.zeros((len(found), len(self.langs)), np.float32)
        rest = np.arange(len(found))
        for depth, table in enumerate(self.grams):
            keys = found[rest] & np.uint64((1 << 16 * (ORDER - depth)) - 1)
            row = table.find(keys)
            hit = row >= 0
            out[rest[hit]] += table.rows[row[hit]]
            rest, keys = rest[~hit], keys[~hit]
            if not len(rest):
                return out
            if depth < len(self.contexts):
                row = self.contexts[depth].find(keys >> np.uint64(16))
                out[rest[row >= 0]] += self.contexts[depth].rows[row[row >= 0]]
        out[rest] += self.unseen
        return out


def build(counts: dict[str, tuple[np.ndarray, np.ndarray]], characters: dict[str, tuple[np.ndarray, np.ndarray]] | None = None) -> Models:
    """Models from each language's grams and their counts: all of them, or a slice.

    `characters` has each language's characters and how many different ones stand before them, which a slice cannot tell.
    """
    nothing = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    langs = sorted(characters or counts)
    tables, vocabulary = {}, 1
    for lang in langs:
        keys, n = counts.get(lang, nothing)
        orders = [(keys, n.astype(float))]
        for order in range(ORDER - 1, 0, -1):  # how many different characters stand before
            keys, n = np.unique(orders[-1][0] & np.uint64((1 << 16 * order) - 1), return_counts=True)
            orders.append((keys, n.astype(float)))
        if characters:
            orders[-1] = characters[lang][0], characters[lang][1].astype(float)
        vocabulary = max(vocabulary, len(orders[-1][0]))
        tables[lang] = orders
    unseen = 1 / (2 * vocabulary)
    union = [np.unique(np.concatenate([tables[x][d][0] for x in langs])) for d in range(ORDER)]
    heads = [np.unique(u >> np.uint64(16)) for u in union[:-1]]
    probability = [np.zeros((len(u), len(langs))) for u in union]
    backoff = [np.ones((len(h), len(langs))) for h in heads]
    for column, lang in enumerate(langs):
        for d in range(ORDER - 1, -1, -1):
            keys, n = tables[lang][d]
            context, own = np.unique(keys >> np.uint64(16), return_inverse=True)
            total, kinds = np.bincount(own, n), np.bincount(own)
            weight, seen = DISCOUNT * kinds / total, np.maximum(n - DISCOUNT, 0) / total[own]
            at = np.searchsorted(union[d], keys)
            if d == ORDER - 1:
                probability[d][:, column] = weight[0] * unseen
                probability[d][at, column] += seen
                continue
            backoff[d][np.searchsorted(heads[d], context), column] = weight
            lower = probability[d + 1][np.searchsorted(union[d + 1], union[d] & np.uint64((1 << 16 * (ORDER - d - 1)) - 1)), column]
            probability[d][:, column] = lower * backoff[d][np.searchsorted(heads[d], union[d] >> np.uint64(16)), column]
            probability[d][at, column] += seen
    return Models(langs, [HashArray(u, np.log2(p).astype(np.float32)) for u, p in zip(union, probability)], [HashArray(h, np.log2(b).astype(np.float32)) for h, b in zip(heads, backoff)], float(np.log2(unseen)))


def _columns(table, key: str) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    return {lang: (g[key].to_numpy(np.int64).view(np.uint64), g["n"].to_numpy(np.int64)) for lang, g in table.groupby("lang")}


@dataclass
class Learned:
    """The grams of all languages in the shared folder, the slice of every last character but one, and the characters."""

    grams: DataFrame
    slice_of: np.ndarray
    characters: dict[str, tuple[np.ndarray, np.ndarray]]

    @property
    def slices(self) -> int:
        return int(self.slice_of.max()) + 1

    def models(self, number: int) -> Models:
        """Models of one slice, whose size SLICE_CELLS bounds."""
        rows = self.grams
        if self.slices > 1:
            mine = [(int(c),) for c in np.flatnonzero(self.slice_of == number)]
            rows = rows.join(F.broadcast(rows.sparkSession.createDataFrame(mine, "_at int")), _before_last("gram") == F.col("_at"), "left_semi")
        return build(_columns(rows.toPandas(), "gram"), self.characters)


def _before_last(gram: str):
    return F.shiftrightunsigned(gram, 16).bitwiseAND(F.lit(0xFFFF)).cast("int")


def learn(docs: DataFrame) -> Learned | None:
    """What there is to learn from docs (text, lang); None for nothing."""
    table = written(counted(docs).where("gram is not null"), "grams")
    last = F.col("gram").bitwiseAND(F.lit(0xFFFF))
    characters = table.select("lang", _before_last("gram").alias("before"), last.alias("last")).distinct().groupBy("lang", "last").agg(F.count(F.lit(1)).alias("n")).toPandas()
    if not len(characters):
        return None
    characters = _columns(characters.sort_values(["lang", "last"]), "last")
    # One row for each of 65 536 characters at most.
    sizes = table.select("gram").distinct().groupBy(_before_last("gram").alias("at")).agg(F.count(F.lit(1)).alias("n")).toPandas().sort_values("at")
    slice_of, number, filled = np.zeros(1 << 16, np.int32), 0, 0
    for at, n in zip(sizes["at"], sizes["n"] * len(characters)):
        if filled and filled + n > SLICE_CELLS:
            number, filled = number + 1, 0
        slice_of[at], filled = number, filled + n
    return Learned(table, slice_of, characters)


def _added(rows: DataFrame, learned: Learned, number: int) -> DataFrame:
    """rows (doc_id, text, n, bits) with what the grams of one slice add: their number, and bits in every language.  The last slice drops the texts."""
    last = number == learned.slices - 1
    shared = rows.sparkSession.sparkContext.broadcast((learned.models(number), learned.slice_of if learned.slices > 1 else None))

    def run(batches):
        models, slice_of = shared.value
        for batch in batches:
            texts = [t or "" for t in batch["text"].to_pylist()]
            added, kinds = np.zeros((batch.num_rows, len(models.langs))), np.zeros(batch.num_rows, np.int64)
            at = 0
            for some in _portions(texts):
                found, counts = grams(some)
                owner = np.repeat(np.arange(len(some)), counts)
                if slice_of is not None:
                    mine = slice_of[(found >> np.uint64(16)) & np.uint64(0xFFFF)] == number
                    found, owner = found[mine], owner[mine]
                logs = models.log_probabilities(found)
                stops = np.searchsorted(owner, np.arange(len(some) + 1))
                for i, (start, stop) in enumerate(zip(stops.tolist(), stops[1:].tolist())):
                    if stop > start:
                        added[at + i] = -logs[start:stop].sum(0, dtype=np.float64)
                        kinds[at + i] = stop - start
                at += len(some)
            before = np.array(batch["bits"].to_pylist(), float).reshape(batch.num_rows, -1)
            bits = (added + before if before.shape[1] else added).tolist()
            n = kinds + np.asarray(batch["n"])
            own = [] if last else [batch["text"]]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *own, pa.array(n, pa.int64()), pa.array(bits, pa.list_(pa.float64()))], ["doc_id", *["text"][: len(own)], "n", "bits"])

    return rows.mapInArrow(run, "doc_id bigint, " + ("" if last else "text string, ") + "n bigint, bits array<double>")


def scored(docs: DataFrame, learned: Learned | None) -> DataFrame:
    """doc_id, lang_pred, score, cross_entropy (bits a character) for every row of docs (doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.lit(0).cast("long").alias("n"), F.array().cast("array<double>").alias("bits"))
    for number in range(learned.slices if learned else 0):
        if number:
            rows = written(rows, "slices")  # one slice at a time in a worker's memory
        rows = _added(rows, learned, number)
    langs = sorted(learned.characters) if learned else []

    def run(batches):
        for batch in batches:
            names, score, entropy = np.full(batch.num_rows, UNDETERMINED, object), np.zeros(batch.num_rows), np.full(batch.num_rows, np.nan)
            for i, (n, bits) in enumerate(zip(batch["n"].to_pylist(), batch["bits"].to_pylist())):
                if n:
                    each = np.array(bits) / n
                    best = int(np.argmin(each))
                    names[i], entropy[i] = langs[best], each[best]
                    score[i] = 1 / np.exp2(-np.minimum(60, (each - each[best]) * min(n, EVIDENCE))).sum()
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(names.tolist(), pa.string()), pa.array(score), pa.array(entropy)], ["doc_id", "lang_pred", "score", "cross_entropy"])

    return rows.select("doc_id", "n", "bits").mapInArrow(run, "doc_id bigint, lang_pred string, score double, cross_entropy double")


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, cross_entropy, rejected for every row of docs (doc_id, text, lang).

    Learns from rows with a language whose doc_id is not in the held-out fold, nor in the part of the others that is set
    apart for the thresholds; a language with too few texts set apart rejects nothing.  A text without letters, NULL or empty, is
    `und` with score 0 and not rejected, and so is every text if there is nothing to learn from.  Repeated rows are
    judged alike; equal cross-entropies go to the first language in order.  Other columns are ignored.
    """
    held_out = fold(F.col("doc_id"), 3) == 1
    apart = F.coalesce(F.pmod(F.xxhash64("doc_id"), F.lit(SET_APART)) == 0, F.lit(False))
    rows = written(scored(docs, learn(docs.where(~held_out & ~apart))).withColumn("held_out", held_out), "languages")
    limits = rows.where(~F.col("held_out") & apart & ~F.isnan("cross_entropy")).groupBy("lang_pred").agg(F.percentile_approx("cross_entropy", 1 - REJECTED_SHARE, 10000).alias("_limit"), F.count(F.lit(1)).alias("_n"))
    limits = limits.where((F.col("_n") + 1) * REJECTED_SHARE >= 1).drop("_n")
    rejected = F.coalesce(F.col("cross_entropy") > F.col("_limit"), F.lit(False)) & ~F.isnan("cross_entropy")
    # One row a language: bounded by the number of languages.
    return rows.join(F.broadcast(limits), "lang_pred", "left").select("doc_id", "held_out", "lang_pred", "score", F.nanvl("cross_entropy", F.lit(None)).alias("cross_entropy"), rejected.alias("rejected"))
