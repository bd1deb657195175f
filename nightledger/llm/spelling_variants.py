"""Spelling variants: words one edit apart, found by the one-edit neighbourhoods of words in a reduced alphabet.

Letters are hashed to a few symbols, so a word's neighbourhood has tens of strings instead of thousands, and words one
edit apart have reduced forms at most one edit apart.  Every word sends out its reduced neighbourhood, every word answers
to its reduced form, and pairs that meet are verified on their letters.  An edit leaves one half of a word alone: both
sides put the untouched half's letters into the key, so that words meet that share a half and no class of reduced
forms, however common, is paired within itself.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

LETTERS = r"a-zA-ZÀ-ÿ"
#: Words whose neighbourhoods are built at a time.
AT_A_TIME = 4096
#: Words a task builds the neighbourhoods of, at most: some tens of rows each.
WORDS_A_TASK = 50_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def _prefixes(codes: np.ndarray) -> np.ndarray:
    """Column i: the polynomial hash of the first i codes of every row, modulo 2^64."""
    powers = np.cumprod(np.r_[np.uint64(1), np.full(codes.shape[1], _BASE)])[: codes.shape[1]]
    return np.concatenate([np.zeros((len(codes), 1), np.uint64), np.cumsum(codes * powers, axis=1, dtype=np.uint64)], axis=1)


class _Halves:
    """Hashes of the halves that a word of `length` letters shares with words one edit away: its first letters, or its last."""

    def __init__(self, letters: np.ndarray, length: int):
        n = letters.shape[1]
        self.cut = -(-length // 2)
        whole = _prefixes(letters)
        shift = np.uint64(pow(int(_INVERSE), n - (length - self.cut), 1 << 64))
        self.first = _mixed(whole[:, self.cut] + np.uint64(2 * length))
        self.last = _mixed((whole[:, n] - whole[:, n - (length - self.cut)]) * shift + np.uint64(2 * length + 1))

    def of(self, in_first: bool) -> np.ndarray:
        """The half that an edit in the first (or else the last) one leaves alone."""
        return self.last if in_first else self.first


def _key(reduced: np.ndarray, half: np.ndarray) -> np.ndarray:
    return _mixed(_mixed(reduced) + half)


def _symbols(letters: np.ndarray, symbols: int) -> np.ndarray:
    return letters % np.uint64(symbols) + np.uint64(1)


def answers(letters: np.ndarray, symbols: int) -> np.ndarray:
    """Two keys for every row of letters (code points of words of one length): its reduced form with either half."""
    n = letters.shape[1]
    reduced, halves = _prefixes(_symbols(letters, symbols))[:, n], _Halves(letters, n)
    return np.stack([_key(reduced, halves.of(x)) for x in (True, False)], axis=1)


def neighbourhoods(letters: np.ndarray, symbols: int) -> np.ndarray:
    """Keys of the full one-edit neighbourhood, and of the reduced form itself, of every row of letters."""
    n = letters.shape[1]
    reduced = _symbols(letters, symbols)
    whole = _prefixes(reduced)
    total = whole[:, n]
    same, less, more = (_Halves(letters, n + d) for d in (0, -1, 1))
    keys = [_key(total, same.of(x)) for x in (True, False)]
    power = np.uint64(1)
    for at in range(n + 1):
        tail = total - whole[:, at]
        for symbol in range(1, symbols + 1):
            code = np.uint64(symbol) * power
            keys.append(_key(whole[:, at] + code + tail * _BASE, more.of(at < more.cut)))
            if at < n:
                keys.append(_key(total + code - reduced[:, at] * power, same.of(at < same.cut)))
        if at < n:
            keys.append(_key(whole[:, at] + (total - whole[:, at + 1]) * _INVERSE, less.of(at < less.cut)))
        power = power * _BASE
    return np.stack(keys, axis=1)


def _keyed(words: DataFrame, make, symbols: int, names: list[str], schema: str) -> DataFrame:
    """key and the columns of `words` for each different key that `make` gives a word."""

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, AT_A_TIME):
                some = batch.slice(start, AT_A_TIME)
                texts = some[0].to_pylist()
                sizes = np.array([len(t) for t in texts])
                for size in np.unique(sizes).tolist():
                    rows = np.flatnonzero(sizes == size)
                    letters = np.array([texts[i] for i in rows.tolist()], f"<U{size}").view("<u4").reshape(len(rows), size).astype(np.uint64)
                    with np.errstate(over="ignore"):
                        keys = np.sort(make(letters, symbols), axis=1)
                    new = np.concatenate([np.ones((len(rows), 1), bool), keys[:, 1:] != keys[:, :-1]], axis=1)
                    chosen = pa.array(np.repeat(rows, new.sum(1)))
                    yield pa.RecordBatch.from_arrays([pa.array(keys[new].view(np.int64)), *(some[i].take(chosen) for i in range(len(names)))], ["key", *names])

    return words.mapInArrow(run, schema)


def symbols_for(words: int) -> int:
    """Symbols of the reduced alphabet: more for larger vocabularies, so that the pairs to verify stay few a word."""
    return max(3, round(3 * (words / 2_000_000) ** (2 / 7)))


def words_of(docs: DataFrame, min_length: int, one_in: int | None) -> DataFrame:
    """word: every run of letters of the texts, A-Z in lower case, of at least min_length code points.

    With `one_in`, a run whose crc32 with its doc_id (NULL: empty) one_in divides loses one letter before it is measured.
    """
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_doc"), F.explode(F.regexp_extract_all(lower, F.lit(f"[{LETTERS}]{{{min_length},}}"), F.lit(0))).alias("word"))
    if one_in:
        runs = runs.select("word", F.crc32(F.concat("_doc", F.lit(":"), "word")).alias("h"))
        at = F.pmod("h", F.length("word")).cast("int")
        shorter = F.concat(F.substring(F.col("word"), F.lit(1), at), F.substring(F.col("word"), at + 2, F.length("word")))
        runs = runs.select(F.when(F.col("h") % one_in == 0, shorter).otherwise(F.col("word")).alias("word"))
    return runs.where(F.length("word") >= min_length)


def near_words(words: DataFrame, total: int) -> DataFrame:
    """word, near, near_n, dealt by word: for `total` words, every ordered pair of different words one inserted, deleted or replaced code point apart."""
    spread = max(int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // WORDS_A_TASK))
    # Words in order stand next to those they share letters with, which keeps the shuffled rows small.
    ordered = words.select("word").repartitionByRange(spread, "word").sortWithinPartitions("word")
    symbols = symbols_for(total)
    sent = _keyed(ordered, neighbourhoods, symbols, ["word"], "key bigint, word string")
    there = _keyed(words.select("word", "n"), answers, symbols, ["near", "near_n"], "key bigint, near string, near_n bigint")
    met = sent.join(there, "key").where((F.col("word") != F.col("near")) & (F.levenshtein("word", "near", 1) == 1))
    # An edit inside a run of equal letters has several places, so that a pair may meet twice.  A word has few near ones.
    return met.select("word", "near", "near_n").repartition("word").dropDuplicates(["word", "near"])


def roots_of(forms: DataFrame) -> DataFrame:
    """word, root: the last form of every word with a form.  Counts grow along the way, so there are no circles; every round doubles the steps."""
    roots = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = roots.select(F.col("word").alias("_at"), F.col("root").alias("_to"))
        further = written(roots.join(onward, roots["root"] == onward["_at"], "left").select("word", F.coalesce("_to", "root").alias("root"), F.col("_to").isNotNull().alias("moved")), "roots")
        roots = further.drop("moved")
        if further.where("moved").isEmpty():
            return roots


def spelling_variants(docs: DataFrame, min_length: int = 7, min_count: int = 2, ratio: int = 10, one_in: int | None = None) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of `docs` (doc_id, text) that occurs at least min_count times.

    A word's form is its near word of largest n (ties: first in code-point order) if that is at least `ratio` times its own;
    its root is the last of its forms, or the word itself.  NULL texts have no words; repeated rows count each time.
    Other columns are ignored; an empty table gives an empty result.
    """
    counted = words_of(docs, min_length, one_in).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)
    words = written(counted, "words")
    near = near_words(words, words.count())
    best = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    much: Column = -F.col("best.less") >= F.col("n") * ratio
    found = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(much, F.col("best.near")).alias("form"), F.when(much, -F.col("best.less")).alias("form_n"))
    found = written(found, "forms")
    roots = roots_of(found.where("form is not null"))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
