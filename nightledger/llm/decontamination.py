"""Benchmark decontamination by latent semantic retrieval.

Passages of the benchmark are TF-IDF vectors over hashed words, with document frequencies counted over all documents.  A
randomised SVD, whose products with the passage matrix run on Spark, gives the latent space.  Documents are read in
overlapping windows; a window whose latent vector is close to that of a passage is compared with it word by word: by
longest common subsequence, and for a looser likeness by whether the passage's answer is there too.

The leading vectors leave out passages of a large benchmark and short ones, so an inverted index of the passages' rarest
words finds windows too: a common subsequence misses so few words that it must have some of those, so none is left out.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Hashed vocabulary and rank: the broadcast table has TERMS * RANK floats at most.
TERM_BITS, RANK, EXTRA, ROUNDS, SEED = 16, 64, 10, 2, 3
TERMS = 1 << TERM_BITS
#: An item is cut into passages of this many words, of which the last may overlap the one before; shorter items count from MIN_WORDS on.
PASSAGE, MIN_WORDS = 64, 5
#: Windows are two blocks of words long and a block apart.
BLOCK = 16
#: Cosine in the latent space, and the passage's part that the window has, for a window to be compared.
MIN_COSINE, MIN_PART = 0.5, 0.2
#: Part of a passage's words in a common subsequence: alone, or with that part of its answer.
MIN_LCS, MIN_LCS_WITH_ANSWER, MIN_ANSWER = 0.8, 0.6, 0.8
#: A passage of fewer words is looked for in stretches of its own length and a quarter more, not in the whole window.
SHORT = 2 * BLOCK
#: Rare words that a window must have of a passage to be compared; more cost more look-ups and give fewer windows.
RARE_WORDS = 4
#: Places of the table that tells which words are looked up.
RARE_BITS = 22
#: Passages that are searched for in one pass over the documents; more take several passes.
PASSAGES_AT_A_TIME = 50_000
#: Words of documents that are searched at a time.
WORDS_AT_A_TIME = 60_000
_TO_SPACE = bytes.maketrans(bytes(range(128)), bytes(c if chr(c).isalnum() else 32 for c in range(128)))


def words(text: str | None) -> list[bytes]:
    """Lower-case words; ASCII punctuation parts them."""
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(_TO_SPACE).split()


def checksums(found: list[bytes]) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, found), np.uint32, len(found))


def terms(found: list[bytes]) -> np.ndarray:
    return checksums(found) & np.uint32(TERMS - 1)


def answer(text: str) -> list[bytes]:
    """Words of the last sentence of at least three words; the last five words if there is no other sentence."""
    sentences = [w for w in map(words, re.split(r"[.?!\n]+", text)) if len(w) >= 3]
    return sentences[-1] if len(sentences) > 1 else words(text)[-5:]


def common(a: list[bytes], b: list[bytes]) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    places: dict[bytes, int] = {}
    for i, w in enumerate(a):
        places[w] = places.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for w in b:
        hit = row & places.get(w, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def likeness(wanted: list[bytes], answer: list[bytes], part: list[bytes]):
    """(common part, whether the answer is there) of each stretch of part that has the passage: all of part, if that is not short."""
    if common(wanted, part) < MIN_LCS_WITH_ANSWER * len(wanted):
        return
    size = len(wanted) + len(wanted) // 4 if len(wanted) < SHORT else len(part)
    known = set(wanted)
    for at in range(max(1, len(part) - size + 1)):
        some = part[at : at + size]
        if len(some) < len(part) and (sum(map(known.__contains__, some)) < MIN_LCS_WITH_ANSWER * len(wanted) or at + size < len(part) and some[0] not in known):
            continue
        lcs = common(wanted, some) / len(wanted)
        if lcs < MIN_LCS_WITH_ANSWER:
            continue
        there = common(answer, some) >= MIN_ANSWER * len(answer)
        if lcs >= MIN_LCS or there:
            yield lcs, there


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Documents that have each term, and documents, over all of docs."""

    def run(batches):
        counts, n = np.zeros(TERMS, np.int64), 0
        for batch in batches:
            for text in batch["text"].to_pylist():
                counts[np.unique(terms(words(text)))] += 1
                n += 1
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(seen, -1)), pa.array(np.append(counts[seen], n))], ["term", "n"])

    table = docs.select("text").mapInArrow(run, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(TERMS + 1, np.int64)
    out[table["term"].to_numpy(np.int64)] = table["n"].to_numpy(np.int64)
    return out[:-1], int(out[-1])


def passages(benchmark: DataFrame) -> DataFrame:
    """item_id, part, words, answer of every passage of benchmark (item_id, text)."""

    def run(batches):
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for item, text in zip(batch["item_id"].to_pylist(), batch["text"].to_pylist()):
                all_ = words(text)
                for part, at in enumerate(range(0, len(all_), PASSAGE)):
                    some = all_[min(at, max(0, len(all_) - PASSAGE)) :][:PASSAGE]
                    if len(some) < MIN_WORDS:
                        continue
                    for column, value in zip(out, (item, part, some, answer(text) if len(all_) <= PASSAGE else some[-5:])):
                        column.append(value)
            types = [pa.int64(), pa.int32(), pa.list_(pa.binary()), pa.list_(pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], ["item_id", "part", "words", "answer"])

    rows = benchmark.where("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    return rows.mapInArrow(run, "item_id bigint, part int, words array<binary>, answer array<binary>")


def _vector(found: list[bytes], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    term, n = np.unique(terms(found), return_counts=True)
    value = n * idf[term]
    return term, value / max(1e-9, float(np.linalg.norm(value)))


def _power(rows: DataFrame, idf: np.ndarray, present: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """A'A basis, where A has a row for each passage and a column for each term present: partial sums by term, added up by Spark."""
    shared = rows.sparkSession.sparkContext.broadcast((idf, present, basis))
    width = basis.shape[1]

    def run(batches):
        idf, present, basis = shared.value
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for found in batch["words"].to_pylist():
                term, value = _vector(found, idf)
                term = np.searchsorted(present, term)
                row = value @ basis[term]
                for t, v in zip(term.tolist(), value.tolist()):
                    total[t] = total[t] + v * row if t in total else v * row
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([v.tolist() for v in total.values()], pa.list_(pa.float64()))], ["term", "v"])

    sums = rows.select("words").mapInArrow(run, "term bigint, v array<double>").groupBy("term").agg(*(F.sum(F.col("v")[i]).alias(f"v{i}") for i in range(width))).toPandas()
    shared.destroy()
    out = np.zeros(basis.shape)
    if len(sums):
        out[sums["term"].to_numpy(np.int64)] = sums.drop(columns="term").to_numpy(float)
    return out


def _terms_of(rows: DataFrame) -> np.ndarray:
    """The terms that passages have, in order."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(terms([w for found in batch["words"].to_pylist() for w in found])).astype(np.int64))], ["term"])

    return np.sort(rows.select("words").mapInArrow(run, "term bigint").distinct().toPandas()["term"].to_numpy(np.int64))


def latent_space(rows: DataFrame, idf: np.ndarray) -> np.ndarray:
    """TERMS x RANK: the leading right singular vectors of the passages' TF-IDF matrix, by randomised SVD."""
    present = _terms_of(rows)
    out = np.zeros((TERMS, RANK), np.float32)
    if len(present):
        basis = np.random.default_rng(SEED).normal(size=(len(present), RANK + EXTRA))
        for _ in range(ROUNDS):
            basis = np.linalg.qr(_power(rows, idf, present, basis))[0]
        _, turn = np.linalg.eigh(basis.T @ _power(rows, idf, present, basis))
        space = basis @ turn[:, ::-1][:, :RANK]
        out[present, : space.shape[1]] = space
    return out


@dataclass
class RareWords:
    """Passages by their rarest words: as many as a common subsequence can miss, and RARE_WORDS more of them."""

    keys: np.ndarray  # checksums of words, sorted
    starts: np.ndarray  # where each one's passages start in owners
    owners: np.ndarray
    enough: np.ndarray  # of each passage: how many of its rare words a match has
    sizes: np.ndarray  # and its words

    @classmethod
    def of(cls, passages: list[list[bytes]], idf: np.ndarray) -> RareWords:
        pairs, enough = [np.zeros((2, 0), np.int64)], []
        for p, some in enumerate(passages):
            least = int(np.ceil(MIN_LCS_WITH_ANSWER * len(some) - 1e-9))
            enough.append(min(RARE_WORDS, least))
            sums = checksums(some)
            rarest = np.argsort(-idf[sums & np.uint32(TERMS - 1)], kind="stable")[: len(some) - least + enough[-1]]
            keys = np.unique(sums[rarest]).astype(np.int64)
            pairs.append(np.stack([keys, np.full(len(keys), p)]))
        key, owner = np.concatenate(pairs, axis=1)
        order = np.argsort(key, kind="stable")
        keys, starts = np.unique(key[order], return_index=True)
        return cls(keys.astype(np.uint32), np.append(starts, len(key)), owner[order], np.array(enough, np.int64), np.array(list(map(len, passages)), np.int64))

    def find(self, sums: np.ndarray, text: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, ...]:
        """text, passage, first and last place of each run of enough rare words of a passage in a stretch of text."""
        if not hasattr(self, "_table"):
            self._table = np.zeros(1 << RARE_BITS, bool)
            self._table[self.keys & np.uint32((1 << RARE_BITS) - 1)] = True
        maybe = np.flatnonzero(self._table[sums & np.uint32((1 << RARE_BITS) - 1)])
        key = np.searchsorted(self.keys, sums[maybe])
        key[key == len(self.keys)] = 0
        hit = self.keys[key] == sums[maybe] if len(maybe) else np.zeros(0, bool)
        word, key = maybe[hit], key[hit]
        n = self.starts[key + 1] - self.starts[key]
        word, owner = np.repeat(word, n), self.owners[np.repeat(self.starts[key] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        order = np.lexsort((word, owner))
        word, owner = word[order], owner[order]
        last = np.arange(len(word)) + self.enough[owner] - 1
        first = np.flatnonzero(last < len(word))
        last = last[first]
        good = (owner[first] == owner[last]) & (text[word[first]] == text[word[last]]) & (word[last] - word[first] < 2 * BLOCK + 2 * self.sizes[owner[first]])
        first, last = first[good], last[good]
        return text[word[first]], owner[first], inside[word[first]], inside[word[last]]


@dataclass
class Index:
    """What a search needs of the passages: for each its item, words, answer and latent vector."""

    items: list[int]
    words: list[list[bytes]]
    answers: list[list[bytes]]
    vectors: np.ndarray  # n, RANK: of length 1
    lengths: np.ndarray  # their lengths before
    table: np.ndarray  # TERMS, RANK: what a word adds to a latent vector
    rare: RareWords

    def search(self, texts: list[str | None]):
        """(text number, item, cosine, common part, whether the answer is there) of each item found, the best of each pair."""
        all_ = [words(t) for t in texts]
        blocks = [-(-len(w) // BLOCK) for w in all_]
        first = np.cumsum([0, *blocks])
        checksum = checksums([w for found in all_ for w in found])
        term = checksum & np.uint32(TERMS - 1)
        sizes = np.fromiter(map(len, all_), np.int64, len(all_))
        inside = np.arange(len(term)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        runs = self.rare.find(checksum, np.repeat(np.arange(len(texts)), sizes), inside)
        block = np.repeat(first[:-1], sizes) + inside // BLOCK
        known = self.known[term]
        term, block = term[known], block[known]
        sums = np.zeros((first[-1] + 1, RANK), np.float32)
        if len(block):
            starts = np.flatnonzero(np.diff(block, prepend=-1))
            sums[block[starts]] = np.add.reduceat(self.table[term], starts)
        owner = np.repeat(np.arange(len(texts)), blocks)
        window = sums[:-1]
        goes_on = np.append(owner[1:] == owner[:-1], False) if len(owner) else np.zeros(0, bool)
        window = window + np.where(goes_on[:, None], sums[1:], 0)
        norm = np.maximum(np.sqrt(np.einsum("ij,ij->i", window, window)), 1e-9)
        # A window shorter than the least part of the shortest passage is close to none.
        long_enough = np.flatnonzero(norm >= MIN_PART * self.lengths.min())
        best: dict[tuple[int, int], tuple] = {}
        rare = set()
        for i, p, start, end in zip(*(x.tolist() for x in runs)):
            # The blocks whose windows, with the words around them, hold the run.
            size = len(self.words[p])
            windows = range(max(0, (end - 2 * BLOCK - size) // BLOCK + 1), min(blocks[i] - 1, (start + size) // BLOCK) + 1)
            rare.update((int(first[i]) + b, p) for b in windows)
        for w, p, alike in chain(self._near(window, norm, long_enough), ((w, p, float(window[w] @ self.vectors[p])) for w, p in rare)):
            i = int(owner[w])
            wanted, at = self.words[p], (int(w) - int(first[i])) * BLOCK
            part = all_[i][max(0, at - len(wanted)) : at + 2 * BLOCK + len(wanted)]
            # No subsequence is longer than the words that are there at all.
            if sum(map(set(part).__contains__, wanted)) < MIN_LCS_WITH_ANSWER * len(wanted):
                continue
            for lcs, there in likeness(wanted, self.answers[p], part):
                found = (lcs, float(alike / norm[w]), there)
                key = (i, self.items[p])
                best[key] = max(best.get(key, found), found)
        return [(i, item, cosine, lcs, there) for (i, item), (lcs, cosine, there) in best.items()]

    def _near(self, window: np.ndarray, norm: np.ndarray, candidates: np.ndarray):
        """(window, passage, product) of those close enough to be compared."""
        for at in range(0, len(candidates), 4096):
            some = candidates[at : at + 4096]
            alike = window[some] @ self.vectors.T
            rows, columns = np.nonzero(alike >= np.maximum(MIN_COSINE * norm[some][:, None], MIN_PART * self.lengths))
            yield from zip(some[rows].tolist(), columns.tolist(), alike[rows, columns].tolist())

    @property
    def known(self) -> np.ndarray:
        if not hasattr(self, "_known"):
            self._known = self.table.any(1)
        return self._known


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, cosine, lcs, answer of every item of benchmark (item_id, text) found in docs (doc_id, text).

    NULL texts have no words; items with fewer than MIN_WORDS words are not searched for.  Repeated rows of docs are
    reported once, with their best values.  Other columns are ignored; an empty table on either side gives no rows.
    """
    spark = docs.sparkSession
    frequencies, n = document_frequencies(docs)
    idf = np.log((n + 1) / (frequencies + 1)) + 1e-3
    rows = passages(benchmark)
    space = latent_space(rows, idf)
    table = (space * idf[:, None]).astype(np.float32)
    table[np.abs(table).max(1) < 1e-4] = 0
    size = rows.count()
    rounds = max(1, -(-size // PASSAGES_AT_A_TIME))
    found = None
    for i in range(rounds):
        # A hash part of the passages, PASSAGES_AT_A_TIME of them or so: bounded, and collected for the search.
        some = rows.where(F.pmod(F.xxhash64("item_id", "part"), F.lit(rounds)) == i).orderBy("item_id", "part").collect()
        vectors = np.array([v @ space[t] for t, v in (_vector(r["words"], idf) for r in some)], np.float32).reshape(-1, RANK)
        # Lengths as windows have them: not divided by the passage's own norm.
        scale = np.array([np.linalg.norm((lambda t, c: c * idf[t])(*np.unique(terms(r["words"]), return_counts=True))) for r in some])
        length = np.linalg.norm(vectors, axis=1)
        index = Index([r["item_id"] for r in some], [list(map(bytes, r["words"])) for r in some], [list(map(bytes, r["answer"])) for r in some], vectors / np.maximum(length, 1e-9)[:, None], (length * scale).astype(np.float32), table, RareWords.of([list(map(bytes, r["words"])) for r in some], idf))
        part = _searched(docs, spark.sparkContext.broadcast(index))
        found = part if found is None else found.unionByName(part)
    return found.groupBy("doc_id", "item_id").agg(F.max("cosine").alias("cosine"), F.max("lcs").alias("lcs"), F.max("answer").alias("answer"))


def _searched(docs: DataFrame, shared) -> DataFrame:
    def run(batches):
        index = shared.value
        for batch in batches:
            names, texts = batch["doc_id"].to_pylist(), batch["text"].to_pylist()
            at, hits = 0, []
            while at < len(texts) and index.items:
                end, size = at, 0
                while end < len(texts) and size < 6 * WORDS_AT_A_TIME:
                    size += len(texts[end] or "")
                    end += 1
                hits += [(names[at + i], *rest) for i, *rest in index.search(texts[at:end])]
                at = end
            columns = list(zip(*hits)) if hits else [[]] * 5
            types = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["doc_id", "item_id", "cosine", "lcs", "answer"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, item_id bigint, cosine double, lcs double, answer boolean")
