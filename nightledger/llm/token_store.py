"""Token ids as directly addressable codes: random access to any token without decoding a block.

A segment splits every id into chunks of CHUNK_BITS.  Level k holds chunk k of the ids that have one, a bitmap that says
which of them go on at level k + 1, and a rank directory (ones before each RANK_BITS-bit block), so the place of an id's
next chunk is a rank query.  Bytes of a segment, little-endian:
    magic, level count (u32), then per level: length (u64), chunks (u8), bitmap, directory (u32).
"""

from __future__ import annotations

import os
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import given_back, written

MAGIC = b"DAC1"
CHUNK_BITS, RANK_BITS = 8, 512
#: A segment is closed once it holds this many tokens; a longer document makes one longer segment.
SEGMENT_TOKENS = 1_000_000
#: Words a worker remembers the ids of; then it forgets them all and begins anew.
CACHED_WORDS = 600_000
#: Documents that are tokenised at a time.
AT_A_TIME = 1000
DOC_NUMBERS = "doc_ids array<bigint>, lengths array<bigint>"


def encode(ids: np.ndarray) -> bytes:
    rest, levels = np.asarray(ids, np.uint32), []
    while True:
        more = rest >> CHUNK_BITS
        goes_on = more > 0
        bitmap = np.packbits(goes_on, bitorder="little")
        bitmap = np.pad(bitmap, (0, -len(bitmap) % (RANK_BITS // 8)))
        ones = np.bitwise_count(bitmap.view(np.uint64)).reshape(-1, RANK_BITS // 64).sum(1)
        directory = (np.cumsum(ones) - ones).astype("<u4")
        chunks = (rest & ((1 << CHUNK_BITS) - 1)).astype(np.uint8)
        levels.append(np.uint64(len(rest)).astype("<u8").tobytes() + chunks.tobytes() + bitmap.tobytes() + directory.tobytes())
        rest = more[goes_on]
        if not len(rest):
            return MAGIC + np.uint32(len(levels)).astype("<u4").tobytes() + b"".join(levels)


class Segment:
    """Views into the bytes of a segment."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a segment")
        at, self.levels = 8, []
        for _ in range(int(np.frombuffer(data, "<u4", 1, 4)[0])):
            n = int(np.frombuffer(data, "<u8", 1, at)[0])
            blocks = -(-n // RANK_BITS)
            chunks = np.frombuffer(data, np.uint8, n, at + 8)
            bitmap = np.frombuffer(data, np.uint8, blocks * RANK_BITS // 8, at + 8 + n)
            directory = np.frombuffer(data, "<u4", blocks, at + 8 + n + len(bitmap))
            self.levels.append((chunks, bitmap, directory))
            at += 8 + n + len(bitmap) + 4 * blocks

    def __len__(self) -> int:
        return len(self.levels[0][0])

    def __getitem__(self, i: int) -> int:
        """Token i, from one chunk and one rank query a level."""
        value, shift = 0, 0
        for chunks, bitmap, directory in self.levels:
            value |= int(chunks[i]) << shift
            shift += CHUNK_BITS
            if not bitmap[i >> 3] >> (i & 7) & 1:
                return value
            block = i // RANK_BITS
            start, end = block * RANK_BITS // 8, i >> 3
            inside = int(np.bitwise_count(bitmap[start:end]).sum()) + (int(bitmap[end]) & ((1 << (i & 7)) - 1)).bit_count()
            i = int(directory[block]) + inside
        raise ValueError("the last level goes on")

    def decode(self) -> np.ndarray:
        out = self.levels[0][0].astype("<u4")
        place, shift = np.arange(len(out)), 0
        for (_, bitmap, _), (chunks, _, _) in zip(self.levels, self.levels[1:]):
            shift += CHUNK_BITS
            place = place[np.unpackbits(bitmap, count=len(place), bitorder="little").astype(bool)]
            out[place] |= chunks.astype("<u4") << np.uint32(shift)
        return out


#: Texts whose ids differ between words and wholes unless case, white space and word ends are treated as WordEncoder needs.
PROBES = [
    "", " ", "The quick brown fox jumps over the lazy dog.", "THE Quick bROWN, fox. Jumps", "two  spaces\tand\na line\n\n\nend ", " leading and trailing ",
    "résumé NAÏVE Ünder straße ÀÉÎ", "don't stop-gap a.b.c 3.14 1,000 (x) [y] <z> #1 $5 50% a@b.co http://c.d/e?f=g", "a . b , c .d ,e", "日本語 текст ελληνικά İstanbul ǅ ﬁ",
    "word<|endoftext|>word", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa zzzzqqqqxxxx", "newline.\nNext, line", "tab\there", "nbsp\u00a0here", "e\u0301 combining",
]
#: Texts handed over at a time where texts are encoded whole.
WHOLE_TEXTS = 256


class WordEncoder:
    """Ids of texts, with the ids of their words remembered.

    Where the tokenizer lower-cases, drops white space and marks word ends, a text's ids are those of its words in turn.  New
    words of letters are encoded many at a time: such a word is one pre-token, whose last id is a word end.  Whether a file is
    of that kind is tried at load on PROBES; the texts of other files are encoded whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for word, i in vocabulary.items() if word.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {"": b""}
        self.remembered = CACHED_WORDS
        # Lower-case Latin letters that normalisation leaves alone.
        self.plain = re.compile("[a-zß-öø-ÿ]{1,200}").fullmatch
        probes = pa.array(PROBES)
        self.by_words = bool(self.ends.any()) and all(np.array_equal(a, b) for a, b in zip(self.encode_words(probes), self.encode_whole(probes)))

    def learn(self, words: list[str]) -> None:
        known, plain = self.known, self.plain
        letters, marked, other = [], [], []
        for word in words:
            base = word.lower()
            if plain(base):
                letters.append(base)
                if base != word:
                    marked.append((word, base, ""))
            elif base[-1] in ".," and plain(base[:-1]):
                letters.append(base[:-1])
                marked.append((word, base[:-1], base[-1]))
            else:
                other.append(word)
        if "." not in known:
            self.one_by_one([".", ","])
        letters = [x for x in dict.fromkeys(letters) if x not in known]
        for i in range(0, len(letters), 400):
            some = letters[i : i + 400]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            stops = (np.flatnonzero(self.ends[ids]) + 1).tolist()
            if len(stops) != len(some):
                self.one_by_one(some)
                continue
            flat = ids.tobytes()
            for word, start, stop in zip(some, [0, *stops], stops):
                known[word] = flat[4 * start : 4 * stop]
        self.one_by_one(other)
        for word, body, tail in marked:
            known[word] = known[body] + known[tail]

    def one_by_one(self, words: list[str]) -> None:
        for word, found in zip(words, self.tokenizer.encode_batch_fast(words, add_special_tokens=False)):
            self.known[word] = np.array(found.ids, "<u4").tobytes()

    def simpler(self, texts: pa.Array) -> pa.Array:
        """Texts with fewer different words and the same ids: lower case, full stops and commas apart from the words before.

        Texts are left alone that hold letters with another lower case elsewhere, marks that a stop would be parted from, or
        what could be a special token.
        """
        lower = pc.replace_substring(pc.replace_substring(pc.utf8_lower(texts), ". ", " . "), ", ", " , ")
        return pc.if_else(pc.match_substring_regex(texts, r"[^\x00-\x7FÀ-ÿ]|<\||[^\p{L}\p{N}][.,] "), texts, lower)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Little-endian unsigned 32-bit ids of all texts, end to end, and how many each text has."""
        return self.encode_words(texts) if self.by_words else self.encode_whole(texts)

    def encode_whole(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Some texts at a time, so that the library's own results stay few."""
        parts, sizes = [np.zeros(0, "<u4")], []
        for at in range(0, len(texts), WHOLE_TEXTS):
            for found in self.tokenizer.encode_batch_fast(texts[at : at + WHOLE_TEXTS].to_pylist(), add_special_tokens=False):
                parts.append(np.array(found.ids, "<u4"))
                sizes.append(len(parts[-1]))
        return np.concatenate(parts), np.array(sizes, np.int64)

    def encode_words(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if len(self.known) > self.remembered:
            self.known = {"": b""}
        lists = pc.split_pattern(self.simpler(pc.replace_substring(texts, "\n", " ")), " ")
        coded = lists.flatten().dictionary_encode()
        words, known = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), self.known
        if new := [w for w in words if w not in known]:
            self.learn(new)
        ids = pa.array([known[w] for w in words], pa.large_binary()).take(coded.indices)
        places = np.frombuffer(ids.buffers()[1], "<i8", len(ids) + 1)
        stops = places[np.asarray(lists.offsets) - lists.offsets[0].as_py()] // 4
        flat = np.frombuffer(ids.buffers()[2], "<u4", int(stops[-1])) if stops[-1] else np.zeros(0, "<u4")
        return flat, np.diff(stops)


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One for each worker and tokenizer file."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


SEGMENTS = "part int, segment int, before bigint, n_tokens bigint, " + DOC_NUMBERS + ", codes binary"


def token_segments(docs: DataFrame, tokenizer: str, end_id: int, remembered: int = CACHED_WORDS) -> DataFrame:
    """Segments of the ids of `docs` (doc_id, text), in ascending doc_id order over parts, segments and places.

    The end id closes every document.  NULL doc_ids come first; rows that repeat a doc_id are ordered by text; NULL counts as
    an empty text, which has only the end id.  Other columns are ignored; an empty table has no segments.  A worker keeps
    the ids of `remembered` words.
    """
    end = np.array([end_id], "<u4").tobytes()

    def parts(batches):
        from pyspark import TaskContext

        part, number, before = TaskContext.get().partitionId(), 0, 0
        held, names, lengths, total = [], [], [], 0
        encoder(tokenizer).remembered = remembered

        def close():
            codes = encode(np.frombuffer(b"".join(held), "<u4"))
            columns = [[part], [number], [before], [total], [names], [lengths], [codes]]
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["part", "segment", "before", "n_tokens", "doc_ids", "lengths", "codes"])

        for batch in batches:
            for at in range(0, batch.num_rows, AT_A_TIME):
                some = batch.slice(at, AT_A_TIME)
                flat, counts = encoder(tokenizer).encode(some["text"])
                ids, stops = flat.tobytes(), np.cumsum(counts).tolist()
                for name, n, stop in zip(some["doc_id"].to_pylist(), counts.tolist(), stops):
                    held.append(ids[4 * (stop - n) : 4 * stop] + end)
                    names.append(name)
                    lengths.append(n + 1)
                    total += n + 1
                    if total >= SEGMENT_TOKENS:
                        yield close()
                        held, names, lengths, total, number, before = [], [], [], 0, number + 1, before + total
        if held:
            yield close()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return ordered.mapInArrow(lambda batches: given_back(parts(batches)), SEGMENTS)


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int, remembered: int = CACHED_WORDS) -> DataFrame:
    """Write the segments to the shared folder; the segments as read from there."""
    return written(token_segments(docs, tokenizer, end_id, remembered), "tokens")


def documents_of(segments: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and where the document lies (part, segment, place), decoded from the segments."""

    def decoded(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                lengths = np.array(batch["lengths"][i].as_py(), np.int64)
                ids = Segment(batch["codes"][i].as_py()).decode()
                stops = np.cumsum(lengths)
                flat = memoryview(ids.tobytes())
                crcs = [zlib.crc32(flat[4 * (s - n) : 4 * s]) for s, n in zip(stops.tolist(), lengths.tolist())]
                n = len(lengths)
                columns = [pa.array(batch["doc_ids"][i].as_py(), pa.int64()), pa.array(batch["_base"][i].as_py() + batch["before"][i].as_py() + stops - lengths), pa.array(lengths), pa.array(crcs, pa.int64())]
                columns += [pa.array(np.full(n, batch[c][i].as_py(), np.int32)) for c in ("part", "segment")] + [pa.array((stops - lengths).astype(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32", "part", "segment", "place"])

    # One row per part (a task of the writer): a list bounded by the number of tasks.
    whole = segments.groupBy("part").agg(F.sum("n_tokens").alias("_n"))
    whole = whole.select("part", (F.sum("_n").over(Window.orderBy("part")) - F.col("_n")).alias("_base"))
    return segments.join(F.broadcast(whole), "part").mapInArrow(decoded, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint, part int, segment int, place bigint")
