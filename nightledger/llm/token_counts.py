"""Token counts of whole texts: batch encoding inside an Arrow function that returns lengths only.

A batch of texts is dealt into calls of the tokenizer of about CALL_BYTES each, so that neither many short texts nor a
few long ones decide how much memory a call needs.  Longer texts are cut first, at places where every tokenizer of this
kind starts a new pre-token whatever stands on either side, so that the pieces' lengths add up to the text's.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of UTF-8 that go to the tokenizer in one call, and code points a piece of a long text has at least.
CALL_BYTES, PIECE_CHARS = 1 << 20, 1 << 16
#: A pre-token of a byte-level pattern ends where a letter, digit or plain stop meets a single space before another, and
#: between a full-width stop and a letter.  Neither place lies in a contraction or a run of white space.
SAFE_CUT = regex.compile(r"(?<=[A-Za-z0-9.,;:)]) (?=[A-Za-z0-9(])|(?<=[。、！？，；：])(?=[一-鿿ぁ-ゖァ-ヺ가-힣])")


def pieces(text: str, size: int = PIECE_CHARS) -> Iterator[str]:
    """`text` cut at the first safe place after every `size` code points; a stretch without one stays whole."""
    start = 0
    while len(text) - start > size:
        cut = SAFE_CUT.search(text, start + size)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def _divisible(tokenizer_json: str) -> bool:
    """Whether the cuts are safe: bytes are split by the usual pattern, nothing is normalised or added in front, and no special string can hold a cut."""
    spec = json.loads(tokenizer_json)
    before, added = spec.get("pre_tokenizer") or {}, spec.get("added_tokens") or []
    plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space", True)
    whole = all(not (t["lstrip"] or t["rstrip"] or t["single_word"]) and not SAFE_CUT.search(t["content"]) and " " not in t["content"][:1] + t["content"][-1:] for t in added)
    return bool(plain and whole and spec.get("normalizer") is None)


def load(path: str) -> tuple[Callable[[list[str]], list[int]], bool]:
    """How many ids each of a list of texts has, and whether texts may be cut; .json for tokenizers, .model for sentencepiece."""
    if path.endswith(".model"):
        import sentencepiece

        processor = sentencepiece.SentencePieceProcessor(model_file=path)
        return (lambda texts: [len(ids) for ids in processor.encode(texts, num_threads=1)]), False
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return (lambda texts: [len(e) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]), _divisible(tokenizer.to_str())


def lengths(texts: pa.Array, count: Callable[[list[str]], list[int]], divisible: bool) -> np.ndarray:
    """Ids of each text, counted in calls of CALL_BYTES: whole short texts share a call, long ones are cut into pieces."""
    total = np.zeros(len(texts), np.int64)
    held, owners, size = [], [], 0

    def flush():
        np.add.at(total, owners, count(held))
        held.clear()
        owners.clear()

    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
    for row, n_bytes in enumerate(sizes.tolist()):
        text = texts[row].as_py()
        for piece in pieces(text) if divisible and n_bytes > PIECE_CHARS else (text,):
            held.append(piece)
            owners.append(row)
            size += n_bytes if len(piece) == len(text) else 4 * len(piece)
            if size >= CALL_BYTES:
                flush()
                size = 0
    if held:
        flush()
    return total


def token_counts(docs: DataFrame, tokenizer: str, limit: int) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit) for every row of `docs` (doc_id, text).

    NULL counts as an empty text, which has no tokens.  Special strings inside texts are handled as the tokenizer's file
    says; none are added, nothing is cut off or filled up.  Rows are counted one by one, so NULL doc_ids and repeated
    rows keep their own counts.  Other columns are ignored; an empty table gives an empty result.
    """

    @F.arrow_udf("bigint")
    def counted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        count, divisible = load(tokenizer)
        for texts in batches:
            yield pa.array(lengths(texts, count, divisible), pa.int64())

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), counted("text").alias("n_tokens")).withColumn("over_limit", F.col("n_tokens") > limit)
