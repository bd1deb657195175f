"""Spelling variants, the filter audit and token counts against plain programs."""

import re
import zlib
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import types as T

from nightledger.llm import filter_audit, spelling_variants, token_counts
from nightledger.llm.queries import COUNTING_FILE, tokenizer_path
from tests.llm.conftest import prose


def words_by_hand(rows, min_length, one_in):
    counts = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if one_in and h % one_in == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            if len(word) >= min_length:
                counts[word] += 1
    return counts


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants_by_hand(rows, min_length=7, min_count=2, ratio=10, one_in=None):
    n = {w: c for w, c in words_by_hand(rows, min_length, one_in).items() if c >= min_count}
    near = {w: [v for v in n if abs(len(v) - len(w)) < 2 and one_edit(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= ratio * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n.get(form[w])))
    return sorted(out)


def got_variants(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


@pytest.fixture(scope="module")
def misspelt(odd_rows):
    # A chain of forms, edits at both ends and inside runs of equal letters, a replaced letter of the same symbol, ties, capitals, letters with marks.
    counts = {"abcdefgh": 400, "abcdefg": 30, "abcdefgx": 3, "xabcdefg": 3, "aaaaaaaa": 40, "aaaaaaa": 2, "aaaaaaab": 2, "aabaaaaa": 2, "modular": 20, "modulau": 20, "modulax": 2,
              "straßeÉn": 30, "straßeén": 2, "Zebrafish": 9, "zebrafish": 20, "zebrafisch": 2, "cruñidos": 50, "crunidos": 4, "middlexodd": 30, "middxexodd": 2, "oncealone": 1}
    text = " ".join(w for w, n in counts.items() for _ in range(n))
    return [*odd_rows, (500, text, "en", "a"), (501, text.replace(" ", "-"), "en", "a")]


@pytest.mark.parametrize("symbols,one_in", [(1, None), (3, 5)])
def test_spelling_variants(make_docs, misspelt, monkeypatch, symbols, one_in):
    monkeypatch.setattr(spelling_variants, "symbols_for", lambda words: symbols)
    got = got_variants(spelling_variants.spelling_variants(make_docs(misspelt), one_in=one_in))
    assert got == variants_by_hand(misspelt, one_in=one_in)
    if one_in is None:
        assert ("abcdefgx", "abcdefgh", "abcdefgh", 6, 2, 800) in got
        assert {w: r for w, _, r, *_ in got}["xabcdefg"] == "abcdefgh"


def test_spelling_variants_of_nothing(make_docs):
    assert spelling_variants.spelling_variants(make_docs([])).count() == 0
    assert spelling_variants.spelling_variants(make_docs([(1, None), (2, "short words only")])).count() == 0


def test_spelling_variants_of_documents(spark, make_docs):
    """The given documents, small typos by the query's rule."""
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    assert got_variants(spelling_variants.spelling_variants(make_docs(rows), one_in=31)) == variants_by_hand(rows, one_in=31)


@settings(max_examples=60, deadline=None)
@given(st.text("aábcdÿ", min_size=7, max_size=10), st.integers(0, 10), st.sampled_from("aábcdÿ"), st.sampled_from(["insert", "delete", "replace"]), st.integers(1, 6))
def test_words_one_edit_apart_meet(word, at, letter, how, symbols):
    at = min(at, len(word) - (how != "insert"))
    other = word[:at] + (letter if how != "delete" else "") + word[at + (how != "insert") :]
    codes = lambda w: np.array([[ord(c) for c in w]], np.uint64)
    with np.errstate(over="ignore"):
        sent, there = spelling_variants.neighbourhoods(codes(word), symbols), spelling_variants.answers(codes(other), symbols)
    assert set(sent.ravel().tolist()) & set(there.ravel().tolist())


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=200))
def test_positional_popcount(words):
    got = filter_audit.positional_popcount(np.array(words, np.uint32))
    assert got.tolist() == [sum(w >> i & 1 for w in words) for i in range(32)]


def audit_by_hand(rows, labels):
    texts = [(i, t or "", lang or "") for i, t, lang, *_ in rows]
    first = {}
    for i, t, _ in texts:
        if i is not None:
            first[t] = min(i, first.get(t, i))
    judged = []
    for i, t, part in texts:
        words = [w for w in re.split("[\x20\x09-\x0d]+", t) if w]
        fails = {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t)}
        fails |= {"D": bool(set(t) & set("#$%&*|")), "E": i is not None and i > first[t]}
        judged.append((part, {f for f in fails if fails[f]}, any(j == i and q == 1 for j, q, *_ in labels if i is not None), any(j == i and x == 1 for j, _, x, *_ in labels if i is not None)))
    out = []
    for part in {p for p, *_ in judged}:
        own = [j[1:] for j in judged if j[0] == part]
        total = Counter()
        rows_of_part = []
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[0]]
                left = [d for d in left if f not in d[0]]
                total[f] += len(gone)
                failing = sum(f in d[0] for d in own)
                rows_of_part.append((f, (part, "".join(order), step, len(left), len(gone), failing - len(gone), sum(d[0] == {f} for d in own), sum(d[1] for d in gone), sum(d[2] for d in gone))))
        out += [(*row, total[f]) for f, row in rows_of_part]
    return sorted(out)


LABELS = T.StructType([T.StructField(n, T.LongType()) for n in ("doc_id", "quality", "toxic", "part")])


def test_filter_audit(spark, make_docs, odd_rows):
    shout, same = "LOUD " * 40 + prose(5, 100), "one two " * 80
    rows = [*odd_rows, (40, shout, "en"), (41, shout, "de"), (42, same, None), (43, same, "en"), (44, prose(6, 120) + " #tag", "en"), (45, "a|b", ""), (46, shout + " 100%", "en"), (None, same, "en")]
    labels = [(40, 1, 0, 5), (41, 0, 1, 5), (42, 1, 1, 5), (44, None, 1, 5), (6, 1, None, 5), (6, 0, 0, 5), (None, 1, 1, 5), (9, 1, 0, 5), (7, 1, 1, 5), (8, 1, 0, 5)]
    columns = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    got = filter_audit.filter_audit(make_docs(rows), spark.createDataFrame(labels, LABELS))
    assert sorted(tuple(r) for r in got.select(*columns).collect()) == audit_by_hand(rows, labels)
    assert filter_audit.filter_audit(make_docs([]), spark.createDataFrame(labels, LABELS)).count() == 0
    assert filter_audit.filter_audit(make_docs(rows), spark.createDataFrame([], LABELS)).where("good_lost > 0").count() == 0


@pytest.fixture(scope="module")
def byte_bpe():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path(COUNTING_FILE))


def test_token_counts(make_docs, odd_rows, byte_bpe, monkeypatch):
    monkeypatch.setattr(token_counts, "PIECE_CHARS", 50)
    monkeypatch.setattr(token_counts, "CALL_BYTES", 500)
    rows = [*odd_rows, (60, "a<|endoftext|>b <|endoftext|> c " * 30), (61, "it's  they'll\n\n x " * 40), (62, "漢字。漢字、" * 80), (63, "x" * 5000), (64, " " * 700), (65, "Größe 3,5 (a) b; c: d. " * 60)]
    got = token_counts.token_counts(make_docs(rows), tokenizer_path(COUNTING_FILE), 300)
    want = [(i, len((t or "").encode()), len(byte_bpe.encode(t or "", add_special_tokens=False).ids)) for i, t, *_ in rows]
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(((i, b, n, n > 300) for i, b, n in want), key=str)
    assert token_counts.token_counts(make_docs([]), tokenizer_path(COUNTING_FILE), 300).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["word", "It's", " ", "  ", "\n", ". ", ", ", "(", ")", "'s", "'", "12", "é", "。", "漢", "<|endoftext|>", "|", ">", "　", "\x1c"]), max_size=80), st.integers(1, 9))
def test_pieces_have_the_ids_of_the_whole(byte_bpe, parts, size):
    text = "".join(parts)
    cut = list(token_counts.pieces(text, size))
    assert "".join(cut) == text
    assert [i for p in cut for i in byte_bpe.encode(p, add_special_tokens=False).ids] == byte_bpe.encode(text, add_special_tokens=False).ids


def test_files_of_other_kinds(make_docs):
    """A tokenizer that is not byte-level, and one of sentencepiece, count whole texts."""
    import sentencepiece
    from tokenizers import Tokenizer

    rows = [(1, "Two words. " * 9), (2, None), (3, prose(7, 300))]
    for name in ("word_bpe_49k.json", "piece_bpe_32k.model"):
        path = tokenizer_path(name)
        count, divisible = token_counts.load(path)
        assert not divisible
        plain = Tokenizer.from_file(path).encode(rows[2][1], add_special_tokens=False).ids if name.endswith("json") else sentencepiece.SentencePieceProcessor(model_file=path).encode(rows[2][1])
        got = {r["doc_id"]: r["n_tokens"] for r in token_counts.token_counts(make_docs(rows), path, 10).collect()}
        assert got[3] == len(plain) and got[2] == 0
