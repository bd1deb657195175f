"""Operators whose rows a plain program can work out: exact dedup, suffix dedup, tokens, fingerprints, personal data."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from nightledger.llm import common, exact_dedup, personal_data, simhash, suffix_dedup, token_store
from nightledger.llm.queries import END_ID, tokenizer_path
from tests.llm.conftest import prose


def sorted_rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def union_find(links):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in parent}


def test_attach_splits_hot_keys(spark):
    rows = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}") for i in range(3000)], "i long, k string")
    groups = rows.groupBy("k").count().withColumnRenamed("count", "n")
    got = common.attach(rows, groups, "k", "n", 3000)
    assert got.count() == 3000 and got.where("k = 'hot'").select("n").distinct().collect()[0][0] == 2000


def test_components(spark):
    r = np.random.default_rng(0)
    links = [(int(a), int(b)) for a, b in r.integers(0, 120, (90, 2))] + [(1000 + i, 1001 + i) for i in range(40)]
    got = dict(common.components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect())
    want = union_find(links)
    assert got == {x: w for x, w in want.items() if any(x in p and p[0] != p[1] for p in links)}


def want_exact(rows):
    groups = defaultdict(list)
    for doc_id, text, *_ in rows:
        groups[text or ""].append(doc_id)
    best = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    return [(i, best[t or ""], len(groups[t or ""]), i == best[t or ""], hashlib.sha256((t or "").encode()).hexdigest()) for i, t, *_ in rows]


def test_exact_dedup(make_docs, odd_rows, monkeypatch):
    columns = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    want = sorted(want_exact(odd_rows), key=str)
    assert sorted_rows(exact_dedup.exact_dedup(make_docs(odd_rows)), *columns) == want
    monkeypatch.setattr(exact_dedup, "BROADCAST_WORDS", 0)
    assert sorted_rows(exact_dedup.exact_dedup(make_docs(odd_rows)), *columns) == want
    assert exact_dedup.exact_dedup(make_docs([])).count() == 0


def test_bloom_lets_unique_rows_pass(spark):
    rows = spark.range(2000).selectExpr("id", "xxhash64(id) AS h").union(spark.range(50).selectExpr("id", "xxhash64(id) AS h"))
    tested = exact_dedup.possibly_repeated(rows, "h", 1 << 15)
    assert tested.where("id < 50 and not maybe").count() == 0
    assert tested.where("maybe").count() < 300


def brute_repeats(rows, length):
    data = [(i, (t or "").encode()) for i, t, *_ in rows]
    seen = Counter(d[p : p + length] for _, d in data for p in range(len(d) - length + 1))
    out = []
    for i, d in data:
        mask = bytearray(len(d) + 1)
        for p in range(len(d) - length + 1):
            if seen[d[p : p + length]] > 1:
                mask[p : p + length] = b"\1" * length
        kept = bytes(b for b, m in zip(d, mask) if not m)
        out.append((i, len(d), sum(mask), sum(mask[k] and not (k and mask[k - 1]) for k in range(len(d))), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def repeats():
    shared, cycle = prose(50, 90), "abcdefgh " * 120
    rows = [(i, prose(60 + i, 50) + shared[i * 3 : len(shared) - i] + prose(80 + i, 40)) for i in range(9)]
    return [*rows, (20, cycle), (21, "a" * 900), (22, shared[:399]), (23, shared[:400]), (24, prose(91, 30) + cycle[5:450])]


@pytest.mark.parametrize("in_one_task", [2000, 0])
def test_suffix_dedup(make_docs, odd_rows, repeats, monkeypatch, in_one_task):
    rows = odd_rows + repeats
    monkeypatch.setattr(suffix_dedup, "IN_ONE_TASK", max(1, in_one_task))
    got = sorted_rows(suffix_dedup.remove_repeats(make_docs(rows)), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == brute_repeats(rows, 400)


def test_suffix_dedup_batches(make_docs, repeats):
    columns = ("doc_id", "n_removed", "n_spans", "kept_sha256")
    assert sorted_rows(suffix_dedup.remove_repeats(make_docs(repeats), 1), *columns) == sorted_rows(suffix_dedup.remove_repeats(make_docs(repeats), 5), *columns)
    assert suffix_dedup.remove_repeats(make_docs([])).count() == 0


def python_functions_in_a_task(plan, above=0):
    """The most Python functions that one task of a plan runs one after the other; each has a worker of its own."""
    if plan.nodeName() == "AdaptiveSparkPlan":
        return python_functions_in_a_task(plan.initialPlan(), above)
    above = 0 if "Exchange" in plan.nodeName() else above + (plan.nodeName() == "MapInArrow")
    return max([above, *(python_functions_in_a_task(plan.children().apply(i), above) for i in range(plan.children().size()))])


def test_suffix_dedup_holds_little(make_docs, repeats, monkeypatch):
    """One Python worker a task, and no more marks of a row that comes often than of one that comes once."""
    plans, tables, write = [], {}, suffix_dedup.written

    def written(df, name, *partition_by):
        plans.append(df._jdf.queryExecution().executedPlan())
        tables[name] = write(df, name, *partition_by)
        return tables[name]

    monkeypatch.setattr(suffix_dedup, "written", written)
    rows = repeats + [repeats[4]] * 25
    got = suffix_dedup.remove_repeats(make_docs(rows))
    assert sorted_rows(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute_repeats(rows, 400)
    assert max(map(python_functions_in_a_task, [*plans, got._jdf.queryExecution().executedPlan()])) == 1
    once = {i: len(suffix_dedup.anchors(t.encode())[0]) for i, t in rows}
    marked = tables["visited"].where("checks is not null").select("doc_id", "checks").collect()
    assert any(i == repeats[4][0] for i, _ in marked) and all(len(checks) <= once[i] for i, checks in marked)


def test_suffix_dedup_counts_blocks(make_docs, monkeypatch):
    """What is shuffled for a core with many unions is far less than a row a string, for a common line and for near copies."""
    tables, write = [], suffix_dedup.written
    monkeypatch.setattr(suffix_dedup, "written", lambda df, name, *by: tables.append((name, write(df, name, *by))) or tables[-1][1])
    monkeypatch.setattr(suffix_dedup, "IN_ONE_TASK", 5)
    line, copy = prose(70, 130), prose(71, 160).split()
    rows = [(i, line + " " + prose(300 + i, 60)) for i in range(40)]
    rows += [(100 + i, " ".join([*copy[: 4 * i], f"new{i}", *copy[4 * i :]])) for i in range(40)] + [(200, " ".join(copy))] * 3
    got = suffix_dedup.remove_repeats(make_docs(rows))
    assert sorted_rows(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute_repeats(rows, 400)
    at = [name for name, _ in tables].index("visited")
    checks = [m for r in tables[at][1].where("checks is not null").select("checks").collect() for m in r[0] if m["kinds"] > 5]
    strings = sum(m["hi"] - m["lo"] + 1 for m in checks)
    assert strings > 5000
    assert sum(table.count() for _, table in tables[at + 1 :]) < strings / 3


def test_snippets_of_repeated_rows_are_compared_once():
    text = prose(7, 200).encode()[:410]
    columns = {"core": [1, 1, 1, 2], "kinds": [2, 2, 2, 2], "row": [5, 5, 5, 6], "lo": [0, 0, 0, 0], "twice": [False] * 4, "snippet": [text] * 4}
    batch = pa.RecordBatch.from_arrays([pa.array(columns[c], t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary()))], list(columns))
    assert [b.num_rows for b in suffix_dedup._compare([batch.slice(0, 2), batch.slice(2)])] == [0, 0]


def test_index_levels_are_a_binary_counter(spark):
    family = suffix_dedup.IndexFamily()
    for i in range(5):
        family.add(spark.createDataFrame([(i, 7, 8), (i, 100 + i, 1)], "row long, core long, full long"))
    assert sorted(family.levels) == [0, 2]
    assert [tuple(r) for r in family.repeated().select("core", "n", "kinds").collect()] == [(7, 5, 1)]


@settings(max_examples=40, deadline=None)
@given(st.binary(max_size=1500), st.integers(0, 300), st.integers(0, 300))
def test_equal_strings_have_their_anchor_at_the_same_place(data, left, right):
    core = np.random.default_rng(5).integers(0, 4, 500, np.uint8).tobytes()
    places = []
    for text in (data[:left] + core, core + data[:right]):
        lo, hi, at = suffix_dedup.anchors(text)
        start = text.index(core)
        places.append([int(at[(lo <= p) & (p <= hi)][0]) - p for p in range(start, start + 101)])
    assert places[0] == places[1]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=700))
def test_codes_round_trip(ids):
    segment = token_store.Segment(token_store.encode(np.array(ids, np.uint32)))
    assert segment.decode().tolist() == ids and len(segment) == len(ids)
    assert [segment[i] for i in range(0, len(ids), 37)] == ids[::37]


def test_token_store(make_docs, odd_rows, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_store, "SEGMENT_TOKENS", 2000)
    odd = ["don't it's 3.14 x²  Ünï\tCÔdé xİ Σίγμας ΟΔΟΣ", "<|endoftext|> A<|ENDOFTEXT|>", "ﬁ ½ é a..b ,,.  x\x85y. Z", "n'T 'S,", "a.\n\nB, c.,", "É. Ö, ... %. X"]
    rows = odd_rows + [(200 + i, t) for i, t in enumerate(odd)]
    segments = token_store.write_tokens(make_docs(rows), tokenizer_path(), END_ID)
    got = sorted((tuple(r) for r in token_store.documents_of(segments).select("start", "doc_id", "n_tokens", "ids_crc32").collect()))
    tokenizer, start, want = Tokenizer.from_file(tokenizer_path()), 0, []
    for doc_id, text, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, END_ID], "<u4")
        want.append((start, doc_id, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == want
    one = segments.orderBy("part", "segment").first()
    assert token_store.Segment(bytes(one["codes"]))[one["lengths"][0] - 1] == END_ID
    assert token_store.documents_of(token_store.write_tokens(make_docs([]), tokenizer_path(), END_ID)).count() == 0


def plain_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(make_docs, odd_rows):
    base = prose(7, 300).split()
    near = [(300 + i, " ".join(base[:i] + ["other"] + base[i + 1 :])) for i in range(0, 300, 20)]
    rows = odd_rows + near + [(400, "\x0b\x0c"), (401, "A B c\x0bD")]
    got = simhash.near_groups(make_docs(rows)).collect()
    fps = {(r[0], r[1]): plain_fingerprint(r[1]) for r in rows}
    assert Counter(r["fingerprint"] for r in got) == Counter(f"{fps[r[0], r[1]]:016x}" for r in rows)
    values = sorted(set(fps.values()))
    root = union_find([(a, b) for a in values for b in values if (a ^ b).bit_count() <= 2])
    first = {}
    for (doc_id, _), fp in fps.items():
        if doc_id is not None:
            first[root[fp]] = min(doc_id, first.get(root[fp], doc_id))
    want = Counter((r[0], first.get(root[fps[r[0], r[1]]])) for r in rows)
    assert Counter((r["doc_id"], r["component_id"]) for r in got) == want
    assert len({w for (i, w) in want if i and 300 <= i < 400}) < len(near)
    assert simhash.near_groups(make_docs([])).count() == 0


def test_grid_finds_every_pair_in_reach(spark):
    r = np.random.default_rng(1)
    base = r.integers(0, 2**63, 40)
    values = {int(b) for b in base} | {int(b) ^ (1 << int(i)) ^ (1 << int(j)) for b in base for i, j in r.integers(0, 63, (6, 2))}
    got = {tuple(x) for x in simhash.links(spark.createDataFrame([(v,) for v in values], "fp long")).collect()}
    assert got == {(a, b) for a in values for b in values if a < b and (a ^ b).bit_count() <= 2}


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else 2 * int(c) - 9 * (int(c) > 4) for i, c in enumerate(reversed(digits))) % 10 == 0


def base_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m[0].split(".")), "card": 13 <= len(digits) <= 19 and luhn(digits or "0"), "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


TRICKY = [
    "a.b@c.d_e@f.gh..i@j", "x@y z@w.q@r.s", "1.2.3.4.5.6.7.8 001.02.3.255 1.2.3.256 99999999999999999999.1.1.1", "4111 1111-1111 1111 and 4111111111111112 4111  1111", "+1 (269) 555-3296 +12 +1 2 3 4 5 6 7 8 9 ++4 123456789)",
    "é漢🎉 a1@b-c.de\x01 +49 30 1234567\n10.0.0.1", "9" * 5000, "a" * 3000 + "@b", "1." * 2000, "@@@ . + - 4", "0000000000000 378282246310005.", "%+-@-.-",
]


def test_personal_data_base(make_docs, odd_rows):
    rows = odd_rows + [(500 + i, t) for i, t in enumerate(TRICKY)]
    got = personal_data.personal_data(make_docs(rows)).collect()
    want = []
    for doc_id, text, *_ in rows:
        spans = base_spans(text)
        counts = [sum(s.startswith(k + ":") for s in spans) for k in PATTERNS]
        want.append((doc_id, *counts, hashlib.sha256(",".join(spans).encode()).hexdigest()))
    assert sorted(((r["doc_id"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) for r in got), key=str) == sorted(want, key=str)
    assert all(r["spans"] == ",".join(base_spans(next(t for i, t, *_ in rows if i == r["doc_id"]))) for r in got if r["doc_id"] is not None and not r["n_discovered"])
    assert personal_data.personal_data(make_docs([])).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="a1@.+- _%(é9", max_size=40))
def test_possessive_patterns_match_alike(text):
    # Python's re knows possessive parts but no \G: attempts inside a run fail like those from its start.
    for kind, pattern in personal_data.PATTERNS.items():
        plain = re.sub(r"^\(\?:\\G\|.*?\]\)\)", "", pattern)
        assert [m.span() for m in re.finditer(plain, text)] == [m.span() for m in re.finditer(PATTERNS[kind], text)]


def test_personal_data_discovers_by_context(make_docs):
    rows = [(i, f"please write to mailbox u{i}@site.example now or later {prose(i, 5)}") for i in range(30)]
    rows += [(100, "please write to mailbox jane7(at)site now or later"), (101, "the sum of x9 is none")]
    got = {r["doc_id"]: r for r in personal_data.personal_data(make_docs(rows)).collect()}
    assert got[100]["spans"] == "email:24:37" and got[100]["n_email"] == 0 and got[100]["n_discovered"] == 1
    assert got[101]["spans"] == "" and got[3]["spans"] == "email:24:39"


@pytest.mark.parametrize("name, by_words", [("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)])
def test_encoder_tries_the_tokenizer_at_load(name, by_words):
    import public_tokenizers
    import pyarrow as pa
    from tokenizers import Tokenizer

    path = public_tokenizers.path(name)
    texts = [*token_store.PROBES, "Some Words, AND more. " * 50, "\x00 odd   marks"] * 20
    encoder = token_store.WordEncoder(path)
    ids, sizes = encoder.encode(pa.array(texts))
    want = [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert encoder.by_words == by_words and sizes.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
