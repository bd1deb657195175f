"""Operators that learn, search or sample: held-out accuracy, brute force and invariants."""

import gzip
import zlib
from collections import Counter
from itertools import combinations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from nightledger.llm import decontamination, language_id, mixing, near_copies, quality_classifier, queries, warc
from tests.conftest import SMALL
from tests.llm.conftest import prose

SF = "/root/testdata/sf0.01"


def crc(doc_id):
    return zlib.crc32(str(doc_id).encode())


def test_quality(spark):
    got = queries.op1_quality(spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").where("quality is not null").collect()
    assert all(r["held_out"] == (crc(r["doc_id"]) % 5 == 0) for r in got) and all(0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["held_out"]]
    assert np.mean([r["predicted"] == r["quality"] for r in held]) > 0.95
    assert all(r["predicted"] == (r["score"] >= 0.3) for r in got)


def test_quality_learns_from_the_other_folds_only(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    sample = quality_classifier.labelled(docs, labels).collect()
    assert sample and all(crc(r["doc_id"]) % 5 for r in sample)


def test_quality_odd_rows(spark, make_docs, odd_rows):
    labels = spark.createDataFrame([(4, 1, 0), (5, 0, 0), (6, None, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = quality_classifier.quality(make_docs(odd_rows), labels).collect()
    assert len(got) == len(odd_rows) and all(0 <= r["score"] <= 1 for r in got)
    assert len({r["score"] for r in got if r["doc_id"] == 9}) == 1
    assert quality_classifier.quality(make_docs([]), labels.limit(0)).count() == 0


def test_chunks_cover_the_text():
    for n in (0, 1, 255, 256, 257, 480, 481, 5000):
        data = bytes(1 + i % 250 for i in range(n))
        cut = quality_classifier.chunks(data.decode("latin-1").encode("latin-1").decode("latin-1") if n and max(data) < 128 else "a" * n)
        assert (len(cut) - 1) * quality_classifier.STEP + quality_classifier.CHUNK >= n and len(cut) >= 1
        assert int((cut[-1] > 0).sum()) > 0 or n == 0


def test_network_gradient():
    net = quality_classifier.Network.initial()
    docs, labels = [quality_classifier.chunks(prose(i, 90)) for i in range(3)], np.array([1.0, 0.0, 1.0], np.float32)

    def loss():
        rows = np.concatenate(docs)
        p = net.probability(net.pooled(rows, net.table()), quality_classifier.filled(rows), np.cumsum([0, *map(len, docs[:-1])]))
        return -np.mean(labels * np.log(p) + (1 - labels) * np.log(1 - p))

    found = net.gradients(docs, labels)
    for name, at in (("out", (3,)), ("hidden", (2, 5)), ("offset", (4,)), ("filters", (1, 2, 7)), ("hidden_offset", (6,))):
        value = getattr(net, name)
        before = value[at]
        value[at] = before + 1e-2
        up = loss()
        value[at] = before - 1e-2
        down = loss()
        value[at] = before
        assert (up - down) / 2e-2 == pytest.approx(found[name][at], rel=0.15, abs=2e-3)


def test_language(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r["held_out"] == (crc(r["doc_id"]) % 3 == 1) for r in got)
    held = [r for r in got if r["held_out"] and r["lang"]]
    assert np.mean([r["lang_pred"] == r["lang"] for r in held]) > 0.97
    assert np.mean([r["rejected"] for r in got]) < 0.05


def test_language_odd_rows(make_docs, odd_rows):
    got = {r["doc_id"]: r for r in language_id.identify(make_docs(odd_rows)).collect()}
    assert {got[i]["lang_pred"] for i in (1, 2, 3)} == {"und"} and got[1]["score"] == 0 and not got[1]["rejected"]
    assert got[6]["lang_pred"] in {"en", "fr", "de"} and 0 <= got[6]["score"] <= 1
    assert {r["lang_pred"] for r in language_id.identify(make_docs([(1, "abc"), (2, None)])).collect()} == {"und"}
    assert language_id.identify(make_docs([])).count() == 0


def test_kneser_ney_sums_to_one():
    texts = ["abra cadabra", "a barb", "cab"]
    keys, n = np.unique(language_id.grams(texts)[0], return_counts=True)
    models = language_id.build({"x": (keys, n)})
    alphabet = sorted({int(k) & 0xFFFF for k in keys})
    for context in ("   ", "  a", "abr", "bra", "zzz", "cab"):
        head = sum(ord(c) << 16 * (3 - i) for i, c in enumerate(context))
        p = np.exp2(models.log_probabilities(np.array([head | c for c in alphabet], np.uint64)))[:, 0]
        # Part of the discount at the bottom is kept for characters that were never seen.
        assert 0.75 < p.sum() <= 1.0001, (context, p.sum())


def lower_orders(counts):
    levels = [Counter(counts)]
    for _ in range(3):
        levels.append(Counter(g[1:] for g in levels[-1]))
    return levels


def plain_kneser_ney(counts, every):
    """log2 p(gram) in one language from the definition, as a function; counts: gram text -> n; every: those of all languages."""
    levels, characters = lower_orders(counts), [set(lower_orders(c)[3]) for c in every]
    # The largest alphabet leaves this to a character; what no language has gets it whole.
    unseen, known = 1 / (2 * max(map(len, characters))), set().union(*characters)

    def p(gram):
        if not gram or gram not in known and len(gram) == 1:
            return unseen
        table = levels[4 - len(gram)]
        total = sum(n for g, n in table.items() if g[:-1] == gram[:-1])
        if not total:
            return p(gram[1:])
        kinds = sum(g[:-1] == gram[:-1] for g in table)
        return max(table[gram] - 0.75, 0) / total + 0.75 * kinds / total * p(gram[1:])

    return lambda gram: np.log2(p(gram))


@pytest.mark.parametrize("cells", [1 << 24, 20])
def test_language_probabilities_from_the_definition(make_docs, monkeypatch, cells):
    """In one slice and in many: every text's cross-entropy is that of a plain Kneser-Ney model of all learned texts."""
    monkeypatch.setattr(language_id, "SLICE_CELLS", cells)
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("abra cadabra, a barb", "x"), ("the cab then the bath", "y"), ("bra braid", "x"), ("hat that bat", "y"), ("abc", "x"), (None, "x"), ("zebra hath", None)] * 3)]
    docs = make_docs(rows)
    apart = {r[0] for r in docs.where(f"pmod(xxhash64(doc_id), {language_id.SET_APART}) = 0").select("doc_id").collect()}
    grams = lambda t: [g for g in plain_grams(t)]
    counts = {x: Counter(g for i, t, lang in rows if lang == x and t and crc(i) % 3 != 1 and i not in apart for g in grams(t)) for x in "xy"}
    models = {x: plain_kneser_ney(counts[x], counts.values()) for x in "xy"}
    learned = language_id.learn(docs.where("crc32(cast(doc_id as string)) % 3 <> 1 and pmod(xxhash64(doc_id), 20) <> 0"))
    assert (learned.slices > 3) == (cells == 20)
    for r in language_id.identify(docs).collect():
        text = rows[r["doc_id"]][1]
        if text:
            bits = {x: -sum(models[x](g) for g in grams(text)) / len(grams(text)) for x in "xy"}
            assert r["lang_pred"] == min(bits, key=bits.get) and r["cross_entropy"] == pytest.approx(min(bits.values()), rel=1e-5)
        else:
            assert r["lang_pred"] == "und"


def test_every_gram_is_kept(make_docs):
    """More than 2^19 different grams of one language."""
    r = np.random.default_rng(1)
    texts = ["".join(map(chr, r.integers(0x4E00, 0x9FA5, 60_000))) for _ in range(9)]
    docs = make_docs([(i, t, "zh") for i, t in enumerate(texts)])
    want = len(np.unique(language_id.grams(texts)[0]))
    assert want > 1 << 19 and language_id.counted(docs).count() == want


def plain_grams(text):
    out, last = "   ", " "
    for c in text.lower():
        if c.isalpha() or last != " ":
            out += c if c.isalpha() else " "
            last = out[-1]
    return [out[i - 3 : i + 1] for i in range(3, len(out))]


def test_grams_match_a_plain_walk():
    texts = ["Hello, World! 12 a", "", "...", "x", "  lead", "tail  ", "éà ßΣ", " a b"]
    found, counts = language_id.grams(texts)
    names = ["".join(chr(int(k) >> 16 * b & 0xFFFF) for b in (3, 2, 1, 0)) for k in found]
    for text, n, stop in zip(texts, counts, np.cumsum(counts)):
        assert names[stop - n : stop] == plain_grams(text)


ITEMS = [(0, "Which river runs through the old town of Marvale before it meets the sea? The silver Ondine river."), (1, "Name the metal that turns green in rain and air on old roofs. It is copper."), (2, "tiny one"), (3, None), (4, "")]


def test_decontamination(spark, make_docs):
    first, second = ITEMS[0][1], ITEMS[1][1]
    loose = first.replace("runs through the old", "flows across an old").replace("before it", "until it")
    rows = [(1, prose(1, 70) + " " + first + " " + prose(2, 50)), (2, prose(3, 20) + "\n" + second.upper().replace(".", " ;")), (3, prose(4, 90) + " " + loose + " " + prose(5, 9))]
    rows += [(10 + i, prose(20 + i, 150)) for i in range(25)] + [(50, None), (51, ""), (52, "tiny one"), (1, rows[0][1]), (60, first[:40] + prose(7, 80))]
    benchmark = spark.createDataFrame([(*i, None) for i in ITEMS], "item_id long, text string, doc_id long")
    got = {(r["doc_id"], r["item_id"]): r for r in decontamination.contaminated(make_docs(rows), benchmark).collect()}
    assert set(got) == {(1, 0), (2, 1), (3, 0)}
    assert got[1, 0]["lcs"] == 1 and 0.6 <= got[3, 0]["lcs"] < 1 and got[3, 0]["answer"]
    assert decontamination.contaminated(make_docs([]), benchmark).count() == 0
    assert decontamination.contaminated(make_docs(rows), benchmark.limit(0)).count() == 0


def test_decontamination_finds_every_verbatim_item(spark):
    docs, benchmark = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    items = [(r["item_id"], " ".join(r["text"].split())) for r in benchmark.collect()]
    want = {(d["doc_id"], i) for d in docs.select("doc_id", "text").collect() for i, t in items if t in " ".join(d["text"].split())}
    got = {(r["doc_id"], r["item_id"]) for r in queries.op3_decontamination(spark, SF).collect()}
    assert want and want <= got and len(got - want) <= 0.1 * len(want)


def test_common_subsequence():
    def plain(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = row[:]
            for j, y in enumerate(b):
                row[j + 1] = last[j] + 1 if x == y else max(last[j + 1], row[j])
        return row[-1]

    r = np.random.default_rng(3)
    for _ in range(60):
        a, b = ([b"%d" % i for i in r.integers(0, 6, r.integers(0, 90))] for _ in range(2))
        assert decontamination.common(a, b) == plain(a, b)


def test_latent_space_is_the_leading_one(spark):
    rows = decontamination.passages(spark.createDataFrame([(i, prose(i, 20)) for i in range(30)], "item_id long, text string"))
    idf = np.random.default_rng(0).uniform(0.5, 2, decontamination.TERMS)
    space = decontamination.latent_space(rows, idf)
    matrix = np.zeros((30, decontamination.TERMS))
    for n, r in enumerate(rows.orderBy("item_id").collect()):
        term, value = decontamination._vector(r["words"], idf)
        matrix[n, term] = value
    assert np.linalg.norm(matrix @ space) == pytest.approx(np.linalg.norm(matrix), rel=1e-3)


@pytest.mark.parametrize("block", [mixing.BLOCK, 40])
def test_mixing(spark, block):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs = docs.withColumn("source", F.when(F.col("doc_id") % 2 == 0, "src0").when(F.col("doc_id") % 97 == 1, None).otherwise(F.col("source")))
    got = mixing.mixed(docs, block).collect()
    pdf = docs.toPandas()
    size = {i: len((t or "").split()) for i, t in zip(pdf.doc_id, pdf.text)}
    total = Counter()
    for i, s in zip(pdf.doc_id, pdf.source):
        total[s] += size[i]
    order = sorted([s for s in total if s is not None]) + ([None] if None in total else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, open_, target = sum(total.values()), set(order), {}
    while True:
        share = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        over = [s for s in open_ if share[s] > 3 * total[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 3.0 * total[s]
            left -= 3 * total[s]
            open_.discard(s)
    taken = Counter()
    for r in got:
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == total[r["source"]] and r["target"] == pytest.approx(target[r["source"]])
        assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"]
        taken[r["source"]] += r["taken"]
    biggest = max(size.values())
    assert all(abs(taken[s] - target[s]) <= biggest for s in order)
    # With a dozen documents left to the landing, a source of some size comes within one percent.
    documents = Counter(r["source"] for r in got)
    assert all(abs(taken[s] - target[s]) <= 0.01 * target[s] for s in order if documents[s] >= 40)
    again = mixing.mixed(docs.repartition(7), block).collect()
    assert Counter(map(str, again)) == Counter(map(str, got))


def test_flight_keeps_documents_and_words():
    r = np.random.default_rng(4)
    share, size = np.full(500, 0.37), r.integers(1, 900, 500).astype(float)
    out = mixing.flight(share, size, r)
    assert ((out > 0) & (out < 1)).sum() <= 2
    assert out.sum() == pytest.approx(share.sum()) and out @ size == pytest.approx(share @ size)


def test_flight_holds_documents_back_and_landing_takes_the_best_subset():
    r = np.random.default_rng(5)
    share, size = np.full(300, 0.37), r.integers(1, 900, 300)
    size[:3] = 20000
    out = mixing.flight(share, size, r, 12)
    left = np.flatnonzero((out > 0) & (out < 1))
    assert 12 <= len(left) <= 14 and set(range(3)) < set(left) and (out[left] == 0.37).sum() >= 12
    landed = mixing.landing(out, size)
    assert set(np.unique(landed)) == {0.0, 1.0}
    assert all(landed[i] == out[i] for i in range(300) if i not in left)
    sums = [sum(c) for n in range(len(left) + 1) for c in combinations(size[left].tolist(), n)]
    assert abs(landed[left] @ size[left] - out[left] @ size[left]) == pytest.approx(min(abs(x - out[left] @ size[left]) for x in sums))
    # Shares that miss a whole number by rounding only are whole.
    assert mixing.flight(np.full(40, 1 - 1e-13), np.arange(40), r, 12).tolist() == [1.0] * 40


def test_mixing_odd_rows(make_docs, odd_rows):
    got = mixing.mixed(make_docs(odd_rows)).collect()
    assert len(got) == len(odd_rows) and sum(r["taken"] for r in got if r["doc_id"] in (1, 2, 3)) == 0
    assert mixing.mixed(make_docs([])).count() == 0


def test_near_copies(make_docs, odd_rows):
    base = prose(7, 200).split()
    near = [(300 + i, " ".join(base[: 20 * i] + ["other", "words"] + base[20 * i + 2 :])) for i in range(9)]
    got = near_copies.near_copies(make_docs(odd_rows + near)).collect()
    assert {r["component_id"] for r in got if r["doc_id"] and 300 <= r["doc_id"] < 400} == {300}
    assert {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] in (1, 2, 3, 6, 7, 8, 30, 31)} == {1: 1, 2: 1, 3: 1, 6: 6, 7: 6, 8: 6, 30: 30, 31: 31}
    assert near_copies.near_copies(make_docs([])).count() == 0


def test_warc_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    want = con.execute(queries.ORACLES["op2_warc"]).df()
    got = queries.op2_warc(spark, SF).toPandas()[want.columns]
    key = lambda df: df.sort_values("page_id").astype(str).values.tolist()
    assert key(got) == key(want)


def test_warc_rows_of_many_records(spark):
    one, two = warc.response(1, "http://a/", "<p>one"), warc.response(2, "http://b/", "<p>two")
    request = warc.pack([("WARC-Type", "request"), ("WARC-Record-ID", "<urn:x>")], b"GET / HTTP/1.1")
    nameless = warc.pack([("WARC-Type", "response")], b"HTTP/1.1 200 OK\r\n\r\n")
    packed = gzip.compress(one) + gzip.compress(request) + gzip.compress(two)
    rows = [(1, one + request + two), (2, packed), (3, one + two[:-40]), (4, packed[:-30]), (5, None), (6, b""), (7, request), (8, b"no record"), (9, nameless + two), (10, gzip.compress(one) + gzip.compress(two)[:-8] + bytes(8)), (11, one.replace(b"Content-Length: ", b"Content-Length: x", 1))]
    got = {}
    for r in warc.derivatives(spark.createDataFrame(rows, "page_id long, record binary")).collect():
        text = None if r["conversion"] is None else warc.unpack(bytes(r["conversion"]))[0][1].decode()
        got.setdefault(r["page_id"], []).append((r["place"], text, r["error"]))
    assert got[1] == got[2] == [(0, "one", None), (2, "two", None)]
    assert got[3] == [(0, "one", None), (1, None, "the record is cut off")]
    assert got[4][0] == (0, "one", None) and got[4][-1][1:] == (None, "a gzip member that is cut off")
    assert got[5] == got[6] == [(None, None, None)] and 7 not in got
    assert got[8] == [(0, None, "not a WARC record")]
    assert got[9] == [(0, None, "a response without an identifier"), (1, "two", None)]
    assert got[10] == [(0, "one", None), (1, None, "a damaged gzip member")] and got[11] == [(0, None, "a record without a length")]


def test_warc_records(spark):
    rows = [(1, "http://a/é", "<p>Tom &amp; <b>Jo</b><script>x</script><a class=k href='/q?a&amp;b'>l</a>"), (2, None, None), (None, "http://b/", ""), (1, "http://a/é", "<p>Tom &amp; <b>Jo</b><script>x</script><a class=k href='/q?a&amp;b'>l</a>")]
    records = warc.responses(spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, record string"))
    source = {r["page_id"]: warc.unpack(bytes(r["record"]))[0] for r in records.collect()}
    for r in warc.derivatives(records, compress=True).collect():
        (about, fields), (head, text) = warc.unpack(bytes(r["metadata"]))[0], warc.unpack(bytes(r["conversion"]))[0]
        origin = source[r["page_id"]][0]
        assert about["warc-refers-to"] == head["warc-refers-to"] == origin["warc-record-id"] and head["warc-concurrent-to"] == about["warc-record-id"]
        assert head["warc-refers-to-date"] == origin["warc-date"] and head["warc-block-digest"] == warc.digest(text)
        assert b"http-header: Content-Type: text/html; charset=utf-8" in fields and origin["warc-payload-digest"].encode() in fields
        if r["page_id"] == 1:
            assert text == b"Tom & Jo l" and b"outlink: /q?a&b" in fields and r["n_links"] == 1
    two = bytes(records.first()["record"])
    assert len(warc.unpack(two + two)) == 2
    with pytest.raises(ValueError):
        warc.unpack(two[:-40])


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracles(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    want = con.execute(queries.ORACLES[name]).df()
    got = queries.queries()[name](spark, SMALL).toPandas()[want.columns]
    as_text = lambda df: sorted(map(str, df.astype(str).values.tolist()))
    assert as_text(got) == as_text(want)


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept.count(), stage(spark, kept, SF).cache()
        assert kept.columns == columns and 0 < kept.count() <= 3 * before
        if "near-dedup" in name:
            assert kept.select("text").distinct().count() == kept.count()
    want = sorted(Counter(r["doc_id"] for r in kept.collect()).items())
    got = corpus_pipeline.STAGES[-1][1](spark, kept, SF).collect()
    assert sorted(Counter(r["doc_id"] for r in got).items()) == want
    leaks = {r["doc_id"] for r in queries.op3_decontamination(spark, SF).collect()}
    assert leaks and not leaks & {i for i, _ in want}


def near_components(rows):
    """doc_id to the smallest doc_id of its near copies, by the similarity of all pairs."""
    sets = {i: set(near_copies.shingle_hashes(t, 5).tolist()) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in sets}


def edited(words, places, mark):
    out = list(words)
    for n, at in enumerate(places):
        out[at] = f"{mark}x{n}"
    return " ".join(out)


def test_near_copies_are_checked_by_exact_similarity(make_docs):
    rows = []
    for family in range(40):
        base = prose(900 + family, 400).split()
        # One block of edits each: similarity 0.75, 0.79 and 0.8 to the base, of the whole shingle sets.
        r = np.random.default_rng(family)
        at = int(r.integers(0, 250))
        rows += [(10 * family + i, edited(base, range(at, at + n), f"{family}-{i}")) for i, n in enumerate((0, 52, 43, 38))]
    got = {r["doc_id"]: r["component_id"] for r in near_copies.near_copies(make_docs(rows)).collect()}
    want = near_components(rows)
    assert len(set(want.values())) > 40 and got == want


def test_near_copies_of_one_base_are_one_group(make_docs):
    """Copies of a base are like it, not like each other; chains hold families together that no single text does."""
    r = np.random.default_rng(5)
    base, other = prose(800, 400).split(), prose(801, 400).split()
    rows = [(1000 + i, edited(base, r.choice(400, 8, replace=False) if i else (), f"b{i}")) for i in range(250)]
    chain = other
    for i in range(30):
        rows.append((2000 + i, " ".join(chain)))
        chain = edited(chain, range(13 * i, 13 * i + 12), f"c{i}").split()
        chain = edited(chain, (13 * i + 3,), f"d{i}").split()
    # Much like the base, but not enough.
    rows += [(3000 + i, edited(base, r.choice(400, 12, replace=False), f"e{i}")) for i in range(20)]
    got = {r["doc_id"]: r["component_id"] for r in near_copies.near_copies(make_docs(rows)).collect()}
    assert got == near_components(rows)


def test_a_family_costs_few_comparisons_a_text(make_docs, monkeypatch):
    """Most copies are like their base, and the rest are told apart by what they do not have from it."""
    compared, alike = [], near_copies.alike

    def counted(pairs, *rest):
        pairs = pairs.distinct().localCheckpoint()
        compared.append(pairs.count())
        return alike(pairs, *rest)

    monkeypatch.setattr(near_copies, "alike", counted)
    r = np.random.default_rng(11)
    base = prose(850, 150).split()
    rows = [(i, edited(base, r.choice(150, int(r.integers(0, 7)), replace=False), f"e{i}")) for i in range(700)]
    got = {row["doc_id"]: row["component_id"] for row in near_copies.near_copies(make_docs(rows)).collect()}
    assert got == near_components(rows)
    # 16 a text when the bands' smallest nodes came first.
    assert sum(compared) < 8 * len(rows), compared


def test_sketches_tell_apart_what_rare_shingles_do_not(make_docs, monkeypatch):
    """Texts with words put in and left out have sizes and places that let them be alike; few of them are."""
    compared, alike = [], near_copies.alike

    def counted(pairs, *rest):
        pairs = pairs.distinct().localCheckpoint()
        compared.append(pairs.count())
        return alike(pairs, *rest)

    monkeypatch.setattr(near_copies, "alike", counted)
    r = np.random.default_rng(12)
    base, rows = prose(851, 150).split(), []
    for i in range(700):
        words = list(base)
        for _ in range(int(r.integers(0, 9))):
            at = int(r.integers(0, len(words)))
            words[at : at + 1] = [] if r.random() < 0.5 else [f"i{i}", words[at]]
        rows.append((i, " ".join(words)))
    got = {row["doc_id"]: row["component_id"] for row in near_copies.near_copies(make_docs(rows)).collect()}
    assert got == near_components(rows)
    assert compared[-1] < 100, compared


def test_decontamination_finds_short_items_of_a_large_benchmark(spark, make_docs):
    items = [(i, prose(5000 + i, 5 + i % 16)) for i in range(800)]
    rows = []
    for i, text in items:
        around = prose(9000 + i, 120).split()
        at = 17 * i % 100
        rows.append((i, " ".join([*around[:at], text, *around[at:]])))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(make_docs(rows), benchmark).collect()}
    assert {(i, i) for i, t in items if len(decontamination.words(t)) >= decontamination.MIN_WORDS} <= got


def test_decontamination_takes_no_scattered_words_for_a_short_passage(spark, make_docs):
    short, long = prose(70, 5), " ".join(f"long{i}" for i in range(69))
    tail, filler = long.split()[-5:], [f"filler{i}" for i in range(60)]

    def scattered(words, gap):
        return " ".join(w for i, word in enumerate(words) for w in (word, *filler[gap * i : gap * (i + 1)]))

    rows = [(1, scattered(short.split(), 6)), (2, scattered(tail, 6)), (3, " ".join(filler[:20] + [*short.split()[:2], "extra", *short.split()[2:]] + filler[20:])), (4, prose(71, 30) + " " + long), (5, " ".join(filler + tail))]
    rows += [(6, " ".join(filler[:40] + long.split()[3:])), (7, " ".join(filler[:40] + long.split()[:64]))]
    benchmark = spark.createDataFrame([(1, short), (2, long)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(make_docs(rows), benchmark).collect()}
    assert got == {(3, 1), (4, 2), (6, 2), (7, 2)}
    assert [len(r["words"]) for r in decontamination.passages(benchmark).orderBy("item_id", "part").collect()] == [5, 64, 64]
