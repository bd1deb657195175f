"""Library listing, header harvest, catalogue upkeep, streams, sinks."""

import datetime as dt
import os
import time

import pytest
from pyspark.sql import functions as F

from nightledger.functions.registry import register_sql_functions
from nightledger.operators.predicates import Flag
from nightledger.operators.screening import DEVIATIONS, screen_sessions
from nightledger.plans import portable
from nightledger.schema import FRAME_SCHEMA
from nightledger.sources import catalog, generations, header_source, headers, library, sinks
from nightledger.streaming import ingest, live
from tests.conftest import SMALL, ids
from tests.test_sessions import night_of


def fits(path, cards, pixels=b"\x00\x01END" * 500):
    """A minimal FITS file: 80-character cards, header blocks of 2880 bytes."""
    text = "".join(c.ljust(80) for c in ["SIMPLE  =                    T", *cards, "END"])
    text += " " * (-len(text) % 2880)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(text.encode("latin-1") + pixels)


def value(key, v, comment=""):
    return f"{key:8}= {v}" + (f" / {comment}" if comment else "")


CARDS = [
    value("NAXIS1", "                6000"), value("NAXIS2", "                4000"), value("OBJECT", "'O''Brien / 31'     ", "target"), value("IMAGETYP", "'LIGHT   '"),
    value("EXPTIME", "               300.0", "seconds"), value("FILTER", "'h-alpha '"), value("CCD-TEMP", "                -9.5"), value("SET-TEMP", "                 -10"),
    value("XPIXSZ", "                3.76"), value("FOCALLEN", "               530.0"), value("DATE-OBS", "'2026-05-13T04:00:00.123'"), value("BLKLEVEL", "                  50"),
    value("EMPTY", ""), "COMMENT first", "COMMENT second \"quoted\"", "", value("SWAP", "                   F"),
]


@pytest.fixture
def library_dir(tmp_path):
    root = tmp_path / "lib"
    fits(str(root / "a" / "one.fits"), CARDS)
    fits(str(root / "a" / "TWO.FIT"), [value(f"KEY{i}", str(i)) for i in range(80)] + [value("OBJECT", "'late'")])
    fits(str(root / ".hidden" / "no.fits"), CARDS)
    (root / "a" / "notes.txt").write_text("x")
    (root / "a" / "broken.fts").write_bytes(b"not an image")
    (root / "a" / "m.xisf").write_bytes(b"XISF0100")
    return str(root)


def test_typed_cards(spark, tmp_path):
    root = str(tmp_path / "typed")
    long = [value("OBJECT", "'M 31 and its compan&'"), "CONTINUE  'ions, seen &'", "CONTINUE  'late' / at last"]
    many = [f"HISTORY step {i}" for i in range(6000)]  # 167 blocks
    cards = [value("FILTER", "'T'"), value("NOTE", "'42'"), value("SET-TEMP", "'-10'"), value("GAIN", "              1.5D2"), value("XBINNING", "'2.5'"), value("YBINNING", "                   2"),
             "HIERARCH ESO DET NAME = 'cam / 1' / chip", "HIERARCH ESO DET ID   = 7", *long, *many, value("OFFSET", "                  10")]
    fits(f"{root}/a.fits", cards)
    row = headers.frames_from_headers(headers.harvest_headers(spark, root)).first()
    import json

    doc = json.loads(row["header_json"])
    assert (doc["FILTER"], doc["NOTE"], doc["SET-TEMP"], doc["GAIN"]) == ("T", "42", "-10", 150.0)
    assert (doc["ESO DET NAME"], doc["ESO DET ID"], doc["OBJECT"], doc["OFFSET"]) == ("cam / 1", 7, "M 31 and its companions, seen late", 10)
    assert (row["gain"], row["xbinning"], row["ybinning"], row["object"]) == (150.0, None, 2, "M 31 and its companions, seen late")


def test_numbers_in_integer_fields(spark, tmp_path):
    """A number loses its fraction; a quoted text must be an integer."""
    cards = [value("XBINNING", "                12.5"), value("YBINNING", "'12.5'"), value("OFFSET", "' 7 '"), value("NAXIS1", "               -3.9"), value("NAXIS2", "'x'")]
    fits(str(tmp_path / "n" / "a.fits"), cards)
    row = headers.frames_from_headers(headers.harvest_headers(spark, str(tmp_path / "n"))).first()
    assert [row[c] for c in ("xbinning", "ybinning", "cam_offset", "naxis1", "naxis2")] == [12, None, 7, -3, None]


def test_many_cards(spark, tmp_path):
    """20 000 cards of one keyword, and a text of as many CONTINUE cards: both are put together in linear time."""
    long = [value("OBJECT", "'start&'"), *(f"CONTINUE  '-{i}&'" for i in range(5000)), "CONTINUE  ' end'"]
    alone = ["CONTINUE  'stray'", value("NOTE", "'not open'"), "CONTINUE  'stray too'"]
    fits(str(tmp_path / "m" / "a.fits"), [*alone, *(f"HISTORY step {i}" for i in range(20_000)), *long, value("FILTER", "'Ha'")])
    cards = headers.harvest_headers(spark, str(tmp_path / "m")).first()["cards"]
    assert cards["HISTORY"] == "step 19999" and cards["NOTE"] == "not open" and cards["FILTER"] == "Ha"
    assert cards["OBJECT"] == "start" + "".join(f"-{i}" for i in range(5000)) + " end"


def touch(path, mtime):
    os.utime(path, (mtime, mtime))


def objects(df):
    return {os.path.basename(r["path"]): r["object"] for r in df.collect()}


def test_new_and_changed_files_in_one_stream(spark, tmp_path):
    """Files that are new, newer and older than before all come in; a restarted stream goes on where it was."""
    root, table, ck = str(tmp_path / "lib"), str(tmp_path / "table"), str(tmp_path / "ck")
    for name in "abc":
        fits(f"{root}/{name}.fits", [value("OBJECT", "'first'")])
        touch(f"{root}/{name}.fits", 1_999_999_000)
    take = lambda: objects(ingest.catch_up(spark, root, table, ck, files_per_batch=2, buckets=4))
    assert take() == dict.fromkeys(["a.fits", "b.fits", "c.fits"], "first")
    before = generations.manifest(spark, table).generation
    assert take() and generations.manifest(spark, table).generation == before   # nothing changed, nothing written
    fits(f"{root}/a.fits", [value("OBJECT", "'restored'")])
    touch(f"{root}/a.fits", 1_000_000_000)                                      # a backup with an older time
    fits(f"{root}/b.fits", [value("OBJECT", "'newer'")])
    touch(f"{root}/b.fits", 1_999_999_500)
    fits(f"{root}/sub/d.fit", [value("OBJECT", "'new'")])
    fits(f"{root}/.trash/e.fit", [value("OBJECT", "'hidden'")])
    assert take() == {"a.fits": "restored", "b.fits": "newer", "c.fits": "first", "d.fit": "new"}
    assert generations.read_current(spark, table).where("path like '%a.fits'").first()["file_mtime"] == 1_000_000_000
    touch(f"{root}/c.fits", 1_999_999_000.5)                                    # within the tolerance
    done = generations.manifest(spark, table).generation
    take()
    assert generations.manifest(spark, table).generation == done


def test_generations(spark, make_frames, tmp_path):
    table = str(tmp_path / "g")
    row = lambda path, name, mtime: {"id": hash(path) % 1000, "path": path, "object": name, "file_mtime": mtime}
    paths = [f"/lib/{i}.fits" for i in range(40)]
    assert generations.commit(spark, table, make_frames(*[row(p, "old", 100.0) for p in paths]), source="s", batch=0, buckets=8) == 1
    # The last writer wins, whatever its time; within a batch the newest row of a path.
    later = make_frames(row(paths[0], "again", 5.0), row(paths[1], "twice", 7.0), row(paths[1], "twice, newer", 8.0))
    assert generations.commit(spark, table, later, source="s", batch=1) == 2
    want = {p: "old" for p in paths} | {paths[0]: "again", paths[1]: "twice, newer"}
    read = lambda g=None: {r["path"]: r["object"] for r in generations.read_current(spark, table, g).collect()}
    assert read() == want and generations.read_current(spark, table).count() == 40
    # Untouched buckets stay where they are.
    written = generations.manifest(spark, table).written
    assert set(written.values()) == {1, 2} and sum(g == 2 for g in written.values()) <= 2
    # A replayed batch changes nothing, not even with other rows.
    assert generations.commit(spark, table, make_frames(row(paths[2], "replayed", 1.0)), source="s", batch=1) == 2 and read() == want
    # A batch that failed before its manifest is invisible, and written over.
    make_frames(row(paths[3], "half", 1.0)).write.parquet(f"{table}/data/generation=3/bucket=0")
    assert read() == want
    assert generations.commit(spark, table, make_frames(), removed=spark.createDataFrame([(paths[5],), ("/unknown",)], "path string")) == 3
    assert read() == {p: o for p, o in want.items() if p != paths[5]} and read(2) == want
    assert {r["object"] for r in generations.read_paths(spark, table, [paths[1], paths[5]]).collect()} == {"twice, newer"}
    # A read groups nothing and shuffles nothing.
    plan = generations.read_current(spark, table)._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and "Exchange" not in plan
    stale = generations.unused_folders(spark, table, keep=1)
    assert stale and not any(f"generation={g}/bucket={b}" in " ".join(stale) for b, g in generations.manifest(spark, table).written.items())


def test_generation_of_nothing(spark, make_frames, tmp_path):
    table = str(tmp_path / "e")
    assert generations.read_current(spark, table).count() == 0 and generations.unused_folders(spark, table) == []
    assert generations.commit(spark, table, make_frames(), batch=0) == 1 and generations.read_current(spark, table).count() == 0
    generations.commit(spark, table, make_frames({"path": "/a"}), batch=1)
    generations.commit(spark, table, make_frames(), removed=spark.createDataFrame([("/a",)], "path string"), batch=2)
    assert generations.read_current(spark, table).count() == 0 and generations.manifest(spark, table).done == {"": 2}


def test_header_source(spark, library_dir):
    spark.dataSource.register(header_source.FrameHeaders)
    rows = {os.path.basename(r["path"]): r for r in spark.read.format("frame_headers").option("path", library_dir).load().collect()}
    assert sorted(rows) == ["TWO.FIT", "broken.fts", "one.fits"]
    assert len(rows["TWO.FIT"]["head"]) == 3 * 2880 and rows["one.fits"]["length"] == os.path.getsize(rows["one.fits"]["path"])
    assert abs(rows["one.fits"]["modificationTime"].timestamp() - os.path.getmtime(rows["one.fits"]["path"])) < 1e-3


def test_stream_offsets(tmp_path):
    """A chunk an offset; the same files for the same offsets; what a crashed run handed out is not lost."""
    root, state = tmp_path / "lib", str(tmp_path / "state")
    for i in range(5):
        fits(str(root / f"{i}.fits"), [])
    reader = header_source.HeaderStreamReader({"path": str(root), "state": state, "files_per_batch": "2"})
    start = reader.initialOffset()
    names = lambda a, b: [os.path.basename(f[0])[0] for p in reader.partitions(a, b) for f in p.files]
    offsets = [reader.latestOffset() for _ in range(4)]
    assert [(o["round"], o["chunk"]) for o in offsets] == [(1, 1), (1, 2), (1, 3), (1, 3)]
    assert names(start, offsets[0]) == ["0", "1"] and names(offsets[0], offsets[2]) == ["2", "3", "4"] and names(offsets[2], offsets[2]) == []
    os.remove(root / "1.fits")
    touch(str(root / "3.fits"), 5)
    fits(str(root / "0" / "x.fits"), [])
    fresh = header_source.HeaderStreamReader(reader.options)
    after = fresh.latestOffset()
    assert (after["round"], after["chunk"], after["mtime"]) == (2, 1, 5_000_000)
    assert [os.path.basename(f[0]) for p in fresh.partitions(offsets[1], after) for f in p.files] == ["4.fits", "x.fits", "3.fits"]
    fresh.commit(after)
    assert fresh.latestOffset() == after


def test_refused_rows(make_frames):
    new = make_frames({"path": "/a"}, {"path": "/a"}, {"path": "/b"}, {"path": "/c"}, {"path": "/c"})
    got = {r["path"]: r["refused"] for r in library.refused_rows(new, make_frames({"path": "/b"}, {"path": "/c"}, {"path": "/z"})).collect()}
    assert got == {"/a": 1, "/b": 1, "/c": 2}


def names(df):
    return sorted(os.path.basename(r["path"]) for r in df.collect())


def test_listing_and_harvest(spark, library_dir):
    listing = library.list_library(spark, library_dir)
    assert names(listing) == ["TWO.FIT", "broken.fts", "m.xisf", "one.fits"]
    rows = {os.path.basename(r["path"]): r for r in headers.harvest_headers(spark, library_dir, listing).collect()}
    cards = rows["one.fits"]["cards"]
    assert cards["OBJECT"] == "O'Brien / 31" and cards["COMMENT"] == 'second "quoted"' and cards["EMPTY"] is None and "END" not in cards and "" not in cards
    assert rows["TWO.FIT"]["cards"]["OBJECT"] == "late" and len(rows["TWO.FIT"]["cards"]) == 82
    assert rows["broken.fts"]["cards"] is None and "no FITS header" in rows["broken.fts"]["error"]

    frames = {os.path.basename(r["path"]): r for r in headers.frames_from_headers(headers.harvest_headers(spark, library_dir, listing)).collect()}
    one = frames["one.fits"]
    assert (one["imagetyp"], one["filter"], one["exptime"], one["ccd_temp"], one["set_temp"], one["cam_offset"], one["solved"]) == ("Light Frame", "Ha", 300.0, -9.5, -10.0, 50, 0)
    assert one["pixel_scale"] == pytest.approx(206.265 * 3.76 / 530) and one["index_error"] is None
    import json

    doc = json.loads(one["header_json"])
    assert doc["SIMPLE"] is True and doc["SWAP"] is False and doc["EXPTIME"] == 300.0 and doc["NAXIS1"] == 6000 and doc["EMPTY"] is None and doc["COMMENT"] == 'second "quoted"'
    assert frames["broken.fts"]["index_error"] and frames["broken.fts"]["header_json"] is None


def test_change_detection(spark, make_frames):
    known = make_frames({"path": "/a", "file_mtime": 100.0}, {"path": "/b", "file_mtime": 100.0}, {"path": "/c", "file_mtime": None}, {"path": "/d", "file_mtime": 0.0}, {"path": "/gone", "file_mtime": 1.0})
    listing = spark.createDataFrame([("/a", 101.0, 1), ("/b", 101.5, 1), ("/c", 9.0, 1), ("/d", 9.0, 1), ("/new", 9.0, 1)], "path string, mtime double, length long")
    got = {r["path"]: r["change"] for r in library.diff_listing(listing, known).collect()}
    assert got == {"/a": "unchanged", "/b": "changed", "/c": "unchanged", "/d": "unchanged", "/new": "new"}
    assert sorted(r["path"] for r in library.prune_missing(known, listing).collect()) == ["/a", "/b", "/c", "/d"]


def test_set_temp_backfill(make_frames):
    df = make_frames({"header_json": '{"SET-TEMP": -10}'}, {"header_json": '{"SET-TEMP": "cold"}'}, {"header_json": '{"SET_TEMP": -5.5}'}, {"header_json": "{oops"}, {"set_temp": 1.0, "header_json": '{"SET-TEMP": -10}'}, {"header_json": '{"SET-TEMP": "-10"}'})
    assert [r["set_temp"] for r in catalog.backfill_set_temp(df).orderBy("id").collect()] == [-10.0, None, -5.5, None, 1.0, None]


def test_needs_analysis(make_frames):
    full = {"median_hfr": 2.0, "altitude": 40.0, "trail_score": 0.0, "diagnostics_json": '{"v":2,"width":1}'}
    df = make_frames(full, {**full, "diagnostics_json": None}, {**full, "diagnostics_json": '{"width":1}'}, {**full, "altitude": None}, {**full, "altitude": None, "imagetyp": "Dark Frame"})
    assert ids(catalog.needs_analysis(df)) == [2, 3, 4]


def test_grades(spark, make_frames):
    df = make_frames({"id": 1}, {"id": 2, "rejected": 1}, {"id": 3, "rejected": 1})
    at = lambda h: dt.datetime(2026, 1, 1, h)
    log = spark.createDataFrame([(1, 1, at(1)), (1, 0, at(2)), (2, None, at(3)), (2, 1, at(2))], "frame_id long, grade int, ts timestamp_ntz")
    assert [r["rejected"] for r in catalog.apply_grades(df, log).orderBy("id").collect()] == [0, None, 1]
    with pytest.raises(ValueError):
        catalog.grade_event(df.select("id"), "superb", F.current_timestamp())


def test_dynamic_overwrite_and_evolution(spark, tmp_path):
    path = str(tmp_path / "c")
    frames = portable.frames(spark, SMALL)
    catalog.write_frames(frames.drop("bg_dip"), path)
    got = catalog.read_frames(spark, path)
    assert got.columns == FRAME_SCHEMA.fieldNames() and got.filter("bg_dip IS NOT NULL").count() == 0
    assert got.count() == frames.count() and got.select("cam_offset").distinct().count() == 1


def test_sinks(spark, make_frames, tmp_path):
    df = make_frames({"path": "/lib/a"}, {"path": "/lib/b", "rejected": 1}, {"path": "/x/c", "rejected": 0})
    out = str(tmp_path / "paths")
    sinks.write_path_list(sinks.approved_paths(df, "/lib", "D:\\z"), out, single_file=True)
    assert sorted(r["value"] for r in spark.read.text(out).collect()) == ["/x/c", "D:\\z\\a"]
    sinks.write_path_list(sinks.approved_paths(df.filter("id > 9")), str(tmp_path / "none"), single_file=True)
    assert spark.read.text(str(tmp_path / "none")).count() == 0
    sinks.write_json(df.select("id", F.struct("path", "median_hfr").alias("f")), str(tmp_path / "json"))
    assert spark.read.text(str(tmp_path / "json")).filter(F.col("value").contains('"median_hfr":null')).count() == 3


def test_sql_functions(spark):
    assert "angsep" in register_sql_functions(spark)
    row = spark.sql("SELECT angsep(10D, 41D, 10D, 42D) AS a, fov_contains(359.9D, 0D, 1D, 1D, NULL, 0.2D, 0D) AS b, fov_contains(359.9D, 0D, NULL, 1D, NULL, 0.2D, 0D) AS c, wrap_ra(-359.5D) AS d").first()
    assert row["a"] == pytest.approx(1.0) and row["b"] and not row["c"] and row["d"] == pytest.approx(0.5)


def test_streaming_ingest(spark, library_dir, tmp_path):
    table, state = str(tmp_path / "catalogue"), str(tmp_path / "state")
    for expected in (["TWO.FIT", "broken.fts", "one.fits"], ["TWO.FIT", "broken.fts", "one.fits", "three.fits"]):
        got = ingest.catch_up(spark, library_dir, table, state, files_per_batch=2)
        assert names(got) == expected
        fits(os.path.join(library_dir, "b", "three.fits"), CARDS)
    rows = {os.path.basename(r["path"]): r for r in got.collect()}
    assert rows["three.fits"]["filter"] == "Ha" and rows["broken.fts"]["index_error"]


@pytest.fixture
def far_zone(spark):
    """A session time zone with clock changes, far from UTC."""
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    yield
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_live_screening(spark, make_frames, tmp_path, far_zone):
    """Provisional verdicts as frames arrive; after the timer, the verdicts of `screen_sessions` for every session that ended."""
    # Two nights on either side of a clock change, frames out of order, one without a star count, a night of two frames, and another key.
    clouded = night_of([500, 510, 495, 505, 200, 150, 480, 500, None, 498], start=dt.datetime(2026, 3, 7, 22))
    clouded[3]["date_obs"] += ".250"
    frost = night_of([500] * 8, dip=[0.008, 0.009, 0.007, 0.008, 0.008, 0.02, 0.035, 0.05], start=dt.datetime(2026, 3, 8, 20), first_id=20)
    short = night_of([500, 100], start=dt.datetime(2026, 3, 10, 1), first_id=40)
    other = night_of([800] * 6 + [400] * 14, start=dt.datetime(2026, 3, 8, 1), first_id=50, filter="Ha")
    last = night_of([500], start=dt.datetime(2026, 3, 20), first_id=90)
    batches = [clouded[:5] + other[:9], clouded[7:] + clouded[5:7] + other[9:], frost[::-1], short, last, night_of([500], start=dt.datetime(2026, 3, 20, 0, 5), first_id=91)]
    src = str(tmp_path / "in")
    for i, rows in enumerate(batches):
        make_frames(*rows).coalesce(1).write.mode("append").parquet(src)
        time.sleep(1.1)  # the file source goes by modification time
    stream = spark.readStream.schema(FRAME_SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)
    q = live.live_screening(stream).writeStream.format("memory").queryName("live_out").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = spark.table("live_out").collect()
    every = [r for rows in batches for r in rows]
    early = {r["id"]: r for r in got if not r["final"]}
    assert sorted(early) == sorted(r["id"] for r in every) and not early[2]["judged"] and early[4]["judged"] and early[5]["anomaly"]
    final = {r["id"]: r for r in got if r["final"]}
    assert len(final) == sum(r["final"] for r in got) and sorted(final) == sorted(r["id"] for r in every if r["id"] < 90)
    want = {r["id"]: r for r in screen_sessions(make_frames(*every), with_type=True).collect()}
    assert {i for i, r in final.items() if r["judged"]} == set(want) and want[5]["seq_anomaly"]
    for i, r in want.items():
        assert final[i]["anomaly"] == r["seq_anomaly"]
        assert [final[i][d] for d in DEVIATIONS] == [None if r[d] is None or r[d] != r[d] else r[d] for d in DEVIATIONS]
    utc_ms = lambda t: int(t.replace(tzinfo=dt.timezone.utc).timestamp() * 1000)
    assert final[4]["session_start"] == utc_ms(dt.datetime(2026, 3, 7, 22)) and final[20]["session_start"] == utc_ms(dt.datetime(2026, 3, 8, 20))


def test_flag_needs_operators():
    with pytest.raises(TypeError):
        bool(Flag(None))


def test_heads_are_cut_not_searched(spark):
    """Cards are cut where they stand; a search through each head took most of the time."""
    card = lambda text: text.ljust(80).encode("latin-1")
    simple, named, end = card("SIMPLE  =                    T"), card("OBJECT  = 'M \xb5/1'  / name"), card("END")
    heads = {"whole": simple + named + end + b" " * 2640, "short end": simple + named + b"END", "blanks": simple + card("") * 40 + named + end, "no end": simple + named, "empty": b"", "none": None}
    rows = spark.createDataFrame([(k, dt.datetime(2024, 1, 1), 0, v and bytearray(v)) for k, v in heads.items()], "path string, modificationTime timestamp, length long, head binary")
    parsed = headers.parse_headers(rows)
    got = {r["path"]: r for r in parsed.collect()}
    for name in ("whole", "short end", "blanks"):
        assert got[name]["cards"] == {"SIMPLE": "T", "OBJECT": "M \xb5/1"} and got[name]["texts"] == ["OBJECT"] and got[name]["error"] is None
    for name in ("no end", "empty", "none"):
        assert got[name]["cards"] is None and got[name]["error"] is not None
    spark.conf.set("spark.sql.maxMetadataStringLength", 4000)
    assert "split(" not in parsed._jdf.queryExecution().optimizedPlan().toString()


def test_unique_paths_rank_narrow_rows(spark):
    """The newest row of a path stays; whole rows are not packed into a sorted aggregate for it."""
    rows = spark.createDataFrame([("a", 1.0, "x"), ("a", 2.0, "y"), ("a", None, "z"), ("b", None, "x"), ("b", None, "x"), (None, 3.0, "n"), (None, 1.0, "m")], "path string, file_mtime double, object string")
    kept, surplus = library.unique_paths(rows)
    assert {tuple(r) for r in kept.collect()} == {("a", 2.0, "y"), ("b", None, "x"), (None, 3.0, "n")}
    assert {tuple(r) for r in surplus.collect()} == {("a", 2), ("b", 1), (None, 1)}
    plan = library.merge_frames(rows, rows).select("path", "file_mtime")._jdf.queryExecution().optimizedPlan().toString()
    assert "max_by" not in plan
