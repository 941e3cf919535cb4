"""The package without its llm part: scalar tables, rules, frames, and every query against its SQL on the smallest data."""

import os
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from silvercask.functions import scalars as S
from silvercask.operators import codec, deid, fuzzy, phi, pixels
from silvercask.plans import registry

SF = "/root/testdata/sf0.001"


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x"))).first()[0]


@pytest.mark.parametrize("uid", ["1.02.3", "1..2", ".1.2", "1.2.", "1.2.a", "1." + "2" * 63])
def test_bad_uids(spark, uid):
    assert one(spark, uid, S.valid_uid) is None


def test_scalars(spark):
    assert one(spark, " 1.2.3 ", S.valid_uid) == "1.2.3"
    assert one(spark, "7", S.series_number) == "007"
    assert one(spark, "-7", S.series_number) == "-007"
    assert one(spark, "12345", S.series_number) == "12345"
    assert one(spark, "", S.series_number) == "NO_SERIES_NUMBER"
    assert one(spark, "a/../b  c__", lambda c: S.sanitize(c, "x")) == "a_b_c"
    assert one(spark, None, S.safe_name) == "unknown"
    assert one(spark, "wadors:https://h/s/1/frames/3/x", S.normalize_url) == "https://h/s/1/x"
    assert one(spark, 1536, S.format_bytes, "long") == "1.5 KB"
    assert one(spark, 61_500, S.format_duration, "long") == "1m 2s"
    assert one(spark, "093Y", S.age) == "090Y"
    assert one(spark, "047Y", S.age) == "045Y"
    assert one(spark, "abc", S.age) == "abc"
    assert one(spark, "20240231", lambda c: S.shift_date(c, F.lit(3))) == ""
    assert one(spark, "2024-01-31", lambda c: S.shift_date(c, F.lit(1))) == "20240201"


def test_label_adjacency_against_a_loop(spark):
    rng, rows, want = random.Random(1), [], {}
    for frame in range(60):
        chain = False
        for i in range(12):
            label, keep, safe, linked = (rng.random() < p for p in (0.2, 0.8, 0.1, 0.7))
            rows.append((frame, i, 10 * i if linked else 10 * i, 0 if linked else 100 * (i % 2 + 1) + 1000 * i, 5, label, keep, safe))
        prev = None
        for r in [r for r in rows if r[0] == frame]:
            near = prev is not None and abs(r[3] - prev[3]) <= 15 and r[2] > prev[2] and r[2] - (prev[2] + prev[4]) <= 50
            hit = bool(chain and near and r[6] and not r[7] and not r[5])
            want[frame, r[1]] = hit
            chain, prev = r[5] or hit, r
    df = spark.createDataFrame(rows, "frame int, seq int, x int, y int, w int, label boolean, keep boolean, safe boolean")
    assert {(r.frame, r.seq): r.redact for r in phi.label_adjacency(df).collect()} == want


def test_run_length_frames():
    rng = random.Random(2)
    for n in (0, 2, 64, 1000):
        data = bytes(rng.choice((0, 0, 0, 7, rng.randrange(256))) for _ in range(n))
        assert codec.decode_rle(codec.encode_rle(data, 2), n) == data if n else True
        assert codec.unpack_bits(codec.pack_bits(data), n) == data
    for width, samples in ((1, 1), (2, 1), (1, 3), (2, 3)):
        data = bytes(rng.choice((5, 5, 5, rng.randrange(256))) for _ in range(60 * width * samples))
        packed = codec.encode_rle(data, width, samples)
        assert codec.decode_rle(packed, len(data), width, samples) == data
        assert int.from_bytes(packed[:4], "little") == width * samples and len(packed) % 2 == 0
        # the first segment is the high byte of the first sample
        first = codec.unpack_bits(packed[64:], 60)
        assert first == bytes(data[i * width * samples + width - 1] for i in range(60))
    with pytest.raises(ValueError):
        codec.decode_rle(b"short", 4)


def test_null_frames(spark):
    df = spark.createDataFrame([(None,), (bytearray(b"aaab"),)], "b binary").select(codec.rle("b").alias("r"), "b")
    got = df.select(codec.unrle("r", F.lit(4)).alias("u")).collect()
    assert [None if r.u is None else bytes(r.u) for r in got] == [None, b"aaab"]


def test_removed_sequence_takes_its_items(spark):
    attrs = spark.createDataFrame([("i", "00400275", "00400275", "SQ", None, "s"), ("i", "00400275[0].00100020", "00100020", "LO", "P", "s"), ("i", "00100020", "00100020", "LO", "P", "s")], "instance_id string, path string, tag string, vr string, value string, subject string")
    rules = spark.createDataFrame([("00400275", "@remove()"), ("00100020", "@ptid")], "tag string, rule string")
    got = {r.path: (r.action, r.new_value) for r in deid.apply_rules(attrs, rules, deid.Options("key")).collect()}
    assert got == {"00400275": ("remove", None), "00100020": ("patient", "ANON")}


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{f}')")
    df = registry.QUERIES[name](spark, SF)
    cur = con.execute(registry.ORACLES[name])
    names = [d[0] for d in cur.description]
    mine = sorted("|".join(f"{r[c]:.9g}" if isinstance(r[c], float) else str(r[c]) for c in sorted(names)) for r in df.collect())
    at = [names.index(c) for c in sorted(names)]
    theirs = sorted("|".join(f"{float(r[i]):.9g}" if isinstance(r[i], float) else str(r[i]) for i in at) for r in cur.fetchall())
    assert sorted(df.columns) == sorted(names) and mine == theirs


def test_fuzzy_pairs_against_every_pair(spark):
    rng = random.Random(6)
    known = ["", "AB", "ABCD"] + ["".join(rng.choices("AB1", k=rng.randint(2, 9))) for _ in range(60)]
    tokens = ["", "ABC", "A" * 40] + ["".join(rng.choices("AB1", k=rng.randint(1, 14))) for _ in range(150)]
    a, b = spark.createDataFrame([(x,) for x in known], "a string"), spark.createDataFrame([(x,) for x in tokens], "b string")
    want = {tuple(r) for r in a.crossJoin(b).where(phi.fuzzy(F.col("a"), F.col("b"))).distinct().collect()}
    got = [tuple(r) for r in phi.fuzzy_pairs(a, b).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 100


@pytest.mark.parametrize("letters", ["AB", "AB1", "ABCÄ"])
def test_fuzzy_counts_against_every_pair(spark, monkeypatch, letters):
    """Counts without pairs, in several portions: equal and other lengths, runs and alternating letters."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choices(letters, k=rng.choice([2, 3, 4, 5, 6, 7, 8, 12])))
    known = ["", "AB", "ABABABAB"] + [word() for _ in range(100)] + ["XX" + word() for _ in range(20)]
    tokens = {word(): rng.randint(1, 9) for _ in range(150)} | {k: rng.randint(1, 5) for k in known[:60]} | {"A" * 40: 1, "BABABABA": 2}
    a, b = spark.createDataFrame([(x,) for x in [*known, None]], "a string"), spark.createDataFrame([*tokens.items(), (None, 1)], "b string, n long")
    every = a.distinct().crossJoin(b).where(phi.fuzzy(F.col("a"), F.col("b"))).groupBy("a").agg(F.count(F.lit(1)), F.sum("n"))
    monkeypatch.setattr(fuzzy, "PORTION", 2000)
    assert sorted(map(tuple, fuzzy.fuzzy_counts(a, b).collect())) == sorted(map(tuple, every.collect()))


@pytest.mark.parametrize("query", ["phi_fuzzy_known_values", "phi_fuzzy_document_tokens"])
def test_fuzzy_queries_exchange_no_pairs(spark, tmp_path, query):
    """Numbered names are nearly all similar: 3,000 have 1,500,000 pairs and more, which no stage may hold."""
    spark.range(3000).selectExpr("id AS c_custkey", "format_string('Customer#%09d', id) AS c_name").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(3000).selectExpr("id AS doc_id", "format_string('of Customer#%09d', id) AS text").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    df = registry.QUERIES[query](spark, str(tmp_path))
    got = {r.known: r[1] for r in df.collect()}
    names = [f"{i:04d}" for i in range(3000)]
    near = lambda x, y: sum(p != q for p, q in zip(x, y)) <= 2 or any(x[:i] + x[i + 1 :] == y[:j] + y[j + 1 :] for i in range(4) for j in range(4))
    assert len(got) == 3000 and all(got[k] == sum(near(names[k], y) for y in names) for k in (0, 1234, 2999))
    assert not any(s in df._jdf.queryExecution().toString() for s in ("levenshtein", "CartesianProduct", "BroadcastNestedLoopJoin"))


def test_fuzzy_document_tokens_takes_every_customer(spark, tmp_path):
    spark.createDataFrame([(i, f"Customer#{i:09d}") for i in range(1, 41)], "c_custkey long, c_name string").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(1, "Seen: customer#000000007, twice customer#000000007"), (2, None), (3, "xCustomer#000000033x other")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.known: (r.n_values, r.n_tokens) for r in registry.QUERIES["phi_fuzzy_document_tokens"](spark, str(tmp_path)).collect()}
    assert set(got) == set(range(1, 41)) and got[7] == (1, 2) and got[33] == (2, 3)


def test_tag_whitelist_of_large_keys_against_sql(spark, tmp_path):
    keys = [0, 7, 65535, 65536, 65537, 0x00100010, 0x00100011, 0x0FFFFFFF]
    spark.createDataFrame([(k,) for k in keys], "p_partkey long").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    want = duckdb.connect().execute(registry.ORACLES["tag_whitelist"].replace("FROM part", f"FROM read_parquet('{tmp_path}/part.parquet/*.parquet')")).fetchall()
    assert sorted(map(tuple, registry.QUERIES["tag_whitelist"](spark, str(tmp_path)).collect())) == sorted(want)
    texts, rules = spark.createDataFrame([(1, "0009,1001 00091001 00100010 00100011")], "id long, text string"), spark.createDataFrame([("00100010", "Name")], "tag string, name string")
    names = {r.tag: r.name for r in deid.whitelist_rows(texts, rules).collect()}
    assert names == {"00091001": "Private Attribute (Vendor Specific)", "00100010": "Name", "00100011": "Unknown DICOM Attribute"}


def walk(spark, rows, rules, **options):
    attrs = spark.createDataFrame([("i", p, p[-8:], vr, v) for p, vr, v in rows], "instance_id string, path string, tag string, vr string, value string")
    out = deid.apply_rules(attrs, spark.createDataFrame(rules, "tag string, rule string"), deid.Options("key", **options))
    return {r.path: (r.action, r.new_value) for r in out.collect()}


def test_nothing_personal_stays(spark):
    rows = [("00100010", "PN", "A^B"), ("00100030", "DA", "19800101"), ("00080050", "SH", "ACC9876"), ("00080016", "UI", "1.2.840.1"), ("00080018", "UI", "1.2.3"), ("00104000", "LT", "x"), ("00020016", "AE", "SITE"), ("00020002", "UI", "1.2")]
    rules = [("00100010", "@ptid"), ("00100030", "@birthdate"), ("00080050", "@acc"), ("00080016", ""), ("00080018", "@remove()"), ("00104000", "@some(new, rule)")]
    got = walk(spark, rows, rules)
    assert got["00100010"] == ("name", "ANONYMOUS") and got["00100030"] == ("birthdate", "") and got["00080050"] == ("accession", "")
    assert got["00080016"] == ("keep", "1.2.840.1") and got["00080018"][0] == "uid" and got["00080018"][1].startswith("2.25.1")
    assert got["00104000"] == ("remove", None) and got["00020016"] == ("remove", None) and got["00020002"] == ("keep", "1.2")
    with pytest.raises(ValueError):
        S.keyed_hash(F.lit("x"), "")


def test_options_keep_classes(spark):
    rows = [("00080090", "PN", "Doc"), ("00180050", "DS", "1"), ("00204000", "LT", "c"), ("60003000", "OW", "x"), ("50003000", "OW", "x"), ("0008103E", "LO", "s"), ("00181030", "LO", "p"), ("00081010", "SH", "d"), ("00080080", "LO", "h"), ("00101010", "AS", "093Y"), ("00080030", "TM", "10"), ("00080020", "DA", "2024-01-31"), ("00100040", "CS", "F"), ("00091001", "LO", "x"), ("00091001", "LO", "x")]
    rules = [("00080090", "@remove()"), ("00180050", "@remove()"), ("00204000", "@remove()"), ("0008103E", "@keepseriesdescriptor"), ("00181030", "@keepprotocolname"), ("00081010", "@device"), ("00080080", "@institution"), ("00101010", "@age"), ("00080030", ""), ("00080020", "@hashdate"), ("00100040", "@characteristic")]
    kept = dict(keepPhysicians=True, keepAcquisitionParameters=True, keepComments=True, keepOverlays=True, keepCurves=True, keepSeriesDescriptors=True, keepProtocolName=True, keepDeviceIdentity=True, keepInstitutionIdentity=True, keepPatientCharacteristics=True, keepExactTimes=True, keepDates=True, newPatientSex="O", privateTags="keep_all")
    got = walk(spark, rows, rules, **kept)
    assert got["00101010"] == ("age", "090Y") and got["00100040"] == ("replace", "O") and got["00080020"] == ("keep", "20240131")
    assert all(a == "keep" for p, (a, _) in got.items() if p not in ("00101010", "00100040"))
    assert {a for a, _ in walk(spark, rows, rules).values()} == {"remove", "shift"}


def test_whitelisted_sequence_stays_whole(spark):
    rows = [("00400275", "SQ", "1"), ("00400275[0].00100010", "PN", "A^B"), ("00400555", "SQ", "0")]
    got = walk(spark, rows, [("00400275", "@remove()"), ("00100010", "@ptid"), ("00400555", "@empty()")], whitelist="0040-0275; junk")
    assert got == {"00400275": ("keep", "1"), "00400275[0].00100010": ("keep", "A^B"), "00400555": ("empty", "")}


def test_contributing_equipment(spark):
    rows = [("0018A001", "SQ", "1"), ("0018A001[0].00080070", "LO", "maker")]
    got = walk(spark, rows, [("0018A001", ""), ("00080070", "")], addContributingEquipment=True)
    assert got["0018A001[1].0040A170[0].00080100"] == ("add", "109104") and got["0018A001"] == ("recurse", "1")
    got = walk(spark, rows, [("0018A001", "@remove()")], addContributingEquipment=True)
    assert got["0018A001"][0] == "add" and "0018A001[0].0018A003" in got


def test_keyed_hash_is_hmac(spark):
    import hashlib
    import hmac

    for secret in ("k", "k" * 64, "long " * 30):
        assert one(spark, "1.2.3", lambda c: S.keyed_hash(c, secret)) == hmac.new(secret.encode(), b"1.2.3", hashlib.sha256).hexdigest()  # noqa: B023
    days = lambda x: one(spark, x, lambda c: S.day_offset(c, "k"))
    assert days(None) == days("") == days(" UNKNOWN ") != 0 and -1825 <= days("x") <= 1825


@pytest.mark.parametrize("text", ["5.2 CM", "120 KVP", "LIVER", "AP", "MI 1.2", "", None])
def test_safe_tokens_are_kept(spark, text):
    df = spark.createDataFrame([("i", 0, 0, 0, 10, text)], "instance_id string, frame int, x int, y int, w int, text string")
    assert [(r.score, r.decision) for r in phi.classify(df).collect()] == [(0, "keep")]


def test_findings_near_labels_and_metadata(spark):
    rows = [(0, 0, 40, "Name:"), (50, 3, 40, "Xavier"), (100, 6, 40, "Ypsilon"), (200, 6, 40, "far"), (0, 40, 40, "Jos\u00e9"), (0, 80, 40, "plain")]
    df = spark.createDataFrame([("i", 0, x, y, w, t) for x, y, w, t in rows], "instance_id string, frame int, x int, y int, w int, text string")
    known = spark.createDataFrame([("i", ["JOSE"])], "instance_id string, known array<string>")
    got = {r.text: (r.score, r.decision) for r in phi.classify(df, known).collect()}
    assert got == {"Name:": (85, "redact"), "Xavier": (90, "redact"), "Ypsilon": (90, "redact"), "far": (0, "keep"), "Jos\u00e9": (100, "redact"), "plain": (0, "keep")}


def test_unicode_forms(spark):
    assert one(spark, "\u00c9l\u00e8ve \uff11", lambda c: phi.normalized(c)) == "ELEVE1"
    assert one(spark, "\uff21\u3000b", lambda c: S.sanitize(c, "x")) == "A_b"


def test_files_round_trip(spark):
    from silvercask.sources import part10

    rows = [("00080018", "00080018", "UI", "1.2.3", None), ("00100010", "00100010", "PN", "A^B", None), ("00280010", "00280010", "US", "512\\7", None), ("00400555", "00400555", "SQ", "2", None), ("00400555[0].00400555", "00400555", "SQ", "1", None), ("00400555[0].00400555[0].0040A160", "0040A160", "UT", "inner", None), ("00400555[1].00091001", "00091001", "UN", None, b"\1\2\3\4"), ("7FE00010", "7FE00010", "OB", "0\\4", b"abcd")]
    data = part10.build(rows)
    got = {p: (vr, v, b) for p, _, vr, v, b in part10.parse(data)}
    for p, _, vr, v, b in rows:
        assert got[p] == (vr, v, b)
    assert got["00020010"][1] == part10.EXPLICIT and got["00020003"][1] == "1.2.3"
    files = spark.createDataFrame([("a", bytearray(data)), ("b", bytearray(data[:150])), ("c", bytearray(b"no")), ("d", None)], "path string, content binary")
    read = part10.read_attributes(files)
    assert {r.instance_id for r in read.where("error is not null").collect()} == {"b", "c", "d"}
    assert [tuple(r) for r in part10.headers(read.where("error is null")).collect()] == [("a", "1.2.3", None, None)]


def test_archives(spark, tmp_path):
    import datetime
    import io
    import zipfile

    from silvercask.operators import archive

    ts = datetime.datetime(1979, 5, 6, 7, 8, 9)
    files = spark.createDataFrame([(1, "b/x", bytearray(b"xx"), ts), (1, "a", None, None), (1, "a", bytearray(b"later"), ts), (2, None, bytearray(b"z"), ts)], "archive int, path string, data binary, ts timestamp")
    got = {r.archive: zipfile.ZipFile(io.BytesIO(bytes(r.zip))) for r in archive.archives(files).collect()}
    assert got[1].namelist() == ["a", "b/x"] and got[1].read("b/x") == b"xx" and got[1].read("a") == b""
    assert got[1].infolist()[1].compress_type == zipfile.ZIP_STORED and got[1].infolist()[1].date_time[0] == 1980
    written = archive.write_files(files.where("archive = 1 and path = 'b/x'"), str(tmp_path)).collect()
    assert [(r.path, r.bytes) for r in written] == [("b/x", 2)] and (tmp_path / "b" / "x").read_bytes() == b"xx"


@pytest.mark.parametrize("rows", [3, 100_000])
def test_running_sums_in_ranges(spark, rows, monkeypatch):
    from silvercask.operators import archive

    monkeypatch.setattr(archive, "RANGE", rows)
    rng = random.Random(3)
    data = [(g, i * 7 - 50, rng.randint(0, 9)) for g in ("a", None) for i in range(40)]
    rng.shuffle(data)
    got = {(r.g, r.k): (r._sum, r._count) for r in archive.running(spark.createDataFrame(data, "g string, k long, bytes long"), "g", "k").collect()}
    for g, k, _ in data:
        assert got[g, k] == (sum(b for h, x, b in data if h == g and x <= k), sum(h == g and x <= k for h, x, _ in data))


def test_rule_files(spark, tmp_path):
    from silvercask.sources import rules

    (tmp_path / "r.json").write_text('{"00100010": {"name": "PatientName", "rule": "@ptid"}, "00080020": "@hashdate"}')
    (tmp_path / "r.script").write_text('<script>\n <e en="T" t="00100010" n="PatientName">@ptid</e>\n <e en="F" t="00080005" n="Set"></e>\n <r>x</r>\n</script>')
    (tmp_path / "c.json").write_text('{"studies": [{"StudyInstanceUID": "1.2", "series": []}]}')
    assert {tuple(r) for r in rules.json_rules(spark, str(tmp_path / "r.json")).collect()} == {("00100010", "PatientName", "@ptid"), ("00080020", "Unknown", "@hashdate")}
    assert {tuple(r) for r in rules.script_rules(spark, str(tmp_path / "r.script")).collect()} == {("00100010", "PatientName", "@ptid"), ("00080005", "Set", "")}
    assert [r.study for r in rules.captured_studies(spark, str(tmp_path / "c.json")).collect()] == ["1.2"]


def test_streamed_attributes_are_as_in_a_batch(spark, tmp_path):
    from silvercask.streaming.ingest import deidentify_stream

    schema = "instance_id string, path string, tag string, vr string, value string, subject string"
    attrs = spark.createDataFrame([(str(i), "00080018", "00080018", "UI", f"1.2.{i}", "s") for i in range(5)], schema)
    attrs.write.parquet(str(tmp_path / "in"))
    rules, options = spark.createDataFrame([("00080018", "@uid")], "tag string, rule string"), deid.Options("key")
    deidentify_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), rules, options, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    want = {(r.path, r.new_value) for r in deid.apply_rules(attrs, rules, options).collect()}
    assert {(r.path, r.new_value) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == want


def test_collision_names_pass_over_taken_ones(spark):
    from silvercask.operators import manifest

    rows = spark.createDataFrame([("p", "a", "X", 1), ("p", "b", "X", 2), ("p", "c", "X_DUP02", 3), ("p", "d", "X", 4)], "parent string, key string, base string, seq long")
    got = {r.key: r.name for r in manifest.distinct_names(rows, ["parent"], "key", "base", "seq").collect()}
    assert got == {"a": "X", "b": "X_DUP03", "c": "X_DUP02", "d": "X_DUP04"}


def test_masks_and_text_in_frames():
    import numpy as np

    from silvercask.operators import pixels

    frame = pixels.drawn("PATIENT 42", 2, 160, 480)
    image = pixels.Image(160, 480)
    boxes = pixels.find_text(pixels.rendered(frame, image))
    assert "".join(b.text for b in boxes) == "PATIENT42"
    after = pixels.masked(frame, image, [(b.x, b.y, b.w, b.h) for b in boxes])
    assert not after.any() and pixels.find_text(pixels.rendered(after[:, :, 0], image)) == []
    low = pixels.Image(4, 4, photometric="MONOCHROME1", bits=16, stored=12)
    out = pixels.masked(np.zeros((4, 4), np.uint16), low, [(1, 1, 0, 0)], margin=1, color="double", width=1)[:, :, 0]
    assert out[:3, :3].tolist() == [[4095] * 3] * 3 and out[3, 3] == 0
    assert pixels.is_contour(np.ones((10, 40), np.uint8)) and not pixels.is_contour(np.tile([1, 1, 0, 0, 0], (10, 8)).astype(np.uint8))
    with pytest.raises(ValueError):
        pixels.Image(4, 4, bits=12)


@pytest.mark.parametrize("query", ["micro_ocr", "redacted_frames"])
def test_frames_are_dealt_to_all_cores(spark, query):
    assert registry.QUERIES[query](spark, SF).rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism


def test_text_is_found_in_brightness_as_in_colours():
    rng = np.random.default_rng(3)
    for photometric, center in (("MONOCHROME2", None), ("MONOCHROME1", None), ("MONOCHROME2", 90.0)):
        image = pixels.Image(128, 512, photometric=photometric, center=center, width=150.0)
        frame = np.maximum(pixels.drawn("NAME42", 2), rng.integers(0, 40, (128, 512), np.uint8))
        frame = 255 - frame if photometric == "MONOCHROME1" else frame
        assert (pixels.rendered(frame, image) == pixels.brightness(frame, image)[:, :, None]).all()
        assert pixels.find_text(pixels.seen(frame, image)) == pixels.find_text(pixels.rendered(frame, image))


def test_report(spark):
    from silvercask.operators import report

    failed = spark.createDataFrame([("s1", "1", "d", "HTTP 500", 1, "3", "1.2", "dcm"), ("s1", "1", "d", "", 2, "", "1.3", "dcm")], "series string, number string, description string, error string, seq long, instance string, sop string, extension string")
    notes = spark.createDataFrame([("1.2.dcm: face",)], "entry string")
    log = spark.createDataFrame([(1, "error", "a"), (2, "info", "b")], "ts long, type string, message string")
    text = report.run_report({"done": 3, "failed": 2, "total": 5, "total_bytes": 2048, "duration_ms": 61_000}, failed, notes, log, "run")
    for line in ("Outcome:     Completed with failures", "Volume:      2.0 KB", "Duration:    1m 1s", "image set 1 — d — 2 file(s) missing", "    1× HTTP 500", "    image set 1 — d · 1.3.dcm: Unknown download error", "[2] INFO: b"):
        assert line in text.split("\n")


def test_fetch_retries_and_classifies():
    from silvercask.sources import fetch

    slept = []

    def server(*answers):
        left = list(answers)

        def get(url, accept):
            a = left.pop(0)
            if isinstance(a, OSError):
                raise a
            return a

        return get

    ok = (200, {"content-type": "application/dicom; x=1"}, b"data")
    run = lambda *answers: fetch.fetch_one("http://h", None, "dcm", server(*answers), 2, slept.append)
    assert run((503, {"retry-after": "3"}, b""), OSError("failed"), ok) == (b"data", None, None, 200, 3) and slept == [3.0, 1.0]
    assert run((404, {}, b""))[1:] == ("HttpError", "HTTP 404", 404, 1)
    assert run((302, {}, b""))[1] == "SessionExpired" and run((200, {"content-type": "text/html"}, b""))[1] == "PayloadValidation"
    assert run(*[(500, {}, b"")] * 3)[1:] == ("HttpError", "HTTP 500", 500, 3)
    assert fetch.wait_ms(9, None, 0) == 30_000 and fetch.wait_ms(1, "Thu, 01 Jan 1970 00:00:05 GMT", 2) == 3000 and fetch.wait_ms(2, "soon", 0) == 1000
    assert fetch.fetch_one(None, None, "dcm")[1] == "Source"


def test_export_from_end_to_end(spark, tmp_path):
    from silvercask.operators import job
    from silvercask.sources import part10

    def make(i, extra=()):
        return part10.build([("00080018", "00080018", "UI", f"1.2.{i}", None), ("0020000D", "0020000D", "UI", "1.1", None), ("0020000E", "0020000E", "UI", "1.1.1", None), ("00100010", "00100010", "PN", "A^B", None), ("00100020", "00100020", "LO", "P1", None), *extra])

    contents = {1: make(1), 2: make(9), 3: b"junk", 4: make(4, [("00420011", "00420011", "OB", None, b"%PDF")]), 5: None}
    rows = []
    for i, data in contents.items():
        if data is not None:
            (tmp_path / f"{i}").write_bytes(data)
        rows.append(("1.1", "1.1.1", f"1.2.{i}", None, str(tmp_path / f"{i}"), "dcm", "P", "S", "R"))
    items = spark.createDataFrame(rows, "study string, series string, sop string, url string, path string, extension string, patient_dir string, study_dir string, series_dir string")
    rules = spark.createDataFrame([("00080018", "@uid"), ("0020000D", "@uid"), ("0020000E", "@uid"), ("00100010", "@ptid"), ("00100020", "@ptid")], "tag string, rule string")
    run = lambda some: {r.sop: r for r in job.export(some, rules, deid.Options("key"), str(tmp_path / "out"), str(tmp_path / "work")).collect()}
    got = run(items)
    assert {k: (r.error or "ok").split(":")[0] for k, r in got.items()} == {"1.2.1": "ok", "1.2.2": "Payload mismatch", "1.2.3": "Payload unreadable", "1.2.4": "UnsafePayload", "1.2.5": "File"}
    back = {p: v for p, _, _, v, _ in part10.parse((tmp_path / "out" / got["1.2.1"].file).read_bytes())}
    assert back["00100010"] == "ANONYMOUS" and back["00080018"].startswith("2.25.") and back["00020003"].startswith("2.25.")
    (tmp_path / "5").write_bytes(make(5))
    (tmp_path / "1").unlink()  # what is written is not fetched again
    again = run(items)
    assert again["1.2.1"].error is None and again["1.2.5"].error is None
    with pytest.raises(job.NothingSaved):
        job.export(items.where("sop = '1.2.3'"), rules, deid.Options("key"), str(tmp_path / "out2"), str(tmp_path / "work2"))
    assert job.deviations(job.preset("retain_dates", "k")) == ["keepPhysicians", "keepDescriptors", "keepExactTimes", "keepDates"] and job.deviations(job.preset("strict", "k")) == []


def test_method_codes():
    assert [c for c, _ in deid.method_codes(deid.Options("k"))] == ["113100", "113107"]
    assert [c for c, _ in deid.method_codes(deid.Options("k", keepDates=True, remapUids=False, privateTags="keep_safe", structuredContent="sanitize"))] == ["113100", "113106", "113110", "113111", "113104"]


def test_whole_instances_are_walked_as_their_rows_are(spark):
    rows = [("00080018", "UI", "1.2.3"), ("00081140", "SQ", "1"), ("00081140[0].00081155", "UI", "1.3"), ("00081140[0].00100010", "PN", "A^B"), ("00090010", "LO", "V"), ("00091001", "LO", "listed"), ("00091002", "LO", "not"), ("00100020", "LO", " P "), ("00080020", "DA", "2024-01-31"), ("00400275", "SQ", None), ("00400275[0].00100020", "LO", "P"), ("00400555", "SQ", "0"), ("00400555[0].00100020", "LO", "P"), ("0040A730", "SQ", "2"), ("0040A730[0].0040A040", "CS", "ODD"), ("0040A730[0].00080104", "SQ", "1"), ("0040A730[0].00080104[0].00080100", "SH", "x"), ("0040A730[1].0040A160", "UT", "found"), ("00189999", "LO", "no rule")]
    rules = spark.createDataFrame([("00080018", "@uid"), ("00081140", "@remove()"), ("00081155", "@uid"), ("00100010", "@ptid"), ("00100020", " @ptid "), ("00080020", "@hashdate"), ("00400275", "@remove()"), ("00400555", "@remove()"), ("0040A730", ""), ("00080100", "@keep")], "tag string, rule string")
    safe = spark.createDataFrame([("V", "0009", 1, 1)], "creator string, grp string, lo int, hi int")
    whole = spark.createDataFrame([(str(i), [(p, p[-8:], v, x) for p, v, x in rows[i:]]) for i in range(6)], "instance_id string, attributes array<struct<path:string,tag:string,vr:string,value:string>>")
    table = whole.selectExpr("instance_id", "inline(attributes)")
    for some in ({}, {"structuredContent": "sanitize"}, {"privateTags": "keep_safe"}, {"preserveUidReferences": False, "whitelist": "00400275"}):
        outs = [deid.apply_rules(a, rules, deid.Options("key", **some), safe) for a in (table, whole)]
        first, second = (sorted(map(repr, df.select(sorted(df.columns)).collect())) for df in outs)
        assert first == second and len(first) > 60
        assert "instance_id" not in "".join(x for x in outs[1]._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in x)


def test_a_keyed_hash_is_worked_out_once(spark):
    for c in (S.mapped_uid(F.col("x"), "key"), S.day_offset(F.col("x"), "key")):
        assert str(c).count("sha2(") == 2


def test_manifest_is_exchanged_once(spark):
    from silvercask.operators import manifest

    end = "1111111111222222222233333333"
    rows = [
        ("1." + end, "1.5", "1.2.1", 1, "u", 7), ("1." + end, "1.5", "1.2.1", 2, "u", 8), ("2." + end, "1.6", "1.2.2", 0, "u", 1),
        ("2." + end, "3." + end, "1.2.3", 5, "u", 2), ("2." + end, "4." + end, "1.2.4", 4, "u", 2), ("2." + end, "4." + end, "bad", 3, "u", 9),
        (None, "", "1.2.5", 9, "u", None), ("study", "series", "1.2.6", 8, "u", 3), ("", None, "1.2.6", 7, "u", 3), ("9", "9", "", 1, "", 1), ("9", "9", None, 2, None, 1), ("9", "9", "instance-0", 3, "", 1),
        ("8", "8", None, 1, "1.2.7", 1), ("8", "8", "1.2.7", 2, "1.2.7", 1), ("7", "7", "", 1, "https://h?objectUID=1.2.8&frame=3", 4), ("7", "7", "1.2.8", 2, "https://h?objectUID=1.2.8", 5),
    ]
    df = spark.createDataFrame(rows, "study string, series string, sop string, seq long, url string, number int").selectExpr("*", "true as has_file", "false as from_frames", "cast(null as string) as patient_id", "' P ' as patient_name")
    out = manifest.manifest(df)
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
    got = {(r.study, r.series, r.sop, r.seq): (r.patient_dir, r.study_dir, r.series_dir, r.patient_name) for r in out.collect()}
    one, two = "Patient_" + end, "Study_" + end
    assert got == {
        ("1." + end, "1.5", "1.2.1", 1): (one, two + "_DUP02", "Series_007_1.5", "P"), ("2." + end, "1.6", "1.2.2", 0): (one, two, "Series_001_1.6", "P"),
        ("2." + end, "3." + end, "1.2.3", 5): (one, two, "Series_002_" + end + "_DUP02", "P"), ("2." + end, "4." + end, "1.2.4", 4): (one, two, "Series_002_" + end, "P"),
        ("study", "series", "1.2.5", 9): ("Patient_study", "Study_study", "Series_003_series", "P"), ("study", "series", "1.2.6", 8): ("Patient_study", "Study_study", "Series_003_series", "P"),
        ("study", "series", "1.2.6", 7): ("Patient_study", "Study_study", "Series_003_series", "P"), ("7", "7", "1.2.8", 1): ("Patient_7", "Study_7", "Series_004_7", "P"),
    }
