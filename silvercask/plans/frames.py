"""Queries over frames, representations and files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import codec, pixels
from ..operators import records as R
from ..sources import part10
from .base import query, spread, table


@query("SELECT l_orderkey, l_linenumber, len(list_filter(range(0, CAST(l_quantity AS BIGINT)), lambda f: f % 20 = 0 OR f = CAST(l_quantity AS BIGINT) // 2 OR f = CAST(l_quantity AS BIGINT) - 1)) AS frames FROM lineitem")
def frame_sampling(spark, sf):
    n = F.col("l_quantity").cast("int")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.size(codec.sampled_frames(n)).cast("long").alias("frames"))


@query("SELECT l_orderkey, l_linenumber, greatest(0, l_suppkey % 500 - 4)::INT AS x0, greatest(0, l_partkey % 500 - 4)::INT AS y0, least(511, l_suppkey % 500 + 24)::INT AS x1, least(511, l_partkey % 500 + 14)::INT AS y1 FROM lineitem")
def mask_geometry(spark, sf):
    m = codec.mask(F.col("l_suppkey") % 500, F.col("l_partkey") % 500, F.lit(20), F.lit(10), F.lit(512), F.lit(512))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", m.alias("m")).select("l_orderkey", "l_linenumber", "m.*")


@query("SELECT doc_id, sha256(coalesce(text, '')) AS sha FROM documents")
def rle_roundtrip(spark, sf):
    b = F.coalesce("text", F.lit("")).cast("binary")
    d = table(spark, sf, "documents").select("doc_id", b.alias("b"))
    return d.select("doc_id", F.sha2(codec.unrle(codec.rle("b"), F.octet_length("b")), 256).alias("sha"))


_PIXELS = "CASE p_size % 4 WHEN 0 THEN 8 WHEN 1 THEN 16 WHEN 2 THEN 12 ELSE 8 END AS bits, CASE WHEN p_size % 3 = 0 THEN 3 ELSE 1 END AS samples, CASE p_size % 5 WHEN 0 THEN 'MONOCHROME1' WHEN 1 THEN 'RGB' WHEN 2 THEN 'YBR_FULL' ELSE 'monochrome2' END AS photometric, CASE p_size % 3 WHEN 0 THEN '1.2.840.10008.1.2.1' WHEN 1 THEN '1.2.840.10008.1.2.5' ELSE '1.2.840.10008.1.2.4.50' END AS syntax"


@query(f"""SELECT p_partkey, bits IN (8, 16) AND photometric <> 'YBR_FULL' AS supported, pow(2, bits) - 1 AS most, CASE WHEN p_partkey % 7 = 0 THEN CAST(p_size AS DOUBLE) WHEN photometric = 'MONOCHROME1' THEN pow(2, bits) - 1 ELSE 0.0 END AS fill, CASE WHEN p_partkey % 2 = 0 THEN 3 WHEN p_partkey % 3 = 0 THEN 2 ELSE 0 END AS border,
 CASE WHEN syntax LIKE '%.1.2.1' THEN '1.2.840.10008.1.2.1' WHEN p_partkey % 5 = 0 THEN '1.2.840.10008.1.2.1' WHEN syntax LIKE '%.5' THEN syntax WHEN samples = 1 OR bits = 8 THEN '1.2.840.10008.1.2.5' ELSE '1.2.840.10008.1.2.1' END AS output,
 CASE WHEN bits % 8 <> 0 THEN NULL ELSE 10 * p_size * samples * (bits // 8) * greatest(1, p_partkey % 4) END AS bytes, p_partkey % 3 <> 2 AS burned FROM (SELECT *, {_PIXELS} FROM part)""")
def pixel_rules(spark, sf):
    i, k = F.col("p_size"), F.col("p_partkey")
    bits = F.when(i % 4 == 0, 8).when(i % 4 == 1, 16).when(i % 4 == 2, 12).otherwise(8)
    samples = F.when(i % 3 == 0, 3).otherwise(1)
    photometric = F.when(i % 5 == 0, "MONOCHROME1").when(i % 5 == 1, "RGB").when(i % 5 == 2, "YBR_FULL").otherwise("monochrome2")
    syntax = F.when(i % 3 == 0, "1.2.840.10008.1.2.1").when(i % 3 == 1, "1.2.840.10008.1.2.5").otherwise("1.2.840.10008.1.2.4.50")
    burned = F.when(k % 3 == 0, " yes").when(k % 3 == 1, "1").otherwise("NO")
    from ..operators.deid import burned_in

    return table(spark, sf, "part").select(
        "p_partkey", R.supported_pixels(bits, samples, photometric).alias("supported"), R.max_stored(bits).alias("most"), R.fill_value(F.when(k % 7 == 0, i), photometric, bits).alias("fill"),
        R.border_width(F.when(k % 3 == 0, "RED").otherwise("none"), F.when(k % 2 == 0, 3)).alias("border"), R.output_syntax(syntax, syntax == R.RLE, samples, bits, k % 5 == 0).alias("output"),
        R.expected_bytes(F.lit(10), i, samples, bits, k % 4).alias("bytes"), burned_in(burned).alias("burned"),
    )


@query("""SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN CASE WHEN p_partkey % 2 = 0 THEN 'SS' ELSE 'US' END WHEN 1 THEN 'SS' WHEN 2 THEN 'OW' WHEN 3 THEN 'US' WHEN 4 THEN 'PN' ELSE 'CS' END AS vr, CASE WHEN p_size % 6 = 5 THEN 2 ELSE 1 END AS n FROM part""")
def vr_resolution(spark, sf):
    """Ambiguous words by sign and content, unknown ones by the dictionary, texts of several values split."""
    i = F.col("p_size") % 6
    pick = lambda *xs: F.element_at(F.array(*map(F.lit, xs)), (i + 1).cast("int"))
    attrs = table(spark, sf, "part").select(F.col("p_partkey").alias("instance_id"), pick("00280120", "00280106", "7FE00010", "00281200", "00100010", "00080008").alias("path"), pick("xs", "US|SS", "lt", "US|OW", "UN", "CS").alias("vr"), pick("5", "1\\-3", "", "7", "A^B", "A\\B").alias("value"), (i == 2).alias("is_binary"), (F.col("p_partkey") % 2 == 0).cast("int").alias("signed"))
    attrs = attrs.withColumn("tag", F.col("path"))
    names = spark.createDataFrame([("00100010", "PN", "1"), ("00080008", "CS", "2-n")], "tag string, dict_vr string, vm string")
    return R.with_resolved_vrs(attrs, names).select(F.col("instance_id").alias("p_partkey"), "vr", F.size("values").alias("n"))


@query("""SELECT p_partkey, action, vr, CASE WHEN action = 'write' THEN CASE WHEN kind = 'none' THEN 0 WHEN vr = 'LO' THEN length(v) ELSE length(v) + length(v) % 2 END END AS size FROM (SELECT p_partkey, v, kind,
 CASE WHEN nested THEN 'drop' WHEN kind = 'bulk' AND private THEN 'drop' WHEN kind = 'bulk' THEN 'error' WHEN kind = 'number' THEN 'drop' ELSE 'write' END AS action, CASE WHEN nested OR kind IN ('bulk', 'number') THEN NULL WHEN private AND p_partkey % 2 = 0 THEN 'LO' ELSE 'UN' END AS vr
 FROM (SELECT *, p_brand AS v, list_extract(['text', 'none', 'bulk', 'number'], p_size % 4 + 1) AS kind, p_partkey % 3 <> 0 AS private, p_partkey % 3 <> 0 AND p_partkey % 5 = 0 AS nested FROM part))""")
def raw_elements(spark, sf):
    k = F.col("p_partkey")
    tag = F.when(k % 3 == 0, "00189999").when(k % 2 == 0, "00190010").otherwise("00191001")
    kind = F.element_at(F.array(*map(F.lit, ("text", "none", "bulk", "number"))), (F.col("p_size") % 4 + 1).cast("int"))
    attrs = table(spark, sf, "part").select("p_partkey", F.when((k % 5 == 0) & (k % 3 != 0), F.concat(F.lit("00400555[0]."), tag)).otherwise(tag).alias("path"), tag.alias("tag"), F.col("p_brand").alias("value"), kind.alias("kind"))
    return R.raw_element(attrs).select("p_partkey", "action", "vr", F.octet_length("bytes").alias("size"))


@query("""SELECT o_orderkey, list_extract(['Explicit VR Little Endian', 'RLE Lossless', 'Unknown transfer syntax', 'JPEG 2000 Lossless'], o_orderkey % 4 + 1) AS name, o_orderkey % 4 IN (1, 2, 3) AS packed, list_extract(['1.2.840.10008.1.2.1', '1.2.3', '1.2.840.10008.1.2.4.70', NULL], o_orderkey % 4 + 1) AS named FROM orders""")
def syntax_names(spark, sf):
    pick = lambda *xs: F.element_at(F.array(*map(F.lit, xs)), (F.col("o_orderkey") % 4 + 1).cast("int"))
    uid = pick("1.2.840.10008.1.2.1 ", "1.2.840.10008.1.2.5", "1.2.3", "1.2.840.10008.1.2.4.90")
    header = pick("application/octet-stream", 'multipart/related; transfer-syntax="1.2.3"', "Content-Type: image/jpeg", "text/plain")
    return table(spark, sf, "orders").select("o_orderkey", R.syntax_name(uid).alias("name"), R.compressed(uid).alias("packed"), R.syntax_of(header).alias("named"))


@query("""WITH f AS (SELECT l_orderkey, l_linenumber, unnest(range(1, greatest(1, CAST(l_quantity AS BIGINT) % 5) + 1)) AS frame FROM lineitem)
SELECT l_orderkey, l_linenumber, count(*) AS n, max(concat('https://h/', l_orderkey, '/', l_linenumber, '/frames/', frame)) AS last, NOT (l_orderkey % 6 = 0 AND max(frame) > 1) AS consistent FROM f GROUP BY 1, 2""")
def frame_requests(spark, sf):
    i = table(spark, sf, "lineitem").select(F.struct("l_orderkey", "l_linenumber").alias("sop"), F.concat(F.lit("wadors:https://h/"), "l_orderkey", F.lit("/"), "l_linenumber", F.lit("/frames/1")).alias("url"), (F.col("l_quantity") % 5).alias("frames"))
    asked = R.frame_requests(i)
    got = asked.withColumn("syntax", F.when((F.col("sop.l_orderkey") % 6 == 0) & (F.col("frame") == 1), R.RLE).otherwise("")).withColumn("bytes", F.lit(10).cast("long"))
    each = R.frame_syntaxes(got).join(asked.groupBy("sop").agg(F.max("url").alias("last")), "sop")
    return each.select("sop.*", "n", "last", "consistent")


@query("""SELECT verdict, count(*) AS n FROM (SELECT CASE WHEN l_orderkey % 7 = 0 THEN 'ok' WHEN l_orderkey % 5 = 0 THEN 'unreadable' WHEN l_linenumber % 3 = 0 THEN 'mismatch' ELSE 'ok' END AS verdict FROM lineitem) GROUP BY 1""")
def payload_check(spark, sf):
    k, sop = F.col("l_orderkey"), F.concat_ws(".", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("long"))
    base = table(spark, sf, "lineitem").select(sop.alias("sop"), F.concat("l_suppkey", F.lit("")).alias("series"), k.cast("string").alias("study"), F.when(k % 7 == 0, "mp4").otherwise("dcm").alias("extension"), (k % 5 == 0).alias("lost"), (F.col("l_linenumber") % 3 == 0).alias("other"))
    found = base.where("not lost").select(F.col("sop").alias("sop_key"), "sop", F.when(F.col("other"), "x").otherwise(F.col("series")).alias("series"), "study")
    return R.payload_check(base.select("sop", "series", "study", "extension"), found).groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT p_partkey, CASE WHEN p_size = 1 THEN '[]' ELSE concat('[0, ', p_size + p_size % 2 + 8, ']') END AS table_, concat('[0, ', p_size + p_size % 2, ', ', 10, ']') AS lengths, CASE p_partkey % 3 WHEN 0 THEN 'fragmentation' WHEN 1 THEN 'offset table' END AS problem, p_partkey % 4 = 0 AS is_file, CASE WHEN p_partkey % 4 = 0 THEN 140 ELSE 132 + 8 END AS repaired, 8 + p_partkey % 2 * 1 + (8 + p_partkey % 2) % 2 AS padded FROM part""")
def encapsulation(spark, sf):
    k, n = F.col("p_partkey"), F.array(F.col("p_size"), F.lit(9))
    text = lambda a: F.concat(F.lit("["), F.array_join(a.cast("array<string>"), ", "), F.lit("]"))
    tables = F.when(F.col("p_size") == 1, text(R.offset_table(n, False))).otherwise(text(R.offset_table(n, True)))
    fragments = F.when(k % 3 == 0, F.array(F.lit(0), F.lit(4))).when(k % 3 == 1, F.array(F.lit(8), F.lit(4), F.lit(4))).otherwise(F.array(F.lit(0), F.lit(4), F.lit(4)))
    data = F.when(k % 4 == 0, F.concat(F.lit(R.PREFIX), F.lit(b"12345678"))).otherwise(F.lit(b"12345678"))
    odd = F.when(k % 2 == 1, F.lit(b"123456789")).otherwise(F.lit(b"12345678"))
    return table(spark, sf, "part").select("p_partkey", tables.alias("table_"), text(R.encapsulated_lengths(n)).alias("lengths"), R.frame_fragment(fragments, F.lit(2)).alias("problem"), R.is_part10(data).alias("is_file"), F.octet_length(R.with_prefix(data)).alias("repaired"), F.octet_length(R.even(odd)).alias("padded"))


@query("""SELECT p_partkey, path, line FROM (SELECT p_partkey, unnest([{'path': '00100010', 'line': concat('(0010,0010) PN [', p_name, '] # PatientName')}, {'path': '00091001', 'line': concat('(0009,1001) UN [<binary data omitted; ', p_size, ' byte', CASE WHEN p_size = 1 THEN '' ELSE 's' END, '>] # PrivateTag')},
 {'path': '00400275', 'line': '(0040,0275) SQ (Sequence with 1 item) # UnknownTag'}, {'path': '00400275[0].00400007', 'line': '    (0040,0007) LO [(no value available)] # UnknownTag'}], recursive := true) FROM part)""")
def attribute_dump(spark, sf):
    rows = [("00100010", "PN", F.col("p_name")), ("00091001", "UN", F.lit(None)), ("00400275", "SQ", F.lit("1")), ("00400275[0].00400007", "LO", F.lit(None)), ("7FE00010", "OW", F.lit(None))]
    each = F.array(*(F.struct(F.lit(p).alias("path"), F.lit(p[-8:]).alias("tag"), F.lit(v).alias("vr"), x.cast("string").alias("value")) for p, v, x in rows))
    attrs = table(spark, sf, "part").select(F.col("p_partkey").alias("instance_id"), F.explode(each).alias("a"), F.col("p_size").alias("size")).select("instance_id", "a.*", "size")
    names = spark.createDataFrame([("00100010", "PatientName")], "tag string, name string")
    return R.dump_lines(attrs, names).select(F.col("instance_id").alias("p_partkey"), "path", "line")


@query("""SELECT doc_id, sha256(coalesce(text, '')) AS sha, lang, concat('1.2.', doc_id) AS sop, n_chars % 7 AS items FROM documents""")
def file_roundtrip(spark, sf):
    """Files written from attributes (a text, nested items, a binary payload) and read again."""
    d, data = table(spark, sf, "documents"), F.coalesce("text", F.lit("")).cast("binary")
    row = lambda path, vr, value, payload=None: F.struct(F.lit(path).alias("path") if isinstance(path, str) else path.alias("path"), (F.lit(path[-8:]) if isinstance(path, str) else F.right(path, F.lit(8))).alias("tag"), F.lit(vr).alias("vr"), value.cast("string").alias("value"), (F.lit(None) if payload is None else payload).cast("binary").alias("payload"))
    inner = F.transform(F.filter(F.sequence(F.lit(0), F.lit(6)), lambda i: i < F.col("n_chars") % 7), lambda i: row(F.concat(F.lit("00400555["), i.cast("string"), F.lit("].0040A160")), "UT", i))
    attrs = F.concat(F.array(row("00080018", "UI", F.concat(F.lit("1.2."), "doc_id")), row("00100020", "LO", F.col("lang")), row("00280010", "US", F.lit(512)), row("00400555", "SQ", F.col("n_chars") % 7), row("00420011", "OB", F.lit(None), data)), inner)
    made = part10.write_attributes(d.select(F.col("doc_id").cast("string").alias("instance_id"), F.explode(attrs).alias("a")).select("instance_id", "a.*"))
    back = part10.read_attributes(made.select(F.col("instance_id").alias("path"), "content"))
    value = lambda p, c: F.max(F.when(F.col("path") == p, F.col(c)))
    size = d.select(F.col("doc_id").cast("string").alias("instance_id"), F.octet_length(data).alias("size"))
    each = back.groupBy("instance_id").agg(value("00420011", "payload").alias("payload"), value("00100020", "value").alias("lang"), value("00080018", "value").alias("sop"), value("00400555", "value").alias("items")).join(size, "instance_id")
    return each.select(F.col("instance_id").cast("long").alias("doc_id"), F.sha2(F.expr("substring(payload, 1, size)"), 256).alias("sha"), "lang", "sop", F.col("items").cast("long").alias("items"))


@query("SELECT doc_id, sha256(coalesce(text, '')) AS sha, CASE WHEN doc_id % 2 = 0 THEN '1.2.840.10008.1.2.4.90' ELSE '1.2.840.10008.1.2.5' END AS syntax FROM documents")
def multipart_bodies(spark, sf):
    d, data = table(spark, sf, "documents"), F.coalesce("text", F.lit("")).cast("binary")
    part = F.concat(F.lit(b"--b\r\nContent-Type: image/jp2\r\n\r\n"), data, F.lit(b"\r\n--b--"))
    bodies = d.select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 2 == 0, part).otherwise(data).alias("body"), F.lit("image/dicom-rle").alias("content_type"))
    return part10.multipart(bodies).select(F.col("id").alias("doc_id"), F.sha2("payload", 256).alias("sha"), R.syntax_of(F.col("part_type")).alias("syntax"))


@query("SELECT p_partkey, concat('ID', p_partkey % 1000) AS text FROM part")
def micro_ocr(spark, sf):
    """Writing drawn into frames is found and read again."""
    import pyarrow as pa

    def read(batches):
        for batch in batches:
            found = ["".join(b.text for b in pixels.find_text(pixels.seen(pixels.drawn(f"ID{k % 1000}", 2, 160, 480), pixels.Image(160, 480)))) for k in batch.column("p_partkey").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("p_partkey"), pa.array(found, pa.string())], names=["p_partkey", "text"])

    return spread(table(spark, sf, "part").select("p_partkey"), "p_partkey").mapInArrow(read, "p_partkey long, text string")


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE 1 END AS n_boxes, '1.2.840.10008.1.2.5' AS syntax, CASE WHEN p_partkey % 5 = 0 THEN true ELSE false END AS failed FROM part WHERE p_partkey % 5 <> 0 UNION ALL SELECT p_partkey, 0, '1.2.840.10008.1.2.5', p_partkey % 3 <> 0 FROM part WHERE p_partkey % 5 = 0")
def redacted_frames(spark, sf):
    """Frames with a name burned in: masked where they say so, left where not, and set aside where they are broken."""
    import pyarrow as pa

    def draw(batches):
        for batch in batches:
            keys = batch.column("p_partkey").to_pylist()
            data = [codec.encode_rle(pixels.drawn(f"NAME{k % 100}", 2, 160, 480).tobytes()) if k % 5 else b"broken" for k in keys]
            yield pa.RecordBatch.from_arrays([batch.column("p_partkey"), pa.array(data, pa.binary())], names=["instance_id", "data"])

    made = spread(table(spark, sf, "part").select("p_partkey"), "p_partkey").mapInArrow(draw, "instance_id long, data binary")
    frames = made.select("instance_id", F.lit(0).alias("frame"), F.lit(1).alias("n_frames"), F.lit(160).alias("rows"), F.lit(480).alias("cols"), F.lit(1).alias("samples"), F.lit(8).alias("bits"), F.lit("MONOCHROME2").alias("photometric"), F.lit(R.RLE).alias("syntax"), F.when(F.col("instance_id") % 3 == 0, "NO").otherwise("YES").alias("burned_in"), "data")
    out = pixels.redact_frames(frames, lambda boxes: [b.text.startswith("NAME") for b in boxes])
    return out.select(F.col("instance_id").alias("p_partkey"), "n_boxes", "syntax", F.col("error").isNotNull().alias("failed"))


@query("""SELECT p_partkey, p_partkey % 5 <> 0 AND p_size % 4 <> 0 AS framed, p_partkey % 3 <> 0 AS rebuilt, CASE WHEN p_partkey % 3 = 0 THEN '1.2.840.10008.5.1.4.1.1.7' ELSE '1.2.3' END AS sop_class, CASE WHEN p_size % 2 = 0 THEN '1.2.840.10008.1.2.5' ELSE '1.2.840.10008.1.2.1' END AS syntax,
 concat('[', 256 * (p_size % 100) + 1, ', ', 2, ']') AS words, concat('2024', lpad((p_size % 12 + 1)::VARCHAR, 2, '0'), '15') AS day FROM part""")
def reconstruction(spark, sf):
    """What a file is rebuilt from: whether it has frames, whether its header is complete, words in base64, dates with signs."""
    k, i = F.col("p_partkey"), F.col("p_size")
    kind = F.when(k % 3 == 0, "").otherwise("1.2.3")
    meta = R.meta_row(kind, F.concat(F.lit("1.2."), k), F.when(i % 2 == 0, R.RLE))
    word = F.concat(F.unhex(F.lit("01")), F.unhex(F.lpad(F.hex(i % 100), 2, "0")), F.unhex(F.lit("020077")))
    words = F.concat(F.lit("["), F.array_join(R.inline_words(F.base64(word)).cast("array<string>"), ", "), F.lit("]"))
    day = F.concat(F.lit("2024-"), F.lpad((i % 12 + 1).cast("string"), 2, "0"), F.lit(".15"))
    framed = R.uses_frames(F.when(k % 5 == 0, "x").otherwise("512"), F.lit(512), i % 4)
    return table(spark, sf, "part").select("p_partkey", framed.alias("framed"), R.reconstructable(kind, k.cast("string")).alias("rebuilt"), meta["sop_class"].alias("sop_class"), meta["syntax"].alias("syntax"), words.alias("words"), R.normalized_value(F.lit("DA"), day).alias("day"))
