"""Attributes as values: representations, reconstruction checks, dumps, and the names of syntaxes, all as Columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S

# The standard's syntaxes, media types and representations.
SYNTAX_NAMES = {
    "1.2.840.10008.1.2": "Implicit VR Little Endian",
    "1.2.840.10008.1.2.1": "Explicit VR Little Endian",
    "1.2.840.10008.1.2.1.99": "Deflated Explicit VR Little Endian",
    "1.2.840.10008.1.2.2": "Explicit VR Big Endian",
    "1.2.840.10008.1.2.4.50": "JPEG Baseline (Process 1)",
    "1.2.840.10008.1.2.4.51": "JPEG Extended (Process 2 & 4)",
    "1.2.840.10008.1.2.4.57": "JPEG Lossless, Non-Hierarchical (Process 14)",
    "1.2.840.10008.1.2.4.70": "JPEG Lossless, Non-Hierarchical, First-Order Prediction",
    "1.2.840.10008.1.2.4.80": "JPEG-LS Lossless",
    "1.2.840.10008.1.2.4.81": "JPEG-LS Near-Lossless",
    "1.2.840.10008.1.2.4.90": "JPEG 2000 Lossless",
    "1.2.840.10008.1.2.4.91": "JPEG 2000",
    "1.2.840.10008.1.2.4.201": "HTJ2K Lossless",
    "1.2.840.10008.1.2.4.202": "HTJ2K Lossless RPCL",
    "1.2.840.10008.1.2.4.203": "HTJ2K",
    "1.2.840.10008.1.2.5": "RLE Lossless",
}
EXPLICIT = "1.2.840.10008.1.2.1"
RLE = "1.2.840.10008.1.2.5"
MEDIA_TYPES = {
    "application/octet-stream": EXPLICIT,
    "image/dicom-rle": RLE,
    "image/jpeg": "1.2.840.10008.1.2.4.70",
    "image/jls": "1.2.840.10008.1.2.4.80",
    "image/jp2": "1.2.840.10008.1.2.4.90",
    "image/jpx": "1.2.840.10008.1.2.4.91",
    "image/jphc": "1.2.840.10008.1.2.4.201",
}
BINARY = ("OB", "OD", "OF", "OL", "OV", "OW", "UN")
PIXEL_TAGS = ("7FE00008", "7FE00009", "7FE00010")
AMBIGUOUS = {"xs": "US|SS", "lt": "US|OW"}
PREFIX = b"\0" * 128 + b"DICM"


def _lookup(table: dict, key: Column) -> Column:
    return F.create_map(*(F.lit(x) for pair in table.items() for x in pair))[key]


def syntax_name(uid: Column) -> Column:
    return F.coalesce(_lookup(SYNTAX_NAMES, F.trim(uid)), F.lit("Unknown transfer syntax"))


def compressed(uid: Column) -> Column:
    """Whether frames are encapsulated: any syntax but the native ones."""
    t = S.missing(F.trim(uid))
    return t.isNotNull() & ~F.coalesce(t.isin(*S.NATIVE_SYNTAXES), F.lit(False))


def syntax_of(content_type: Column) -> Column:
    """The transfer syntax that a content type names, or that its media type stands for."""
    named = F.coalesce(S.missing(F.regexp_extract(content_type, r'(?i)transfer-syntax\s*=\s*"([^"]+)"', 1)), S.missing(F.regexp_extract(content_type, r'(?i)transfer-syntax\s*=\s*([^;"\s,]+)', 1)))
    media = F.lower(F.regexp_extract(content_type, r"(?i)^\s*(?:content-type\s*:\s*)?([a-z][a-z0-9.+-]*/[a-z0-9.+-]+)", 1))
    return F.coalesce(named, _lookup(MEDIA_TYPES, media))


def uses_frames(rows: Column, columns: Column, bits: Column) -> Column:
    return (S.numeric_value(rows) > 0) & (S.numeric_value(columns) > 0) & (S.numeric_value(bits) > 0)


def reconstructable(sop_class: Column, sop: Column) -> Column:
    return S.missing(sop_class).isNotNull() & S.missing(sop).isNotNull()


def expected_bytes(rows: Column, columns: Column, samples: Column, bits: Column, frames: Column) -> Column:
    """The bytes of native pixels; null where a sample is not whole bytes or a size is missing."""
    n = lambda c, default: F.coalesce(c.cast("long"), F.lit(default))
    whole = (n(rows, 0) > 0) & (n(columns, 0) > 0) & (n(bits, 0) > 0) & (n(bits, 1) % 8 == 0)
    size = n(rows, 0) * n(columns, 0) * n(samples, 1) * (n(bits, 0) / 8).cast("long") * F.greatest(F.lit(1).cast("long"), n(frames, 1))
    return F.when(whole, size)


def frame_requests(instances: DataFrame) -> DataFrame:
    """instances (sop, url, frames) -> sop, frame, url: a row for each frame to fetch."""
    n = F.greatest(F.lit(1), F.coalesce(F.col("frames").cast("int"), F.lit(1)))
    each = instances.select("sop", "url", F.explode(F.sequence(F.lit(1), n)).alias("frame"))
    return each.select("sop", "frame", S.frame_url(S.normalize_url(F.col("url")), F.col("frame")).alias("url"))


def frame_syntaxes(frames: DataFrame) -> DataFrame:
    """frames (sop, syntax, bytes) -> sop, n, bytes, syntax, consistent: whether all frames have one syntax."""
    syntax = F.coalesce(S.missing(F.col("syntax")), F.lit(EXPLICIT))
    each = frames.groupBy("sop").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"), F.min(syntax).alias("syntax"), (F.min(syntax) == F.max(syntax)).alias("consistent"))
    return each


def payload_check(wanted: DataFrame, found: DataFrame) -> DataFrame:
    """wanted (sop, series, study, extension) beside found (sop_key, sop, series, study; null where no header could be
    read) by sop_key -> sop, verdict: ok, mismatch, or unreadable. Videos are not looked into."""
    got = found.select(F.col("sop_key").alias("_key"), F.struct("sop", "series", "study").alias("_got"))
    same = F.col("_got") == F.struct("sop", "series", "study")
    none = F.col("_got").isNull() | (F.col("_got.sop").isNull() & F.col("_got.series").isNull() & F.col("_got.study").isNull())
    verdict = F.when(F.col("extension") == "mp4", "ok").when(none, "unreadable").when(F.coalesce(same, F.lit(False)), "ok").otherwise("mismatch")
    return wanted.join(got, wanted["sop"] == F.col("_key"), "left").select("sop", verdict.alias("verdict"))


def is_part10(data: Column) -> Column:
    return (F.octet_length(data) >= 132) & (F.substring(data, 129, 4) == F.lit(b"DICM"))


def with_prefix(data: Column) -> Column:
    """With the 128 bytes and four letters that a file begins with."""
    return F.when(is_part10(data), data).otherwise(F.concat(F.lit(PREFIX), data))


def even(data: Column) -> Column:
    """With a zero byte where its length is odd."""
    return F.when(F.octet_length(data) % 2 == 1, F.concat(data, F.lit(b"\0"))).otherwise(data)


def offset_table(lengths: Column, populated: bool) -> Column:
    """Where each frame of an encapsulated stream begins, counted from the first frame's item; empty unless asked for."""
    if not populated:
        return F.array().cast("array<long>")
    padded = F.transform(lengths, lambda n: n.cast("long") + n % 2 + 8)
    return F.transform(padded, lambda n, i: F.aggregate(F.slice(padded, F.lit(1), i), F.lit(0).cast("long"), lambda a, b: a + b))


def encapsulated_lengths(lengths: Column) -> Column:
    """The lengths of the fragments: an empty offset table, then the frames, padded."""
    return F.concat(F.array(F.lit(0).cast("long")), F.transform(lengths, lambda n: n.cast("long") + n % 2))


def frame_fragment(lengths: Column, frames: Column) -> Column:
    """Why single frames cannot be told apart in fragments of these lengths; null where they can."""
    return F.when(F.size(lengths) == 0, "no pixels").when(F.size(lengths) != frames + 1, "fragmentation").when(lengths[0] != 0, "offset table")


def resolved_vr(vr: Column, value: Column, is_binary: Column, signed: Column) -> Column:
    """A representation that depends on its context: words are unsigned unless they are binary (US|OW), or the pixels
    or a value are negative (US|SS). Others give their first."""
    code = F.coalesce(_lookup(AMBIGUOUS, vr), vr)
    parts = F.split(code, r"\|")
    has = lambda x: F.array_contains(parts, x)
    negative = F.exists(F.split(F.coalesce(value, F.lit("")), r"\\"), lambda v: F.rlike(v, F.lit(r"^\s*-[0-9]")))
    ss = F.coalesce(signed.cast("string") == "1", F.lit(False)) | negative
    return F.when(F.size(parts) < 2, vr).when(has("US") & has("OW"), F.when(is_binary, "OW").otherwise("US")).when(has("US") & has("SS"), F.when(ss, "SS").otherwise("US")).otherwise(parts[0])


def with_resolved_vrs(attrs: DataFrame, dictionary: DataFrame) -> DataFrame:
    """attrs (instance_id, path, tag, vr, value, is_binary, signed) -> with vr resolved and values: unknown ones get the
    dictionary's representation (tag, dict_vr, vm), and texts of attributes with several values are split."""
    rows = attrs.join(F.broadcast(dictionary) if dictionary.limit(10_001).count() <= 10_000 else dictionary, "tag", "left")
    known = F.when((F.coalesce("vr", F.lit("UN")) == "UN") & (F.coalesce("dict_vr", F.lit("UN")) != "UN") & ~F.col("is_binary"), F.col("dict_vr")).otherwise(F.coalesce("vr", "dict_vr", F.lit("UN")))
    values = F.when(F.contains("value", F.lit("\\")) & (F.coalesce("vm", F.lit("1")) != "1"), F.split("value", r"\\")).otherwise(F.array("value"))
    return rows.withColumn("values", values).withColumn("vr", resolved_vr(known, F.col("value"), F.col("is_binary"), F.col("signed"))).drop("dict_vr", "vm")


def is_private(tag: Column) -> Column:
    return F.conv(F.substring(tag, 4, 1), 16, 10).cast("int") % 2 == 1


def is_creator(tag: Column) -> Column:
    return is_private(tag) & F.conv(F.substring(tag, 5, 4), 16, 10).cast("int").between(0x10, 0xFF)


def raw_element(attrs: DataFrame) -> DataFrame:
    """Attributes (path, tag, value, kind: text, binary (base64), number, bulk or none) that have no dictionary entry ->
    with action and vr, and bytes: what is written of them.

    Creators are texts, texts and binary values are unknown bytes padded to an even length; nested private attributes
    and private bulk data are left out, and standard bulk data that is not there stops the file."""
    nested, private = F.contains("path", F.lit("[")), is_private(F.col("tag"))
    action = (
        F.when(F.col("tag") == "7FE00010", "pixels")
        .when(nested & private, "drop")
        .when((F.col("kind") == "bulk") & private, "drop")
        .when(F.col("kind") == "bulk", "error")
        .when(F.col("kind").isin("none", "text", "binary"), "write")
        .otherwise("drop")
    )
    creator = is_creator(F.col("tag"))
    raw = F.when(F.col("kind") == "binary", F.unbase64("value")).otherwise(F.col("value").cast("binary"))
    pad = F.when(F.octet_length(raw) % 2 == 1, F.concat(raw, F.when(F.col("kind") == "binary", F.lit(b"\0")).otherwise(F.lit(b" ")))).otherwise(raw)
    vr = F.when(creator & F.col("kind").isin("none", "text"), "LO").otherwise("UN")
    data = F.when(F.col("kind") == "none", F.lit(b"")).when(vr == "LO", F.col("value").cast("binary")).otherwise(pad)
    return attrs.withColumn("action", action).withColumn("vr", F.when(F.col("action") == "write", vr)).withColumn("bytes", F.when(F.col("action") == "write", data))


def normalized_value(vr: Column, value: Column) -> Column:
    """Dates without signs; other values as they are."""
    return F.when(vr == "DA", F.regexp_replace(value, r"[-./\s]", "")).otherwise(value)


def inline_words(data: Column) -> Column:
    """Base64 as unsigned words of two bytes, low byte first."""
    raw = F.unbase64(data)
    byte = lambda i: F.conv(F.hex(F.substring(raw, i, F.lit(1))), 16, 10).cast("int")
    n = F.floor(F.octet_length(raw) / 2).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: byte(i * 2 - 1) + 256 * byte(i * 2))).otherwise(F.array().cast("array<int>"))


def meta_row(sop_class: Column, sop: Column, syntax: Column) -> Column:
    """The attributes of a file's header, with what stands in where they are missing."""
    return F.struct(
        F.coalesce(S.missing(sop_class), F.lit("1.2.840.10008.5.1.4.1.1.7")).alias("sop_class"),
        F.coalesce(S.missing(sop), F.lit("1.2.840.10008.5.1.4.1.1.7.1")).alias("sop"),
        F.coalesce(S.missing(syntax), F.lit(EXPLICIT)).alias("syntax"),
        F.lit(bytes([0, 1])).alias("version"),
    )


def dump_lines(attrs: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """attrs (instance_id, path, tag, vr, value, size: bytes of binary values) -> instance_id, path, line: a line for each
    attribute, pixels and the contents of binary values left out. Ordered by path, lines are ordered by tag."""
    rows = attrs.where(~F.col("tag").isin(*PIXEL_TAGS))
    rows = rows.withColumn("name", F.lit(None).cast("string")) if names is None else rows.join(F.broadcast(names) if names.limit(10_001).count() <= 10_000 else names, "tag", "left")
    depth = F.size(F.split("path", r"\[")) - 1
    tag = F.concat(F.lit("("), F.lower(F.substring("tag", 1, 4)), F.lit(","), F.lower(F.substring("tag", 5, 4)), F.lit(")"))
    vr = F.upper(F.coalesce("vr", F.lit("UN")))
    plural = lambda n: F.when(n == 1, "").otherwise("s")
    size, items = F.coalesce(F.col("size"), F.lit(0)), F.coalesce(F.col("value").try_cast("int"), F.lit(0))
    binary = F.concat(F.lit("<binary data omitted; "), size.cast("string"), F.lit(" byte"), plural(size), F.lit(">"))
    shown = F.when(vr.isin(*BINARY), binary).otherwise(F.coalesce(F.col("value"), F.lit("(no value available)")))
    text = F.when(vr == "SQ", F.concat(F.lit("(Sequence with "), items.cast("string"), F.lit(" item"), plural(items), F.lit(")"))).otherwise(F.concat(F.lit("["), shown, F.lit("]")))
    name = F.coalesce("name", F.when(is_private(F.col("tag")), "PrivateTag").otherwise("UnknownTag"))
    line = F.concat(F.repeat(F.lit("    "), depth), tag, F.lit(" "), F.rpad(vr, 2, " "), F.lit(" "), text, F.lit(" # "), name)
    return rows.select("instance_id", "path", line.alias("line"))


def dos_time(ts: Column) -> Column:
    """Date and time of a ZIP entry: from 1980 to 2107, in steps of two seconds."""
    year = F.greatest(F.lit(1980), F.least(F.lit(2107), F.year(ts))) - 1980
    date = F.shiftleft(year, 9).bitwiseOR(F.shiftleft(F.month(ts), 5)).bitwiseOR(F.dayofmonth(ts))
    time = F.shiftleft(F.hour(ts), 11).bitwiseOR(F.shiftleft(F.minute(ts), 5)).bitwiseOR(F.floor(F.second(ts) / 2).cast("int"))
    return F.struct(date.alias("date"), time.alias("time"))


def supported_pixels(bits: Column, samples: Column, photometric: Column) -> Column:
    return F.coalesce(bits.isin(8, 16) & samples.isin(1, 3) & F.upper(photometric).isin("MONOCHROME1", "MONOCHROME2", "RGB"), F.lit(False))


def max_stored(bits: Column) -> Column:
    return F.when(bits >= 1, F.pow(F.lit(2.0), F.least(bits, F.lit(53))) - 1).otherwise(0.0)


def fill_value(padding: Column, photometric: Column, bits_stored: Column) -> Column:
    """What a mask is filled with: the padding value, else black."""
    return F.when(padding.isNotNull(), padding.cast("double")).when(F.upper(photometric) == "MONOCHROME1", max_stored(bits_stored)).otherwise(0.0)


def border_width(color: Column, width: Column) -> Column:
    return F.when(width.isNotNull(), F.greatest(F.lit(0), width)).when(F.lower(color) != "none", 2).otherwise(0)


def output_syntax(syntax: Column, encodes: Column, samples: Column, bits: Column, uncompressed: Column) -> Column:
    """The syntax of masked frames: their own where it can be written, else run lengths, else native."""
    packed = compressed(syntax) & ~uncompressed
    return F.when(packed & encodes, syntax).when(packed & ((samples == 1) | (bits == 8)), RLE).otherwise(EXPLICIT)
