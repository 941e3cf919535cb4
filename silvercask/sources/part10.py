"""Files of attributes (a prefix, a header group, and explicit little-endian elements), read and written in Arrow batches.

Sequences, undefined lengths and encapsulated pixels are read; other encodings than explicit or implicit little endian give
an error row. Nothing is sent to the driver; a file is one row, so it is bounded by a row's 2 GiB.
"""

from __future__ import annotations

import struct

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.records import EXPLICIT, PREFIX

IMPLICIT = "1.2.840.10008.1.2"
# Representations whose length takes four bytes, and those of fixed binary numbers.
LONG = {"OB", "OD", "OF", "OL", "OV", "OW", "SQ", "SV", "UC", "UN", "UR", "UT", "UV"}
NUMBERS = {"US": "H", "SS": "h", "UL": "I", "SL": "i", "FL": "f", "FD": "d", "UV": "Q", "SV": "q"}
BINARY = {"OB", "OD", "OF", "OL", "OV", "OW", "UN"}
#: Representations of the attributes that implicit files leave to the dictionary; others are unknown there.
VRS = {
    "00080005": "CS", "00080016": "UI", "00080018": "UI", "00080020": "DA", "00080030": "TM", "00080050": "SH", "00080060": "CS", "00080090": "PN",
    "00100010": "PN", "00100020": "LO", "00100030": "DA", "00100040": "CS", "0020000D": "UI", "0020000E": "UI", "00200011": "IS", "00200013": "IS",
    "00280002": "US", "00280004": "CS", "00280008": "IS", "00280010": "US", "00280011": "US", "00280100": "US", "00280101": "US", "00280103": "US",
    "00280301": "CS", "7FE00010": "OW",
}


class Unreadable(ValueError):
    """Bytes that are not a file of attributes."""


def is_file(data: bytes) -> bool:
    return len(data) >= 132 and data[128:132] == b"DICM"


def _value(raw: bytes, vr: str):
    """(value, payload): text of an element, numbers and texts joined by backslashes; or the bytes of a binary one."""
    if vr in BINARY:
        return None, raw
    if vr in NUMBERS:
        size = struct.calcsize(NUMBERS[vr])
        return "\\".join(str(x[0]) for x in struct.iter_unpack("<" + NUMBERS[vr], raw[: len(raw) // size * size])), None
    if vr == "AT":
        return "\\".join("%04X%04X" % x for x in struct.iter_unpack("<HH", raw[: len(raw) // 4 * 4])), None
    return raw.decode("utf-8", "replace").rstrip("\0 "), None


def _elements(data: bytes, at: int, end: int, explicit: bool, prefix: str, out: list, depth: int = 0) -> int:
    if depth > 64:
        raise Unreadable("sequences too deep")
    while at < end:
        if at + 8 > end:
            raise Unreadable("an element is cut off")
        group, element = struct.unpack_from("<HH", data, at)
        tag = f"{group:04X}{element:04X}"
        if tag in ("FFFEE00D", "FFFEE0DD"):  # the end of an item or a sequence of undefined length
            return at + 8
        if explicit:
            vr = data[at + 4 : at + 6].decode("ascii", "replace")
            if not (vr.isalpha() and vr.isupper()):
                raise Unreadable(f"no representation at {at}")
            if vr in LONG:
                if at + 12 > end:
                    raise Unreadable("an element is cut off")
                size, at = struct.unpack_from("<I", data, at + 8)[0], at + 12
            else:
                size, at = struct.unpack_from("<H", data, at + 6)[0], at + 8
        else:
            size, at = struct.unpack_from("<I", data, at + 4)[0], at + 8
            vr = VRS.get(tag, "SQ" if size == 0xFFFFFFFF else "UN")
        path = prefix + tag
        if vr == "SQ" or (vr == "UN" and size == 0xFFFFFFFF):
            stop, n = (end if size == 0xFFFFFFFF else at + size), 0
            if stop > end:
                raise Unreadable("a sequence is cut off")
            row = len(out)
            out.append(None)
            while at + 8 <= stop:
                g, e, length = struct.unpack_from("<HHI", data, at)
                at += 8
                if (g, e) == (0xFFFE, 0xE0DD):
                    break
                if (g, e) != (0xFFFE, 0xE000):
                    raise Unreadable("a sequence holds no item")
                limit = stop if length == 0xFFFFFFFF else at + length
                if limit > stop:
                    raise Unreadable("an item is cut off")
                at = _elements(data, at, limit, explicit if vr == "SQ" else False, f"{path}[{n}].", out, depth + 1)
                n += 1
            out[row] = (path, tag, "SQ", str(n), None)
            continue
        if size == 0xFFFFFFFF:  # encapsulated pixels: fragments, the first of which is the offset table
            parts = []
            while True:
                if at + 8 > end:
                    raise Unreadable("a fragment is cut off")
                g, e, length = struct.unpack_from("<HHI", data, at)
                at += 8
                if (g, e) == (0xFFFE, 0xE0DD):
                    break
                if (g, e) != (0xFFFE, 0xE000) or at + length > end:
                    raise Unreadable("a fragment is cut off")
                parts.append(data[at : at + length])
                at += length
            out.append((path, tag, vr, "\\".join(str(len(p)) for p in parts), b"".join(parts)))
            continue
        if at + size > end:
            raise Unreadable("a value is cut off")
        out.append((path, tag, vr, *_value(data[at : at + size], vr)))
        at += size
    return at


def parse(data: bytes) -> list[tuple[str, str, str, str | None, bytes | None]]:
    """(path, tag, vr, value, payload) of all attributes, header first. Of encapsulated pixels the value is the lengths of
    the fragments, and the payload all of them."""
    if not is_file(data):
        raise Unreadable("no file of attributes")
    out: list = []
    at, end = 132, len(data)
    while at + 8 <= end and struct.unpack_from("<H", data, at)[0] == 2:
        group_end = at + (12 if data[at + 4 : at + 6].decode("ascii", "replace") in LONG else 8)
        size = struct.unpack_from("<I", data, at + 8)[0] if group_end - at == 12 else struct.unpack_from("<H", data, at + 6)[0]
        _elements(data, at, min(end, group_end + size), True, "", out)
        at = group_end + size
    syntax = next((v for p, _, _, v, _ in out if p == "00020010"), EXPLICIT)
    if syntax in ("1.2.840.10008.1.2.2", "1.2.840.10008.1.2.1.99"):
        raise Unreadable(f"encoding {syntax} is not read")
    _elements(data, at, end, syntax != IMPLICIT, "", out)
    return out


def _encoded(tag: str, vr: str, value: str | None, payload: bytes | None, inner: bytes | None) -> bytes:
    if inner is not None:
        raw = inner
    elif vr in BINARY:
        raw = payload or b""
    elif vr in NUMBERS:
        kind = float if vr in ("FL", "FD") else int
        raw = b"".join(struct.pack("<" + NUMBERS[vr], kind(x)) for x in (value or "").split("\\") if x)
    elif vr == "AT":
        raw = b"".join(struct.pack("<HH", int(x[:4], 16), int(x[4:], 16)) for x in (value or "").split("\\") if x)
    else:
        raw = (value or "").encode()
    raw += (b"\0" if vr in BINARY or vr == "UI" else b" ") * (len(raw) % 2)
    head = struct.pack("<HH", int(tag[:4], 16), int(tag[4:], 16)) + vr.encode()
    if vr not in LONG and len(raw) > 0xFFFF:
        raise Unreadable(f"{tag} is too long for {vr}")
    return head + (struct.pack("<HI", 0, len(raw)) if vr in LONG else struct.pack("<H", len(raw))) + raw


def _dataset(rows: dict, prefix: str) -> bytes:
    """The attributes directly in an item, by tag, with the items of their sequences."""
    out = b""
    for path, (tag, vr, value, payload) in sorted((p, r) for p, r in rows.items() if p.startswith(prefix) and "[" not in p[len(prefix) :]):
        inner = None
        if vr == "SQ":
            inner, n = b"", 0
            while any(p.startswith(f"{path}[{n}]") for p in rows):
                item = _dataset(rows, f"{path}[{n}].")
                inner += struct.pack("<HHI", 0xFFFE, 0xE000, len(item)) + item
                n += 1
        elif tag == "7FE00010" and value:  # the lengths of fragments
            at, inner_ = 0, b""
            for size in map(int, value.split("\\")):
                inner_ += struct.pack("<HHI", 0xFFFE, 0xE000, size) + (payload or b"")[at : at + size]
                at += size
            out += struct.pack("<HH", 0x7FE0, 0x0010) + b"OB\0\0" + struct.pack("<I", 0xFFFFFFFF) + inner_ + struct.pack("<HHI", 0xFFFE, 0xE0DD, 0)
            continue
        out += _encoded(tag, vr, value, payload, inner)
    return out


def build(attributes: list[tuple]) -> bytes:
    """A file of (path, tag, vr, value, payload); its header is completed, its elements are explicit little endian."""
    rows = {p: (t, v, x, b) for p, t, v, x, b in attributes}
    first = lambda p, default: (rows.get(p) or (0, 0, default))[2] or default
    header = {p: r for p, r in rows.items() if p.startswith("0002")}
    header.pop("00020000", None)
    header["00020001"] = ("00020001", "OB", None, b"\0\1")
    header.setdefault("00020002", ("00020002", "UI", first("00080016", "1.2.840.10008.5.1.4.1.1.7"), None))
    header.setdefault("00020003", ("00020003", "UI", first("00080018", "1.2.840.10008.5.1.4.1.1.7.1"), None))
    if (header.get("00020010") or (0, 0, IMPLICIT))[2] == IMPLICIT:
        header["00020010"] = ("00020010", "UI", EXPLICIT, None)
    meta = _dataset(header, "")
    size = _encoded("00020000", "UL", str(len(meta)), None, None)
    return PREFIX + size + meta + _dataset({p: r for p, r in rows.items() if not p.startswith("0002")}, "")


def read_attributes(files: DataFrame) -> DataFrame:
    """files (path, content) -> instance_id (the path), path, tag, vr, value, payload, error: a row for each attribute; a
    file that cannot be read is one row with an error."""
    def run(batches):
        for batch in batches:
            for name, data in zip(batch.column("path").to_pylist(), batch.column("content")):
                try:
                    rows = [(name, *r, None) for r in parse(data.as_py() or b"")]
                except (Unreadable, struct.error) as e:
                    rows = [(name, None, None, None, None, None, str(e))]
                columns = zip(*rows) if rows else [[]] * 7
                kinds = [pa.string()] * 5 + [pa.binary(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["instance_id", "path", "tag", "vr", "value", "payload", "error"])

    return files.select("path", "content").mapInArrow(run, "instance_id string, path string, tag string, vr string, value string, payload binary, error string")


def scan(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """The files of a folder and what is below it, as read_attributes takes them."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder).select("path", "content")


def headers(attrs: DataFrame) -> DataFrame:
    """instance_id with the three UIDs that name an instance, from its attributes; null where they are not there."""
    uid = lambda p: F.max(F.when(F.col("path") == p, F.col("value")))
    return attrs.groupBy("instance_id").agg(uid("00080018").alias("sop"), uid("0020000E").alias("series"), uid("0020000D").alias("study"))


def write_attributes(attrs: DataFrame) -> DataFrame:
    """Attributes (instance_id, path, tag, vr, value, payload) -> instance_id, content: a file for each instance."""
    import pandas as pd

    def one(key, rows):
        some = rows.astype(object).where(rows.notna(), None)
        attributes = list(zip(some["path"], some["tag"], some["vr"], some["value"], some["payload"]))
        return pd.DataFrame({"instance_id": [key[0]], "content": [build([(p, t, v, x, None if b is None else bytes(b)) for p, t, v, x, b in attributes])]})

    kind = attrs.schema["instance_id"].dataType.simpleString()
    return attrs.select("instance_id", "path", "tag", "vr", "value", "payload").groupBy("instance_id").applyInPandas(one, f"instance_id {kind}, content binary")


def multipart(bodies: DataFrame) -> DataFrame:
    """bodies (id, body, content_type) -> id, payload, part_type: the one part of a multipart body and its header, or the
    body itself with its own content type."""
    def run(batches):
        for batch in batches:
            payloads, types = [], []
            for body, kind in zip(batch.column("body"), batch.column("content_type").to_pylist()):
                data = body.as_py() or b""
                head, line = data.find(b"\r\n\r\n"), data.find(b"\r\n", 2)
                if head < 0 or line < 0 or not data.startswith(b"--"):
                    payloads.append(data)
                    types.append(kind or "")
                    continue
                end = data.find(b"\r\n" + data[:line], head + 4)
                text = data[line + 2 : head].decode("utf-8", "replace")
                named = next((x.split(":", 1)[1].strip() for x in text.split("\r\n") if x.lower().startswith("content-type:")), "")
                payloads.append(data[head + 4 : end if end >= 0 else len(data)])
                types.append(named or kind or "")
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(payloads, pa.binary()), pa.array(types, pa.string())], names=["id", "payload", "part_type"])

    kind = bodies.schema["id"].dataType.simpleString()
    return bodies.select("id", "body", "content_type").mapInArrow(run, f"id {kind}, payload binary, part_type string")
