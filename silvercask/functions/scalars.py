"""Scalar functions on identifiers, paths, URLs, dates, ages and sizes, all as Column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
UID_GRAMMAR = r"^([0-9]|[1-9][0-9]*)(\.([0-9]|[1-9][0-9]*))*$"
UID_LENGTH = 64
SHORT_UID = 28
SIZE_UNITS = ("B", "KB", "MB", "GB", "TB")
STUDY_DIR = 120
NATIVE_SYNTAXES = ("1.2.840.10008.1.2", "1.2.840.10008.1.2.1", "1.2.840.10008.1.2.2")
NO_SUBJECT = "FALLBACK_SUBJECT_KEY"
RETRY_CAP_MS = 30_000


def _pairs(form: str, keep) -> tuple[str, str]:
    """Characters (up to U+FFFF) that a Unicode normal form maps to one character, and those."""
    found = ((chr(i), "".join(x for x in unicodedata.normalize(form, chr(i)) if not unicodedata.combining(x))) for i in range(0x80, 0x10000) if not 0xD800 <= i < 0xE000)
    some = [(a, b) for a, b in found if len(b) == 1 and a != b and keep(b)]
    return "".join(a for a, _ in some), "".join(b for _, b in some)


def unaccented(c: Column) -> Column:
    """Letters and digits that decompose to an ASCII one as that; other characters stay."""
    return F.translate(c, *_pairs("NFKD", lambda b: b.isascii() and b.isalnum()))


def compatible(c: Column) -> Column:
    """Characters that compatibility composition maps to one other (full width, no-break space and so on) as that;
    sequences that compose are left as they are."""
    a, b = zip(*((chr(i), unicodedata.normalize("NFKC", chr(i))) for i in range(0x80, 0x10000) if not 0xD800 <= i < 0xE000 and len(unicodedata.normalize("NFKC", chr(i))) == 1 and unicodedata.normalize("NFKC", chr(i)) != chr(i)))
    return F.translate(c, "".join(a), "".join(b))


def missing(c: Column) -> Column:
    """Null for null and empty strings."""
    return F.nullif(c, F.lit(""))


def first_non_empty(*cs: Column) -> Column:
    return F.coalesce(*(missing(F.trim(c)) for c in cs), F.lit(""))


def once(c: Column, f) -> Column:
    """f of a value that it reads more than once: a lambda's variable is worked out once, a repeated expression each time."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def pad_left(c: Column, n: int = 3) -> Column:
    """Zeros in front, without cutting what is longer."""
    return F.lpad(c, F.greatest(F.lit(n), F.length(c)), F.lit("0"))


def safe_name(c: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(F.coalesce(missing(c), F.lit("unknown")), r"\.\.", "_"), r"[^A-Za-z0-9._-]+", "_")
    return F.coalesce(missing(F.regexp_replace(s, r"^[._]+|[._]+$", "")), F.lit("unknown"))


def short_uid(c: Column) -> Column:
    return F.right(F.coalesce(c, F.lit("")), F.lit(SHORT_UID))


def sanitize(c: Column, fallback: str) -> Column:
    """A path component: no traversal, no characters that are illegal on common file systems, no white space."""
    s = F.regexp_replace(F.trim(compatible(c)), r"\.\.", "_")
    for pattern, by in ((r'[<>:"/\\|?*\x00-\x1F]', "_"), (r"\s+", "_"), ("_+", "_"), (r"^[._]+|[._]+$", "")):
        s = F.regexp_replace(s, pattern, by)
    return F.coalesce(missing(s), F.lit(fallback))


def series_number(c: Column) -> Column:
    t = F.trim(c)
    digits = F.regexp_replace(F.regexp_replace(t, "^-", ""), "^0+(?=[0-9])", "")
    minus = F.when(t.startswith("-") & (digits != "0"), "-").otherwise("")
    return F.when(missing(c).isNull(), "NO_SERIES_NUMBER").when(F.rlike(t, F.lit(r"^-?[0-9]+$")), F.concat(minus, pad_left(digits))).otherwise(sanitize(t, "NO_SERIES_NUMBER"))


def valid_uid(c: Column) -> Column:
    t = F.trim(c)
    return F.when((F.length(t) <= UID_LENGTH) & F.rlike(t, F.lit(UID_GRAMMAR)), t)


def escape_html(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def format_bytes(c: Column) -> Column:
    out = F.lit("0 B")
    for i, unit in enumerate(SIZE_UNITS):
        x = c / float(1024**i)
        tenths = F.floor(x * 10 + 0.5).cast("long")
        plain = F.floor(x + 0.5).cast("string")
        one = F.concat((tenths / 10).cast("long").cast("string"), F.lit("."), (tenths % 10).cast("string"))
        out = F.when(c >= 1024**i if i else c > 0, F.concat(plain if i == 0 else F.when(x >= 10, plain).otherwise(one), F.lit(f" {unit}"))).otherwise(out)
    return out


def format_duration(ms: Column) -> Column:
    s = F.greatest(F.lit(0), F.floor(ms / 1000 + 0.5)).cast("long")
    m = F.floor(s / 60).cast("string")
    return F.when(s >= 60, F.concat(m, F.lit("m "), (s % 60).cast("string"), F.lit("s"))).otherwise(F.concat(s.cast("string"), F.lit("s")))


def normalize_url(c: Column) -> Column:
    """Without one scheme prefix of a viewer, and without the first frame segment."""
    s = F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), "^(wadouri:|dicomweb:|wadors:)", "")
    return F.regexp_replace(s, r"^(.*?)/frames/[0-9]+(/.*|\?.*|)$", "$1$2")


def without_frame(c: Column) -> Column:
    s = F.regexp_replace(c, r"([?&])frame(Number)?=[^&#]*&?", "$1")
    return F.regexp_replace(s, "[?&]$", "")


def has_frame(c: Column) -> Column:
    return F.coalesce(F.rlike(c, F.lit(r"[?&]frame(Number)?=")), F.lit(False))


def age(c: Column, to: int = 5, over_89: bool = True) -> Column:
    """Ages in years rounded down to a multiple of ``to``; over 89 together; what is no age stays as it is."""
    t = F.upper(F.trim(c))
    value, unit = F.regexp_extract(t, r"^([0-9]{1,3})\s*([DWMY])$", 1), F.regexp_extract(t, r"^([0-9]{1,3})\s*([DWMY])$", 2)
    n = F.when(value != "", value).cast("int")
    n = F.when((unit == "Y") & (to > 0), F.floor(n / to) * to).otherwise(n) if to > 0 else n
    old = F.when(value != "", value).cast("int") > 89
    return F.when(value == "", c).when((unit == "Y") & old & over_89, "090Y").otherwise(F.concat(pad_left(n.cast("string")), unit))


def keyed_hash(c: Column, secret: str) -> Column:
    """HMAC-SHA-256 of a string, in hexadecimal digits. Without the secret nobody can try out values."""
    if not secret:
        raise ValueError("a secret is needed: unkeyed hashes of identifiers can be undone by trying them")
    import hashlib

    key = secret.encode() if len(secret.encode()) <= 64 else hashlib.sha256(secret.encode()).digest()
    inner, outer = (bytes(x ^ y for x in key.ljust(64, b"\0")) for y in (0x36, 0x5C))
    first = F.unhex(F.sha2(F.concat(F.lit(inner), c.cast("binary")), 256))
    return F.sha2(F.concat(F.lit(outer), first), 256)


def day_offset(subject: Column, secret: str) -> Column:
    """Days in [-1825, 1825] without 0, the same for a subject in every run and partition. Subjects that are not known
    share one offset."""
    name = F.trim(F.coalesce(subject, F.lit("")))
    known = F.when((name == "") | (name == "UNKNOWN"), NO_SUBJECT).otherwise(name)
    n = F.pmod(F.conv(F.substring(keyed_hash(F.concat(F.lit("date/"), known), secret), 1, 8), 16, 10).cast("long"), F.lit(3651)) - 1825
    return once(n, lambda n: F.when(n == 0, 1).otherwise(n)).cast("int")


def shift_date(c: Column, days: Column, keep_times: bool = False) -> Column:
    """The date moved by days; empty if its first eight digits are no date. A time of day stays only on request."""
    s = F.regexp_replace(c, "[-./ ]", "")
    day = F.when(F.rlike(s, F.lit("^[0-9]{8}")), F.try_to_date(F.substring(s, 1, 8), "yyyyMMdd"))
    moved = F.date_format(F.date_add(day, days), "yyyyMMdd")
    return F.coalesce(F.concat(moved, F.substring(s, 9, 100) if keep_times else F.lit("")), F.lit(""))


def mapped_uid(c: Column, secret: str) -> Column:
    """A new UID from a keyed hash: 2.25. and 31 digits. Empty ones stay empty."""
    part = lambda h, i: F.lpad(F.conv(F.substring(h, i, 12), 16, 10), 15, "0")
    new = once(keyed_hash(F.concat(F.lit("uid/"), c), secret), lambda h: F.concat(F.lit("2.25.1"), part(h, 1), part(h, 13)))
    return F.when(c == "", c).otherwise(new)


def retry_delay(attempt: Column, after: Column) -> Column:
    return F.coalesce(after.cast("double"), F.least(F.lit(30000.0), 500 * F.pow(F.lit(2.0), attempt - 1)))


def retryable(status: Column) -> Column:
    return (status == 408) | (status == 429) | (status >= 500)


def session_error(status: Column, kind: Column | None = None) -> Column:
    out = status.between(300, 399) | status.isin(401, 403)
    return out if kind is None else F.coalesce(out, F.lit(False)) | F.coalesce(kind == "opaqueredirect", F.lit(False))


def _says(message: Column, *words: str) -> Column:
    return F.coalesce(F.rlike(F.lower(message), F.lit("|".join(words))), F.lit(False))


def cors_error(message: Column) -> Column:
    return _says(message, "cors", "failed to fetch", "load failed", "networkerror when attempting to fetch resource", "network request failed")


def quota_error(name: Column, message: Column) -> Column:
    return F.coalesce(name == "QuotaExceededError", F.lit(False)) | _says(message, "quota", "disk", "space", "storage")


def retryable_error(name: Column, message: Column, status: Column) -> Column:
    """HTTP errors that may pass, and network errors; never what a full disk causes."""
    again = F.when(name == "HttpError", F.coalesce(retryable(status), F.lit(False))).otherwise(F.coalesce(name == "TypeError", F.lit(False)))
    return ~quota_error(name, message) & again


def retry_after(value: Column, now: Column) -> Column:
    """Milliseconds that a Retry-After header asks for (seconds or a date), at most 30 seconds; null if it is neither."""
    t = F.trim(value)
    seconds = F.when(F.rlike(t, F.lit(r"^[0-9]+(\.[0-9]+)?$")), t.cast("double"))
    date = F.try_to_timestamp(F.concat(F.regexp_extract(t, "^[A-Za-z]{3}, ([0-9]{2} [A-Za-z]{3} [0-9]{4} [0-9:]{8}) GMT$", 1), F.lit(" +0000")), F.lit("dd MMM yyyy HH:mm:ss Z"))
    wait = F.greatest(F.lit(0.0), (F.unix_millis(date) - F.unix_millis(now)).cast("double"))
    asked = F.when(seconds.isNotNull(), seconds * 1000).when(date.isNotNull(), wait)
    return F.when(asked.isNotNull(), F.least(F.lit(float(RETRY_CAP_MS)), asked))


def normalize_date(c: Column) -> Column:
    t = F.trim(c)
    return F.when(F.rlike(t, F.lit("^[0-9]{8}$")), t).otherwise("UNKNOWN_DATE")


def numeric_value(c: Column) -> Column:
    """The number that a text is; 0 for anything else."""
    t = F.trim(c.cast("string"))
    return F.coalesce(F.when(F.rlike(t, F.lit(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$")), t.cast("double")), F.lit(0.0))


def query_value(url: Column, name: str) -> Column:
    """The decoded value of a query parameter; null without it."""
    raw = F.regexp_extract(url, rf"^[^?#]*\?(?:[^#]*&)?{name}=([^&#]*)", 1)
    there = F.rlike(url, F.lit(rf"^[^?#]*\?(?:[^#]*&)?{name}="))
    return F.when(there, F.coalesce(F.try_url_decode(raw), raw))


def extension(url: Column) -> Column:
    return F.when(query_value(url, "contentType") == "video/mp4", "mp4").otherwise("dcm")


def instance_url(root: Column, study: Column, series: Column, sop: Column) -> Column:
    """The address of an instance of a web service; its frames are numbered below it."""
    return F.concat(F.regexp_replace(root, "/+$", ""), F.lit("/studies/"), study, F.lit("/series/"), series, F.lit("/instances/"), sop)


def frame_url(instance: Column, frame: Column) -> Column:
    return F.concat(instance, F.lit("/frames/"), frame.cast("string"))


def wado_uri(root: Column, study: Column, series: Column, sop: Column) -> Column:
    """The address of an object by query parameters."""
    sign = F.when(F.contains(root, F.lit("?")), "&").otherwise("?")
    parts = (F.lit("WADO"), study, series, sop, F.lit("application/dicom"), F.lit("*"))
    names = ("requestType", "studyUID", "seriesUID", "objectUID", "contentType", "transferSyntax")
    return F.concat(root, sign, F.concat_ws("&", *(F.concat(F.lit(f"{n}="), F.url_encode(p)) for n, p in zip(names, parts))))


def transfer_speed(size: Column, elapsed_ms: Column) -> Column:
    speed = size / F.greatest(F.lit(1.0), elapsed_ms / 1000)
    return F.when((size > 0) & elapsed_ms.isNotNull(), F.concat(format_bytes(speed), F.lit("/s"))).otherwise("--")


def percent_done(done: Column, total: Column) -> Column:
    return F.least(F.lit(100), F.floor(done * 100 / total + 0.5)).cast("int")


def time_left(done: Column, total: Column, elapsed_ms: Column) -> Column:
    """The rest of the items at the rate so far, in words."""
    s = F.when((done > 0) & (total > done), F.ceil((total - done) * elapsed_ms / done / 1000)).otherwise(0).cast("long")
    minutes = F.concat(F.lit("~"), F.floor(s / 60).cast("string"), F.lit("m "), (s % 60).cast("string"), F.lit("s remaining"))
    waiting = F.when(s <= 0, "Estimating time remaining…").when(s < 60, F.concat(F.lit("~"), s.cast("string"), F.lit("s remaining"))).otherwise(minutes)
    return F.when(done >= total, "Finalizing output…").otherwise(waiting)


def _joined(*cs: Column) -> Column:
    return F.concat_ws("_", *(missing(c) for c in cs))


def study_dir(date: Column, description: Column, accession: Column, limit: int = STUDY_DIR) -> Column:
    """The three parts joined; what is too long loses the end of its description first."""
    limit = max(limit, 20)
    d, a = (F.coalesce(F.length(missing(c)) + 1, F.lit(0)) for c in (date, accession))
    cut = lambda c, n: F.left(c, F.greatest(F.lit(0), n))
    without = F.when(F.length(_joined(date, accession)) <= limit, _joined(date, accession)).when((limit - d > 0) & missing(accession).isNotNull(), _joined(date, cut(accession, limit - d))).otherwise(cut(F.coalesce(missing(date), accession), F.lit(limit)))
    short = _joined(date, F.regexp_replace(cut(description, limit - d - a), "_+$", ""), accession)
    full = _joined(date, description, accession)
    return F.when(F.length(full) <= limit, full).when((limit - d - a > 0) & missing(description).isNotNull(), short).otherwise(without)


def series_dir(description: Column, number: Column, limit: int = STUDY_DIR) -> Column:
    limit = max(limit, 20)
    rest = limit - F.coalesce(F.length(missing(number)) + 1, F.lit(0))
    full, cut = _joined(description, number), F.left(description, F.greatest(F.lit(0), rest))
    short = _joined(F.regexp_replace(cut, "_+$", ""), number)
    return F.when(F.length(full) <= limit, full).when((rest > 0) & missing(description).isNotNull(), short).otherwise(F.left(F.coalesce(missing(description), number), F.lit(limit)))
