"""Scores text findings for identifying information: patterns, label words, fuzzy matches, label adjacency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as S

# Patterns, label words and scores.
EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
MRN = r"(?i)\b(MRN|PATIENTID|PATIENT_ID|ID|SSN|ACC|ACCESSION)\s*[:#]?\s*([A-Z0-9-]+)\b"
PHONE = r"\b(?:\+[0-9]{1,3}[-.\s]?)?\(?[0-9]{3}\)?[-.\s]?[0-9]{3}[-.\s]?[0-9]{4}\b"
DATE = r"(?i)\b(?:[0-9]{4}[-./][0-9]{1,2}[-./][0-9]{1,2}|[0-9]{1,2}[-./][0-9]{1,2}[-./][0-9]{2,4}|[0-9]{8}|[0-9]{1,2}-[A-Z]{3}-[0-9]{2,4})\b"
LABELS = ("NAME", "PATIENT", "PATIENTNAME", "PATIENTID", "PAT", "DOB", "BIRTH", "BIRTHDATE", "MRN", "SSN", "ACC", "ACCESSION", "PHYSICIAN", "DOCTOR", "OPERATOR", "HOSPITAL", "CLINIC", "DEPT", "DEPARTMENT")
SAFE = (
    "-", "+", "=", ".", ",", ":", ";", "/", "\\", "|", "_", "*", "°", "%", "L", "R", "AP", "PA", "LAT", "MED", "SUP", "INF", "PROX", "DIST", "ANT", "POST", "RT", "LT",
    "MHZ", "GHZ", "KHZ", "HZ", "DB", "CM", "MM", "M", "KM", "IN", "FT", "KG", "G", "LB", "FPS", "GAIN", "DEPTH", "MI", "TIB", "TIC", "TIS", "FR", "DR", "PRF", "PRR",
    "KV", "KVP", "MA", "MAS", "MS", "SL", "SP", "FOV", "ST", "MONO", "COLOR", "SCALE", "GRADIENT", "MEASURE", "MEASUREMENT", "CALIPER", "TICKS", "BAR", "ZOOM", "ANGLE",
    "AREA", "VOL", "VOLUME", "STD", "MEAN", "MAX", "MIN", "US", "CT", "MR", "DX", "CR", "XA", "RF", "NM", "PT", "MG",
    "LIVER", "KIDNEY", "AORTA", "HEART", "SPLEEN", "GALLBLADDER", "PANCREAS", "BRAIN", "LUNG", "BREAST", "PROSTATE", "BLADDER", "THYROID", "SPINE", "CAROTID", "FEMORAL",
)
MEASUREMENT = r"(?i)^\s*[-+]?[0-9]+(\.[0-9]+)?\s*(CM|MM|M|HZ|KHZ|MHZ|GHZ|DB|KV|KVP|MA|MAS|FPS|MS|S|G|KG|LB|DEG|DEGREE|°|%|B|M|D|2D|3D|CC|ML|BPM|MMHG|CM2|CM3|MM2|MM3)\b"
TECHNICAL = r"(?i)^\s*(MI|TIB|TIC|TIS|GAIN|DR|FR|PRF|D)\s*[-+]?[0-9]+(\.[0-9]+)?"
METADATA_TAGS = ("00100010", "00100020", "00101000", "00100030", "00080050", "00200010", "00080090", "00081050", "00081070", "00081048", "00080080", "00081040", "00181010", "00181000")
SCORES = {"date": 90, "phone": 95, "email": 100, "mrn": 95, "label": 85}
REDACT = 50


def normalized(c: Column) -> Column:
    """Upper case letters and digits only; letters lose their accents, other characters fall away."""
    return F.regexp_replace(F.upper(F.regexp_replace(S.unaccented(c), "[^A-Za-z0-9]+", "")), "[^A-Z0-9]+", "")


def pattern_score(text: Column, word: Column | None = None) -> Column:
    hits = [F.when(F.rlike(text, F.lit(p)), SCORES[k]).otherwise(0) for k, p in (("date", DATE), ("phone", PHONE), ("email", EMAIL), ("mrn", MRN))]
    if word is not None:
        hits.append(F.when(normalized(word).isin(LABELS), SCORES["label"]).otherwise(0))
    return F.greatest(*hits)


def fuzzy(a: Column, b: Column, most: int = 2) -> Column:
    """Equal; or of four letters and more, one within the other, or few edits for their length."""
    d, longest = F.levenshtein(a, b, most), F.greatest(F.length(a), F.length(b))  # -1: more than that
    both = (F.length(a) >= 4) & (F.length(b) >= 4)
    return (a == b) | both & (F.contains(a, b) | F.contains(b, a) | (d >= 0) & (d / longest <= 0.35))


def _deletions(c: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.concat(c.substr(F.lit(1), i - 1), c.substr(i + 1, F.length(c))))


def _neighbourhood(c: Column) -> Column:
    """Hashes of a value without 0, 1 and 2 of its letters: values at most two edits apart share one."""
    one = _deletions(c)
    every = F.concat(F.array(c), one, F.flatten(F.transform(one, _deletions)))
    return F.transform(F.array_distinct(every), lambda x: F.xxhash64(x))


def _parts(c: Column, size: Column) -> Column:
    """The distinct parts of a value that have the given size, which it has at least."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - size + 1), lambda i: c.substr(i, size)))


def fuzzy_pairs(known: DataFrame, tokens: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) with fuzzy(a, b) of the values a of known and b of tokens. Candidates are equal, hold one
    another, or share a hash of their neighbourhoods; nothing is broadcast that grows with the input."""
    known, tokens = known.select("a").where("a is not null").distinct(), tokens.select("b").where("b is not null").distinct()
    sizes = sorted(r[0] for r in known.select(F.length("a")).distinct().collect())  # a row for each length
    long = [n for n in sizes if n >= 4]
    found = known.join(tokens, F.col("a") == F.col("b"))
    if long:
        a, b = known.where(F.length("a") >= 4), tokens.where(F.length("b") >= 4)
        inner = F.flatten(F.transform(F.sequence(F.lit(4), F.length("a")), lambda n: _parts(F.col("a"), n)))
        found = found.unionByName(a.select("a", F.explode(inner).alias("b")).join(b, "b", "left_semi"))
        fit = F.filter(F.array(*map(F.lit, long)), lambda n: n <= F.length("b"))
        outer = b.select("b", F.explode(fit).alias("n")).select("b", F.explode(_parts(F.col("b"), F.col("n"))).alias("a"))
        found = found.unionByName(outer.join(a, "a", "left_semi"))
        near = b.where(F.length("b").between(long[0] - 2, long[-1] + 2)).select("b", F.explode(_neighbourhood(F.col("b"))).alias("key"))
        near = a.select("a", F.explode(_neighbourhood(F.col("a"))).alias("key")).join(near, "key").select("a", "b")
        found = found.unionByName(near.where(F.abs(F.length("a") - F.length("b")) <= 2))
    return found.where(fuzzy(F.col("a"), F.col("b"))).distinct()  # what is not similar is not shuffled again


def reading_lines(boxes: DataFrame, step: int = 10, frame: str = "frame") -> DataFrame:
    """Boxes (frame, x, y) with the number of their line: a new one where y grows by more than ``step``."""
    w = W.partitionBy(frame).orderBy("y", "x")
    new = (F.col("y") - F.lag("y").over(w) > step).cast("int")
    return boxes.withColumn("line", F.sum(F.coalesce(new, F.lit(0))).over(w))


def label_adjacency(boxes: DataFrame, frame: str = "frame") -> DataFrame:
    """Boxes (frame, seq, x, y, w, label, keep, safe) with redact: a kept box goes if the run of boxes that are linked
    to its left begins with a label. A run goes on over kept, unsafe boxes that stand close to the one before.

    The last label and the last break up to a box decide, so one window per frame does it, without a loop.
    """
    w = W.partitionBy(frame).orderBy("seq")
    to_here = w.rowsBetween(W.unboundedPreceding, W.currentRow)
    gap = F.col("x") - (F.lag("x").over(w) + F.lag("w").over(w))
    linked = F.coalesce((F.abs(F.col("y") - F.lag("y").over(w)) <= 15) & (F.col("x") > F.lag("x").over(w)) & (gap <= 50), F.lit(False))
    out = boxes.withColumn("_on", linked & F.col("keep") & ~F.col("safe"))
    label = F.max(F.when(F.col("label"), F.col("seq"))).over(to_here)
    cut = F.max(F.when(~F.col("label") & ~F.col("_on"), F.col("seq"))).over(to_here)
    return out.withColumn("redact", F.col("_on") & ~F.col("label") & (F.coalesce(label, F.lit(-1)) > F.coalesce(cut, F.lit(-1)))).drop("_on")


def safe_token(text: Column) -> Column:
    """Signs, measures and technical or anatomical words that identify nobody; nothing at all is safe too."""
    t, norm = F.trim(text), normalized(text)
    return (norm == "") | F.upper(t).isin(*SAFE) | norm.isin(*SAFE) | F.rlike(t, F.lit(MEASUREMENT)) | F.rlike(t, F.lit(TECHNICAL))


def label_word(text: Column) -> Column:
    """Whether one of the text's words names something that identifies a person."""
    parts = F.split(F.upper(text), r"[\s_:\-^/,.\[\]]+")
    return F.exists(F.transform(parts, lambda w: F.regexp_replace(w, "[^A-Z]", "")), lambda w: (F.length(w) >= 3) & w.isin(*LABELS))


def metadata_values(attrs: DataFrame) -> DataFrame:
    """(instance_id, known): what the attributes at the top say about persons and places, whole and in parts, normalised."""
    value = F.explode(F.split("value", r"\\")).alias("v")
    whole = attrs.where(F.col("path").isin(*METADATA_TAGS)).select("instance_id", value).select("instance_id", F.trim("v").alias("v")).where("v <> ''")
    parts = F.filter(F.split("v", r"[\^,/\-_\s]+"), lambda p: F.length(p) >= 2)
    each = whole.select("instance_id", F.explode(F.concat(F.array("v"), parts)).alias("v")).select("instance_id", normalized(F.col("v")).alias("v"))
    return each.where(F.length("v") >= 2).groupBy("instance_id").agg(F.array_sort(F.collect_set("v")).alias("known"))


def classify(findings: DataFrame, metadata: DataFrame | None = None) -> DataFrame:
    """findings (instance_id, frame, x, y, w, text) -> with score, decision and by_label (a label beside it
    decides), in reading order (seq in the frame).

    A match with the instance's metadata (instance_id, known) redacts; safe tokens stay; then patterns and label words
    decide; at last a box right of a label goes with it. A null text is an empty one.
    """
    rows = findings.withColumn("text", F.coalesce(F.trim("text"), F.lit("")))
    if metadata is None:
        rows = rows.withColumn("known", F.array().cast("array<string>"))
    else:
        rows = rows.join(metadata.select("instance_id", "known"), "instance_id", "left")
    rows = rows.withColumn("_norm", normalized(F.col("text")))
    match = F.coalesce(F.exists("known", lambda k: fuzzy(F.col("_norm"), k)), F.lit(False)) & (F.col("_norm") != "")
    label = label_word(F.col("text")) & ~F.col("_match") & ~F.col("_safe")
    score = F.when(F.col("_match"), 100).when(F.col("_safe"), 0).otherwise(F.greatest(pattern_score(F.col("text")), F.when(F.col("_label"), SCORES["label"]).otherwise(0)))
    rows = rows.withColumn("_match", match).withColumn("_safe", safe_token(F.col("text"))).withColumn("_label", label).withColumn("_score", score)
    rows = reading_lines(rows.withColumn("_frame", F.struct("instance_id", "frame")), frame="_frame")
    rows = rows.withColumn("seq", F.row_number().over(W.partitionBy("_frame").orderBy("line", "x", "text")))
    boxes = rows.select("*", F.col("_label").alias("label"), (F.col("_score") < REDACT).alias("keep"), F.col("_safe").alias("safe"))
    out = label_adjacency(boxes, frame="_frame")
    final = F.when(F.col("redact"), 90).otherwise(F.col("_score")).alias("score")
    return out.select("instance_id", "frame", "seq", "x", "y", "w", "text", final, F.col("redact").alias("by_label"), F.when(F.col("redact") | (F.col("_score") >= REDACT), "redact").otherwise("keep").alias("decision"))
