"""Attribute rules: one row per attribute, rules by a broadcast join, precedence as one CASE chain.

An attribute table has instance_id, path, tag, vr and value. The path of an attribute in a sequence's item is
``SEQUENCE[item].TAG``, nested as deep as needed; several values are separated by a backslash. A sequence's own value is
its number of items (null: some). What an attribute's ancestors or neighbours decide comes from lists over the rows of its
instance, so one exchange by instance is all that a walk needs. A table of whole instances (instance_id and attributes, an
array of path, tag, vr and value) needs none.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as S

# Tags that carry hidden payloads, tags of the walk's special cases, and the rules that a flag keeps.
HAZARDS = ("00420011", "04000520")
PHYSICIANS = ("00080090", "00081050", "00081048", "00081070", "00081060")
ACQUISITION = ("00180010", "00180050", "00180080", "00180081", "00180087", "00180600", "00181151", "00181152")
COMMENTS = ("00204000", "00084000")
META_KEPT = ("00020000", "00020001", "00020002", "00020010", "00020012")
INVARIANT_UIDS = ("00020002", "00020010", "00041510", "00041512", "00080016", "0008010C", "00081150")
NEVER_KEPT = ("00120062", "00120063", "00120064")
CONTENT = "0040A730"
VALUE_TYPE = "0040A040"
VALUE_TYPES = ("CONTAINER", "TEXT", "CODE", "NUM", "PNAME", "DATE", "TIME", "DATETIME", "UIDREF", "IMAGE", "COMPOSITE", "WAVEFORM", "SCOORD", "SCOORD3D", "TCOORD")
CONTENT_TEXT = ("0040A160", "00700006")
CONTENT_NAMES = ("0040A123", "0040A075")
CONTENT_DATES = ("0040A120", "0040A121", "0040A13A", "0040A030", "0040A032")
CONTENT_SKELETON = ("0040A010", "0040A040", "0040A043", "0040A730")
HEAD_PARTS = ("HEAD", "BRAIN", "FACE", "NECK", "CRANIUM", "SKULL")
#: Rules are broadcast up to this many rows; a tag has one rule, so a table is small.
RULE_ROWS = 100_000


@dataclass
class Options:
    """How attributes are treated. The secret keys the UIDs and the offsets of dates, and has to be given."""

    secret: str
    whitelist: str | tuple = ()
    newPatientName: str = "ANONYMOUS"
    newPatientId: str = "ANON"
    newPatientBirthDate: str = ""
    newAccessionNumber: str = ""
    newPatientSex: str = ""
    newStudyDescription: str = ""
    newSeriesDescription: str = ""
    implementationVersion: str = "SILVERCASK"
    keepOverlays: bool = False
    keepCurves: bool = False
    keepPhysicians: bool = False
    keepAcquisitionParameters: bool = False
    keepComments: bool = False
    keepDescriptors: bool = False
    keepSeriesDescriptors: bool = False
    keepProtocolName: bool = False
    keepPatientCharacteristics: bool = False
    keepDeviceIdentity: bool = False
    keepInstitutionIdentity: bool = False
    keepExactTimes: bool = False
    keepDates: bool = False
    remapUids: bool = True
    preserveUidReferences: bool = True
    aggregateAgesOver89: bool = True
    roundAgeToYears: int = 5
    privateTags: str = "remove_all"  # or keep_safe, keep_all
    structuredContent: str = "remove"  # or sanitize
    addContributingEquipment: bool = False


def whitelist_tags(given: str | tuple | list) -> list[str]:
    """Tags of 8 hexadecimal digits, in any writing, in their order, each once."""
    import re

    parts = re.split(r"[,;\s]+", given) if isinstance(given, str) else given
    clean = (re.sub("[^0-9A-Fa-f]", "", str(x or "")).upper() for x in parts)
    return list(dict.fromkeys(x for x in clean if len(x) == 8))


def whitelist_rows(texts: DataFrame, rules: DataFrame, private: str = "Private Attribute (Vendor Specific)") -> DataFrame:
    """Rows (id, text) of whitelists -> id, tag, name: the tags in them, each once, with the rules' names for them;
    those of odd groups that have none are ``private``."""
    tag = F.upper(F.regexp_replace("part", "[^0-9A-Fa-f]", ""))
    tags = texts.select("id", F.explode(F.split("text", r"[,;\s]+")).alias("part")).select("id", tag.alias("tag")).where(F.length("tag") == 8).distinct()
    unknown = F.when(_odd(), private).otherwise("Unknown DICOM Attribute")
    return tags.join(_small(rules.select("tag", "name")), "tag", "left").select("id", "tag", F.coalesce(S.missing(F.col("name")), unknown).alias("name"))


def _small(rules: DataFrame) -> DataFrame:
    return F.broadcast(rules) if rules.limit(RULE_ROWS + 1).count() <= RULE_ROWS else rules


def _each(c: Column, f) -> Column:
    """f on each of several values."""
    return F.array_join(F.transform(F.split(c, r"\\"), f), "\\")


def _over_rows(which, value) -> Column:
    """The values of those attributes of an instance, from the rows of a window. Both read an attribute by ``at(name)``."""
    return F.collect_list(F.when(which(F.col), value(F.col))).over(W.partitionBy("instance_id"))


def _in_array(which, value) -> Column:
    """The same from the attributes of a whole instance."""
    return F.transform(F.filter("attributes", lambda a: which(a.getField)), lambda a: value(a.getField))


def _subject_values(listed) -> Column:
    """The attributes (path, value) of an instance that may say whose it is."""
    return listed(lambda at: at("path").isin("00100020", "00100010", "00100030", "0020000D"), lambda at: F.struct(at("path").alias("path"), at("value").alias("value")))


def subject_key(values: Column | None = None) -> Column:
    """Over the rows of an instance: its patient id, else name and birth date, else study, else the instance itself."""
    return S.once(_subject_values(_over_rows) if values is None else values, _subject)


def _subject(values: Column) -> Column:
    top = lambda tag: F.coalesce(F.array_max(F.transform(F.filter(values, lambda v: v["path"] == tag), lambda v: F.trim(v["value"]))), F.lit(""))
    patient, name, birth, study = (top(t) for t in ("00100020", "00100010", "00100030", "0020000D"))
    return (
        F.when((patient != "") & (patient != "UNKNOWN"), patient)
        .when((name != "") | (birth != ""), F.concat(F.lit("NAME_"), name, F.lit("_DOB_"), birth))
        .when(study != "", F.concat(F.lit("STUDY_"), study))
        .otherwise(F.concat(F.lit("INSTANCE_"), F.col("instance_id").cast("string")))
    )


def _within(paths: Column) -> Column:
    """Whether one of the paths is that of a sequence around the row's attribute."""
    return F.exists(paths, lambda p: F.startswith(F.col("path"), F.concat(p, F.lit("["))))


def _holds(paths: Column) -> Column:
    """Whether one of the paths is within the row's sequence."""
    return F.exists(paths, lambda p: F.startswith(p, F.concat(F.col("path"), F.lit("["))))


def _dataset(path: Column) -> Column:
    """The path of the item around an attribute, with its dot; empty at the top."""
    return F.regexp_replace(path, "[0-9A-Za-z]{8}$", "")


def _element(tag: Column) -> Column:
    return F.conv(F.substring(tag, 5, 4), 16, 10).cast("int")


def _creators(listed) -> Column:
    """The elements (path, value) of an instance that name creators of private attributes."""
    named = lambda at: _odd(at("tag")) & _element(at("tag")).between(0x10, 0xFF) & (F.coalesce(at("value"), F.lit("")) != "")
    return listed(named, lambda at: F.struct(at("path").alias("path"), at("value").alias("value")))


def safe_private(attrs: DataFrame, safe: DataFrame) -> DataFrame:
    """Private attributes (with _creators) with is_safe: creator elements always; others if the element that names their
    creator stands in the same item and safe (creator, grp, lo, hi: ranges of the low byte) lists them."""
    element = _element(F.col("tag"))
    block = F.floor(element / 256).cast("int")
    creator_tag = F.concat(F.substring("tag", 1, 4), F.lit("00"), F.lpad(F.hex(block), 2, "0"))
    is_creator = element.between(0x10, 0xFF)
    wanted = F.concat(_dataset(F.col("path")), creator_tag)
    creator = F.when(block >= 0x10, F.get(F.filter(F.col("_creators"), lambda c: c["path"] == F.col("_wanted")), F.lit(0))["value"])
    rules = safe.groupBy("creator", F.lower("grp").alias("grp")).agg(F.collect_list(F.struct("lo", "hi")).alias("_ranges"))
    rows = attrs.withColumn("_wanted", wanted).withColumn("_creator", F.split(creator, r"\\")[0]).drop("_creators", "_wanted")
    rows = rows.join(_small(rules), (F.col("_creator") == F.col("creator")) & (F.lower(F.substring("tag", 1, 4)) == F.col("grp")), "left")
    listed = F.coalesce(F.exists("_ranges", lambda r: (element % 256 >= r["lo"]) & (element % 256 <= r["hi"])), F.lit(False))
    return rows.withColumn("is_safe", is_creator | listed).drop("_creator", "creator", "grp", "_ranges")


def _odd(tag: Column | None = None) -> Column:
    return F.conv(F.substring("tag" if tag is None else tag, 4, 1), 16, 10).cast("int") % 2 == 1


def _own_action(o: Options, at) -> Column:
    """What the rules say of an attribute by itself; remove? is a sequence that goes if no UID within has to stay. The
    first case that applies decides."""
    tag, vr, rule = at("tag"), at("vr"), at("rule")
    group = F.substring(tag, 1, 4)
    private = F.lit("keep") if o.privateTags == "keep_all" else F.when((vr != "SQ") & at("is_safe"), "keep").otherwise("remove") if o.privateTags == "keep_safe" else F.lit("remove")
    out = F.when(tag.isin(whitelist_tags(o.whitelist)), "keep")
    for flag, which in ((o.keepOverlays, group.startswith("60")), (o.keepCurves, group.startswith("50")), (o.keepPhysicians, tag.isin(*PHYSICIANS)), (o.keepAcquisitionParameters, tag.isin(*ACQUISITION)), (o.keepComments, tag.isin(*COMMENTS))):
        out = out.when(which, "keep") if flag else out
    for value, which in ((o.newPatientSex, "00100040"), (o.newStudyDescription, "00081030"), (o.newSeriesDescription, "0008103E")):
        out = out.when(tag == which, "replace") if value else out
    meta = F.when(tag == "00020003", "uid" if o.remapUids else "keep").when(tag == "00020013", "replace").when(tag.isin(*META_KEPT), "keep").otherwise("remove")
    items = (vr == "SQ") & ~F.coalesce(at("value").isin("", "0"), F.lit(False))
    return (
        out.when(_odd(tag), private)
        .when(rule.isNull() & (group == "0002"), meta)
        .when(rule.isNull(), "remove")
        .when(items & (tag == CONTENT), "sanitize" if o.structuredContent == "sanitize" else "remove")
        .when(items & F.contains(rule, F.lit("@remove")), "remove?" if o.preserveUidReferences else "remove")
        .when(items, "recurse")
        .when((vr == "TM") & F.lit(not o.keepExactTimes), "remove")
        .when(vr == "UI", F.when(tag.isin(*INVARIANT_UIDS) | F.lit(not o.remapUids), "keep").otherwise("uid"))
        .otherwise(at("_says"))
    )


def _says(o: Options) -> Column:
    """What a rule says of its tag where nothing before it in the chain decides: worked out once a rule, not once a row."""
    tag, rule = F.col("tag"), F.col("rule")
    has = lambda word: F.contains(rule, F.lit(word))
    keep = lambda flag: F.lit("keep" if flag else "remove")
    return (
        F.when((rule == "") | (rule == "@keep"), "keep")
        .when(has("@empty"), "empty")
        .when(has("@uid"), "uid" if o.remapUids else "keep")
        .when(has("@ptid"), F.when(tag == "00100010", "name").otherwise("patient"))
        .when(has("@birthdate"), "birthdate")
        .when(has("@acc"), "accession")
        .when(has("@hashdate"), "keep" if o.keepDates else "shift")
        .when(has("@age"), "age" if o.keepPatientCharacteristics else "remove")
        .when(has("@characteristic"), keep(o.keepPatientCharacteristics))
        .when(has("@device"), keep(o.keepDeviceIdentity))
        .when(has("@institution"), keep(o.keepInstitutionIdentity))
        .when(has("@keepseriesdescriptor"), keep(o.keepDescriptors or o.keepSeriesDescriptors))
        .when(has("@keepprotocolname"), keep(o.keepDescriptors or o.keepProtocolName))
        .when(has("@keepdescriptor"), keep(o.keepDescriptors))
        .when(rule.startswith("@"), "remove")  # @remove, and what is not known
        .otherwise("keep")
    )


def _content_action(at) -> Column:
    """Within structured content: texts and names go, UIDs and dates are mapped whatever the options say, private
    attributes go, and of an item of unknown type only its skeleton stays."""
    own_type = F.get(F.filter("_types", lambda t: t["path"] == F.concat(_dataset(at("path")), F.lit(VALUE_TYPE))), F.lit(0))["value"]
    tag, kind = at("tag"), F.upper(F.coalesce(F.get(F.split(own_type, r"\\"), F.lit(0)), F.lit("")))
    return (
        F.when((kind != "") & ~kind.isin(*VALUE_TYPES) & ~tag.isin(*CONTENT_SKELETON), "remove")
        .when(_odd(tag), "remove")
        .when((at("vr") == "PN") | tag.isin(*CONTENT_NAMES), "name")
        .when(tag.isin(*CONTENT_TEXT), "text")
        .when(tag == "0040A124", "uid")
        .when(tag.isin(*CONTENT_DATES), "shift")
        .when(tag == "0040A122", "empty")
        .when(at("vr") == "SQ", "recurse")
        .otherwise("keep")
    )


def _outermost(at) -> Column:
    """What is done with the outermost sequence around an attribute that is not walked through; null without one."""
    found = F.array_min(F.filter("_around", lambda s: F.startswith(at("path"), s["path"])))["_own"]
    return F.when(F.contains(at("path"), F.lit("[")), found)


def _with_lookup(rows: DataFrame, table: DataFrame) -> tuple[DataFrame, object]:
    """Whole instances with _rules, the rules by group and tag, and what reads an attribute of the array with its rule."""
    group = table.groupBy(F.substring("tag", 1, 4).alias("g")).agg(F.map_from_entries(F.collect_list(F.struct("tag", F.struct("rule", "_says")))).alias("m"))
    found = lambda a: F.try_element_at(F.try_element_at(F.col("_rules"), F.substring(a["tag"], 1, 4)), a["tag"])
    # A sequence is never safe by a list of private attributes.
    reader = lambda a: lambda name: found(a)[name] if name in ("rule", "_says") else F.lit(False) if name == "is_safe" else a[name]
    return rows.crossJoin(F.broadcast(group.agg(F.map_from_entries(F.collect_list(F.struct("g", "m"))).alias("_rules")))), reader


def _with_own(rows: DataFrame, table: DataFrame, o: Options, safe: DataFrame | None) -> DataFrame:
    """Rows with their rule and _own, what it says of them."""
    if o.privateTags == "keep_safe":
        rows = rows.withColumn("is_safe", _element(F.col("tag")).between(0x10, 0xFF)) if safe is None else safe_private(rows, safe)
    return rows.join(table, "tag", "left").withColumn("_own", _own_action(o, F.col))


def apply_rules(attrs: DataFrame, rules: DataFrame, options: Options, safe: DataFrame | None = None) -> DataFrame:
    """attrs (instance_id, path, tag, vr, value and, where known, subject) and rules (tag, rule) -> with action and new_value.

    Removed attributes stay as rows with action remove; what is within a removed sequence leaves no rows. Sequences that
    are kept without a look inside keep all that is in them. safe: private attributes that privateTags='keep_safe' keeps.
    attrs may be whole instances (instance_id, attributes, maybe subject), one row each: then nothing is exchanged.
    """
    o, whole, few = options, "attributes" in attrs.columns, rules.limit(RULE_ROWS + 1).count() <= RULE_ROWS
    if whole and not few:
        attrs, whole = attrs.select(*(c for c in attrs.columns if c != "attributes"), F.inline("attributes")), False
    listed = _in_array if whole else _over_rows
    sanitizes, lists = o.structuredContent == "sanitize", o.privateTags == "keep_safe" and safe is not None
    table = rules.select("tag", F.trim("rule").alias("rule")).withColumn("_says", _says(o))
    table = F.broadcast(table) if few else table
    path = lambda at: at("path")
    typed = {"_types": listed(lambda at: at("tag") == VALUE_TYPE, lambda at: F.struct(at("path").alias("path"), at("value").alias("value")))} if sanitizes else {}
    uids = {"_uids": listed(lambda at: (at("vr") == "UI") & ~at("tag").isin(*INVARIANT_UIDS), path)} if o.preserveUidReferences else {}
    rows = attrs if "subject" in attrs.columns else attrs.withColumn("subject", subject_key(_subject_values(listed)))
    rows = rows.withColumn("_creators", _creators(listed)) if lists else rows
    sequence = lambda at, own: F.struct(F.length(at("path")).alias("size"), F.concat(at("path"), F.lit("[")).alias("path"), own.alias("_own"))
    if whole:
        rows, reader = _with_lookup(rows, table)
        around = F.transform(F.filter("attributes", lambda a: a["vr"] == "SQ"), lambda a: sequence(a.getField, _own_action(o, reader(a))))
    else:
        rows = _with_own(rows, table, o, safe)
        around = _over_rows(lambda at: at("vr") == "SQ", lambda at: sequence(at, at("_own")))
    rows = rows.withColumns(typed | uids | {"_around": around})
    stays = lambda s: F.exists("_uids", lambda p: F.startswith(p, s["path"])) if o.preserveUidReferences else F.lit(False)
    rows = rows.withColumn("_around", F.filter("_around", lambda s: s["_own"].isin("remove", "keep", "sanitize") | ((s["_own"] == "remove?") & ~stays(s)))).drop("_uids", "_rules")
    lost = listed(lambda at: (at("vr") == "SQ") & (_outermost(at) == "sanitize") & (_content_action(at) == "remove"), path)
    rows = rows.withColumn("_lost", lost) if sanitizes else rows
    if whole:
        rows = rows.select(*(c for c in rows.columns if c != "attributes"), F.inline("attributes"))
    out = rows.withColumn("_outer", _outermost(F.col)).where("_outer is null or _outer not in ('remove', 'remove?')")
    out = out.where(~_within(F.col("_lost"))) if sanitizes else out
    goes = F.exists("_around", lambda s: (s["_own"] == "remove?") & (s["path"] == F.concat("path", F.lit("["))))
    out = out.withColumn("_goes", F.when(F.col("vr") == "SQ", goes)).drop("_around", "_lost")
    out = _with_own(out, table, o, safe) if whole else out
    own = F.when(F.col("_own") == "remove?", F.when(F.col("_goes"), "remove").otherwise("recurse")).otherwise(F.col("_own"))
    action = F.when(F.col("_outer") == "keep", "keep")
    action = (action.when(F.col("_outer") == "sanitize", _content_action(F.col)) if sanitizes else action).otherwise(own)
    # Of all that is removed at the end, these three stand at the top.
    out = out.withColumn("action", F.when(F.col("path").isin(*NEVER_KEPT), "remove").otherwise(action))
    a, value = F.col("action"), F.col("value")
    days = S.day_offset(F.col("subject"), o.secret)
    fixed = {"00020013": o.implementationVersion, "00100040": o.newPatientSex, "00081030": o.newStudyDescription, "0008103E": o.newSeriesDescription}
    replaced = F.coalesce(*(F.when(F.col("tag") == t, v) for t, v in fixed.items()))
    new = (
        F.when(a.isin("keep", "recurse", "sanitize"), value)
        .when(a == "empty", "")
        .when(a == "text", "[REMOVED]")
        .when(a == "replace", replaced)
        .when(a == "uid", _each(value, lambda v: S.mapped_uid(v, o.secret)))
        .when(a == "name", o.newPatientName)
        .when(a == "patient", o.newPatientId)
        .when(a == "birthdate", o.newPatientBirthDate)
        .when(a == "accession", o.newAccessionNumber)
        .when(a == "shift", _each(value, lambda v: S.shift_date(v, days, o.keepExactTimes)))
        .when(a == "age", _each(value, lambda v: S.age(v, o.roundAgeToYears, o.aggregateAgesOver89)))
    )
    plain = F.regexp_replace("new_value", r"[-./\s]", "")
    out = out.withColumn("new_value", new).withColumn("new_value", F.when((F.col("vr") == "DA") & (a != "remove"), plain).otherwise(F.col("new_value")))
    out = out.drop("_own", "_outer", "_goes", "_types", "_says", "_creators", "is_safe")
    return _with_equipment(out) if o.addContributingEquipment else out


def _with_equipment(out: DataFrame) -> DataFrame:
    """An item of sequence 0018A001 that says what was done, after the items that are there."""
    stays = (F.col("path") == "0018A001") & (F.col("action") != "remove")
    last = F.max(F.regexp_extract("path", r"^0018A001\[([0-9]+)\]", 1).try_cast("int"))
    each = out.groupBy("instance_id").agg(F.coalesce(last + 1, F.lit(0)).alias("k"), F.coalesce(F.max(stays), F.lit(False)).alias("there"))
    item = F.concat(F.lit("0018A001["), F.col("k").cast("string"), F.lit("]."))
    code = F.concat(item, F.lit("0040A170[0]."))
    # The standard's code for equipment that de-identifies.
    rows = [(F.lit(""), "0018A001", "SQ", None), (item, "0040A170", "SQ", "1"), (code, "00080100", "SH", "109104"), (code, "00080102", "SH", "DCM"), (code, "00080104", "LO", "De-identifying Equipment"), (item, "00081090", "LO", "silvercask"), (item, "0018A003", "ST", "De-identified attribute by attribute")]
    made = F.array(*(F.struct(F.concat(p, F.lit(t)).alias("path"), F.lit(t).alias("tag"), F.lit(v).alias("vr"), F.lit(x).cast("string").alias("new_value")) for p, t, v, x in rows))
    added = each.select("instance_id", "there", F.explode(made).alias("r")).where("not (there and r.path = '0018A001')").select("instance_id", "r.*", F.lit("add").alias("action"))
    return out.where("path <> '0018A001' or action <> 'remove'").unionByName(added, allowMissingColumns=True)


def method_codes(o: Options) -> list[tuple[str, str]]:
    """The standard's codes for how attributes were treated, with their meanings; for files whose pixels are known to be
    clean, which no run claims by itself."""
    # Codes of the standard.
    codes = [("113100", "Basic Application Confidentiality Profile")]
    codes += [("113108", "Retain Patient Characteristics Option")] * o.keepPatientCharacteristics
    codes += [("113109", "Retain Device Identity Option")] * o.keepDeviceIdentity
    codes += [("113112", "Retain Institution Identity Option")] * o.keepInstitutionIdentity
    codes += [("113106", "Retain Longitudinal Temporal Information Full Dates Option") if o.keepDates else ("113107", "Retain Longitudinal Temporal Information Modified Dates Option")]
    codes += [("113110", "Retain UIDs Option")] * (not o.remapUids)
    codes += [("113111", "Retain Safe Private Option")] * (o.privateTags == "keep_safe")
    codes += [("113104", "Clean Structured Content Option")] * (o.structuredContent == "sanitize")
    return codes


def contains_remappable_uid(attrs: DataFrame) -> DataFrame:
    """The sequences (instance_id, path) with has_uid: whether any UID that a new one would replace is within them."""
    uids = F.collect_list(F.when((F.col("vr") == "UI") & ~F.col("tag").isin(*INVARIANT_UIDS), F.col("path"))).over(W.partitionBy("instance_id"))
    return attrs.withColumn("_uids", uids).where("vr = 'SQ'").select("instance_id", "path", _holds(F.col("_uids")).alias("has_uid"))


def warnings(attrs: DataFrame) -> DataFrame:
    """(instance_id, warning): pictures that may show a face, and those said to have text burned in."""
    top = lambda tag: F.max(F.when(F.col("path") == tag, F.upper(F.trim("value"))))
    each = attrs.where(F.col("path").isin("00180015", "00280301")).groupBy("instance_id").agg(top("00180015").alias("part"), top("00280301").alias("burned"))
    found = F.array_compact(F.array(F.when(head_part(F.col("part")), "face"), F.when(F.col("burned") == "YES", "burned in")))
    return each.select("instance_id", F.explode(found).alias("warning"))


def head_part(body_part: Column) -> Column:
    return F.coalesce(F.rlike(F.upper(body_part), F.lit("|".join(HEAD_PARTS))), F.lit(False))


def burned_in(value: Column) -> Column:
    return F.coalesce(F.upper(F.trim(value)).isin("YES", "Y", "1"), F.lit(False))


def hazardous(attrs: DataFrame) -> DataFrame:
    """Instances with a non-empty hidden payload anywhere."""
    return attrs.where(F.col("tag").isin(*HAZARDS) & (F.length("value") > 0)).select("instance_id").distinct()


def rule_diff(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Tags of two rule tables (tag, rule) with their status; where rules differ, that of the second stands."""
    a, b = ours.select("tag", F.col("rule").alias("a")), theirs.select("tag", F.col("rule").alias("b"))
    status = F.when(F.col("a").isNull(), "Missing in JSON").when(F.col("b").isNull(), "Only in JSON").when(F.col("a") == F.col("b"), "Match").otherwise("Rule Mismatch")
    return a.join(b, "tag", "full_outer").select("tag", status.alias("status"), F.coalesce("b", "a").alias("rule"))
