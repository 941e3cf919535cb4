"""The hierarchy of studies, series and instances: catalogue, selection and the manifest of an export.

An instance is a row with study, series, seq (its place, which decides what comes first), sop, url, has_file, frames,
modality, and the names of patient, study and series where they are known. Nothing depends on the order of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as S

# Names of modalities, and limits.
MODALITIES = {
    "CR": "Computed Radiography", "CT": "Computed Tomography", "DOC": "Document", "DX": "Digital Radiography", "ECG": "Electrocardiography", "ES": "Endoscopy",
    "IO": "Intra-Oral Radiography", "MG": "Mammography", "MR": "Magnetic Resonance", "NM": "Nuclear Medicine", "OT": "Other", "PR": "Presentation State",
    "PT": "Positron Emission Tomography", "PX": "Panoramic X-Ray", "RF": "Radio Fluoroscopy", "RG": "Radiographic Imaging", "RTDOSE": "Radiotherapy Dose",
    "RTIMAGE": "Radiotherapy Image", "RTPLAN": "Radiotherapy Plan", "RTSTRUCT": "Radiotherapy Structure Set", "SC": "Secondary Capture", "SEG": "Segmentation",
    "SM": "Slide Microscopy", "SR": "Structured Report", "US": "Ultrasound", "XA": "X-Ray Angiography", "XC": "External-Camera Photography",
}
SPLIT_GROUPS = 100
DIR_LENGTH = 120
ZIP_ENTRIES = 60_000


def download_url(static: Column, root: Column, study: Column, series: Column, sop: Column, *addresses: Column) -> Column:
    """Where an instance is fetched from: its first address in static mode; else by query parameters, where there is a
    root and the instance has its three UIDs; else its first address, unless that is a local one."""
    first = F.coalesce(*(S.missing(a) for a in addresses), F.lit(""))
    named = S.missing(root).isNotNull() & S.missing(study).isNotNull() & S.missing(series).isNotNull() & S.missing(sop).isNotNull()
    return F.when(static, first).when(named, S.wado_uri(root, study, series, sop)).when(first.startswith("dicomfile:"), "").otherwise(first)


def display_instances(sets: DataFrame) -> DataFrame:
    """Rows (id, active, instances, images, instance) of display sets -> id, instance: of the active sets if there are any,
    else of all, the instances, else the images, else the one instance."""
    some = sets.where("active").limit(1).count() > 0
    found = F.when(F.size("instances") > 0, F.col("instances")).when(F.size("images") > 0, F.col("images")).otherwise(F.array_compact(F.array("instance")))
    return (sets.where("active") if some else sets).select("id", F.explode(found).alias("instance"))


def catalogue(instances: DataFrame) -> DataFrame:
    """study, its first-seen patient and date, n (instances), series (uid, number, modality and n, by number), modalities.

    Rows without a file or url are left out, and of rows with the same study, series, sop and source the first stays.
    Series are sorted by their number (0 where it is none), then by their first instance.
    """
    source = F.coalesce(S.missing(F.col("url")), S.missing(F.col("file_name")), F.lit(""))
    usable = instances.where((F.coalesce(F.col("url"), F.lit("")) != "") | F.col("has_file")).withColumn("_source", source)
    first = usable.groupBy("study", "series", "sop", "_source").agg(F.min_by(F.struct("patient", "study_date", "number", "modality"), "seq").alias("a"), F.min("seq").alias("seq"))
    series = first.groupBy("study", "series").agg(F.min("seq").alias("seq"), F.count(F.lit(1)).alias("n"), F.min_by("a", "seq").alias("a"))
    row = F.struct(S.numeric_value(F.col("a.number")).alias("order"), "seq", "series", F.col("a.number").alias("number"), F.col("a.modality").alias("modality"), "n")
    studies = series.groupBy("study").agg(F.min_by("a", "seq").alias("a"), F.sum("n").alias("n"), F.array_sort(F.collect_list(row)).alias("series"))
    seen = F.array_distinct(F.filter(F.transform("series", lambda s: s["modality"]), lambda m: m != ""))
    return studies.select("study", "a.patient", "a.study_date", "n", "series", F.array_join(seen, "/").alias("modalities"))


def flattened(studies: DataFrame) -> DataFrame:
    """Rows (study, rank: a number that orders the studies, series: array) with the ordinals of study and series."""
    numbered = ranked(studies, "rank", "_index").withColumn("study_index", (F.col("_index") - 1).cast("long"))
    return numbered.select("study", "study_index", F.posexplode("series").alias("series_index", "series"))


def modality_code(series: Column, first_instance: Column) -> Column:
    return F.upper(F.coalesce(S.missing(series), S.missing(first_instance), F.lit("IMG")))


def modality_name(code: Column) -> Column:
    c = F.upper(F.coalesce(S.missing(code), F.lit("IMG")))
    return F.coalesce(F.create_map(*(F.lit(x) for pair in MODALITIES.items() for x in pair))[c], c)


def available_modalities(entries: DataFrame) -> DataFrame:
    """(code, label) of entries (modality), each once, by label."""
    return entries.select(F.col("modality").alias("code")).distinct().withColumn("label", modality_name(F.col("code"))).orderBy(F.lower("label"), "label")


def is_multiframe(frames: Column, url: Column) -> Column:
    return (F.coalesce(frames, F.lit(0)) > 1) | S.has_frame(S.normalize_url(url))


def object_groups(instances: DataFrame) -> DataFrame:
    """study, series, object_uid, object_url, frame_count, n, first: multiframe instances that are one object.

    An object is named by its UID, else by that in its url, else by its url, else by its place in the series."""
    place = F.row_number().over(W.partitionBy("study", "series").orderBy("seq")) - 1
    url = S.normalize_url(F.col("url"))
    rows = instances.withColumn("_place", place).where(is_multiframe(F.col("frames"), F.col("url"))).withColumn("object_url", F.when(url != "", S.without_frame(url)).otherwise(""))
    uid = F.coalesce(S.missing(F.col("sop")), S.missing(S.query_value(F.col("object_url"), "objectUID")), S.missing(F.col("object_url")), F.concat(F.lit("instance-"), F.col("_place").cast("string")))
    return rows.groupBy("study", "series", uid.alias("object_uid"), "object_url").agg(F.max(F.coalesce("frames", F.lit(0))).alias("frame_count"), F.count(F.lit(1)).alias("n"), F.min("seq").alias("first"))


def selection_entries(instances: DataFrame, most: int = SPLIT_GROUPS) -> DataFrame:
    """What can be chosen: study, series, kind, object_uid, entry (its number), frame_count, n.

    A series with 2 to ``most`` multiframe objects gives an entry for each, and one for its other instances if it has
    any; any other series is one entry."""
    groups = object_groups(instances)
    total = instances.groupBy("study", "series").agg(F.count(F.lit(1)).alias("total"), F.max(F.coalesce("frames", F.lit(0))).alias("most"))
    each = groups.groupBy("study", "series").agg(F.count(F.lit(1)).alias("objects"), F.sum("n").alias("multi"))
    series = total.join(each, ["study", "series"], "left").withColumn("split", F.coalesce(F.col("objects").between(2, most), F.lit(False)))
    none = F.lit(None).cast("string")
    whole = series.where("not split").select("study", "series", F.lit("series").alias("kind"), none.alias("object_uid"), F.lit(0).alias("entry"), F.col("most").alias("frame_count"), F.col("total").alias("n"))
    single = series.where("split and total > multi").select("study", "series", F.lit("singleframe").alias("kind"), none.alias("object_uid"), F.lit(0).alias("entry"), F.lit(0).cast("long").alias("frame_count"), (F.col("total") - F.col("multi")).alias("n"))
    entry = F.row_number().over(W.partitionBy("study", "series").orderBy("first"))
    multi = groups.join(series.where("split").select("study", "series"), ["study", "series"], "left_semi").select("study", "series", F.lit("multiframe").alias("kind"), "object_uid", entry.alias("entry"), F.col("frame_count").cast("long").alias("frame_count"), "n")
    return whole.withColumn("frame_count", F.col("frame_count").cast("long")).unionByName(single).unionByName(multi)


def toggled(entries: DataFrame, code: str) -> DataFrame:
    """entries (id, modality, selected) after a click on a modality: if all of it is selected, none of it, else all."""
    full = F.min(F.when(F.col("modality") == code, F.col("selected").cast("int"))).over(W.partitionBy(F.col("modality"))) == 1
    return entries.withColumn("selected", F.when(F.col("modality") == code, ~full).otherwise(F.col("selected")))


def chosen(entries: DataFrame, ids: DataFrame) -> DataFrame:
    """The entries whose id is in ids (id)."""
    return entries.join(ids.select("id").distinct(), "id", "left_semi")


def modality_states(entries: DataFrame) -> DataFrame:
    """(modality, label, selected, total, state) of entries (modality, selected): none, some or all."""
    n, k = F.count(F.lit(1)), F.count_if("selected")
    state = F.when(F.col("selected_count") == 0, "none").when(F.col("selected_count") == F.col("total"), "all").otherwise("some")
    return entries.groupBy("modality").agg(k.alias("selected_count"), n.alias("total")).select("modality", modality_name(F.col("modality")).alias("label"), "selected_count", "total", state.alias("state"))


def with_suffix(base: Column, k: Column) -> Column:
    """The name of the k-th that has this name, within the length of a name."""
    tail = F.concat(F.lit("_DUP"), S.pad_left(k.cast("string"), 2))
    return F.when(k == 1, base).otherwise(F.concat(F.left(base, DIR_LENGTH - F.length(tail)), tail))


def distinct_names(rows: DataFrame, parent: list[str], key: str, base: str, seq: str) -> DataFrame:
    """(parent, key, name): the keys of a parent get the names base, base_DUP02, ... by their first seq.

    A name that was itself given as a base is passed over: counting goes on until a free one is found."""
    first = rows.groupBy(*parent, key, base).agg(F.min(seq).alias("_first"))
    taken = F.collect_set(F.when(F.rlike(base, F.lit("_DUP[0-9]{2,}$")), F.col(base))).over(W.partitionBy(*parent))  # few
    k = F.row_number().over(W.partitionBy(*parent, base).orderBy("_first", key))
    named = first.withColumn("_k", k).withColumn("_taken", taken)
    return named.select(*parent, key, _free_name(F.col(base), F.col("_k"), F.col("_taken")).alias("name"))


def _free_name(base: Column, k: Column, taken: Column) -> Column:
    """The name of the k-th that has this base, among the taken ones that were themselves given."""
    # The numbers 2, 3, ... whose names are free, of which the k-th name takes the one at k - 1.
    spare = F.filter(F.sequence(F.lit(2), k + F.size(taken)), lambda n: ~F.array_contains(taken, with_suffix(base, n)))
    return with_suffix(base, F.when((k == 1) | (F.size(taken) == 0), k).otherwise(F.element_at(spare, k - 1)))


def manifest(instances: DataFrame) -> DataFrame:
    """One row per file to export: patient_dir, study_dir, series_dir, sop, url, extension, seq and the raw patient fields.

    Of rows with the same study, series, object and url the first stays, whether or not its UID is valid; then those
    without a valid UID go. Directories are neutral: the ends of UIDs, numbered where they collide. What has the same end of
    a study's UID is exchanged once and lies together then; all else is decided there, in windows over it.
    """
    url = S.normalize_url(F.col("url"))
    object_url = F.when(F.col("from_frames"), url).when(url != "", S.without_frame(url)).otherwise("")
    rows = instances.where((url != "") | F.col("has_file")).withColumn("object_url", object_url)
    sop = F.coalesce(S.missing(F.col("sop")), S.missing(S.query_value(F.col("object_url"), "objectUID")))
    some = ["seq", "study", "series", "object_url", "number", "patient_id", "patient_name"]
    rows = rows.select(*some, sop.alias("_sop"))
    end = S.short_uid(F.coalesce(S.missing(F.col("study")), F.lit("study")))
    # An object without UID and url has no valid UID whatever its place may be, so it needs no name of its own here.
    rows = rows.withColumn("_end", end).repartition("_end").withColumn("_raw", F.coalesce("_sop", S.missing(F.col("object_url"))))
    rows = rows.withColumn("_study", F.coalesce(S.missing(F.col("study")), F.lit("study"))).withColumn("_series", F.coalesce(S.missing(F.col("series")), F.lit("series")))
    over = lambda *keys: W.partitionBy("_end", *keys)
    # Sorted once for this and the next three windows, whose keys are the first of these.
    place = F.row_number().over(over("_study", "_series", "study", "series", "_raw", "object_url").orderBy("seq"))
    first = rows.withColumn("_place", place).where("_place = 1").drop("_place", "_raw", "study", "series")
    kept = first.withColumn("sop", S.valid_uid(F.col("_sop"))).where("sop is not null").drop("_sop")
    base = F.concat(F.lit("Series_"), S.series_number(F.col("number").cast("string")), F.lit("_"), S.short_uid(F.col("_series")))
    given = lambda c: F.collect_set(F.when(F.rlike(c, F.lit("_DUP[0-9]{2,}$")), c))
    kept = kept.withColumns({"_base": F.min_by(base, "seq").over(over("_study", "_series")), "_first": F.min("seq").over(over("_study", "_series"))})
    kept = kept.withColumns({"_given": given(F.col("_base")).over(over("_study")), "_study_first": F.min("_first").over(over("_study"))})
    study_base = F.concat(F.lit("Study_"), F.col("_end"))
    kept = kept.withColumn("_study_given", given(study_base).over(over()))
    kept = kept.withColumn("_k", F.dense_rank().over(over("_study", "_base").orderBy("_first", "_series")))
    kept = kept.withColumn("_study_k", F.dense_rank().over(over().orderBy("_study_first", "_study")))
    raw_of = lambda c: F.coalesce(S.missing(F.trim(c)), F.lit("UNKNOWN"))
    study_dir, series_dir = _free_name(study_base, F.col("_study_k"), F.col("_study_given")), _free_name(F.col("_base"), F.col("_k"), F.col("_given"))
    return kept.select("seq", F.col("_study").alias("study"), F.col("_series").alias("series"), "sop", F.col("object_url").alias("url"), S.extension(F.col("object_url")).alias("extension"), F.concat(F.lit("Patient_"), "_end").alias("patient_dir"), study_dir.alias("study_dir"), series_dir.alias("series_dir"), "number", raw_of("patient_id").alias("patient_id"), raw_of("patient_name").alias("patient_name"))


def person_name(alphabetic: Column, ideographic: Column, phonetic: Column) -> Column:
    return F.coalesce(*(S.missing(F.trim(c)) for c in (alphabetic, ideographic, phonetic)), F.lit(""))


def aliased(rows: DataFrame, patient_id: str, patient_name: str, secret: str, remap: bool = True) -> DataFrame:
    """Manifest rows with new_id, new_name and anonymous directories. Patients are numbered by their first row, and the
    number is part of the names where there is more than one."""
    key = F.concat("patient_id", F.lit("|"), "patient_name")
    patients = rows.groupBy(key.alias("_key")).agg(F.min("seq").alias("_first"))
    # One sorted pass over the patients: a rank within ranges of their first rows, plus the patients in earlier ranges.
    numbered = ranked(patients, "_first", "_index")
    many = F.col("_patients") > 1
    suffix = F.when(many, F.concat(F.lit("_P"), F.col("_index").cast("string"))).otherwise("")
    out = rows.withColumn("_key", key).join(numbered, "_key")
    out = out.withColumn("new_id", F.concat(S.sanitize(F.lit(patient_id), "ANON"), suffix)).withColumn("new_name", F.concat(S.sanitize(F.lit(patient_name), "ANONYMOUS"), suffix))
    out = out.withColumn("patient_dir", F.concat("new_id", F.lit("_"), "new_name")).drop("_key", "_first", "_index", "_patients")
    if not remap:
        return out
    short = lambda c: S.short_uid(S.mapped_uid(F.col(c), secret))
    number = F.coalesce(S.missing(F.col("number").cast("string")), F.lit("1"))
    out = out.withColumn("study_dir", S.study_dir(F.lit(""), F.lit("ANON_STUDY"), F.concat(F.lit("ANON_"), short("study"))))
    return out.withColumn("series_dir", S.series_dir(F.lit("ANON_SERIES"), F.concat(number, F.lit("_"), short("series"))))


def ranked(rows: DataFrame, by: str, name: str, parts: int = 64) -> DataFrame:
    """Rows with their number in the order of a numeric column (1 first), and _patients, the number of rows: ranks
    within ``parts`` ranges, so that no task sorts all of them."""
    low, high = rows.agg(F.min(by), F.max(by)).first()
    width = max(1, ((high or 0) - (low or 0)) // parts + 1)
    cut = rows.withColumn("_part", F.floor((F.col(by) - (low or 0)) / width))
    sums = {r["_part"]: r["n"] for r in cut.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most parts + 1 rows
    before, total = {}, 0
    for part in sorted(sums):
        before[part], total = total, total + sums[part]
    start = F.coalesce(*(F.when(F.col("_part") == p, n) for p, n in before.items()), F.lit(0))
    number = F.row_number().over(W.partitionBy("_part").orderBy(by)) + start
    return cut.withColumn(name, number).withColumn("_patients", F.lit(total)).drop("_part")


def selection_errors(instances: DataFrame) -> DataFrame:
    """(seq, error): what stands in the way of an export. An instance without a source has that error only."""
    url = S.normalize_url(F.col("url"))
    bad = lambda c: S.valid_uid(c).isNull()
    sop = F.coalesce(S.missing(F.col("sop")), S.query_value(url, "objectUID"))
    uids = F.array_compact(F.array(F.when(bad(F.col("study")), "study uid"), F.when(bad(F.col("series")), "series uid"), F.when(bad(sop), "sop uid")))
    return instances.select("seq", F.explode(F.when((url == "") & ~F.col("has_file"), F.array(F.lit("source"))).otherwise(uids)).alias("error"))


def start_gate(totals: DataFrame, zip_output: bool, anonymize: bool, confirmed: bool, most: int = ZIP_ENTRIES) -> DataFrame:
    """totals (files, errors) with why an export cannot start, or null."""
    gate = (
        F.when(F.col("files") == 0, "nothing selected")
        .when(F.lit(not anonymize and not confirmed), "identified export not confirmed")
        .when(F.col("errors") > 0, "manifest errors")
        .when(F.lit(zip_output) & (F.col("files") + 2 > most), "too many entries")
    )
    return totals.withColumn("blocked", gate)


def not_dicom(extension: Column) -> Column:
    return (F.coalesce(extension, F.lit("")) != "") & ~extension.isin("dcm", "dicom")


def entry_name(description: Column, number: Column, modality: Column, kind: Column, entry: Column) -> Column:
    base = F.coalesce(S.missing(F.trim(description)), F.concat(F.lit("Images "), number.cast("string"), F.lit(" / "), modality))
    return F.when(kind == "multiframe", F.concat(base, F.lit(" - grouped images "), entry.cast("string"))).otherwise(base)


def entry_meta(modality: Column, files: Column, kind: Column, frames: Column) -> Column:
    count = F.when(files > 0, F.concat(F.lit(" • "), files.cast("string"), F.when(files == 1, " image").otherwise(" images"))).otherwise("")
    together = F.when(frames > 1, F.concat(F.lit(" • "), frames.cast("string"), F.lit(" images grouped together"))).otherwise(" • grouped images")
    return F.concat(modality, count, F.when(kind == "multiframe", together).otherwise(""))


def study_label(description: Column, date: Column, modalities: Column) -> Column:
    return F.concat_ws(" • ", F.coalesce(S.missing(F.trim(description)), F.lit("Medical imaging exam")), S.missing(date), S.missing(modalities))


def series_label(number: Column, description: Column) -> Column:
    tail = F.when(S.missing(description).isNotNull(), F.concat(F.lit(" — "), description)).otherwise("")
    return F.concat(F.lit("image set "), F.coalesce(S.missing(number.cast("string")), F.lit("?")), tail)


def file_name(sop: Column, extension: Column) -> Column:
    return F.concat(sop, F.lit("."), extension)


def item_label(number: Column, description: Column, instance: Column, sop: Column, extension: Column) -> Column:
    image = F.when(S.missing(instance.cast("string")).isNotNull(), F.concat(F.lit("image "), instance.cast("string")))
    return F.concat_ws(" · ", series_label(number, description), image, F.when(S.missing(sop).isNotNull(), file_name(sop, extension)))


def display_label(number: Column, sop: Column, extension: Column) -> Column:
    return F.concat(F.lit("image set "), S.safe_name(number.cast("string")), F.lit(" / "), file_name(sop, extension))


def export_label(studies: Column, uid: Column, anonymized: bool, secret: str = "") -> Column:
    """The name of an archive, by how many studies it holds."""
    tail = "_ANON" if anonymized else ""
    name = S.mapped_uid(uid, secret) if anonymized else uid
    return (
        F.when(studies > 1, F.concat(F.lit("Imaging_"), studies.cast("string"), F.lit(f"_Exams{tail}")))
        .when((studies == 1) & S.missing(uid).isNotNull(), F.concat(F.lit("Imaging_Exam_"), S.safe_name(S.short_uid(name)), F.lit(tail)))
        .otherwise(f"Medical_Images{tail}")
    )
