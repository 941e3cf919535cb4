"""An export from end to end: what is selected is fetched, checked, de-identified and written, and a row says what came of
each item. Every step is a table in a folder, so a run that breaks off goes on with the items that are not written."""

from __future__ import annotations

from dataclasses import fields, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import fetch as source
from ..sources import part10
from . import archive, deid, report
from .records import payload_check

# What the named profiles keep beyond the default.
PRESETS: dict[str, dict] = {
    "strict": {},
    "research": {"keepSeriesDescriptors": True, "keepProtocolName": True, "keepAcquisitionParameters": True, "privateTags": "keep_safe", "structuredContent": "sanitize"},
    "retain_dates": {"keepDates": True, "keepExactTimes": True, "keepDescriptors": True, "keepPhysicians": True},
    "preserve_all": {
        "remapUids": False, "keepDates": True, "keepExactTimes": True, "keepDescriptors": True, "keepPhysicians": True, "keepAcquisitionParameters": True, "keepComments": True,
        "keepOverlays": True, "keepCurves": True, "keepPatientCharacteristics": True, "keepDeviceIdentity": True, "keepInstitutionIdentity": True, "privateTags": "keep_all",
    },
}


class NothingSaved(RuntimeError):
    """All items of an export failed, or its session ended."""


def preset(name: str, secret: str, **changes) -> deid.Options:
    return replace(deid.Options(secret), **PRESETS[name], **changes)


def deviations(options: deid.Options) -> list[str]:
    """The options that are not as in the strict profile."""
    plain = deid.Options(options.secret)
    return [f.name for f in fields(options) if getattr(options, f.name) != getattr(plain, f.name)]


def export(items: DataFrame, rules: DataFrame, options: deid.Options, root: str, work: str, get=source.http_get, sleep=None) -> DataFrame:
    """items (a manifest: study, series, sop, url, path, extension, patient_dir, study_dir, series_dir) -> the staged
    outcome of each: sop, file, bytes, sha256, error.

    Files go below ``root``, which all executors share, and tables below ``work``. Items whose files an earlier run has
    written (work/written) are not fetched again. Videos are written as they come. A hidden payload, a file that is not
    the one that was asked for and one that cannot be read are errors of their item. An expired session, or a run that
    saves nothing, raises NothingSaved."""
    spark = items.sparkSession
    put = lambda df, name: (df.write.mode("overwrite").parquet(f"{work}/{name}"), spark.read.parquet(f"{work}/{name}"))[1]
    done = None
    try:
        done = spark.read.parquet(f"{work}/written")
        todo = report.unsaved(items, done.select("sop"))
    except Exception as e:  # noqa: BLE001  (there is no earlier run)
        if "PATH_NOT_FOUND" not in str(e):
            raise
        todo = items
    got = put(source.fetch(todo, get, **({"sleep": sleep} if sleep else {})), "fetched")
    if not source.ends_run(got).isEmpty():
        raise NothingSaved("the session has expired")
    whole = got.where("error is null")
    attrs = put(part10.read_attributes(whole.where("extension <> 'mp4'").select(F.col("sop").alias("path"), F.col("data").alias("content"))), "attributes")
    heads = part10.headers(attrs.where("error is null")).select(F.col("instance_id").alias("sop_key"), "sop", "series", "study")
    wanted = todo.join(whole.select("sop"), "sop", "left_semi")
    checked = payload_check(wanted.select("sop", "series", "study", "extension"), heads)
    unsafe = deid.hazardous(attrs.where("error is null").withColumn("value", F.coalesce("value", F.hex(F.substring("payload", 1, 1))))).select(F.col("instance_id").alias("sop"), F.lit("UnsafePayload").alias("unsafe"))
    verdicts = put(checked.join(unsafe, "sop", "left").select("sop", F.coalesce("unsafe", F.when(F.col("verdict") != "ok", F.concat(F.lit("Payload "), "verdict"))).alias("problem")), "verdicts")
    good = verdicts.where("problem is null").select("sop")
    clean = deid.apply_rules(attrs.join(good.select(F.col("sop").alias("instance_id")), "instance_id", "left_semi"), rules, options).where("action <> 'remove'")
    files = part10.write_attributes(clean.select("instance_id", "path", "tag", "vr", F.col("new_value").alias("value"), "payload")).select(F.col("instance_id").alias("sop"), F.col("content").alias("data"))
    videos = whole.where("extension = 'mp4'").select("sop", "data")
    place = archive.file_path(F.col("patient_dir"), F.col("study_dir"), F.col("series_dir"), F.col("sop"), F.col("extension"))
    ready = put(files.unionByName(videos).join(todo.select("sop", place.alias("path")), "sop"), "ready")
    saved = put(archive.write_files(ready, root), "saved")
    written = ready.select("sop", "path").join(saved, "path").select("sop", F.col("path").alias("file"), "bytes", "sha256")
    written.write.mode("append").parquet(f"{work}/written")
    failed = got.where("error is not null").select("sop", F.concat_ws(": ", "error", "message").alias("error")).unionByName(verdicts.where("problem is not null").select("sop", F.col("problem").alias("error")))
    every = spark.read.parquet(f"{work}/written").dropDuplicates(["sop"])
    out = put(items.select("sop").join(every, "sop", "left").join(failed, "sop", "left").select("sop", "file", "bytes", "sha256", F.when(F.col("file").isNull(), F.coalesce("error", F.lit("not written"))).alias("error")), "outcome")
    if out.where("error is null").isEmpty() and not out.isEmpty():
        raise NothingSaved("no item was saved")
    return out
