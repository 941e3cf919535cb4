"""What came of an export: outcomes, failures, warnings, log, and the records that are written beside the files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as S
from .manifest import item_label, series_label

# Limits of the log and of the ring of codec failures, and the format's own tag.
LOG_TAIL = 500
CODEC_RING = 50
FORMAT = "export-manifest-v1"


def run_totals(items: DataFrame) -> DataFrame:
    """One row of items (ok, bytes, at in milliseconds): done, failed, total, total_bytes, duration_ms, status."""
    done, failed = F.count_if("ok"), F.count_if(~F.col("ok"))
    t = items.agg(done.alias("done"), failed.alias("failed"), F.count(F.lit(1)).alias("total"), F.coalesce(F.sum(F.when(F.col("ok"), F.col("bytes"))), F.lit(0)).alias("total_bytes"), F.coalesce(F.max("at") - F.min("at"), F.lit(0)).alias("duration_ms"))
    return t.withColumn("status", F.when(F.col("failed") == 0, "complete").when(F.col("done") > 0, "partial_success").otherwise("failed"))


def outcome(cancelled: Column, issue: Column, error: Column, failed: Column, not_anonymized: Column) -> Column:
    """The most telling of what happened."""
    return (
        F.when(cancelled, "Cancelled by user")
        .when(issue.isNotNull(), F.concat(F.lit("Failed — "), issue))
        .when(error.isNotNull(), F.concat(F.lit("Failed — "), error))
        .when(failed > 0, "Completed with failures")
        .when(not_anonymized > 0, "Completed — not fully de-identified")
        .otherwise("Completed")
    )


def tone(cancelled: Column, failure: Column, done: Column, failed: Column, total: Column, not_anonymized: Column) -> Column:
    """success only if files were saved and all was done as asked."""
    lost = ~cancelled & (failure | ((done == 0) & (total > 0)))
    return F.when(lost, "destructive").when(~cancelled & (done > 0) & (failed == 0) & (not_anonymized == 0), "success").otherwise("warning")


def failures(items: DataFrame) -> DataFrame:
    """Failed items (series, number, description, error, seq) by series: key, label, count and causes with their counts,
    in the order in which they were first seen."""
    label = series_label(F.col("number"), F.col("description"))
    rows = items.select(F.coalesce(S.missing(F.col("series")), label).alias("key"), label.alias("label"), F.coalesce(S.missing(F.col("error")), F.lit("Unknown download error")).alias("cause"), "seq")
    causes = rows.groupBy("key", "cause").agg(F.count(F.lit(1)).alias("count"), F.min("seq").alias("first"), F.min_by("label", "seq").alias("label"))
    row = F.struct("first", "cause", "count")
    each = causes.groupBy("key").agg(F.min_by("label", "first").alias("label"), F.sum("count").alias("count"), F.min("first").alias("first"), F.array_sort(F.collect_list(row)).alias("causes"))
    return each.withColumn("causes", F.transform("causes", lambda c: F.struct(c["cause"].alias("cause"), c["count"].alias("count"))))


def warning_message(entry: Column) -> Column:
    """A warning without the file it is about."""
    at = F.instr(entry, ": ")
    head = F.left(entry, at - 1)
    named = (at > 0) & (F.contains(head, F.lit(".dcm")) | F.contains(head, F.lit("SOP")))
    return F.when(named, F.substr(entry, at + 2)).otherwise(entry)


def warning_groups(entries: DataFrame) -> DataFrame:
    """(message, count) of entries (entry)."""
    return entries.groupBy(warning_message(F.col("entry")).alias("message")).agg(F.count(F.lit(1)).alias("count"))


def log_counts(log: DataFrame) -> DataFrame:
    """errors (warnings too) and successes of log (type)."""
    return log.agg(F.count_if(F.col("type").isin("error", "warning")).alias("errors"), F.count_if(F.col("type") == "success").alias("successes"))


def log_filter(log: DataFrame, which: str = "all") -> DataFrame:
    kinds = {"errors": ("error", "warning"), "success": ("success",)}
    return log.where(F.col("type").isin(*kinds[which])) if which in kinds else log


def tail(rows: DataFrame, by: list[str], most: int = LOG_TAIL) -> tuple[DataFrame, Column]:
    """The last rows and how many are dropped."""
    return rows.orderBy(*(F.desc(c) for c in by)).limit(most), F.greatest(F.lit(0), F.lit(rows.count() - most))


def last_failures(rows: DataFrame, group: str, by: str, most: int = CODEC_RING) -> DataFrame:
    """The last failures of each group: stage, context, name and message are columns of rows."""
    return rows.withColumn("_k", F.row_number().over(W.partitionBy(group).orderBy(F.desc(by)))).where(F.col("_k") <= most).drop("_k")


def manifest_records(items: DataFrame, by: list[str]) -> DataFrame:
    """Each item (study, series, sop, extension, sha256, bytes, error) as the lines of the export manifest that it
    gives: section (requested, and written or failed) and json; sorted output needs no order of completion."""
    uids = [F.col("study").alias("studyInstanceUid"), F.col("series").alias("seriesInstanceUid"), F.col("sop").alias("sopInstanceUid")]
    file = F.concat("sop", F.lit("."), "extension").alias("fileName")
    requested = F.struct(F.lit("requested").alias("section"), F.to_json(F.struct(*uids)).alias("json"))
    written = F.struct(F.lit("written").alias("section"), F.to_json(F.struct(*uids, file, F.col("sha256"), F.col("bytes"))).alias("json"))
    failed = F.struct(F.lit("failed").alias("section"), F.to_json(F.struct(*uids, file, F.col("error"))).alias("json"))
    lines = F.array(requested, F.when(F.col("error").isNull(), written).otherwise(failed))
    return items.select(*by, F.explode(lines).alias("l")).select(*by, "l.*")


def unsaved(items: DataFrame, written: DataFrame) -> DataFrame:
    """The items (sop) that a new run has to fetch again."""
    return items.join(written.select("sop").distinct(), "sop", "left_anti")


def run_report(totals: dict, failed: DataFrame, warnings: DataFrame, log: DataFrame, run_id: str = "", cancelled: bool = False, issue: str | None = None, error: str | None = None, not_anonymized: DataFrame | None = None, rows: int = 1_000) -> str:
    """The report of a run as text. totals: a row of run_totals; failed as for failures(), with instance, sop and extension.

    The report is read by people: of failures, notes and log it shows the first (of the log the last) ``rows``, and
    says how many there are; the tables themselves hold the rest."""
    spark = failed.sparkSession
    n_failed, n_warnings, n_log = failed.count(), warnings.count(), log.count()
    n_open = not_anonymized.count() if not_anonymized is not None else 0
    flags = spark.range(1).select(outcome(F.lit(cancelled), F.lit(issue), F.lit(error), F.lit(totals["failed"]), F.lit(n_open)).alias("o"), S.format_bytes(F.lit(totals["total_bytes"])).alias("b"), S.format_duration(F.lit(totals["duration_ms"])).alias("d")).first()
    out = ["Export report", "============="]
    out += [f"Run ID:      {run_id}"] if run_id else []
    out += [f"Outcome:     {flags.o}", f"Saved:       {totals['done']}", f"Failed:      {totals['failed']}", f"Requested:   {totals['total']}", f"Volume:      {flags.b}", f"Duration:    {flags.d}"]
    out += ["", f"Issue: {issue}"] if issue else []
    out += ["", f"Error: {error}"] if error else []
    if n_failed:
        out += ["", f"Failed files ({n_failed})", "-" * 30]
        label = item_label(F.col("number"), F.col("description"), F.col("instance"), F.col("sop"), F.col("extension"))
        for g in failures(failed).orderBy("first").limit(rows).collect():
            out.append(f"{g.label} — {g['count']} file(s) missing")
            out += [f"    {c['count']}× {c['cause']}" for c in g.causes]
        out += [f"    {r.label}: {r.error}" for r in failed.orderBy("seq").select(label.alias("label"), F.coalesce(S.missing(F.col("error")), F.lit("Unknown download error")).alias("error")).limit(rows).collect()]
    if n_open:
        out += ["", f"NOT ANONYMIZED ({n_open})", "-" * 30]
        out += [f"{r.file}: {r.reason}" for r in not_anonymized.orderBy("file").limit(rows).collect()]
    if n_warnings:
        out += ["", f"Anonymization notes ({n_warnings})", "-" * 30]
        out += [r.entry for r in warnings.orderBy("entry").limit(rows).collect()]
    if n_log:
        out += ["", f"Activity log ({n_log} entries)", "-" * 30]
        last = sorted(log.orderBy(F.desc("ts")).limit(rows).collect(), key=lambda r: r.ts)
        out += [f"[{r.ts}] {r.type.upper()}: {r.message}" for r in last]
    return "\n".join(out)
