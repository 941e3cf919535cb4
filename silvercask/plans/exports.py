"""Queries over exports: payloads, archives, retries, failures, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import manifest as M
from ..operators import records as R
from ..operators import report
from ..operators.archive import budget, offsets
from .base import query, table


@query("SELECT doc_id, concat(sha256(text), '  ', doc_id, '.txt') AS line FROM documents")
def checksums(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.concat_ws("  ", F.sha2("text", 256), F.concat("doc_id", F.lit(".txt"))).alias("line"))


@query()
def crc32_sizes(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.crc32("text").alias("crc"), F.octet_length("text").alias("size"))


@query("SELECT doc_id, sum(strlen(text)) OVER w AS used, sum(strlen(text)) OVER w <= 100000 AND count(*) OVER w <= 60 AS fits FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id)")
def zip_budget(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source", F.octet_length("text").cast("long").alias("bytes"))
    return budget(d, "source", "doc_id", 100_000, 60).select("doc_id", "used", "fits")


@query("SELECT doc_id, coalesce(sum(b + 8) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM (SELECT doc_id, source, strlen(text) + strlen(text) % 2 AS b FROM documents)")
def offset_table(spark, sf):
    return offsets(table(spark, sf, "documents").select("doc_id", "source", F.octet_length("text").cast("long").alias("bytes")), "source", "doc_id").select("doc_id", "start")


@query("""SELECT event_id, coalesce(CASE WHEN event_id % 4 = 0 THEN CAST(event_id % 50 * 1000 AS DOUBLE) END, least(30000.0, 500 * pow(2.0, event_id % 9))) AS delay, s = 408 OR s = 429 OR s >= 500 AS again, s BETWEEN 300 AND 399 OR s IN (401, 403) AS session FROM (SELECT *, 300 + event_id % 250 AS s FROM events)""")
def retry_policy(spark, sf):
    e, s = table(spark, sf, "events"), F.lit(300) + F.col("event_id") % 250
    return e.select("event_id", S.retry_delay(F.col("event_id") % 9 + 1, F.when(F.col("event_id") % 4 == 0, F.col("event_id") % 50 * 1000)).alias("delay"), S.retryable(s).alias("again"), S.session_error(s).alias("session"))


@query("""SELECT event_id, CAST(CASE event_id % 4 WHEN 0 THEN least(30000, event_id % 50 * 1000) WHEN 1 THEN least(30000, event_id % 40 * 1000) WHEN 2 THEN 0 END AS DOUBLE) AS wait FROM events""")
def retry_headers(spark, sf):
    """What a Retry-After header of seconds, of a later date, of an earlier date, or of neither asks for."""
    e, k = table(spark, sf, "events"), F.col("event_id")
    date = lambda ts: F.date_format(ts, "'Wed, 'dd MMM yyyy HH:mm:ss' GMT'")
    now = F.date_trunc("second", "ts")
    later = F.timestamp_seconds(F.unix_seconds(now) + k % 40)
    header = F.when(k % 4 == 0, (k % 50).cast("string")).when(k % 4 == 1, date(later)).when(k % 4 == 2, date(F.timestamp_seconds(F.unix_seconds(now) - 60))).otherwise("soon")
    return e.select("event_id", S.retry_after(header, now).alias("wait"))


_ERRORS = [("HttpError", "HTTP 503", 503), ("HttpError", "HTTP 404", 404), ("TypeError", "Failed to fetch", 0), ("QuotaExceededError", "full", 0), ("TypeError", "No space left on disk", 0), ("Error", "Network request failed", 0), ("HttpError", "HTTP 302", 302)]


@query("""SELECT i AS kind, again, cors, quota, session, n FROM (SELECT user_id % 7 AS i, count(*) AS n FROM events GROUP BY 1) JOIN (VALUES (0, true, false, false, false), (1, false, false, false, false), (2, true, true, false, false), (3, false, false, true, false), (4, false, false, true, false), (5, false, true, false, false), (6, false, false, false, true)) v(i, again, cors, quota, session) USING (i)""")
def error_kinds(spark, sf):
    e = F.array(*(F.struct(F.lit(a).alias("name"), F.lit(b).alias("message"), F.lit(c).alias("status")) for a, b, c in _ERRORS))
    k = (F.col("user_id") % 7).cast("int")
    rows = table(spark, sf, "events").select(F.col("user_id") % 7, F.element_at(e, k + 1).alias("e")).toDF("kind", "e").select("kind", "e.*")
    flags = rows.select("kind", S.retryable_error(F.col("name"), F.col("message"), F.col("status")).alias("again"), S.cors_error(F.col("message")).alias("cors"), S.quota_error(F.col("name"), F.col("message")).alias("quota"), S.session_error(F.col("status"), F.lit("basic")).alias("session"))
    return flags.groupBy("kind", "again", "cors", "quota", "session").agg(F.count(F.lit(1)).alias("n"))


_FAILED = "SELECT event_id, user_id, concat('image set ', CASE WHEN user_id % 3 = 0 THEN '?' ELSE CAST(user_id % 3 AS VARCHAR) END) AS label, CASE WHEN event_id % 6 = 5 THEN 'Unknown download error' ELSE concat('HTTP ', 500 + event_id % 6) END AS cause FROM events WHERE event_type = 'error'"


def _failed(spark, sf):
    e, k = table(spark, sf, "events").where("event_type = 'error'"), F.col("event_id")
    number = F.when(F.col("user_id") % 3 == 0, "").otherwise((F.col("user_id") % 3).cast("string"))
    error = F.when(k % 6 == 5, "").otherwise(F.concat(F.lit("HTTP "), (500 + k % 6).cast("string")))
    return e.select(F.when(F.col("user_id") % 5 == 0, "").otherwise(F.col("user_id").cast("string")).alias("series"), number.alias("number"), F.lit("").alias("description"), error.alias("error"), k.alias("seq"), k.alias("instance"), F.concat(F.lit("1.2."), k).alias("sop"), F.lit("dcm").alias("extension"))


@query(f"""WITH f AS (SELECT *, CASE WHEN user_id % 5 = 0 THEN label ELSE CAST(user_id AS VARCHAR) END AS key FROM ({_FAILED})), c AS (SELECT key, cause, count(*) AS n, min(event_id) AS first, arg_min(label, event_id) AS label FROM f GROUP BY 1, 2)
SELECT key, arg_min(label, first) AS label, sum(n)::BIGINT AS count, string_agg(concat(n, 'x ', cause), ', ' ORDER BY first) AS causes FROM c GROUP BY 1""")
def failures_by_series(spark, sf):
    out = report.failures(_failed(spark, sf))
    return out.select("key", "label", "count", F.array_join(F.transform("causes", lambda c: F.concat(c["count"].cast("string"), F.lit("x "), c["cause"])), ", ").alias("causes"))


@query("SELECT event_id, event_type, (SELECT greatest(0, count(*) - 500) FROM events) AS dropped FROM events ORDER BY ts DESC, event_id DESC LIMIT 500")
def log_tail(spark, sf):
    last, dropped = report.tail(table(spark, sf, "events"), ["ts", "event_id"])
    return last.select("event_id", "event_type", dropped.alias("dropped"))


@query("""SELECT CASE event_type WHEN 'error' THEN concat('Face risk of ', event_id % 4) ELSE concat('note: ', event_type) END AS message, count(*) AS count FROM events GROUP BY 1""")
def warning_categories(spark, sf):
    entry = F.when(F.col("event_type") == "error", F.concat(F.when(F.col("event_id") % 2 == 0, "SOP ").otherwise(""), "event_id", F.lit(".dcm: Face risk of "), (F.col("event_id") % 4).cast("string"))).otherwise(F.concat(F.lit("note: "), "event_type"))
    return report.warning_groups(table(spark, sf, "events").select(entry.alias("entry")))


@query("SELECT count(*) FILTER (WHERE event_type IN ('error', 'view')) AS errors, count(*) FILTER (WHERE event_type = 'purchase') AS successes, count(*) FILTER (WHERE event_type IN ('error', 'view')) AS shown FROM events")
def log_counts(spark, sf):
    kind = F.when(F.col("event_type") == "view", "warning").when(F.col("event_type") == "purchase", "success").otherwise(F.when(F.col("event_type") == "error", "error").otherwise("info"))
    log = table(spark, sf, "events").select(kind.alias("type"))
    return report.log_counts(log).crossJoin(report.log_filter(log, "errors").agg(F.count(F.lit(1)).alias("shown")))  # one row each


@query("SELECT event_id, user_id FROM events WHERE event_type = 'error' QUALIFY row_number() OVER (PARTITION BY user_id % 20 ORDER BY event_id DESC) <= 50")
def codec_failures(spark, sf):
    e = table(spark, sf, "events").where("event_type = 'error'").withColumn("g", F.col("user_id") % 20)
    return report.last_failures(e, "g", "event_id").select("event_id", "user_id")


@query("""SELECT user_id % 50 AS run, count(*) FILTER (WHERE event_type <> 'error') AS done, count(*) FILTER (WHERE event_type = 'error') AS failed, count(*) AS total, coalesce(sum(event_id) FILTER (WHERE event_type <> 'error'), 0)::BIGINT AS total_bytes,
 CASE WHEN count(*) FILTER (WHERE event_type = 'error') = 0 THEN 'complete' WHEN count(*) FILTER (WHERE event_type <> 'error') > 0 THEN 'partial_success' ELSE 'failed' END AS status FROM events WHERE user_id % 50 = 7 GROUP BY 1""")
def run_totals(spark, sf):
    e = table(spark, sf, "events").where("user_id % 50 = 7")
    t = report.run_totals(e.select((F.col("event_type") != "error").alias("ok"), F.col("event_id").alias("bytes"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at")))
    return t.select(F.lit(7).cast("long").alias("run"), "done", "failed", "total", "total_bytes", "status")


@query("""SELECT o_orderkey, CASE WHEN c THEN 'Cancelled by user' WHEN k % 5 = 0 THEN 'Failed — disk: full' WHEN k % 7 = 0 THEN 'Failed — HTTP 500' WHEN f > 0 THEN 'Completed with failures' WHEN k % 2 = 0 THEN 'Completed — not fully de-identified' ELSE 'Completed' END AS outcome,
 CASE WHEN NOT c AND (k % 5 = 0 OR k % 7 = 0 OR k % 6 = 0) THEN 'destructive' WHEN NOT c AND k % 6 > 0 AND f = 0 AND k % 2 <> 0 THEN 'success' ELSE 'warning' END AS tone FROM (SELECT o_orderkey, o_orderkey AS k, o_orderstatus = 'F' AND o_orderkey % 11 = 0 AS c, o_orderkey % 3 AS f FROM orders)""")
def outcomes(spark, sf):
    k, f = F.col("o_orderkey"), F.col("o_orderkey") % 3
    cancelled = (F.col("o_orderstatus") == "F") & (k % 11 == 0)
    open_, issue, error = F.when(k % 2 == 0, 1).otherwise(0), F.when(k % 5 == 0, "disk: full"), F.when(k % 7 == 0, "HTTP 500")
    return table(spark, sf, "orders").select("o_orderkey", report.outcome(cancelled, issue, error, f, open_).alias("outcome"), report.tone(cancelled, issue.isNotNull() | error.isNotNull(), k % 6, f, F.lit(9), open_).alias("tone"))


@query("""WITH i AS (SELECT concat('1.2.', l_orderkey) AS a, concat('1.2.', l_orderkey, '.', l_suppkey) AS b, concat('1.2.', l_orderkey, '.', l_suppkey, '.', l_linenumber) AS c, l_orderkey, l_linenumber, l_orderkey % 9 = 0 AS bad FROM lineitem)
SELECT section, count(*) AS n, min(json) AS least, max(json) AS most FROM (SELECT 'requested' AS section, concat('{"studyInstanceUid":"', a, '","seriesInstanceUid":"', b, '","sopInstanceUid":"', c, '"}') AS json FROM i
 UNION ALL SELECT CASE WHEN bad THEN 'failed' ELSE 'written' END, concat('{"studyInstanceUid":"', a, '","seriesInstanceUid":"', b, '","sopInstanceUid":"', c, '","fileName":"', c, '.dcm",', CASE WHEN bad THEN '"error":"HTTP 500"}' ELSE concat('"sha256":"', sha256(c), '","bytes":', l_linenumber, '}') END) FROM i) GROUP BY 1""")
def export_manifest(spark, sf):
    study, bad = F.concat(F.lit("1.2."), "l_orderkey"), F.col("l_orderkey") % 9 == 0
    series = F.concat(study, F.lit("."), "l_suppkey")
    sop = F.concat(series, F.lit("."), "l_linenumber")
    items = table(spark, sf, "lineitem").select(study.alias("study"), series.alias("series"), sop.alias("sop"), F.lit("dcm").alias("extension"), F.when(~bad, F.sha2(sop, 256)).alias("sha256"), F.when(~bad, F.col("l_linenumber")).alias("bytes"), F.when(bad, "HTTP 500").alias("error"))
    return report.manifest_records(items, ["sop"]).groupBy("section").agg(F.count(F.lit(1)).alias("n"), F.min("json").alias("least"), F.max("json").alias("most"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey % 9 = 0")
def retry_failed(spark, sf):
    sop = F.concat("l_orderkey", F.lit("."), "l_linenumber").alias("sop")
    items = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", sop)
    return report.unsaved(items, items.where("l_orderkey % 9 <> 0")).select("l_orderkey", "l_linenumber")


@query("""SELECT doc_id, CASE WHEN b >= 1048576 THEN concat(floor(b / 1048576.0 * 10 + 0.5)::BIGINT // 10, '.', floor(b / 1048576.0 * 10 + 0.5)::BIGINT % 10, ' MB') WHEN b >= 10240 THEN concat(floor(b / 1024.0 + 0.5)::BIGINT, ' KB')
 WHEN b >= 1024 THEN concat(floor(b / 1024.0 * 10 + 0.5)::BIGINT // 10, '.', floor(b / 1024.0 * 10 + 0.5)::BIGINT % 10, ' KB') WHEN b > 0 THEN concat(b, ' B') ELSE '0 B' END AS size,
 CASE WHEN s >= 60 THEN concat(s // 60, 'm ', s % 60, 's') ELSE concat(s, 's') END AS took FROM (SELECT doc_id, strlen(text) AS b, floor(n_chars * 37 / 1000.0 + 0.5)::BIGINT AS s FROM documents)""")
def format_helpers(spark, sf):
    return table(spark, sf, "documents").select("doc_id", S.format_bytes(F.octet_length("text")).alias("size"), S.format_duration(F.col("n_chars") * 37).alias("took"))


@query("""SELECT event_id, least(100, floor(d * 100 / 200.0 + 0.5))::INT AS percent, CASE WHEN d >= 200 THEN 'Finalizing output…' WHEN s <= 0 THEN 'Estimating time remaining…' WHEN s < 60 THEN concat('~', s, 's remaining') ELSE concat('~', s // 60, 'm ', s % 60, 's remaining') END AS eta,
 CASE WHEN d = 0 THEN '--' ELSE concat(d, ' B/s') END AS speed FROM (SELECT event_id, event_id % 230 AS d, CASE WHEN event_id % 230 BETWEEN 1 AND 199 THEN ceil((200 - event_id % 230) * 90000.0 / (event_id % 230) / 1000)::BIGINT ELSE 0 END AS s FROM events)""")
def progress(spark, sf):
    d = F.col("event_id") % 230
    return table(spark, sf, "events").select("event_id", S.percent_done(d, F.lit(200)).alias("percent"), S.time_left(d, F.lit(200), F.lit(90000)).alias("eta"), S.transfer_speed(d * 90, F.lit(90000)).alias("speed"))


@query(r"""SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(regexp_replace(concat(p_name, ' ..', p_type, '/', p_brand, '_'), '\.\.', '_', 'g'), '[<>:"/\\|?*]|\s+', '_', 'g'), '_+', '_', 'g'), '^[._]+|[._]+$', '', 'g') AS path,
 regexp_replace(regexp_replace(replace(concat('..', p_name, '(', p_brand, ').'), '..', '_'), '[^A-Za-z0-9._-]+', '_', 'g'), '^[._]+|[._]+$', '', 'g') AS safe,
 replace(replace(concat('<', p_name, '&'), '&', '&amp;'), '<', '&lt;') AS html FROM part""")
def path_sanitize(spark, sf):
    raw = F.concat("p_name", F.lit(" .."), "p_type", F.lit("/"), "p_brand", F.lit("_"))
    safe = F.concat(F.lit(".."), "p_name", F.lit("("), "p_brand", F.lit(")."))
    return table(spark, sf, "part").select("p_partkey", S.sanitize(raw, "x").alias("path"), S.safe_name(safe).alias("safe"), S.escape_html(F.concat(F.lit("<"), "p_name", F.lit("&"))).alias("html"))


@query("""SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN '20240131' ELSE 'UNKNOWN_DATE' END AS day, CAST(CASE p_size % 3 WHEN 0 THEN 20240131.0 WHEN 1 THEN -1.5 ELSE 0.0 END AS DOUBLE) AS number, CASE p_size % 3 WHEN 0 THEN '20240131' WHEN 1 THEN '-1.5' ELSE p_brand END AS first, CASE p_size % 4 WHEN 0 THEN '-012' WHEN 1 THEN '1234' WHEN 2 THEN 'a_b' ELSE 'NO_SERIES_NUMBER' END AS series FROM part""")
def value_helpers(spark, sf):
    i = F.col("p_size") % 3
    raw = F.when(i == 0, " 20240131 ").when(i == 1, "-1.5").otherwise(" ")
    series = F.element_at(F.array(*map(F.lit, ("-12", "1234", " a b ", ""))), (F.col("p_size") % 4 + 1).cast("int"))
    return table(spark, sf, "part").select("p_partkey", S.normalize_date(raw).alias("day"), S.numeric_value(raw).alias("number"), S.first_non_empty(raw, F.col("p_brand")).alias("first"), S.series_number(series).alias("series"))


@query(r"""SELECT page_id, concat(url, CASE WHEN page_id % 2 = 0 THEN '' ELSE '/x' END) AS clean, page_id % 3 = 0 AS framed, CASE WHEN page_id % 3 = 0 THEN concat('https://h/i?a=', page_id) ELSE concat('https://h/i?objectUID=1.2.', page_id, '&a=1') END AS plain,
 CASE WHEN page_id % 3 = 0 THEN NULL ELSE concat('1.2.', page_id) END AS uid, CASE WHEN page_id % 5 = 0 THEN 'mp4' ELSE 'dcm' END AS extension, concat('https://h/s/', page_id, '/frames/', page_id % 7 + 1) AS frame FROM pages""")
def url_normalize(spark, sf):
    p, k = table(spark, sf, "pages"), F.col("page_id")
    raw = F.concat(F.lit(" wadors:"), "url", F.lit("/frames/"), "page_id", F.when(k % 2 == 0, "").otherwise("/x"))
    long = F.when(k % 3 == 0, F.concat(F.lit("https://h/i?frame=3&a="), "page_id")).otherwise(F.concat(F.lit("https://h/i?objectUID=1.2."), "page_id", F.lit("&frameNumber=7&a=1")))
    kind = F.when(k % 5 == 0, "https://h/v?a=1&contentType=video%2Fmp4").otherwise("https://h/v?contentType=application%2Fdicom")
    frame = S.frame_url(S.normalize_url(F.concat(F.lit("wadors:https://h/s/"), "page_id", F.lit("/frames/9"))), k % 7 + 1)
    return p.select("page_id", S.normalize_url(raw).alias("clean"), S.has_frame(F.concat("url", F.when(k % 3 == 0, "&frame=2").otherwise(""))).alias("framed"), S.without_frame(long).alias("plain"), S.query_value(long, "objectUID").alias("uid"), S.extension(kind).alias("extension"), frame.alias("frame"))


@query("SELECT extension, count(*) AS n FROM (SELECT CASE WHEN page_id % 5 = 0 THEN 'mp4' ELSE 'dcm' END AS extension FROM pages) WHERE extension <> 'dcm' GROUP BY 1")
def not_dicom_files(spark, sf):
    ext = F.when(F.col("page_id") % 5 == 0, "mp4").otherwise("dcm")
    return table(spark, sf, "pages").select(ext.alias("extension")).where(M.not_dicom(F.col("extension"))).groupBy("extension").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, ((greatest(1980, least(2107, year(ts))) - 1980) * 512 + month(ts) * 32 + day(ts))::INT AS date, (hour(ts) * 2048 + minute(ts) * 32 + second(ts) // 2)::INT AS time FROM events")
def dos_times(spark, sf):
    return table(spark, sf, "events").select("event_id", R.dos_time(F.col("ts")).alias("t")).select("event_id", "t.*")
