"""Queries over the hierarchy: catalogue, selection, manifest."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import manifest as M
from .base import GRAMMAR_SQL, INSTANCES, ITEMS, SECRET, instances, items, query, table, uid_sql

_NAMES = "CASE code " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in M.MODALITIES.items()) + " ELSE code END"


@query(f"""WITH u AS (SELECT * FROM ({INSTANCES}) WHERE url <> '' OR has_file), d AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY study, series, sop, coalesce(nullif(url, ''), CASE WHEN has_file THEN concat(sop, '.dcm') END, '') ORDER BY seq) = 1),
s AS (SELECT study, series, count(*) AS n, min(seq) AS seq, arg_min(modality, seq) AS modality, arg_min(number, seq) AS number FROM d GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY study ORDER BY number, seq) AS k FROM s), f AS (SELECT study, modality, min(k) AS k FROM r WHERE modality <> '' GROUP BY 1, 2)
SELECT r.study, sum(n)::BIGINT AS n, count(*) AS n_series, string_agg(series, ' ' ORDER BY k) AS series, (SELECT coalesce(string_agg(modality, '/' ORDER BY k), '') FROM f WHERE f.study = r.study) AS modalities FROM r GROUP BY 1""")
def catalog_payload(spark, sf):
    i = instances(spark, sf).select("study", "series", "sop", "seq", "url", "has_file", F.when(F.col("has_file"), F.concat("sop", F.lit(".dcm"))).alias("file_name"), F.lit("").alias("patient"), F.lit("").alias("study_date"), F.col("number").cast("string").alias("number"), "modality")
    return M.catalogue(i).select("study", "n", F.size("series").cast("long").alias("n_series"), F.array_join(F.transform("series", lambda s: s["series"]), " ").alias("series"), "modalities")


@query(f"""WITH u AS (SELECT *, CASE WHEN url = '' THEN '' ELSE regexp_replace(url, '&frame=2$', '') END AS object_url, row_number() OVER (PARTITION BY study, series ORDER BY seq) - 1 AS place FROM ({INSTANCES}) WHERE url <> '' OR has_file),
n AS (SELECT *, coalesce(nullif(sop, ''), nullif(regexp_extract(object_url, 'objectUID=([^&]*)', 1), '')) AS uid FROM u),
d AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY study, series, coalesce(uid, nullif(object_url, ''), concat('instance-', place)), object_url ORDER BY seq) = 1),
k AS (SELECT * FROM d WHERE uid IS NOT NULL AND {GRAMMAR_SQL.format('uid')})
SELECT seq, study, uid AS sop, object_url AS url, concat('Patient_', right(study, 28)) AS patient_dir, concat('Study_', right(study, 28)) AS study_dir,
 concat('Series_', lpad(CAST(first_value(number) OVER (PARTITION BY study, series ORDER BY seq) AS VARCHAR), 3, '0'), '_', right(series, 28)) AS series_dir, 'dcm' AS extension FROM k""")
def manifest_build(spark, sf):
    none = F.lit(None).cast("string")
    i = instances(spark, sf).select("study", "series", "sop", "seq", "url", "has_file", F.lit(False).alias("from_frames"), "number", none.alias("patient_id"), none.alias("patient_name"))
    return M.manifest(i).select("seq", "study", "sop", "url", "patient_dir", "study_dir", "series_dir", "extension")


@query("""WITH s AS (SELECT o_custkey AS patient, concat(o_orderkey, '.1111111111222222222233333333') AS uid, o_orderkey AS seq FROM orders),
b AS (SELECT patient, uid, concat('Study_', right(uid, 28)) AS base, seq FROM s), r AS (SELECT *, row_number() OVER (PARTITION BY patient, base ORDER BY seq) AS k FROM b)
SELECT uid, CASE WHEN k = 1 THEN base ELSE concat(left(base, 120 - 4 - greatest(2, length(CAST(k AS VARCHAR)))), '_DUP', CASE WHEN k < 10 THEN '0' ELSE '' END, k) END AS dir FROM r""")
def manifest_collisions(spark, sf):
    s = table(spark, sf, "orders").select(F.col("o_custkey").alias("patient"), F.concat(F.col("o_orderkey"), F.lit(".1111111111222222222233333333")).alias("uid"), F.col("o_orderkey").alias("seq"))
    b = s.withColumn("base", F.concat(F.lit("Study_"), S.short_uid(F.col("uid"))))
    return M.distinct_names(b, ["patient"], "uid", "base", "seq").select("uid", F.col("name").alias("dir"))


@query(f"""WITH o AS (SELECT o_orderkey AS seq, concat('1.2.', o_orderkey) AS study, concat('1.2.', o_orderkey, '.1') AS series, o_orderkey % 9 AS number, coalesce(nullif(CASE WHEN o_custkey % 7 = 0 THEN '' ELSE CAST(o_custkey AS VARCHAR) END, ''), 'UNKNOWN') AS id FROM orders),
p AS (SELECT id, row_number() OVER (ORDER BY min(seq)) AS k FROM o GROUP BY 1), n AS (SELECT count(*) AS n FROM p)
SELECT seq, concat('ID', s) AS new_id, concat('NOBODY', s) AS new_name, concat('ID', s, '_NOBODY', s) AS patient_dir, concat('ANON_STUDY_ANON_', right({uid_sql('study')}, 28)) AS study_dir, concat('ANON_SERIES_', number, '_', right({uid_sql('series')}, 28)) AS series_dir
FROM (SELECT o.*, CASE WHEN n.n > 1 THEN concat('_P', p.k) ELSE '' END AS s FROM o JOIN p USING (id), n)""")
def manifest_patient_alias(spark, sf):
    o, cust = table(spark, sf, "orders"), F.col("o_custkey")
    uid = F.concat(F.lit("1.2."), "o_orderkey")
    rows = o.select(F.col("o_orderkey").alias("seq"), uid.alias("study"), F.concat(uid, F.lit(".1")).alias("series"), (F.col("o_orderkey") % 9).alias("number"), F.when(cust % 7 == 0, "UNKNOWN").otherwise(cust.cast("string")).alias("patient_id"), F.lit("UNKNOWN").alias("patient_name"))
    return M.aliased(rows, "ID", "NOBODY", SECRET).select("seq", "new_id", "new_name", "patient_dir", "study_dir", "series_dir")


_MULTI = "(frames > 1 OR regexp_matches(url, '[?&]frame='))"


@query(f"""WITH i AS (SELECT *, row_number() OVER (PARTITION BY study, series ORDER BY seq) - 1 AS place, CASE WHEN url = '' THEN '' ELSE regexp_replace(url, '&frame=2$', '') END AS object_url FROM ({INSTANCES})),
g AS (SELECT study, series, coalesce(nullif(sop, ''), nullif(regexp_extract(object_url, 'objectUID=([^&]*)', 1), ''), nullif(object_url, ''), concat('instance-', place)) AS object_uid, object_url, max(frames) AS frame_count, count(*) AS n, min(seq) AS first FROM i WHERE {_MULTI} GROUP BY ALL),
t AS (SELECT study, series, count(*) AS total, max(frames) AS most FROM i GROUP BY ALL), e AS (SELECT study, series, count(*) AS objects, sum(n) AS multi FROM g GROUP BY ALL),
s AS (SELECT t.*, coalesce(objects BETWEEN 2 AND 100, false) AS split, multi FROM t LEFT JOIN e USING (study, series))
SELECT study, series, 'series' AS kind, NULL AS object_uid, 0 AS entry, most AS frame_count, total AS n FROM s WHERE NOT split
UNION ALL SELECT study, series, 'singleframe', NULL, 0, 0, (total - multi)::BIGINT FROM s WHERE split AND total > multi
UNION ALL SELECT study, series, 'multiframe', object_uid, row_number() OVER (PARTITION BY study, series ORDER BY first), frame_count, n FROM g JOIN (SELECT study, series FROM s WHERE split) USING (study, series)""")
def multiframe_groups(spark, sf):
    return M.selection_entries(instances(spark, sf))


@query(f"""WITH e AS (SELECT series, coalesce(nullif(modality, ''), 'IMG') AS code, (l_suppkey % 3 = 0) AS selected FROM ({INSTANCES}) GROUP BY ALL)
SELECT code AS modality, {_NAMES} AS label, count(*) FILTER (WHERE selected) AS selected_count, count(*) AS total, CASE WHEN count(*) FILTER (WHERE selected) = 0 THEN 'none' WHEN count(*) FILTER (WHERE selected) = count(*) THEN 'all' ELSE 'some' END AS state FROM e GROUP BY code""")
def modality_states(spark, sf):
    e = instances(spark, sf).select("series", M.modality_code(F.col("modality"), F.lit(None)).alias("modality"), (F.col("l_suppkey") % 3 == 0).alias("selected")).distinct()
    return M.modality_states(e)


@query(f"""SELECT code, {_NAMES} AS label FROM (SELECT DISTINCT coalesce(nullif(modality, ''), 'IMG') AS code FROM ({INSTANCES}))""")
def modality_list(spark, sf):
    return M.available_modalities(instances(spark, sf).select(M.modality_code(F.col("modality"), F.lit("")).alias("modality")))


@query(f"""WITH e AS (SELECT series, any_value(modality) AS modality, any_value(l_suppkey) AS k FROM ({INSTANCES}) GROUP BY series), f AS (SELECT bool_and(k % 3 = 0) AS every FROM e WHERE modality = 'CT')
SELECT series FROM e, f WHERE CASE WHEN modality = 'CT' THEN NOT every ELSE k % 3 = 0 END""")
def selection_semi(spark, sf):
    """What is selected after a click on one modality, and the entries of these ids."""
    e = instances(spark, sf).select(F.col("series").alias("id"), "modality", (F.col("l_suppkey") % 3 == 0).alias("selected")).distinct()
    after = M.toggled(e, "CT").where("selected")
    return M.chosen(e, after).select(F.col("id").alias("series"))


@query(f"""WITH e AS (SELECT seq, CASE WHEN url = '' AND NOT has_file THEN ['source'] ELSE list_filter([CASE WHEN NOT ({GRAMMAR_SQL.format('study')}) THEN 'study uid' END, CASE WHEN NOT ({GRAMMAR_SQL.format('series')}) THEN 'series uid' END, CASE WHEN NOT ({GRAMMAR_SQL.format('uid')}) THEN 'sop uid' END], lambda x: x IS NOT NULL) END AS errors
 FROM (SELECT *, coalesce(nullif(sop, ''), regexp_extract(url, 'objectUID=([^&]*)', 1)) AS uid FROM ({INSTANCES}))) SELECT error, count(*) AS n, min(seq) AS first FROM (SELECT seq, unnest(errors) AS error FROM e) GROUP BY 1""")
def preflight_errors(spark, sf):
    return M.selection_errors(instances(spark, sf)).groupBy("error").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first"))


@query(f"""WITH t AS (SELECT l_suppkey % 5 AS part, count(*) FILTER (WHERE url <> '' OR has_file) AS files, count(*) FILTER (WHERE url = '' AND NOT has_file) AS errors FROM ({INSTANCES}) WHERE l_suppkey % 5 <> 3 OR url <> '' GROUP BY 1)
SELECT part, files, errors, CASE WHEN files = 0 THEN 'nothing selected' WHEN errors > 0 THEN 'manifest errors' WHEN files + 2 > 60000 THEN 'too many entries' END AS blocked, files + 2 > 100 AS over_100 FROM t""")
def start_gate(spark, sf):
    i = instances(spark, sf).where((F.col("l_suppkey") % 5 != 3) | (F.col("url") != ""))
    source = (F.col("url") != "") | F.col("has_file")
    t = i.groupBy((F.col("l_suppkey") % 5).alias("part")).agg(F.count_if(source).alias("files"), F.count_if(~source).alias("errors"))
    return M.start_gate(t, True, True, False).withColumn("over_100", F.col("files") + 2 > 100)


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN static THEN first WHEN root <> '' AND l_linenumber <> 2 THEN concat(root, CASE WHEN contains(root, '?') THEN '&' ELSE '?' END, 'requestType=WADO&studyUID=', l_orderkey, '&seriesUID=', l_suppkey, '.1&objectUID=', l_linenumber, '.5&contentType=application%2Fdicom&transferSyntax=*')
 WHEN starts_with(first, 'dicomfile:') THEN '' ELSE first END AS url FROM (SELECT *, l_orderkey % 5 = 0 AS static, CASE l_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'https://w/x' ELSE 'https://w/x?a=1' END AS root, CASE WHEN l_linenumber % 3 = 0 THEN concat('dicomfile:', l_linenumber) ELSE concat('https://i/', l_orderkey) END AS first FROM lineitem)""")
def download_urls(spark, sf):
    k = F.col("l_orderkey")
    root = F.when(k % 3 == 0, "").when(k % 3 == 1, "https://w/x").otherwise("https://w/x?a=1")
    first = F.when(F.col("l_linenumber") % 3 == 0, F.concat(F.lit("dicomfile:"), "l_linenumber")).otherwise(F.concat(F.lit("https://i/"), k))
    study = F.when(F.col("l_linenumber") == 2, "").otherwise(k.cast("string"))
    url = M.download_url(k % 5 == 0, root, study, F.concat("l_suppkey", F.lit(".1")), F.concat("l_linenumber", F.lit(".5")), F.lit(""), first)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", url.alias("url"))


@query("""SELECT c_custkey, unnest(CASE WHEN c_custkey % 3 = 0 THEN [c_name, c_mktsegment] WHEN c_custkey % 3 = 1 THEN [c_mktsegment] WHEN c_custkey % 2 = 0 THEN [c_name] ELSE [] END) AS instance FROM customer WHERE c_custkey % 4 = 0""")
def display_instances(spark, sf):
    c, k, none = table(spark, sf, "customer"), F.col("c_custkey"), F.array().cast("array<string>")
    sets = c.select(k.alias("id"), (k % 4 == 0).alias("active"), F.when(k % 3 == 0, F.array("c_name", "c_mktsegment")).otherwise(none).alias("instances"), F.when(k % 3 == 1, F.array("c_mktsegment")).otherwise(none).alias("images"), F.when(k % 2 == 0, F.col("c_name")).alias("instance"))
    return M.display_instances(sets).select(F.col("id").alias("c_custkey"), "instance")


@query("""SELECT p_partkey, concat_ws(' • ', d, nullif(p_size::VARCHAR, ''), nullif(p_brand, '')) AS study, CASE WHEN p_partkey % 4 = 0 THEN concat(coalesce(nullif(n, ''), concat('Images ', p_size, ' / ', p_brand)), ' - grouped images ', p_partkey % 7) ELSE coalesce(nullif(n, ''), concat('Images ', p_size, ' / ', p_brand)) END AS entry,
 concat(p_brand, CASE WHEN f = 0 THEN '' WHEN f = 1 THEN ' • 1 image' ELSE concat(' • ', f, ' images') END, CASE WHEN p_partkey % 4 <> 0 THEN '' WHEN p_size > 1 THEN concat(' • ', p_size, ' images grouped together') ELSE ' • grouped images' END) AS meta,
 concat('image set ', p_size, CASE WHEN n = '' THEN '' ELSE concat(' — ', n) END, ' · image ', p_partkey, ' · 1.2.', p_partkey, '.dcm') AS item, concat('image set ', p_size, ' / 1.2.', p_partkey, '.dcm') AS display,
 CASE WHEN f > 1 THEN concat('Imaging_', f, '_Exams') WHEN f = 1 THEN concat('Imaging_Exam_1.2.', p_partkey) ELSE 'Medical_Images' END AS archive
 FROM (SELECT *, p_partkey % 3 AS f, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE p_name END AS n, CASE WHEN p_partkey % 5 = 0 THEN 'Medical imaging exam' ELSE p_name END AS d FROM part)""")
def labels(spark, sf):
    k, n = F.col("p_partkey"), F.when(F.col("p_partkey") % 5 == 0, "").otherwise(F.col("p_name"))
    kind, uid, size, f = F.when(k % 4 == 0, "multiframe").otherwise("series"), F.concat(F.lit("1.2."), k), F.col("p_size"), k % 3
    return table(spark, sf, "part").select("p_partkey", M.study_label(n, size.cast("string"), F.col("p_brand")).alias("study"), M.entry_name(n, size, F.col("p_brand"), kind, k % 7).alias("entry"), M.entry_meta(F.col("p_brand"), f, kind, size).alias("meta"), M.item_label(size, n, k, uid, F.lit("dcm")).alias("item"), M.display_label(size, uid, F.lit("dcm")).alias("display"), M.export_label(f, uid, False).alias("archive"))


@query(r"""SELECT p_partkey, CASE WHEN length(j) <= 30 THEN j WHEN 30 - 9 - length(a) - 1 > 0 THEN concat_ws('_', '20240131', nullif(regexp_replace(left(p_name, 30 - 9 - length(a) - 1), '_+$', ''), ''), a) ELSE left(concat('20240131_', a), 30) END AS study_dir,
 CASE WHEN length(s) <= 30 THEN s ELSE concat_ws('_', nullif(regexp_replace(left(p_name, 30 - length(n) - 1), '_+$', ''), ''), n) END AS series_dir FROM (SELECT *, concat('20240131_', p_name, '_', a) AS j, concat(p_name, '_', n) AS s FROM (SELECT *, concat('A', p_partkey) AS a, lpad(p_size::VARCHAR, 3, '0') AS n FROM part))""")
def truncated_dirs(spark, sf):
    a, n = F.concat(F.lit("A"), "p_partkey"), S.pad_left(F.col("p_size").cast("string"))
    return table(spark, sf, "part").select("p_partkey", S.study_dir(F.lit("20240131"), F.col("p_name"), a, 30).alias("study_dir"), S.series_dir(F.col("p_name"), n, 30).alias("series_dir"))


@query(f"""WITH e AS (SELECT series, modality, max(l_quantity) AS frames, bool_or(l_quantity > 1) AS multi FROM ({ITEMS}) GROUP BY 1, 2)
SELECT modality, count(*) AS total, count(*) FILTER (WHERE multi) AS multiframe, max(frames) AS max_frames FROM e GROUP BY 1""")
def modality_summary(spark, sf):
    e = items(spark, sf).groupBy("series", "modality").agg(F.max("l_quantity").alias("frames"))
    return e.groupBy("modality").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("frames") > 1).alias("multiframe"), F.max("frames").alias("max_frames"))


@query(f"""WITH s AS (SELECT study, series, l_suppkey % 3 = 0 AS selected, count(DISTINCT sop) AS files, count(*) AS per_entry FROM (SELECT * FROM ({INSTANCES}) WHERE sop <> '') GROUP BY ALL)
SELECT coalesce(sum(files) FILTER (WHERE selected), 0)::BIGINT AS selected_files, sum(files)::BIGINT AS all_files, coalesce(sum(per_entry) FILTER (WHERE selected), 0)::BIGINT AS selected_rows FROM s""")
def file_counts(spark, sf):
    """Selected and all files, each once, and as the sum over the entries."""
    s = instances(spark, sf).where("sop <> ''").groupBy("study", "series", (F.col("l_suppkey") % 3 == 0).alias("selected")).agg(F.countDistinct("sop").alias("files"), F.count(F.lit(1)).alias("per_entry"))
    chosen = lambda c: F.coalesce(F.sum(F.when(F.col("selected"), F.col(c))), F.lit(0))
    return s.agg(chosen("files").alias("selected_files"), F.sum("files").alias("all_files"), chosen("per_entry").alias("selected_rows"))


@query("""WITH s AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem), p AS (SELECT l_orderkey, dense_rank() OVER (ORDER BY l_orderkey) - 1 AS study_index FROM (SELECT DISTINCT l_orderkey FROM s))
SELECT l_orderkey, p.study_index, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_suppkey) - 1 AS series_index, l_suppkey FROM s JOIN p USING (l_orderkey)""")
def flatten_series(spark, sf):
    studies = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("study")).agg(F.array_sort(F.collect_set("l_suppkey")).alias("series")).withColumn("rank", F.col("study"))
    return M.flattened(studies).select(F.col("study").alias("l_orderkey"), "study_index", "series_index", F.col("series").alias("l_suppkey"))


@query("""SELECT p_partkey, concat('Pat_', p_partkey, '/St_', p_size, '/Se_b/1.2.', p_partkey, '.dcm') AS path, CASE p_size % 3 WHEN 0 THEN 'A^B' WHEN 1 THEN 'ideo' ELSE '' END AS name FROM part""")
def file_paths(spark, sf):
    from ..operators.archive import file_path

    k, i = F.col("p_partkey"), F.col("p_size") % 3
    path = file_path(F.concat(F.lit("Pat:"), k), F.concat(F.lit(" St "), "p_size"), F.lit("../Se b."), F.concat(F.lit("1.2."), k), F.lit("dcm"))
    name = M.person_name(F.when(i == 0, "A^B"), F.when(i == 1, " ideo "), F.lit(""))
    return table(spark, sf, "part").select("p_partkey", path.alias("path"), name.alias("name"))
