"""What the query modules share: registration, tables, and the views that stand for the model.

customer = patient, orders = study, (order, supplier) = series, lineitem = instance, events = log, documents = text
findings and payloads, pages = URLs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict = {}
ORACLES: dict = {}
#: The key of the queries' hashes, over invented data. A real run brings its own.
SECRET = "driver tables"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows that are small but much work each, dealt to all cores: a file of them is a single task otherwise."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism), key)


def hmac_sql(value: str) -> str:
    """HMAC-SHA-256 of a text expression, as SQL."""
    key = SECRET.encode().ljust(64, b"\0")
    inner, outer = ("'" + "".join(f"\\x{x ^ y:02X}" for x in key) + "'::BLOB" for y in (0x36, 0x5C))
    return f"sha256({outer} || unhex(sha256({inner} || encode({value}))))"


def number_sql(value: str, digits: str) -> str:
    return f"CAST(concat('0x', substr({value}, {digits})) AS BIGINT)"


def uid_sql(value: str) -> str:
    h = hmac_sql(f"concat('uid/', {value})")
    part = lambda i: f"lpad(CAST({number_sql(h, f'{i}, 12')} AS VARCHAR), 15, '0')"
    return f"concat('2.25.1', {part(1)}, {part(13)})"


def offset_sql(subject: str) -> str:
    n = f"({number_sql(hmac_sql(f"concat('date/', {subject})"), '1, 8')} % 3651 - 1825)"
    return f"CAST(CASE WHEN {n} = 0 THEN 1 ELSE {n} END AS INTEGER)"


GRAMMAR_SQL = "regexp_matches({0}, '^([0-9]|[1-9][0-9]*)(\\.([0-9]|[1-9][0-9]*))*$') AND length({0}) <= 64"

ITEMS = """SELECT concat('1.2.840.', CASE WHEN l_orderkey % 17 = 0 THEN '0' ELSE '' END, l_orderkey) AS study, concat('1.2.840.', l_orderkey, '.', l_suppkey) AS series,
 concat('1.2.840.', l_orderkey, '.', l_suppkey, '.', l_linenumber) AS sop, l_orderkey * 100000000 + l_linenumber * 10000000 + l_partkey AS seq, l_suppkey % 8 AS modality, l_quantity, l_orderkey, l_suppkey, l_linenumber FROM lineitem"""


def items(spark, sf):
    pre = F.when(F.col("l_orderkey") % 17 == 0, "0").otherwise("")
    series = F.concat(F.lit("1.2.840."), F.col("l_orderkey"), F.lit("."), F.col("l_suppkey"))
    return table(spark, sf, "lineitem").select(F.concat(F.lit("1.2.840."), pre, F.col("l_orderkey")).alias("study"), series.alias("series"), F.concat(series, F.lit("."), F.col("l_linenumber")).alias("sop"), (F.col("l_orderkey") * 100000000 + F.col("l_linenumber") * 10000000 + F.col("l_partkey")).alias("seq"), (F.col("l_suppkey") % 8).alias("modality"), "l_quantity", "l_orderkey", "l_suppkey", "l_linenumber")


MODALITY_CODES = ("CT", "MR", "US", "CR", "XA", "MG", "", "RTSTRUCT")

#: Instances with the corners that plain rows never reach: study keys with a leading zero, repeated rows, rows without a
#: source, frame addresses, empty modalities, and series whose objects are named by their address only.
INSTANCES = f"""SELECT study, series, CASE WHEN seq % 19 = 0 THEN '' ELSE sop END AS sop, seq, CASE WHEN seq % 13 = 0 THEN '' ELSE concat('https://h/dicom/', l_orderkey, '/', l_suppkey, '?objectUID=', sop, CASE WHEN seq % 3 = 0 THEN '&frame=2' ELSE '' END) END AS url,
 seq % 26 = 0 AS has_file, CASE WHEN l_quantity > 30 THEN CAST(l_quantity AS BIGINT) ELSE 1 END AS frames, list_extract(['CT', 'MR', 'US', 'CR', 'XA', 'MG', '', 'RTSTRUCT'], modality + 1) AS modality, l_orderkey, l_suppkey, l_linenumber, modality AS number
 FROM (SELECT * FROM ({ITEMS}) UNION ALL SELECT * REPLACE (seq + 100000000000000000 AS seq) FROM ({ITEMS}) WHERE l_orderkey % 50 = 0)"""


def instances(spark, sf):
    i = items(spark, sf)
    i = i.unionByName(i.where("l_orderkey % 50 = 0").withColumn("seq", F.col("seq") + 100000000000000000))
    seq = F.col("seq")
    address = F.concat(F.lit("https://h/dicom/"), "l_orderkey", F.lit("/"), "l_suppkey", F.lit("?objectUID="), "sop", F.when(seq % 3 == 0, "&frame=2").otherwise(""))
    code = F.element_at(F.array(*map(F.lit, MODALITY_CODES)), (F.col("modality") + 1).cast("int"))
    return i.select("study", "series", F.when(seq % 19 == 0, "").otherwise(F.col("sop")).alias("sop"), "seq", F.when(seq % 13 == 0, "").otherwise(address).alias("url"), (seq % 26 == 0).alias("has_file"), F.when(F.col("l_quantity") > 30, F.col("l_quantity").cast("long")).otherwise(F.lit(1).cast("long")).alias("frames"), code.alias("modality"), "l_orderkey", "l_suppkey", "l_linenumber", F.col("modality").alias("number"))
