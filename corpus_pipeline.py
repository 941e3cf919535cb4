"""From raw documents to packed token sequences, in five stages.

Each stage reads what the one before kept, written as Parquet in between; all but the last return the columns of
documents. Rows are joined back to decisions by a 64-bit hash of doc_id (null or not) and text, so rows that share an
id but not a text are decided one by one; of rows that repeat id and text one stays from the exact stage on.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from silvercask.llm import exact_dedup, ngram_join, packing, pii, quality
from silvercask.llm.arrow import ROWS
from silvercask.llm.common import Stage

#: The key of a row while a stage decides.
KEY = "_row_key"
#: Decisions of at most this many rows are broadcast (8 bytes each); beyond it, Spark joins by shuffle.
BROADCAST_IDS = 1_000_000


def _keyed(docs: DataFrame, text: Column | None = None) -> DataFrame:
    """docs with KEY, a hash of doc_id and of text (or what stands for it)."""
    return docs.withColumn(KEY, F.xxhash64(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")) if text is None else text))


def _without(keyed: DataFrame, gone: DataFrame) -> DataFrame:
    """keyed, without KEY, and without the rows whose KEY is in gone (one column)."""
    gone = Stage(keyed.sparkSession, "gone").put(gone.toDF("_gone").distinct())
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    return keyed.join(gone, keyed[KEY] == gone["_gone"], "left_anti").drop(KEY)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; null and empty texts have no words and are rejected. An empty table gives an empty one."""
    keyed = _keyed(docs)
    return _without(keyed, quality.quality(keyed, id_col=KEY).where("not kept").select("doc_id"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the smallest doc_id stays (null is the largest); of rows that repeat it and the text, one."""
    keyed = _keyed(docs, F.sha2(exact_dedup.normalised(F.coalesce("text", F.lit(""))), 256))
    found = exact_dedup.exact_dedup(docs).select(F.xxhash64("doc_id", "text_sha256").alias(KEY), "kept")
    found = Stage(spark, "exact").put(found)
    again = Stage(spark, "again").put(found.where("kept").groupBy(KEY).count().where("count > 1").select(KEY))
    gone = found.where("not kept").select(KEY)
    if again.isEmpty():
        return _without(keyed, gone)
    return _without(keyed, gone.unionByName(again)).unionByName(keyed.join(again, KEY, "left_semi").dropDuplicates([KEY]).drop(KEY))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that with the smallest doc_id (null is the largest): five-word
    shingles, similarity 0.8."""
    keyed, stage = _keyed(docs), Stage(spark, "near")
    found = ngram_join.jaccard_classes(keyed, k=5, percent=80, id_col=KEY).select(F.col("doc_id").alias(KEY), "component_id")
    many = stage.put(found.distinct())
    groups = many.groupBy("component_id").count().where("count > 1").select("component_id")
    members = stage.put(many.join(groups, "component_id").join(keyed.select(KEY, "doc_id").distinct(), KEY))
    best = members.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", KEY)).alias("best"))
    return _without(keyed, members.join(best, "component_id").where(F.col(KEY) != F.col(f"best.{KEY}")).select(KEY))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind in brackets; n_chars counts the new text. A null text stays null (and its
    n_chars too); rows that repeat an id or a text are redacted one by one. Staged, so that few rows at a time are in
    Python whoever writes the result."""
    model = pii.Crf.train()
    rest = [c for c in docs.columns if c not in ("text", "n_chars")]
    return Stage(spark, "pii").put(pii.redacted_rows(docs, model), rows=ROWS).select(*[F.col(c) if c in rest else F.col("text") if c == "text" else F.length("text").cast(docs.schema[c].dataType).alias(c) for c in docs.columns])


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents packed into sequences of 1,024 tokens, a row for each piece. A null or empty text is one end token; rows
    that repeat an id are packed one by one; an empty table gives an empty result."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality_rules", quality_stage), ("exact_dedup", exact_stage), ("near_duplicates", near_stage), ("pii", pii_stage), ("best_fit_packing", packing_stage)]

#: The stages from near duplicates on have no form in SQL; the tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; the last one's rows."""
    docs, stage = spark.read.parquet(f"{sf_dir}/documents.parquet"), Stage(spark, "pipeline")
    for i, (_, f) in enumerate(STAGES):
        docs = f(spark, docs, sf_dir)
        docs = stage.put(docs) if i + 1 < len(STAGES) else docs
    return docs
