"""Exact dedup by content-defined chunk recipes (native: SQL functions only).

A normalised text (runs of white space become one space) is cut where its content says so: after a sentence
end once a chunk has ``low`` characters, at the latest after ``high``. A recipe is the ordered list of its
chunks' identifiers. Recipes are made where the rows are read; only they are shuffled, about 2 % of the text.
Different recipes prove different texts. Among texts with equal recipes, every chunk travels once a task
(partial aggregation) and is compared in full with the others of its identifier; a chunk identifier that
stands for two chunks makes the operator repeat the grouping on the chunks themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANKS, Stage, documents, texts

#: Ids of at most this many documents are broadcast (8 bytes each); beyond it, Spark joins by shuffle.
BROADCAST_IDS = 1_000_000


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, BLANKS, " ")


def chunks(norm: Column, low: int, high: int) -> Column:
    return F.regexp_extract_all(norm, F.lit(rf"(?s).{{{low},{high}}}?[.!?] |.{{1,{high}}}"), F.lit(0))


def identifier(chunk: Column) -> Column:
    return F.unhex(F.md5(chunk))


def exact_dedup(docs: DataFrame, low: int = 512, high: int = 4096, id_col: str = "doc_id", text_col: str = "text", _identifier=identifier) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256, n_chunks.

    Of equal normalised texts the smallest doc_id stays. Null text counts as empty and all empty texts are equal.
    Rows that repeat a doc_id are counted and answered one by one. A null doc_id is larger than any other; a group
    of null ids only has a null keep_id and is kept. An empty table gives an empty result.
    """
    spark, stage = docs.sparkSession, Stage(docs.sparkSession, "exact")
    base = texts(docs, id_col, text_col).select("doc_id", normalised(F.col("text")).alias("norm"))
    made = stage.put(base.select("doc_id", F.sha2("norm", 256).alias("text_sha256"), F.transform(chunks(F.col("norm"), low, high), _identifier).alias("recipe")))
    groups = made.groupBy("recipe").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    many = stage.put(groups.where("group_size > 1"))
    ids = made.join(many.select("recipe"), "recipe", "left_semi").select("doc_id")
    ids = F.broadcast(ids) if (many.agg(F.sum("group_size")).first()[0] or 0) <= BROADCAST_IDS else ids
    moved = base.join(ids.toDF("_id"), F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi").select(F.explode(chunks(F.col("norm"), low, high)).alias("chunk"))
    held = moved.groupBy(_identifier(F.col("chunk")).alias("id")).agg(F.min("chunk").alias("a"), F.max("chunk").alias("b"))
    if not held.where("a <> b").isEmpty():  # an identifier of two chunks: let the chunks stand for themselves
        stage.drop(made, many)
        return exact_dedup(docs, low, high, id_col, text_col, _identifier=lambda c: c.cast("binary"))
    out = made.join(many, "recipe", "left")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return out.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256", F.size("recipe").alias("n_chunks"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """exact_dedup() over documents: null and empty texts are equal, repeated rows are answered one by one."""
    return exact_dedup(documents(spark, sf_dir)).drop("n_chunks")


SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.t) AS text_sha256 FROM n JOIN g ON n.t = g.t
"""
