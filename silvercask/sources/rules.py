"""Rule tables from files: JSON objects by tag, and XML scripts; and studies from captured JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def json_rules(spark: SparkSession, path: str) -> DataFrame:
    """(tag, name, rule) of a JSON object whose members are tags, with a rule or an object of name and rule."""
    text = spark.read.text(path, wholetext=True)
    entry = F.from_json("value", T.MapType(T.StringType(), T.StringType()))
    rows = text.select(F.explode(entry).alias("tag", "v"))
    nested = F.from_json("v", "name string, rule string")
    is_object = F.trim("v").startswith("{")
    return rows.select("tag", F.when(is_object, nested["name"]).otherwise("Unknown").alias("name"), F.when(is_object, F.coalesce(nested["rule"], F.lit(""))).otherwise(F.col("v")).alias("rule"))


def script_rules(spark: SparkSession, path: str) -> DataFrame:
    """(tag, name, rule) of a script: elements e with attributes t and n, and the rule as their text. The flag of an element is not looked at."""
    schema = "_en string, _t string, _n string, _VALUE string"
    rows = spark.read.format("xml").option("rowTag", "e").option("ignoreSurroundingSpaces", "true").schema(schema).load(path)
    return rows.where(F.coalesce(F.col("_t"), F.lit("")) != "").select(F.col("_t").alias("tag"), F.col("_n").alias("name"), F.trim(F.coalesce("_VALUE", F.lit(""))).alias("rule"))


def captured_studies(spark: SparkSession, path: str) -> DataFrame:
    """The studies of JSON documents (one a file) that hold any, with their documents' paths: study and its JSON."""
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("source"), "value")
    studies = F.from_json(F.get_json_object("value", "$.studies"), "array<string>")
    each = text.select("source", F.explode(studies).alias("study_json"))
    return each.select("source", F.get_json_object("study_json", "$.StudyInstanceUID").alias("study"), "study_json")
