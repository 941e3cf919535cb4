"""What the operators share: reading documents, the white space of the contracts, staged tables."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of every contract: space and 0x09 to 0x0D, which is also what bytes.split() cuts at.
BLANKS = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text (null: empty), so that no other column can clash or be shuffled."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a folder of our own only where none is set in local mode (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
    if not found:
        found = f"file://{tempfile.mkdtemp(prefix='silvercask-')}"
        spark.conf.set("spark.checkpoint.dir", found)
        atexit.register(__import__("shutil").rmtree, found.removeprefix("file://"), True)
    return found.rstrip("/")


#: Spark's own setting that deletes an execution's shuffle files when it ends: a staged table has no use for them.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Rows of an Arrow batch.
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Bytes of an Arrow batch.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
#: What these settings are where a session sets nothing.
DEFAULTS = {CLEANUP: "false", BATCH: "10000", BATCH_BYTES: "64m"}


class Stage:
    """Tables written to the shared folder, so that a lost executor never costs more than one stage.

    A staged table replaces recomputation (and lineage); drop() removes those that nothing lazy reads any more.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}", 0

    def put(self, df: DataFrame, rows: int | None = None, size: int | None = None) -> DataFrame:
        """df, written and read again. rows: how many at most go to Python at a time, where rows are large; size: how many bytes."""
        self.n += 1
        path = f"{self.root}/{self.n}"
        settings = {CLEANUP: "true"} | ({BATCH: str(rows)} if rows else {}) | ({BATCH_BYTES: str(size)} if size else {})
        before = {k: self.spark.conf.get(k, DEFAULTS[k]) for k in settings}
        for k, v in settings.items():
            self.spark.conf.set(k, v)
        try:
            df.write.parquet(path)
        finally:
            for k, v in before.items():
                self.spark.conf.set(k, v)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._stage_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        jvm = self.spark._jvm
        for t in tables:
            path = jvm.org.apache.hadoop.fs.Path(t._stage_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def let(value: Column, body) -> Column:
    """body(value), with value computed once for a row however often body uses it."""
    return F.transform(F.array(value), body)[0]
