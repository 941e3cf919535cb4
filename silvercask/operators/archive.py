"""Archives: running budgets and offsets without a task per archive, and stored ZIP files."""

from __future__ import annotations

import io
import zipfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows of a group that one task adds up; a larger group is cut into ranges.
RANGE = 100_000
# Limits of a stored ZIP without extensions.
ZIP_BYTES = 4 << 30
ZIP_FILES = 65_535


def running(rows: DataFrame, group: str, by: str, parts: int = 256) -> DataFrame:
    """rows (group, by, bytes) with _sum and _count up to and with each row, in the order of the number ``by``.

    A group is cut into ranges of ``by`` where it has more than ``RANGE`` rows: sums of the ranges are added up first, a
    few rows a group, and then within each range. Nothing sorts a whole group in one task."""
    size = rows.groupBy(group).agg(F.count(F.lit(1)).alias("_n"), F.min(by).alias("_low"), F.max(by).alias("_high"))
    cuts = F.least(F.lit(parts), F.ceil(F.col("_n") / RANGE))
    size = size.select(F.col(group).alias("_g"), "_low", F.greatest(F.lit(1).cast("long"), F.floor((F.col("_high") - F.col("_low")) / cuts).cast("long") + 1).alias("_width"))
    cut = rows.join(size, rows[group].eqNullSafe(F.col("_g"))).withColumn("_part", F.floor((F.col(by) - F.col("_low")) / F.col("_width")).cast("long"))
    before = W.partitionBy("_g").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    sums = cut.groupBy("_g", "_part").agg(F.sum("bytes").alias("s"), F.count(F.lit(1)).alias("c"))
    sums = sums.select(F.col("_g").alias("_g2"), F.col("_part").alias("_part2"), F.coalesce(F.sum("s").over(before), F.lit(0).cast("long")).alias("_s"), F.coalesce(F.sum("c").over(before), F.lit(0).cast("long")).alias("_c"))
    out = cut.join(sums, F.col("_g").eqNullSafe(F.col("_g2")) & (F.col("_part") == F.col("_part2")))
    here = W.partitionBy("_g", "_part").orderBy(by).rowsBetween(W.unboundedPreceding, W.currentRow)
    out = out.withColumn("_sum", F.sum("bytes").over(here) + F.col("_s")).withColumn("_count", F.count(F.lit(1)).over(here) + F.col("_c"))
    return out.drop("_g", "_g2", "_low", "_width", "_part", "_part2", "_s", "_c")


def budget(rows: DataFrame, group: str, by: str, most_bytes: int, most_files: int) -> DataFrame:
    """rows with used (bytes up to and with each) and fits: whether an archive still takes it."""
    out = running(rows, group, by)
    return out.select(*rows.columns, F.col("_sum").alias("used"), ((F.col("_sum") <= most_bytes) & (F.col("_count") <= most_files)).alias("fits"))


def offsets(rows: DataFrame, group: str, by: str) -> DataFrame:
    """rows with start: where an even-padded frame's item begins, counted from the first of its group."""
    padded = rows.withColumn("_own", F.col("bytes") + F.col("bytes") % 2 + 8)
    out = running(padded.withColumn("bytes", F.col("_own")), group, by)
    return out.select(*[c for c in rows.columns if c != "bytes"], (F.col("_sum") - F.col("bytes")).alias("start"))


def file_path(patient: Column, study: Column, series: Column, sop: Column, extension: Column) -> Column:
    """The place of a file below the folder of an export."""
    from ..functions import scalars as S

    part = lambda c, name: S.sanitize(c, name)
    return F.concat_ws("/", part(patient, "patient"), part(study, "study"), part(series, "series"), F.concat(S.safe_name(sop), F.lit("."), extension))


def archives(files: DataFrame, group: str = "archive") -> DataFrame:
    """files (group, path, data, ts; those of an archive fit its budget) -> group, n, zip: a stored ZIP of each group, its
    files by path, those of equal path by their bytes, the first staying.

    An archive is one binary value, so it is bounded by 2 GiB, the limit of a row; larger groups are refused, as are
    more than 65,534 files. A null path or null data stands for an empty one."""
    import pandas as pd

    def build(key, rows):
        rows = rows.assign(path=rows["path"].fillna(""), data=[bytes(d) if d is not None else b"" for d in rows["data"]]).sort_values(["path", "data"]).drop_duplicates("path")
        if len(rows) >= ZIP_FILES or rows["data"].map(len).sum() > (2 << 30) - (1 << 20):
            raise ValueError(f"archive {key[0]} is too large")
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
            for path, data, ts in zip(rows["path"], rows["data"], rows["ts"]):
                when = (min(max(ts.year, 1980), 2107), ts.month, ts.day, ts.hour, ts.minute, ts.second) if not pd.isna(ts) else (1980, 1, 1, 0, 0, 0)
                z.writestr(zipfile.ZipInfo(path, when), data)
        return pd.DataFrame({group: [key[0]], "n": [len(rows)], "zip": [out.getvalue()]})

    kind = files.schema[group].dataType.simpleString()
    return files.select(group, "path", "data", "ts").groupBy(group).applyInPandas(build, f"{group} {kind}, n long, zip binary")


def write_files(files: DataFrame, root: str) -> DataFrame:
    """files (path, data) below a folder that all executors share -> path, bytes, sha256 of what was written.

    A file is written beside its place and moved there, so a task that runs again or is lost leaves whole files only;
    of files with one path the last to be written stays. Paths must stay below the folder."""
    import hashlib
    import os
    import uuid

    def run(batches):
        for batch in batches:
            paths, sizes, sums = [], [], []
            for path, data in zip(batch.column("path").to_pylist(), batch.column("data")):
                data, target = data.as_py() or b"", os.path.normpath(os.path.join(root, path or "unnamed"))
                if os.path.commonpath([target, os.path.normpath(root)]) != os.path.normpath(root):
                    raise ValueError(f"path outside the folder: {path}")
                os.makedirs(os.path.dirname(target), exist_ok=True)
                part = f"{target}.{uuid.uuid4().hex}.part"
                with open(part, "wb") as f:
                    f.write(data)
                os.replace(part, target)
                paths.append(path)
                sizes.append(len(data))
                sums.append(hashlib.sha256(data).hexdigest())
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(sizes, pa.int64()), pa.array(sums, pa.string())], names=["path", "bytes", "sha256"])

    return files.select("path", F.col("data").cast("binary").alias("data")).mapInArrow(run, "path string, bytes long, sha256 string")
