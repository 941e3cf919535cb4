"""De-identification of attribute tables as they arrive. New UIDs and date offsets come from keyed hashes, so no state is
kept between batches, and a batch that runs again gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.deid import Options, apply_rules


def deidentify_stream(arriving: DataFrame, rules: DataFrame, options: Options, target: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """A stream of attributes (whole instances in each batch, as files hold them) to Parquet below ``target``, a folder for
    each batch, replaced as a whole when a batch runs again."""

    def write(batch: DataFrame, number: int) -> None:
        apply_rules(batch, rules, options).where("action <> 'remove'").write.mode("overwrite").parquet(f"{target}/batch={number}")

    stream = arriving.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (stream.trigger(availableNow=True) if once else stream).start()
