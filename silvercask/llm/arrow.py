"""Arrow batches of texts for the operators that run Python on the executors."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Characters of text that are worked on at a time; a longer text is worked on alone.
PORTION = 2_000_000
#: Texts that are worked on at a time, however short.
TEXTS = 65_536
#: Whole rows with their texts that go to Python at a time, where Spark's 10,000 are too large beside what else is held.
ROWS = 512
#: The same in bytes, where rows without texts go to Python in the same plan and should not go a few at a time.
BYTES = 1 << 20


def trim() -> None:
    """Gives freed memory back to the system; else a worker that is reused keeps the most that any task before has held."""
    pa.default_memory_pool().release_unused()
    give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc only
    if give_back:
        give_back(0)


def portions(batch: pa.RecordBatch, limit: int = PORTION) -> Iterator[tuple[list, list[str]]]:
    """(ids, texts) of consecutive rows, cut by the length of their texts, so that memory is bounded by one text."""
    ids, texts, size = [], [], 0
    for i, t in zip(batch.column(0), batch.column(1)):
        t = t.as_py()
        if texts and (size + len(t) > limit or len(texts) == TEXTS):
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(i.as_py())
        texts.append(t)
        size += len(t)
    if texts:
        yield ids, texts


def gathered(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[list, list[str]]]:
    """As portions, over the ends of batches: small batches make no small portions."""
    ids, texts, size = [], [], 0
    for batch in batches:
        for more, some in portions(batch, limit):
            n = sum(map(len, some))
            if texts and (size + n > limit or len(texts) + len(some) > TEXTS):
                yield ids, texts
                ids, texts, size = [], [], 0
            ids, texts, size = ids + more, texts + some, size + n
    if texts:
        yield ids, texts


def map_texts(df: DataFrame, work: Callable[[list, list[str]], list], schema: str) -> DataFrame:
    """work(ids, texts) -> one list or array a column; df has doc_id and text."""
    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        for batch in batches:
            for ids, texts in portions(batch):
                columns = work(ids, texts)
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, target)], schema=target)

    return df.mapInArrow(run, schema)
