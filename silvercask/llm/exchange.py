"""Which shingles of a corpus occur more than once, and how often: an exchange of packed hashes.

Texts are read once, in portions. A portion's hashes are sorted, cut into ranges and sent packed, a row for each range;
a hash that a portion holds more than once is sent once, with its count, so a shingle of very many documents costs
10 bytes a portion. Hashes are sent without the bits that name their range, 48 bits each: those that decide are of 52 to
64 bits, 64 from 256 GB of text on. Where a range of all portions meets, the counts are summed, and what occurs more than once goes back
to its portion with the logarithm of its count. A shingle that stays behind occurs once in the corpus: it can be in no
intersection, so the rest of a join needs neither it nor the texts again.

A portion is named by its task, its place there and its hashes, which a repeated task gives again if its rows come in
the same order, as they do from files and staged tables; if they do not, the job fails, and no wrong rows come out.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import gathered
from .common import Stage

#: Characters of a portion, and of the texts whose hashes meet in one range (8 to 10 bytes a word, so some 12 MB).
PIECE = 4_000_000
RANGE = 8_000_000
#: Bytes of a hash that are sent.
SENT = 6
#: Packed rows (or texts) that go to Python at a time.
BLOBS = 128
#: There are 2 ** 4 to 2 ** 20 ranges, by the length of all texts.
BITS = (4, 20)


def log_count(n: np.ndarray) -> np.ndarray:
    """Counts in a byte: 8 steps for each doubling, 0 for 1."""
    return np.minimum(8 * np.log2(n), 255).astype(np.uint8)


def count_bound(log: np.ndarray) -> np.ndarray:
    """The greatest count that a byte stands for."""
    return np.ceil(2.0 ** ((log.astype(np.float64) + 1) / 8)).astype(np.int64)


def pack(arrays: dict[str, np.ndarray]) -> bytes:
    """Named arrays of any lengths as one Arrow message."""
    lists = [pa.LargeListArray.from_arrays(pa.array([0, len(a)], pa.int64()), pa.array(a)) for a in arrays.values()]
    batch, sink = pa.RecordBatch.from_arrays(lists, names=list(arrays)), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpack(data: bytes) -> dict[str, np.ndarray]:
    batch = next(iter(pa.ipc.open_stream(data)))
    return {name: batch.column(name).values.to_numpy(zero_copy_only=False) for name in batch.schema.names}


def by_value(batches, name: str):
    """(value, rows) for each run of equal values of a column; holds the rows of one value."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(name).to_numpy()
        cuts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]).tolist() + [len(key)]
        for a, b in zip(cuts, cuts[1:]):
            if held and key[a] != last:
                yield last, pa.Table.from_batches(held)
                held = []
            last = key[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield last, pa.Table.from_batches(held)


def _narrow(a: np.ndarray, width: int) -> np.ndarray:
    """The low bytes of numbers, a row each."""
    return np.ascontiguousarray(a.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :width]


def _wide(data, width: int) -> np.ndarray:
    rows = np.frombuffer(data, np.uint8).reshape(-1, width)
    return np.pad(rows, ((0, 0), (0, 8 - width))).view("<u8").ravel()


def _array(column, kind: str) -> np.ndarray:
    return np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in column if x.is_valid] or [np.empty(0, kind)])


def shared_elements(docs: DataFrame, describe: Callable, assemble: Callable, schema: str, stage: Stage) -> DataFrame:
    """Staged rows that assemble makes of each portion of docs (doc_id, text).

    describe(ids, texts) -> hashes (uint64), their owners (uint32, of any meaning within the portion) and a dict of
    arrays to keep. assemble(kept, hashes, owners, logs) -> a record batch; it gets those hashes, with their owners,
    that occur more than once in the corpus, in no order. Each is counted as often as describe gives it.
    """
    length = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    bits = min(max(int(length // RANGE).bit_length(), BITS[0]), BITS[1])
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), (1 << bits) // 4)
    drop, own_bits = np.uint64(64 - 8 * SENT), np.uint64(bits)
    sent = "range long, portion long, width int, once binary, owner binary, many binary, times binary, kept binary"

    def send(batches):
        task, nth = TaskContext.get().partitionId(), 0
        for ids, texts in gathered(batches, PIECE):
            values, owners, kept = describe(ids, texts)
            if 8 * SENT + bits < 64:
                low = np.uint64(64 - 8 * SENT - bits)
                values = values >> low << low
            order = np.argsort(values, kind="stable")
            values, owners = values[order], owners[order].astype(np.uint32)
            first = np.flatnonzero(np.r_[True, values[1:] != values[:-1]]) if len(values) else np.empty(0, np.int64)
            times = np.diff(np.r_[first, len(values)])
            single = np.repeat(times == 1, times)
            once, own = values[single], owners[single]
            many, n = values[first[times > 1]], times[times > 1].astype(np.uint32)
            kept = kept | {"_many": many, "_times": n, "_owners": owners[~single]}
            edges = np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
            x, y = np.append(np.searchsorted(once, edges), len(once)), np.append(np.searchsorted(many, edges), len(many))
            some = np.flatnonzero((np.diff(x) > 0) | (np.diff(y) > 0))
            width = max(1, (int(own.max()).bit_length() + 7) // 8) if len(own) else 1
            cut = lambda a, e: pa.array([a[e[i] : e[i + 1]].tobytes() for i in some] + [None], pa.binary())
            portion = task << 43 | nth << 23 | zlib.crc32(values.tobytes()) & 0x7FFFFF
            nth += 1
            rows = len(some) + 1
            columns = [pa.array([*some.tolist(), -1 - portion % 4093], pa.int64()), pa.array([portion] * rows, pa.int64()), pa.array([width] * rows, pa.int32())]
            columns += [cut(_narrow(once << own_bits >> drop, SENT), x), cut(_narrow(own, width), x), cut(_narrow(many << own_bits >> drop, SENT), y), cut(n, y), pa.array([None] * len(some) + [pack(kept)], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["range", "portion", "width", "once", "owner", "many", "times", "kept"])

    found = "range long, portion long, width int, value binary, owner binary, log binary, many binary, kept binary"
    names = ["range", "portion", "width", "value", "owner", "log", "many", "kept"]

    def count(batches):
        for key, rows in by_value(batches, "range"):
            if key < 0:
                none = pa.nulls(rows.num_rows, pa.binary())
                yield from pa.Table.from_arrays([rows.column("range"), rows.column("portion"), rows.column("width"), none, none, none, none, rows.column("kept")], names=names).to_batches()
                continue
            once, many = ([_wide(x.as_buffer(), SENT) for x in rows.column(c)] for c in ("once", "many"))
            values = np.concatenate(once + many)
            weight = np.concatenate([np.ones(sum(map(len, once)), np.int64), _array(rows.column("times"), "<u4").astype(np.int64)])
            order = np.argsort(values, kind="stable")
            first = np.flatnonzero(np.r_[True, values[order][1:] != values[order][:-1]])
            total = np.empty(len(values), np.int64)
            total[order] = np.repeat(np.add.reduceat(weight[order], first), np.diff(np.r_[first, len(values)]))
            logs, at, to = log_count(total), 0, sum(map(len, once))
            out = [[], [], [], [], [], []]
            for portion, width, v, own, m in zip(rows.column("portion").to_pylist(), rows.column("width").to_pylist(), once, rows.column("owner"), many):
                again = total[at : at + len(v)] > 1
                if again.any() or len(m):
                    owners = np.frombuffer(own.as_buffer(), np.uint8).reshape(-1, width)
                    for column, x in zip(out, (portion, width, _narrow(v[again], SENT).tobytes(), owners[again].tobytes(), logs[at : at + len(v)][again].tobytes(), logs[to : to + len(m)].tobytes())):
                        column.append(x)
                at, to = at + len(v), to + len(m)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(out[0]), pa.int64()), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), *(pa.array(c, pa.binary()) for c in out[2:]), pa.nulls(len(out[0]), pa.binary())], names=names)

    def settle(batches):
        for _, rows in by_value(batches, "portion"):  # by range: what was kept comes first, then the hashes in order
            found = [x.as_py() for x in rows.column("kept") if x.is_valid]
            if len(found) != 1:
                raise RuntimeError("a repeated task has read other rows than before; stage the input")
            kept = unpack(found[0])
            many, times, own = kept.pop("_many"), kept.pop("_times"), kept.pop("_owners")
            logs, width = _array(rows.column("many"), "u1"), rows.column("width")[0].as_py()
            whole = [(_wide(x.as_buffer(), SENT) << drop >> own_bits) | (np.uint64(r) << np.uint64(64 - bits)) for r, x in zip(rows.column("range").to_pylist(), rows.column("value")) if x.is_valid]
            values = np.concatenate([*whole, np.repeat(many, times)])
            owners = np.concatenate([*(_wide(x.as_buffer(), width) for x in rows.column("owner") if x.is_valid), own]).astype(np.int64)
            batch = assemble(kept, values, owners, np.concatenate([_array(rows.column("log"), "u1"), np.repeat(logs, times)]))
            if batch is not None and batch.num_rows:
                yield batch

    met = docs.mapInArrow(send, sent).repartition(tasks, "range").sortWithinPartitions("range").mapInArrow(count, found)
    return stage.put(met.repartition(tasks, "portion").sortWithinPartitions("portion", "range").mapInArrow(settle, schema), rows=BLOBS)
