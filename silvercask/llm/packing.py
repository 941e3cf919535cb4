"""Best-fit packing of token sequences, after Martello-Toth dominance reduction.

Only lengths matter to a packing, and there are at most ``size`` of them, so the instance that is solved on the
driver is a histogram: its size does not depend on the corpus. First come sets that provably belong to an optimal
packing: for an item of length a, another that fills the bin exactly; nothing, if no item fits beside it; the
largest that fits, if no two items fit beside it. Each is fixed and leaves a smaller instance; the remainder is packed
best-fit decreasing, all items of a length at once. The packing is a few thousand bin patterns with multiplicities;
documents get their places in it by rank among the pieces of their length. Ranks are dealt by (length, salt).
"""

from __future__ import annotations

import os
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from tokenizers import Tokenizer

from .arrow import ROWS, portions, trim
from .common import Stage, documents, texts
from .token_counts import byte_symbols

_BLANKS = re.compile(r"\s{1000}")
#: Pieces of one length that are ranked together, about.
RANKED = 500_000

Pattern = tuple[int, list[tuple[int, int]]]  # bins of this kind, [(length, items of it in each bin)]


def reduce_instance(counts: dict[int, int], size: int) -> list[Pattern]:
    """Fixes dominating sets, and takes them out of counts."""
    fixed: list[Pattern] = []

    def take(n: int, *items: int) -> None:
        each = defaultdict(int)
        for x in items:
            each[x] += 1
        for x, k in each.items():
            counts[x] -= n * k
            if not counts[x]:
                del counts[x]
        fixed.append((n, sorted(each.items(), reverse=True)))

    for a in sorted(counts, reverse=True):
        if a in counts and a == size:
            take(counts[a], a)
        elif a in counts and size - a in counts and (b := size - a) <= a and (n := counts[a] // 2 if a == b else min(counts[a], counts[b])):
            take(n, a, b)
    changed = True
    while changed and counts:
        changed = False
        for a in sorted(counts, reverse=True):
            if a not in counts:
                continue
            room, order = size - a, sorted(counts)
            others = lambda x: counts[x] - (x == a)
            least = [x for x in order[:3] for _ in range(min(2, others(x)))][:2]
            if not least or least[0] > room:
                take(counts[a] if not least or a + a > size else 1, a)
            elif len(least) == 1 or sum(least) > room:
                best = max(x for x in order if x <= room and others(x))
                take(1 if best == a else min(counts[a], counts[best]), a, best)
            else:
                break  # two items fit beside this one, and so beside every smaller one
            changed = True
            break
    return fixed


def best_fit(counts: dict[int, int], size: int) -> list[Pattern]:
    """Best-fit decreasing, with bins of equal contents kept as one entry; at most four entries a length arise."""
    rooms: dict[int, list[Pattern]] = defaultdict(list)
    for a in sorted(counts, reverse=True):
        n = counts[a]
        while n:
            room = min((r for r in rooms if r >= a and rooms[r]), default=None)
            bins, held = rooms[room].pop() if room is not None else (n, [])
            room = size if room is None else room
            k = min(room // a, n)
            full = min(bins, n // k)
            if bins > full and held:
                rooms[room].append((bins - full, held))
            rooms[room - k * a].append((full, [*held, (a, k)]))
            n -= full * k
            if not rooms[room]:
                del rooms[room]
    return [p for ps in rooms.values() for p in ps]


def solve(counts: dict[int, int], size: int) -> list[Pattern]:
    left = {k: v for k, v in counts.items() if v}
    return reduce_instance(left, size) + best_fit(left, size)


def places(patterns: list[Pattern]) -> dict[int, np.ndarray]:
    """For each length, rows (first rank, items in a bin, id of the first bin, offset in a bin), by first rank."""
    found, used, base = defaultdict(list), defaultdict(int), 0
    for n, items in patterns:
        offset = 0
        for a, k in items:
            found[a].append((used[a], k, base, offset))
            used[a] += n * k
            offset += a * k
        base += n
    return {a: np.array(rows, np.int64) for a, rows in found.items()}


_encodings: dict[str, tiktoken.Encoding] = {}


def encoding(path: str) -> tiktoken.Encoding:
    """The byte-level vocabulary of a tokenizers file: its ids are in the order of its merges, as this library needs."""
    if path not in _encodings:
        import json

        with open(path, encoding="utf-8") as f:
            j = json.load(f)
        place = {m: b for b, m in enumerate(byte_symbols())}
        special = {t["content"]: t["id"] for t in j["added_tokens"]}
        ranks = {bytes(place[c] for c in s): i for s, i in j["model"]["vocab"].items() if s not in special}
        _encodings[path] = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
    return _encodings[path]


_tokenizers: dict[str, Tokenizer] = {}


def tokenizer(path: str) -> Tokenizer:
    """The file's tokenizer, once in each Python worker; a task is one thread of a cluster, so it starts none of its own."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _tokenizers:
        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        _tokenizers[path] = t
    return _tokenizers[path]


def token_ids(path: str, texts_: list[str]) -> list[list[int]]:
    """The ids of each text. The faster of two libraries with equal ids breaks down on very long runs of white space
    (its patterns go back over them), so texts with such a run are left to the other."""
    enc, out = encoding(path), []
    special = list(enc._special_tokens)
    for t in texts_:
        if _BLANKS.search(t):
            out.append(tokenizer(path).encode(t, add_special_tokens=False).ids)
        else:
            out.append(enc.encode(t, allowed_special="all") if any(x in t for x in special) else enc.encode_ordinary(t))
    return out


def pieces(docs: DataFrame, path: str, size: int, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and a salt. The first piece of a longer document takes what is over."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, salt long"
    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        for batch in batches:
            for ids, texts_ in portions(batch):
                rows = []
                for i, got in zip(ids, token_ids(path, texts_)):
                    a = np.array([*got, end_id], "<u4")
                    cuts = [0, *range(len(a) % size or size, len(a) + 1, size)]
                    for k, (x, y) in enumerate(zip(cuts, cuts[1:])):
                        crc = zlib.crc32(a[x:y].tobytes())
                        rows.append((i, k, x, y - x, crc, zlib.crc32(f"{i} {k} {crc}".encode())))
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), target)], schema=target)
        trim()

    return texts(docs, id_col, text_col).mapInArrow(run, schema)


def pack(docs: DataFrame, path: str, size: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Every document ends with end_id, so null and empty texts are pieces of length 1. Rows that repeat a doc_id are
    packed one by one. An empty table gives an empty result. Equal pieces are interchangeable, and are numbered in a
    fixed order (doc_id, piece, checksum); so a rerun gives the same packing.
    """
    spark = docs.sparkSession
    made = Stage(spark, "packing").put(pieces(docs, path, size, end_id, id_col, text_col), rows=ROWS)
    counts = {r["length"]: r["count"] for r in made.groupBy("length").count().collect()}  # at most ``size`` rows
    salts = max(16, max(counts.values(), default=0) // RANKED)
    lots = made.withColumn("salt", F.pmod("salt", F.lit(salts)))
    sizes = lots.groupBy("length", "salt").count()
    before = sizes.select("length", "salt", (F.sum("count").over(W.partitionBy("length").orderBy("salt")) - F.col("count")).alias("before"))
    local = F.row_number().over(W.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = lots.withColumn("local", local).join(before, ["length", "salt"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("local") + F.col("before")).alias("rank"))
    table = places(solve(counts, size))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    target = to_arrow_schema(StructType.fromDDL(schema))

    def assign(batches):
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            seq, off = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for a in np.unique(length):
                at, rows = np.flatnonzero(length == a), table[int(a)]
                row = rows[np.searchsorted(rows[:, 0], rank[at], "right") - 1]
                nth = rank[at] - row[:, 0]
                seq[at], off[at] = row[:, 2] + nth // row[:, 1], row[:, 3] + nth % row[:, 1] * a
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(seq), pa.array(off)], schema=target)

    return ranked.mapInArrow(assign, schema)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pack() over documents: null and empty texts are one end id."""
    return pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
