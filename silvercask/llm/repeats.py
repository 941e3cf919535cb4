"""Substring dedup by the common-prefix interval tree of an enhanced suffix array.

A byte goes if a string of ``width`` bytes that also starts in a document with a smaller id covers it.

1. Of each window of ``width`` bytes, the least of its k-gram hashes names an anchor; equal windows have equal
   anchors. Windows with the same anchor lie side by side, and their union is the anchor's context.
2. Of equal contexts only the one in the smallest document goes on, in a batch of documents first and then in all;
   in the others all of it is removed. Anchors whose k-gram occurs in one document only are left behind, in a pass
   over the sorted hashes that holds the rows of one document.
3. For the contexts that go on, the bytes are fetched from the documents.
4. The distinct contexts of an anchor meet in one task. Their suffixes are sorted, neighbours' common prefixes
   (LCP) computed, and a stack scan over them gives the intervals of the tree: every repeat with all its places.
   Those that are preceded by different bytes are maximal repeats. Each place of a maximal repeat that
   starts in a smaller document as well is removed.
5. An anchor with more than ``CROWD`` contexts is dealt by window instead, with the same result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .arrow import BYTES, portions, trim
from .common import Stage, documents, texts
from .shingles import mixed

K = 24
#: Windows that are worked on at a time in one text.
STRIDE = 1 << 20
#: Contexts (32 bytes each) that are held to settle those that repeat, and rows that go out to Spark at a time.
HELD, SENT = 1 << 21, 1 << 16
#: Distinct contexts of an anchor that one task sorts.
CROWD = 20_000
#: Ids (8 bytes each) and bytes of spans that are broadcast at most.
BROADCAST_IDS, BROADCAST_BYTES = 1_000_000, 32 << 20

#: Where ids repeat with different texts: bits of a key for the texts of an id, and for the ids of a sorted partition.
VARIANT_BITS, PLACE_BITS = 22, 27

_P = np.uint64(0x9E3779B97F4A7C15)


def gram_hashes(b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every K-gram, by doubling."""
    with np.errstate(over="ignore"):
        h, p, size, parts = b.astype(np.uint64) + np.uint64(1), _P, 1, {}
        while size <= K:
            parts[size] = (h, p)
            h, p, size = h[: len(h) - size] * p + h[size:], p * p, size * 2
        out, done = None, 0
        for size in sorted((s for s in parts if K & s), reverse=True):
            h, p = parts[size]
            h = h[done : done + len(b) - K + 1]
            out, done = (h if out is None else out * p + h), done + size
        return mixed(out)


def _least(v: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w neighbours."""
    size, m = 1, v
    while size * 2 <= w:
        m, size = np.minimum(m[:-size], m[size:]), size * 2
    return np.minimum(m[: len(v) - w + 1], m[w - size :]) if size < w else m


def anchors(data: bytes, width: int) -> tuple[np.ndarray, ...]:
    """For each anchor of a text: hash of its k-gram, hash of its context, start, anchor - start, length of the context."""
    found = []
    for at in range(0, len(data) - width + 1, STRIDE):
        b = np.frombuffer(data, np.uint8, min(len(data) - at, STRIDE + width - 1), at)
        h = gram_hashes(b)
        rank = (h >> np.uint64(32) << np.uint64(32)) | np.arange(len(h), dtype=np.uint64)  # ties: the leftmost
        p = (_least(rank, width - K + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.r_[True, p[1:] != p[:-1]])
        p, stop = p[first], np.r_[first[1:], len(p)] + width - 1
        e = np.zeros(len(p), np.uint64)
        with np.errstate(over="ignore"):
            for x in (first, first + K, np.maximum(stop - 2 * K, first), stop - K):  # these cover the context
                e = mixed(e * _P + h[np.minimum(x, stop - K)])
            e = mixed(e + ((p - first) << 8 | (stop - first)).astype(np.uint64))
        found.append((h[p].view(np.int64), e.view(np.int64), first + at, p - first, stop - first))
    return tuple(np.concatenate(c) for c in zip(*found)) if found else (np.empty(0, np.int64),) * 5


def _repeated(h: np.ndarray, e: np.ndarray, doc: np.ndarray, shift: int) -> np.ndarray:
    """Of each context, True but for the rows of the smallest document."""
    order = np.argsort(h)
    same = h[order[1:]] == h[order[:-1]]
    some = order[np.r_[same, False] | np.r_[False, same]] if len(h) else order  # rows of one h
    del order, same
    some = some[np.lexsort((doc[some], e[some], h[some]))]
    again = np.zeros(len(h), bool)
    if len(some):
        new = np.r_[True, (h[some[1:]] != h[some[:-1]]) | (e[some[1:]] != e[some[:-1]])]
        first = some[np.maximum.accumulate(np.where(new, np.arange(len(some)), 0))]
        again[some] = (doc[some] >> shift) > (doc[first] >> shift)
    return again


def _anchor_rows(docs: DataFrame, width: int, shift: int) -> DataFrame:
    """(h, e, doc, place); place packs start, anchor - start and length. Documents are compared without their ``shift`` low bits.

    Contexts that repeat among ``HELD`` of a task are settled here: all but the one in the smallest document come out
    with e null and a random h, as spans to remove. So a context of very many documents costs a row a task, or a row for
    each ``HELD`` contexts. Of the texts, only the anchors are held.
    """
    schema = "h long, e long, doc long, place long"

    def settled(held):
        h, e, doc, place = (np.concatenate([rows.pop(0) for _ in range(len(rows))]) for rows in held)
        again = _repeated(h, e, doc, shift)
        h[again] = mixed(doc[again].view(np.uint64) ^ h[again].view(np.uint64)).view(np.int64)
        for x in range(0, len(h), SENT):
            y = x + SENT
            yield pa.RecordBatch.from_arrays([pa.array(h[x:y]), pa.array(e[x:y], mask=again[x:y]), pa.array(doc[x:y]), pa.array(place[x:y])], names=["h", "e", "doc", "place"])

    def run(batches):
        held, n = ([], [], [], []), 0
        for batch in batches:
            for ids, texts_ in portions(batch):
                rows = [anchors(t.encode(), width) for t in texts_]
                doc = np.repeat(np.array(ids, np.int64), [len(r[0]) for r in rows])
                h, e, start, off, size = (np.concatenate(c) for c in zip(*rows))
                for column, x in zip(held, (h, e, doc, start << 16 | off << 8 | size)):
                    column.append(x)
                n += len(h)
                if n >= HELD:
                    yield from settled(held)
                    n = 0
        if n:
            yield from settled(held)
        trim()

    return docs.mapInArrow(run, schema)


def _shared(rows: DataFrame) -> DataFrame:
    """Rows whose h occurs in two documents, and those with e null.

    The rows of an h come one after the other (sorted by Spark, which spills); only those of the first document of an
    h are held back, until another document shows up.
    """

    def run(batches):
        held, held_h, is_open = None, None, False  # rows of held_h so far, all of one document; or it is known as shared
        for batch in batches:
            settled = batch.column("e").is_null()
            yield batch.filter(settled)
            live = pa.Table.from_batches([batch.filter(pa.compute.invert(settled))])
            if not live.num_rows:
                continue
            if held is not None:
                live, held = pa.concat_tables([held, live]), None
            h, doc = live.column("h").to_numpy(), live.column("doc").to_numpy()
            first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            size = np.diff(np.r_[first, len(h)])
            many = np.minimum.reduceat(doc, first) < np.maximum.reduceat(doc, first)
            many[0] |= is_open and h[0] == held_h
            is_open, held_h = bool(many[-1]), h[-1]
            keep = np.repeat(many, size)
            if not is_open:
                held = live.slice(int(first[-1]))
            yield from live.filter(pa.array(keep)).combine_chunks().to_batches()
        trim()

    return rows.repartition("h").sortWithinPartitions("h").mapInArrow(run, "h long, e long, doc long, place long")


def intervals(suffixes: np.ndarray, lengths: np.ndarray, before: np.ndarray, docs: np.ndarray, low: int, apart: np.ndarray):
    """Maximal repeats of at least ``low`` bytes of sorted, zero-padded suffixes, by a stack scan of their LCP.

    apart: where suffixes of another anchor begin. before: the byte in front of a suffix, -1 where it is not known. Yields (length, first, after last, smallest
    document) of every interval of the tree whose members are preceded by different bytes or by an unknown one.
    """
    n = len(suffixes)
    if n < 2:
        return
    lcp = np.zeros(n + 1, np.int64)
    for a in range(0, n - 1, 65_536):
        x, y = suffixes[a : a + 65_536], suffixes[a + 1 : a + 65_537]
        differ = x[: len(y)] != y
        same = np.where(differ.any(1), differ.argmax(1), suffixes.shape[1])
        lcp[a + 1 : a + 1 + len(y)] = np.minimum(same, np.minimum(lengths[a : a + len(y)], lengths[a + 1 : a + 1 + len(y)]))
    lcp[:-1][apart] = 0
    change = np.r_[0, np.cumsum(before[1:] != before[:-1])]  # members of one left byte have one value
    unknown = np.r_[0, np.cumsum(before < 0)]
    deep = np.flatnonzero(lcp >= low)  # runs of neighbours that share enough; a run is a subtree of its own
    for run in np.split(deep, np.flatnonzero(np.diff(deep) > 1) + 1) if len(deep) else ():
        stack: list[list[int]] = []  # [length, first, smallest document so far]
        for i in [*run.tolist(), int(run[-1]) + 1]:
            here = int(lcp[i]) if lcp[i] >= low else 0
            first, least = i - 1, int(docs[i - 1])
            while stack and stack[-1][0] > here:
                length, first, least = stack.pop()
                if change[i - 1] > change[first] or unknown[i] > unknown[first]:
                    yield length, first, i, least
                if stack and stack[-1][0] >= here:
                    stack[-1][2] = min(stack[-1][2], least)
            if here:
                if not stack or stack[-1][0] < here:
                    stack.append([here, first, least])
                stack[-1][2] = min(stack[-1][2], int(docs[i]))


def context_spans(h: np.ndarray, doc: np.ndarray, contexts: list[bytes], width: int) -> list[list[tuple[int, int]]]:
    """For each context, the spans of it that maximal repeats with a smaller document cover."""
    sizes = np.array([len(c) for c in contexts], np.int64)
    top = int(sizes.max())
    text = np.zeros((len(contexts), top), np.uint8)
    text[np.arange(top) < sizes[:, None]] = np.frombuffer(b"".join(contexts), np.uint8)
    windows = sizes - width + 1
    row = np.repeat(np.arange(len(contexts)), windows)
    start = np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows)
    out: list[list[tuple[int, int]]] = [[] for _ in contexts]
    group = np.searchsorted(np.unique(h), h)
    ends = np.r_[0, np.cumsum(windows)]
    for a, b in _portions(group, windows):  # whole anchors, some 100 000 suffixes at a time
        r, s = row[ends[a] : ends[b]], start[ends[a] : ends[b]]
        suffix = np.pad(text[a:b], ((0, 0), (0, top)))[(r - a)[:, None], s[:, None] + np.arange(top)]
        key = np.concatenate([np.ascontiguousarray(group[r].astype(">u4")).view(np.uint8).reshape(-1, 4), suffix], axis=1)
        order = _sorted_rows(key)
        r, s, suffix = r[order], s[order], suffix[order]
        g = group[r]
        before = np.where(s > 0, text[r, np.maximum(s - 1, 0)].astype(np.int64), -1)
        lens = sizes[r] - s
        for length, x, y, least in intervals(suffix, lens, before, doc[r], width, np.r_[True, g[1:] != g[:-1]]):
            for q in range(x, y):
                if doc[r[q]] > least:
                    out[r[q]].append((int(s[q]), int(s[q]) + length))
    return out


def _sorted_rows(key: np.ndarray) -> np.ndarray:
    """The lexicographic order of rows of bytes, sorted 8 bytes at a time."""
    pad = -key.shape[1] % 8
    words = np.ascontiguousarray(np.pad(key, ((0, 0), (0, pad)))).view(">u8")
    return np.lexsort([words[:, i] for i in range(words.shape[1] - 1, -1, -1)])


def _portions(group: np.ndarray, windows: np.ndarray, most: int = 100_000):
    """Ranges of rows with whole groups; group is sorted."""
    ends = np.r_[np.flatnonzero(group[1:] != group[:-1]) + 1, len(group)]
    total = np.r_[0, np.cumsum(windows)]
    a = b = 0
    for e in ends.tolist():
        if b > a and total[e] - total[a] > most:
            yield a, b
            a = b
        b = e
    yield a, b


def _merged(spans: np.ndarray) -> np.ndarray:
    """Sorted, disjoint, not touching."""
    spans = spans[np.lexsort((spans[:, 1], spans[:, 0]))]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.r_[True, spans[1:, 0] > reach[:-1]]
    last = np.r_[np.flatnonzero(new)[1:] - 1, len(spans) - 1]
    return np.stack([spans[new, 0], reach[last]], axis=1)


def repeat_spans(docs: DataFrame, width: int, stage: Stage, shift: int = 0) -> DataFrame:
    """(doc, spans binary of int64 pairs): what is to be removed from each document that has something to remove. Of two
    documents that differ in their ``shift`` low bits only, none is smaller."""
    smaller = F.shiftright("least", shift) < F.shiftright("doc", shift)
    seen = stage.put(_shared(_anchor_rows(docs, width, shift)), size=BYTES)
    least = stage.put(seen.where("e is not null").groupBy("h", "e").agg(F.min("doc").alias("least")))
    marked = seen.where("e is not null").join(least, ["h", "e"])
    start, size = F.shiftright("place", 16), F.col("place").bitwiseAND(F.lit(255))
    inner = stage.put(seen.where("e is null").unionByName(marked.where(smaller).drop("least")).select("doc", start.alias("a"), (start + size).alias("b")))
    many = stage.put(least.groupBy("h").agg(F.count(F.lit(1)).alias("contexts")).where("contexts > 1"))
    first = marked.where(~smaller).join(many, "h").select("doc", F.struct("h", "place", "contexts").alias("r"))
    asked = stage.put(first.groupBy("doc").agg(F.collect_list("r").alias("rs")))  # a document's own anchors
    few = asked.count() <= BROADCAST_IDS
    holders = docs.join(F.broadcast(asked.select(F.col("doc").alias("doc_id"))), "doc_id", "left_semi") if few else docs
    joined = holders.join(asked, holders["doc_id"] == asked["doc"]).select("doc_id", "text", "rs")

    def cut(batches):
        for batch in batches:
            for i, t, rs in zip(*batch.columns):
                data, rs = t.as_py().encode(), rs.as_py()
                h = [r["h"] for r in rs]
                at = [r["place"] >> 16 for r in rs]
                text = [data[r["place"] >> 16 : (r["place"] >> 16) + (r["place"] & 255)] for r in rs]
                yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array([i.as_py()] * len(h), pa.int64()), pa.array(at, pa.int64()), pa.array(text, pa.binary()), pa.array([r["contexts"] for r in rs], pa.int64())], names=["h", "doc", "at", "context", "contexts"])
        trim()

    contexts = stage.put(joined.mapInArrow(cut, "h long, doc long, at long, context binary, contexts long"), size=BYTES)
    stage.drop(seen, least, many, asked)

    def scan(batches):
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        t = pa.Table.from_batches(parts).sort_by([("h", "ascending")])
        del parts
        h, doc, at = (t.column(c).to_numpy() for c in ("h", "doc", "at"))
        text = t.column("context")
        for x, y in _portions(h, pa.compute.binary_length(text).to_numpy() - width + 1):
            found = context_spans(h[x:y], doc[x:y] >> shift, text[x:y].to_pylist(), width)
            n = [len(f) for f in found]
            flat = np.array([x for f in found for x in f], np.int64).reshape(-1, 2) + np.repeat(at[x:y], n)[:, None]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(doc[x:y], n)), pa.array(flat[:, 0]), pa.array(flat[:, 1])], names=["doc", "a", "b"])
        trim()

    outer = contexts.where(F.col("contexts") <= CROWD).repartition("h").mapInArrow(scan, "doc long, a long, b long")
    crowd = contexts.where(F.col("contexts") > CROWD)
    windows = crowd.select("doc", "at", "context", F.explode(F.sequence(F.lit(1), F.length("context") - width + 1)).alias("i"))
    windows = windows.select("doc", (F.col("at") + F.col("i") - 1).alias("a"), F.expr(f"substring(context, i, {width})").alias("w"))
    smallest = windows.groupBy("w").agg(F.min("doc").alias("least"))
    crowded = windows.join(smallest, "w").where(smaller).select("doc", "a", (F.col("a") + width).alias("b"))
    every = inner.unionByName(outer).unionByName(crowded).groupBy("doc").agg(F.collect_list(F.struct("a", "b")).alias("s"))

    def merge(batches):
        for batch in batches:
            lists = batch.column("s")
            flat = np.stack([lists.values.field(k).to_numpy() for k in (0, 1)], axis=1)
            offs = lists.offsets.to_numpy()
            got = [_merged(flat[x:y]).tobytes() for x, y in zip(offs, offs[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(got, pa.binary())], names=["doc", "spans"])
        trim()

    out = stage.put(every.mapInArrow(merge, "doc long, spans binary"))
    return out


def _keys(docs: DataFrame, stage: Stage) -> DataFrame:
    """(id, hash, key) for the distinct texts of each id: keys are in the order of the ids, and differ for the texts of
    one id in their low bits only."""
    each = docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash")).distinct()
    texts_ = stage.put(each.withColumn("variant", F.row_number().over(W.partitionBy("id").orderBy("hash")) - 1))
    ordered = stage.put(texts_.select("id").distinct().orderBy("id").withColumn("place", F.monotonically_increasing_id()))
    low, task = F.col("place").bitwiseAND(F.lit((1 << 33) - 1)), F.shiftright("place", 33)
    most = ordered.agg(F.max(low).alias("low"), F.max(task).alias("task")).first()
    if most.low >= 1 << PLACE_BITS or most.task >= 1 << (63 - PLACE_BITS - VARIANT_BITS) or (texts_.agg(F.max("variant")).first()[0] or 0) >= 1 << VARIANT_BITS:
        raise ValueError("too many ids in one sorted partition, or texts of one id")
    rank = F.shiftleft(F.shiftleft(task, PLACE_BITS) + low, VARIANT_BITS)
    return texts_.join(ordered.select("id", rank.alias("rank")), "id").select("id", "hash", (F.col("rank") + F.col("variant")).alias("key"))


def remove_repeats(docs: DataFrame, width: int = 50, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, kept text (bytes), spans; as digest: n_bytes, n_removed, n_spans, kept_sha256.

    Null text counts as empty. Texts shorter than ``width`` bytes keep everything. Rows that repeat a doc_id, with the
    same text or another, are answered one by one; a string in two rows of one id does not count as a repeat. Rows
    with a null doc_id keep everything. Kept bytes need not be valid UTF-8, since spans are spans of bytes. An empty
    table gives an empty result. Digests are staged, so that few texts at a time are in Python whoever writes them.
    """
    spark, stage = docs.sparkSession, Stage(docs.sparkSession, "repeats")
    base = texts(docs, id_col, text_col)
    known, shift = base.where("doc_id is not null"), 0
    several = known.groupBy("doc_id").agg((F.min(F.xxhash64("text")) != F.max(F.xxhash64("text"))).alias("several"))
    if several.where("several").isEmpty():
        base = base.withColumn("key", F.col("doc_id"))
    else:
        keys, shift = _keys(known, stage), VARIANT_BITS
        base = base.join(keys, (F.col("doc_id") == F.col("id")) & (F.xxhash64("text") == F.col("hash")), "left").select("doc_id", "text", "key")
    spans = repeat_spans(base.where("key is not null").select(F.col("key").alias("doc_id"), "text"), width, stage, shift)
    size = spans.agg(F.sum(F.length("spans") + 16)).first()[0] or 0
    joined = base.join(F.broadcast(spans) if size <= BROADCAST_BYTES else spans, base["key"] == spans["doc"], "left").select("doc_id", "text", "spans")

    def cut(batches):
        for batch in batches:
            rows = []
            for i, t, s in zip(*batch.columns):
                data, found = t.as_py().encode(), np.frombuffer(s.as_py() or b"", np.int64).reshape(-1, 2).tolist()
                ends = [0, *(x for f in found for x in f), len(data)]
                kept = b"".join(data[a:b] for a, b in zip(ends[::2], ends[1::2]))
                rows.append((i.as_py(), len(data), len(data) - len(kept), len(found), hashlib.sha256(kept).hexdigest()) if digest else (i.as_py(), kept, found))
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] if digest else ["doc_id", "kept", "spans"]
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()] if digest else [pa.int64(), pa.binary(), pa.list_(pa.list_(pa.int64()))]
            columns = list(zip(*rows)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)
        trim()

    if not digest:
        return joined.mapInArrow(cut, "doc_id long, kept binary, spans array<array<long>>")
    out = stage.put(joined.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"), size=BYTES)
    stage.drop(spans)
    return out


def op1_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """remove_repeats() over documents, as digests; what it says of nulls, short texts and repeated rows holds."""
    return remove_repeats(documents(spark, sf_dir), digest=True)
