"""N-gram Jaccard join: exact near-duplicate classes of documents by a count-vector R-tree.

1. All shingles are counted over the corpus (exchange.py). A shingle that occurs once is in no intersection: only the
   shared ones of a document go on, and documents with too few of them are done.
2. Documents with equal shingle sets form a class, and classes are joined.
3. Two sets that are similar enough share one of their first n - ceil(t * n) + 1 shingles in any common order (prefix
   principle). The order is rare ones first, so most of a prefix are shingles that occur once, which need no block. A
   block is the classes that share a shingle of their prefixes.
4. In a block, classes are linked to pivots of about their size, those with the fewest shingles of their own: as many
   pairs as rows, however large a group of near copies is. Verified links to a pivot give the classes labels.
5. Blocks that still hold different labels are joined on their count vectors: shared shingles are hashed into groups,
   the group counts of a class are a point, and points are packed into an R-tree. The summed minima of two points (or of
   the upper corners of two boxes) bound the shared shingles, so most pairs of boxes fall at once. First only the
   likeliest partner of each class comes out, which merges most labels at a linear number of pairs; then all that remain.
6. Surviving pairs are verified on the whole sets. Components of all verified links are the result: no link
   between different components is ever skipped, only pairs that are known to be connected already.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Stage, documents, texts
from .components import components
from .exchange import count_bound, shared_elements
from .shingles import shingles

GROUPS = 64
#: Classes with more shared shingles get a finer count vector (4 kB) before they are compared in whole.
FINE = 512
#: Sets that are compared with one other set in one place.
PARTNERS = 512
#: Rows of a block that one task joins; larger blocks are cut into cells, and pairs of cells are joined.
CELL = 4_096
#: Turns in which each class of a block with different labels is compared with the likeliest class of another
#: label, and labels merge. Only then are all pairs of labels that are still apart compared.
BRIDGES = 2
#: At most this many ids are broadcast (8 bytes each).
BROADCAST_IDS = 1_000_000


def _shared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Upper bounds on the shared shingles of sets (or boxes) by the summed minima of their group counts."""
    return np.minimum(x, y).sum(1, dtype=np.int64)


def _needed(a, b, percent: int):
    """Shared shingles that sets of a and b shingles need: 100 * i >= percent * (a + b - i), rounded up."""
    return -(-percent * (a + b) // (100 + percent))


def vector_of(members: np.ndarray, groups: int) -> bytes:
    """The group counts of a set of hashes; groups is a power of two."""
    return np.bincount((members >> np.uint64(65 - groups.bit_length())).astype(np.int64), minlength=groups).astype("<u4").tobytes()


def cells_of(logs: np.ndarray) -> np.ndarray:
    """Parts of a block whose key has one of these logarithmic counts."""
    return -(-count_bound(logs) // CELL)


def tree_pairs(vectors: np.ndarray, n: np.ndarray, percent: int, left: np.ndarray | None = None, fan: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i < j) of points whose summed minima allow the similarity, by an R-tree joined with itself.

    Points are packed by size and then by their most varied coordinates; a box is its upper corner and its smallest
    size. left: marks the points of one side; pairs within a side are left out.
    """
    order = np.lexsort((*[vectors[:, c] for c in np.argsort(vectors.var(0))[-2:]], n // max(1, int(n.max() * 0.1))))
    levels = [(vectors[order], n[order], n[order])]
    while len(levels[-1][0]) > fan:
        v, lo, hi = levels[-1]
        cuts = np.arange(0, len(v), fan)
        levels.append((np.maximum.reduceat(v, cuts), np.minimum.reduceat(lo, cuts), np.maximum.reduceat(hi, cuts)))
    top = len(levels[-1][0])
    i, j = np.triu_indices(top)
    for depth in range(len(levels) - 1, -1, -1):
        v, lo, hi = levels[depth]
        keep = np.zeros(len(i), bool)
        for a in range(0, len(i), 16_384):
            x, y = i[a : a + 16_384], j[a : a + 16_384]
            sizes = (100 * hi[x] >= percent * lo[y]) & (100 * hi[y] >= percent * lo[x])
            keep[a : a + 16_384] = sizes & (_shared(v[x], v[y]) >= _needed(lo[x], lo[y], percent))
        i, j = i[keep], j[keep]
        if depth:
            below, step = len(levels[depth - 1][0]), np.arange(fan)
            ii = np.repeat(i[:, None] * fan + step, fan, axis=1).ravel()
            jj = np.tile(j[:, None] * fan + step, (1, fan)).ravel()
            ok = (ii < below) & (jj < below) & (ii <= jj)
            i, j = ii[ok], jj[ok]
    i, j = order[i[i != j]], order[j[i != j]]
    if left is not None:
        other = left[i] != left[j]
        i, j = i[other], j[other]
    return np.minimum(i, j), np.maximum(i, j)


def _blocks(batches, most: int = 200_000):
    """Batches sorted by (s, cell) -> tables of whole blocks, of some ``most`` rows or one block."""
    held, rows = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        s, cell = batch.column("s").to_numpy(), batch.column("cell").to_numpy()
        last = int(np.flatnonzero(np.r_[True, (s[1:] != s[:-1]) | (cell[1:] != cell[:-1])])[-1])
        if rows + last > most and (last or held and (held[-1].column("s")[-1].as_py(), held[-1].column("cell")[-1].as_py()) != (s[0], cell[0])):
            yield pa.Table.from_batches([*held, batch.slice(0, last)] if last else held)
            held, rows = [], 0
            batch = batch.slice(last)
        held.append(batch)
        rows += batch.num_rows
    if held:
        yield pa.Table.from_batches(held)


def _block_pairs(rows: DataFrame, percent: int, best: bool = False) -> DataFrame:
    """Rows (s, cell, side, doc, n, label, vector) -> distinct pairs (a, b) of documents with different labels that the
    bound lets through; with best, only the one of each document a whose bound is highest."""

    def pairs_of(t):
        s, cell, side, doc, n, label = (t.column(c).to_numpy() for c in ("s", "cell", "side", "doc", "n", "label"))
        v = np.frombuffer(b"".join(x.as_py() for x in t.column("vector")), "<u4").reshape(len(s), -1)
        order = np.lexsort((doc, cell, s))
        new = np.r_[True, (s[order][1:] != s[order][:-1]) | (cell[order][1:] != cell[order][:-1])]
        starts = np.flatnonzero(new)
        sizes = np.diff(np.r_[starts, len(s)])
        found = []

        def keep(x, y):
            ok = (label[x] != label[y]) & (doc[x] != doc[y])
            x, y = x[ok], y[ok]
            if best and len(x):
                at = range(0, len(x), 16_384)
                score = np.concatenate([_shared(v[x[i : i + 16_384]], v[y[i : i + 16_384]]) for i in at]) * 1000 // np.maximum(n[x], n[y])
                one, two, score = np.r_[doc[x], doc[y]], np.r_[doc[y], doc[x]], np.r_[score, score]
                order = np.lexsort((-two, score, one))
                last = order[np.r_[one[order][1:] != one[order][:-1], True]]
                found.append(np.stack([one, two, score], 1)[last])
            elif len(x):
                found.append(np.unique(np.stack([np.minimum(doc[x], doc[y]), np.maximum(doc[x], doc[y])], 1), axis=0))

        for c in np.unique(sizes[(sizes > 1) & (sizes <= 24)]):  # trees of one leaf, those of one size together
            first = starts[sizes == c]
            i, j = np.triu_indices(c, 1)
            step = max(1, 16_384 // len(i))
            for a in range(0, len(first), step):
                x = order[(first[a : a + step, None] + i).ravel()]
                y = order[(first[a : a + step, None] + j).ravel()]
                ok = (label[x] != label[y]) & ((side[x] != side[y]) | (cell[x] < 0))
                ok &= (100 * n[x] >= percent * n[y]) & (100 * n[y] >= percent * n[x])
                x, y = x[ok], y[ok]
                ok = _shared(v[x], v[y]) >= _needed(n[x], n[y], percent)
                keep(x[ok], y[ok])
        for a, c in zip(starts[sizes > 24], sizes[sizes > 24]):
            at = order[a : a + c]
            x, y = tree_pairs(v[at], n[at], percent, side[at] if cell[at[0]] >= 0 else None)
            keep(at[x], at[y])
        pairs = np.unique(np.concatenate(found), axis=0) if found else np.empty((0, 3), np.int64)
        if best and len(pairs):
            pairs = pairs[np.lexsort((-pairs[:, 1], pairs[:, 2], pairs[:, 0]))]
            pairs = pairs[np.r_[pairs[1:, 0] != pairs[:-1, 0], True]]
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, i]) for i in range(3 if best else 2)], names=["a", "b", "score"][: 3 if best else 2])

    def run(batches):
        for t in _blocks(batches):
            yield pairs_of(t)

    dealt = rows.repartition("s", "cell").sortWithinPartitions("s", "cell")
    if not best:
        return dealt.mapInArrow(run, "a long, b long").distinct()
    top = dealt.mapInArrow(run, "a long, b long, score long").groupBy("a").agg(F.max(F.struct("score", (-F.col("b")).alias("minus"))).alias("m"))
    return top.select("a", (-F.col("m.minus")).alias("b"))


def _bounded(pairs: DataFrame, held: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that the summed minima of their vectors let through; pairs without two vectors in held pass."""

    def run(batches):
        for batch in batches:
            known = pa.compute.and_(batch.column("x").is_valid(), batch.column("y").is_valid())
            ok = known.to_numpy(zero_copy_only=False) == False  # noqa: E712
            some = batch.filter(known)
            if some.num_rows:
                n, m = (some.column(c).to_numpy() for c in ("n", "m"))
                x, y = (np.frombuffer(b"".join(v.as_py() for v in some.column(c)), "<u4").reshape(len(n), -1) for c in ("x", "y"))
                fit = (100 * n >= percent * m) & (100 * m >= percent * n)
                ok[~ok] = fit & (_shared(x, y) >= _needed(n, m, percent))
            yield batch.select(["a", "b"]).filter(pa.array(ok))

    one = held.select(F.col("doc_id").alias("a"), "n", F.col("vector").alias("x"))
    two = held.select(F.col("doc_id").alias("b"), F.col("n").alias("m"), F.col("vector").alias("y"))
    return pairs.join(one, "a", "left").join(two, "b", "left").select("a", "b", "n", "m", "x", "y").mapInArrow(run, "a long, b long")


def similar(x: np.ndarray, y: np.ndarray, n: int, m: int, percent: int) -> bool:
    """Whether sets of n and m shingles are similar, by their shared ones (sorted, distinct)."""
    both = np.sort(np.concatenate([x, y]), kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (n + m - common)


def verified(pairs: DataFrame, sets: DataFrame, percent: int, stage: Stage) -> DataFrame:
    """Distinct staged pairs (a, b) of the staged pairs whose sets are similar. sets: doc_id, n, members, fine.

    Fine vectors stop most pairs of large sets before those move. A set moves once for each b it is compared with, and
    waits in no table; a b with many partners is cut into cells of ``PARTNERS``, each with its own copy of b."""
    pairs = stage.put(_bounded(pairs, sets.where("fine is not null").select("doc_id", "n", F.col("fine").alias("vector")), percent))
    sizes = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / PARTNERS).cast("long").alias("cells"))
    one = pairs.join(sizes, "b").select(F.col("a").alias("doc_id"), F.col("b").alias("key"), F.pmod(F.xxhash64("a"), F.col("cells")).alias("cell"), F.lit(1).alias("kind"))
    two = sizes.select(F.col("b").alias("doc_id"), F.col("b").alias("key"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("cells") - 1)).alias("cell"), F.lit(0).alias("kind"))
    moved = sets.select("doc_id", "n", "members").join(one.unionByName(two), "doc_id")

    def run(batches):
        base = None
        for batch in batches:
            a, b = [], []
            for doc, key, kind, n, members in zip(*(batch.column(c) for c in ("doc_id", "key", "kind", "n", "members"))):
                held = np.frombuffer(members.as_buffer(), "<u8"), n.as_py()
                if not kind.as_py():
                    base = held
                elif similar(base[0], held[0], base[1], held[1], percent):
                    a.append(doc.as_py())
                    b.append(key.as_py())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    dealt = moved.select("doc_id", "key", "cell", "kind", "n", "members").repartition("key", "cell").sortWithinPartitions("key", "cell", "kind")
    return stage.put(dealt.mapInArrow(run, "a long, b long").distinct())


def _stars(rows: DataFrame, percent: int) -> DataFrame:
    """Rows (s, salt, doc, n, own) of blocks -> distinct (a, b, keys): each class with the pivots of its blocks.

    A pivot is, of the classes of a part of a block whose sizes are so near that they can be similar, the one with the
    smallest share of shingles of its own; pivots of the parts of a block, and of neighbouring sizes, meet in a second turn."""
    size = F.floor(F.log(F.col("n").cast("double")) / F.lit(max(float(np.log(100 / percent)), 1e-3))).alias("size")
    rows = rows.select("s", "salt", "doc", "n", (F.col("own") / F.col("n")).alias("share"), size)
    first = F.first(F.struct("doc", "share")).over(W.partitionBy("s", "salt", "size").orderBy("share", "doc"))
    stars = rows.select("s", "size", "doc", first.alias("p")).select("s", "size", "doc", F.col("p.doc").alias("pivot"), "p.share")
    heads = stars.select("s", "size", F.col("pivot").alias("doc"), "share").distinct()
    head = F.first("doc").over(W.partitionBy("s", "size").orderBy("share", "doc"))
    again = heads.select("s", "size", "doc", head.alias("pivot"))
    below = F.struct(F.lag("pivot").over(W.partitionBy("s").orderBy("size", "pivot")).alias("pivot"), F.lag("size").over(W.partitionBy("s").orderBy("size", "pivot")).alias("size"))
    steps = again.select("s", "size", "pivot").distinct().withColumn("below", below).where("below.size = size - 1").select("s", F.col("pivot").alias("doc"), F.col("below.pivot").alias("pivot"))
    every = stars.select("s", "doc", "pivot").unionByName(again.select("s", "doc", "pivot")).unionByName(steps).where("doc <> pivot")
    return every.distinct().groupBy(F.col("doc").alias("a"), F.col("pivot").alias("b")).agg(F.count(F.lit(1)).alias("keys"))


def block_links(reps: DataFrame, percent: int, stage: Stage) -> DataFrame:
    """Verified links (a, b) between staged sets (doc_id, n, held: shared shingles, members, prefix: keys, cells: parts
    of each key's block, vector, fine) that share a key: steps 4 to 6. Every similar pair is linked or already connected."""
    keys = F.explode(F.arrays_zip("prefix", "cells")).alias("key")
    rows = reps.select(keys, F.col("doc_id").alias("doc"), "n", (F.col("n") - F.col("held")).alias("own"))
    rows = rows.select(F.col("key.prefix").alias("s"), F.pmod(F.xxhash64("doc"), F.col("key.cells")).alias("salt"), "doc", "n", "own")
    several = rows.groupBy("s").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("s")
    rows = stage.put(rows.join(several, "s", "left_semi"))
    stars = stage.put(_stars(rows, percent))
    near = stage.put(_bounded(stars.select("a", "b"), reps, percent))
    # The pivot that a class shares most keys with comes first; the others only where that leaves labels apart.
    best = near.join(stars, ["a", "b"]).groupBy("a").agg(F.max(F.struct("keys", (-F.col("b")).alias("minus"))).alias("m")).select("a", (-F.col("m.minus")).alias("b"))
    best = stage.put(best)
    links = verified(best, reps, percent, stage)
    named_a = links.select(F.col("a"), F.least("a", "b").alias("la")).groupBy("a").agg(F.min("la").alias("la"))
    named_b = named_a.select(F.col("a").alias("b"), F.col("la").alias("lb"))
    rest = near.join(best, ["a", "b"], "left_anti").join(named_a, "a", "left").join(named_b, "b", "left")
    rest = stage.put(rest.where(F.least("a", F.coalesce("la", "a")) != F.least("b", F.coalesce("lb", "b"))).select("a", "b"))
    links = links.unionByName(verified(rest, reps, percent, stage))
    pair_of = lambda t: t.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    tried, found = pair_of(near), None
    for turn in range(BRIDGES + 1):
        if found is None or not found.isEmpty():  # labels have changed
            label = components(links).select(F.col("node").alias("doc"), F.col("component").alias("to"))
            open_ = stage.put(_open(rows, stage.put(label), reps))
            if open_.isEmpty():
                break
        pairs = pair_of(_block_pairs(open_, percent, turn < BRIDGES)).distinct()
        pairs = stage.put(pairs.join(tried, ["a", "b"], "left_anti"))
        found = verified(pairs, reps, percent, stage)
        links, tried = links.unionByName(found), tried.unionByName(pairs)
    stage.drop(stars, best, rest)
    return links


def _open(rows: DataFrame, label: DataFrame, reps: DataFrame) -> DataFrame:
    """Rows (s, doc, n) of blocks that hold different labels -> s, cell, side, doc, n, label, vector. label: doc, to."""
    named = rows.join(label, "doc", "left").select("s", "doc", "n", F.least("doc", F.coalesce("to", "doc")).alias("label"))
    mixed = named.groupBy("s").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count(F.lit(1)).alias("rows")).where("x <> y").select("s", F.ceil(F.col("rows") / CELL).alias("cells"))
    open_ = named.join(mixed, "s").withColumn("part", F.pmod(F.xxhash64("doc", F.lit(1)), F.col("cells")))
    open_ = open_.join(reps.select(F.col("doc_id").alias("doc"), "vector"), "doc")
    # Whole small blocks; of a cut block, every pair of parts. Cells below 0 are joined with themselves.
    whole = open_.where("cells = 1").select("s", F.lit(-1).cast("long").alias("cell"), F.lit(0).cast("long").alias("side"), "doc", "n", "label", "vector")
    pair = F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("cells") - 1), lambda q: F.struct(F.when(F.col("part") == q, -1 - q).otherwise(F.least("part", q) * F.col("cells") + F.greatest("part", q)).alias("cell"), F.when(F.col("part") <= q, 0).otherwise(1).cast("long").alias("side"))))
    split = open_.where("cells > 1").withColumn("p", pair).select("s", "p.cell", "p.side", "doc", "n", "label", "vector")
    return whole.unionByName(split)


def _counted(docs: DataFrame, k: int, percent: int, stage: Stage) -> DataFrame:
    """Staged row for each row of docs: doc_id, n, same (id of the set), least (smallest doc_id of that set in its
    portion). The first row of a set in its portion also has held, members, prefix, cells, vector and, where large, fine;
    these are null where too few of its shingles are shared."""

    def describe(ids, texts_):
        seen, values, n, same, first = {}, [], [], [], []
        for i, t in enumerate(texts_):
            s = shingles(t, k)
            name = blake2b(s.tobytes(), digest_size=16).digest()
            at = seen.setdefault(name, i) if len(s) else i
            values.append(s if at == i else s[:0])
            n.append(len(s))
            same.append(name)
            first.append(at)
        owners = np.repeat(np.arange(len(ids), dtype=np.uint32), [len(v) for v in values])
        known = np.array([i is not None for i in ids])
        return np.concatenate(values), owners, {"id": np.array([i or 0 for i in ids], np.int64), "known": known.astype(np.uint8), "n": np.array(n, np.int64), "same": np.frombuffer(b"".join(same), np.uint8), "first": np.array(first, np.int64)}

    def assemble(kept, values, owners, logs):
        ids, n, first = kept["id"], kept["n"], kept["first"]
        least = np.full(len(ids), np.iinfo(np.int64).max)
        some = kept["known"] > 0
        np.minimum.at(least, first[some], ids[some])
        order = np.lexsort((values, logs, owners))
        values, logs, held = values[order], logs[order], np.bincount(owners, minlength=len(ids))
        at = np.r_[0, np.cumsum(held)]
        fit = (n > 0) & (100 * held >= percent * n)
        out = [[], [], [], [], []]
        for i in range(len(ids)):
            row = [None] * 5
            if fit[i]:
                v, c = values[at[i] : at[i + 1]], logs[at[i] : at[i + 1]]
                p = int(n[i] - -(-percent * n[i] // 100) + 1 - (n[i] - held[i]))
                v_sorted = np.sort(v)
                row = [v_sorted.tobytes(), v[:p].view(np.int64), cells_of(c[:p]), vector_of(v, GROUPS), vector_of(v, 1024) if len(v) >= FINE else None]
            for column, x in zip(out, row):
                column.append(x)
        same = [bytes(x) if m else None for x, m in zip(kept["same"].reshape(-1, 16), n)]
        kinds = [pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary()]
        columns = [pa.array(ids, mask=~some), pa.array(n), pa.array(same, pa.binary()), pa.array(least[first], mask=least[first] == np.iinfo(np.int64).max), pa.array(held, pa.int64(), mask=~fit), *(pa.array(c, t) for c, t in zip(out, kinds))]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "same", "least", "held", "members", "prefix", "cells", "vector", "fine"])

    return shared_elements(docs, describe, assemble, "doc_id long, n long, same binary, least long, held long, members binary, prefix array<long>, cells array<long>, vector binary, fine binary", stage)


def jaccard_classes(docs: DataFrame, k: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id (smallest doc_id reachable by links).

    Two documents link when 100 * |intersection| >= percent * |union| of their sets of k-word shingles. Null and
    empty texts have no shingles and link with nothing. Rows are joined by their texts, whatever their doc_id: rows that
    repeat a doc_id are answered one by one, with the same text or another, and rows with a null doc_id link too; a
    component_id is null only where no reachable row has a doc_id. An empty table gives an empty result.
    """
    stage = Stage(docs.sparkSession, "jaccard")
    made = _counted(texts(docs, id_col, text_col), k, percent, stage)
    whole = ["n", "held", "members", "prefix", "cells", "vector", "fine"]
    classes = made.where("members is not null").groupBy("same").agg(F.min("least").alias("least"), *(F.first(c, True).alias(c) for c in whole))
    classes = stage.put(classes.withColumn("doc_id", F.monotonically_increasing_id()))
    links = block_links(classes.select("doc_id", *whole), percent, stage)
    found = components(links).select(F.col("node").alias("doc_id"), "component")
    named = stage.put(classes.select("doc_id", "same", "least").join(found, "doc_id", "left").select("same", "least", F.coalesce("component", "doc_id").alias("c")))
    low = named.groupBy("c").agg(F.min("least").alias("component_id"))
    own = stage.put(named.join(low, "c").select("same", "component_id"))
    out = made.select("doc_id", "n", "same", "least").join(own, "same", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("component_id", "least")).otherwise(F.col("doc_id")).alias("component_id"))


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """jaccard_classes() over documents: sets of four-word shingles, 85 percent."""
    return jaccard_classes(documents(spark, sf_dir))
