"""Substring dedup by MinHash banding of paragraphs and of the passages within them.

A paragraph is a line; a line of more than ``long`` words is cut where its words say so, after the end of a
sentence whose last word's hash is even. So that what stands inside a line is found wherever it stands, every paragraph
is also cut into passages: after every sentence, and sentences of more than ``WIDE`` words (texts without sentence
ends too) at words that their neighbourhood chooses. Paragraphs and passages are units, all compared with all.

The five-word shingles of all texts are counted over the corpus (exchange.py). A shingle that stands in one place only is
in no intersection, so a unit of which more than a fifth stand in one place only is like no other, and most units are.
Of the rest, units with equal sets are one class. Classes of more than ``SMALL`` shingles get a MinHash signature in
``bands`` bands of ``rows`` values: at a similarity of 0.8 a pair shares a band with a probability of at least
1 - (1 - 0.8 ** 3) ** 8 = 0.997 (the signature is of the shared shingles, which are more similar than the whole sets);
smaller ones collide by their first shingles, always. Units that collide are joined as in the n-gram join (pivots
first, then the rest of a bucket by bounds; no bucket is emitted as all its pairs), their exact Jaccard similarity is
verified, and components of the links decide: the unit with the smallest (document, place) stays, the others go. Where
that is a passage of a paragraph that goes for another component, the component's first paragraph stays, or else its
first passage in a paragraph that stays; a paragraph that stays keeps the passages of its own component.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stage, documents, texts
from .components import components
from .exchange import shared_elements
from .ngram_join import block_links, cells_of, vector_of
from .shingles import _LOWER, _ODD, _hashes, mixed

GROUPS = 16
#: Words of a passage at least; at most WIDE. A passage of 50 words or more then holds whole ones.
LEAST = 5
WIDE = 24
#: Sets of at most so many shingles collide by their first ones, which loses nothing; larger ones by bands.
SMALL = 20
#: A word begins a window if no word this near has a smaller hash.
NEAR = 5
_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True
_END = np.zeros(256, bool)
_END[list(b".!?")] = True


class Words(NamedTuple):
    """The words of some texts, one after the other: hash, text, place in the text's bytes, and whether a paragraph or a
    passage begins with it."""

    h: np.ndarray
    text: np.ndarray
    start: np.ndarray
    paragraph: np.ndarray
    passage: np.ndarray


def _runs(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and sizes of the runs that begin where first is set."""
    at = np.flatnonzero(first)
    return at, np.diff(np.append(at, len(first)))


def segmented(texts_: list[bytes], long: int) -> Words:
    """Sentences of under LEAST words go with the one before; what is longer than WIDE words is cut into windows."""
    data = b"\n".join(texts_)
    raw = np.frombuffer(data, np.uint8)
    blank = _BLANK[raw]
    start = np.flatnonzero(~blank & np.r_[True, blank[:-1]])
    if not len(start):
        none = np.empty(0, np.int64)
        return Words(none.astype(np.uint64), none, none, none.astype(bool), none.astype(bool))
    last = raw[np.flatnonzero(~blank & np.r_[blank[1:], True])]
    w = data.translate(_LOWER).split()
    h = np.fromiter(map(_hashes.__getitem__, w), np.uint64, len(w))
    ends = np.cumsum([len(t) + 1 for t in texts_])
    text = np.searchsorted(ends, start, "right")
    line = np.searchsorted(np.flatnonzero(raw == 10), start)
    stop = np.r_[False, _END[last][:-1]]  # a sentence ends before this word
    fresh = np.r_[True, line[1:] != line[:-1]]
    _, size = _runs(fresh)
    even = np.r_[False, (h[:-1] & np.uint64(1)) == 0]
    paragraph = fresh | (stop & even & np.repeat(size > long, size))
    passage = paragraph | stop
    at, size = _runs(passage)
    passage[at[(size < LEAST) & ~paragraph[at]]] = False
    at, size = _runs(passage)
    wide = np.repeat(size > WIDE, size)
    if wide.any():
        _cut_windows(h, passage, np.flatnonzero(wide))
    return Words(h, text, start - np.r_[0, ends[:-1]][text], paragraph, passage)


def _cut_windows(h: np.ndarray, passage: np.ndarray, some: np.ndarray) -> None:
    """Passages of the words ``some`` are cut before words whose pair with the next has the smallest hash among NEAR
    words to each side, and, where these are further apart than WIDE words, WIDE words after the last cut."""
    at, size = _runs(passage[some])
    own, place = np.repeat(np.arange(len(at)), size), np.arange(len(some)) - np.repeat(at, size)
    left = np.repeat(size, size) - place
    x = h[some]
    with np.errstate(over="ignore"):
        x = mixed(x * _ODD[0] + np.where(left > 1, np.append(x[1:], np.uint64(0)), np.uint64(0)) * _ODD[1])
    least = (place >= LEAST) & (left >= LEAST)
    for d in range(1, NEAR + 1):
        same = own[d:] == own[:-d]
        least[d:] &= ~same | (x[d:] < x[:-d])
        least[:-d] &= ~same | (x[:-d] <= x[d:])
    passage[some[least]] = True
    at, size = _runs(passage[some])
    for a, n in zip(at[size > WIDE].tolist(), size[size > WIDE].tolist()):
        cuts = np.minimum(np.arange(WIDE, n, WIDE), n - LEAST)
        passage[some[a + cuts]] = True


def _cut(text: str, long: int, kind: str) -> list[str]:
    data = text.encode()
    w = segmented([data], long)
    at = [0, *w.start[getattr(w, kind)][1:].tolist(), len(data)]
    return [data[a:b].decode() for a, b in zip(at, at[1:]) if a < b]


def paragraphs(text: str, long: int = 60) -> list[str]:
    """The text in paragraphs, which together are the text; blanks go with the word before, or else after."""
    return _cut(text, long, "paragraph")


def passages(paragraph: str) -> list[str]:
    """A paragraph in passages, which together are the paragraph."""
    return _cut(paragraph, len(paragraph) + 1, "passage")


def _units(w: Words, k: int, least: int) -> tuple[np.ndarray, ...]:
    """For the paragraphs and, where there are several, the passages of each, with at least ``least`` (passages LEAST)
    words: text, place, part (-1: the paragraph), first word, words."""
    at, size = _runs(w.paragraph)
    text = w.text[at]
    _, each = _runs(np.r_[True, text[1:] != text[:-1]]) if len(at) else (at, at)
    place = np.arange(len(at)) - np.repeat(np.cumsum(each) - each, each)
    pat, psize = _runs(w.passage)
    of = np.cumsum(w.paragraph)[pat] - 1
    held = np.bincount(of, minlength=len(at))
    part = np.arange(len(pat)) - (np.cumsum(held) - held)[of]
    big, inner = size >= max(least, k), (psize >= max(LEAST, k)) & (held[of] > 1)
    both = lambda x, y: np.concatenate([x, y])
    return both(text[big], text[of[inner]]), both(place[big], place[of[inner]]), both(np.full(big.sum(), -1), part[inner]), both(at[big], pat[inner]), both(size[big], psize[inner])


def _made(docs: DataFrame, stage: Stage, k: int, percent: int, least: int, long: int, bands: int, rows: int) -> DataFrame:
    """Staged units that enough of is shared for a partner: doc, text (hash of the whole text), place, part, n, held
    (shared shingles), same (id of the set), and for the first unit of a set in its portion members, prefix (keys),
    cells, vector."""
    params = mixed(np.arange(1, bands * rows + 1, dtype=np.uint64) * _ODD[0]).reshape(bands, rows)

    def describe(ids, texts_):
        data = [t.encode() for t in texts_]
        w = segmented(data, long)
        name = np.array([xxhash.xxh64_intdigest(t, 42) for t in data], np.uint64).view(np.int64)
        kept = {"doc": np.array(ids, np.int64), "text": name, "words": np.bincount(w.text, minlength=len(ids)).astype(np.int32), "paragraph": np.packbits(w.paragraph), "passage": np.packbits(w.passage)}
        if len(w.h) < k:
            return np.empty(0, np.uint64), np.empty(0, np.uint32), kept
        with np.errstate(over="ignore"):
            every = np.full(len(w.h) - k + 1, k, np.uint64)
            for i in range(k):
                every = mixed(every + w.h[i : len(w.h) - k + 1 + i] * _ODD[i % 5])
        _, n = _runs(w.paragraph)
        left = np.repeat(np.cumsum(n), n) - np.arange(len(w.h))  # words to the end of the paragraph
        whole = np.flatnonzero(left[: len(every)] >= k)
        return every[whole], whole, kept

    def assemble(kept, values, owners, logs):
        total, of = int(kept["words"].sum()), np.repeat(np.arange(len(kept["doc"])), kept["words"])
        flags = (np.unpackbits(kept[c], count=total).astype(bool) for c in ("paragraph", "passage"))
        text, place, part, first, size = _units(Words(of, of, of, *flags), k, least)
        unit_of = {"doc": kept["doc"][text], "text": kept["text"][text], "place": place, "part": part}
        t = size - k + 1
        shared, value, log = np.zeros(total + 1, np.int64), np.zeros(total, np.uint64), np.zeros(total, np.uint8)
        shared[owners + 1], value[owners], log[owners] = 1, values, logs
        before = np.cumsum(shared)
        found = before[first + t] - before[first]
        pick = np.flatnonzero(100 * found >= percent * t)
        if not len(pick):
            return None
        unit = np.repeat(np.arange(len(pick)), t[pick])
        at = np.arange(len(unit)) + np.repeat(first[pick] - (np.cumsum(t[pick]) - t[pick]), t[pick])
        some = shared[at + 1] > 0
        unit, at = unit[some], at[some]
        order = np.lexsort((value[at], log[at], unit))
        unit, v, c = unit[order], value[at][order], log[at][order]
        new = np.r_[True, (v[1:] != v[:-1]) | (unit[1:] != unit[:-1])]
        unit, v, c = unit[new], v[new], c[new]
        held = np.bincount(unit, minlength=len(pick))
        own = t[pick] - found[pick]  # shingles that stand here only
        n = held + own
        fit = 100 * held >= percent * n
        edge = np.r_[0, np.cumsum(held)]
        with np.errstate(over="ignore"):
            same = np.stack([np.add.reduceat(mixed(v), edge[:-1]), np.add.reduceat(mixed(v ^ _ODD[1]), edge[:-1])], 1)
        seen, out = set(), [[] for _ in range(11)]
        for i in np.flatnonzero(fit).tolist():
            x, logs_, size, j = v[edge[i] : edge[i + 1]], c[edge[i] : edge[i + 1]], int(n[i]), pick[i]
            unit = [x[j] for x in unit_of.values()]
            alone = 100 * size < percent * (size + 1)  # so small that only an equal set is similar
            if alone and own[i]:
                continue
            name = b"%d %d %d %d" % tuple(unit) if own[i] else same[i].tobytes()  # a set with a shingle of its own equals no other
            row = [None] * 4
            if name not in seen:
                seen.add(name)
                keys, cells = [x[:0]], [logs_[:0].astype(np.int64)]
                if not alone and percent * size <= 100 * SMALL:  # similar sets share one of their first shingles (prefix principle)
                    p = int(held[i]) - -(-percent * size // 100) + 1
                    keys.append(x[:p])
                    cells.append(cells_of(logs_[:p]))
                if not alone and size > SMALL:  # at a size of both, both are keys
                    for column, y in zip((keys, cells), _bands(x, logs_, params)):
                        column.append(y)
                row = [np.sort(x).tobytes(), np.concatenate(keys).view(np.int64), np.concatenate(cells), vector_of(x, GROUPS)]
            for column, y in zip(out, (*unit, size, held[i], name, *row)):
                column.append(y)
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds)], names=["doc", "text", "place", "part", "n", "held", "same", "members", "prefix", "cells", "vector"])

    return shared_elements(docs, describe, assemble, "doc long, text long, place int, part int, n long, held long, same binary, members binary, prefix array<long>, cells array<long>, vector binary", stage)


def _bands(x: np.ndarray, logs: np.ndarray, params: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A key of each band of the MinHash signature, and the parts its bucket is cut into: no more units can be in it
    than there are places of the rarest of its shingles."""
    with np.errstate(over="ignore"):
        ranked = mixed(x[None, :] ^ params.reshape(-1, 1))
        where = ranked.argmin(1)
        low = ranked[np.arange(len(ranked)), where].reshape(params.shape)
        keys = np.arange(len(params), dtype=np.uint64)
        for i in range(params.shape[1]):
            keys = mixed(keys * _ODD[2] + low[:, i])
    return keys, cells_of(logs[where].reshape(params.shape).min(1))


def removals(docs: DataFrame, stage: Stage, k: int = 5, percent: int = 80, least: int = 5, long: int = 60, bands: int = 8, rows: int = 3) -> DataFrame:
    """(doc, text, place, part, kept): paragraphs (part -1) and passages to remove, and the document of the unit that
    stays in their place. docs: doc_id, text; text in the result: its hash."""
    made = _made(docs, stage, k, percent, least, long, bands, rows)
    whole = ["n", "held", "members", "prefix", "cells", "vector"]
    reps = made.groupBy("same").agg(*(F.first(c, True).alias(c) for c in whole), F.count(F.lit(1)).alias("units"))
    reps = stage.put(reps.select("*", F.lit(None).cast("binary").alias("fine"), F.monotonically_increasing_id().alias("doc_id")))
    links = block_links(reps.select("doc_id", *whole, "fine"), percent, stage)
    found = components(links).select(F.col("node").alias("doc_id"), "component")
    some = reps.select("same", "units", "doc_id").join(found, "doc_id", "left").where("units > 1 or component is not null").select("same", F.coalesce("component", "doc_id").alias("c"))
    members = stage.put(made.select("doc", "text", "place", "part", "same").join(some, "same").drop("same").distinct())
    stage.drop(made)
    paragraph, unit = F.struct("doc", "text", "place"), F.struct("doc", "text", "place", "part")
    least_ = members.groupBy("c").agg(F.min(unit).alias("m"), F.min(F.when(F.col("part") < 0, paragraph)).alias("lead"))
    # A passage that is its component's least may be in a paragraph that goes: there, the least paragraph stays.
    going = members.where("part < 0").join(least_, "c").where(unit != F.col("m")).select(paragraph.alias("p"))
    lost = least_.where("m.part >= 0").join(going, F.struct("m.doc", "m.text", "m.place") == F.col("p"), "left_semi")
    lead = least_.join(lost.select("c", F.lit(True).alias("lost")), "c", "left")
    lead = stage.put(lead.select("c", "m", F.when(F.col("lost") | (F.col("m.part") < 0), F.col("lead")).alias("lead")))
    gone = members.where("part < 0").join(lead, "c").where(~F.coalesce(paragraph == F.col("lead"), F.lit(False)))
    gone = stage.put(gone.select("doc", "text", "place", "part", F.coalesce("lead.doc", "m.doc").alias("kept")))
    inner = stage.put(members.where("part >= 0").join(gone.select("doc", "text", "place"), ["doc", "text", "place"], "left_anti"))
    first = inner.groupBy("c").agg(F.min(unit).alias("first"))
    inner = inner.join(first, "c").join(lead, "c")
    stays = F.coalesce(paragraph == F.col("lead"), unit == F.col("first"))
    inner = inner.where(~stays).select("doc", "text", "place", "part", F.coalesce("lead.doc", "first.doc").alias("kept"))
    return gone.unionByName(inner)


def paragraph_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per row of docs: doc_id, n_removed (paragraphs and passages), removed (places of the paragraphs that go),
    passages (of paragraphs that stay, the passages that go: place of the paragraph, part), kept_in (documents that
    keep a unit in place of one that goes here, this one included), text_hash (which names the row with doc_id).

    Null and empty texts, and texts of short lines only, keep everything; a paragraph or passage of under five words has
    no shingle and stays. Rows that repeat a doc_id with another text are documents of their own; rows that repeat id and
    text are one document, answered row by row. Rows with a null doc_id keep everything. An empty table gives an empty
    result.
    """
    stage = Stage(docs.sparkSession, "paragraphs")
    base = texts(docs, id_col, text_col)
    gone = removals(base.where("doc_id is not null"), stage, **options)
    places = F.collect_set(F.when(F.col("part") < 0, F.col("place")))
    inner = F.collect_set(F.when(F.col("part") >= 0, F.struct("place", "part")))
    each = gone.groupBy(F.col("doc").alias("doc_id"), F.col("text").alias("text_hash")).agg(F.array_sort(places).alias("removed"), F.array_sort(inner).alias("passages"), F.array_sort(F.collect_set("kept")).alias("kept_in"))
    each = stage.put(each)
    out = base.select("doc_id", F.xxhash64("text").alias("text_hash")).join(each, ["doc_id", "text_hash"], "left")
    or_none = lambda c, kind: F.coalesce(c, F.array().cast(kind)).alias(c)
    removed, inner = or_none("removed", "array<int>"), or_none("passages", "array<struct<place:int,part:int>>")
    return out.select("doc_id", (F.size(removed) + F.size(inner)).cast("long").alias("n_removed"), removed, inner, or_none("kept_in", "array<long>"), "text_hash")


def without_paragraphs(docs: DataFrame, report: DataFrame, long: int = 60, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the text without the paragraphs and passages that a report of the same table removes.

    Null texts come out empty; rows with a null doc_id and rows that the report does not name come out whole.
    """
    wanted = report.where("n_removed > 0").select("doc_id", "text_hash", "removed", "passages").dropDuplicates(["doc_id", "text_hash"])
    joined = texts(docs, id_col, text_col).withColumn("text_hash", F.xxhash64("text")).join(wanted, ["doc_id", "text_hash"], "left")

    def run(batches):
        for batch in batches:
            kept = []
            for t, r, q in zip(batch.column("text"), batch.column("removed"), batch.column("passages")):
                text, gone = t.as_py(), set(r.as_py() or ())
                inner = {(u["place"], u["part"]) for u in q.as_py() or ()}
                if gone or inner:
                    data = text.encode()
                    w = segmented([data], long)
                    at = np.flatnonzero(w.passage)
                    place = np.cumsum(w.paragraph)[at] - 1
                    part = np.arange(len(at)) - np.searchsorted(place, place)
                    cuts = [0, *w.start[at][1:].tolist(), len(data)]
                    text = b"".join(data[a:b] for a, b, i, j in zip(cuts, cuts[1:], place.tolist(), part.tolist()) if i not in gone and (i, j) not in inner).decode()
                kept.append(text)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(kept, pa.string())], names=["doc_id", "text"])

    return joined.select("doc_id", "text", "removed", "passages").mapInArrow(run, "doc_id long, text string")


def op3_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """paragraph_report() over documents, at five words and a similarity of 0.8."""
    return paragraph_report(documents(spark, sf_dir))
