"""Scores by a gated recurrent language model, trained and run in numpy.

Counts of all training tokens are exact and distributed. The commonest ``table`` tokens have their counts sent to the
tasks, and the rest are joined. The commonest ``vocabulary`` of them are the model's words, sorted into classes of equal
size by rank; p(word) = p(class | state) * p(word | class, state). Rarer words go through one unknown word, and share its
probability by their smoothed counts. Training reads all training documents once: they are dealt to shards by their ids,
and each shard trains a copy by truncated backpropagation over windows of ``window`` tokens, many documents side by side,
each with its own state that is carried from window to window (for PIECE tokens); the copies' weights are averaged,
weighted by tokens, in an aggregation. That is done in ``rounds``, each over its share of the documents and from the weights of the one before.
Scoring carries the state through whole documents in the same way.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrow import PORTION, gathered, portions
from .common import Stage, documents, texts
from .exchange import by_value
from .shingles import words

END = b"\n"  # no word has it
#: Tokens that are trained on in one go; of a longer document, the next ones start from a state of zeros.
PIECE = 2048
#: Tokens of a document that is scored with other long ones; documents are scored side by side, those of ``HELD`` tokens at a time.
LONG, HELD = 1024, 2_000_000
#: Rows of a softmax that are worked on at a time, so that they stay in the cache.
ROWS = 2048
#: Weights are averaged as whole multiples of one part in this.
FIXED = float(1 << 32)


class Model:
    """A GRU with one weight table for its input words, and a class-factored softmax over ``size`` words.

    Word 0 is the unknown word; word ids are by rank, class c holds ids c * width to (c + 1) * width - 1. Weights of the
    gates come one gate after the other, so that all that is worked on lies in one piece; the last row of c and o is the bias.
    """

    def __init__(self, size: int, hidden: int, counts: np.ndarray | None = None, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.size, self.hidden = size, hidden
        self.width = max(1, math.isqrt(max(size - 1, 0)) + 1)
        self.classes = -(-size // self.width)
        r = lambda *s: (rng.standard_normal(s) * 0.1).astype(np.float32)
        gates = lambda a: np.ascontiguousarray(a.reshape(len(a), -1, hidden).transpose(1, 0, 2))
        self.w = {"x": gates(r(size, 3 * hidden)), "u": gates(r(hidden, 2 * hidden)), "v": r(hidden, hidden), "c": r(hidden, self.classes), "o": r(self.classes, hidden, self.width)}
        n = np.zeros(self.classes * self.width)  # the output starts as the words' own frequencies
        n[:size] = 0.1 + (0 if counts is None else counts)
        n = n.reshape(self.classes, self.width)
        own = np.where(n > 0, np.log(np.maximum(n, 1e-9) / n.sum(1, keepdims=True)), -30)
        self.w["c"] = np.concatenate([self.w["c"], np.log(n.sum(1) / n.sum()).astype(np.float32)[None]])
        self.w["o"] = np.concatenate([self.w["o"], own.astype(np.float32)[:, None]], 1)

    def vector(self) -> np.ndarray:
        return np.concatenate([v.ravel() for v in self.w.values()])

    def load(self, flat: np.ndarray) -> Model:
        at = 0
        for k, v in self.w.items():
            self.w[k] = flat[at : at + v.size].reshape(v.shape).astype(np.float32)
            at += v.size
        return self

    def step(self, x: np.ndarray, h: np.ndarray, g: np.ndarray, rh: np.ndarray, c: np.ndarray, new: np.ndarray) -> None:
        """For input words x and states h: what both gates hold back (1 - gate), the reset states, candidates and next states."""
        a = self.w["x"].take(x, 1)
        np.matmul(h, self.w["u"], out=g)
        g += a[:2]
        _held_back(g)
        np.multiply(h, g[1], out=rh)
        np.subtract(h, rh, out=rh)
        np.matmul(rh, self.w["v"], out=c)
        c += a[2]
        c *= 2
        _held_back(c)
        c *= -2
        c += 1
        np.subtract(h, c, out=new)
        new *= g[0]
        new += c

    def log_probs(self, h: np.ndarray, y: np.ndarray, grad: bool = False):
        """Natural log probability of words y after states h; with grad, also the gradient of minus their sum.

        States are within (-1, 1), so sums of weights bound the logits, and no maximum has to be taken off them first."""
        w, n = self.w, self.hidden
        k, j = np.divmod(y, self.width)
        order = _order(k, self.classes)
        k, j = k[order], j[order]
        cuts = np.searchsorted(k, np.arange(self.classes + 1))
        rows = np.empty((len(y), n + 1), h.dtype)
        rows[:, :n], rows[:, n] = h.take(order, 0), 1
        lp, gh = np.empty(len(y), h.dtype), np.empty((len(y), n) if grad else (0, n), h.dtype)
        gc, go = np.zeros_like(w["c"]), np.zeros_like(w["o"]) if grad else None
        high = _high(w["c"])
        for a in range(0, len(y), ROWS):
            b = min(a + ROWS, len(y))
            lp[a:b] = _softmax(rows[a:b], w["c"], k[a:b], high, gh[a:b] if grad else None, gc)
        high = _high(w["o"])
        more = np.empty((ROWS, n), h.dtype)
        for c in np.flatnonzero(np.diff(cuts)):
            for a in range(cuts[c], cuts[c + 1], ROWS):
                b = min(a + ROWS, cuts[c + 1])
                lp[a:b] += _softmax(rows[a:b], w["o"][c], j[a:b], high, more[: b - a] if grad else None, go[c] if grad else None)
                if grad:
                    gh[a:b] += more[: b - a]
        out = np.empty_like(lp)
        out[order] = lp
        if not grad:
            return out
        back = np.empty_like(gh)
        back[order] = gh
        return out, back, {"c": gc, "o": go}


def _order(a: np.ndarray, most: int) -> np.ndarray:
    """Numbers below ``most`` in a stable order; numbers of 16 bits are sorted by their digits."""
    return np.argsort(a.astype(np.uint16) if most <= 1 << 16 else a, kind="stable")


def _held_back(a: np.ndarray) -> None:
    """1 - the logistic function, in place; what overflows is 0."""
    np.exp(a, out=a)
    a += 1
    np.reciprocal(a, out=a)


def _high(weights: np.ndarray) -> bool:
    """Whether a logit may pass 80, of states within (-1, 1)."""
    return bool((np.abs(weights[..., :-1, :]).sum(-2) + weights[..., -1, :]).max() > 80)


def _softmax(rows: np.ndarray, weights: np.ndarray, own: np.ndarray, high: bool, gh: np.ndarray | None, gw: np.ndarray | None) -> np.ndarray:
    """Log probabilities of the own columns; gh is set to the gradient of the states and added to gw that of the weights."""
    e = rows @ weights
    if high:
        np.minimum(e, 80, out=e)
    flat, at = e.reshape(-1), np.arange(0, e.size, e.shape[1])
    at += own
    mine = flat.take(at)
    np.exp(e, out=e)
    total = e @ np.ones(e.shape[1], e.dtype)
    if gh is not None:
        flat[at] -= total  # total times (probability - 1 for the own one)
        part = np.reciprocal(total)[:, None]
        np.matmul(e, weights[:-1].T, out=gh)
        gh *= part
        gw += (rows * part).T @ e
    return np.maximum(mine - np.log(total), -69)


class Streams:
    """Documents side by side: column b of a window goes on where it was, and takes the next document after an end."""

    def __init__(self, docs: list[np.ndarray], lanes: int):
        size = np.array([len(d) for d in docs])
        own = [[] for _ in range(max(1, min(lanes, len(docs))))]
        load = [(0, i) for i in range(len(own))]
        for d in np.argsort(-size, kind="stable").tolist():
            n, i = load[0]
            own[i].append(d)
            heapq.heapreplace(load, (n + int(size[d]), i))
        lens = np.array([size[lane].sum() for lane in own])
        rank = np.argsort(-lens, kind="stable")  # lanes are sorted by length, and lie one after the other
        line = np.array([d for i in rank for d in own[i] if size[d]])
        self.lens = lens[rank]
        self.starts = np.cumsum(self.lens) - self.lens
        self.y, self.owner = np.concatenate([docs[d] for d in line]).astype(np.int32), np.repeat(line, size[line])
        self.fresh = np.zeros(len(self.y), bool)
        self.fresh[np.cumsum(size[line]) - size[line]] = True
        self.x = np.where(self.fresh, 1, np.roll(self.y, 1)).astype(np.int64)  # a document begins after an end, which is word 1

    def windows(self, size: int):
        """(inputs, targets, owners, whether a document starts there, where each step starts); step after step, and in each
        the lanes that are not over."""
        live = np.searchsorted(-self.lens, -np.arange(1, self.lens[0] + 1), "right")
        for a in range(0, int(self.lens[0]), size):
            n, rows = live[a], live[a : a + size]
            at = self.starts[:n] + np.arange(a, a + len(rows))[:, None]
            at = at.ravel() if rows[-1] == n else at[np.arange(n) < rows[:, None]]
            yield self.x[at], self.y[at], self.owner[at], self.fresh[at], np.r_[0, np.cumsum(rows)].tolist()


def run(model: Model, docs: list[np.ndarray], lanes: int, window: int, rate: float = 0.0) -> np.ndarray:
    """Natural log probability of each document; with a rate, learns on the way (one update a window)."""
    scores = np.zeros(len(docs))
    if not docs:
        return scores
    n, w = model.hidden, model.w
    kind = w["v"].dtype
    square = {k: np.full(v.shape, 1e-4, np.float32) for k, v in w.items()} if rate else {}
    h = np.zeros((min(lanes, len(docs)), n), kind)
    with np.errstate(over="ignore"):
        for x, y, owner, fresh, edge in Streams(docs, lanes).windows(window):
            states = np.empty((len(x), n), kind)
            # What is learnt from is kept for the whole window; else each step takes the place of the one before.
            held = len(x) if rate else edge[1]
            g, rh, c, before = np.empty((2, held, n), kind), np.empty((held, n), kind), np.empty((held, n), kind), np.empty((held, n), kind)
            for a, b in zip(edge, edge[1:]):
                at = slice(a, b) if rate else slice(0, b - a)
                before[at] = h[: b - a]
                if fresh[a:b].any():
                    before[at][fresh[a:b]] = 0
                h = states[a:b]
                model.step(x[a:b], before[at], g[:, at], rh[at], c[at], h)
            if not rate:
                scores += np.bincount(owner, model.log_probs(states, y), len(docs))
                continue
            lp, gh, grads = model.log_probs(states, y, True)
            scores += np.bincount(owner, lp, len(docs))
            for k, v in (grads | _gradients(model, x, fresh, edge, g, rh, c, before, gh)).items():
                np.clip(v, -50, 50, out=v)
                part = v * v
                square[k] += part
                np.sqrt(square[k], out=part)
                np.divide(v, part, out=part)
                part *= rate
                w[k] -= part
    return scores


def _gradients(model: Model, x: np.ndarray, fresh: np.ndarray, edge: list[int], g: np.ndarray, rh: np.ndarray, c: np.ndarray, before: np.ndarray, gh: np.ndarray) -> dict[str, np.ndarray]:
    """Gradients of x, u and v from that of the states, which is added to: what does not hang on it is made at once."""
    w, (q, s) = model.w, g
    r = 1 - s
    to_c, to_z, to_r = (1 - q) * (1 - c * c), (c - before) * q * (1 - q), before * r * s
    d = np.empty((3, *gh.shape), gh.dtype)
    back, (uz, ur), v = gh[:0], w["u"].transpose(0, 2, 1), w["v"].T
    for a, b in zip(edge[-2::-1], edge[:0:-1]):
        own = gh[a:b]
        own[: len(back)] += back
        dz, dr, dc = d[:, a:b]
        np.multiply(own, to_c[a:b], out=dc)
        drh = dc @ v
        np.multiply(own, to_z[a:b], out=dz)
        np.multiply(drh, to_r[a:b], out=dr)
        back = own * q[a:b]
        drh *= r[a:b]
        back += drh
        back += dz @ uz
        back += dr @ ur
        if fresh[a:b].any():
            back[fresh[a:b]] = 0
    order = _order(x, model.size)
    words_ = x[order]
    first = np.flatnonzero(np.r_[True, np.diff(words_) > 0])
    gx = np.zeros_like(w["x"])
    gx[:, words_[first]] = np.add.reduceat(d.take(order, 1), first, 1)
    return {"x": gx, "u": np.matmul(before.T, d[:2]), "v": rh.T @ d[2]}


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % 10 == 0


def _counts(docs: DataFrame) -> DataFrame:
    """(token, n) over all documents; a task's own sums are made before anything is sent."""

    def work(batches):
        for batch in batches:
            for ids, texts_ in portions(batch, 16 * PORTION):
                seen = Counter()
                for t in texts_:
                    seen.update(words(t))
                seen[END] += len(texts_)
                yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["token", "n"])

    return docs.mapInArrow(work, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n"))


def commonest(counts: DataFrame, most: int) -> list[tuple[bytes, int]]:
    """The (token, n) with the greatest n, at most ``most``, sorted by n and token; of those that are just as common as the last, some by
    their hash. Two small histograms find the cut, so that the driver gets no more rows than that."""
    size = F.when(F.col("n") < 1024, F.col("n")).otherwise(F.floor(F.log2("n") * 64) + 384).cast("long")
    slot = F.pmod(F.xxhash64("token"), F.lit(1 << 16))
    left, cut = most, None
    for r in sorted(counts.groupBy(size.alias("size")).agg(F.count(F.lit(1)).alias("c")).collect(), key=lambda r: -r["size"]):  # some 4,000 rows at most
        if r["c"] > left:
            cut = r["size"]
            break
        left -= r["c"]
    whole = size > cut if cut is not None else F.lit(True)
    if cut is not None and left:
        edge = 0
        for r in sorted(counts.where(size == cut).groupBy(slot.alias("slot")).agg(F.count(F.lit(1)).alias("c")).collect(), key=lambda r: r["slot"]):  # 65,536 rows at most
            if r["c"] > left:
                break
            left, edge = left - r["c"], r["slot"] + 1
        whole = whole | ((size == cut) & (slot < edge))
    return sorted(((bytes(r["token"]), r["n"]) for r in counts.where(whole).collect()), key=lambda x: (-x[1], x[0]))


class _Ranks(dict):
    def __missing__(self, word: bytes) -> int:
        return -1


def _sums(x: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """The sum of each part of x between two edges."""
    out, some = np.zeros(len(edge) - 1), np.flatnonzero(np.diff(edge))
    if len(some):
        out[some] = np.add.reduceat(x.astype(np.float64), edge[some])
    return out


def _groups(batches, size: int, code):
    """Documents of a sorted stream in groups of some ``size`` characters, wherever the batches end."""
    held, n = [], 0
    for batch in batches:
        for d, k in zip(batch.column("words"), batch.column("chars").to_pylist()):
            if held and n + k > size:
                yield held
                held, n = [], 0
            held.append(np.frombuffer(d.as_buffer(), code))
            n += k
    if held:
        yield held


def _added(columns, named):
    """Work on batches of (part, seen, columns): of each part of the weights, the tokens seen and the sums of ``named``'s two
    arrays. Weights times tokens are added up in whole numbers, as high and low halves, so that no order matters."""

    def work(batches):
        held = {}
        for batch in batches:
            for i, (part, seen) in enumerate(zip(batch.column("part").to_pylist(), batch.column("seen").to_pylist())):
                more = named(seen, *(np.frombuffer(batch.column(c)[i].as_buffer(), np.int64) for c in columns))
                old = held.get(part)
                held[part] = (old[0] + seen, old[1] + more[0], old[2] + more[1]) if old else (seen, *more)
        for part, (seen, high, low) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seen], pa.int64()), pa.array([high.tobytes()], pa.binary()), pa.array([low.tobytes()], pa.binary())], names=["part", "seen", "high", "low"])

    return work


def language_model_scores(docs: DataFrame, vocabulary: int = 4096, table: int = 65536, hidden: int = 16, window: int = 32, lanes: int = 512, rate: float = 0.1, rounds: int = 4, shard_size: int = 16_000_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from documents whose crc32(doc_id as text) mod 10 is not 0 (a null doc_id is not learnt from). Null and
    empty texts are one end token. Without training tokens every word is unknown, and base_score is a sum of
    log10(0.1 / 0.1). Rows that repeat a doc_id are scored one by one. Scores are log10, and but for rounding a function of
    the table: what a shard of some ``shard_size`` characters learns does not depend on partitions.
    """
    spark, stage = docs.sparkSession, Stage(docs.sparkSession, "lm")
    base = texts(docs, id_col, text_col)
    mine = F.coalesce(~held_out(), F.lit(False))
    counts = stage.put(_counts(base.where(mine)))
    total, kinds = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    ends = next((r["n"] for r in counts.where(F.col("token") == F.lit(END)).collect()), 0)
    top = commonest(counts.where(F.col("token") != F.lit(END)), max(table, vocabulary) - 2)
    known_n = dict(top) | {END: ends}
    top = top[: vocabulary - 2]
    size = 2 + len(top)
    rare_tokens, rare_kinds = total - sum(n for _, n in top) - ends, kinds - len(top) - (ends > 0)
    frequency = np.array([rare_tokens, ends, *(n for _, n in top)], np.float64)

    code = np.uint16 if size <= 1 << 16 else np.uint32
    # The model's word of a rank in the table; the last entry is that of rank -1, of words that are not in it.
    word_of = np.zeros(len(known_n) + 1, np.int32)
    word_of[: len(top)] = np.arange(2, size)
    ranks = _Ranks((x, i) for i, x in enumerate(x for x in known_n if x != END))

    def ranked(split):
        """Ranks of the words of all texts, one text after the other, how many each has, and the model's words, with each text's end."""
        n = np.array([len(w) for w in split])
        flat = np.fromiter(map(ranks.__getitem__, chain.from_iterable(split)), np.int64, int(n.sum()))
        ends = np.cumsum(n + 1)
        line = np.ones(int(ends[-1]), code)
        line[np.delete(np.arange(len(line)), ends - 1)] = word_of[flat]
        return flat, n, line

    # Of each rank: its part of the base score, what it adds to that of the unknown word, and whether it is known.
    low, under = math.log10(rare_tokens + 0.1 * (rare_kinds + 1)), math.log10(total + 0.1 * (kinds + 1))
    common = np.array([n for x, n in known_n.items() if x != END] + [0], np.float64)
    base_of = np.append(np.log10(common[:-1] + 0.1) - under, 0.0)
    more_of = np.append(np.where(word_of[: len(common) - 1] > 0, 0.0, np.log10(common[:-1] + 0.1) - low), 0.0)
    end_base, end_known = math.log10(ends + 0.1) - under, int(ends > 0)

    def numbered(batches):
        """The model's words of each text, and what its score needs of the words that the model has not."""
        for own, texts_ in gathered(batches, 4 * PORTION):
            split = [words(t) for t in texts_]
            flat, n, line = ranked(split)
            edge = np.r_[0, np.cumsum(n)]
            frequent, more, known, missed = (_sums(x, edge) for x in (base_of[flat], more_of[flat], flat >= 0, flat < 0))
            rare = [list(Counter(w[x] for x in np.flatnonzero(flat[a:b] < 0).tolist()).items()) if m else [] for w, a, b, m in zip(split, edge, edge[1:], missed)]
            cuts = (np.r_[0, np.cumsum(n + 1)] * line.itemsize).astype(np.int64)
            coded = pa.Array.from_buffers(pa.large_binary(), len(own), [None, pa.py_buffer(cuts), pa.py_buffer(line)]).cast(pa.binary())
            columns = [pa.array(own, pa.int64()), pa.array([len(t) for t in texts_], pa.int64()), coded, pa.array(more), pa.array(frequent + end_base), pa.array(known.astype(np.int64) + end_known), pa.array([[x for x, _ in r] for r in rare], pa.list_(pa.binary())), pa.array([[k for _, k in r] for r in rare], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "chars", "words", "more", "frequent", "known", "rare", "times"])

    # Texts are cut into words once more only, after the counts. A row's number keeps rows apart that repeat a doc_id.
    lines = stage.put(base.mapInArrow(numbered, "doc_id long, chars long, words binary, more double, frequent double, known long, rare array<binary>, times array<long>").withColumn("row", F.monotonically_increasing_id()))

    weights = Model(size, hidden, frequency).vector()

    def train(start):
        def work(batches):
            for shard, rows in by_value(batches, "shard"):
                model, seen = Model(size, hidden).load(start), 0
                for d in _groups(rows.to_batches(), 4 * PORTION, code):
                    run(model, [x[a : a + PIECE] for x in d for a in range(0, len(x), PIECE)], lanes, window, rate)
                    seen += sum(map(len, d))
                flat = np.rint(model.vector().astype(np.float64) * FIXED).astype(np.int64)
                parts = np.array_split(flat, max(1, len(flat) // 4096))
                yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([seen] * len(parts), pa.int64()), pa.array([p.tobytes() for p in parts], pa.binary())], names=["part", "seen", "weights"])

        return work

    # A shard's documents and their order come from the ids and words alone, and copies are added up in whole numbers, so
    # the model does not depend on how the table is cut into partitions or in which order tasks end.
    characters = lines.where(mine).agg(F.sum("chars")).first()[0] or 0
    shards = max(1, int(characters // shard_size))
    drawn = F.xxhash64("doc_id", F.lit(11))
    dealt = lines.where(mine).select(F.pmod(drawn, F.lit(rounds)).alias("round"), F.pmod(F.shiftright(drawn, 20), F.lit(shards)).alias("shard"), "doc_id", "words", "chars")
    for turn in range(rounds if total else 0):
        rows = dealt.where(F.col("round") == turn).select("shard", "doc_id", "words", "chars")
        rows = rows.repartition(min(shards, 20_000), "shard").sortWithinPartitions("shard", "doc_id", "words", "chars")
        copies = stage.put(rows.mapInArrow(train(weights), "part int, seen long, weights binary"))
        halves = "part int, seen long, high binary, low binary"
        some = stage.put(copies.mapInArrow(_added(["weights"], lambda seen, w: ((w >> 16) * seen, (w & 0xFFFF) * seen)), halves), 256)  # rows of 32 KB
        learnt = some.repartition("part").mapInArrow(_added(["high", "low"], lambda seen, high, low: (high, low)), halves).collect()  # the model's size, whatever the corpus
        if learnt:
            halved = [(r["seen"], *(np.frombuffer(r[k], np.int64).astype(np.float64) for k in ("high", "low"))) for r in sorted(learnt, key=lambda r: r["part"])]
            weights = np.concatenate([(high * 65536 + low) / seen for seen, high, low in halved]) / FIXED
            weights = weights.astype(np.float32)
        del learnt
        stage.drop(copies, some)

    names = ["row", "doc_id", "n_tokens", "score", "frequent", "known"]
    kinds_ = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64()]

    def score(batches):
        model = Model(size, hidden).load(weights)

        def scored(some):
            """Rows (words, row, doc_id, score of the common words that the model has not, base score, known)."""
            natural = run(model, [r[0] for r in some], lanes, 64) / math.log(10)
            columns = zip(*((k, i, len(d), float(n) + more, frequent, known) for n, (d, k, i, more, frequent, known) in zip(natural, some)))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds_)], names=names)

        held, tokens = {True: [], False: []}, {True: 0, False: 0}
        for batch in batches:
            for d, *rest in zip(batch.column("words"), *(batch.column(c).to_pylist() for c in ("row", "doc_id", "more", "frequent", "known"))):
                d = np.frombuffer(d.as_buffer(), code)
                long = len(d) > LONG
                held[long].append((d, *rest))
                tokens[long] += len(d)
                if tokens[long] > HELD:
                    yield scored(held[long])
                    held[long], tokens[long] = [], 0
        for some in held.values():
            if some:
                yield scored(some)

    made = stage.put(lines.select("row", "doc_id", "words", "more", "frequent", "known").mapInArrow(score, "row long, doc_id long, n_tokens long, score double, frequent double, known long"))
    rare = lines.select("row", F.explode(F.arrays_zip("rare", "times")).alias("r")).select("row", F.col("r.rare").alias("token"), F.col("r.times").alias("k"))
    c = F.coalesce("n", F.lit(0))
    per = rare.join(counts, "token", "left").groupBy("row").agg(
        F.sum(F.col("k") * F.log10((c + 0.1) / (total + 0.1 * (kinds + 1)))).alias("rare_base"),
        F.sum(F.when(c > 0, F.col("k")).otherwise(0)).alias("rare_known"),
        F.sum(F.col("k") * F.log10((c + 0.1) / (rare_tokens + 0.1 * (rare_kinds + 1)))).alias("rare_score"),
    )
    out = made.join(per, "row", "left")
    zero = F.lit(0.0)
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "n_tokens", (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), (F.col("frequent") + F.coalesce("rare_base", zero)).alias("base_score"), (F.col("score") + F.coalesce("rare_score", zero)).alias("score"))


def op5_recurrent_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """language_model_scores() over documents: null and empty texts are one end token."""
    return language_model_scores(documents(spark, sf_dir))
