"""How many tokens are fuzzily like each known value, counted without a row a pair.

Same length. Few edits are two substitutions, or a deletion and an insertion. Tokens with up to two substitutions follow
from how many share the value with none, one and two places blanked; those with a deletion and an insertion from how many
share a value without one letter, less what is counted twice: one substitution; c d..d against d..d e, which is two
substitutions as well; and alternating stretches, the only ones with two such values in common. So a count is a sum of
counts of keys, times factors: keys are exchanged once, packed, and no key is ever paired with another.

Other lengths: pairs, of the lengths that do occur, by sorted joins: what is small on disk may not fit a driver's memory.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import phi

PORTION = 1_000_000  # keys a portion of the exchange
BATCH = 300_000  # keys a call
_DATA = np.dtype([("k", "<u8"), ("c", "<u8"), ("n", "<i8")])
_ASK = np.dtype([("k", "<u8"), ("c", "<u8"), ("id", "<i8"), ("f", "<i4")])
_EXACT, _ONE, _TWO, _LESS = (np.uint64(x * 0x9E3779B97F4A7C15 % 2**64) for x in (3, 5, 7, 11))


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    x = (x.astype(np.uint64) + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _place(at: np.ndarray, letter: np.ndarray) -> np.ndarray:
    """What a letter at a place adds to the two hashes of a value: (..., 2)."""
    x = (np.asarray(at, np.uint64) << np.uint64(24)) + np.asarray(letter, np.uint64)
    return np.stack([_mix(x, 1), _mix(x, 0x51ED270B)], -1)


_BLANK = 1 << 23  # stands for any letter


def _keys(m: np.ndarray, varies: np.ndarray, ask: bool):
    """Keys of values (n x length code points) as (row numbers, keys (k, 2), factors); factors only matter when asking.

    Places where all values agree are never blanked."""
    n, size = m.shape
    rows, at = np.arange(n), np.arange(size)
    h = _place(at, m)  # n x size x 2
    whole = h.sum(1, dtype=np.uint64)
    some = np.flatnonzero(varies)
    v = len(some)
    most = 0 if size < 4 else 1 if size < 6 else 2
    # Counts with exactly none, one, two substitutions: s0, s1 - v s0, s2 - v(v-1)/2 s0 - (v-1)(s1 - v s0).
    parts, f0 = [], 1
    if most:
        blank = _place(some, np.full(v, _BLANK))
        off = blank - h[:, some]  # n x v x 2
        one = whole[:, None] + off
        f1 = 1 if most == 1 else 1 - (v - 1) - 1  # the last: one substitution is also a deletion and an insertion
        f0 += -v if most == 1 else -v - v * (v - 1) // 2 + (v - 1) * v + v
        if f1 or not ask:
            parts.append((np.repeat(rows, v), one.reshape(-1, 2) + _ONE, f1))
        if most == 2:
            i, j = np.triu_indices(v, 1)
            parts.append((np.repeat(rows, len(i)), (whole[:, None] + off[:, i] + off[:, j]).reshape(-1, 2) + _TWO, 1))
            # Without one letter: of equal letters in a row, the first goes.
            first = np.concatenate([np.ones((n, 1), bool), m[:, 1:] != m[:, :-1]], 1)
            before = np.cumsum(h, 1, dtype=np.uint64) - h
            left = np.zeros_like(h)
            left[:, 1:] = _place(at[:-1], m[:, 1:])
            after = left.sum(1, dtype=np.uint64)[:, None] - np.cumsum(left, 1, dtype=np.uint64)
            r, i = np.nonzero(first)
            parts.append((r, (before + after)[r, i] + _LESS, 1))
            if ask:
                parts.append((rows, whole + _EXACT, -first.sum(1)))  # the value itself, once for each of these
                parts += _both_ways(m, varies, h, whole)
    parts.append((rows, whole + _EXACT, f0))
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), np.concatenate([np.broadcast_to(p[2], len(p[0])) for p in parts])


def _both_ways(m, varies, h, whole):
    """What a deletion and an insertion reach that is two substitutions as well, and what they reach in two ways."""
    n, size = m.shape
    parts = []
    for step in (1, -1):
        for i in np.flatnonzero(varies):
            if not 0 <= i + step < size:
                continue
            d = m[:, i + step]
            on = m[:, i] != d
            moved = whole - h[:, i] + _place(np.full(n, i), d)
            j = i + step
            while 0 <= j < size and on.any():
                on = on & (m[:, j] == d)
                if varies[j] and on.any():
                    r = np.flatnonzero(on)
                    parts.append((r, moved[r] - h[r, j] + _place(np.full(len(r), j), np.full(len(r), _BLANK)) + _ONE, -1))
                    parts.append((r, moved[r] + _EXACT, 1))
                j += step
    for i in range(size - 2):
        if not varies[i]:
            continue
        c, d = m[:, i], m[:, i + 1]
        on = c != d
        flipped = whole.copy()
        for j in range(i, size):
            here, other = (c, d) if (j - i) % 2 == 0 else (d, c)
            on = on & (m[:, j] == here) & varies[j]
            if not on.any():
                break
            flipped = flipped - h[:, j] + _place(np.full(n, j), other)
            if j - i >= 2:
                r = np.flatnonzero(on)
                parts.append((r, flipped[r] + _EXACT, -1))
    return parts


def _letters(texts: list[str], size: int) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(texts), size)


def _by_length(texts: list[str]):
    sizes = np.array([len(t) for t in texts], np.int64)
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        step = max(1, BATCH // (int(size) ** 2 // 2 + 4 * int(size) + 2))
        for k in range(0, len(at), step):
            yield int(size), at[k : k + step]


def _varying(values: DataFrame) -> dict[int, np.ndarray]:
    """By length, the places at which the values (v) differ: the least and greatest letter of each place."""

    def run(batches):
        for batch in batches:
            texts, out = batch.column("v").to_pylist(), []
            for size, at in _by_length(texts):
                m = _letters([texts[i] for i in at], size)
                out += [(size, p, int(a), int(b)) for p, (a, b) in enumerate(zip(m.min(0), m.max(0)))]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int32()) for k in range(4)], names=["size", "p", "a", "b"])

    seen = values.mapInArrow(run, "size int, p int, a int, b int").groupBy("size", "p").agg((F.min("a") < F.max("b")).alias("varies"))
    found: dict[int, np.ndarray] = {}
    for r in seen.collect():  # a row for each length and place
        found.setdefault(r.size, np.zeros(r.size, bool))[r.p] = r.varies
    return found


def _same_length(known: DataFrame, tokens: DataFrame, sizes: list[int]) -> DataFrame:
    """(id, which, n): sums over tokens of the length of the known value with this id, in parts; which: 0 distinct, 1 all."""
    known, tokens = (x.where(F.length("v").isin(sizes)) for x in (known.select("id", "v"), tokens.select("v", "n")))
    varies = _varying(known.select("v").unionByName(tokens.select("v")))
    count = {r.s: r.k for r in known.select("v").unionByName(tokens.select("v")).groupBy(F.length("v").alias("s")).agg(F.count(F.lit(1)).alias("k")).collect()}
    each = {s: 1 + int(varies[s].sum()) ** 2 // 2 + 2 * s if s else 1 for s in count}
    portions = max(1, sum(k * each[s] for s, k in count.items()) // PORTION)

    def pack(ask):
        def run(batches):
            for batch in batches:
                texts = batch.column("v").to_pylist()
                value = np.asarray(batch.column("id" if ask else "n").to_numpy(zero_copy_only=False), np.int64)
                for size, at in _by_length(texts):
                    row, key, factor = _keys(_letters([texts[i] for i in at], size), varies.get(size, np.zeros(0, bool)), ask)
                    out = np.empty(len(row), _ASK if ask else _DATA)
                    out["k"], out["c"] = key[:, 0], key[:, 1]
                    out["id" if ask else "n"] = value[at][row]
                    if ask:
                        out["f"] = factor
                    part = (key[:, 0] >> np.uint64(20)) % np.uint64(portions)
                    order = np.argsort(part, kind="stable")
                    out, part = out[order], part[order]
                    cuts = np.flatnonzero(np.diff(part, prepend=part[0] + np.uint64(1)))
                    ends = np.r_[cuts[1:], len(part)]
                    yield pa.RecordBatch.from_arrays([pa.array(part[cuts].astype(np.int64)), pa.array([ask] * len(cuts)), pa.array([out[a:b].tobytes() for a, b in zip(cuts, ends)], pa.binary())], names=["part", "ask", "rows"])

        return run

    def count_up(parts):
        data, asks = (np.frombuffer(b"".join(parts[k]), t) for k, t in ((False, _DATA), (True, _ASK)))
        if not len(data) or not len(asks):
            return None
        order = np.lexsort((data["c"], data["k"]))
        data = data[order]
        start = np.flatnonzero(np.r_[True, (data["k"][1:] != data["k"][:-1]) | (data["c"][1:] != data["c"][:-1])])
        one, all_ = np.diff(np.r_[start, len(data)]), np.add.reduceat(data["n"], start)
        head = data[start]
        at = np.searchsorted(head["k"], asks["k"])
        at[at == len(head)] = 0
        # Two keys with the same first hash are next to each other: step on until the second is the same.
        for _ in range(4):
            nxt = np.minimum(at + 1, len(head) - 1)
            at = np.where((head["k"][at] == asks["k"]) & (head["c"][at] != asks["c"]) & (head["k"][nxt] == asks["k"]), nxt, at)
        hit = np.flatnonzero((head["k"][at] == asks["k"]) & (head["c"][at] == asks["c"]))
        if not len(hit):
            return None
        ids, f, at = asks["id"][hit], asks["f"][hit].astype(np.int64), at[hit]
        order = np.argsort(ids, kind="stable")
        ids, f, at = ids[order], f[order], at[order]
        start = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
        return pa.RecordBatch.from_arrays([pa.array(ids[start]), pa.array(np.add.reduceat(f * one[at], start)), pa.array(np.add.reduceat(f * all_[at], start))], names=["id", "n_values", "n"])

    def collect(batches):
        now, parts = None, {False: [], True: []}
        for batch in batches:
            for part, ask, rows in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if part != now:
                    out = count_up(parts)
                    if out is not None:
                        yield out
                    now, parts = part, {False: [], True: []}
                parts[ask].append(rows)
        out = count_up(parts)
        if out is not None:
            yield out

    kind = "part long, ask boolean, rows binary"
    sent = known.mapInArrow(pack(True), kind).unionByName(tokens.mapInArrow(pack(False), kind))
    return sent.repartition("part").sortWithinPartitions("part").mapInArrow(collect, "id long, n_values long, n long")


def _staged(df: DataFrame) -> DataFrame:
    """df, computed once: in the folder that driver and executors share, or in a local session's own storage."""
    root = df.sparkSession.conf.get("spark.checkpoint.dir", None)
    if not root:
        return df.localCheckpoint()
    path = f"{root.rstrip('/')}/fuzzy-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _near(lengths: list[int], others: list[int], c: Column) -> Column:
    """Whether a length has one or two more or less among the others."""
    return F.length(c).isin([n for n in lengths if any(abs(n - m) in (1, 2) for m in others)])


def _other_lengths(a: DataFrame, b: DataFrame, long: list[int], seen: list[int]) -> DataFrame | None:
    """Distinct pairs of values and tokens of different lengths, of which long and seen are all."""
    found = []
    if any(m < n for n in long for m in seen):
        fit = F.filter(F.array(*map(F.lit, [m for m in seen if m < long[-1]])), lambda m: m < F.length("a"))
        inner = a.select("a", F.explode(fit).alias("n")).select("a", F.explode(phi._parts(F.col("a"), F.col("n"))).alias("b"))
        found.append(inner.join(b.hint("merge"), "b", "left_semi").select("a", "b"))
    if any(n < m for n in long for m in seen):
        fit = F.filter(F.array(*map(F.lit, long)), lambda n: n < F.length("b"))
        outer = b.select("b", F.explode(fit).alias("n")).select("b", F.explode(phi._parts(F.col("b"), F.col("n"))).alias("a"))
        found.append(outer.join(a.hint("merge"), "a", "left_semi").select("a", "b"))
    if any(abs(n - m) in (1, 2) for n in long for m in seen):
        near = b.where(_near(seen, long, F.col("b"))).select("b", F.explode(phi._neighbourhood(F.col("b"))).alias("key"))
        near = a.where(_near(long, seen, F.col("a"))).select("a", F.explode(phi._neighbourhood(F.col("a"))).alias("key")).join(near.hint("merge"), "key").select("a", "b")
        found.append(near.where(F.abs(F.length("a") - F.length("b")).isin(1, 2)))
    if not found:
        return None
    every = found[0]
    for x in found[1:]:
        every = every.unionByName(x)
    return every.where(phi.fuzzy(F.col("a"), F.col("b"))).distinct()


def fuzzy_counts(known: DataFrame, tokens: DataFrame) -> DataFrame:
    """(a, n_values, n): for the distinct values a of known that have any, how many distinct tokens b are fuzzily like it,
    and the sum of their n. tokens: (b, n), each b once. Values are told apart by 64 bits, keys by 128."""
    known = _staged(known.select("a").where("a is not null").distinct())
    tokens = _staged(tokens.select("b", F.col("n").cast("long").alias("n")).where("b is not null"))
    lengths = lambda df, c: sorted(r[0] for r in df.select(F.length(c)).distinct().collect())  # noqa: E731  (a row for each length)
    sizes, seen = lengths(known, "a"), lengths(tokens, "b")
    keyed = known.select(F.xxhash64("a").alias("id"), "a")
    same = _same_length(keyed.select("id", F.col("a").alias("v")), tokens.select(F.col("b").alias("v"), "n"), sorted(set(sizes) & set(seen)))
    long, seen = [n for n in sizes if n >= 4], [n for n in seen if n >= 4]
    pairs = _other_lengths(known.where(F.length("a") >= 4), tokens.where(F.length("b") >= 4).select("b"), long, seen)
    if pairs is not None:
        each = pairs.join(tokens.hint("merge"), "b").select(F.xxhash64("a").alias("id"), F.lit(1).cast("long").alias("n_values"), "n")
        same = same.unionByName(each)
    total = same.groupBy("id").agg(F.sum("n_values").alias("n_values"), F.sum("n").alias("n")).where("n_values > 0")
    return keyed.join(total.hint("merge"), "id").select("a", "n_values", "n")
