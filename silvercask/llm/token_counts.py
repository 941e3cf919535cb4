"""Token counts by rank-synchronous merging of ragged numpy arrays.

Pre-tokens are cut by the tokenizer's pattern. All pre-tokens of a portion that are not known yet form one flat
array of symbols with sequence offsets; in each round every sequence applies its lowest-rank pair, at all its
places at once (of overlapping places the left ones). That equals merging one by one, because a merge can only make
pairs of a higher rank than its own. Sequences without a pair retire; a count is the symbols that survive.
"""

from __future__ import annotations

import json

import numpy as np
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession

from .arrow import map_texts
from .common import documents, texts

#: Pre-tokens kept with their counts in each Python worker, and the longest of them.
KNOWN, KNOWN_CHARS = 400_000, 40


def byte_symbols() -> list[str]:
    """The printable character that byte-level vocabularies use for each byte: itself where printable, else from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(spare)) for b in range(256)]


class MergeTable:
    """Pairs of symbol ids with the rank and the result of their merge, in an open-addressed table."""

    def __init__(self, merges: list[tuple[int, int, int]]):
        self.bits = max(4, (4 * len(merges)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.rank = np.full(1 << self.bits, np.iinfo(np.int32).max, np.int32)
        self.into = np.zeros(1 << self.bits, np.int32)
        todo = np.arange(len(merges))
        a, b, c = (np.array([m[i] for m in merges], np.int64) for i in range(3))
        key = a << 32 | b
        slot = self._slot(key)
        self.probes = 0
        while len(todo):  # each free slot takes one of those that want it; the rest go on to the next
            self.probes += 1
            free = self.keys[slot[todo]] < 0
            taken, first = np.unique(slot[todo[free]], return_index=True)
            won = todo[free][first]
            self.keys[taken], self.rank[taken], self.into[taken] = key[won], won, c[won]
            todo = np.setdiff1d(todo, won, assume_unique=True)
            slot[todo] = slot[todo] + 1 & (1 << self.bits) - 1

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Slots of the pairs, and whether each is there."""
        key = a.astype(np.int64) << 32 | b
        slot = self._slot(key)
        open_ = np.flatnonzero(self.keys[slot] != key)
        for _ in range(self.probes - 1):
            open_ = open_[self.keys[slot[open_]] >= 0]
            if not len(open_):
                break
            slot[open_] = slot[open_] + 1 & (1 << self.bits) - 1
            open_ = open_[self.keys[slot[open_]] != key[open_]]
        return slot, self.keys[slot] == key


def merge_all(symbols: np.ndarray, lengths: np.ndarray, table: MergeTable) -> np.ndarray:
    """How many symbols survive of each sequence; symbols holds the sequences one after the other."""
    left = lengths.astype(np.int64).copy()
    own = np.arange(len(lengths))
    top = np.iinfo(np.int32).max
    own, lens = own[lengths > 1], left[lengths > 1]
    sym = symbols[np.repeat(lengths > 1, lengths)]
    while len(own):
        ends = np.cumsum(lens)
        slot, there = table.find(sym[:-1], sym[1:])
        rank = np.full(len(sym), top, np.int32)
        rank[:-1][there] = table.rank[slot[there]]
        rank[ends - 1] = top
        low = np.minimum.reduceat(rank, ends - lens)
        hit = (rank == np.repeat(low, lens)) & (rank < top)
        at = np.flatnonzero(hit)
        if len(at) > 1:  # of places that overlap (runs of one symbol), take every other one from the left
            start = np.r_[True, np.diff(at) > 1]
            run = np.flatnonzero(start)
            at = at[(np.arange(len(at)) - run[np.cumsum(start) - 1]) % 2 == 0]
        sym[at] = table.into[slot[at]]
        stay = np.ones(len(sym), bool)
        stay[at + 1] = False
        lens = np.add.reduceat(stay.astype(np.int64), ends - lens)
        left[own] = lens
        go = (low < top) & (lens > 1)
        sym = sym[stay][np.repeat(go, lens)[: int(stay.sum())]]
        own, lens = own[go], lens[go]
    return left


class Counter:
    """Counts tokens as the tokenizers library does for a byte-level BPE file: without begin or end tokens; strings of
    its special tokens inside a text are such tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            j = json.load(f)
        vocab = j["model"]["vocab"]
        self.first = np.array([vocab[s] for s in byte_symbols()], np.int32)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in j["model"]["merges"]]
        self.table = MergeTable([(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs])
        special = [regex.escape(t["content"]) for t in j["added_tokens"]]
        self.special = regex.compile("|".join(sorted(special, key=len, reverse=True)) or r"(?!)")
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.known: dict[str, int] = {}

    def learn(self, new: list[str]) -> dict[str, int]:
        if not new:
            return {}
        data = [s.encode() for s in new]
        lens = np.array([len(b) for b in data], np.int64)
        return dict(zip(new, merge_all(self.first[np.frombuffer(b"".join(data), np.uint8)], lens, self.table).tolist()))

    def counts(self, texts: list[str]) -> list[int]:
        cut, n = [], []
        for t in texts:
            parts = self.special.split(t)
            cut.append([x for p in parts for x in self.pattern.findall(p)])
            n.append(len(parts) - 1)
        distinct, known = set().union(*cut), self.known
        new = [x for x in distinct if x not in known]
        if len(known) + len(new) > KNOWN:
            known.clear()
            new = list(distinct)
        known.update(self.learn(new))
        out = [k + sum(map(known.__getitem__, c)) for k, c in zip(n, cut)]
        for x in new:
            if len(x) > KNOWN_CHARS:
                del known[x]
        return out


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def token_counts(docs: DataFrame, path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    Null text counts as empty: no bytes, no tokens. No shuffle; other columns of docs are not read.
    """

    def work(ids, texts_):
        n = counter(path).counts(texts_)
        return [ids, [len(t.encode()) for t in texts_], n, [x > limit for x in n]]

    return map_texts(texts(docs, id_col, text_col), work, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """token_counts() over documents: null and empty texts have no tokens, repeated rows are counted one by one."""
    return token_counts(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
