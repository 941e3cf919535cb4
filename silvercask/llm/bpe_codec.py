"""BPE encoding by backtracking over Aho-Corasick matches, and decoding by an offset table.

For each pre-token an Aho-Corasick automaton gives the longest token at every place. The encoder takes the longest
match that is compatible with the token before it, falls back to the token's longest proper prefix that is a token,
and steps back one token where nothing fits; each place is given up at most once, so the time is linear. Two tokens
are compatible if BPE, run on both together, would leave exactly these two; this is decided by undoing their merges
from the last one on, and remembered in a table. The result is exactly that of applying the merges by rank.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from itertools import chain

import ahocorasick
import numpy as np
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession

from .arrow import map_texts
from .common import documents, texts
from .token_counts import KNOWN, KNOWN_CHARS, byte_symbols

#: Pairs of tokens whose compatibility each Python worker remembers.
PAIRS = 1_000_000


class Codec:
    """Encodes and decodes as the tokenizers library does for a file of lower-case word BPE with word ends."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            j = json.load(f)
        vocab, end = j["model"]["vocab"], j["model"]["end_of_word_suffix"]
        marks, self.n = byte_symbols(), 1 + max([*vocab.values(), *(t["id"] for t in j["added_tokens"])])
        place = {m: b for b, m in enumerate(marks)}
        # A token as a string over 512 letters: byte b inside a word is b, as the word's last byte it is 256 + b.
        self.units: list[str] = [""] * self.n
        for token, i in vocab.items():
            last = token.endswith(end) and len(token) > len(end)
            units = [place[c] for c in (token[: -len(end)] if last else token)]
            self.units[i] = "".join(map(chr, units[:-1])) + chr(units[-1] + 256 * last)
        self.split = {i: (i, i) for i in vocab.values()}
        self.merged: dict[tuple[int, int], int] = {}
        self.rank = {i: -1 for i in vocab.values()}
        for r, m in enumerate(j["model"]["merges"]):
            a, b = (vocab[x] for x in (m if isinstance(m, list) else m.split(" ")))
            c = vocab[(m[0] + m[1]) if isinstance(m, list) else m.replace(" ", "")]
            if self.rank[c] < 0:
                self.rank[c], self.split[c], self.merged[a, b] = r, (a, b), c
        auto = ahocorasick.Automaton()
        for i in vocab.values():
            auto.add_word(self.units[i], i)
        auto.make_automaton()
        self.auto, ids = auto, {self.units[i]: i for i in vocab.values()}
        self.shorter = {i: next((ids[u[:k]] for k in range(len(u) - 1, 0, -1) if u[:k] in ids), None) for u, i in ids.items()}
        self.size = [len(u) for u in self.units]
        self.special = {t["content"]: t["id"] for t in j["added_tokens"]}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.pattern = regex.compile(j["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        names = {i: s for s, i in [*vocab.items(), *self.special.items()]}
        data = [f"{names.get(i, '')} ".encode() for i in range(self.n)]
        self.offsets = np.cumsum([0, *map(len, data)])
        self.buffer = np.frombuffer(b"".join(data), np.uint8)
        self.fits: dict[tuple[int, int], bool] = {}
        self.known: dict[str, tuple[int, ...]] = {}

    def compatible(self, a: int, b: int) -> bool:
        """Whether no merge across the border of a and b comes before the merges that make a and b."""
        if len(self.fits) >= PAIRS:
            self.fits.clear()
        found = self.fits[a, b] = self._compatible(a, b)
        return found

    def _compatible(self, a: int, b: int) -> bool:
        rank, split, merged = self.rank, self.split, self.merged
        limit = len(rank) + 1  # ranks from here on cannot happen any more
        while True:
            c = merged.get((a, b))
            if c is not None and rank[c] < limit:
                return False
            # Undo the later of the two merges. Equal tokens: the left one is made first, so undo the right one first.
            if rank[a] > rank[b]:
                limit, a = rank[a], split[a][1]
            elif rank[b] >= 0:
                limit, b = rank[b] + 1, split[b][0]
            else:
                return True

    def word(self, pre: str) -> tuple[int, ...]:
        data = pre.encode()
        text = "".join(map(chr, data[:-1])) + chr(data[-1] + 256)
        size, shorter, fits = self.size, self.shorter, self.fits
        longest = [0] * len(text)
        for stop, i in self.auto.iter(text):  # by their ends, so the last match from a place is its longest
            longest[stop + 1 - size[i]] = i
        out: list[int] = []
        at, dead, token, n, last = 0, set(), longest[0], len(text), None
        while at < n:
            stop = at + size[token]
            ok = last is None or fits.get((last, token))
            if ok is None:
                ok = self.compatible(last, token)
            if ok and stop not in dead:
                out.append(token)
                at, last = stop, token
                token = longest[at] if at < n else 0
            elif shorter[token] is not None:
                token = shorter[token]
            else:
                dead.add(at)
                token = out.pop()
                at -= size[token]
                last = out[-1] if out else None
        return tuple(out)

    def pretokens(self, text: str) -> list[str]:
        """Normalised as the file says. Its replacement of white space changes no match, and so is left out."""
        t = unicodedata.normalize("NFC", text) if not text.isascii() else text
        return self.pattern.findall(t.replace("Σ", "σ").lower())  # a final sigma gets no form of its own

    def encode(self, text: str) -> list[int]:
        known, out = self.known, []
        for k, part in enumerate(self.cut.split(text)):
            if k % 2:
                out.append(self.special[part])
                continue
            pre = self.pretokens(part)
            new = [w for w in set(pre) if w not in known]
            if len(known) + len(new) > KNOWN:
                known.clear()
                new = list(set(pre))
            for w in new:
                known[w] = self.word(w)
            out.extend(chain.from_iterable(map(known.__getitem__, pre)))
            for w in new:
                if len(w) > KNOWN_CHARS:
                    del known[w]
        return out

    def decode(self, ids: list[int]) -> bytes:
        """The tokens' strings with one space between them, gathered from the buffer of all tokens."""
        if not ids:
            return b""
        i = np.asarray(ids, np.int64)
        starts, lens = self.offsets[i], self.offsets[i + 1] - self.offsets[i]
        step = np.ones(int(lens.sum()), np.int64)
        step[0] = starts[0]
        step[np.cumsum(lens)[:-1]] = starts[1:] - (starts[:-1] + lens[:-1] - 1)
        return self.buffer[np.cumsum(step)[:-1]].tobytes()


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, ids array<int>, decoded string. Null text counts as empty: no ids, ''. Rows that
    repeat a doc_id are encoded one by one; an empty table gives an empty result; other columns of docs are not read."""

    def work(ids, texts_):
        c = codec(path)
        found = [c.encode(t) for t in texts_]
        return [ids, found, [c.decode(x).decode() for x in found]]

    return map_texts(texts(docs, id_col, text_col), work, "doc_id long, ids array<int>, decoded string")


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As encode(), but hashes in place of ids and decoded text, so that neither leaves the Python worker; nulls, repeats
    and empty tables as there."""

    def work(ids, texts_):
        c = codec(path)
        n, a, b = [], [], []
        for t in texts_:
            found = c.encode(t)
            n.append(len(found))
            a.append(hashlib.sha256(" ".join(map(str, found)).encode()).hexdigest())
            b.append(hashlib.sha256(c.decode(found)).hexdigest())
        return [ids, n, a, b]

    return map_texts(texts(docs, id_col, text_col), work, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op8_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """digests() over documents: null and empty texts have no ids, and decode to an empty text."""
    return digests(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
