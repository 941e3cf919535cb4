"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes.

The patterns give the base spans. The model is trained on the driver from the small labelled table and decoded by
Viterbi in numpy batches, a line of text being a sequence; it adds spans of its own kinds (local phone numbers
without a country code, social security numbers, secrets) where no base span lies.
"""

from __future__ import annotations

import hashlib
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession

from .arrow import map_texts, portions, trim
from .common import WORD, documents, texts
from .pii_labelled import LABELLED

BASE = ("email", "ip", "card", "phone")
ADDED = ("local_phone", "ssn", "secret")
ORDER = {k: i for i, k in enumerate((*BASE, *ADDED))}
Span = tuple[int, int, str]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match can only begin where a run of digits does, so long runs are looked at once.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WORD = re.compile(WORD)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def _emails(text: str) -> list[Span]:
    """From each @ to both sides, so that a long run without one costs nothing."""
    found, end, at = [], 0, text.find("@")
    while at >= 0:
        left = at
        while left > end and text[left - 1] in _LOCAL:
            left -= 1
        m = _DOMAIN.match(text, at + 1) if left < at else None
        if m:
            end = m.end()
            found.append((left, end, "email"))
        at = text.find("@", max(at + 1, end))
    return found


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind, those that fail their check dropped; by start, then kind."""
    found = _emails(text)
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in m[0].split("."))):
            found.append((*m.span(), "ip"))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((*m.span(), "card"))
    for m in _PHONE.finditer(text) if "+" in text else ():
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            found.append((*m.span(), "phone"))
    return sorted(found, key=lambda s: (s[0], ORDER[s[2]]))


class _Shapes(dict):
    def __missing__(self, code: int) -> str:
        c = chr(code)
        self[code] = s = "d" if "0" <= c <= "9" else "X" if c.isupper() else "x" if c.islower() else "-" if c.isalpha() else c
        return s


_SHAPES = _Shapes()


def shape(word: str) -> str:
    """X for upper case, x for lower case, d for a digit, - for all else that is a letter, and marks as they are."""
    return word[:48].translate(_SHAPES)


def own_features(word: str) -> list[str]:
    s = shape(word)
    short = re.sub(r"(.)\1+", r"\1+", s)
    digits, hexes = s.count("d"), sum(c in "0123456789abcdef" for c in word[:48])
    mixed = "d" in s and ("x" in s or "X" in s)
    return ["s:" + s[:24], "c:" + short[:24], f"d:{min(digits, 12)}", f"l:{min(len(word), 48) // 6}", f"m:{mixed}:{min(len(word), 48) // 8}", f"h:{hexes >= 0.8 * min(len(word), 48) and mixed}", "w:" + word.lower()[:24], "k:" + re.split(r"[=:]", word.lower())[0][:16] + "=" if "=" in word else "k:-"]


def near_features(word: str) -> list[str]:
    return ["w:" + word.lower().strip('.,;:"')[:24], "c:" + re.sub(r"(.)\1+", r"\1+", shape(word))[:12]]


class Crf:
    """Weights by feature for a word itself, the one before and the one after it, and for pairs of labels."""

    labels = ("", *ADDED)

    def __init__(self, tables: list[dict[str, np.ndarray]], pairs: np.ndarray):
        self.tables, self.pairs = tables, pairs
        self.known: dict[str, int] = {}
        self.alike: dict[tuple, np.ndarray] = {}
        self.rows = np.zeros((3, 1024, len(self.labels)))

    @classmethod
    def train(cls, table: str = LABELLED, rounds: int = 250, rate: float = 0.15, decay: float = 0.02) -> Crf:
        """Maximum likelihood with a squared penalty, by Adam on all sentences at once (forward-backward in numpy)."""
        sents = []
        for line in filter(None, map(str.strip, table.splitlines())):
            words, tags = [], []
            for kind, marked, plain in re.findall(r"\[(\w+) ([^\]]+)\]|([^\s\[]+)", line):
                for w in (marked or plain).split():
                    words.append(w)
                    tags.append(cls.labels.index(kind))
            sents.append((words, tags))
        names: list[dict[str, int]] = [{}, {}, {}]
        place = lambda k, f: names[k].setdefault(f, len(names[k]))
        lines = [[[[place(0, f) for f in own_features(w)], [place(1, f) for f in near_features(ws[i - 1])] if i else [], [place(2, f) for f in near_features(ws[i + 1])] if i + 1 < len(ws) else []] for i, w in enumerate(ws)] for ws, _ in sents]
        n, most = len(cls.labels), max(len(x) for x in lines)
        theta = [np.zeros((len(d), n)) for d in names] + [np.zeros((n, n))]
        m, v = [np.zeros_like(x) for x in theta], [np.zeros_like(x) for x in theta]
        mask = np.array([[i < len(x) for i in range(most)] for x in lines])
        gold = np.array([[t[i] if i < len(t) else 0 for i in range(most)] for _, t in sents])
        flat = [[(s, i, f) for s, x in enumerate(lines) for i, fs in enumerate(x) for f in fs[k]] for k in range(3)]
        flat = [tuple(np.array(x).T) for x in flat]
        for step in range(1, rounds + 1):
            emit = np.zeros((len(lines), most, n))
            for k in range(3):
                np.add.at(emit, flat[k][:2], theta[k][flat[k][2]])
            fwd, bwd, t = emit.copy(), np.zeros_like(emit), theta[3]
            for i in range(1, most):
                fwd[:, i] += np.logaddexp.reduce(fwd[:, i - 1, :, None] + t, axis=1)
            last = mask.sum(1) - 1
            for i in range(most - 2, -1, -1):
                inner = np.logaddexp.reduce(t + (emit[:, i + 1] + bwd[:, i + 1])[:, None, :], axis=2)
                bwd[:, i] = np.where((i < last)[:, None], inner, 0)
            z = np.logaddexp.reduce(fwd[np.arange(len(lines)), last], axis=1)
            node = (np.exp(fwd + bwd - z[:, None, None]) - np.eye(n)[gold]) * mask[:, :, None]
            edge = np.exp(fwd[:, :-1, :, None] + t + (emit + bwd)[:, 1:, None, :] - z[:, None, None, None]) * mask[:, 1:, None, None]
            grads = [np.zeros_like(x) for x in theta]
            for k in range(3):
                np.add.at(grads[k], flat[k][2], node[flat[k][0], flat[k][1]])
            grads[3] = edge.sum((0, 1))
            np.add.at(grads[3], (gold[:, :-1][mask[:, 1:]], gold[:, 1:][mask[:, 1:]]), -1)
            for k, g in enumerate(grads):
                g = g + decay * theta[k]
                m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                theta[k] = theta[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        return cls([{f: theta[k][i] for f, i in names[k].items()} for k in range(3)], theta[3])

    def index(self, word: str) -> int:
        """The row of the word's emission weights; words are forgotten when there are too many."""
        i = len(self.known)
        if i == self.rows.shape[1]:
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)], axis=1)
        s, low, key = shape(word), word.lower()[:24], None
        if "d" not in s and "=" not in word:  # then only these decide: most words share their weights with others
            bare = word.lower().strip('.,;:"')[:24]
            key = (s, len(word) if len(word) > 47 else 0, low if "w:" + low in self.tables[0] else "", bare if "w:" + bare in self.tables[1] or "w:" + bare in self.tables[2] else "")
        found = self.alike.get(key)
        if found is None:
            none, near = np.zeros(len(self.labels)), near_features(word)
            found = np.array([sum((self.tables[k].get(f, none) for f in fs), none) for k, fs in enumerate((own_features(word), near, near))])
            if key and len(self.alike) < 30_000:
                self.alike[key] = found
        self.rows[:, i] = found
        self.known[word] = i
        return i

    def decode(self, lines: list[list[str]]) -> list[np.ndarray]:
        """The most probable labels of each line's words, all lines at once, the longest first."""
        if len(self.known) > 100_000:
            self.known, self.rows = {}, np.zeros((3, 1024, len(self.labels)))
        known = self.known
        lens = np.array([len(x) for x in lines])
        every = list(chain.from_iterable(lines))
        for w in set(every):
            if w not in known:
                self.index(w)
        ids = np.fromiter(map(known.__getitem__, every), np.int64, len(every))
        emit = self.rows[0][ids]
        ends = np.cumsum(lens)
        inner = np.ones(len(ids), bool)
        inner[(ends - lens)[lens > 0]] = False
        after = np.flatnonzero(inner)
        emit[after] += self.rows[1][ids[after - 1]]
        emit[after - 1] += self.rows[2][ids[after]]
        order = np.argsort(-lens, kind="stable")
        starts, sizes = (ends - lens)[order], lens[order]
        alive = np.searchsorted(-sizes, -np.arange(1, sizes[0] + 1 if len(sizes) else 1), "right") if len(sizes) else []
        back = np.zeros(emit.shape, np.int8)
        score, pairs = emit[starts[: alive[0]]] if len(alive) else emit, self.pairs.T[None]
        final = np.zeros(len(lines), np.int64)
        for i in range(1, len(alive)):
            n = alive[i]
            if n < len(score):
                final[n : len(score)] = score[n:].argmax(1)
                score = score[:n]
            step = score[:, None, :] + pairs
            best = step.argmax(2)
            at = starts[:n] + i
            back[at] = best
            score = np.take_along_axis(step, best[:, :, None], 2)[:, :, 0] + emit[at]
        if len(alive):
            final[: len(score)] = score.argmax(1)
        out = np.zeros(len(ids), np.int64)
        cur = final
        for i in range(len(alive) - 1, -1, -1):
            n = alive[i]
            at = starts[:n] + i
            out[at] = cur[:n]
            cur[:n] = back[at, cur[:n]]
        return np.split(out, ends[:-1]) if len(lens) else []


def added_spans(model: Crf, texts_: list[str]) -> list[list[Span]]:
    """The model's spans of each text: runs of words with one label, without marks at their ends."""
    lines, owner = [], []
    for k, t in enumerate(texts_):
        at = 0
        for line in t.split("\n"):
            if words := _WORD.findall(line):
                lines.append(words)
                owner.append((k, at, line))
            at += len(line) + 1
    found: list[list[Span]] = [[] for _ in texts_]
    for (k, at, line), tags in zip(owner, model.decode(lines)):
        if not tags.any():
            continue
        places, i = [m.span() for m in _WORD.finditer(line)], 0
        while i < len(tags):
            j = i
            while j + 1 < len(tags) and tags[j + 1] == tags[i]:
                j += 1
            if tags[i]:
                a, b = places[i][0], places[j][1]
                while a < b and line[a] in "\"'([<{,;:":
                    a += 1
                while a < b and line[b - 1] in "\"')]>},;:.!?":
                    b -= 1
                a -= line[a - 1 : a] == "(" and ")" in line[a:b]
                if a < b and any(c.isdigit() for c in line[a:b]):
                    found[k].append((at + a, at + b, model.labels[tags[i]]))
            i = j + 1
    return found


def spans(model: Crf, texts_: list[str]) -> list[tuple[list[Span], list[Span]]]:
    """(base spans, all spans) of each text; an added span that touches a base span is left out."""
    out = []
    for t, added in zip(texts_, added_spans(model, texts_)):
        base = base_spans(t)
        extra = [s for s in added if not any(s[0] < e and b < s[1] for b, e, _ in base)] if base else added
        out.append((base, sorted(base + extra, key=lambda s: (s[0], ORDER[s[2]]))))
    return out


def _joined(found: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in found)


def find(docs: DataFrame, model: Crf | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, counts of the base kinds, base_sha256, spans (code points, end exclusive).

    Null text counts as empty and has no spans. Spans of different kinds may overlap. No shuffle.
    """
    model = model or Crf.train()

    def work(ids, texts_):
        found = spans(model, texts_)
        n = [[sum(s[2] == k for s in base) for base, _ in found] for k in BASE]
        return [ids, *n, [hashlib.sha256(_joined(base).encode()).hexdigest() for base, _ in found], [_joined(every) for _, every in found]]

    return map_texts(texts(docs, id_col, text_col), work, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redact(text: str, found: list[Span]) -> str:
    """The text with each span replaced by its kind in brackets; of overlapping spans, the first takes the rest in."""
    out, at = [], 0
    for a, b, kind in found:
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redacted_rows(docs: DataFrame, model: Crf | None = None, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, with the text without personal data; a null text stays null. No shuffle.

    Rows go out a portion at a time, so a batch of Spark's is held once and never beside a whole batch of new texts.
    """
    model = model or Crf.train()
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            for nth, texts_ in portions(pa.RecordBatch.from_arrays([pa.array(range(batch.num_rows)), batch.column(at).fill_null("")], names=["i", "t"])):
                part = batch.slice(nth[0], len(nth))
                none = part.column(at).is_null().to_numpy(zero_copy_only=False)
                new = pa.array([redact(t, every) for t, (_, every) in zip(texts_, spans(model, texts_))], pa.string(), mask=none)
                yield pa.RecordBatch.from_arrays([new if i == at else c for i, c in enumerate(part.columns)], names=batch.schema.names)
        trim()

    return docs.mapInArrow(run, docs.schema)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """find() over documents: null and empty texts have no spans, rows that repeat an id are answered one by one."""
    return find(documents(spark, sf_dir))
