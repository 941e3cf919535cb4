"""The llm operators against brute force on small tables with nulls, empty texts, ties, copies and clashing columns."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest

from silvercask.llm import bpe_codec, exact_dedup, ngram_join, packing, paragraphs, pii, quality, recurrent, repeats, token_counts
from silvercask.llm.shingles import words

SCHEMA = "doc_id long, text string, least string, n long, h long, spans string"
W = r"[^\x20\x09-\x0D]+"


def table(spark, rows):
    """Extra columns carry names that operators use inside."""
    return spark.createDataFrame([(i, t, "x", 1, 2, None) for i, t in rows], SCHEMA).repartition(3)


def rows(seed=5, n=80):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdeé", k=rng.randint(1, 6))) for _ in range(200)]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randint(0, 150))) + "." for _ in range(n // 2)]
    while len(texts) < n:
        w = rng.choice(texts).split(" ")
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        texts.append(rng.choice((" ", " ", "\n")).join(w))
    texts += ["", None, " \t\n", "a", "a b c", "a b c", "x" * 500, "x" * 400, "Mail a.b@c.de +1 (555) 123-4567 <|endoftext|>"]
    ids = rng.sample(range(10**6), len(texts))
    return list(zip(ids, texts))


DATA = rows()
BY_ID = {i: t or "" for i, t in DATA}


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, DATA)


def find(links, ids):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def test_exact(docs):
    norm = {i: re.sub(r"[\x20\x09-\x0D]+", " ", t) for i, t in BY_ID.items()}
    groups = collections.defaultdict(list)
    for i, t in norm.items():
        groups[t].append(i)
    for got in (exact_dedup.exact_dedup(docs), exact_dedup.exact_dedup(docs, _identifier=lambda c: c.substr(1, 1).cast("binary"))):
        assert {(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got.collect()} == {(i, min(groups[t]), len(groups[t]), i == min(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in norm.items()}


def test_quality(docs):
    for r in quality.quality(docs).collect():
        t = BY_ID[r.doc_id]
        w = re.findall(W, t)
        seen, marked = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7)), set()
        for i in range(len(w) - 7):
            marked |= set(range(i, i + 8)) if seen[tuple(w[i : i + 8])] > 1 else set()
        lines = [x for x in t.split("\n") if re.search(W, x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(marked))
        assert r.base_failed == (len(w) < 20 or 100 * len(marked) > 30 * len(w)) and not (r.base_failed and r.kept)


def least_of(data, width):
    least = {}
    for i in sorted(data):
        b = data[i].encode()
        for a in range(len(b) - width + 1):
            least.setdefault(b[a : a + width], i)
    return least


@pytest.mark.parametrize("crowd", [2, 20_000])
def test_repeats(docs, crowd, monkeypatch):
    monkeypatch.setattr(repeats, "CROWD", crowd)
    least = least_of(BY_ID, 50)
    for r in repeats.remove_repeats(docs, digest=True).collect():
        b = BY_ID[r.doc_id].encode()
        gone = bytearray(len(b))
        for a in range(len(b) - 49):
            if least[b[a : a + 50]] < r.doc_id:
                gone[a : a + 50] = b"\1" * 50
        kept = bytes(x for x, y in zip(b, gone) if not y)
        assert (r.n_bytes, r.n_removed, r.kept_sha256) == (len(b), sum(gone), hashlib.sha256(kept).hexdigest())


@pytest.mark.parametrize("cell", [3, 4096])
def test_jaccard(docs, cell, monkeypatch):
    monkeypatch.setattr(ngram_join, "CELL", cell)
    monkeypatch.setattr(ngram_join, "FINE", 20)
    sets = {}
    for i, t in BY_ID.items():
        w = words(t)
        sets[i] = {tuple(w[a : a + 4]) for a in range(max(1, len(w) - 3))} if w else set()
    ids = sorted(sets)
    want = find([(a, b) for a in ids for b in ids if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])], ids)
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.jaccard_classes(docs).collect()} == {(i, len(sets[i]), want[i]) for i in ids}


def test_paragraphs(docs):
    got = {r.doc_id: r for r in paragraphs.paragraph_report(docs).collect()}
    assert set(got) == set(BY_ID)
    sets = {}
    for i, t in BY_ID.items():
        parts = paragraphs.paragraphs(t, 60)
        assert "".join(parts) == t
        for k, p in enumerate(parts):
            if len(w := words(p)) >= 10:
                sets[i, k] = {tuple(w[a : a + 5]) for a in range(len(w) - 4)}
    ids = sorted(sets)
    want = find([(a, b) for a in ids for b in ids if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])], ids)
    gone, mine = {p for p in ids if want[p] != p}, {(i, k) for i, r in got.items() for k in r.removed}
    assert mine <= gone and len(mine) >= 0.95 * len(gone)


def test_tokenizers(docs):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    ref = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    assert {(r.doc_id, r.n_tokens) for r in token_counts.token_counts(docs, P.path("byte_bpe_50k.json")).collect()} == {(i, len(ref.encode(t, add_special_tokens=False).ids)) for i, t in BY_ID.items()}
    ref = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    for r in bpe_codec.encode(docs, P.path("word_bpe_49k.json")).collect():
        ids = ref.encode(BY_ID[r.doc_id], add_special_tokens=False).ids
        assert r.ids == ids and r.decoded == ref.decode(ids, skip_special_tokens=False)


def test_packing(docs):
    import public_tokenizers as P

    seen = collections.defaultdict(list)
    for r in packing.pack(docs, P.path("byte_bpe_50k.json"), size=64).collect():
        seen[r.sequence_id].append((r.offset, r.length))
    for places in seen.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    rng = random.Random(3)
    for _ in range(100):
        counts = collections.Counter(rng.randint(1, 40) for _ in range(rng.randint(0, 80)))
        used, bins = collections.Counter(), 0
        for n, items in packing.solve(dict(counts), 40):
            assert n > 0 and sum(a * k for a, k in items) <= 40
            bins += n
            for a, k in items:
                used[a] += n * k
        assert used == counts and bins <= sum(n for n, _ in packing.best_fit(dict(counts), 40))


def test_pii():
    model = pii.Crf.train()
    text = "call (555) 123-4567 or a.b@c.de at 1.2.3.4, 4111 1111 1111 1111 or +1 (555) 123-4567\nssn 123-45-6789 and\npassword=e3b3ed3cc8548923d6"
    (base, every), (none, nothing) = pii.spans(model, [text, ""])
    assert [k for _, _, k in base] == ["email", "ip", "card", "phone"] and not none and not nothing
    assert {k for _, _, k in every} == {"email", "ip", "card", "phone", "local_phone", "ssn", "secret"}
    assert "c.de" not in pii.redact(text, every)


def test_recurrent(docs):
    import math
    import zlib

    got = recurrent.language_model_scores(docs, vocabulary=50, table=60, hidden=4).collect()
    tokens = {i: [*words(t), b"\n"] for i, t in BY_ID.items()}
    c = collections.Counter(w for i, ws in tokens.items() if zlib.crc32(str(i).encode()) % 10 for w in ws)
    n, v = sum(c.values()), len(c)
    for r in got:
        ws = tokens[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws), sum(c[w] > 0 for w in ws), n)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), rel_tol=1e-9)
        assert r.score < 0


def test_empty_tables(spark):
    import public_tokenizers as P

    none = table(spark, [])
    path = P.path("byte_bpe_50k.json")
    for f in (exact_dedup.exact_dedup, quality.quality, repeats.remove_repeats, ngram_join.jaccard_classes, paragraphs.paragraph_report, pii.find, recurrent.language_model_scores, lambda d: token_counts.token_counts(d, path), lambda d: packing.pack(d, path)):
        assert f(none).count() == 0


def test_similar_by_shared_shingles():
    """The shared shingles of two sets decide as the whole sets do."""
    rng = np.random.default_rng(3)
    for shared in (0, 900, 918, 919, 920, 925, 940, 1000):
        x = np.unique(rng.integers(0, 1 << 63, 1000, dtype=np.uint64) << np.uint64(1))
        y = np.unique(np.concatenate([x[:shared], rng.integers(0, 1 << 63, 1000 - shared, dtype=np.uint64) << np.uint64(1)]))
        both = np.intersect1d(x, y)
        truth = 100 * len(both) >= 85 * len(np.union1d(x, y))
        assert ngram_join.similar(x, y, len(x), len(y), 85) == ngram_join.similar(both, both, len(x), len(y), 85) == truth


@pytest.mark.parametrize("ends", [True, False])
def test_passages_inside_lines(spark, ends):
    """Passages of 50 words are found in the middle of lines of foreign text, with sentence ends or without."""
    rng = random.Random(11)
    vocabulary = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(3000)]

    def prose(n):
        w = rng.choices(vocabulary, k=n)
        return [x + "." if ends and rng.random() < 0.08 else x for x in w]

    data = []
    for i in range(60):
        passage = prose(50)
        for copy in (0, 100):
            data.append((i + copy, " ".join(prose(rng.randint(60, 120)) + passage + prose(rng.randint(60, 120)))))
    data += [(300 + i, " ".join(prose(150))) for i in range(40)]
    docs, texts = table(spark, data), dict(data)
    report = paragraphs.paragraph_report(docs)
    got = {r.doc_id: r for r in report.collect()}
    assert all(got[i].n_removed == 0 for i in texts if i < 100 or i >= 300)
    found = [i for i in range(100, 160) if got[i].n_removed]
    assert len(found) >= 57 and all(got[i].kept_in == [i - 100] for i in found)
    for r in paragraphs.without_paragraphs(docs, report).collect():
        gone = len(texts[r.doc_id].split()) - len(r.text.split())
        assert gone >= 5 if r.doc_id in found else r.text == texts[r.doc_id]
    for t in texts.values():
        assert "".join(paragraphs.passages(t)) == t


def test_short_lines(spark):
    """Lines of 5 to 9 words are paragraphs too; lines without a five-word shingle stay."""
    lines = [" ".join(f"w{n}x{i}" for i in range(n)) for n in range(1, 12)]
    data = [(d, f"own{d} text{d} of{d} document{d} here{d} alone{d}\n" + "\n".join(lines)) for d in range(3)]
    got = {r.doc_id: r.removed for r in paragraphs.paragraph_report(table(spark, data)).collect()}
    assert got == {0: [], 1: list(range(5, 12)), 2: list(range(5, 12))}


def test_counts_of_very_large_sets(spark):
    """Group counts over 65,535 do not wrap: equal sets of millions of shingles reach the comparison of whole sets."""
    for groups, n in ((64, 5_000_000), (1024, 80_000_000)):
        v, n = np.full((2, groups), n // groups, "<u4"), np.array([n, n])
        v[:, 0] += np.uint32(n[0] - v[0].sum(dtype=np.int64))
        assert [x.tolist() for x in ngram_join.tree_pairs(v, n, 85)] == [[0], [1]]
        held = spark.createDataFrame([(i, int(n[0]), bytearray(v[0].tobytes())) for i in (1, 2)], "doc_id long, n long, vector binary")
        pairs = spark.createDataFrame([(1, 2)], "a long, b long")
        assert [tuple(r) for r in ngram_join._bounded(pairs, held, 85).collect()] == [(1, 2)]
        block = held.selectExpr("1L as s", "-1L as cell", "0L as side", "doc_id as doc", "n", "doc_id as label", "vector")
        assert [tuple(r) for r in ngram_join._block_pairs(block, 85).collect()] == [(1, 2)]
    members = np.zeros(70_000, np.uint64)  # all in one group
    assert np.frombuffer(ngram_join.vector_of(members, 64), "<u4").tolist() == [70_000] + [0] * 63


def test_very_long_texts():
    """Places go on after 2 ** 20."""
    assert len(paragraphs.paragraphs("a b\n" * ((1 << 20) + 3), 60)) == (1 << 20) + 3


def test_pipeline_keeps_clean_rows_whatever_their_id(spark):
    """Rows without an id or with one that other texts share are decided by their own text."""
    import corpus_pipeline

    rng = random.Random(4)
    vocabulary = ["".join(rng.choices("abcdefghij", k=rng.randint(3, 8))) for _ in range(800)]
    good = [" ".join(rng.choices(vocabulary, k=80)) + "." for _ in range(8)]
    near = good[5].replace(good[5].split()[40], "changed", 1)
    bad = "### *** $$$"
    data = [(None, good[0]), (None, good[1]), (None, good[1]), (1, bad), (1, good[2]), (2, good[3]), (2, good[3]), (2, good[4]), (3, good[4]), (None, good[4]), (None, bad), (7, good[5]), (6, near), (6, good[6]), (None, good[6] + " once more"), (9, good[7])]
    docs = table(spark, data)
    want = sorted(data, key=str)
    for (_, f), gone in zip(corpus_pipeline.STAGES[:3], ([(1, bad), (None, bad)], [(None, good[1]), (2, good[3]), (3, good[4]), (None, good[4])], [(7, good[5]), (None, good[6] + " once more")])):
        for x in gone:
            want.remove(x)
        docs = f(spark, docs, "")
        assert docs.columns == table(spark, []).columns
        assert sorted(((r.doc_id, r.text) for r in docs.collect()), key=str) == want


def test_recurrent_rounds_learn_on(spark):
    """Later rounds start from the averaged weights: many small tasks learn more in rounds than each alone."""
    import inspect

    found = inspect.signature(recurrent.language_model_scores).parameters
    assert found["vocabulary"].default >= 4096 and found["hidden"].default >= 16 and found["rounds"].default > 1
    rng, data = random.Random(8), []
    for i in range(800):
        at, w = rng.randrange(20), []
        for _ in range(40):
            w.append(f"w{at}")
            at = (at + 1) % 20 if rng.random() < 0.9 else rng.randrange(20)
        data.append((i, " ".join(w)))
    docs = table(spark, data).repartition(8, "doc_id")
    one, four = (sum(r.score for r in recurrent.language_model_scores(docs, hidden=8, lanes=8, rounds=n).collect() if r.held_out) for n in (1, 4))
    assert four > one
