"""Quality rules by weak supervision (native: SQL functions only).

Nine rules vote good (1), bad (-1) or abstain (0) on features that are computed where a document is read.
Expectation-maximisation over the counts of the vote patterns (at most 3**9, whatever the corpus size) estimates
how each rule votes on good and on bad documents; a document stays when its posterior probability of being good
is high enough. One pass over the texts: the features are staged, the rest reads 20 numbers a document.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANKS, WORD, Stage, documents, let, texts

SYMBOLS = "#*$%&|<>"
WINDOW = 8


def repeat_words(words: Column, width: int = WINDOW) -> Column:
    """Words that lie in a window of ``width`` words found twice or more in the text.

    Windows are compared by 64-bit hashes; texts whose window hashes are all distinct stop there. Otherwise the
    windows are sorted by hash, those with an equal neighbour are kept, and the lengths they cover are summed.
    """
    zero = F.lit(0).cast("long")

    def windows(h):
        return F.transform(F.sequence(F.lit(1), F.size(h) - (width - 1)), lambda i: F.xxhash64(F.slice(h, i, width)))

    def covered(p):
        each = F.transform(p, lambda v, k: F.least(F.lit(width), F.coalesce(F.get(p, k + 1) - v, F.lit(width))).cast("long"))
        return F.aggregate(each, zero, lambda a, b: a + b)

    def places(s):
        twin = F.filter(s, lambda e, k: F.coalesce(F.get(s, k - 1)["x"] == e["x"], F.lit(False)) | F.coalesce(F.get(s, k + 1)["x"] == e["x"], F.lit(False)))
        return F.array_sort(F.transform(twin, lambda e: e["i"]))

    def repeated(g):
        placed = F.array_sort(F.transform(g, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(g)) == F.size(g), zero).otherwise(let(placed, lambda s: let(places(s), covered)))

    return F.when(F.size(words) <= width, zero).otherwise(let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: let(windows(h), repeated)))


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of a text: the contract's, and those that only the rules look at."""
    t = texts(docs, id_col, text_col).withColumn("words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    lines = F.filter(F.split("text", "\n"), lambda s: F.rlike(s, F.lit(WORD)))
    long = lambda c: c.cast("long")
    return t.select(
        "doc_id",
        long(F.size("words")).alias("n_words"),
        long(F.length(F.regexp_replace("text", BLANKS, ""))).alias("word_chars"),
        long(F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).alias("n_symbols"),
        long(let(lines, lambda a: F.size(a) - F.size(F.array_distinct(a)))).alias("n_dup_lines"),
        repeat_words(F.col("words")).alias("n_repeat_words"),
        long(let(lines, lambda a: F.size(a))).alias("n_lines"),
        long(F.length(F.regexp_replace("text", r"[^\p{L}]+", ""))).alias("n_letters"),
        long(F.length("text") - F.length(F.regexp_replace("text", r"\p{Lu}+", ""))).alias("n_upper"),
        long(F.length("text") - F.length(F.translate("text", "!?", ""))).alias("n_marks"),
        long(F.size(F.array_distinct(F.transform("words", lambda w: F.xxhash64(w))))).alias("n_distinct"),
    )


def _share(a: str, b: str) -> Column:
    return F.col(a) / F.greatest(F.col(b), F.lit(1))


def rules() -> dict[str, tuple[Column, Column]]:
    """Name -> (votes good, votes bad); neither: abstains. A text without words is bad by length and else abstains."""
    words, some = F.col("n_words"), F.col("n_words") > 0
    size, sym, dup, rep = _share("word_chars", "n_words"), _share("n_symbols", "n_words"), _share("n_dup_lines", "n_lines"), _share("n_repeat_words", "n_words")
    letters, upper, marks, kinds = _share("n_letters", "word_chars"), _share("n_upper", "n_letters"), _share("n_marks", "n_words"), _share("n_distinct", "n_words")
    return {
        "length": (words >= 40, words < 20),
        "word_size": (size.between(3.0, 12.0), some & ~size.between(2.0, 18.0)),
        "symbols": (some & (sym <= 0.05), sym > 0.2),
        "dup_lines": (some & (dup <= 0.2), dup > 0.4),
        "repeats": (some & (rep <= 0.15), rep > 0.3),
        "letters": (letters >= 0.85, (words >= 20) & (letters < 0.6)),
        "upper": ((F.col("n_letters") > 0) & (upper <= 0.3), upper > 0.5),
        "marks": (some & (marks <= 0.1), marks > 0.3),
        "kinds": (kinds >= 0.4, (words >= 40) & (kinds < 0.15)),
    }


def votes() -> dict[str, Column]:
    return {k: F.when(bad, -1).when(good, 1).otherwise(0) for k, (good, bad) in rules().items()}


#: The kind of bad document that a rule looks for.
KINDS = {"length": "thin", "word_size": "thin", "symbols": "marked", "letters": "marked", "dup_lines": "repeated", "repeats": "repeated", "kinds": "repeated", "upper": "loud", "marks": "loud"}


def fit(counts: dict[tuple[int, ...], int], names: list[str], rounds: int = 60, smooth: float = 0.5) -> list[tuple[float, list[dict[int, float]]]]:
    """For the good class and then each kind of bad: log prior, and for each rule the log probability of each vote.

    Expectation-maximisation for classes within which votes are independent: good documents and the kinds of bad
    ones (a single bad class would settle on the commonest kind). It starts from the belief that a document which
    rules of a kind call bad is of that kind 19 times in 20, and good as often otherwise, which ties the classes to
    their meaning; smoothing keeps unseen votes finite.
    """
    kinds = ["good", *dict.fromkeys(KINDS.values())]
    model: list[tuple[float, list[dict[int, float]]]] = []
    for step in range(rounds):
        mass = [smooth] * len(kinds)
        seen = [[[smooth] * 3 for _ in names] for _ in kinds]
        for k, tables in enumerate(seen):  # what the rules mean, as a few documents' worth of evidence
            for j, name in enumerate(names):
                tables[j][0 if KINDS[name] == kinds[k] else 2] += 2.0
        for pattern, c in counts.items():
            if step:
                logs = [lp + sum(t[j][v] for j, v in enumerate(pattern)) for lp, t in model]
            else:
                hit = {KINDS[names[j]] for j, v in enumerate(pattern) if v < 0}
                logs = [math.log(0.95 if (k in hit if hit else k == "good") else 0.05 / len(kinds)) for k in kinds]
            top = max(logs)
            each = [math.exp(x - top) for x in logs]
            for k, e in enumerate(each):
                p = c * e / sum(each)
                mass[k] += p
                for j, v in enumerate(pattern):
                    seen[k][j][v + 1] += p
        model = [(math.log(m / sum(mass)), [{v: math.log(t[v + 1] / sum(t)) for v in (-1, 0, 1)} for t in tables]) for m, tables in zip(mass, seen)]
    return model


def posterior(model) -> Column:
    """Probability that a document is good, from its votes in columns vote_<rule>."""

    def log_joint(lp, tables):
        return reduce(lambda a, b: a + b, (F.get(F.array(*map(F.lit, (w[-1], w[0], w[1]))), F.col(f"vote_{k}") + 1) for k, w in zip(votes(), tables)), F.lit(lp))

    good, *bad = [log_joint(*m) for m in model]
    return 1 / (1 + reduce(lambda a, b: a + b, (F.exp(x - good) for x in bad)))


def quality(docs: DataFrame, at_least: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, the five contract counts, base_failed, kept, p_good.

    base_failed: n_words < 20, or 100 * n_repeat_words > 30 * n_words; such a document is never kept. Null and empty
    texts have no words and fail. An empty table gives an empty result; other columns of docs are not looked at.
    """
    made = features(docs, id_col, text_col)
    seen = Stage(docs.sparkSession, "quality").put(made.select("*", *[v.alias(f"vote_{k}") for k, v in votes().items()]))
    names = list(votes())
    patterns = seen.groupBy([F.col(f"vote_{k}").alias(k) for k in names]).count().collect()  # at most 3**9 rows
    model = fit({tuple(r[k] for k in names): r["count"] for r in patterns}, names)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    out = seen.withColumn("p_good", posterior(model)).withColumn("base_failed", failed)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.col("p_good") >= at_least)).alias("kept"), "p_good")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """quality() over documents: null and empty texts have no words and are not kept."""
    return quality(documents(spark, sf_dir))
