"""Quality rules with risk-controlled cutoffs.

Each rule is a ratio of a document that grows with junk. Its cutoff is chosen for each stratum
(language by default) from labelled holdouts: the rows labelled good. Going from the laxest to the
strictest cutoff of a grid, a cutoff is certified while the exact binomial test shows that it
rejects fewer than ``alpha / rules`` of the good rows, at level ``delta / (strata * rules)``;
the walk ends at the first that isn't (a fixed sequence needs no further correction; strata and
rules are corrected by Bonferroni). This is the exact (Clopper-Pearson) upper bound on the false
rejection rate. Strata with so few good rows that even no false rejection would certify nothing
are pooled and judged as one (which is decided by their numbers alone, so the bound holds for the
pool); a pool that is still too small, and strata without a good row, have nothing rejected by a
cutoff. The bound is on good rows that hold the base rule: those that fail it are rejected whatever
the cutoffs.

Defined results: null or empty texts have no words, fail the base rule and aren't kept; rows with
equal text get equal results unless their strata differ; a null stratum is a stratum; repeated
label rows count once; a row with labels of both kinds isn't good; repeated rows of a document count
once each; without labels only the base rule rejects; other columns aren't read.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, per_batch, words_of

_SYMBOLS = "#*$%&|<>"
#: Rule: its ratio (of columns of features()) and its cutoffs, laxest first; above a cutoff is rejected.
RULES: dict[str, tuple[str, list[float]]] = {
    "symbols": ("n_symbols / nullif(word_chars, 0)", [round(0.5 - 0.02 * i, 2) for i in range(25)]),
    "dup_lines": ("n_dup_lines * 10D / nullif(n_words, 0)", [round(1.0 - 0.04 * i, 2) for i in range(25)]),
    "repeats": ("n_repeat_words / nullif(n_words, 0)", [round(0.5 - 0.02 * i, 2) for i in range(25)]),
}


def repeat_words(words: list[str]) -> int:
    """Words that lie in a 3-word window found twice or more in the list."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict[str, int] = {}
    a = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    size = len(ids)
    key = a[:-2] * size + a[1:-1]
    if size > 2_000_000:  # the triple would pass 63 bits
        key = np.unique(key, return_inverse=True)[1].astype(np.int64)
    key = key * size + a[2:]
    _, at, count = np.unique(key, return_inverse=True, return_counts=True)
    again = count[at] > 1
    if not again.any():
        return 0
    covered = np.zeros(n, bool)
    for i in range(3):
        covered[i : n - 2 + i] |= again
    return int(covered.sum())


def measure(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    words = words_of(text)
    if not words:
        return 0, 0, sum(text.count(s) for s in _SYMBOLS) if text else 0, 0, 0
    seen, dup = set(), 0
    for line in text.split("\n"):
        if line in seen:
            dup += 1
        elif line.strip(" \t\n\v\f\r"):
            seen.add(line)
    return len(words), sum(map(len, words)), sum(text.count(s) for s in _SYMBOLS), dup, repeat_words(words)


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``id_col``, the columns ``keep``, the five measures and ``base_failed`` of every whole text. No shuffle."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    types = dict(docs.dtypes)

    def make():
        def f(texts, ids, *others):
            rows = np.array([measure(t) for t in texts], np.int64).reshape(-1, 5)
            return {id_col: ids} | dict(zip(keep, others, strict=True)) | {n: rows[:, i] for i, n in enumerate(names)}

        return f

    schema = ", ".join([f"{c} {types[c]}" for c in (id_col, *keep)] + [f"{n} long" for n in names])
    out = per_batch(docs, [text_col, id_col, *keep], schema, make)
    return out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def binomial_at_most(k: int, n: int, p: float) -> float:
    """P(X <= k) for n draws of chance p, exactly."""
    if k >= n:
        return 1.0
    log = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
    top = max(log)
    return min(1.0, math.exp(top) * math.fsum(math.exp(x - top) for x in log))


def cutoffs(good: DataFrame, stratum: str = "stratum", alpha: float = 0.05, delta: float = 0.05) -> list[tuple[tuple[str | None, ...], str, float]]:
    """(strata, rule, cutoff) of each certified rule; strata are one, or all that were pooled. ``good``: features of rows labelled good.

    One aggregate: for each stratum (there are few) and cutoff, how many good rows it would reject.
    """
    counts = [F.sum(F.coalesce((_ratio(r) > c).cast("long"), F.lit(0))).alias(f"{r}_{i}") for r, (_, grid) in RULES.items() for i, c in enumerate(grid)]
    rows = good.groupBy(stratum).agg(F.count("*").alias("n_good"), *counts).collect()
    enough = lambda n, strata: (1 - alpha / len(RULES)) ** n <= delta / (strata * len(RULES))
    rows = [r.asDict() | {stratum: (r[stratum],)} for r in rows]
    own = [r for r in rows if enough(r["n_good"], len(rows))]
    few = [r for r in rows if not enough(r["n_good"], len(rows))]
    if few:
        own.append({k: sum(r[k] for r in few) for k in few[0] if k != stratum} | {stratum: tuple(r[stratum][0] for r in few)})
    rows, out = own, []
    for row in rows:
        for rule, (_, grid) in RULES.items():
            best = None
            for i, cut in enumerate(grid):
                if binomial_at_most(row[f"{rule}_{i}"], row["n_good"], alpha / len(RULES)) > delta / (len(rows) * len(RULES)):
                    break
                best = cut
            if best is not None:
                out.append((row[stratum], rule, best))
    return out


def _ratio(rule: str) -> Column:
    return F.expr(RULES[rule][0])


def apply(measured: DataFrame, chosen: list[tuple[tuple[str | None, ...], str, float]], stratum: str = "stratum") -> DataFrame:
    """``measured`` with ``kept``: the base rule holds and no certified cutoff is passed."""
    bad = F.lit(False)
    for strata, rule, cut in chosen:
        here = reduce(Column.__or__, [F.col(stratum).eqNullSafe(F.lit(s)) for s in strata])
        bad = bad | (here & F.coalesce(_ratio(rule) > cut, F.lit(False)))
    return measured.withColumn("kept", ~F.col("base_failed") & ~bad)


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = 0.05, delta: float = 0.05, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Features and verdict of every document; ``labels`` has ``id_col`` and ``quality`` (1: good).

    The texts are read once; their measures are checkpointed and joined with the labels by id.
    """
    measured = durable(features(docs, id_col, text_col, (stratum,)))
    labelled = labels.groupBy(id_col).agg(F.min("quality").alias("_q")).filter("_q = 1").select(id_col)
    good = measured.filter(~F.col("base_failed")).join(labelled, id_col)
    return apply(measured, cutoffs(good, stratum, alpha, delta), stratum)
