"""Language identification: averaged hashed subword embeddings with a linear softmax.

A text is lower-cased, what isn't a letter becomes one space, and its character 2-, 3- and 4-grams
are hashed into buckets. The mean of the buckets' embeddings goes through a linear softmax. Both
are trained by stochastic gradient descent in numpy on a bounded sample of labelled rows
(``per_language`` rows each, the first by a hash of the id); a fifth of it sets the temperature and
the score under which a prediction counts as rejected. As the model is linear, a bucket's
embedding times the softmax weights is one row of scores, so a text is scored by one sum.

Defined results: null texts and texts without a letter get ``und`` and score 0; without any
labelled row all get that; repeated rows are scored alike; rows with a null id are scored and not
learned from; an id with several languages is an example of each; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, per_batch

BUCKETS, GRAMS = 1 << 16, (2, 3, 4)
#: Characters handled at once.
_AT_ONCE = 1_500_000
_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.array([chr(i).isalpha() for i in range(0x110000)]))
    return _LETTER[0]


def grams(texts: list[str | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For runs of texts: index of the first, each text's bound in the next array (one more than texts), buckets.

    Buckets of grams that would span two texts are ``BUCKETS``.
    """
    at = 0
    while at < len(texts):
        until, size = at, 0
        while until < len(texts) and size < _AT_ONCE:
            size += len(texts[until] or "")
            until += 1
        lower = [(t or "").lower() for t in texts[at:until]]
        code = np.frombuffer(" ".join([*lower, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        doc = np.repeat(np.arange(len(lower)), [len(t) + 1 for t in lower])
        letter = _letters()[code]
        code = np.where(letter, code, 32)
        keep = letter | np.r_[True, letter[:-1]] | np.r_[True, doc[1:] != doc[:-1]]
        code, doc = code[keep].astype(np.uint64), doc[keep]
        found, owner = [], []
        for n in GRAMS:
            m = len(code) - n + 1
            if m < 1:
                continue
            h = np.full(m, n, np.uint64)
            for i in range(n):
                h = h * np.uint64(0x9E3779B97F4A7C15) + code[i : m + i]
            bucket = ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(48)).astype(np.int64) & (BUCKETS - 1)
            bucket[doc[:m] != doc[n - 1 :]] = BUCKETS
            found.append(bucket)
            owner.append(doc[:m])
        if found:
            bucket, owner = np.concatenate(found), np.concatenate(owner)
            order = np.argsort(owner, kind="stable")
            yield at, np.searchsorted(owner[order], np.arange(len(lower) + 1)), bucket[order]
        else:
            yield at, np.zeros(len(lower) + 1, np.int64), np.zeros(0, np.int64)
        at = until


def train(rows: list[tuple[np.ndarray, np.ndarray, str]], dims: int = 16, epochs: int = 6, rate: float = 0.5, seed: int = 7) -> dict | None:
    """Model from (buckets, counts, language) rows: ``langs``, ``scores`` (a row for each bucket), ``temperature``, ``reject``."""
    if not rows:
        return None
    langs = sorted({r[2] for r in rows})
    y = np.array([langs.index(r[2]) for r in rows])
    x = [(b, (c / c.sum()).astype(np.float32)[:, None]) for b, c, _ in rows]
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(rows))
    held = order[: len(rows) // 5] if len(rows) >= 50 else order
    fit = order[len(rows) // 5 :] if len(rows) >= 50 else order
    emb = rng.normal(0, 0.1, (BUCKETS, dims)).astype(np.float32)
    weights = rng.normal(0, 0.1, (dims, len(langs))).astype(np.float32)
    step, total = 0, epochs * len(fit)
    for _ in range(epochs):
        for i in rng.permutation(fit):
            lr = rate * (1 - step / total)
            step += 1
            b, c = x[i]
            v = (emb[b] * c).sum(0)
            z = v @ weights
            p = np.exp(z - z.max())
            g = p / p.sum()
            g[y[i]] -= 1
            back = weights @ g
            weights -= lr * np.outer(v, g)
            emb[b] -= lr * 20 * c * back
    table = emb @ weights
    z = np.array([(table[b] * c).sum(0) for b, c in x])[held]
    grid = np.geomspace(0.25, 8, 41)
    logp = lambda t: (z * t - np.log(np.exp(z * t - (z * t).max(1, keepdims=True)).sum(1, keepdims=True)) - (z * t).max(1, keepdims=True))[np.arange(len(held)), y[held]].mean()
    t = float(grid[np.argmax([logp(t) for t in grid])])
    e = np.exp(z * t - (z * t).max(1, keepdims=True))
    p = e / e.sum(1, keepdims=True)
    top, right = p.max(1), p.argmax(1) == y[held]
    by = np.argsort(-top, kind="stable")
    good = np.cumsum(right[by]) / np.arange(1, len(by) + 1) >= 0.99
    reject = float(top[by][good.nonzero()[0].max()]) if good.any() else 1.0
    return {"langs": langs, "scores": table * np.float32(t), "reject": min(reject, 0.999)}


def _first(known: DataFrame, per_language: int) -> DataFrame:
    """``i, l``: for each language the ids with the least hashes, ``per_language`` at most.

    Only ids below a bound on their hash travel, which the language's number of rows sets so that
    about eight times as many as are needed do; where they are too few (ids that repeat) it is raised.
    So what reaches one task doesn't grow with the table.
    """
    whole = 1 << 30
    bound = {r["l"]: min(whole, 8 * per_language * whole // r["n"] + 1) for r in known.groupBy("l").agg(F.count("*").alias("n")).collect()}  # a row a language
    if not bound:
        return known.limit(0)
    hashed = known.withColumn("h", F.pmod(F.xxhash64("i"), F.lit(whole)))
    while True:
        below = F.create_map(*[F.lit(x) for pair in bound.items() for x in pair])
        few = durable(hashed.filter(F.col("h") < F.element_at(below, F.col("l"))).distinct())
        have = {r["l"]: r["n"] for r in few.groupBy("l").agg(F.count("*").alias("n")).collect()}
        short = [x for x, b in bound.items() if b < whole and have.get(x, 0) < per_language]
        if not short:
            break
        bound |= {x: min(whole, bound[x] * 64) for x in short}
    order = Window.partitionBy("l").orderBy("h", "i")
    return few.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= per_language).select("i", "l")


def sample(docs: DataFrame, per_language: int, id_col: str, text_col: str, lang_col: str) -> list[tuple[np.ndarray, np.ndarray, str]]:
    """Gram counts of at most ``per_language`` rows for each language, the first by a hash of the id."""
    known = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(lang_col).alias("l"))
    ids = _first(known.select("i", "l"), per_language)
    chosen = known.join(F.broadcast(ids), ["i", "l"], "left_semi")  # its bound: per_language ids a language

    def make():
        def f(texts, langs):
            out = {"lang": [], "bucket": [], "n": []}
            for at, bound, bucket in grams(texts):
                for i in range(len(bound) - 1):
                    b, n = np.unique(bucket[bound[i] : bound[i + 1]], return_counts=True)
                    if (some := b < BUCKETS).any():
                        out["lang"].append(langs[at + i])
                        out["bucket"].append(b[some].astype(np.int32))
                        out["n"].append(n[some].astype(np.int32))
            return out

        return f

    rows = per_batch(chosen, ["t", "l"], "lang string, bucket array<int>, n array<int>", make).toArrow().to_pydict()
    return sorted(((np.array(b), np.array(n), lang) for b, n, lang in zip(rows["bucket"], rows["n"], rows["lang"], strict=True)), key=lambda r: (r[2], len(r[0]), r[0].tobytes(), r[1].tobytes()))


def predict(docs: DataFrame, model: dict | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, lang_pred, score, rejected`` of every whole text. No shuffle."""
    kind = dict(docs.dtypes)[id_col]
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a row for each bucket

    def make():
        model = sent.value
        if model is None:
            return lambda ids, texts: {id_col: ids, "lang_pred": ["und"] * len(ids), "score": [0.0] * len(ids), "rejected": [True] * len(ids)}
        langs = model["langs"]
        table = np.vstack([np.hstack([model["scores"], np.ones((BUCKETS, 1), np.float32)]), np.zeros((1, len(langs) + 1), np.float32)])

        def f(ids, texts):
            lang, score = np.full(len(ids), "und", object), np.zeros(len(ids))
            for at, bound, bucket in grams(texts):
                total = np.zeros((len(bound) - 1, len(langs) + 1))
                some = bound[1:] > bound[:-1]
                if some.any():
                    total[some] = np.add.reduceat(table[bucket], bound[:-1][some], axis=0, dtype=np.float64)
                for i, t in enumerate(texts[at : at + len(bound) - 1]):
                    if total[i, -1] and any(map(str.isalpha, t)):
                        z = total[i, :-1] / total[i, -1]
                        p = np.exp(z - z.max())
                        p /= p.sum()
                        k = int(p.argmax())
                        lang[at + i], score[at + i] = langs[k], p[k]
            return {id_col: ids, "lang_pred": lang.tolist(), "score": score, "rejected": score < model["reject"]}

        return f

    return per_batch(docs, [id_col, text_col], f"{id_col} {kind}, lang_pred string, score double, rejected boolean", make)


def identify(docs: DataFrame, learn_from: DataFrame, per_language: int = 600, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Train on a bounded sample of ``learn_from`` and predict every row of ``docs``."""
    return predict(docs, train(sample(learn_from, per_language, id_col, text_col, lang_col)), id_col, text_col)
