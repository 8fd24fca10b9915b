"""Toxicity by the nearest labelled examples: exact cosine of weighted TF-IDF over a block-max inverted index.

All labelled rows are learned from. The index is fitted on a bounded sample of them, the examples
(``examples`` in all, the first by a hash of the id); every other labelled row is indexed under the
example that is nearest to it, whose vote is the mean label of all rows there. Up to ``examples``
rows each is an example. Terms are all words of the examples and their beginnings; none is left
out. Words are 64-bit hashes of their characters from the start. Document frequencies are counted over all documents. A
term's weight is TF-IDF times how strongly its presence goes with the label, in either direction:
(chi2 + 1) / rows of the 2x2 table of all labelled rows, so a term that says nothing still weighs what chance gives.
Vectors have unit length over the whole text: a word that no example has counts with the largest
idf and the least such factor. The k nearest examples are exact. Their votes, weighted by cosine, give a raw
score; isotonic regression over the scores of all labelled rows, each found without itself, makes it a
probability.

Defined results: null and empty texts, and texts without any term, have no neighbours and get the
calibrated rate of such examples; without labelled rows every score is 0; ties in cosine go to the
example with the smaller id; an example with several labels counts once, with the largest; repeated
rows are scored alike; rows with a null id are scored and never learned from; other columns aren't read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HashTable, Tokens, durable, give_back, keep_rows, per_batch, per_task, remove, rows_of_ids, settle, shared_folder

#: Lengths of the beginnings of words that are terms too.
BEGINNINGS = (5, 7)


def terms_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text and hash of each word and of each beginning of a word of some texts, and which are whole words."""
    tokens = Tokens(texts)
    text, parts = tokens.text(), [tokens.beginnings(n) for n in BEGINNINGS]
    hashes = np.concatenate([tokens.words(), *[h for _, h in parts]])
    return np.concatenate([text, *[text[at] for at, _ in parts]]), hashes, np.arange(len(hashes)) < len(text)


def _counted(first: np.ndarray, second: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct pairs in order, second below ``size``, and how often each is there."""
    pair, n = np.unique(first * size + second, return_counts=True)
    return *np.divmod(pair, size), n


class Terms:
    """Counts the terms of the examples in texts."""

    def __init__(self, table: HashTable):
        self.table = table

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, ...]:
        """Text, term and count of each term in each text, in order; and text and count of words that no example has."""
        text, hashes, whole = terms_of(texts)
        term = self.table(hashes)
        known, strange = term >= 0, np.flatnonzero((term < 0) & whole)
        at, again = text[strange], hashes[strange]
        order = np.lexsort((again, at))
        at, again = at[order], again[order]
        first = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (again[1:] != again[:-1])]) if len(at) else at
        return *_counted(text[known], term[known].astype(np.int64), max(1, self.table.size)), at[first], np.diff(np.r_[first, len(at)])


#: More than single precision can be wrong by in a cosine.
_NEAR = 1e-5


class BlockMaxIndex:
    """Exact cosines of unit vectors: a matrix for frequent terms, a block-max inverted index for all others.

    Terms that a share ``dense`` of the rows have are the columns of a matrix: one product gives what
    they add for many queries, in single precision; rows that may be among the nearest by it are
    added up again in double precision. Weights are kept in single precision. The other terms' postings are in order of ``blocks`` blocks of rows, of
    each of which a term's greatest weight is known. The block of the highest bound comes first; those
    whose bound doesn't reach the k-th best cosine then aren't looked at. Rows are put in order of
    their most frequent terms, so that those of one language share blocks.
    """

    def __init__(self, row: np.ndarray, term: np.ndarray, weight: np.ndarray, n_rows: int, n_terms: int, kin: np.ndarray | None = None, blocks: int = 4, dense: float = 0.1):
        self.n, self.blocks, self.block = n_rows, blocks, max(1, -(-n_rows // blocks))
        self.order = np.arange(n_rows) if kin is None else np.lexsort((np.arange(n_rows), kin))  # place: row
        self.at = np.empty(n_rows, np.int64)
        self.at[self.order] = np.arange(n_rows)
        at, often = self.at[row], np.bincount(term, minlength=n_terms) >= max(2, dense * n_rows)
        self.column = np.where(often, np.cumsum(often) - 1, -1).astype(np.int32)
        self.matrix = np.zeros((blocks * self.block, int(often.sum())), np.float32)
        frequent = often[term]
        self.matrix[at[frequent], self.column[term[frequent]]] = weight[frequent]
        at, term, weight = at[~frequent], term[~frequent], weight[~frequent].astype(np.float32)
        by = np.lexsort((at, term))
        #: Place and weight of each posting, in one number; of each term and block where its postings start, and the greatest weight.
        self.posting = (at[by] << 32) | weight[by].view(np.uint32).astype(np.int64)
        key = term[by].astype(np.int64) * blocks + at[by] // self.block
        self.start = np.searchsorted(key, np.arange(n_terms * blocks + 1)).astype(np.int32)
        self.most = np.zeros(n_terms * blocks, np.float32)
        np.maximum.at(self.most, key, weight[by])
        self.most = self.most.reshape(n_terms, blocks)

    def nearest(self, bound: np.ndarray, term: np.ndarray, weight: np.ndarray, k: int, without: np.ndarray | None = None, at_once: int = 24) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each query, terms[bound[i]:bound[i + 1]], the rows and cosines of the k nearest with a cosine above 0; ties to the smaller row."""
        n = len(bound) - 1
        query = np.repeat(np.arange(n), np.diff(bound))
        column = self.column[term]
        rare = column < 0
        for first in range(0, n, at_once):
            many = min(at_once, n - first)
            here = slice(*bound[[first, first + many]])
            q, f = np.zeros((many, self.matrix.shape[1])), ~rare[here]
            q[query[here][f] - first, column[here][f]] = weight[here][f]
            dense = q.astype(np.float32) @ self.matrix.T
            score = dense.astype(float)
            self._search(score, query[here][~f] - first, term[here][~f], weight[here][~f], k)
            if without is not None:
                score[np.arange(many), self.at[without[first : first + many]]] = 0
            least = self._least(score, k)
            for i, low in enumerate(least.tolist()):
                places = np.flatnonzero(score[i] >= max(low - _NEAR, 1e-300))
                again = self.matrix[places].astype(float) @ q[i]
                found, rows = np.round(score[i, places] - dense[i, places] + again, 9), self.order[places]
                best = np.lexsort((rows, -found))[:k]
                best = best[found[best] > 0]
                yield rows[best], found[best]

    @staticmethod
    def _least(score: np.ndarray, k: int) -> np.ndarray:
        """The k-th best of each row."""
        return np.partition(score, -k, axis=1)[:, -k] if score.shape[1] > k else np.zeros(len(score))

    def _search(self, score: np.ndarray, query: np.ndarray, term: np.ndarray, weight: np.ndarray, k: int) -> None:
        """Add the postings of all blocks that may hold one of a query's k nearest, besides itself."""
        if not len(term):
            return
        most = np.zeros((len(score), self.blocks))
        first = np.flatnonzero(np.r_[True, query[1:] != query[:-1]])
        most[query[first]] = np.add.reduceat(weight[:, None] * self.most[term], first)
        bound = score.reshape(len(score), self.blocks, self.block).max(2) + most
        chosen = np.arange(self.blocks) == bound.argmax(1)[:, None]
        self._add(score, chosen, query, term, weight)
        rest = ~chosen & (most > 0) & (bound >= self._least(score, k + 1)[:, None] - _NEAR)
        if rest.any():
            self._add(score, rest, query, term, weight)

    def _add(self, score: np.ndarray, chosen: np.ndarray, query: np.ndarray, term: np.ndarray, weight: np.ndarray) -> None:
        of, block = np.nonzero(chosen[query])
        at = term[of] * self.blocks + block
        low = self.start[at]
        size = self.start[at + 1] - low
        some = np.flatnonzero(size)
        if not len(some):
            return
        of, low, size = of[some], low[some], size[some].astype(np.int64)
        end = np.cumsum(size)
        posting = self.posting[np.repeat(low - end + size, size) + np.arange(end[-1])]
        held = posting.view(np.float32)[::2] * np.repeat(weight[of], size)
        posting >>= 32
        posting += np.repeat(query[of] * score.shape[1], size)
        score += np.bincount(posting, held, score.size).reshape(score.shape)


def _pooled(raw: np.ndarray, toxic: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Steps of the non-decreasing fit, pooling adjacent violators: of each its least raw, toxic rows and rows.

    Of 0 and 1 there are few steps, as their means differ. Steps of consecutive ranges can be pooled again.
    """
    x, at = np.unique(raw, return_inverse=True)
    out: list[list[float]] = []
    for step in zip(x.tolist(), np.bincount(at, toxic).tolist(), np.bincount(at, n).tolist(), strict=True):
        out.append([*step])
        while len(out) > 1 and out[-2][1] * out[-1][2] >= out[-1][1] * out[-2][2]:
            _, b, m = out.pop()
            out[-1][1] += b
            out[-1][2] += m
    return np.array(out).reshape(-1, 3)


def isotonic(raw: np.ndarray, label: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Steps of the non-decreasing fit of label on raw: (least raw of a step, its value); with ``n``, label is the toxic ones of n rows."""
    steps = _pooled(raw, label, np.ones(len(raw)) if n is None else n)
    return steps[:, 0], steps[:, 1] / steps[:, 2]


class Weights:
    """Weight of each term and of words that no example has; unit vectors of texts."""

    def __init__(self, weight: np.ndarray, other: float):
        self.weight, self.other = weight, other

    def __call__(self, text: np.ndarray, term: np.ndarray, n: np.ndarray, strange_text: np.ndarray, strange_n: np.ndarray, n_texts: int) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of the texts' terms, and their weights in vectors of unit length; other words only lengthen them."""
        w = (1 + np.log(n)) * self.weight[term]
        square = np.bincount(text, w * w, n_texts) + np.bincount(strange_text, ((1 + np.log(strange_n)) * self.other) ** 2, n_texts)
        return np.searchsorted(text, np.arange(n_texts + 1)), w / np.sqrt(np.where(square > 0, square, 1.0))[text]


def _vote(rows: np.ndarray, cosines: np.ndarray, labels: np.ndarray, empty: float, rate: float) -> float:
    """Votes weighted by cosine, with one vote's weight at the examples' rate."""
    return (float((cosines * labels[rows]).sum()) + rate) / (float(cosines.sum()) + 1) if len(rows) else empty


def fit(docs: DataFrame, labelled: DataFrame, examples: int = 4096, k: int = 32, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> dict | None:
    """Model from all rows of ``labelled`` (``id_col``, ``label_col``), its index fitted on ``examples`` of them; frequencies over all ``docs``."""
    one = labelled.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col), F.col(label_col).alias("_label"))
    one = one.groupBy(id_col).agg(F.max("_label").alias("_label"))
    first = durable(one.orderBy(F.xxhash64(id_col), id_col).limit(examples))
    sample = docs.select(id_col, text_col).join(F.broadcast(first), id_col)  # its bound: ``examples``
    spark, folder, many = docs.sparkSession, None, one.count()
    if many > examples:  # all labelled texts, which move once
        folder = f"{shared_folder(spark)}/toxicity-{uuid.uuid4().hex}"
        rows_of_ids(docs.select(id_col, text_col), one, many, id_col).write.option("compression", "zstd").parquet(folder)
        settle(spark)

    def counted():
        def f(ids, texts, labels):
            text, hashes, _ = terms_of(texts)
            order = np.lexsort((hashes, text))
            text, hashes = text[order], hashes[order].view(np.int64)
            first = np.flatnonzero(np.r_[True, (text[1:] != text[:-1]) | (hashes[1:] != hashes[:-1])]) if len(text) else text
            n, edge = np.diff(np.r_[first, len(text)]), np.searchsorted(text[first], np.arange(1, len(texts)))
            return {"id": ids, "label": labels, "term": np.split(hashes[first], edge), "n": np.split(n, edge)}

        return f

    kind = dict(docs.dtypes)[id_col]
    bags = per_batch(sample, [id_col, text_col, "_label"], f"id {kind}, label int, term array<long>, n array<int>", counted).toArrow()  # a bounded sample
    size = bags.num_rows
    if not size:
        if folder:
            remove(spark, folder)
        return None
    lists = pa.concat_arrays(bags.column("term").chunks)
    counts = pa.concat_arrays(bags.column("n").chunks).flatten().to_numpy()
    ids, label = bags.column("id").to_pylist(), bags.column("label").to_numpy().astype(float)
    names, term = np.unique(lists.flatten().to_numpy().view(np.uint64), return_inverse=True)
    term = term.astype(np.int32)
    row = np.repeat(np.arange(size, dtype=np.int32), np.diff(lists.offsets.to_numpy()))
    del bags, lists
    # rows in order of ids; of a repeated id, in order of labels and texts
    mark = np.bincount(row, np.sqrt(term + 1.0) * counts, size)
    order = np.array(sorted(range(size), key=lambda i: (ids[i], label[i], mark[i])))
    place = np.empty(size, np.int32)
    place[order] = np.arange(size)
    ids, label, row = [ids[i] for i in order], label[order], place[row]
    by = np.lexsort((term, row))
    row, term, counts = row[by], term[by], counts[by]
    table = HashTable(names)
    n_terms = len(names)
    # 2x2 table of each term over all labelled rows: a toxic with it, b others with it, c toxic without, d others without
    have = np.bincount(term, minlength=n_terms).astype(float)
    a, toxic, b, every = np.bincount(term, label[row], n_terms), float(label.sum()), have, float(size)
    if folder:
        n, bad = _frequencies(spark.read.parquet(folder), table, [text_col, "_label"])
        a, toxic, b, every = bad[:-1], bad[-1], n[:-1], n[-1]
    b = b - a
    c, d = toxic - a, every - toxic - b
    product = (a + b) * (c + d) * (a + c) * (b + d)
    chi2 = np.where(product > 0, (a * d - b * c) ** 2 * every / np.maximum(product, 1), 0.0)
    df, _ = _frequencies(docs, table, [text_col])
    idf = np.log((1 + df[-1]) / (1 + df[:-1]))
    weights = Weights(idf * (chi2 + 1) / every, float(idf.max(initial=0.0)) / every)
    none = np.zeros(0, np.int64)
    bound, weight = weights(row, term, counts, none, none, size)
    kin = np.full(size, -1)  # of each example its most frequent term, that of most examples first
    top = np.lexsort((term, -have[term], -counts, row))
    head = np.flatnonzero(np.r_[True, row[top][1:] != row[top][:-1]]) if len(top) else none
    kin[row[top][head]] = term[top][head]
    keep = weight > 0
    index, rate = BlockMaxIndex(row[keep], term[keep], weight[keep], size, n_terms, kin), toxic / every
    bare = np.bincount(row[keep], minlength=size) == 0
    del by, top, head, keep, row, counts, a, b, c, d, product, chi2, df, idf
    model = {"table": table, "weights": weights, "index": index, "ids": ids, "rate": rate, "k": k}
    give_back()
    # of each example the rows indexed under it and the toxic ones of them, itself included; last those without neighbours
    n, bad = np.r_[np.ones(size), bare.sum()], np.r_[label, label[bare].sum()]
    found = None
    if folder:
        others = spark.read.parquet(folder).join(F.broadcast(first.select(id_col)), id_col, "left_anti")
        found = _neighbours(others, model, text_col)
        remove(spark, folder)
        for r in found.groupBy(F.get("row", F.lit(0)).alias("at")).agg(F.count("*").alias("n"), F.sum("label").alias("bad")).collect():
            at = -1 if r["at"] is None else r["at"]
            n[at] += r["n"]
            bad[at] += r["bad"]
    votes = bad[:-1] / n[:-1]
    model |= {"labels": votes, "empty": float(bad[-1] / n[-1]) if n[-1] else rate}
    raw = np.array([_vote(*x, votes, model["empty"], rate) for x in index.nearest(bound, term, weight, k, np.arange(size))])
    del term, weight
    give_back()
    return model | {"steps": isotonic(raw, label) if found is None else _calibrated(found, raw, label, n, bad, model)}


def _neighbours(labelled: DataFrame, model: dict, text_col: str) -> DataFrame:
    """``label, row, cosine``: of each labelled row that is no example the nearest examples."""
    sent = labelled.sparkSession.sparkContext.broadcast(model)  # bounded by the sample and the terms

    def make():
        m = sent.value
        count = Terms(m["table"])

        def f(texts, labels):
            found = count(texts)
            bound, weight = m["weights"](*found, len(texts))
            near = list(m["index"].nearest(bound, found[1], weight, m["k"]))
            return {"label": labels, "row": [r for r, _ in near], "cosine": [c for _, c in near]}

        return f

    out = durable(per_batch(labelled, [text_col, "_label"], "label int, row array<int>, cosine array<double>", make))
    sent.destroy()
    return out


def _calibrated(found: DataFrame, raw: np.ndarray, label: np.ndarray, n: np.ndarray, bad: np.ndarray, model: dict) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic steps over all labelled rows; a row's own label isn't in the vote of the example that it is indexed under.

    Ranges of raw scores are pooled each by a task, and their steps at last.
    """
    votes, empty, rate = model["labels"], model["empty"], model["rate"]

    def make():
        def f(labels, rows, cosines):
            out = []
            for y, at, cos in zip(labels, rows, cosines, strict=True):
                at, cos = np.array(at, np.int64), np.array(cos)
                own = votes[at]
                if len(at):
                    own[0] = (bad[at[0]] - y) / (n[at[0]] - 1)
                out.append(_vote(np.arange(len(at)), cos, own, empty, rate))
            return {"raw": out, "label": labels}

        return f

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = np.zeros((0, 3))
        for b in batches:  # sorted, so that steps so far and a batch are consecutive
            more = np.stack([b.column(i).to_numpy().astype(float) for i in range(3)], axis=1)
            steps = _pooled(*np.concatenate([steps, more]).T)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.float64()) for x in steps.T], ["raw", "bad", "n"])

    examples = found.sparkSession.createDataFrame(pa.table({"raw": raw, "label": label.astype(np.int32)}))
    scored = per_batch(found, ["label", "row", "cosine"], "raw double, label int", make).union(examples)
    counted = scored.groupBy("raw").agg(F.sum("label").cast("double").alias("bad"), F.count("*").cast("double").alias("n"))
    steps = counted.repartitionByRange("raw").sortWithinPartitions("raw").mapInArrow(pool, "raw double, bad double, n double").toArrow()
    return isotonic(*(steps.column(i).to_numpy() for i in range(3)))


def _frequencies(docs: DataFrame, table: HashTable, columns: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Of each term the rows that have it, over all of ``docs``, and those with a label of 1; last their numbers. ``columns`` are the text and the label, if any."""
    sent = docs.sparkSession.sparkContext.broadcast(table)  # the terms of a bounded sample

    def make():
        count = Terms(sent.value)
        n, bad = np.zeros((2, sent.value.size + 1), np.int64)

        def f(texts, labels=None):
            text, term, *_ = count(texts)
            n[:] += np.bincount(term, minlength=len(n))
            n[-1] += len(texts)
            if labels is not None:
                y = np.array(labels, np.int64)
                bad[:] += np.bincount(term[y[text] > 0], minlength=len(n))
                bad[-1] += (y > 0).sum()

        def end():
            some = n.nonzero()[0]
            return {"term": some, "n": n[some], "bad": bad[some]}

        return f, end

    sums = [F.sum("n").alias("n"), *([F.sum("bad").alias("bad")] if len(columns) > 1 else [])]
    found = per_task(docs, columns, "term int, n long, bad long", make).groupBy("term").agg(*sums).toArrow()
    out = np.zeros((2, table.size + 1))
    at = found.column("term").to_numpy()
    for i in range(1, found.num_columns):
        out[i - 1, at] = found.column(i).to_numpy()
    sent.destroy()
    return out[0], out[1]


class Scorer:
    """Scores texts by a model."""

    def __init__(self, model: dict | None, evidence: int = 3):
        self.model, self.evidence = model, evidence
        self.count = Terms(model["table"]) if model else None

    def __call__(self, texts: list[str | None]) -> list[tuple[float, list]]:
        m = self.model
        if m is None:
            return [(0.0, []) for _ in texts]
        found = self.count(texts)
        bound, weight = m["weights"](*found, len(texts))
        (low, value), out = m["steps"], []
        for rows, cosines in m["index"].nearest(bound, found[1], weight, m["k"]):
            raw = _vote(rows, cosines, m["labels"], m["empty"], m["rate"])
            out.append((float(value[max(0, np.searchsorted(low, raw, "right") - 1)]), [m["ids"][r] for r in rows[: self.evidence]]))
        return out


def predict(docs: DataFrame, model: dict | None, threshold: float = 0.3, evidence: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, score, predicted, evidence`` (ids of the nearest examples) of every whole text. No shuffle."""
    kind = dict(docs.dtypes)[id_col]
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample and the terms

    def make():
        scorer = Scorer(sent.value, evidence)

        def f(ids, texts):
            found = scorer(texts)
            return {id_col: ids, "score": [s for s, _ in found], "predicted": [int(s >= threshold) for s, _ in found], "evidence": [e for _, e in found]}

        return f

    return per_batch(docs, [id_col, text_col], f"{id_col} {kind}, score double, predicted int, evidence array<{kind}>", make)


def reject(docs: DataFrame, model: dict | None, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that aren't predicted toxic, with all their columns. No shuffle, no join."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        scorer = Scorer(sent.value)
        return lambda texts: [s < threshold for s, _ in scorer(texts)]

    return keep_rows(docs, text_col, make)
