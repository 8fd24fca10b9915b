"""N-gram Jaccard join by prefixes of token combinations.

A document's set is its distinct word shingles; documents with equal sets are one node. Two sets of
the wanted similarity t and n shingles lack at most ``miss(n) = n - ceil(t n)`` of each other's.

*Slices.* A node's slice is its ``2 miss(n) + 2`` shingles of the smallest hashes. By the prefix rule
(two sets that lack so few of each other's share k of their first ``miss + k``, in any one order)
two linked nodes share ``low(n)`` of their slices, about half. Nodes with fewer shingles in their
slice that any other slice has can't link, and go; this leaves few, without moving whole sets.

*Stars.* What is left posts its slice's tokens, as far as a prefix of the rarest that must hold a shared
one. The members of each token's list are compared with its most typical one, whose tokens are the
most frequent, as the original of altered copies has them all, then with two others. Confirmed links
give components. A pair within a component can't change them.

*Combinations.* From then on only tokens of several components count, and only nodes that have enough
of them; their full sets are read, ordered by frequency, rare first. Rare tokens (lists of ``RARE`` at
most) are posted singly. Frequent ones fall into classes by hash, so many that a class has few of a
prefix, and two tokens of one class are posted together: the prefix is made longer by one token a
class, so that a linked pair that shares no rare token of it shares two of some class (pigeonholes).
Classes grow with the sets: sizes are cut into ranges of ratio 1/t, and a node posts under its own
range and the next one, where it meets larger partners. Members of a list in different components,
of sizes and with tokens left that allow the similarity, are compared.

No step can lose a link, whatever the order or the frequencies; equal 64-bit hashes of different
shingles would count as one.

Defined results: nulls and texts without words have no shingles and link with nothing; with fewer
words than a shingle the whole sequence is one; rows with equal ids are one node that links where one
of its texts does; rows with a null id link with nothing (their component is null); ids are cast to
long; empty tables give empty results; other columns aren't read.
"""

from __future__ import annotations

from fractions import Fraction
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, if_small, mix64, per_batch
from .neardup import compared, components, joined, once, repeated, same_ids, shingles, texts_of

#: Longest list of a token that is posted singly.
RARE = 8
#: Tokens that a pair may lack for each class of frequent ones.
PER_CLASS = 16
_P = np.uint64(0x9E3779B97F4A7C15)


class Bounds:
    """What the wanted similarity asks of sets by their sizes, in whole numbers."""

    def __init__(self, similarity: Fraction):
        self.p, self.q = similarity.numerator, similarity.denominator
        if not 0 < self.p < self.q:
            raise ValueError("the similarity lies between 0 and 1")
        #: Smallest sizes of the ranges: a set's partners are in its own or a neighbouring range.
        self.starts = [1]
        while self.starts[-1] < 1 << 40:
            self.starts.append(self.starts[-1] * self.q // self.p + 1)

    def least(self, n: int) -> int:
        """Size of the smallest partner, and the least overlap with any."""
        return -(-self.p * n // self.q)

    def miss(self, n: int) -> int:
        return n - self.least(n)

    def slice(self, n: int) -> int:
        """Tokens of a slice; none for sets that link with equal ones alone."""
        return min(n, 2 * self.miss(n) + 2) if n * (self.q - self.p) >= self.p else 0

    def low(self, n: int) -> int:
        """Tokens that the slices of a set and of any partner share at least."""
        m = self.least(n)
        return min(self.miss(m) + 2, m)

    def range(self, n: int) -> int:
        return int(np.searchsorted(self.starts, n, "right")) - 1

    def classes(self, g: int) -> int:
        """Classes of frequent tokens in a range: no more than a pair has shared tokens for."""
        return max(0, min(-(-self.miss(self.starts[g]) // PER_CLASS), self.least(self.starts[max(0, g - 1)]) - 1))


def features(docs: DataFrame, size: int, bounds: Bounds) -> DataFrame:
    """``doc_id, version, n_shingles, set_key, low, slice`` of (``doc_id, version, text``). No shuffle."""

    def make():
        import xxhash

        def f(ids, versions, texts):
            sets = shingles(texts, size)
            sizes = [len(s) for s in sets]
            keys = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            parts = [s[: bounds.slice(len(s))].view(np.int64) for s in sets]
            return {"doc_id": ids, "version": versions, "n_shingles": sizes, "set_key": keys, "low": [bounds.low(n) for n in sizes], "slice": parts}

        return f

    return per_batch(docs, ["doc_id", "version", "text"], "doc_id long, version long, n_shingles long, set_key binary, low int, slice array<long>", make)


def distinct_sets(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(``id, version, n, low, slice`` of a node for each set of several sizes, ``set_key, id`` of all sets). Slices stay where they are."""
    first = rows.filter("set_key is not null and doc_id is not null").groupBy("set_key").agg(F.min(F.struct("doc_id", "version")).alias("r"), F.count("*").alias("k"))
    first = durable(first.select("set_key", F.col("r.doc_id").alias("id"), F.col("r.version").alias("v"), "k"))
    shared = if_small(durable(first.filter("k > 1").select("set_key", "id", "v")))
    own = rows.filter("size(slice) > 0 and doc_id is not null").join(shared, "set_key", "left")
    nodes = own.filter("id is null or (id = doc_id and v = version)").select(F.col("doc_id").alias("id"), "version", F.col("n_shingles").alias("n"), "low", "slice")
    return nodes, first.select("set_key", "id")


def live(nodes: DataFrame) -> DataFrame:
    """``id, version, n, low, own, typical``: nodes that share enough of their slice with others; ``own`` are those tokens (f, h), rare first, ``typical`` how frequent they are."""
    posts = nodes.select("id", "version", "n", "low", F.explode("slice").alias("h"))
    shared = posts.groupBy("h").agg(F.count("*").alias("f")).filter("f > 1")
    own = posts.join(shared, "h").groupBy("id", "version", "n", "low").agg(F.sort_array(F.collect_list(F.struct("f", "h"))).alias("own"))  # one node's slice
    return durable(own.filter("size(own) >= low").withColumn("typical", F.aggregate("own.f", F.lit(0).cast("long"), lambda s, f: s + f) / F.col("n")))


def _fit(a: str, b: str, bounds: Bounds) -> str:
    """SQL: sets of sizes a and b may have the similarity."""
    return f"least({a}, {b}) * {bounds.q} >= greatest({a}, {b}) * {bounds.p}"


def enough_shared(pairs: DataFrame, alive: DataFrame) -> DataFrame:
    """The pairs (a, b) whose slices share what those of a linked pair do."""
    some = alive.select("id", "low", F.col("own.h").alias("s"))
    both = pairs.join(some.toDF("a", "low_a", "s_a"), "a").join(some.toDF("b", "low_b", "s_b"), "b")
    return both.filter(F.size(F.array_intersect("s_a", "s_b")) >= F.greatest("low_a", "low_b")).select("a", "b").distinct()


def combination_posts(tokens: DataFrame, bounds: Bounds) -> DataFrame:
    """``key, id, n, c, left``: nodes under rare tokens of their prefix, and under two frequent ones of a class, by range of sizes.

    ``tokens`` has ``id, n, c`` and ``own``, the tokens of the whole set that count, as (f, h), rare first.
    ``left`` bounds what a pair that meets here first can share: the tokens from the key's on, and as
    many before it as it takes to be sure of a key.
    """

    def make():
        def keys(n: int, own: list[dict]):
            for g in (bounds.range(n), bounds.range(n) + 1):
                m = bounds.classes(g)
                groups: dict[int, list[tuple[int, int]]] = {}
                for at, t in enumerate(own[: max(0, len(own) - bounds.least(n) + 1 + m)]):
                    h = t["h"] % (1 << 64)
                    if t["f"] <= RARE or not m:
                        yield g, h, 0, len(own) - at + m
                    else:
                        groups.setdefault(h % m, []).append((h, at))
                for mine in groups.values():
                    yield from ((g, *sorted((h, k)), len(own) - at + m) for (h, _), (k, at) in combinations(mine, 2))

        def f(ids, sizes, labels, owns):
            found = [np.array(list(keys(*x)), np.uint64).reshape(-1, 4) for x in zip(sizes, owns, strict=True)]
            times = [len(x) for x in found]
            g, one, two, left = np.concatenate(found).T
            key = mix64(mix64(one * _P + g) + two)
            return {"key": key.view(np.int64), "left": left.astype(np.int64)} | {c: np.repeat(np.array(x, np.int64), times) for c, x in (("id", ids), ("n", sizes), ("c", labels))}

        return f

    return per_batch(tokens, ["id", "n", "c", "own"], "key long, id long, n long, c long, left long", make)


def between_components(members: DataFrame, docs: DataFrame, size: int, bounds: Bounds) -> DataFrame:
    """Pairs (a, b) of ``members`` (id, version, c) in different components, every linked one among them."""

    def sets():
        def f(ids, versions, texts):
            found = [s.view(np.int64) for s in shingles(texts, size)]
            times = [len(s) for s in found]
            return {"id": np.repeat(np.array(ids, np.int64), times), "version": np.repeat(np.array(versions, np.int64), times), "n": np.repeat(times, times), "h": np.concatenate(found)}

        return f

    texts = texts_of(docs, members, members.select(F.col("id").alias("doc_id")))
    has = durable(per_batch(texts, ["doc_id", "version", "text"], "id long, version long, n long, h long", sets))
    every = has.join(if_small(durable(members.select("id", "version", "c").distinct())), ["id", "version"])
    spans = every.groupBy("h").agg(F.min("c").alias("low_c"), F.max("c").alias("high_c"), F.count("*").alias("f")).filter("low_c < high_c").select("h", "f")
    own = every.join(spans, "h").groupBy("id", "version", "n", "c").agg(F.sort_array(F.collect_list(F.struct("f", "h"))).alias("own"))  # one node's set
    keyed = durable(combination_posts(own.filter(F.size("own") * bounds.q >= F.col("n") * bounds.p), bounds))
    several = keyed.groupBy("key").agg(F.min("c").alias("low_c"), F.max("c").alias("high_c")).filter("low_c < high_c").select("key")
    x = durable(keyed.join(several, "key"))
    room = F.least("x.left", "y.left") * (bounds.p + bounds.q) >= (F.col("x.n") + F.col("y.n")) * bounds.p
    met = (F.col("x.key") == F.col("y.key")) & (F.col("x.id") < F.col("y.id")) & (F.col("x.c") != F.col("y.c")) & F.expr(_fit("x.n", "y.n", bounds)) & room
    return x.alias("x").join(x.alias("y"), met).select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()


def link(docs: DataFrame, size: int, similarity: Fraction) -> tuple[DataFrame, DataFrame]:
    """(features, ``set_key, component`` of all sets) of ``doc_id, version, text``."""
    bounds = Bounds(similarity)
    rows = durable(features(docs, size, bounds))
    docs = once(docs, repeated(rows), ["doc_id", "version"])
    nodes, sets = distinct_sets(rows)
    alive = live(nodes)
    ends = alive.select("id", "version")
    linked = lambda found: found.filter(F.col("common") * bounds.q >= F.col("total") * bounds.p).select("a", "b")
    check = lambda pairs: linked(compared(durable(enough_shared(pairs.filter("a < b").distinct(), alive)), docs, ends, size))

    # stars: every list's most typical member, then two others where components differ
    room = F.size("own") - F.col("low") + 1
    posts = durable(alive.select("id", "n", "typical", F.explode(F.slice("own", F.lit(1), room)).alias("t")).select(F.col("t.h").alias("h"), "id", "n", "typical"))
    hubs = posts.groupBy("h").agg(F.max(F.struct("typical", (-F.col("id")).alias("minus"), "n")).alias("hub"), F.count("*").alias("k")).filter("k > 1").select("h", (-F.col("hub.minus")).alias("hub"), F.col("hub.n").alias("hub_n"))
    star = posts.join(hubs, "h").filter(_fit("n", "hub_n", bounds)).filter("id != hub").select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b"))
    found = components(check(star))
    label = lambda table: table.join(if_small(found.toDF("id", "c")), "id", "left").withColumn("c", F.coalesce("c", "id"))
    mine = label(posts.select("h", "id", "n"))
    firsts = [F.min_by(F.struct("id", "n", "c"), F.xxhash64("id", F.lit(turn))) for turn in range(2)]
    others = mine.groupBy("h").agg(F.array(*firsts).alias("hub"), F.min("c").alias("low_c"), F.max("c").alias("high_c")).filter("low_c < high_c").select("h", F.explode("hub").alias("hub"))
    apart = mine.join(others, "h").filter(F.col("c") != F.col("hub.c")).filter(_fit("n", "hub.n", bounds)).select(F.least("id", "hub.id").alias("a"), F.greatest("id", "hub.id").alias("b"))
    found = joined(found, check(apart))

    # combinations: exactly what is left between components
    every = label(alive).select("id", "version", "low", "c", F.explode("own.h").alias("h"))
    spans = every.groupBy("h").agg(F.min("c").alias("low_c"), F.max("c").alias("high_c")).filter("low_c < high_c").select("h")
    members = durable(every.join(spans, "h").groupBy("id", "version", "low", "c").agg(F.count("*").alias("k")).filter("k >= low"))
    pairs = between_components(members, docs, size, bounds)
    found = joined(joined(found, check(pairs)), same_ids(rows, sets))
    return rows, sets.join(found, "id", "left").select("set_key", F.coalesce("component", "id").alias("component"))


def join(docs: DataFrame, size: int = 5, similarity: Fraction = Fraction(4, 5), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every document."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("version", F.xxhash64("text"))
    rows, sets = link(own, size, similarity)
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return rows.join(sets, "set_key", "left").select("doc_id", "n_shingles", component.alias("component_id"))
