"""MinHash near-dedup by a signature-coordinate inverted join.

Each document's set of word shingles is hashed to a signature of ``coordinates`` minima. Documents
with equal sets become one representative. Representatives are posted under their (coordinate,
value) pairs. Two sets of the wanted similarity agree in at least ``least`` coordinates (chosen so
that fewer do with a chance of at most 1e-5), so when every document orders its pairs by their
number of postings, two such documents share one of the first ``coordinates - least + 1``: only this
prefix is posted and long lists are skipped; what the rest agrees in is counted on the signatures
themselves. Pairs with ``least`` matches or more are confirmed on the full sets.

Long lists aren't expanded into all pairs. First the members of each list are paired with its
smallest, its hub, and lists of ``SHORT`` members or fewer in all pairs; confirmed links give
components. Then two other hubs of each list meet its members of other components. Last come the members
still outside their hub's component: they meet the members of other components by an exact prefix
join on the shingles themselves, whose bounds on size and place leave few pairs even among copies
that almost link. A pair within one component can't change the components, so no step loses a link.

Defined results: nulls and texts without words have no shingles and link with nothing; with fewer
words than a shingle the whole sequence is one; rows with equal ids are one node that links where
one of its texts does; rows with a null id link with nothing (their component is null and they are
kept); empty tables give empty results; other columns aren't read.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SMALL, Tokens, durable, if_small, mix64, per_batch, settle, unused
from .quality import binomial_at_most

_P = np.uint64(0x9E3779B97F4A7C15)
#: Lists up to this length are paired whole.
SHORT = 8
#: Numbers that a filter of ids holds at most.
BUCKETS = 1 << 17


def shingles(texts: list[str | None], size: int) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of the runs of ``size`` words, A-Z lower-cased."""
    return [_shingles(h, size) for h in Tokens(texts, "word").lists()]


def _shingles(words: np.ndarray, size: int) -> np.ndarray:
    if not len(words):
        return np.zeros(0, np.uint64)
    k = min(size, len(words))
    total = np.full(len(words) - k + 1, k, np.uint64)
    for i in range(k):
        total = total * _P + words[i : len(words) - k + 1 + i]
    return np.unique(mix64(total))


def signature(shingled: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each coordinate the least of the shingles' 32-bit hashes."""
    least = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingled), 4096):
        part = shingled[None, i : i + 4096] * a[:, None] + b[:, None]
        least = np.minimum(least, (part >> np.uint64(32)).min(1))
    return least.astype(np.uint32)


def least_matches(similarity: Fraction, coordinates: int, miss: float = 1e-5) -> int:
    """Most matches that sets of this similarity fall short of with a chance of at most ``miss``."""
    t = 1
    while t < coordinates and binomial_at_most(t, coordinates, float(similarity)) <= miss:
        t += 1
    return t


def features(docs: DataFrame, size: int, coordinates: int, seed: int = 11) -> DataFrame:
    """``doc_id, version, n_shingles, set_key, sig`` of (``doc_id, version, text``). No shuffle."""

    def make():
        import xxhash

        rng = np.random.default_rng(seed)
        a = rng.integers(0, 1 << 63, coordinates, np.uint64) * np.uint64(2) + np.uint64(1)
        b = rng.integers(0, 1 << 63, coordinates, np.uint64)

        def f(ids, versions, texts):
            out = {"doc_id": ids, "version": versions, "n_shingles": [], "set_key": [], "sig": []}
            for s in shingles(texts, size):
                out["n_shingles"].append(len(s))
                out["set_key"].append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                out["sig"].append(signature(s, a, b).tobytes() if len(s) else None)
            return out

        return f

    return per_batch(docs, ["doc_id", "version", "text"], "doc_id long, version long, n_shingles long, set_key binary, sig binary", make)


def _prefixes(nodes: DataFrame, coordinates: int, least: int) -> DataFrame:
    """``key, id``: each node under the rarest of its (coordinate, value) pairs that others share."""

    def make():
        def f(ids, sigs):
            value = np.frombuffer(b"".join(sigs), np.uint32).reshape(len(ids), coordinates).astype(np.int64)
            key = (np.arange(coordinates, dtype=np.int64)[None, :] << 32) | value
            return {"key": key.ravel(), "id": np.repeat(np.array(ids, np.int64), coordinates)}

        return f

    posts = per_batch(nodes, ["id", "sig"], "key long, id long", make)
    shared = posts.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    ranked = posts.join(shared, "key").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("n", "key"))).alias("own"))  # at most ``coordinates``
    room = F.greatest(F.size("own") - F.lit(least - 1), F.lit(0))  # pairs that nobody shares come first
    return ranked.select("id", F.explode(F.slice("own", F.lit(1), room)).alias("p")).select("p.key", "id").distinct()


def _enough_matches(pairs: DataFrame, nodes: DataFrame, coordinates: int, least: int) -> DataFrame:
    """The pairs (a, b) whose signatures agree in ``least`` coordinates or more."""
    sig = nodes.select("id", "sig")
    both = pairs.join(sig.toDF("a", "sig_a"), "a").join(sig.toDF("b", "sig_b"), "b")

    def make():
        def f(a, b, x, y):
            u, v = (np.frombuffer(b"".join(s), np.uint32).reshape(-1, coordinates) for s in (x, y))
            ok = (u == v).sum(1) >= least
            return {"a": np.array(a, np.int64)[ok], "b": np.array(b, np.int64)[ok]}

        return f

    return per_batch(both, ["a", "b", "sig_a", "sig_b"], "a long, b long", make)


def repeated(rows: DataFrame) -> DataFrame:
    """``doc_id, version`` of rows that are there more than once: narrow numbers, no texts."""
    return durable(rows.groupBy("doc_id", "version").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id", "version"))


def same_ids(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) between the sets, by the ids they go by in ``sets`` (set_key, id), of the texts that one id has."""
    known = rows.filter("set_key is not null and doc_id is not null").select("doc_id", "set_key")
    several = known.groupBy("doc_id").agg(F.min("set_key").alias("low"), F.max("set_key").alias("high")).filter("low != high").select("doc_id")
    named = durable(known.join(if_small(durable(several)), "doc_id", "left_semi").join(sets, "set_key").select("doc_id", F.col("id").alias("b")).distinct())
    return named.join(named.groupBy("doc_id").agg(F.min("b").alias("a")), "doc_id").filter("a != b").select("a", "b")


def once(docs: DataFrame, again: DataFrame, keys: list[str]) -> DataFrame:
    """One row of each of ``again`` (``keys``, null-safe); other rows stay where they are. Only the repeated ones move."""
    if not again.limit(1).count():
        return docs
    flag = unused(docs, "_again")
    small = F.broadcast if again.count() <= SMALL else lambda df: df
    a, b = docs.alias("d"), small(again.withColumn(flag, F.lit(True))).alias("r")
    same = F.col(f"d.{keys[0]}").eqNullSafe(F.col(f"r.{keys[0]}")) & F.col(f"d.{keys[1]}").eqNullSafe(F.col(f"r.{keys[1]}"))
    marked = a.join(b, same, "left").select("d.*", F.col(f"r.{flag}").alias(flag))
    return marked.filter(F.col(flag).isNull()).unionByName(marked.filter(flag).dropDuplicates(keys)).drop(flag)


def texts_of(docs: DataFrame, nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents of ``ids`` (doc_id): most others are passed by before the shuffle.

    Few ids are broadcast. Of many, only their buckets are, at most ``BUCKETS`` numbers whatever the
    input; that lets some others through, which the join then drops.
    """
    wanted = durable(nodes.select(F.col("id").alias("doc_id"), "version").join(if_small(durable(ids.distinct())), "doc_id", "left_semi"))
    if wanted.count() <= SMALL:
        return docs.join(F.broadcast(wanted), ["doc_id", "version"]).select("doc_id", "version", "text")
    bucket = F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS)).alias("_bucket")  # ``docs`` has the columns of link()
    some = docs.withColumn("_bucket", bucket).join(F.broadcast(wanted.select(bucket).distinct()), "_bucket", "left_semi")
    return some.join(wanted, ["doc_id", "version"]).select("doc_id", "version", "text")


def compared(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """The pairs with the Jaccard similarity of their full sets, ``common`` and ``total``: the texts of their ends are read again."""
    texts = texts_of(docs, nodes, pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b").alias("doc_id"))))

    def sets():
        return lambda ids, texts: {"id": ids, "shingles": [s.view(np.int64) for s in shingles(texts, size)]}

    known = per_batch(texts, ["doc_id", "text"], "id long, shingles array<long>", sets)
    both = pairs.join(known.toDF("a", "set_a"), "a").join(known.toDF("b", "set_b"), "b")
    # compared in the JVM: with a second Python step in one task, twice as many workers would live on
    common = F.size(F.array_intersect("set_a", "set_b"))
    found = both.select("a", "b", common.cast("long").alias("common"), (F.size("set_a") + F.size("set_b") - common).cast("long").alias("total"))
    best = durable(found.groupBy("a", "b").agg(F.max_by(F.struct("common", "total"), F.col("common") / F.col("total")).alias("s")).select("a", "b", "s.common", "s.total"))
    settle(docs.sparkSession)
    return best


def components(links: DataFrame) -> DataFrame:
    """``id, component`` (the smallest id reachable) of all ends of ``links`` (a, b)."""
    both = durable(links.select("a", "b").union(links.select("b", "a")).distinct())
    label = durable(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("component")).withColumnRenamed("a", "id"))
    hint = F.broadcast if label.count() <= SMALL else lambda df: df
    while True:
        around = both.join(hint(label.toDF("b", "near")), "b").groupBy("a").agg(F.min("near").alias("near")).withColumnRenamed("a", "id")
        lower = around.join(hint(label), "id").select("id", "component", F.least("component", "near").alias("to"))
        far = label.toDF("to", "beyond")  # a node takes its label's own label too, so paths halve
        new = durable(lower.join(hint(far), "to").select("id", F.col("component").alias("was"), F.least("to", "beyond").alias("component")))
        label = new.select("id", "component")
        if not new.filter("was != component").limit(1).count():
            settle(links.sparkSession)
            return label


def _rest(members: DataFrame, docs: DataFrame, nodes: DataFrame, size: int, similarity: Fraction) -> DataFrame:
    """Pairs of ``members`` (id, c, apart) of different components that may link, one of them apart, compared: ``a, b, common, total``.

    An exact prefix join on the shingles themselves: a set's shingles are ordered by how many members
    have them; sets that link share one of the first n - ceil(similarity * n) + 1, and, counted from
    that place, enough are left in both to reach the overlap that their sizes ask for.
    """
    p, q = similarity.numerator, similarity.denominator

    def sets():
        def f(ids, texts):
            found = [s.view(np.int64) for s in shingles(texts, size)]
            return {"id": np.repeat(np.array(ids, np.int64), [len(s) for s in found]), "h": np.concatenate(found)}

        return f

    has = durable(per_batch(texts_of(docs, nodes, members.select(F.col("id").alias("doc_id"))), ["doc_id", "text"], "id long, h long", sets).distinct())
    often = has.groupBy("h").agg(F.count("*").alias("f"))
    own = has.join(often, "h").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("f", "h"))).alias("o"))  # one document's own shingles
    n = F.size("o")
    prefix = F.slice("o", F.lit(1), n - F.ceil(n * p / q - 1e-9).cast("int") + 1)
    posts = own.select("id", n.alias("n"), F.posexplode(prefix).alias("at", "o")).filter("o.f > 1").select(F.col("o.h").alias("h"), "id", "n", "at").join(if_small(members), "id")
    posts = durable(posts)
    x, y = posts.filter("apart").alias("x"), posts.alias("y")
    once = ~F.col("y.apart") | (F.col("x.id") < F.col("y.id"))
    left = F.least(F.col("x.n") - F.col("x.at"), F.col("y.n") - F.col("y.at"))
    sizes = (F.least("x.n", "y.n") * q >= F.greatest("x.n", "y.n") * p) & (left * (p + q) >= (F.col("x.n") + F.col("y.n")) * p)
    met = (F.col("x.h") == F.col("y.h")) & (F.col("x.c") != F.col("y.c")) & once & sizes
    pairs = x.join(y, met).select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"), (F.col("x.n") + F.col("y.n")).alias("both")).distinct()
    common = pairs.join(has.toDF("a", "h"), "a").join(has.toDF("b", "h"), ["b", "h"]).groupBy("a", "b", "both").agg(F.count("*").alias("common"))
    return durable(common.select("a", "b", "common", (F.col("both") - F.col("common")).alias("total")))


def joined(found: DataFrame, more: DataFrame) -> DataFrame:
    """Components after further links: only the components that these touch are worked on."""
    few = if_small(found)
    label = lambda c: few.select(F.col("id").alias(c), F.col("component").alias(f"_{c}"))
    ends = more.join(label("a"), "a", "left").join(label("b"), "b", "left").select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b"))
    merged = components(ends.filter("a != b"))
    known = found.join(if_small(merged.toDF("component", "_to")), "component", "left").select("id", F.coalesce("_to", "component").alias("component"))
    fresh = merged.join(found.select("id"), "id", "left_anti")
    return durable(known.unionByName(fresh))


def link(docs: DataFrame, size: int, similarity: Fraction, coordinates: int = 64) -> tuple[DataFrame, DataFrame]:
    """(features, ``set_key, component`` of all sets) of ``doc_id, version, text``."""
    rows = durable(features(docs, size, coordinates))
    docs = once(docs, repeated(rows), ["doc_id", "version"])  # equal rows are one when texts are compared
    sets = rows.filter("set_key is not null and doc_id is not null").groupBy("set_key").agg(F.min(F.struct("doc_id", "version")).alias("r"), F.max("sig").alias("sig"), F.max("n_shingles").alias("n"))
    nodes = durable(sets.select("set_key", F.col("r.doc_id").alias("id"), "r.version", "sig", "n"))
    least = least_matches(similarity, coordinates)
    posts = durable(_prefixes(nodes, coordinates, least))
    lists = posts.groupBy("key").agg(F.min("id").alias("hub"), F.count("*").alias("k")).filter("k > 1")
    posted = durable(posts.join(lists, "key"))
    linked = lambda compared: compared.filter(F.col("common") * similarity.denominator >= F.col("total") * similarity.numerator).select("a", "b")
    check = lambda pairs: linked(compared(durable(_enough_matches(pairs.filter("a < b").distinct(), nodes, coordinates, least)), docs, nodes, size))

    # first: every list's star, and short lists whole
    star = posted.select(F.col("hub").alias("a"), F.col("id").alias("b"))
    short = posted.filter(F.col("k") <= SHORT).select("key", "id", "hub")
    whole = short.select("key", F.col("id").alias("a")).join(short.filter("id != hub").select("key", F.col("id").alias("b")), "key").select("a", "b")
    links = check(star.union(whole))
    found = components(links)

    # then: two other hubs of each list, against other components only
    labelled = lambda: posted.join(if_small(found.toDF("id", "c")), "id", "left").withColumn("c", F.coalesce("c", "id"))
    mine = labelled().filter(F.col("k") > SHORT)
    firsts = [F.min_by(F.struct("id", "c"), F.xxhash64("id", F.lit(turn))) for turn in range(2)]
    other = mine.groupBy("key").agg(F.array(*firsts).alias("h"), F.min("c").alias("c_lo"), F.max("c").alias("c_hi")).filter("c_lo < c_hi").select("key", F.explode("h").alias("h"))
    apart = mine.join(other, "key").filter(F.col("c") != F.col("h.c")).select(F.least("id", "h.id").alias("a"), F.greatest("id", "h.id").alias("b"))
    found = joined(found, check(apart))

    # last: what is still outside its hub's component, with all that it may link with
    mine = labelled().filter(F.col("k") > SHORT).join(if_small(found.toDF("hub", "hub_c")), "hub", "left").withColumn("apart", F.col("c") != F.coalesce("hub_c", "hub"))
    open_lists = mine.groupBy("key").agg(F.max("apart").alias("open")).filter("open").select("key")
    members = durable(mine.join(open_lists, "key", "left_semi").groupBy("id").agg(F.min("c").alias("c"), F.max("apart").alias("apart")))
    more = linked(_rest(members, docs, nodes, size, similarity))
    found = joined(joined(found, more), same_ids(rows, nodes.select("set_key", "id")))
    return rows, nodes.join(found, "id", "left").select("set_key", F.coalesce("component", "id").alias("component"))


def cluster(docs: DataFrame, size: int = 5, similarity: Fraction = Fraction(4, 5), coordinates: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every document."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("version", F.xxhash64("text"))
    rows, sets = link(own, size, similarity, coordinates)
    out = rows.join(sets, "set_key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def survivors(docs: DataFrame, size: int = 5, similarity: Fraction = Fraction(4, 5), coordinates: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns: of each component the smallest id.

    Exact copies under one id, or without an id, leave one row.
    """
    i, v = unused(docs, "_id"), unused(docs, "_version")
    own = docs.withColumn(i, F.col(id_col).cast("long")).withColumn(v, F.xxhash64(text_col))
    rows, sets = link(own.select(F.col(i).alias("doc_id"), F.col(v).alias("version"), F.col(text_col).alias("text")), size, similarity, coordinates)
    gone = rows.join(sets, "set_key").filter("doc_id != component").select(F.col("doc_id").alias(i), F.col("version").alias(v)).distinct()
    left = own.join(if_small(durable(gone)), [i, v], "left_anti")
    return once(left, repeated(rows).toDF(i, v), [i, v]).select(*docs.columns)
