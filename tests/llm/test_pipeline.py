"""Pipeline stages, pseudonyms and languages against slow versions in plain Python; held-out quality on the tables."""

import datetime as dt
import hashlib
import random

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F
from test_operators import EDGES, exact_hits, rows_of, slow_components

import corpus_pipeline as pipeline
from tidewheel.llm import bpe, decontaminate, language, pii, secrets, toxicity
from tidewheel.llm.common import crc_mod, table

CLASHES = ("score", "predicted", "_id", "_version", "id", "key", "component", "version", "n_tokens", "word", "label")

SECRET = (7000, "token = 'abcdef0123456789' and AKIAABCDEFGHIJKL12 or db_pwd: aB3dE6gH9jK2mN5pQ8", "en", "s", 80)


@pytest.fixture(scope="module")
def odd(spark, sf):
    """The smallest documents with odd rows, repeated rows and columns named like the operators' own."""
    docs = table(spark, sf, "documents")
    more = spark.createDataFrame([*EDGES, EDGES[3], EDGES[5], EDGES[5], SECRET], docs.schema)
    return docs.unionByName(more).unionByName(docs.filter("doc_id % 40 = 1")).withColumns({c: F.lit("mine") for c in CLASHES})


def told(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)


def test_every_stage_keeps_the_right_rows(spark, sf, odd):
    stages, rows = dict(pipeline.STAGES), told(odd)
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "secrets", "bpe"]
    for name in ("toxicity", "near_duplicates", "decontamination", "secrets"):
        out = stages[name](spark, odd, sf)
        assert out.columns == odd.columns and not out.filter(F.greatest(*[F.col(c) != "mine" for c in CLASHES])).count()
        if name == "toxicity":
            model = toxicity.fit(odd, table(spark, sf, "labels"))
            score = dict(zip([t for _, t in rows], [s for s, _ in toxicity.Scorer(model)([t for _, t in rows])], strict=True))
            want = [r for r in rows if score[r[1]] < 0.3]
            assert 0 < len(want) < len(rows)
        elif name == "near_duplicates":
            distinct = sorted(set(rows), key=repr)
            kept = {i for i, (_, _, k) in slow_components([r for r in distinct if r[0] is not None], 5, 4, 5).items() if k}
            want = [r for r in distinct if r[0] is None or r[0] in kept]
        elif name == "decontamination":
            items = [(r.item_id, r.text) for r in table(spark, sf, "benchmark").collect()]
            hit = exact_hits([(k, t) for k, (_, t) in enumerate(rows)], items)
            want = [r for k, r in enumerate(rows) if k not in {k for k, _ in hit}]
            assert len(want) < len(rows)
        else:
            plain = {r.doc_id: r.text for r in secrets.redact(odd.select("doc_id", "text").distinct()).collect()}
            want = sorted(((i, plain[i]) for i, _ in rows), key=repr)
            assert any(t != dict(rows)[i] for i, t in plain.items()) and all("AKIA" not in (t or "") for t in plain.values())
        assert told(out) == want, name
    got = {r.doc_id: (r.n_tokens, r.ids) for r in stages["bpe"](spark, odd, sf).collect()}
    e = bpe.TrieEncoder(bpe.default_path())
    assert all(got[i] == (n, ids) for (i, _), (n, ids, _) in zip(rows, e.encode_batch([t for _, t in rows]), strict=True))


def test_every_stage_takes_an_empty_table(spark, sf, odd):
    none = odd.limit(0)
    for _, stage in pipeline.STAGES:
        assert stage(spark, none, sf).count() == 0


# -- pseudonyms ---------------------------------------------------------------------------------------


def feistel(x, y, mx, my, key, tweak):
    for r in range(1, pii.ROUNDS + 1):
        h = int(hashlib.sha256(f"{key}|{tweak}|{r}|{y}".encode()).hexdigest()[:14], 16)
        x, y, mx, my = y, (x + h % mx) % mx, my, mx
    return x, y


def permuted(d, key, tweak):
    n, a = len(d), len(d) // 2
    x, y = feistel(int(d[:a]), int(d[a:]), 10**a, 10 ** (n - a), key, f"{tweak}:{n}")
    return f"{x:0{a}d}{y:0{n - a}d}"


def laid_out(form, digits):
    it = iter(digits)
    return "".join(next(it) if c in "0123456789" else c for c in form)


def luhn(d):
    return sum(int(c) if (len(d) - i) % 2 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(d)) % 10


def mod97(s):
    s = s.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97


def day(m):
    try:
        y, mo, d = (m[6:], m[3:5], m[:2]) if m[2] == "/" else (m[:4], m[5:7], m[8:])
        return dt.date(int(y), int(mo), int(d))
    except ValueError:
        return None


def shifted(half, other, r, key):
    stream = hashlib.sha256(f"{key}|email|{r}|{other.lower()}".encode()).hexdigest()
    out = ""
    for i, c in enumerate(half):
        k = int(stream[i % 61 : i % 61 + 3], 16)
        base, size = (97, 26) if "a" <= c <= "z" else (65, 26) if "A" <= c <= "Z" else (48, 10) if "0" <= c <= "9" else (0, 0)
        out += chr((ord(c) - base + k) % size + base) if size else c
    return out


def slow_pseudonym(m, key):
    """The pseudonym of one candidate: the first kind that it is valid for."""
    digits = "".join(c for c in m if c in "0123456789")
    for kind, pattern in pii.KINDS.items():
        if not regex.fullmatch(pattern, m):
            continue
        if kind == "email":
            local, domain = m.split("@")
            x, y = local[: len(local) // 2], local[len(local) // 2 :]
            for r in range(1, 5):
                x, y = y, shifted(x, y, r, key)
            return f"{x}{y}@{domain}"
        if kind == "ip" and all(int(o) < 256 for o in m.split(".")):
            o = list(map(int, m.split(".")))
            x, y = feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536, key, "ip")
            return ".".join(map(str, (*divmod(x, 256), *divmod(y, 256))))
        if kind == "date" and (d := day(m)):
            x, y = feistel(*divmod((d - dt.date(1900, 1, 1)).days, 4297), 17, 4297, key, "date")
            new = dt.date(1900, 1, 1) + dt.timedelta(x * 4297 + y)
            return new.strftime("%d/%m/%Y" if m[2] == "/" else "%Y/%m/%d" if "/" in m else "%Y-%m-%d")
        if kind == "ssn" and not regex.search("^(?:000|666|9)|-00-|-0000$", m):
            area, group, serial = map(int, m.split("-"))
            x, y = feistel((area - 1 - (area > 666)) * 99 + group - 1, serial - 1, 898 * 99, 9999, key, "ssn")
            area = x // 99 + 1
            return f"{area + (area >= 666):03d}-{x % 99 + 1:02d}-{y + 1:04d}"
        if kind == "phone":
            code = regex.match(r"(\+[0-9]{1,3}[ .\-])?", m)[0]
            rest = m[len(code) :]
            return code + laid_out(rest, permuted("".join(c for c in rest if c in "0123456789"), key, "phone"))
        if kind == "iban" and mod97(m) == 1:
            own = "".join(c for c in m[4:] if c in "0123456789")
            body = laid_out(m[4:], permuted(own, key, "iban")) if len(own) > 1 else m[4:]
            return f"{m[:2]}{98 - mod97(m[:2] + '00' + body):02d}{body}"
        if kind == "card" and luhn(digits) == 0:
            new = permuted(digits[:-1], key, "card")
            return laid_out(m, new + str(-luhn(new + "0") % 10))
    return m


def test_pseudonyms_by_a_plain_feistel(spark, sf):
    more = "GB82WEST12345698765432 GB82 WEST 1234 5698 7654 32 28/02/2021 2021/02/28 31/02/2021 666-12-1234 665-12-1234 667-12-1234 899-99-9999 000-12-1234 1.2.3.4 255.255.255.255 300.1.1.1 A.b+c9@x.org 4785-3805-9239-1139 +1 (499) 555-6503 499.555.6503"
    rows = [*rows_of(spark, sf), (5000, more), (5001, None), (5002, "")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in pii.pseudonymise(d, "some key").collect()}
    pattern = regex.compile(pii.PATTERN)
    want = {i: t and pattern.sub(lambda m: slow_pseudonym(m[0], "some key"), t) for i, t in rows}
    assert got == want and sum(want[i] != t for i, t in rows) > 10


# -- languages ----------------------------------------------------------------------------------------


def slow_language(model, text):
    """Score of each language: the mean of the grams' rows, through a softmax."""
    code, last = [], True
    for i, c in enumerate((text or "").lower() + " "):
        letter = c.isalpha()
        if letter or last or not i:
            code.append(ord(c) if letter else 32)
        last = letter
    rows = []
    for n in language.GRAMS:
        for i in range(len(code) - n + 1):
            h = n
            for c in code[i : i + n]:
                h = (h * 0x9E3779B97F4A7C15 + c) % 2**64
            rows.append(model["scores"][((h ^ h >> 29) * 0xBF58476D1CE4E5B9 % 2**64 >> 48) & (language.BUCKETS - 1)])
    z = np.mean(np.array(rows, float), axis=0)
    p = np.exp(z - z.max())
    return p / p.sum()


def test_language_by_a_plain_softmax(spark, sf):
    docs = table(spark, sf, "documents")
    model = language.train(language.sample(docs, 40, "doc_id", "text", "lang"))
    got = {r.doc_id: r for r in language.predict(docs, model).collect()}
    for i, t in rows_of(spark, sf):
        if not any(map(str.isalpha, t or "")):
            assert (got[i].lang_pred, got[i].score, got[i].rejected) == ("und", 0.0, True)
            continue
        p = slow_language(model, t[:3000]) if len(t) > 3000 else slow_language(model, t)
        if len(t) <= 3000:
            assert got[i].lang_pred == model["langs"][int(p.argmax())] and abs(got[i].score - p.max()) < 1e-5 and got[i].rejected == (got[i].score < model["reject"])


def test_language_sample_is_the_least_hashes(spark):
    d = spark.createDataFrame([(i, f"text {i}", "en" if i % 3 else "de") for i in range(900)] + [(7, "text", "fr")] * 50, "i long, t string, l string")
    first = {(r.i, r.l) for r in language._first(d.select("i", "l"), 20).collect()}
    ranked = [(r.i, r.l) for r in d.select("i", "l").distinct().orderBy(F.pmod(F.xxhash64("i"), F.lit(1 << 30)), "i").collect()]
    assert first == {x for lang in ("en", "de", "fr") for x in [y for y in ranked if y[1] == lang][:20]}


# -- quality on the tables ------------------------------------------------------------------------------


def test_toxicity_of_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    held = {r.doc_id: r.toxic for r in labels.collect() if crc_mod(r.doc_id, 4) == 2}
    model = toxicity.fit(docs, labels.filter(F.crc32(F.col("doc_id").cast("string")) % 4 != 2))
    got = {r.doc_id: r.score for r in toxicity.predict(docs, model).collect() if r.doc_id in held}
    bad, good = ([s for i, s in got.items() if held[i] == y] for y in (1, 0))
    area = np.mean([(b > np.array(good)).mean() + 0.5 * (b == np.array(good)).mean() for b in bad])
    found, wrong = sum(s >= 0.3 for s in bad), sum(s >= 0.3 for s in good)
    print(f"toxicity held out: area {area:.3f}, {found} of {len(bad)} found, {wrong} of {len(good)} false alarms")
    assert area > 0.85 and found >= 0.5 * len(bad) and wrong <= 0.1 * len(good)


def test_learning_takes_repeated_and_null_rows(spark, sf):
    docs, labels = table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "labels").select("doc_id", "toxic")
    odd = docs.unionByName(spark.createDataFrame([(None, "no id"), (3, None)], docs.schema)).unionByName(docs.limit(20))
    more = labels.unionByName(labels.limit(20)).unionByName(spark.createDataFrame([(None, 1), (3, None)], labels.schema))
    one, other = (toxicity.predict(docs, toxicity.fit(docs, x)) for x in (labels, more))
    assert {r.doc_id: r.score for r in one.collect()} == {r.doc_id: r.score for r in other.collect()}
    assert toxicity.predict(odd, toxicity.fit(odd, more)).count() == odd.count()
    items = table(spark, sf, "benchmark")
    got = {(r.doc_id, r.item_id) for r in decontaminate.hits(docs, items).collect()}
    assert {(r.doc_id, r.item_id) for r in decontaminate.hits(odd, items).collect()} == got


@pytest.mark.parametrize(("share", "least"), [(0.95, 1.0), (0.8, 0.97), (0.65, 0.9)])
def test_paraphrases_found(spark, share, least):
    """Items that keep a share of their words in order, others put in their places, against the comparison of all pairs."""
    r = random.Random(int(share * 100))
    text = lambda n: [f"u{int(r.paretovariate(0.4)) % 5000}" for _ in range(n)]
    items = [(i, text(r.randint(20, 60))) for i in range(120)]
    docs = [(i, " ".join(text(60) + [w if r.random() < share else f"x{r.randint(0, 900)}" for w in items[i][1]] + text(r.randint(10, 80)))) for i in range(60)]
    told_items = [(i, " ".join(t)) for i, t in items]
    exact = exact_hits(docs, told_items)
    got = {(x.doc_id, x.item_id) for x in decontaminate.hits(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(told_items, "item_id long, text string")).collect()}
    print(f"paraphrases with {share} of the words: recall {len(got & exact)} of {len(exact)}")
    assert got <= exact and len(exact) > 10 and len(got & exact) >= least * len(exact)
