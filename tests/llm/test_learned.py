import random

import numpy as np
from pyspark.sql import functions as F

from prismal.llm import langid as L
from prismal.llm import toxicity as T

RNG = random.Random(4)
CLEAN = ["".join(RNG.choice("aeioulmnrst") for _ in range(RNG.randint(2, 8))) for _ in range(300)]
BAD = ["zgrumpf", "quaxolo", "vexatron"]


def document(toxic):
    sents = [" ".join(RNG.choice(CLEAN) for _ in range(8)) for _ in range(RNG.randint(2, 9))]
    if toxic:
        k = RNG.randrange(len(sents))
        sents[k] += " " + RNG.choice(BAD) + RNG.choice(["", "ix", "on"])
    return ". ".join(sents) + "."


def tables(spark, n=400):
    labels = [int(i % 4 == 0) for i in range(n)]
    docs = spark.createDataFrame([(i, document(y)) for i, y in enumerate(labels)], "doc_id long, text string")
    return docs, spark.createDataFrame(list(enumerate(labels)), "doc_id long, toxic int")


def test_noisy_or_learns_sentences_from_document_labels(spark):
    docs, labels = tables(spark)
    fit, held = docs.filter("doc_id % 5 <> 0"), docs.filter("doc_id % 5 = 0")
    model = T.fit(fit, labels)
    out = T.score_toxicity(held, model).join(labels, "doc_id").join(docs, "doc_id").collect()
    assert np.mean([r.predicted == r.toxic for r in out]) >= 0.97
    for r in out:
        if r.predicted and r.toxic:
            best = max(r.offending, key=lambda s: s.p)
            assert any(b in r.text[best.start : best.end] for b in BAD)
    kept = T.drop_toxic(held, model)
    assert kept.columns == held.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in out if not r.predicted}


def test_noisy_or_gradient_points_downhill():
    bags, y = [[[0], [1]], [[1]], [[], []], [[0, 1]]], np.array([1, 0, 0, 1])

    def loss(w, b):
        total = [sum(np.logaddexp(0, b + sum(w[i] for i in s)) for s in bag) for bag in bags]
        return np.mean([-np.log(-np.expm1(-t)) if v else t for t, v in zip(total, y)])

    w, b = T.fit_noisy_or(bags, y, 2, 400, prior=1e-3)
    assert w[0] > 3 and w[0] > w[1]
    for d in (0.3, -0.3):
        assert loss(w, b) <= loss(w + [d, 0], b) + 5e-3 and loss(w, b) <= loss(w, b + d) + 5e-3


def test_scores_of_odd_rows_and_models_without_both_classes(spark):
    docs, labels = tables(spark, 40)
    odd = spark.createDataFrame([(1, None, "x"), (1, "", "x"), (None, "...", "x"), (2, "quaxolo " * 30_000, "x")], "doc_id long, text string, score string")
    model = T.fit(docs, labels)
    out = T.score_toxicity(odd, model).collect()
    assert len(out) == 4 and all(0 <= r.score <= 1 for r in out) and [r.n_sentences for r in out] == [1, 1, 1, 1]
    assert T.score_toxicity(odd.limit(0), model).count() == 0
    none = T.fit(docs, labels.filter("toxic = 0"))
    assert all(r.predicted == 0 for r in T.score_toxicity(docs, none).collect())
    assert T.fit(docs, labels.limit(0)).weights == {}
    nulls = labels.unionByName(spark.createDataFrame([(None, 1), (3, None), (9_999, 1)], "doc_id long, toxic int"))
    assert T.fit(docs, nulls).weights.keys() == model.weights.keys()


def test_held_out_remainder_is_crc(spark):
    import zlib

    got = spark.range(50).select(T.remainder("id", 4)).collect()
    assert [r[0] for r in got] == [zlib.crc32(str(i).encode()) % 4 for i in range(50)]


TEXTS = {"xx": "abra kadabra simsala bim ", "yy": "der ölige Käse über Straßen ", "zz": "привет мир как дела "}


def languages(spark, n=60):
    rows = []
    for i in range(n):
        lang = list(TEXTS)[i % 3]
        w = TEXTS[lang].split()
        rows.append((i, " ".join(RNG.choice(w) for _ in range(30)), lang))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def out_of_place(doc, profile):
    place = {g: i for i, g in enumerate(profile)}
    return sum(abs(place[g] - i) if g in place else L.PROFILE for i, g in enumerate(doc))


def test_languages_and_distances_by_hand(spark):
    docs = languages(spark)
    profiles = L.fit_profiles(docs.filter("doc_id % 4 <> 0"))
    assert list(profiles) == ["xx", "yy", "zz"]
    rows = L.identify(docs, profiles).join(docs, "doc_id").collect()
    assert len(rows) == 60 and all(r.lang_pred == r.lang and 0.5 <= r.score <= 1 for r in rows)
    r = rows[7]
    doc = L.ranked(*L.ngrams(r.text), L.DOC_PROFILE).tolist()
    d = sorted(out_of_place(doc, p.tolist()) for p in profiles.values())
    assert r.score == d[1] / (d[0] + d[1])


def test_ngrams_by_hand():
    from collections import Counter

    text, want = "Ab ab2c!", Counter()
    for word in ("ab", "ab", "c"):
        p = f"\x01{word}\x01"
        want.update(c for c in word)
        want.update(p[i : i + 2] for i in range(len(p) - 1))
        want.update(p[i : i + 3] for i in range(len(p) - 2))
    code = lambda g: sum(ord(c) << 21 * (len(g) - 1 - i) for i, c in enumerate(g))
    g, n = L.ngrams(text)
    assert dict(zip(g.tolist(), n.tolist())) == {code(k): v for k, v in want.items()}


def test_undetermined_rows_and_empty_models(spark):
    docs = languages(spark, 9)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 34 !"), (None, "abra"), (5, "kadabra " * 40_000)], "doc_id long, text string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in L.identify(odd, L.fit_profiles(docs)).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0) and got[None][0] == got[5][0] == "xx"
    empty = L.fit_profiles(docs.withColumn("lang", F.lit(None).cast("string")))
    assert empty == {} and {r.lang_pred for r in L.identify(docs, empty).collect()} == {"und"}
    assert L.identify(docs.limit(0), {}).count() == 0
    one = L.fit_profiles(docs.filter("lang = 'xx'"))
    assert {r.lang_pred for r in L.identify(docs, one).collect()} == {"xx"}
