import random

import numpy as np
import pytest

import corpus_pipeline
from prismal.llm import near_copies as N
from prismal.llm import simhash

DOCS = "doc_id long, text string"


def grams(text):
    w = (text or "").lower().split()
    return frozenset(" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def alike(a, b):
    return a == b or len(a & b) * 10 >= 8 * len(a | b)


def firsts(rows):
    """Ids kept by brute force over all pairs."""
    sets, low = [grams(t) for _, t in rows], list(range(len(rows)))
    near = [[j for j, q in enumerate(sets) if alike(p, q)] for p in sets]
    while (new := [min(low[j] for j in near[i]) for i in range(len(rows))]) != low:
        low = new
    return {rows[i][0] for i in low}


def edited(words, rng, n):
    out = list(words)
    for at in rng.sample(range(len(out)), n):
        out[at] = f"edit{rng.randrange(10**6)}"
    return out


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(900)]
    notice = [rng.choice(vocabulary) for _ in range(40)]
    texts = ["", " ", "one two", "ONE two", "one two three four five", "one two three four five six"]
    for _ in range(40):
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(20, 400))]
        texts += [" ".join(base + notice), " ".join(base)]
        # around the threshold on both sides
        texts += [" ".join(edited(base, rng, n)) for n in (1, len(base) // 55 + 1, len(base) // 45 + 1, len(base) // 40 + 1, len(base) // 20 + 1)]
    # a chain: each is like the next, the first and last are not
    chain = [rng.choice(vocabulary) for _ in range(200)]
    texts += [" ".join(chain[i : i + 150]) for i in range(0, 50, 8)]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("small", [False, True])
def test_stage_keeps_what_brute_force_keeps(spark, corpus, monkeypatch, small):
    if small:
        for name, value in (("BLOCK", 2), ("BROADCAST_SETS", 0), ("BROADCAST_IDS", 0), ("BUCKET_BYTES", 30_000), ("TASK_BYTES", 30_000)):
            monkeypatch.setattr(N, name, value)
    docs = spark.createDataFrame(corpus, DOCS).repartition(5)
    kept = corpus_pipeline.drop_near_copies(spark, docs, "")
    want = firsts(corpus)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(want) and 60 < len(want) < len(corpus)


def test_whole_small_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    kept = N.keep_first(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(firsts(rows))


@pytest.mark.parametrize("stretch", [3, 17, 1 << 18])
def test_shingle_sets_equal_those_of_words(stretch, monkeypatch):
    monkeypatch.setattr(N, "STRETCH", stretch)
    rng = random.Random(stretch)
    texts = ["", "  ", "A", "a b", "b a", "a\x0bb", "one two three four five", "one two three four five six" * 9, "é É\u3000ü", "x" * 100 + " y", "p q r s p q r s p q r s p"]
    texts += ["".join(rng.choice("aB \n\t") for _ in range(rng.randrange(80))) for _ in range(60)]
    raw = [t.encode() for t in texts]
    h, sizes = N.shingle_sets(b"".join(raw), np.cumsum([len(t) for t in raw]), 5)
    of, at = {}, 0
    for t, n in zip(texts, sizes.tolist()):
        want = N.shingle_words(t, 5)
        mine, at = frozenset(h[at : at + n].tolist()), at + n
        assert n == len(want) == len(mine) and of.setdefault(frozenset(want), mine) == mine
    assert len(set(of.values())) == len(of)


def test_a_bitmap_never_says_more_than_the_sets_differ():
    rng = np.random.default_rng(2)
    for n, m, both in ((1, 1, 0), (40, 60, 30), (500, 900, 450), (3000, 2500, 2000)):
        x = np.unique(rng.integers(0, 1 << 63, n + m - both, dtype=np.uint64))
        a, b = x[:n], x[n - both :]
        assert np.bitwise_count(N.parity(a) ^ N.parity(b)).sum() <= len(np.setxor1d(a, b)) and not (N.parity(a) ^ N.parity(a)).any()


def test_rows_are_decided_by_id_and_text(spark):
    long = " ".join(f"w{i}" for i in range(100))
    rows = [(1, long), (2, long + " more"), (2, "quite another text of seven words"), (3, "alone"), (3, "alone"), (None, long), (4, long.upper()), (None, None), (None, None), (9, ""), (None, "nobody else's text"), (None, "nobody else's text")]
    kept = N.keep_first(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted((str(r.doc_id), r.text) for r in kept) == sorted([("1", long), ("2", rows[2][1]), ("3", "alone"), ("9", ""), ("None", rows[-1][1])])
    assert N.keep_first(spark.createDataFrame([], DOCS)).count() == 0
    clash = spark.createDataFrame([(1, long, 5, "x"), (2, long + " z", 6, None)], "doc_id int, text string, t int, k string")
    assert N.keep_first(clash).collect() == clash.filter("doc_id = 1").collect() and N.keep_first(clash).schema == clash.schema


def test_the_stage_links_fingerprints_and_goes_on_from_them(spark):
    core, tails = "one two three four five ", [" ".join(f"{x}{i}" for i in range(20)) for x in "ab"]
    rows = [(1, core * 50 + tails[0]), (2, core * 50 + tails[1]), (3, core + core + tails[1]), (4, "quite another text of seven words"), (None, core * 50 + "c d e f g h i"), (5, None), (6, " ")]
    docs = spark.createDataFrame(rows, DOCS)
    # 1 and 2 are alike by fingerprint only, 2 and 3 by shingles only
    assert firsts(rows[:2]) == {1, 2} and firsts(rows[1:3]) == {2}
    found = {r.doc_id: r.root for r in simhash.fingerprint_groups(docs).collect()}
    assert found[1] == found[2] == found[None] and 3 not in found and 4 not in found and found[5] == found[6]
    assert sorted(r.doc_id for r in N.keep_first(docs).collect() if r.doc_id) == [1, 2, 4, 5]
    kept = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert sorted(r.doc_id for r in kept.collect()) == [1, 4, 5] and kept.schema == docs.schema
    assert corpus_pipeline.drop_near_copies(spark, docs.filter("doc_id > 9"), "").count() == 0


def test_a_hot_shingle_inside_one_bucket_is_split(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 32)
    notice = " ".join(f"notice{i}" for i in range(40))
    # every text has the notice, and little else: all of them meet in one shingle of their prefixes
    rows = [(i, f"{notice} own{i}a own{i}b") for i in range(300)]
    docs = spark.createDataFrame(rows, DOCS)
    met = N.meetings(N.postings(docs, 0.8, 5, "doc_id", "text"))
    from pyspark.sql import functions as F

    sizes = met.groupBy("task", "sig").agg(F.countDistinct("k").alias("n")).agg(F.max("n"), F.count("*")).first()
    assert sizes[0] <= 64 and sizes[1] > 50
    assert [r.doc_id for r in N.keep_first(docs).collect()] == [0]


def test_counts_of_hashes_are_true_within_a_bucket(spark):
    from prismal.llm import buckets as B

    times = {3: 1, 5: 126, 7: 127, 11: 128, 13: 50_000, 1 << 40: 300}
    key = np.repeat(np.array(list(times), np.uint64), list(times.values()))
    owner = np.arange(len(key))
    asked = B.ask(0, key, owner).to_pylist() + B.ask(1, np.array([3, 13], np.uint64), np.zeros(2, np.int64)).to_pylist()
    table = spark.createDataFrame([(r["shard"], r["bucket"], bytearray(r["hashes"])) for r in asked], B.ASKED)
    got = B.answers(table).filter("bucket = 0").toArrow()
    at = np.array(sorted(times), np.uint64)
    total = [times[int(k)] + (int(k) in (3, 13)) for k in at]
    assert B.classes(at, got).tolist() == [n.bit_length() for n in total]
