import math
import random
import re

import duckdb
import pytest

from prismal.llm import lexical as L

DOCS = "doc_id long, text string, score int, term string"
TERM = re.compile("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute(docs, items, k):
    """Scores of every document by the definition."""
    split = [(d[0], TERM.findall(lowered(d[1]))) for d in docs]
    split = [(i, ts) for i, ts in split if ts]
    n_docs, n_terms = len(split), sum(len(ts) for _, ts in split)
    out = []
    for item, text in sorted(set(items), key=str):
        scored = []
        for i, ts in split:
            total = 0
            for t in TERM.findall(lowered(text)):
                df, tf = sum(t in x for _, x in split), ts.count(t)
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
                m = 100 - 75 + 75 * len(ts) * n_docs // n_terms
                total += w * (1_000_000_000 * tf // (1000 * tf + 8 * m)) if tf else 0
            if total > 0:
                scored.append((-total, i is None, i or 0))
        out += [(item, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def rows(df):
    return sorted(map(tuple, df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


def some(seed, n):
    draw = random.Random(seed)
    words = ["Apple", "apple", "ÄPFEL", "äpfel", "x9", "of", "of", "of", "中文", "re-do", "q"]
    texts = [" ".join(draw.choices(words, k=draw.randrange(12))) for _ in range(n)] + [None, "", " -- ", "of " * 4000]
    return [(draw.choice([None, 7, 7, *range(-5, 40)]), t, 1, "a") for t in texts]


ITEMS = [(1, "apple of äpfel"), (1, "of of of"), (2, "APPLE apple x9"), (2, "APPLE apple x9"), (3, None), (4, "--"), (None, "re do 中文"), (5, "nowhere")]


@pytest.mark.parametrize("window,block", [(1 << 14, 1 << 20), (3, 20)])
def test_ranks_equal_brute_force(spark, monkeypatch, window, block):
    monkeypatch.setattr(L, "WINDOW", window)
    docs = some(window, 60)
    # rows equal in id tie: every one has a rank of its own
    got = L.search(spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(ITEMS, "item_id long, text string"), k=5, block_bytes=block)
    assert rows(got) == brute(docs, ITEMS, 5)


def test_twin_equals_brute_force():
    docs = [(i, d[1]) for i, d in enumerate(some(5, 50))]
    con = duckdb.connect()
    con.sql("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.sql("CREATE TABLE benchmark (item_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", docs)
    con.executemany("INSERT INTO benchmark VALUES (?, ?)", ITEMS)
    assert sorted(con.sql(L.search_sql(4)).fetchall(), key=str) == brute(docs, ITEMS, 4)


def test_empty_tables(spark):
    docs, items = spark.createDataFrame(some(1, 5), DOCS), spark.createDataFrame(ITEMS, "item_id long, text string")
    assert L.search(docs.limit(0), items).count() == 0
    assert L.search(docs, items.limit(0)).count() == 0
    assert L.search(docs.filter("text is null"), items).count() == 0


def test_heap_keeps_smallest_ids_of_equal_scores():
    import numpy as np

    best = L.Best(2)
    best.harvest(np.array([5, 5, 5, 1]), np.array([9, 11, 12, 0]), np.ones(4, np.uint8))
    best.harvest(np.array([5, 5]), np.array([3, 10]), np.ones(2, np.uint8))
    assert sorted(best.heap) == [(5, 1, -9), (5, 1, -3)]
