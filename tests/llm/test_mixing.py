import random
from collections import Counter, defaultdict

import duckdb
import pytest

from prismal.llm import mixing as M

SCHEMA = "doc_id long, text string, source string, size int, key string, cls int, q double"


def some(seed, n):
    draw = random.Random(seed)
    sources = ["a", "a", "a", "b", "\uffff", "\U0001f600", None, "tiny", ""]
    rows = [(i, " ".join(["w"] * draw.choice([0, 1, 2, 3, 5, 8, 40, 90])), draw.choice(sources)) for i in range(n)]
    rows += [(None, None, "a"), (None, "", None), (5, "x \x0b y\u00a0z\r", "b"), (6, "w " * 3000, "long")]
    # repeated rows, with and without an id
    return rows + [(7, "one two three", "b")] * 40 + [(None, "one two", "b")] * 40 + [(900, "lone word", "odd")]


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "k", 2, 0.5) for r in rows], SCHEMA)


def rows_of(df):
    return sorted(map(tuple, df.select("doc_id", "size", "source_size", "target", "taken", "copies").collect()), key=str)


def twin(rows, weights=(1, 2, 3), most=3, seed=42):
    con = duckdb.connect()
    con.sql("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    if rows:
        con.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    return sorted(con.sql(M.mix_sql(weights, most, seed)).fetchall(), key=str)


@pytest.mark.parametrize("bucket,weights", [(2048, (1, 2, 3)), (3, (1, 9))])
def test_mix_equals_twin_and_meets_targets(spark, monkeypatch, bucket, weights):
    monkeypatch.setattr(M, "BUCKET", bucket)
    rows = some(bucket, 300)
    got = rows_of(M.mix(table(spark, rows).repartition(5), weights))
    assert got == twin(rows, weights) and len(got) == len(rows)
    by = defaultdict(int)
    for (_, size, words, target, taken, _) in got:
        by[words, target] += taken
        assert taken <= 3 * size and (taken == 0 or size > 0)
    assert abs(sum(t for _, t in by) - sum(r[1] for r in got)) < 1e-6
    for (words, target), taken in by.items():
        assert target <= 3 * words and (words == 3000 or abs(taken - target) <= 45)  # half of the longest other document


def test_targets_by_resharing(spark):
    from prismal.llm.common import written

    sizes = {"a": 1000, "b": 1, "c": 2, "d": 30, "e": 0, "f": 700}
    given = written(spark.createDataFrame([(k, 1, v) for k, v in sizes.items()], "src string, n long, source_size long"), "t")
    got = {r.src: r.target for r in M.targets(given).collect()}
    share, left = dict(zip(sizes, (1, 2, 3, 1, 2, 3))), sum(sizes.values())
    want, free = {}, set(sizes)
    while True:
        level = left / sum(share[s] for s in free)
        over = {s for s in free if level * share[s] > 3 * sizes[s]}
        if not over:
            break
        for s in over:
            want[s] = 3 * sizes[s]
            left -= want[s]
        free -= over
    want |= {s: level * share[s] for s in free}
    assert got == pytest.approx(want)


def test_every_document_is_drawn_as_often_as_its_share(spark):
    draw = random.Random(3)
    rows = [(i, "w " * draw.choice([1, 4, 9, 30, 31]), "a" if i % 4 else "b") for i in range(200)]
    times, rate = Counter(), {}
    for seed in range(60):
        for i, size, words, target, taken, copies in twin(rows, seed=seed):
            times[i] += copies
            rate[i] = target / words
    # 60 draws of a probability lie within four deviations
    assert all(abs(times[i] / 60 - rate[i]) < 4 * (0.25 / 60) ** 0.5 for i in rate)


def test_empty_tables_and_texts_without_words(spark):
    assert rows_of(M.mix(table(spark, []))) == []
    none = [(1, None, "a"), (2, " ", "b"), (2, " ", "b")]
    assert rows_of(M.mix(table(spark, none))) == twin(none) and all(r[4] == 0 for r in twin(none))


def test_mixed_documents_are_rows_as_often_as_taken(spark):
    rows = some(9, 60)
    docs = table(spark, rows)
    want = Counter()
    for r in M.mix(docs).collect():
        want[r.key] += r.copies
    mixed = M.mixed_documents(docs)
    assert mixed.columns == docs.columns
    got = Counter(r[0] for r in mixed.select(M._key("doc_id", "text", "source")).collect())
    assert got == +want
