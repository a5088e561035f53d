import random
import zlib
from hashlib import sha256

import pytest

from prismal.llm import merkle as M

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, rank int, cell string, total int"
COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climb(nodes):
    """Root, and of every node the (left, right) siblings level by level."""
    ways, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for way, i in zip(ways, at):
            run = i - i % 8
            way.append(("".join(nodes[run:i]), "".join(nodes[i + 1 : run + 8])))
        nodes, at = [h(*nodes[i : i + 8]) for i in range(0, len(nodes), 8)], [i // 8 for i in at]
    return nodes[0], ways


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    found = {}
    for g in names:
        groups[g].sort(key=lambda r: (r[0] is None, r[0] or 0, leaf(r)))
        found[g] = climb([leaf(r) for r in groups[g]])
    root, tops = climb([found[g][0] for g in names])
    out = []
    for g, top in zip(names, tops):
        for r, way in zip(groups[g], found[g][1]):
            now = r
            if r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0:
                now = (*r[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4]))
            folded = leaf(now)
            for a, b in way + top:
                folded = h(a, folded, b)
            proof = h(*(x for step in way + top for x in step))
            out.append((r[0], leaf(r), found[g][0], root, proof, folded, folded == root))
    return sorted(out, key=str)


def some(seed, n):
    draw = random.Random(seed)
    ids = [None, 3, 3, 3, -(2**63), 2**63 - 1, *range(40), *(draw.randrange(-(2**40), 2**40) for _ in range(5))]
    langs = ["en", "en", "en", None, "de", "\U0001f600", "\uffff", ""]
    texts = [None, "", "ABC Äé", "abc", "Long " * 3000, "x"]
    return [(draw.choice(ids), draw.choice([None, "src1"]), draw.choice(langs), draw.choice([None, 7]), draw.choice(texts)) for _ in range(n)]


def got(spark, rows):
    table = spark.createDataFrame([(*r, 1, "c", 2) for r in rows], SCHEMA).repartition(3)
    return sorted(map(tuple, M.manifest(table, altered={"text": M.tampered_text()}).select(COLUMNS).collect()), key=str)


@pytest.mark.parametrize("small", [False, True])
def test_manifest_equals_brute_force(spark, monkeypatch, small):
    if small:
        for name, value in (("CELL", 2), ("HEAVY", 3), ("DIGIT", 5), ("COPIES", 2), ("DEPTH", 1)):
            monkeypatch.setattr(M, name, value)
    rows = some(1, 150) + [(3, "s", "en", 1, "same")] * 7 + [(3, "s", "en", 1, f"T{i}") for i in range(9)]
    assert got(spark, rows) == brute(rows)


def test_one_row_one_group_and_none(spark):
    one = [(5, "s", "en", 1, "Text")]
    assert got(spark, one) == brute(one)
    nine = [(i, "s", None, 1, "T") for i in range(9)]
    assert got(spark, nine) == brute(nine)
    assert got(spark, []) == []


def test_unaltered_rows_verify_and_any_field_counts(spark):
    from pyspark.sql import functions as F

    table = spark.createDataFrame([(i, "s", "en", i, "t") for i in range(20)], "doc_id long, source string, lang string, n_chars long, text string")
    assert M.manifest(table).filter("verified").count() == 20
    changed = M.manifest(table, altered={"n_chars": F.when(F.col("doc_id") == 4, 5).otherwise(F.col("n_chars"))})
    assert [r.doc_id for r in changed.filter("not verified").collect()] == [4]
