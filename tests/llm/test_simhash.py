import random
import re

import numpy as np
import pytest
import xxhash

from prismal.llm import common, simhash as S

DOCS = "doc_id long, text string"


def reference_print(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    sh = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64(x.encode(), 42).intdigest() for x in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def labels_of(links, n):
    lab = np.arange(n)
    while True:
        new = np.array([lab[links[i]].min() for i in range(n)])
        if (new == lab).all():
            return lab
        lab = new


@pytest.mark.parametrize("text", [None, "", " \n\t", "One", "one two", "Ärger UND ÄRGER und\x0bx", "a b c d e f " * 40, "x" * 5000, "a\x1cb c d", "w " * 70_000])
def test_fingerprint_equals_its_definition(text):
    assert S.simhash(text) == reference_print(text)


def prints(seed=5, centres=30, near=1500, far=800):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 1 << 63, centres, dtype=np.uint64)
    out = [base, rng.integers(0, 1 << 63, far, dtype=np.uint64)]
    for _ in range(near):
        x = base[rng.integers(centres)]
        for b in rng.integers(0, 64, rng.integers(0, 6)):
            x ^= np.uint64(1 << int(b))
        out.append(np.array([x], np.uint64))
    return np.unique(np.concatenate(out))


@pytest.mark.parametrize("rows", [60, 500, 64_000])
def test_links_equal_brute_force_at_any_shard_size(spark, rows):
    f = prints()
    want = labels_of(np.bitwise_count(f[:, None] ^ f[None, :]) <= 3, len(f))
    df = spark.createDataFrame([(int(x),) for x in f.view(np.int64)], "fp long").repartition(3)
    root = {r.node: r.root for r in common.connected_components(S.near_links(df, 3, 700, rows)).collect()}
    got = [root.get(int(x), int(x)) for x in f.view(np.int64)]
    pairing = dict(zip(want, got))
    assert all(pairing[a] == b for a, b in zip(want, got)) and len(set(got)) == len(set(want))


def test_a_tree_loses_no_pair_across_its_boundaries():
    f = prints(9, 10, 600, 200)
    tree = S.Tree(f[::3], len(f), 3, 50)
    seen = set()
    for _, homes, guests in tree.route(f):
        both = np.concatenate([homes, guests])
        for h in homes:
            seen |= {tuple(sorted((int(h), int(x)))) for x in both[np.bitwise_count(both ^ h) <= 3]}
    y, x = np.nonzero(np.bitwise_count(f[:, None] ^ f[None, :]) <= 3)
    assert seen >= {tuple(sorted((int(f[a]), int(f[b])))) for a, b in zip(y, x)} and len(tree.nodes) > 3


def test_groups_and_edge_rows(spark):
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(400)]
    base = " ".join(rng.choice(words) for _ in range(300))
    rows = [(7, base), (3, base), (3, base), (9, base.upper()), (None, base), (20, ""), (21, None), (22, " \n"), (30, "solo words here now"), (31, base.replace(words[0], "zzzzz"))]
    out = S.simhash_groups(spark.createDataFrame([(*r, "x") for r in rows], DOCS + ", component_id string").repartition(3)).collect()
    assert len(out) == len(rows)
    by = {}
    for r in out:
        by.setdefault(r.doc_id, set()).add((r.fingerprint, r.component_id))
    assert all(len(v) == 1 for v in by.values())
    got = {k: next(iter(v)) for k, v in by.items()}
    assert got[7][1] == got[9][1] == got[None][1] == 3 and got[3][0] == f"{reference_print(base):016x}"
    assert got[20] == got[21] == got[22] == ("0" * 16, 20) and got[30][1] == 30
    kept = S.keep_first_of_groups(spark.createDataFrame(rows, DOCS)).collect()
    ids = [r.doc_id for r in kept]
    assert ids.count(3) == 1 and 7 not in ids and 9 not in ids and 21 not in ids and None in ids and 20 in ids and 30 in ids


def test_differing_texts_under_one_id_are_decided_each(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 2)
    a, other = " ".join(f"w{i}" for i in range(60)), "quite another text of some words"
    rows = [(1, a), (5, a), (5, other), (6, a), (6, a), (7, other), (7, other)]
    kept = S.keep_first_of_groups(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted(map(tuple, kept)) == [(1, a), (5, other)]
    out = S.simhash_groups(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted((r.doc_id, r.component_id) for r in out) == [(1, 1), (5, 1), (5, 5), (6, 1), (6, 1), (7, 5), (7, 5)]


def test_empty_table(spark):
    assert S.simhash_groups(spark.createDataFrame([], DOCS)).count() == 0


def test_components_of_chains_stars_and_cycles(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, x) for x in range(101, 130)] + [(200, 201), (201, 202), (202, 200), (5, 5), (None, 3), (1, 2)]
    got = {r.node: r.root for r in common.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    want = {i: 1 for i in range(1, 41)} | {i: 100 for i in range(100, 130)} | {i: 200 for i in (200, 201, 202)}
    assert got == want
    assert common.connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_scratch_lies_in_the_named_folder_and_can_be_discarded(spark):
    import os

    common.discard_scratch(spark)
    df = common.written(spark.range(3), "t")
    path = common._paths[spark.sparkContext][0]
    assert path.startswith(spark.conf.get("spark.checkpoint.dir")) and df.count() == 3
    assert common.discard_scratch(spark) == 1 and not os.path.exists(path.removeprefix("file://")) and common.discard_scratch(spark) == 0


@pytest.mark.parametrize("limit", [1_000_000, 0])
def test_rows_without_ids_either_way(spark, monkeypatch, limit):
    monkeypatch.setattr(common, "BROADCAST_IDS", limit)
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b"), (None, "c")], "k long, ids string")
    out = common.without_ids(rows, spark.createDataFrame([(2,), (2,), (None,)], "k long"), "k")
    assert sorted(map(str, ((r.k, r.ids) for r in out.collect()))) == ["(1, 'a')", "(None, 'c')"] and out.columns == rows.columns
