import base64
import hashlib
import os
import random
import zipfile

import numpy as np
import pytest

from prismal.llm import buckets
from prismal.llm import suffix_dedup as S
from prismal.llm import warc_zip as Z

SF = "/root/testdata/sf0.001"


# ---- packages


@pytest.mark.parametrize("wide", [False, True])
def test_zip_is_read_by_ranges_and_by_the_standard_library(tmp_path, wide):
    members = [("archive/data.warc.gz", os.urandom(5000)), ("indexes/é.json", b"{}"), ("empty", b"")]
    data = Z.zip_package(members, wide)
    p = tmp_path / "x.zip"
    p.write_bytes(data)
    with zipfile.ZipFile(p) as z:
        assert z.testzip() is None and [(n, z.read(n)) for n in z.namelist()] == members
    asked = []
    package = Z.ZipReader(lambda at, n: asked.append(n) or data[at : at + n], len(data))
    for name, body in members:
        at, size = package.locate(name)
        assert data[at : at + size] == body
    assert (b"PK\6\6" in data) == wide


def test_foreign_zips(tmp_path):
    p = tmp_path / "y.zip"
    with zipfile.ZipFile(p, "w") as z:
        z.writestr(zipfile.ZipInfo("a"), b"x" * 100)
        with z.open(zipfile.ZipInfo("b"), "w", force_zip64=True) as f:
            f.write(b"yy")
        z.writestr("c", b"z" * 1000, zipfile.ZIP_DEFLATED)
        z.comment = b"PK\5\6 a comment that looks like an end record"
    data = p.read_bytes()
    package = Z.ZipReader(lambda at, n: data[at : at + n], len(data))
    at, size = package.locate("b")
    assert data[at : at + size] == b"yy" and set(package.members) == {"a", "b", "c"}
    with pytest.raises(ValueError, match="compressed"):
        package.locate("c")
    with pytest.raises(ValueError):
        Z.ZipReader(lambda at, n: b"x" * n, 100)


def test_records_round_trip_and_refuse_damage():
    r = Z.parse_record(Z.warc_record(5, "http://x/\r\n", "é\r\n\r\nx".encode()))
    assert r["page_id"] == 5 and r["payload"] == "é\r\n\r\nx".encode() and r["url"] == "http://x/%0D%0A" and r["record_type"] == "response"
    v = Z.parse_record(Z.warc_record(6, None, b"abc", 5))
    assert (v["record_type"], v["refers_to"], v["payload_bytes"], v["payload"], v["payload_digest"]) == ("revisit", 5, 3, None, Z.digest(b"abc"))
    import gzip

    raw = gzip.decompress(Z.warc_record(5, "u", b"payload")).replace(b"payload", b"pAyload")
    with pytest.raises(ValueError, match="differ"):
        Z.parse_record(gzip.compress(raw))


def test_round_trip_of_pages(spark, monkeypatch):
    rows = [(1, "u", "same"), (2, "v", "same"), (2, "v", "same"), (3, None, None), (4, "w", ""), (0, "x", "other"), (1, "u", "other"), (None, "n", "same"), (9, "big", "<p>" * 400_000)]
    pages = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, record_type string").repartition(3)
    out = Z.archive_round_trip(spark, pages)
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out.collect()), key=str)
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", 99), i)
    want = []
    for i, _, h in rows:
        b = (h or "").encode()
        again = i is not None and i > first[h or ""]
        want.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if again else "response", first[h or ""] if again else None))
    assert got == sorted(want, key=str)
    small = Z.archive_round_trip(spark, pages, min_bytes=10)
    assert {r.record_type for r in small.collect()} == {"response"}
    assert Z.archive_round_trip(spark, pages.limit(0)).count() == 0


def test_several_packages_and_payloads(spark, tmp_path):
    pages = spark.range(40).selectExpr("id AS page_id", "'u' AS url", "repeat(cast(id as string), 50) AS html", "cast(null as long) AS refers_to").coalesce(1)
    listed = Z.write_packages(pages, f"file://{tmp_path}/deep/er", package_bytes=1000, zip64=True).cache()
    assert listed.count() > 2 and sum(r.n_records for r in listed.collect()) == 40
    back = {r.page_id: bytes(r.payload) for r in Z.read_packages(listed).collect()}
    assert back == {i: str(i).encode() * 50 for i in range(40)}


# ---- repeats


def brute(rows, size=50):
    rank = lambda i: 1 << 62 if i is None else i
    texts, first = [(i, (t or "").encode()) for i, t in rows], {}
    for i, b in texts:
        for k in range(len(b) - size + 1):
            first[b[k : k + size]] = min(rank(i), first.get(b[k : k + size], 1 << 63))
    out = []
    for i, b in texts:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - size + 1):
            if first[b[k : k + size]] < rank(i):
                gone[k : k + size] = True
        out.append((i, len(b), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out, key=str)


def spans(df):
    return sorted(map(tuple, S.repeated_spans(df).collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_removed_bytes_equal_brute_force(spark, monkeypatch, seed):
    rng = random.Random(seed)
    base = "".join(rng.choice("abcdé ") for _ in range(700))
    line = "".join(rng.choice("xyz ") for _ in range(80))

    def text():
        parts = []
        for _ in range(rng.randint(0, 4)):
            a = rng.randint(0, 600)
            parts.append(rng.choice([base[a : a + rng.randint(10, 90)], line, "q" * rng.randint(1, 120), "".join(rng.choice("mnop ") for _ in range(60)), base[a : a + 49]]))
        return rng.choice([None, "", base, "".join(parts), "".join(parts), "ab" * 60])

    rows = [(rng.choice([None, *range(40)]), text()) for _ in range(120)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, bucket int").repartition(6)
    assert spans(df) == brute(rows)
    unique = [(i, t) for i, (_, t) in enumerate(rows)]
    monkeypatch.setattr(S, "SHARD_BYTES", 2000)
    monkeypatch.setattr(S, "BUCKET_BYTES", 3000)
    assert spans(spark.createDataFrame(unique, "doc_id long, text string").repartition(5)) == brute(unique)


def test_whole_small_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert spans(docs) == brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


@pytest.mark.parametrize("letters", [b"ab", b"ab\0", b"abcdefgh"])
@pytest.mark.parametrize("size", [8, 10, 20, 50])
def test_runs_cover_all_windows_and_factors_equal_brute_force(size, letters):
    rng = random.Random(size)
    for _ in range(12):
        texts = [bytes(rng.choice(letters) for _ in range(rng.randint(0, 130))) for _ in range(rng.randint(1, 7))]
        texts += [texts[0][:60] + texts[-1][-70:]]
        data, ends = b"".join(texts), np.cumsum([len(t) for t in texts], dtype=np.int64)
        h, doc, begin, count = S.runs(data, ends, size, stretch=rng.choice([7, 64, 1000]))
        windows = sorted((int(d), int(b) + i, int(x)) for x, d, b, c in zip(h, doc, begin, count) for i in range(c))
        assert [w[:2] for w in windows] == [(d, int(ends[d]) - len(t) + i) for d, t in enumerate(texts) for i in range(len(t) - size + 1)] and max(count, default=0) <= S.LONGEST
        by_text = {}
        for d, s, x in windows:
            assert by_text.setdefault(data[s : s + size], x) == x
        if not windows:
            continue
        at, of = np.array([w[1] for w in windows]), np.array([w[0] for w in windows])
        owner = np.array([rng.randint(0, 4) for _ in texts])[of]
        lengths = ends[of] - at
        got = S.previous_factors(data, at, lengths, owner, 1)
        suffixes = [data[s : s + n] for s, n in zip(at.tolist(), lengths.tolist())]
        want = [max((len(os.path.commonprefix([a, b])) for b, e in zip(suffixes, owner) if e < d), default=0) for a, d in zip(suffixes, owner)]
        # where zero bytes stand in for a suffix's end, a factor may be found shorter, never longer
        assert got.tolist() == want if 0 not in letters else (got <= want).all()


def test_factors_are_longer_than_the_window(monkeypatch):
    text = bytes(range(65, 125)) * 2
    run, begin, end = S.earlier_ranges(text + text[5:], np.array([120, 235]), np.array([3, 7]), 50)
    assert (run.tolist(), begin.tolist(), end.tolist()) == ([1], [0], [115])


def test_frequent_hashes_long_texts_and_other_sizes(spark, monkeypatch):
    rng = random.Random(11)
    notice = "".join(rng.choice("abcdefghijklmnop ") for _ in range(130))
    rows = [(i, "".join(rng.choice("rstuvwxyz ") for _ in range(rng.randint(0, 90))) + notice + "".join(rng.choice("rstuvwxyz ") for _ in range(40))) for i in range(60)]
    rows += [(70, None), (71, ""), (72, notice * 300), (72, "q" * 5000 + notice), (None, notice), (None, notice), (None, "x" + notice)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for name, value in (("FREQUENT", 3), ("STRETCH", 999), ("SHARD_BYTES", 3000), ("BUCKET_BYTES", 9000), ("SORT_BYTES", 2000)):
        monkeypatch.setattr(S, name, value)
    monkeypatch.setattr(buckets, "HASH_SHARD_BYTES", 5000)
    assert spans(df) == brute(rows)
    for size in (9, 20):
        assert sorted(map(tuple, S.repeated_spans(df, size=size).collect()), key=str) == brute(rows, size)
    with pytest.raises(ValueError, match="8 bytes"):
        S.repeated_spans(df, size=7)


def test_previous_smaller():
    rng = np.random.default_rng(1)
    for _ in range(40):
        d, lcp = rng.integers(0, 5, 60), rng.integers(0, 60, 60).astype(np.int16)
        got = S.previous_smaller(d, lcp, 20)
        for i in range(60):
            j, best = i, 99
            while True:
                best = min(best, lcp[j] if j else 0)
                j -= 1
                if j < 0 or d[j] < d[i]:
                    break
            want = best if j >= 0 and best >= 20 else 0
            assert got[i] == want


def test_cut_texts_keep_rows_columns_and_characters(spark):
    p = "é" * 40
    rows = [(1, "ab" + p + "cd", "x", 1), (2, "zz" + p, None, 2), (3, None, "y", 3), (4, "ab" + p + "cd", "w", None), (5, "short", "v", 5)]
    out = {r.doc_id: r for r in S.without_repeats(spark.createDataFrame(rows, "doc_id long, text string, rows string, n_chars long")).collect()}
    assert len(out) == 5 and out[1].text == rows[0][1] and out[2].text == "zz" and out[3].text is None and out[4].text == "" and out[5].text == "short" and out[2].n_chars == 2
    assert S.repeated_spans(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    clash = spark.createDataFrame([(1, p, 1, "a", 2, None), (2, "x" + p, 2, "b", None, 3)], "doc_id int, text string, _id int, bucket string, _bucket int, rows int")
    less = S.without_repeats(clash)
    assert less.schema == clash.schema and sorted(map(tuple, less.collect())) == [(1, p, 1, "a", 2, None), (2, "x", 2, "b", None, 3)]
