import hashlib
import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from prismal.llm import packing as P
from prismal.llm import tiff as T
from prismal.llm import token_counts as C

WORD = public_tokenizers.path("word_bpe_49k.json")
PIECE = public_tokenizers.path("piece_bpe_32k.model")
ALPHABET = "ab'sTHE \n\t  ▁é<s>|/ſ\r​Ж中😀.İς$_7½ªß'm\x00\x0b\x1c"


@pytest.fixture(scope="module")
def counter():
    return C.Counter(PIECE)


@pytest.fixture(scope="module")
def encoder():
    return P.WordEncoder(WORD)


def test_the_proof_holds_for_the_vocabulary(counter):
    assert counter.provable and counter.proved > 10_000
    some = random.Random(0).sample(sorted(counter.base[0]), 300)
    assert all(len(counter.sp.encode(w)) == 1 for w in some)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.text(ALPHABET, max_size=40), st.text(max_size=20), st.text("ab c\nd", max_size=60)), max_size=5))
def test_counts_equal_the_library(counter, texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    assert counter.count(texts) == [len(counter.sp.encode(t)) for t in texts]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.text(ALPHABET, max_size=40), st.text(max_size=20), st.text("aBc 'stre.,7é\n", max_size=60)), max_size=5))
def test_ids_equal_the_tokenizer(encoder, texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    want = [np.array(encoder.tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert encoder.encode(texts) == want


def test_special_strings_and_cache_turns(encoder, monkeypatch):
    monkeypatch.setattr(P, "CACHE", 3)
    for t in ("a<|endoftext|>b", "one two three four five", "six one seven", "it's we'll I'm 42 _x_ ..'s", "Straße ŸÆ ﬁ"):
        assert encoder.encode([t])[0] == np.array(encoder.tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes()


def test_token_count_rows(spark):
    docs = spark.createDataFrame([(1, None, 5), (2, "", 5), (None, "héllo wörld", 5), (2, "a " * 5000, 5)], "doc_id long, text string, n_tokens int")
    got = sorted(((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in C.token_counts(docs, PIECE).collect()), key=str)
    sp = C.Counter(PIECE).sp
    assert got == sorted([(1, 0, 0, False), (2, 0, 0, False), (None, 13, len(sp.encode("héllo wörld")), False), (2, 10_000, len(sp.encode("a " * 5000)), True)], key=str)
    assert C.token_counts(docs.limit(0), PIECE).count() == 0


# ---- packing


def test_bounds_never_exceed_an_optimal_packing():
    rng = random.Random(0)

    def optimum(items, cap):
        best = [len(items)]

        def place(i, bins):
            if len(bins) >= best[0]:
                return
            if i == len(items):
                best[0] = len(bins)
                return
            for k in range(len(bins)):
                if bins[k] + items[i] <= cap:
                    bins[k] += items[i]
                    place(i + 1, bins)
                    bins[k] -= items[i]
            place(i + 1, [*bins, items[i]])

        place(0, [])
        return best[0]

    for _ in range(60):
        items = sorted((rng.randint(1, 20) for _ in range(rng.randint(1, 8))), reverse=True)
        bound, best = P.lower_bound(np.array(items), 20), optimum(items, 20)
        where, offset, n = P.best_fit_decreasing(np.array(items), 20)
        assert bound <= best <= n and n == len(set(where.tolist()))
    assert P.lower_bound(np.array([11] * 5), 20) == 5 and P.lower_bound(np.array([7] * 6), 20) == 3 and P.lower_bound(np.zeros(0, int), 20) == 0


def check_packing(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_packing_is_whole_and_gapless(spark, monkeypatch):
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["cat", "unrealistically", "Dog.", "x1"]) for _ in range(rng.randint(0, 60))) for _ in range(300)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(1, texts[1]), (None, "null id"), (900, None), (901, "z " * 500)]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, piece int, length int").repartition(4)
    tok = P.WordEncoder(WORD).tok
    want = {}
    for d, t in rows:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        for k, at in enumerate(range(0, len(ids), 64)):
            part = ids[at : at + 64]
            key = (d, k, at, len(part), zlib.crc32(part.tobytes()))
            want[key] = want.get(key, 0) + 1
    counts = []
    for size in (10_000, 60):
        monkeypatch.setattr(P, "PARTITION_PIECES", size)
        out = P.pack(docs, WORD, 64).collect()
        got = {}
        for r in out:
            key = (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
            got[key] = got.get(key, 0) + 1
        assert got == want
        counts.append(check_packing(out, 64))
    least = P.lower_bound(np.array([k[3] for k, n in want.items() for _ in range(n)]), 64)
    assert least <= counts[0] <= least + 2 and counts[1] <= counts[0] + 12


def test_packing_of_nothing(spark):
    assert P.pack(spark.createDataFrame([], "doc_id long, text string"), WORD).count() == 0


# ---- TIFF


@settings(max_examples=150, deadline=None)
@given(st.binary(min_size=0, max_size=3000))
def test_codecs_round_trip(data):
    assert T.lzw_decode(T.lzw_encode(data), len(data)) == data
    assert T.packbits_decode(T.packbits_encode(data), len(data)) == data


@pytest.mark.parametrize("how", [T.NONE, T.LZW, T.DEFLATE, T.PACKBITS])
@pytest.mark.parametrize("tile", [None, (16, 32)])
@pytest.mark.parametrize("order", ["<", ">"])
def test_pages_round_trip(how, tile, order):
    rng = np.random.default_rng(how)
    pages = [rng.integers(0, top, (r, c)).astype(np.uint8) for top, r, c in ((256, 70, 45), (3, 1, 1), (2, 33, 64))]
    for predictor in (1, 2):
        found = list(T.read_pages(T.write_tiff(pages, how, predictor, 7, tile, order)))
        assert len(found) == 3 and all((f[1][:, :, 0] == p).all() for f, p in zip(found, pages))
        assert found[0][0]["tiled"] == bool(tile) and found[0][0]["compression"] == how


def test_long_lzw_fills_and_clears_its_table():
    data = np.random.default_rng(0).integers(0, 256, 60_000).astype(np.uint8).tobytes()
    assert T.lzw_decode(T.lzw_encode(data), len(data)) == data


def test_published_lzw_example():
    # the TIFF 6.0 text's own example: 7 7 7 8 8 7 7 6 6 gives codes 256 7 258 8 8 258 6 6 257
    bits = "".join(f"{c:09b}" for c in (256, 7, 258, 8, 8, 258, 6, 6, 257))
    packed = int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
    assert T.lzw_encode(bytes((7, 7, 7, 8, 8, 7, 7, 6, 6))) == packed


def test_sixteen_bit_samples_and_bad_files():
    body = np.array([[1, 2, 500]], "<u2")
    raw = bytearray(T.write_tiff([np.zeros((1, 6), np.uint8)], T.NONE, 1))
    first = next(T.directories(bytes(raw)))[1]
    raw[first[T.STRIP_OFFSETS][0] : first[T.STRIP_OFFSETS][0] + 6] = body.tobytes()
    data = bytes(raw).replace(b"\x02\x01\x03\x00\x01\x00\x00\x00\x08", b"\x02\x01\x03\x00\x01\x00\x00\x00\x10").replace(b"\x00\x01\x04\x00\x01\x00\x00\x00\x06", b"\x00\x01\x04\x00\x01\x00\x00\x00\x03")
    assert next(T.read_pages(data))[1][:, :, 0].tolist() == body.tolist()
    with pytest.raises(ValueError):
        list(T.read_pages(b"nope"))


def test_files_that_cannot_be_read_are_rows(spark):
    good = T.write_tiff([np.arange(12, dtype=np.uint8).reshape(3, 4)] * 2, T.LZW, 2)
    tag = struct.pack("<HHI", T.PREDICTOR, 3, 1)
    at = good.rindex(tag)
    third = good[: at + 8] + b"\x03" + good[at + 9 :]
    strip = next(T.directories(good))[1][T.STRIP_OFFSETS][0]
    files = [good, b"nope", good[:-40], third, good[:strip] + bytes(4) + good[strip + 4 :], None, b"II*\0", T.write_tiff([np.zeros((9, 9), np.uint8)], T.NONE, 1)[:40]]
    rows = T.explode_pages(spark.createDataFrame(list(enumerate(files)), "media_id long, media binary")).collect()
    by = {i: sorted((r for r in rows if r.media_id == i), key=lambda r: r.page) for i in range(len(files))}
    assert [(r.page, r.error, len(r.pixels)) for r in by[0]] == [(0, None, 12), (1, None, 12)] and not by[5]
    assert all(by[i] and by[i][-1].error and by[i][-1].pixels is None for i in (1, 2, 3, 4, 6, 7)) and "predictor 3" in by[3][-1].error


def test_text_media_rows(spark, monkeypatch):
    texts = [None, "", "a" * 64, "b" * 65, "é" * 100_000, "a" * 64]
    docs = spark.createDataFrame([(i if i else None, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, media string")
    out = {r.doc_id: r for r in T.media_digest(T.text_media(docs)).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        padded = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        r = out[i if i else None]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
    assert out[2].media_sha256 == out[5].media_sha256 and out[2].feature == out[5].feature and out[4].feature.startswith("pages=1;")
    media = T.text_media(docs)
    pages = T.explode_pages(media.unionByName(spark.createDataFrame([(77, 0, None)], "media_id long, n_bytes long, media binary"))).collect()
    assert len(pages) == 6 and sum(len(p.pixels) for p in pages) == sum(r.payload_bytes for r in out.values())
    assert T.media_digest(T.text_media(docs.limit(0))).count() == 0
    assert len(list(T.read_pages(T.payload_tiff("x" * (64 * T.PAGE_ROWS + 1))[1]))) == 2
    assert media.filter(F.col("media_id") == 2).count() == 1
