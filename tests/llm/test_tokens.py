import base64
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from netloom.llm import bpe, chunking, packing

public = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def exact():
    with open(public.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.read_vocab())


PARTS = ["'", "s", "re", "ll", "v", "d", "S", " ", "  ", "\n", "\r\n", "\t", "1", "23", "é", "中文", ".", "。", "-", " ", "\x1c", "\x85", "​", "😀", "½", "<|endoftext|>", "hello", "Größe", "aaaa"]


def messy(rng, n):
    return "".join(rng.choice(PARTS) for _ in range(n))


def test_equal_to_the_public_library(encoder, exact):
    rng = random.Random(1)
    texts = ["", "x", "'", "it's 'sun ''s we'll I'VE", "a" * 9000, "=" * 3000, "中" * 4000, " " * 3000, "\n" * 999 + "x", "ab1" * 4000]
    texts += [messy(rng, rng.randrange(0, 25)) for _ in range(4000)]
    e = encoder.encode_slice(pa.array(texts))
    ids = e.ids()
    for i, t in enumerate(texts):
        assert ids[e.text_tokens[i] : e.text_tokens[i + 1]].tolist() == exact.encode_ordinary(t), repr(t[:80])


def test_merge_many_equals_merging_one_by_one(encoder):
    rng = random.Random(2)
    words = [messy(rng, rng.randrange(1, 12)).encode() for _ in range(500)] + [b"aaaaaaa", b"abababab", b"\xff\xfe"]
    at = np.concatenate([[0], np.cumsum([len(w) for w in words])])
    owner, token = encoder.merge_many(np.frombuffer(b"".join(words), np.uint8), at[:-1], at[1:])
    for i, w in enumerate(words):
        assert token[owner == i].tolist() == encoder._merge(w)


def test_pair_check_equals_merging(encoder):
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 50256, 3000), rng.integers(0, 2000, 3000)
    got = encoder.pairs_good(a.astype(np.int32), b.astype(np.int32))
    for x, y, good in zip(a, b, got):
        assert good == (encoder._merge(encoder.tokens[x] + encoder.tokens[y]) == [x, y])


def test_every_token_is_its_own_encoding(encoder):
    token, at = encoder.encode_words(encoder.token_data, encoder.token_offsets)
    assert (np.diff(at) == 1).all() and (token == np.arange(len(encoder.tokens))).all()


DOCS = "doc_id bigint, text string, ids string, key string, n_tokens string"


def doc_rows():
    rng = random.Random(4)
    texts = [None, "", " ", "a", "a", messy(rng, 40), "word " * 30_000, "x" * 20_000, "\n\n".join(messy(rng, 300) for _ in range(9))]
    return [(i, t, "", "", "") for i, t in enumerate(texts)] + [(3, "a", "", "", ""), (None, "null key", "", "", "")]


def test_encode_column(spark, exact):
    rows = doc_rows()
    out = bpe.encode_column(spark.createDataFrame(rows, DOCS), "doc_id").collect()
    assert sorted((str(r.doc_id), r.ids) for r in out) == sorted((str(k), exact.encode_ordinary(t or "")) for k, t, *_ in rows)
    counts = bpe.count_column(spark.createDataFrame(rows, DOCS), "doc_id").collect()
    assert sorted((str(r.doc_id), r.n_tokens) for r in counts) == sorted((str(k), len(exact.encode_ordinary(t or ""))) for k, t, *_ in rows)
    assert bpe.encode_column(spark.createDataFrame([], DOCS), "doc_id").count() == 0


def test_bytes_that_are_not_text(encoder, exact):
    bad = pa.array([b"ab\xffc", b"ok", None], pa.binary())
    e = encoder.encode_slice(bad)
    assert e.ids().tolist() == exact.encode_ordinary("ab�c") + exact.encode_ordinary("ok")


def test_slices_are_bounded():
    texts = pa.array(["a" * 10, None, "b" * 50, "", "c" * 10, "d" * 10])
    assert list(bpe.slices(texts, 25)) == [(0, 2), (2, 3), (3, 6)] and list(bpe.slices(pa.array([], pa.string()))) == []


def check_packing(rows, capacity, out):
    sizes = {}
    for r in out:
        if r.container is None:
            assert r.size == 0
        else:
            sizes[r.container] = sizes.get(r.container, 0) + r.size
    assert all(0 < s <= capacity for s in sizes.values())
    pieces = {}
    for r in out:
        pieces.setdefault(r.doc_id, []).append((r.piece, r.start, r.size))
    for key, size in rows:
        mine = sorted(pieces[key])
        size = max(size or 0, 0)
        assert sum(p[2] for p in mine) == size and [p[1] for p in mine] == [i * capacity for i in range(len(mine))]
        assert len(mine) == 1 or size > capacity
    return sizes


@pytest.mark.parametrize("seed", range(3))
def test_packing(spark, seed):
    rng = random.Random(seed)
    rows = [(i, rng.choice([rng.randrange(1, 60), rng.randrange(1, 260), rng.randrange(1, 3000)])) for i in range(3000)]
    rows += [(5000, None), (5001, 0), (5002, -3), (5003, 1000), (5004, 10_000), (5005, 1), (5006, 501), (5007, 500)]
    df = spark.createDataFrame([(k, s, "x") for k, s in rows], "doc_id bigint, n_tokens int, container string")
    out = packing.pack(df, 1000).collect()
    sizes = check_packing(rows, 1000, out)
    total = sum(max(s or 0, 0) for _, s in rows)
    assert len(sizes) * 1000 < total * 1.15
    used = packing.containers(packing.pack(df, 1000), 1000).collect()
    assert {r.container: r.used for r in used} == sizes and all(r.unused == 1000 - r.used for r in used)


def test_packing_over_windows():
    rng = np.random.default_rng(1)
    packer = packing.Packer(100)
    sizes = rng.integers(0, 101, 5000)
    box = np.concatenate([packer.pack(part) for part in np.array_split(sizes, 37)])
    assert ((box < 0) == (sizes == 0)).all()
    assert np.bincount(box[box >= 0], weights=sizes[box >= 0]).max() <= 100


def test_classes_are_filled_by_fixed_counts():
    # sizes of one class share containers by count, whatever they are
    packer = packing.Packer(100)
    for sizes, count in (([51, 99, 70], 1), ([34, 50, 40, 36], 2), ([21, 25, 22, 24], 4)):
        box = packing.Packer(100).pack(np.array(sizes))
        assert np.bincount(box).max() == count
    # the room of a large item takes what always fits: two of at most 20 in 45, not three
    assert np.bincount(packer.pack(np.array([55, 17, 18, 17]))).tolist() == [3, 1]


@pytest.mark.parametrize("workers", [1, 8, 64])
def test_waste_of_a_worker_does_not_grow(workers):
    rng = np.random.default_rng(3)
    sizes = np.minimum(rng.lognormal(5, 1.2, 20_000).astype(np.int64) + 1, 2048)
    boxes = 0
    for part in np.array_split(sizes, workers):
        packer = packing.Packer(2048)
        box = packer.pack(part)
        assert np.bincount(box, weights=part).max() <= 2048
        boxes += packer.next
    assert boxes <= sizes.sum() / 2048 * 1.005 + 2 * workers


def test_packing_of_nothing(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id string, n_tokens bigint"), 10).count() == 0
    with pytest.raises(ValueError):
        packing.pack(spark.createDataFrame([], "doc_id string, n_tokens bigint"), 0)


def test_packing_texts(spark, exact):
    rows = doc_rows()[:9]
    out = packing.pack_texts(spark.createDataFrame(rows, DOCS), 2048).collect()
    check_packing([(k, len(exact.encode_ordinary(t or ""))) for k, t, *_ in rows], 2048, out)


def chunk_texts():
    rng = random.Random(7)
    sentence = lambda: " ".join(rng.choice(["net", "route", "Größe", "via", "n_12[3]", "don't"]) for _ in range(rng.randrange(4, 20))) + rng.choice([". ", "! ", "? "])
    paragraph = lambda: "".join(sentence() for _ in range(rng.randrange(1, 9)))
    texts = [
        "\n\n".join(paragraph() for _ in range(60)), "\r\n".join(paragraph() for _ in range(60)), "".join(sentence() for _ in range(300)),
        "这是一个很长的段落。" * 600, "x" * 30_000, "'" * 5000 + "s" * 5000, " " * 9000 + "end", "\n" * 9000 + "end", "a" * 3000 + " b c. " * 900 + "é" * 9000,
        "😀" * 3000, "{'k':1}" * 2000, "short text", "", None, " ", messy(rng, 8000), messy(rng, 20_000), "12" * 9000, ("y" * 700 + "'s ") * 90,
    ]
    return [(i, t, "", "", "") for i, t in enumerate(texts)]


@pytest.mark.parametrize("limit,overlap", [(1024, 64), (100, 10), (64, 0), (16, 4)])
def test_pieces(spark, exact, limit, overlap):
    rows = chunk_texts() if limit > 64 else [r for r in chunk_texts() if r[1] is None or len(r[1]) < 9000]
    out = chunking.pieces(spark.createDataFrame(rows, DOCS), limit, overlap).collect()
    by_doc = {}
    for r in out:
        by_doc.setdefault(r.doc_id, []).append(r)
    texts = {k: t for k, t, *_ in rows}
    assert set(by_doc) == {k for k, t in texts.items() if len(exact.encode_ordinary(t or "")) > limit}
    for key, found in by_doc.items():
        text = texts[key]
        found.sort(key=lambda r: r.piece)
        assert found[0].start == 0 and found[-1].end == len(text) and found[-1].boundary == "end"
        for i, r in enumerate(found):
            assert (r.piece, r.n_pieces) == (i, len(found)) and r.text == text[r.start : r.end]
            assert r.n_tokens == len(exact.encode_ordinary(r.text)) <= limit, (key, i)
            if i:
                last = found[i - 1]
                assert last.start < r.start <= last.end < r.end
                shared = len(exact.encode_ordinary(text[r.start : last.end]))
                assert overlap <= shared <= 2 * overlap + 4, (key, i, shared)
            if r.boundary == "paragraph":
                assert re.search(r"\n\s*\n\s*$", r.text)
            if r.boundary == "line":
                assert re.search(r"\n\s*$", r.text)
    kinds = {r.boundary for r in by_doc[0]} if limit == 1024 else {"paragraph", "end"}
    assert kinds == {"paragraph", "end"}


def test_long_texts_are_encoded_in_parts(spark, exact, monkeypatch):
    from netloom.llm import bpe

    texts = [t for _, t, *_ in chunk_texts() if t] + ["ab c  d e\tf don't 12 x" * 300, " " * 500 + "a b" * 400]
    for most in (64, 1000):
        monkeypatch.setattr(bpe, "BLOCK_BYTES", 100)
        for t in texts:
            parts = list(bpe.parts_of(t.encode(), most))
            assert b"".join(parts).decode() == t
            assert [i for x in parts for i in exact.encode_ordinary(x.decode())] == exact.encode_ordinary(t)


def test_slices_of_long_texts(encoder, exact):
    from netloom.llm import bpe

    texts = pa.array(["a b", None, "net one two " * 400, "", "x y " * 200, "z"])
    got = []
    for lo, hi, offsets, tokens in bpe.encoded_slices(encoder, texts, 500):
        ids = tokens()
        got += [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])]
        assert len(offsets) == hi - lo + 1
    assert got == [exact.encode_ordinary(t.as_py() or "") for t in texts]


def test_edits_move_only_neighbouring_pieces(spark):
    text = chunk_texts()[2][1]
    other = text[:3000] + "An inserted sentence. " + text[3000:]
    df = spark.createDataFrame([(1, text, "", "", ""), (2, other, "", "", "")], DOCS)
    out = chunking.pieces(df, 128, 8).collect()
    one, two = ({r.text for r in out if r.doc_id == k} for k in (1, 2))
    assert len(one - two) <= 4 and len(one) > 15


def test_pieces_do_not_depend_on_the_batch(encoder):
    texts = [t for _, t, *_ in chunk_texts() if t]
    together = encoder.encode_slice(pa.array(texts))
    places = chunking.Places(together)
    for i, t in enumerate(texts):
        if together.counts()[i] > 200:
            alone = chunking.Places(encoder.encode_slice(pa.array([t])))
            shift = together.text_bytes[i]
            assert [(a - shift, b - shift, n, k) for a, b, n, k in chunking.cut(places, i, 200, 16)] == chunking.cut(alone, 0, 200, 16)


def test_whole_texts_and_nothing(spark):
    out = chunking.pieces(spark.createDataFrame(doc_rows(), DOCS), 1024, 64, whole=True).collect()
    assert {r.doc_id for r in out} == {None, 2, 3, 4, 5, 6, 7, 8}
    assert sum(r.doc_id == 3 for r in out) == 2
    assert chunking.pieces(spark.createDataFrame([], DOCS), 1024, 64).count() == 0
    with pytest.raises(ValueError):
        chunking.pieces(spark.createDataFrame([], DOCS), 100, 50)
