"""Encoders against their libraries; files, packing and decoding by round trips."""

import hashlib
import json
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from millrace.llm import byte_bpe, packing, token_files, tokens
from tests.llm.test_text_operators import key

MULTI, BYTES, WORDS = P.path("byte_bpe_multi_50k.tiktoken"), P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json")
REFERENCE = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=tokens.read_ranks(MULTI), special_tokens={})


def library(path, plain=False):
    t = Tokenizer.from_file(path)
    if plain:
        t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


LITERALS = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>"]


@pytest.mark.parametrize(("path", "kind", "plain", "want"), [(MULTI, "byte", False, REFERENCE.encode_ordinary), (BYTES, "byte", False, library(BYTES)), (BYTES, "byte", True, library(BYTES, True)), (WORDS, "word", False, library(WORDS)), (WORDS, "word", True, library(WORDS, True))])
def test_encoders_equal_their_libraries(path, kind, plain, want, corpus):
    enc = tokens.Encoder(path, kind, plain)
    pieces = st.lists(st.sampled_from([*"aab  \n\t 12'st.,!é中😀 \x85\x1c​́<|endoftext|>\x00RÉßΣ", *LITERALS, *LITERALS]), max_size=40).map("".join)

    @settings(max_examples=200, deadline=None)
    @given(st.lists(pieces, max_size=5))
    def equal(texts):
        ids, at = enc.encode(pa.array(texts, pa.string()))
        assert [ids[at[i] : at[i + 1]].tolist() for i in range(len(texts))] == [list(want(t)) for t in texts]

    equal()
    texts = [t or "" for _, t, *_ in corpus] + [f"end{a}{x}{b}next {x}{x} {x}" for x in LITERALS for a in ("", " ", "  ", "\n ") for b in ("", " ", "  ", " \n")]
    ids, at = enc.encode(pa.array(texts))
    assert [ids[at[i] : at[i + 1]].tolist() for i in range(len(texts))] == [list(want(t)) for t in texts]


def test_a_full_cache_forgets(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_CHUNKS", 5)
    enc, want = tokens.Encoder(BYTES, "byte"), library(BYTES)
    for k in range(30):
        text = f"the the word{k} again word{k % 3}"
        assert enc.encode(pa.array([text]))[0].tolist() == want(text)


def test_round_trip(docs, corpus, clashing, nothing):
    want = key((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t, *_ in corpus for ids in [REFERENCE.encode_ordinary(t or "")])
    for d in (docs, clashing):
        assert key(map(tuple, byte_bpe.round_trip(d, MULTI).collect())) == want
    assert byte_bpe.round_trip(nothing, MULTI).count() == 0


def test_offsets_and_split_characters(spark):
    text = "héllo 😀中 wörld"
    rows = spark.createDataFrame([(1, text), (2, None)], "doc_id int, text string")
    coded = byte_bpe.encode(rows, MULTI, offsets=True)
    r = coded.where("doc_id = 1").first()
    data = [REFERENCE.decode_single_token_bytes(i) for i in r.ids]
    at = 0
    for piece, a, z in zip(data, r.starts, r.ends, strict=True):
        lo, hi = at, at + len(piece)
        at = hi
        edges = np.cumsum([0] + [len(c.encode()) for c in text])
        assert a == int(np.searchsorted(edges, lo, "right")) - 1 and z == int(np.searchsorted(edges, hi, "left"))
    assert {x.doc_id: bytes(x.data).decode() for x in byte_bpe.decode(coded, MULTI).collect()} == {1: text, 2: ""}


def test_token_files(docs, corpus, clashing, nothing, tmp_path, spark):
    want = library(BYTES)
    for k, d in enumerate((docs, clashing)):
        out = f"file://{tmp_path}/{k}"
        token_files.write(d, out, BYTES, end_id=2)
        rows = sorted(token_files.read(spark, out, ids=True).collect(), key=lambda r: r.start)
        assert [r.doc_id for r in rows] == sorted((i for i, *_ in corpus), key=lambda i: (i is not None, i))
        assert [r.start for r in rows] == [0, *np.cumsum([r.n_tokens for r in rows])[:-1].tolist()]
        assert key((r.doc_id, r.ids) for r in rows) == key((i, [*want(t or ""), 2]) for i, t, *_ in corpus)
        assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in rows)
        manifest = json.loads((tmp_path / str(k) / "manifest.json").read_text())
        assert sum(p["docs"] for p in manifest["parts"]) == len(corpus)
        flat = np.concatenate([np.fromfile(tmp_path / str(k) / f"{p['name']}.bin", "<u2") for p in manifest["parts"]])
        assert len(flat) == sum(r.n_tokens for r in rows) and flat[0] == rows[0].ids[0]
        assert not list((tmp_path / str(k)).glob("*.local"))
    token_files.write(nothing, f"file://{tmp_path}/none", BYTES, end_id=2)
    assert token_files.read(spark, f"file://{tmp_path}/none").count() == 0


def test_numbers_of_a_store_that_cannot_be_mapped(tmp_path, monkeypatch):
    from pyarrow import fs

    np.arange(1000, dtype="<u2").tofile(tmp_path / "x.bin")
    (tmp_path / "none.bin").write_bytes(b"")
    mapped = token_files._Numbers(f"file://{tmp_path}/x.bin", "<u2")
    monkeypatch.setattr(token_files, "_store", lambda uri: (fs.SubTreeFileSystem("/", fs.LocalFileSystem()), uri.removeprefix("file://")))
    ranged = token_files._Numbers(f"file://{tmp_path}/x.bin", "<u2")
    assert mapped.file is None and ranged.file is not None and len(mapped) == len(ranged) == 1000
    for first, end in ((0, 0), (0, 7), (990, 1000), (0, 1000)):
        assert mapped.range(first, end).tolist() == ranged.range(first, end).tolist() == list(range(first, end))
    assert len(token_files._Numbers(f"file://{tmp_path}/none.bin", "<u8")) == 0


def test_packing(docs, corpus, clashing, nothing):
    want = library(WORDS)
    for d in (docs, clashing):
        rows = packing.pack(d, WORDS, capacity=64, ids=True).collect()
        pieces = key((i, k, 64 * k, ids[64 * k : 64 * k + 64]) for i, t, *_ in corpus for ids in [[*want(t or ""), 0]] for k in range(-(-len(ids) // 64)))
        assert key((r.doc_id, r.piece, r.start, r.ids) for r in rows) == pieces
        assert all(r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in rows)
        held = {}
        for r in rows:
            held.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for x in held.values():
            ends = 0
            for at, n in sorted(x):
                assert at == ends
                ends += n
            assert ends <= 64
        assert 9 * (len(held) - 1) <= 11 * -(-sum(r.length for r in rows) // 64)  # the guarantee of best fit by decreasing length
    assert packing.pack(nothing, WORDS).count() == 0


def optimum(items, capacity):
    """The fewest bins, by search."""
    items = sorted(items, reverse=True)
    best = [len(items)]

    def go(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(items):
            best[0] = len(rooms)
            return
        for r in sorted(set(rooms)):
            if r >= items[i]:
                left = list(rooms)
                left.remove(r)
                go(i + 1, [*left, r - items[i]])
        go(i + 1, [*rooms, capacity - items[i]])

    go(0, [])
    return best[0]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=9))
def test_dominance_loses_no_optimum(items):
    count = [0] * 21
    for x in items:
        count[x] += 1
    fixed = packing.reduce_by_dominance(count, 20)
    rest = [x for x in range(21) for _ in range(count[x])]
    assert sorted([x for m, n in fixed for x, k in m for _ in range(k * n)] + rest) == sorted(items)
    assert all(sum(x * k for x, k in m) <= 20 for m, _ in fixed)
    assert sum(n for _, n in fixed) + optimum(rest, 20) == optimum(items, 20)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(1, 400), max_size=30))
def test_plan_is_whole(histogram):
    plan = packing.plan_of(histogram, 50)
    got = {}
    for lengths, n in plan:
        assert sum(x * k for x, k in lengths) <= 50
        for x, k in lengths:
            got[x] = got.get(x, 0) + k * n
    assert got == histogram
