"""Decontamination, tokenizer alignment and snapshot difference against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import public_tokenizers as P
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from millrace.llm import decontamination, snapshot_difference, tokenizer_alignment, tokens
from tests.llm.test_text_operators import key

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# decontamination
def plain_words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))


def contamination(docs, items, window=10):
    """Every window of every item at every place of every document."""
    grams = {}
    for name, text in items:
        w = plain_words(text)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            grams.setdefault(tuple(w[i : i + n]), set()).add(name)
    out = []
    for row in docs:
        w = plain_words(row[1])
        hit, names = set(), set()
        for n in {len(g) for g in grams}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in grams:
                    hit |= set(range(i, i + n))
                    names |= grams[tuple(w[i : i + n])] - {None}
        out.append((row[0], len(w), sorted(hit), sorted(map(str, names))))
    return out


@pytest.fixture(scope="module")
def items(corpus, spark):
    r = random.Random(3)
    words = [(t or "").split() for _, t, *_ in corpus]
    rows = [(i, " ".join(w[k : k + r.choice([3, 9, 10, 11, 30])])) for i, w in enumerate(words[:40]) if i % 3 == 0 and w for k in [r.randrange(max(1, len(w) - 30))]]
    rows += [(100, "one"), (101, "TWO-words"), (102, None), (103, ""), (104, "?! --"), (105, " ".join(words[47])), (105, " ".join(words[2][5:20])), (None, " ".join(words[1][3:20])), (7, "same " * 12), (107, "Same, same; " * 4)]
    rows += [(200 + i, f"{' '.join(words[3][10:22])} unseen{i} tail") for i in range(3)] + rows[:2]
    return rows


def marked(df):
    return [(r.doc_id, r.n_words, [i for s in r.spans for i in range(s["first"], s["end"])], r["items"]) for r in df.collect()]


def test_decontamination(docs, corpus, items, nothing, spark, monkeypatch):
    bench = spark.createDataFrame(items, "item_id bigint, text string").repartition(3)
    want = contamination(corpus, items)
    assert sum(bool(w[2]) for w in want) > 15
    got = decontamination.mark(docs.select("doc_id", "text"), bench)
    assert key(marked(got)) == key(want)
    for r in got.collect():  # spans are merged and in order
        assert all(a["end"] < b["first"] for a, b in zip(r.spans, r.spans[1:], strict=False))
    monkeypatch.setattr(decontamination, "BLOCK_WORDS", 60)  # many blocks, one after the other
    monkeypatch.setattr(decontamination, "PIECE_WORDS", 25)
    assert key(marked(decontamination.mark(docs.select("doc_id", "text"), bench))) == key(want)
    monkeypatch.undo()
    assert decontamination.mark(nothing, bench).count() == 0
    empty = decontamination.mark(docs, bench.limit(0))
    assert key(marked(empty)) == key((i, n, [], []) for i, n, *_ in want)


def test_windows_of_one_hash_are_told_apart(docs, corpus, items, spark, monkeypatch):
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    index = decontamination.Index(*(pa.array(c, pa.string()) for c in (["1", "2", "2"], ["a b c", "b c d", "c d"])), 3)
    monkeypatch.setattr(decontamination.Index, "_hashes", staticmethod(lambda codes, length: (codes % 2).astype("uint64")))
    clash = decontamination.Index(*(pa.array(c, pa.string()) for c in (["1", "2", "2"], ["a b c", "b c d", "c d"])), 3)
    text = pa.array(["x a b c d y", "c d", "b c x"])
    assert decontamination._mark(clash, text)[1:] == ([[{"first": 1, "end": 5}], [{"first": 0, "end": 2}], []], [["1", "2"], ["2"], []])
    monkeypatch.undo()
    assert decontamination._mark(index, text)[1:] == ([[{"first": 1, "end": 5}], [{"first": 0, "end": 2}], []], [["1", "2"], ["2"], []])
    assert bench.count() == len(items)


def test_decontaminated_documents(clashing, docs, corpus, items, spark):
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    want = {(i, t): h for (i, t, *_), (_, _, h, _) in zip(corpus, contamination(corpus, items), strict=True)}
    for d in (docs, clashing):
        kept = decontamination.clean_documents(d, bench)
        assert kept.columns == d.columns
        assert key((r.doc_id, r.text) for r in kept.collect()) == key((i, t) for i, t, *_ in corpus if not want[i, t])
    cut = decontamination.clean_spans(clashing, bench)
    assert cut.columns == clashing.columns

    def without(text, hit):
        spots, hit = [m.span() for m in re.finditer("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))], set(hit)
        out = list(text) if text else text
        for i in sorted(hit, reverse=True):
            out[spots[i][0] : spots[i + 1][0] if i + 1 in hit else spots[i][1]] = []
        return "".join(out) if text else text

    assert key((r.doc_id, r.text, r.n_chars) for r in cut.collect()) == key((i, t2, len(t2) if t2 is not None else None) for i, t, *_ in corpus for t2 in [without(t, want[i, t])])


# tokenizer alignment
def tools():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def pieces(text, a, b):
    """(id, first byte, end byte) of each token of both, or nothing."""
    back = {c: i for i, c in enumerate(tokens.byte_characters())}
    if not text:
        return [], []
    out = []
    for named in ([(i, bytes(back[c] for c in a.id_to_token(i))) for i in a.encode(f" {text}", add_special_tokens=False).ids], [(i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()) for i in b.encode(text) for p in [b.id_to_piece(i)]]):
        if b"".join(x for _, x in named) != f" {text}".encode():
            return [], []
        at, rows = 0, []
        for i, x in named:
            rows.append((i, at, at + len(x)))
            at += len(x)
        out.append(rows)
    return out


def alignment(texts):
    a, b = tools()
    found = [pieces(t, a, b) for t in texts]
    links = [[(x[0], y[0]) for x in p for y in q if x[1] < y[2] and y[1] < x[2]] for p, q in found]
    count = Counter(x for own in links for x in own)
    best = {}
    for (_, y), n in count.items():
        best[y] = max(best.get(y, 0), n)
    out = []
    for (p, q), own in zip(found, links, strict=True):
        cuts = sorted({x[2] for x in p} & {y[2] for y in q})
        groups = [([x[0] for x in p if lo < x[2] <= hi], [y[0] for y in q if lo < y[2] <= hi]) for lo, hi in zip([0, *cuts], cuts, strict=False)]
        text = ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
        out.append((len(p), len(q), len(groups), len(own), sum(count[x] == best[x[1]] for x in own), sum(count[x] for x in own), hashlib.sha256(text.encode()).hexdigest() if p else ""))
    return out


ODD = ["x<|endoftext|> y", "a▁b", "  lead", "trail   ", "\x00", "é́ 中文 😀😀", "<0x41> <s> <unk>", "a\r\n\tb  c   d", "naïve ﬁ ①", "　wide", "don't we'll 12345 67"]


def test_piece_encoder_equals_its_library():
    enc, (_, model) = tokens.PieceEncoder(B), tools()
    assert enc.cuts

    @settings(max_examples=200, deadline=None)
    @given(st.lists(st.lists(st.sampled_from([*"aab  \n\t 12'.é中😀\x85<>|\x00ßﬁ", "the", "ing", "  ", "<s>", " a"]), max_size=30).map("".join), max_size=5))
    def equal(texts):
        ids, at = enc.encode(pa.array(texts, pa.string()))
        assert [ids[at[i] : at[i + 1]].tolist() for i in range(len(texts))] == model.encode(texts)

    equal()
    enc.cuts = False  # whole texts as chunks: a vocabulary whose pieces span words
    equal()


def test_alignment(spark, corpus, monkeypatch):
    rows = [(i, t) for i, t, *_ in corpus if len(t or "") < 3000] + [(1000 + i, t) for i, t in enumerate(ODD)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    want = key((i, *x) for (i, _), x in zip(rows, alignment([t for _, t in rows]), strict=True))
    assert any(x[1] == 0 for x in want) and any(x[2] != x[1] and x[3] < x[1] for x in want)
    assert key(map(tuple, tokenizer_alignment.scores(docs, A, B).collect())) == want
    for name, value in (("SLICE", 700), ("TOKENS", 37), ("LINKS", 50), ("PAIRS", 90)):  # small slices, many rounds
        monkeypatch.setattr(tokenizer_alignment, name, value)
    assert key(map(tuple, tokenizer_alignment.scores(docs, A, B).collect())) == want
    named = docs.select("*", *[F.lit("x").alias(c) for c in ("n_a", "codes", "times", "n_best", "code", "best")])
    assert key(map(tuple, tokenizer_alignment.scores(named, A, B).collect())) == want


def test_alignment_of_nothing_and_of_very_long_texts(nothing, spark):
    assert tokenizer_alignment.scores(nothing, A, B).count() == 0
    assert tokenizer_alignment.align(nothing, A, B).count() == 0
    none = spark.createDataFrame([(1, None), (None, "")], "doc_id int, text string")
    assert key(map(tuple, tokenizer_alignment.scores(none, A, B).collect())) == key([(1, 0, 0, 0, 0, 0, 0, ""), (None, 0, 0, 0, 0, 0, 0, "")])
    text = "long winded prose, 123 times over. " * 90_000
    r = tokenizer_alignment.scores(spark.createDataFrame([(1, text), (2, text)], "doc_id int, text string"), A, B).collect()
    assert r[0][1:] == r[1][1:] and r[0].n_best >= r[0].n_links - 1 and r[0].n_links >= max(r[0].n_a, r[0].n_b)


def test_alignment_groups(spark):
    texts = ["the tokenizers' differences", None, *ODD]
    a, b = tools()
    rows = {r.doc_id: r for r in tokenizer_alignment.align(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), A, B).collect()}
    for i, t in enumerate(texts):
        p, q = pieces(t, a, b)
        assert (rows[i].a_ids, rows[i].b_ids) == ([x[0] for x in p], [y[0] for y in q])
        cuts = sorted({x[2] for x in p} & {y[2] for y in q})
        assert rows[i].a_cuts == [sum(x[2] <= c for x in p) for c in cuts] and rows[i].b_cuts == [sum(y[2] <= c for y in q) for c in cuts]


# snapshot difference
def restated(old, new, n_content, names):
    """old, new: lists of (key, *values) with keys that occur once a side."""
    order = lambda k: (k is not None, k)
    was, now, out = {r[0]: r for r in old}, {r[0]: r for r in new}, []
    diff = lambda a, b: [n for n, x, y in zip(names, a[1:], b[1:], strict=True) if x != y]
    for k in was.keys() & now.keys():
        d = diff(was[k], now[k])
        out.append((k, k, "update" if d else "same", d, now[k][1:]))
    lone, fresh = {}, {}
    for k in was.keys() - now.keys():
        lone.setdefault(was[k][1 : 1 + n_content], []).append(was[k])
    for k in now.keys() - was.keys():
        fresh.setdefault(now[k][1 : 1 + n_content], []).append(now[k])
    for c in lone.keys() | fresh.keys():
        a = sorted(lone.get(c, []), key=lambda r: order(r[0]))
        b = sorted(fresh.get(c, []), key=lambda r: order(r[0]), reverse=True)
        n = min(len(a), len(b))
        out += [(y[0], x[0], "rekey", diff(x, y), y[1:]) for x, y in zip(a[:n], b[:n], strict=True)]
        out += [(x[0], x[0], "delete", [], None) for x in a[n:]] + [(y[0], None, "insert", [], y[1:]) for y in b[n:]]
    return out


FIELDS = "doc_id bigint, text string, lang string, source string"
NAMES = ["text", "lang", "source"]


def found(df):
    return key((r.key, r.old_key, r.op, r.changed, None if r.row is None else tuple(r.row)) for r in df.collect())


@pytest.mark.parametrize("hashed", [F.xxhash64, lambda c: F.xxhash64(c) % 2])
def test_difference(spark, hashed):
    r = random.Random(5)
    pick = lambda xs: r.choice(xs)
    side = lambda lo, hi: [(k, pick(["a", "a", "b", "c", "", None]), pick(["en", None]), pick(["s", "t", None])) for k in [None, *range(lo, hi)] if r.random() < 0.8]
    old, new = side(-20, 60), side(30, 120)
    frames = [spark.createDataFrame(x, FIELDS).repartition(3).withColumn("key", F.lit("x")).withColumn("later", F.lit(1)) for x in (old, new)]
    got = snapshot_difference.difference(*frames, "doc_id", NAMES, NAMES[:2], hashed)
    assert {x[2] for x in found(got)} == {"same", "update", "rekey", "insert", "delete"}
    assert found(got) == key(restated(old, new, 2, NAMES))
    swapped = snapshot_difference.difference(frames[1], frames[0], "doc_id", NAMES, ["source"], hashed)
    assert found(swapped) == key((k, o, p, d, v) for k, o, p, d, v in [(k, o, p, [n for n in NAMES if n in d], None if v is None else (v[1], v[2], v[0])) for k, o, p, d, v in restated([(k, s, t, g) for k, t, g, s in new], [(k, s, t, g) for k, t, g, s in old], 1, ["source", "text", "lang"])])


def test_one_hot_content(spark):
    """A group of copies over many partitions: ranks add up across tasks."""
    old = [(i, "hot", "en", str(i)) for i in range(0, 900)] + [(i, f"t{i}", "en", "s") for i in range(5000, 5100)]
    new = [(-i, "hot", "en", str(i)) for i in range(1, 700)] + [(i, f"t{i}", "en", "s") for i in range(5050, 5150)]
    frames = [spark.createDataFrame(x, FIELDS).repartition(6) for x in (old, new)]
    assert found(snapshot_difference.difference(*frames, "doc_id", NAMES, NAMES[:2])) == key(restated(old, new, 2, NAMES))


def test_empty_snapshots_and_keys_of_text(spark):
    rows = [("k1", "a", "en", None), ("k2", "a", "en", None), (None, None, None, None)]
    some, none = spark.createDataFrame(rows, FIELDS.replace("bigint", "string")), spark.createDataFrame([], FIELDS.replace("bigint", "string"))
    go = lambda a, b: found(snapshot_difference.difference(a, b, "doc_id", NAMES, NAMES[:2]))
    assert go(none, none) == []
    assert go(some, none) == key(restated(rows, [], 2, NAMES)) and go(none, some) == key(restated([], rows, 2, NAMES))
    assert [x[2] for x in go(some, some)] == ["same"] * 3
    with pytest.raises(TypeError):
        snapshot_difference.difference(some.select(F.lit(1.0).alias("doc_id"), *NAMES), none, "doc_id", NAMES, ["text"])


def test_repeated_keys_pair_one_by_one(spark):
    old = [(1, "a", "en", "s")] * 3 + [(1, "b", "en", "s"), (2, "c", "en", "s"), (None, "n", "en", "s"), (None, "n", "en", "s")]
    new = [(1, "a", "en", "s")] * 2 + [(2, "c", "en", "s"), (2, "c", "en", "s"), (None, "n", "en", "s"), (9, "a", "en", "t")]
    got = found(snapshot_difference.difference(*(spark.createDataFrame(x, FIELDS).repartition(3) for x in (old, new)), "doc_id", NAMES, NAMES[:2]))
    count = Counter(x[2] for x in got)
    # key 1: four against two; key 2: one against two; null keys: two against one; an `a` of key 1 is left for key 9
    assert count["same"] + count["update"] == 2 + 1 + 1 and (count["rekey"], count["delete"], count["insert"]) == (1, 2, 1)
    assert [x for x in got if x[2] == "rekey"] == [(9, 1, "rekey", ["source"], ("a", "en", "t"))]
    assert Counter(x[4] for x in got if x[4]) == Counter(r[1:] for r in new)


def test_later_snapshot_of_documents(spark, docs, corpus):
    rows = [(i, t, g, s) for i, t, g, s, _ in corpus]

    def later(i, t, g, s):
        k = zlib.crc32(str(i).encode()) % 25 if i is not None else 99
        moved = None if i is None else -1 - i
        return {0: [], 1: [(i, f"{t or ''}+", g, s)], 2: [(i, t, s, g)], 3: [(moved, t, g, s)], 4: [(moved, t, g, None)], 5: [(i, t, g, s), (moved, t, g, s)]}.get(k, [(i, t, g, s)])

    wide = docs.unionByName(spark.createDataFrame([(i, None if i % 5 else f"t{i}", "en", "s", 1) for i in range(2000, 2100)], docs.schema))
    rows += [(i, None if i % 5 else f"t{i}", "en", "s") for i in range(2000, 2100)]
    assert key(map(tuple, snapshot_difference.later_snapshot(wide).collect())) == key(x for r in rows for x in later(*r))
