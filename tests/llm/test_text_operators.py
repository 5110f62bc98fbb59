"""Brute-force versions of the operators on documents."""

import hashlib
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from millrace.llm import jaccard, substring_dedup, suffix_array
from tests.llm.conftest import SCHEMA

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def covered(corpus, window):
    seen, every = Counter(), []
    for i, t, *_ in corpus:
        w = WORD.findall(t or "")
        every.append((i, w))
        seen.update(tuple(w[k : k + window]) for k in range(len(w) - window + 1))
    out = []
    for i, w in every:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k : k + window])] > 1:
                gone[k : k + window] = [True] * window
        out.append((i, w, gone))
    return out


def key(rows):
    return sorted(rows, key=str)


def test_substring_dedup(docs, corpus, clashing):
    want = [(i, len(w), sum(g), hashlib.sha256(" ".join(x for x, y in zip(w, g, strict=True) if not y).encode()).hexdigest()) for i, w, g in covered(corpus, 35)]
    assert key(map(tuple, substring_dedup.digest(docs).collect())) == key(want)
    assert key(map(tuple, substring_dedup.digest(clashing).collect())) == key(want)


def test_common_anchors_come_last(docs, corpus, spark, monkeypatch):
    """Results don't depend on which anchors count as common, nor on how many buckets there are."""
    import random

    from millrace.llm import repeats

    r = random.Random(8)
    say = lambda n: " ".join(f"v{r.randint(0, 10**6)}" for _ in range(n))
    passage = say(80)
    hot = corpus + [(1000 + i, f"{say(r.randint(0, 40))} {passage} {say(r.randint(0, 40))}", "en", "s", 0) for i in range(60)]
    df = spark.createDataFrame(hot, SCHEMA).repartition(4)
    for name, value in (("HOT_PIECES", 3), ("SEEN_OFTEN", 1), ("BUCKET_WORDS", 500)):
        monkeypatch.setattr(repeats, name, value)
    want = [(i, len(w), sum(g)) for i, w, g in covered(hot, 35)]
    assert key((x.doc_id, x.n_words, x.n_removed) for x in substring_dedup.digest(df).collect()) == key(want)
    gone = {(i, k) for i, _, g in covered(hot, 50) for k, x in enumerate(g) if x}
    assert {(x.doc_id, k) for x in suffix_array.repeated_passages(df).collect() for k in range(x.first, x.end)} == gone


def test_common_passages_are_dealt_out():
    """Windows at the edge of a common passage get minimisers outside it."""
    import numpy as np

    from millrace.llm import repeats

    anchors = np.arange(1, 101, dtype=np.uint64) << np.uint64(40)
    start, _ = repeats.windows(np.array([0, 100]), 35)
    common = np.sort(anchors[20:60])
    place = repeats.minimisers(anchors, start, 35, common)
    plain = repeats.minimisers(anchors, start, 35)
    inside = (start >= 20) & (start + 35 - repeats.ANCHOR < 60)
    assert ((place >= 20) & (place < 60)).tolist() == inside.tolist() and (plain == start).all()


def test_removed_text_keeps_columns(clashing, corpus):
    out = substring_dedup.remove(clashing)
    assert out.columns == clashing.columns
    got = key((r.doc_id, WORD.findall(r.text or "")) for r in out.collect())
    assert got == key((i, [x for x, y in zip(w, g, strict=True) if not y]) for i, w, g in covered(corpus, 35))


def test_colliding_hashes_are_compared(monkeypatch, docs, corpus, spark):
    """With a hash that tells nothing apart, word-by-word comparison still gives the right windows."""
    import numpy as np
    import pyarrow as pa

    table = pa.table({"id": [1, 2], "text_key": [0, 0], "first": [0, 0], "anchor": pa.array([0, 0], pa.int32()), "n": pa.array([4, 4], pa.int32()), "words": [b"a b c d", b"x b c d"]})
    monkeypatch.setattr(substring_dedup, "window_hashes", lambda h, n: np.zeros(len(h), np.uint64))
    assert substring_dedup.count_windows(table, 3).to_pylist() == [{"id": 1, "text_key": 0, "first": 1, "end": 4}, {"id": 2, "text_key": 0, "first": 1, "end": 4}]


def test_repeated_passages(docs, corpus, clashing):
    want = []
    for i, _, gone in covered(corpus, 50):
        at = 0
        while at < len(gone):
            end = at
            while end < len(gone) and gone[end]:
                end += 1
            if end > at:
                want.append((i, at, end, end - at))
            at = max(end, at + 1)
    got = suffix_array.repeated_passages(docs)
    # rows that are the same in id and text share their spans
    assert set(map(tuple, got.collect())) == set(want)
    assert set(map(tuple, suffix_array.repeated_passages(clashing).collect())) == set(want)


def shingles(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def groups(corpus):
    sets = [shingles(r[1]) for r in corpus]
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            c = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * c >= 80 * (len(sets[a]) + len(sets[b]) - c):
                parent[root(a)] = root(b)
    ids = defaultdict(list)
    for k in range(len(sets)):
        if corpus[k][0] is not None:
            ids[root(k)].append(corpus[k][0])
    return sets, root, ids


def test_jaccard_join(docs, corpus, clashing):
    sets, root, ids = groups(corpus)
    want = key((r[0], len(s), min(ids[root(k)], default=None) if s else r[0]) for k, (r, s) in enumerate(zip(corpus, sets, strict=True)))
    for d in (docs, clashing):
        assert key((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join(d).collect()) == want


def test_names_are_short_where_that_is_enough(docs, corpus, monkeypatch):
    """Half of each name travels; where halves meet (here first bytes do), all of it, with the same groups."""
    sets, root, ids = groups(corpus)
    want = key((r[0], min(ids[root(k)], default=None) if s else r[0]) for k, (r, s) in enumerate(zip(corpus, sets, strict=True)))
    for short, wide, pairs in ((8, 8, 3), (1, 16, 1)):  # pairs in several batches, and more than are broadcast
        monkeypatch.setattr(jaccard, "SHORT", short)
        monkeypatch.setattr(jaccard, "PAIRS", pairs)
        rows = jaccard.join(docs).collect()
        assert key((r.doc_id, r.component_id) for r in rows) == want
        assert {len(x) for r in rows for x in (r.node, r.component) if x is not None} == {wide}


def test_representatives(docs, corpus, clashing):
    sets, root, _ = groups(corpus)
    kept = jaccard.representatives(clashing)
    assert kept.columns == clashing.columns
    rows = kept.collect()
    assert sum(not shingles(r.text) for r in rows) == sum(not s for s in sets)
    of = {s: root(k) for k, s in enumerate(sets) if s}
    assert Counter(of[shingles(r.text)] for r in rows if shingles(r.text)) == Counter({root(k): 1 for k, s in enumerate(sets) if s})


def test_a_hot_passage_and_a_hot_group(spark, monkeypatch):
    """Many unrelated documents share a passage; many near copies share a template."""
    import random

    r = random.Random(3)
    say = lambda n: [f"w{r.randint(0, 10**6)}" for _ in range(n)]
    passage, template = say(60), say(150)
    rows = [(i, " ".join(say(60) + passage + say(60))) for i in range(150)]
    for i in range(150, 300):
        w = list(template)
        for k in r.sample(range(150), r.randint(0, 3)):
            w[k] = say(1)[0]
        rows.append((i, " ".join(w)))
    _, root, ids = groups([(*x,) for x in rows])
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    for dealt in (False, True):
        if dealt:  # long lists go over several buckets and are compared in tiles
            for name, value in (("SPLIT", 12), ("TILE", 8), ("FOLLOWERS", 3)):
                monkeypatch.setattr(jaccard, name, value)
        got = {x.doc_id: x.component_id for x in jaccard.join(df).collect()}
        assert got == {i: min(ids[root(i)]) for i, _ in rows}


def test_tiles_find_what_buckets_find(spark):
    """A dealt list's tiles give the same pairs and counts as one bucket."""
    import random

    r = random.Random(9)
    rows = [(1, t, r.randbytes(16), n := r.randint(50, 60), r.randint(0, n // 4), r.randint(1, 3), bytes([r.choice((1, 1, 1, 2, 3, k))] * 16)) for t in range(4) for k in range(40)]
    names = "bucket int, token bigint, node binary, n int, pos int, ask int, component binary"
    df = spark.createDataFrame(rows, names)
    whole = df.groupBy("bucket").applyInArrow(jaccard._across(80), jaccard._FOUND_DDL)
    try:
        jaccard.TILE, old = 7, jaccard.TILE
        tiled = jaccard._tiles(df, 80).groupBy("a", "b").agg(F.sum("n").alias("n"), F.min("need").alias("need"))
        want = whole.groupBy("a", "b").agg(F.sum("n").alias("n"), F.min("need").alias("need"))
        got = sorted(tuple(map(str, x)) for x in tiled.collect())
    finally:
        jaccard.TILE = old
    assert got and got == sorted(tuple(map(str, x)) for x in want.collect())


def test_a_chain_of_near_copies(spark):
    """Each document is similar to its neighbours alone, so the links make one long path."""
    words = [f"w{i * 7919 % 100_003}" for i in range(700)]
    rows = [(i, " ".join(words[10 * i : 10 * i + 100])) for i in range(60)]
    _, root, ids = groups(rows)
    assert len(set(map(root, range(60)))) == 1
    got = jaccard.join(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)).collect()
    assert {r.component_id for r in got} == {0}


def test_shingles_of_equal_low_bits_both_count():
    import numpy as np
    import pyarrow as pa

    def row(token, node, pos):
        cols = [np.array(token, "<u4"), np.array(node, "S16"), np.full(len(token), 9, "<i4"), np.array(pos, "<i4"), np.ones(len(token), "u1")]
        return {"bucket": 3, **{k: c.tobytes() for k, c in zip(jaccard._ENTRY, cols, strict=True)}}

    a, b = b"a" * 16, b"b" * 16
    rows = [row([5, 5, 7], [a, a, a], [0, 1, 2]), row([5, 5, 8], [b, b, b], [0, 1, 2]), row([5, 5, 7], [a, a, a], [0, 1, 2])]
    kinds = pa.schema([("bucket", pa.int32()), *[(k, pa.binary()) for k in jaccard._ENTRY]])
    token, node, _, pos, _ = jaccard._joined(jaccard._shared(pa.Table.from_pylist(rows, kinds)), jaccard._ENTRY)
    assert token.tolist() == [5] * 4 and sorted(zip(node.tolist(), pos.tolist())) == [(a, 0), (a, 1), (b, 0), (b, 1)]


def test_adaptive_prefix():
    import numpy as np

    assert jaccard.choose(np.zeros(100, np.int64), 20) == 1
    assert jaccard.choose(np.array([0] * 10 + [1000] + [0] * 20), 11) == 2


def test_empty_tables(nothing):
    for f in (substring_dedup.digest, substring_dedup.remove, suffix_array.repeated_passages, jaccard.join, jaccard.representatives):
        assert f(nothing).count() == 0


def test_only_nulls(spark):
    rows = spark.createDataFrame([(1, None, None, None, None), (2, None, None, None, None)], SCHEMA)
    assert [(r.n_words, r.n_removed) for r in substring_dedup.digest(rows).collect()] == [(0, 0)] * 2
    assert sorted((r.doc_id, r.component_id) for r in jaccard.join(rows).collect()) == [(1, 1), (2, 2)]
    assert suffix_array.repeated_passages(rows).count() == 0 and jaccard.representatives(rows).count() == 2
