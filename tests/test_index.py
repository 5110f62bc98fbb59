"""The stored lexical index and merge-on-read tables against what a scan or a dictionary gives; searches of odd vectors."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.operators import retrieval, search
from millrace.sources import postings, store
from millrace.sources.postings import Postings
from millrace.sources.store import Conflict, Table


def by_hand(docs, queries, k):
    """Every query against every document, term by term."""
    words = {i: t.lower().split() for i, t in docs.items() if t and t.split()}
    n, avg = len(words), sum(map(len, words.values())) / len(words)
    df = Counter(w for ws in words.values() for w in set(ws))
    part = lambda tf, dl: tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avg))
    out = []
    for q, text in queries.items():
        asked = Counter(text.lower().split())
        rows = []
        for i, ws in words.items():
            tf = Counter(ws)
            hits = [w for w in asked if w in tf]
            if hits:
                score = sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * part(tf[w], len(ws)) * part(asked[w], sum(asked.values())) for w in hits)
                rows.append((-round(score, 6), i))
        out += [(q, i, -s, r + 1) for r, (s, i) in enumerate(sorted(rows)[:k])]
    return out


def some_documents(seed, ids):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    return {i: " ".join(r.choices(words, [1 / (k + 1) for k in range(60)], k=r.randint(1, 40))) for i in ids} | {min(ids): "", max(ids): "only here"}


def frame(spark, docs):
    return spark.createDataFrame(list(docs.items()), "doc_id bigint, text string").repartition(3)


def found(df):
    return sorted((r.q_id, r.doc_id, round(r.score, 6), r.rk) for r in df.collect())


def close(got, want):
    assert [g[:2] + g[3:] for g in got] == [w[:2] + w[3:] for w in want]
    assert all(abs(g[2] - w[2]) <= 1.5e-6 for g, w in zip(got, want, strict=True))


def test_postings_follow_their_documents(spark, tmp_path, monkeypatch):
    docs = some_documents(1, range(200))
    queries = {1: "w1 w7 w7 w30", 2: docs[17], 3: "w59 only nowhere", 4: "", 5: "nowhere"}
    asked = spark.createDataFrame(list(queries.items()), "q_id bigint, text string")
    index = Postings(spark, f"file://{tmp_path}/p", segment=150, folders=3)  # many segments
    index.build(frame(spark, docs))
    assert index._state()[1]["parts"][0]["segments"] > postings.FIRST_LOOK
    close(found(index.search(asked, 5)), sorted(by_hand(docs, queries, 5)))
    new = some_documents(2, range(150, 260))
    index.upsert(frame(spark, new), removed=frame(spark, {i: "" for i in range(0, 40)}))
    now = {i: t for i, t in (docs | new).items() if i >= 40}
    close(found(index.search(asked, 5)), sorted(by_hand(now, queries, 5)))
    index.delete(frame(spark, {i: "" for i in range(60, 80)} | {9999: ""}))
    index.upsert(frame(spark, {41: None, 42: "w1 w1 w1", 300: "w7"}))  # a text that is lost, changed, new
    now = {i: t for i, t in (now | {41: None, 42: "w1 w1 w1", 300: "w7"}).items() if not 60 <= i < 80}
    want = sorted(by_hand(now, queries, 5))
    close(found(index.search(asked, 5)), want)
    some = frame(spark, {i: "" for i in now if i % 3 == 0})
    close(found(index.search(asked, 5, allowed=some)), sorted((q, i, s, n) for q in queries for n, (_, i, s, _) in enumerate([w for w in by_hand(now, queries, 10**6) if w[0] == q and w[1] % 3 == 0][:5], 1)))
    lengths = [len(t.split()) for t in now.values() if t and t.split()]
    assert index.statistics() == (len(lengths), sum(lengths))
    monkeypatch.setattr(search, "BATCH_BYTES", 60)  # one batch after the other
    monkeypatch.setattr(search, "HELD_SCORES", 500)
    monkeypatch.setattr(retrieval, "FEW_TERMS", 2)  # terms are joined, not pushed
    close(found(index.search(asked, 5)), want)
    close(found(retrieval.bm25(frame(spark, now), asked, 5)), want)
    monkeypatch.undo()
    index.compact()
    assert len(index._state()[1]["parts"]) == 1 and index.statistics() == (len(lengths), sum(lengths))
    close(found(index.search(asked, 5)), want)
    with pytest.raises(Conflict):
        index._next(1, index._state()[1])


def test_a_search_reads_its_terms_and_skips_segments(spark, tmp_path):
    docs = {i: f"common {'rare ' * (i == 777)}{' '.join(f'x{i}y{j}' for j in range(20))}" for i in range(1500)}
    index = Postings(spark, f"file://{tmp_path}/p", segment=300, folders=3)
    index.build(frame(spark, docs))
    asked = spark.createDataFrame([(1, "rare common")], "q_id bigint, text string")
    close(found(index.search(asked, 3)), sorted(by_hand(docs, {1: "rare common"}, 3)))
    plan = index._wanted(index._state()[1], retrieval.query_terms(asked))._jdf.queryExecution().toString()
    assert "In(term, [" in plan and "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan
    many = spark.createDataFrame([(1, "common")], "q_id bigint, text string")
    longer = {i: f"top {'top ' * 5 if i % 10 == 0 else ''}{'pad ' * (5 if i % 10 == 0 else 40)}" for i in range(400)}
    other = Postings(spark, f"file://{tmp_path}/q", segment=8, folders=3)
    other.build(frame(spark, longer))
    assert other.skipped(spark.createDataFrame([(1, "top")], "q_id bigint, text string"), 3) > 0.3
    close(found(other.search(spark.createDataFrame([(1, "top")], "q_id bigint, text string"), 3)), sorted(by_hand(longer, {1: "top"}, 3)))
    assert index.search(many, 2).count() == 2


def test_an_empty_index_and_ids_of_text(spark, tmp_path):
    none = spark.createDataFrame([], "name string, body string")
    index = Postings(spark, f"file://{tmp_path}/p", "name", "body", folders=3)
    index.build(none)
    asked = spark.createDataFrame([(1, "two words")], "q_id bigint, text string")
    assert index.search(asked, 3).count() == 0 and index.statistics() == (0, 0)
    index.upsert(spark.createDataFrame([("b", "two words"), ("a", "two words"), ("a", "two words"), (None, "words")], "name string, body string"))
    assert [(r.name, r.rk) for r in index.search(asked, 2).orderBy("rk").collect()] == [("a", 1), ("a", 2)]
    index.delete(spark.createDataFrame([("a",)], "name string"))
    assert [r.name for r in index.search(asked, 3).orderBy("rk").collect()] == ["b", None]


# searches of vectors
def test_vectors_of_other_lengths_or_with_odd_components_take_no_part(spark, monkeypatch):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0]), (2, [1.0, 0.0, 0.5]), (3, [0.6, 0.8]), (4, [None, 1.0]), (5, [nan, 1.0]), (6, [inf, 0.0]), (7, None), (8, []), (9, [1.0, 0.0]), (10, [0.0, 1.0])]
    v = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(2)
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0]), (3, [nan, 1.0]), (4, None), (5, [1.0, 0.0, 0.0, 0.0])], "q_id bigint, q array<double>")
    want = [(1, 3, 0.6, 2), (1, 9, 1.0, 1), (1, 10, 0.0, 3), (2, 1, 2.0, 1)]
    assert sorted(map(tuple, retrieval.dense(v, asked, 5).collect())) == want
    monkeypatch.setattr(search, "BATCH_BYTES", 20)
    assert sorted(map(tuple, retrieval.dense(v, asked, 5).collect())) == want
    assert sorted(map(tuple, retrieval.dense(v.withColumn("embedding", F.col("embedding").cast("array<float>")), [(1, [1.0, 0.0])], 1).collect())) == [(1, 9, 1.0, 1)]
    with pytest.raises(ValueError):
        retrieval.dense(v, [], 1)
    assert np.isfinite([r.sim for r in retrieval.dense(v, asked, 5).collect()]).all()


# tables
def rows(spark, values):
    return spark.createDataFrame(list(values.items()), "k bigint, _bucket string")


def test_a_change_writes_its_rows_alone(spark, tmp_path):
    sizes = []
    for n in (1000, 20000):
        t = Table(spark, f"file://{tmp_path}/{n}", "k", buckets=4)
        t.write(rows(spark, {i: f"v{i}" for i in range(n)}))
        before = {str(p) for p in (tmp_path / str(n)).rglob("*.parquet")}
        t.upsert(rows(spark, {i * 7: "new" for i in range(50)}))
        made = [p for p in (tmp_path / str(n)).rglob("*.parquet") if str(p) not in before]
        sizes.append(sum(p.stat().st_size for p in made))
        assert t.read().where("_bucket = 'new'").count() == 50 and t.read().count() == n
    assert sizes[1] < 1.5 * sizes[0]


def test_a_table_equals_a_dictionary(spark, tmp_path, monkeypatch):
    r, t, want = random.Random(4), Table(spark, f"file://{tmp_path}/t", "k", buckets=2), {}
    monkeypatch.setattr(store, "FOLD_ROWS", 60)
    monkeypatch.setattr(store, "BUCKET_ROWS", 50)
    seen = set()
    for turn in range(6):
        new = {r.choice([None, *range(150)]) if turn else i: f"{turn}:{i}" for i in range(40)}
        t.upsert(rows(spark, new))
        want |= new
        if turn % 3 == 2:
            t.delete(F.col("k") % 5 == turn % 5)
            want = {k: v for k, v in want.items() if k is None or k % 5 != turn % 5}
        assert {x.k: x._bucket for x in t.read().collect()} == want and t.read().count() == len(want)
        seen.add((t._state()[1]["n"], bool(t._state()[1]["changes"])))
    assert len({n for n, _ in seen}) > 1 and {c for _, c in seen} == {True, False}  # buckets were split, changes folded
    t.snapshot("s")
    t.merge(gone=t.read().select("k"))
    assert t.read().count() == 0
    t.vacuum(keep=1)
    t.restore("s")
    assert {x.k: x._bucket for x in t.read().collect()} == want
    repeated = spark.createDataFrame([(1, "a"), (1, "c"), (1, "b")], "k bigint, _bucket string")
    t.upsert(repeated, order=F.col("_bucket"))
    assert [x._bucket for x in t.read().where("k = 1").collect()] == ["c"]


def test_racing_writers(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    Table(spark, f"file://{tmp_path}/t", "k").write(rows(spark, {0: "a"}))
    base, manifest = Table(spark, f"file://{tmp_path}/t", "k")._state()

    def go(i):
        try:
            return Table(spark, f"file://{tmp_path}/t", "k")._next(base, manifest | {"writer": i})
        except Conflict:
            return None

    with ThreadPoolExecutor(8) as pool:
        assert sum(x is not None for x in pool.map(go, range(8))) == 1


def test_a_vector_index_equals_a_scan(spark, tmp_path):
    from millrace.sources.vectors import VectorIndex

    r = np.random.default_rng(3)
    middle = r.normal(size=(12, 8)) * 4
    vector = lambda i: (middle[i % 12] + r.normal(size=8) * 0.2).tolist()
    odd = [(9001, None, "a"), (9002, [1.0], "a"), (9003, [float("nan")] * 8, "a"), (9004, [], "b")]
    rows = {i: (i, vector(i), "ab"[i % 2]) for i in range(600)}
    schema = "vec_id bigint, embedding array<double>, kind string"
    put = lambda x: spark.createDataFrame(x, schema).repartition(3)
    index = VectorIndex(spark, f"file://{tmp_path}/v", columns=["kind"], folder=50)
    index.build(put([*rows.values(), *odd]))
    asked = spark.createDataFrame([(i, rows[i][1]) for i in range(0, 600, 50)] + [(7777, [1.0]), (7778, None)], "q_id bigint, q array<double>")
    got = lambda df: sorted(map(tuple, df.collect()))
    assert got(index.search(asked, 4)) == got(retrieval.dense(put(list(rows.values())), asked.where("q_id < 600"), 4))
    assert index.reads[0] < 0.6 * index.reads[1]  # clusters were ruled out
    new = {i: (i, vector(i + 1), "c") for i in range(590, 640)}
    index.upsert(put(list(new.values())))
    index.delete(put([(i, None, None) for i in range(0, 30)]))
    now = {i: x for i, x in (rows | new).items() if i >= 30}
    want = got(retrieval.dense(put(list(now.values())).where("kind <> 'a'"), asked.where("q_id < 600"), 5, exclude_self=True))
    assert got(index.search(asked, 5, F.col("kind") != "a", exclude_self=True)) == want
    index.compact()
    assert got(index.search(asked, 5, F.col("kind") != "a", exclude_self=True)) == want and index.read().count() == len(now)
    empty = VectorIndex(spark, f"file://{tmp_path}/e", columns=["kind"])
    empty.build(put([]).limit(0))
    assert empty.search(asked, 3).count() == 0


def test_best_rows_of_many_queries_at_once():
    """Tables of scores with ties and rows that take no part, in several turns, against sorting all."""
    r = np.random.default_rng(2)
    scores = r.integers(0, 12, (7, 90)) / 4.0
    scores[r.random(scores.shape) < 0.3] = -np.inf
    best = search._Best(np.arange(7) * 50, 4)
    for at in range(0, 90, 30):
        best.add(scores[:, at : at + 30], pa.array(np.arange(90)[::-1][at : at + 30]))
    got = [x for b in best.rows(["q", "i", "s"]) for x in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    want = [(q * 50, 89 - i, s) for q in range(7) for s, i in sorted([(scores[q, j], j) for j in range(90) if scores[q, j] >= 0], key=lambda x: (-x[0], -x[1]))[:4]]
    assert got == want


def test_common_terms_score_like_rare_ones():
    r = np.random.default_rng(4)
    weights, parts = (np.where(r.random(shape) < 0.4, r.random(shape), 0.0) for shape in ((40, 9), (25, 9)))
    weights[:, 3:] *= r.random((40, 6)) < 0.1
    term, query = np.nonzero(weights.T)
    asked = search.Asked(np.arange(40), pa.array([f"w{i}" for i in range(9)]), np.searchsorted(term, np.arange(10)), query, weights[query, term])
    assert 0 < asked.table.shape[1] < 9
    doc, of = np.nonzero(parts)
    assert np.allclose(asked.scores(doc, of, parts[doc, of], 25), weights @ parts.T)
    some = np.array([3, 17, 30])
    assert np.allclose(asked.only(some).scores(doc, of, parts[doc, of], 25), weights[some] @ parts.T)


def test_groups_of_queries_have_exact_scores(monkeypatch):
    """Queries and documents of two languages that share a few words, in small tiles, against a product of all with all."""
    r = np.random.default_rng(5)
    kind = lambda n: np.r_[np.zeros(n // 2, int), np.ones(n - n // 2, int)]
    frequent = np.where(r.random(60) < 0.3, 0.5, 0.03)

    def made(n):
        k = r.permutation(kind(n))
        own = np.c_[np.tile(k == 0, (30, 1)).T, np.tile(k == 1, (30, 1)).T]
        return np.where(r.random((n, 60)) < np.where(own, frequent, 0.01), r.random((n, 60)) + 0.1, 0.0)

    weights, parts = made(120), made(300)
    term, query = np.nonzero(weights.T)
    asked = search.Asked(np.arange(120), pa.array([f"w{i}" for i in range(60)]), np.searchsorted(term, np.arange(61)), query, weights[query, term])
    assert len(asked.groups) > 1
    monkeypatch.setattr(search, "HELD_SCORES", 40_000)
    best = search._Best(np.arange(120), 7)
    for at in range(0, 300, 150):
        doc, of = np.nonzero(parts[at : at + 150])
        mine = np.arange(120)[(np.arange(120) >= at) & (np.arange(120) < at + 150)]  # a query's own number is left out
        asked.add_to(best, doc, of, parts[at + doc, of], pa.array(np.arange(at, at + 150)), without=(mine, mine - at))
    got = [x for b in best.rows(["q", "i", "s"]) for x in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    score = search.rounded(weights @ parts.T, 6)
    assert got == [(q, i, s) for q in range(120) for s, i in sorted([(score[q, i], i) for i in range(300) if i != q and score[q, i] > 0], key=lambda x: (-x[0], x[1]))[:7]]


def test_blocks_are_shuffled_once_for_all_batches(spark, tmp_path, monkeypatch):
    docs = {i: f"w{i % 5} w{i % 7} w{i % 11} x{i}" for i in range(60)}
    index = Postings(spark, f"file://{tmp_path}/p", segment=20, folders=2)
    index.build(frame(spark, docs))
    asked = spark.createDataFrame([(i, f"w{i} x{i}") for i in range(8)], "q_id bigint, text string")
    want = sorted(map(tuple, index.search(asked, 3).collect()))
    monkeypatch.setattr(search, "BATCH_BYTES", 60)
    shuffles, dealt = [], type(asked).repartition
    monkeypatch.setattr(type(asked), "repartition", lambda self, *by: (shuffles.append(by), dealt(self, *by))[1])
    assert sorted(map(tuple, index.search(asked, 3).collect())) == want
    assert 0 < shuffles.count(("segment",)) <= 2


def test_the_index_is_written_densely(spark, tmp_path):
    index = Postings(spark, f"file://{tmp_path}/p", segment=20, folders=2)
    index.build(frame(spark, {i: f"w{i % 5} x{i}" for i in range(60)}))
    blocks = list(tmp_path.glob("p/part-*/blocks/**/*.parquet"))
    assert blocks and all(".zstd." in f.name for f in blocks)
