"""Stores with two writers, preferences, staged answers, and limits of readers."""

import pytest
from pyspark.sql import functions as F

from millrace.api import Workspace
from millrace.sources import files
from millrace.sources.store import Conflict, Table


def test_two_writers(spark, tmp_path):
    rows = lambda *k: spark.createDataFrame([(i, f"v{i}") for i in k], "k bigint, v string")
    first, second = (Table(spark, f"file://{tmp_path}/t", "k", buckets=4) for _ in range(2))
    first.write(rows(*range(20)))
    base, manifest = second._state()
    first.upsert(rows(3).withColumn("v", F.lit("new")))
    with pytest.raises(Conflict):  # made from a version that is no longer the last
        second._next(base, manifest)
    assert {r.k: r.v for r in second.read().collect()} == {i: "new" if i == 3 else f"v{i}" for i in range(20)}
    _, now = second._state()
    assert now["buckets"] == manifest["buckets"] and [c["rows"] for c in now["changes"]] == [1]  # no bucket was rewritten
    first.compact()
    _, now = second._state()
    assert sum(manifest["buckets"].get(k) != f for k, f in now["buckets"].items()) == 1 and not now["changes"]  # one bucket was
    assert {r.k: r.v for r in second.read().collect()} == {i: "new" if i == 3 else f"v{i}" for i in range(20)}
    first.snapshot("kept")
    first.delete(F.col("k") >= 0)
    first.vacuum(keep=1)
    assert first.read().count() == 0 and first.snapshots() == ["kept"]
    first.restore("kept")
    assert first.read().count() == 20


def test_preferences(spark, tmp_path):
    w = Workspace(spark, f"file://{tmp_path}/w")
    a = w.prefer("ann", "short answers")
    assert w.prefer("ann", "short answers") == a != w.prefer("bob", "short answers")
    b = w.prefer("ann", "metric units please")
    assert [r.preference_id for r in w.preferences("ann").collect()] == [b, a]
    assert w.preferences("ann", "which units", limit=1).first().preference_id == b
    w.forget("bob", a)
    w.forget("ann", a)
    assert [r.preference_id for r in w.preferences("ann").collect()] == [b]


def test_staged_answer(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.txt").write_text("The harbour handled forty tonnes of cargo in the winter months.")
    w = Workspace(spark, f"file://{tmp_path}/w")
    w.index(f"file://{tmp_path}/d")
    found = w.search("cargo and months", decompose=lambda q: q.split(" and "), imagine=lambda q: f"about {q}").collect()
    assert len(found) == 1
    events = list(w.events("harbour cargo", lambda q, hits: iter(["forty ", "tonnes"])))
    assert [n for n, _ in events] == ["sources", "token", "token", "eval", "done"]
    assert events[3][1] == {"confidence": 1.0} and events[4][1] == "forty tonnes"

    def broken(q, hits):
        raise ValueError("no model")

    assert list(w.events("harbour cargo", broken))[-1] == ("error", "no model")


def test_limits_of_readers(spark, tmp_path):
    (tmp_path / "big.txt").write_text("x" * 2000)
    (tmp_path / "small.txt").write_text("some words")
    (tmp_path / "slow.odd").write_text("x")

    def slow(raw):
        import time

        time.sleep(5)

    got = {r.path.rsplit("/", 1)[-1]: (r.kind, r.text) for r in files.documents(spark, f"file://{tmp_path}", {"odd": slow}, most_bytes=1000, seconds=0.5).collect()}
    assert got["small.txt"] == ("text", "some words")
    assert got["big.txt"] == ("error", "larger than 1000 bytes") and got["slow.odd"][0] == "error" and "0.5 s" in got["slow.odd"][1]
