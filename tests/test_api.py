import pytest

from millrace.api import Workspace


def test_a_day_at_the_workspace(spark, tmp_path):
    w = Workspace(spark, f"file://{tmp_path}/w")
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs/cats.txt").write_text("# Cats\n\nCats sleep most of the day and purr when they are content.\n\n# Food\n\nThey eat fish and chicken twice a day.")
    (tmp_path / "docs/ships.txt").write_text("Ships carry cargo over the sea from one harbour to another harbour.")
    assert {r.source: r.chunks for r in w.index(f"file://{tmp_path}/docs").collect()} == {"cats": 2, "ships": 1}
    w.index(f"file://{tmp_path}/docs")
    assert w.stats().first().rows == 3
    hits = w.search("harbour cargo ships", limit=1).collect()
    assert [h.source for h in hits] == ["ships"]
    assert w.search("fish chicken", limit=1, window=1).count() == 2
    assert w.search("fish", filters={"source": ["ships"]}).where("source <> 'ships'").count() == 0
    with pytest.raises(ValueError):
        w.search("x", limit=101)
    w.backup("one")
    w.delete("ships")
    assert [r.source for r in w.documents().collect()] == ["cats"] and w.chunks.snapshots() == ["one"]
    (tmp_path / "t.csv").write_text("Name,Score\nAda,3\nBob,5\n")
    assert w.register_csv("scores", f"file://{tmp_path}/t.csv").first().total_rows == 2
    assert w.query("SELECT max(cast(score AS int)) AS m FROM {table}", "scores").result.first().m == 5
    w.say("s1", "u1", [(0, "user", "hello there"), (1, "assistant", "hi")])
    assert w.buffer("s1", "u1").count() == 2 and w.buffer("s1", "u2").count() == 0 and w.sessions("u1").count() == 1
    with pytest.raises(PermissionError):
        w.say("s1", "u2", [(2, "user", "mine now")])
    w.remember("u1", {"name": "Ada"})
    w.remember("u1", {"name": "Eve"})
    assert w.facts_of("u1").first().facts == {"name": "Eve"}
    w.rate("f1", 1)
    w.rate("f1", -1, True)
    r = w.feedback().where("scope = 'all'").first()
    assert (r.total, r.not_helpful, r.escalated) == (1, 1, 1)


def test_owners_errors_and_emptied_files(spark, tmp_path):
    w = Workspace(spark, f"file://{tmp_path}/w")
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs/cats.txt").write_text("Cats sleep most of the day and purr when they are content.")
    (tmp_path / "docs/ships.txt").write_text("Ships carry cargo over the sea from one harbour to another harbour.")
    (tmp_path / "docs/odd.bin").write_bytes(b"\x00\x01")
    (tmp_path / "docs/more").mkdir()
    (tmp_path / "docs/more/cats.txt").write_text("Another file of the same name about cats and their habits.")
    for owner in ("u1", "u3"):
        w.index(f"file://{tmp_path}/docs", owner)
    count = lambda owner: {r.source: r.n for r in w.chunks.read().where(f"owner_id = '{owner}'").groupBy("source").count().withColumnRenamed("count", "n").collect()}
    assert count("u1") == count("u3") == {"cats": 2, "ships": 1}
    assert [(r.owner_id, r.path.rsplit("/", 1)[-1], r.reason) for r in w.failures().orderBy("owner_id").collect()] == [("u1", "odd.bin", "no reader"), ("u3", "odd.bin", "no reader")]
    before = w.chunks._state()[1]["buckets"]
    (tmp_path / "docs/ships.txt").write_text("Ships sail.\n\nHarbours are where they rest over the winter months.")
    (tmp_path / "docs/cats.txt").write_text("   \n ")
    w.index(f"file://{tmp_path}/docs", "u1")
    assert w.chunks._state()[1]["buckets"] == before  # only changes were written
    assert count("u3") == {"cats": 2, "ships": 1}
    assert w.chunks.read().where("owner_id = 'u1' AND content LIKE '%purr%'").count() == 0 and count("u1")["cats"] == 1
    with pytest.raises(ValueError, match="no reader"):
        w.index(f"file://{tmp_path}/docs", "u1", strict=True)
