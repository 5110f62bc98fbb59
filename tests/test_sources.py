import email.message

from pyspark.sql import functions as F

from millrace.models import embedding, hashing_embedder, reranked
from millrace.operators.memory import counted, valid_turns
from millrace.sources import files
from millrace.sources.store import Table
from millrace.streaming import sessions
from millrace.streaming.ingest import ingest
from tests.conftest import SMALL


def test_csv_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_text("age;Sex (m/f)\n1;2\n3\n4;5;6\n")
    df = files.read_csv(spark, str(tmp_path / "a.csv"))
    assert df.columns == ["age", "sex_m_f"]
    assert sorted((r.age, r.sex_m_f) for r in df.collect()) == [("1", "2"), ("3", None)]


def test_sniffs():
    assert files.sniff("a|b\n1|2\n") == ("|", True)
    assert files.sniff("1,2\n3,4\n") == (",", False)
    assert files.encoding_of("é".encode()) == "utf-8" and files.encoding_of("é".encode("latin-1") + b"abcdefgh") == "windows-1252"


def test_documents(spark, tmp_path):
    m = email.message.EmailMessage()
    m["Subject"], m["From"], m["To"] = "Hi", "a@x.org", "b@x.org"
    m.set_content("First part.\n\nSecond part.")
    m.add_attachment(b"attached text", maintype="text", subtype="plain", filename="note.txt")
    (tmp_path / "m.eml").write_bytes(m.as_bytes())
    (tmp_path / "t.txt").write_text("one\n\ntwo")
    (tmp_path / "u.xyz").write_bytes(b"\x00")
    rows = files.documents(spark, str(tmp_path)).collect()
    by = {n: [r for r in rows if r.path.endswith(n)] for n in ("m.eml", "t.txt", "u.xyz")}
    assert [r.kind for r in by["m.eml"]] == ["header", "text", "text", "text"] and by["m.eml"][-1].page == 1000 and "[attachment:note.txt]" in by["m.eml"][-1].text
    assert [r.text for r in by["t.txt"]] == ["one", "two"] and by["u.xyz"][0].kind == "error"


def test_html_tables():
    assert files.tables_in("<table><tr><th>a<th>b</tr><tr><td>1</td></tr></table>") == [[["a", "b"], ["1", ""]]]
    assert files.tables_in("<table><tr><td>a</td><td>b</td></tr><tr><td>1</td></tr></table>") == [[["a", "b"], ["1", ""]]]


def test_store(spark, tmp_path):
    t = Table(spark, f"file://{tmp_path}/t", "k")
    t.write(spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"))
    t.snapshot("first")
    t.upsert(spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string"))
    t.upsert(spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string"))
    assert sorted((r.k, r.v) for r in t.read().collect()) == [(1, "a"), (2, "c"), (3, "d")]
    t.delete(F.col("k") == 1)
    assert t.read().count() == 2
    t.restore("first")
    assert sorted(r.k for r in t.read().collect()) == [1, 2] and t.snapshots() == ["first"]
    t.vacuum(1)
    assert t.read().count() == 2


def test_incremental_ingest(spark, tmp_path):
    src = tmp_path / "in"
    t = Table(spark, f"file://{tmp_path}/t", "k")
    for rows in ([(1, "a")], [(1, "b"), (2, "c")]):
        spark.createDataFrame(rows, "k int, v string").write.mode("append").parquet(str(src))
        ingest(spark, str(src), "k int, v string", t, lambda df: df, str(tmp_path / "ck")).awaitTermination(120)
    assert sorted((r.k, r.v) for r in t.read().collect()) == [(1, "b"), (2, "c")]


def test_stream_equals_batch(spark, tmp_path):
    batch = {tuple(r) for r in sessions.session_windows(spark.read.parquet(f"{SMALL}/events.parquet")).collect()}
    schema = spark.read.parquet(f"{SMALL}/events.parquet").schema
    (tmp_path / "e").mkdir()
    (tmp_path / "e/x.parquet").symlink_to(f"{SMALL}/events.parquet")
    q = sessions.session_windows(spark.readStream.schema(schema).parquet(str(tmp_path / "e"))).writeStream.format("memory").queryName("sess").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {tuple(r) for r in spark.table("sess").collect()} == batch


def test_buffer_stream(spark, tmp_path):
    turns = counted(valid_turns(spark.read.parquet(f"{SMALL}/conversations.parquet"))).select("conv_id", "turn", "token_count")
    turns.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(turns.schema).parquet(str(tmp_path / "in"))
    q = sessions.buffers(stream, 300).writeStream.format("memory").queryName("buf").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination(120)
    from millrace.operators.memory import trim

    want = {(r.conv_id, r["count"]) for r in trim(turns, 300).where("kept").groupBy("conv_id").count().collect()}
    assert {(r.conv_id, r.kept) for r in spark.table("buf").collect()} == want


def test_models(spark):
    df = spark.createDataFrame([("q words", "words here", 0.1), ("q", None, 0.2)], "q string, c string, score double")
    v = df.select(embedding(lambda: hashing_embedder(16))("c").alias("v")).collect()
    assert len(v[0].v) == 16 and abs(sum(x * x for x in v[0].v) - 1) < 1e-6
    assert [(r.score, r.first_stage_score) for r in reranked(df, F.col("q"), F.col("c")).collect()] == [(0.5, 0.1), (0.0, 0.2)]
