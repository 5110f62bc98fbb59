"""Learnt languages on held-out rows and on texts of none."""

import pytest
from pyspark.sql import functions as F

from millrace.operators import language
from millrace.sources.scratch import written


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where(F.length("text") >= 60)
    out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    model = written(language.learn(docs.where(~out)), "languages")
    r = language.guessed(docs.where(out), model).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("language") == F.col("lang")).cast("int")).alias("right"), F.avg((F.col("language") == "").cast("int")).alias("none")).first()
    assert r.n > 100 and r.right > 0.9
    plan = language.guessed(docs, model)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_texts_of_no_language(spark):
    rows = [(1, "en", "the cat sat on the mat and the dog ran to the house"), (2, "de", "der Hund und die Katze sind nicht in dem Haus mit der Maus"), (3, None, "nothing is known of this text at all, nor should it be"), (4, "en", None)]
    docs = spark.createDataFrame(rows, "doc_id int, lang string, text string")
    model = written(language.learn(docs), "languages")
    asked = [(1, "the dog and the cat ran to the mat, the house"), (2, "die Katze und der Hund mit dem Haus"), (3, "the cat"), (4, None), (5, "0123456789 " * 5), (6, "\u0436\u0443\u043a \u0438 \u043b\u0443\u0447 " * 6)]
    got = {r.doc_id: r.language for r in language.guessed(spark.createDataFrame(asked, "doc_id int, text string"), model).collect()}
    assert got == {1: "en", 2: "de", 3: "", 4: "", 5: "", 6: ""}
    with pytest.raises(Exception, match="more than"):
        language.guessed(docs, language.learn(spark.range(300).select(F.lit("some words here").alias("text"), F.col("id").cast("string").alias("lang")))).collect()


def test_whole_texts_count(spark):
    late = "0123456789 " * 40
    rows = [(1, "en", late + "the cat sat on the mat and the dog ran to the house"), (2, "de", late + "der Hund und die Katze sind nicht in dem Haus mit der Maus")]
    docs = spark.createDataFrame(rows, "doc_id int, lang string, text string")
    asked = spark.createDataFrame([(1, late + "the dog and the cat ran to the mat"), (2, late + "die Katze und der Hund mit dem Haus")], "doc_id int, text string")
    got = {r.doc_id: r.language for r in language.guessed(asked, written(language.learn(docs), "languages")).collect()}
    assert got == {1: "en", 2: "de"}
