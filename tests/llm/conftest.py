import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def corpus():
    """A small corpus with copies, near copies, shared passages, nulls, empty and long texts, repeated rows and ids."""
    r = random.Random(7)
    vocabulary = ["".join(r.choice("abcdeéü") for _ in range(r.randint(2, 7))) for _ in range(400)]
    say = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    passage = say(70)
    texts = [say(r.randint(60, 200)) for _ in range(30)]
    texts += [texts[0], texts[1], texts[1]]
    for i in range(2, 8):
        w = texts[i].split()
        w[len(w) // 2] = "changed"
        texts.append(" ".join(w))
    texts += [f"{say(20)}\n{passage} {say(15 + i)}" for i in range(4)]
    texts += [None, "", "   \n\t ", "one", "One", "two words", "TWO words", f"{passage} {passage}", "same " * 120, "same " * 90, say(6000), "a b " * 40]
    texts += ["mail a.b@x.example.org or +1 (017) 555-7713, ip 10.0.0.256 10.0.0.7, card 4111 1111 1111 1111", "token = \"3fdf5a35c7b8d733c0b5c7d364eda8ac88d929d1\" end", "# $ % | < > *\nline\nline\n\nline!!", "\x00odd\x0bspace\x1cs"]
    rows = [(i, t, "en", "src0", len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (5, "another text of the same id " + say(50), "fr", "s", 1), (None, say(80), None, None, None), (None, texts[9], None, None, None), (None, None, None, None, None)]
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(docs):
    """Columns named like those that operators add."""
    from pyspark.sql import functions as F

    names = ["node", "component_id", "component", "text_key", "score", "spans", "id", "a", "b", "first", "end", "n_words", "bucket", "key", "words", "label", "rank", "length", "piece", "start", "_own", "_k", "_n", "_once", "_id", "_key", "_text", "_spans", "n", "w", "l"]
    return docs.select("*", *[F.lit("x").alias(n) for n in names])
