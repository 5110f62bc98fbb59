"""Queries over stored indexes and tables that change."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import calibration, factors, retrieval
from millrace.plans.registry import query, table
from millrace.plans.retrieval_queries import _BM25, _DENSE, EVERY
from millrace.sources.postings import Postings
from millrace.sources.scratch import scratch, written
from millrace.sources.vectors import VectorIndex


def _asked(docs):
    return docs.where(F.col("doc_id") % EVERY == 0).select(F.col("doc_id").alias("q_id"), "text")


@query("postings_top10", f"{_BM25} SELECT q_id, doc_id, score, rk FROM rk WHERE rk <= 10")
def postings_top10(spark, d):
    """Every fiftieth document is a query against the stored index of all documents."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    index = Postings(spark, scratch(spark, "postings"))
    index.build(docs)
    return index.search(_asked(docs), 10)


_CHANGED = "changed AS (SELECT doc_id, CASE WHEN doc_id % 10 = 3 THEN text || ' ' || source ELSE text END AS text, lang, source FROM documents WHERE doc_id % 10 <> 7)"


@query("postings_updated", f"{_BM25.replace('WITH toks', f'WITH {_CHANGED}, toks').replace('FROM documents)', 'FROM changed)')} SELECT q_id, doc_id, score, rk FROM rk WHERE rk <= 10")
def postings_updated(spark, d):
    """The index of all documents, after a tenth has other texts and a tenth has gone."""
    docs = table(spark, d, "documents").select("doc_id", "text", "source")
    index = Postings(spark, scratch(spark, "postings"))
    index.build(docs)
    new = docs.where("doc_id % 10 = 3").withColumn("text", F.concat_ws(" ", "text", "source"))
    index.upsert(new, removed=docs.where("doc_id % 10 = 7"))
    return index.search(_asked(docs), 10)


@query("csv_quoted_lines", "SELECT CAST(doc_id AS VARCHAR) AS doc_id, md5(text) AS h, lang, source FROM documents WHERE text <> ''")
def csv_quoted_lines(spark, d):
    """Documents with their line breaks, quotes and separators, written as CSV and read in parallel."""
    from millrace.sources.files import read_csv

    path = scratch(spark, "quoted")
    docs = table(spark, d, "documents").where("text <> ''").select("doc_id", "text", "lang", "source")
    docs.write.options(header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    return read_csv(spark, path, ",", True).select("doc_id", F.md5("text").alias("h"), "lang", "source")


def _vector_queries(v):
    return v.where(F.col("vec_id") % EVERY == 0).select(F.col("vec_id").alias("q_id"), F.col("embedding").alias("q"))


@query("vector_index_topk", f"WITH {_DENSE} SELECT q_id, vec_id, sim, rk FROM dr WHERE rk <= 10")
def vector_index_topk(spark, d):
    """Every fiftieth vector is a query against the stored index of all vectors."""
    v = table(spark, d, "embeddings")
    index = VectorIndex(spark, scratch(spark, "vectors"), folder=500)
    index.build(v)
    return index.search(_vector_queries(v), 10, exclude_self=True)


@query("vector_index_filtered", f"""WITH {_DENSE.replace("FROM embeddings e, dq WHERE e.vec_id <> q_id", "FROM embeddings e JOIN documents x ON x.doc_id = e.vec_id, dq WHERE lang = 'en' AND source IN ('src0', 'src1', 'src2') AND e.vec_id % 10 <> 3")} SELECT q_id, vec_id, sim, rk FROM dr WHERE rk <= 5""")
def vector_index_filtered(spark, d):
    """The filter is pushed into the clusters' folders; a tenth of the vectors has gone."""
    v = table(spark, d, "embeddings").join(table(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), "lang", "source"), "vec_id", "left")
    index = VectorIndex(spark, scratch(spark, "vectors"), columns=["lang", "source"], folder=500)
    index.build(v)
    index.delete(v.where("vec_id % 10 = 3"))
    return index.search(_vector_queries(v), 5, retrieval.payload_filter({"lang": "en", "source": ["src0", "src1", "src2"]}))


_CELLS = "list_transform(range(1, length(s) - 1), lambda i: (unicode(s[i]) * 961 + unicode(s[i + 1]) * 31 + unicode(s[i + 2])) % 16384)"


@query(
    "language_learnt",
    f"""WITH t AS (SELECT doc_id, lang, length(text) AS n, {_CELLS} AS cells FROM (SELECT doc_id, lang, text, ' ' || trim(regexp_replace(lower(text), '[^\\p{{L}}]+', ' ', 'g')) || ' ' AS s FROM documents)),
e AS (SELECT lang AS l, unnest(cells) AS cell FROM t WHERE lang IS NOT NULL), c AS (SELECT l, cell, count(*) AS n FROM e GROUP BY l, cell), k AS (SELECT l, sum(n)::DOUBLE AS total FROM c GROUP BY l),
u AS (SELECT doc_id, unnest(cells) AS cell FROM t), g AS (SELECT doc_id, k.l, sum(ln((coalesce(c.n, 0) + 1.0::DOUBLE) / (total + 16384.0::DOUBLE))) AS s, count(*) * ln(1.0::DOUBLE / 16384) AS none FROM u CROSS JOIN k LEFT JOIN c ON c.l = k.l AND c.cell = u.cell GROUP BY doc_id, k.l),
r AS (SELECT doc_id, CASE WHEN s > none THEN l ELSE '' END AS l, row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, l) AS rk FROM g) SELECT t.doc_id, CASE WHEN n >= 30 THEN coalesce(r.l, '') ELSE '' END AS language FROM t LEFT JOIN r ON r.doc_id = t.doc_id AND rk = 1""",
)
def language_learnt(spark, d):
    """Languages of all documents by a model learnt from their labels."""
    from millrace.operators import language
    from millrace.sources.scratch import written

    docs = table(spark, d, "documents").select("doc_id", "lang", "text")
    return language.guessed(docs, written(language.learn(docs), "languages")).select("doc_id", "language")


def diversity(text):
    """A text's share of distinct words, as a cell; null without words."""
    words = F.regexp_extract_all(text, F.lit("[A-Za-z0-9]+"), F.lit(0))
    return F.when(F.size(words) > 0, F.least(F.floor(F.size(F.array_distinct(words)) * calibration.CELLS / F.size(words)), F.lit(calibration.CELLS - 1)).cast("int"))


@query(
    "calibrated_confidence",
    """WITH t AS (SELECT doc_id, regexp_extract_all(text, '[A-Za-z0-9]+') AS w FROM documents), d AS (SELECT doc_id, CASE WHEN len(w) > 0 THEN least(len(list_distinct(w)) * 1024 // len(w), 1023) END::INTEGER AS cell FROM t),
g AS (SELECT cell, count(*) AS n, sum(quality) AS yes FROM d JOIN labels USING (doc_id) WHERE cell IS NOT NULL AND quality IN (0, 1) GROUP BY cell),
p AS (SELECT cell, row_number() OVER (ORDER BY cell) AS i, sum(n) OVER (ORDER BY cell) AS n, sum(yes) OVER (ORDER BY cell) AS yes FROM g), z AS (SELECT i, n, yes FROM p UNION ALL SELECT 0, 0, 0),
jk AS (SELECT a.i AS j, b.i AS k, (b.yes - a.yes)::DOUBLE / (b.n - a.n)::DOUBLE AS share FROM z a JOIN z b ON a.i < b.i),
low AS (SELECT j, k AS i, min(share) OVER (PARTITION BY j ORDER BY k DESC) AS least_share FROM jk), iso AS (SELECT i, max(least_share) AS confidence FROM low GROUP BY i),
known AS (SELECT p.cell, iso.confidence FROM p JOIN iso USING (i)),
c AS (SELECT cell, coalesce((SELECT max_by(confidence, known.cell) FROM known WHERE known.cell <= s.cell), (SELECT min_by(confidence, known.cell) FROM known)) AS confidence FROM (SELECT DISTINCT cell FROM d WHERE cell IS NOT NULL) s)
SELECT d.doc_id, d.cell, c.confidence FROM d LEFT JOIN c ON c.cell = d.cell""",
)
def calibrated_confidence(spark, d):
    """Each document's chance of being labelled good by its share of distinct words, learnt from all labelled ones."""
    docs = written(table(spark, d, "documents").select("doc_id", diversity(F.col("text")).alias("cell")), "cells")
    labels = table(spark, d, "labels").select("doc_id", F.col("quality").alias("label"))
    return docs.withColumn("confidence", calibration.confidence(F.col("cell"), calibration.learn(docs.join(labels, "doc_id"))))


@query("factor_neighbours")
def factor_neighbours(spark, d):
    """The five nearest documents of every fiftieth one, by embeddings that are learnt from the documents."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    run = factors.embedding(spark, factors.fit(docs))
    vectors = written(docs.select("doc_id", run(F.col("text")).alias("embedding")), "factors")
    asked = vectors.where(F.col("doc_id") % EVERY == 0).select(F.col("doc_id").alias("q_id"), F.col("embedding").alias("q"))
    return retrieval.dense(vectors, asked, 5, id_col="doc_id", exclude_self=True)


def _replayed(spark, rows, ts: str, make):
    """A stateful stream over rows, in files in the order of arrival, run twice on one checkpoint: the second time after a last
    row from far later, which moves the watermark past all others."""
    source, sink, state = (scratch(spark, n) for n in ("arrivals", "replayed", "state"))
    rows.write.parquet(f"{source}/part=0")
    last = rows.where(F.col(ts).isNotNull()).orderBy(F.col(ts).desc()).limit(1)
    for turn in range(2):
        if turn:
            last.withColumn(ts, F.col(ts) + F.expr("INTERVAL 400 DAYS")).write.parquet(f"{source}/part=1")
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 16).parquet(f"{source}/part=*")
        make(stream).writeStream.format("parquet").option("path", sink).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(sink)


_ARRIVED = "SELECT click_id, client_id, kind, epoch_us(ts) AS us FROM clicks WHERE ts IS NOT NULL"


@query(
    "rewrite_cache_stream",
    f"""WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY client_id, kind ORDER BY us, click_id) AS j FROM ({_ARRIVED})),
f AS (SELECT client_id, kind, click_id, us, j, us AS made, false AS hit FROM o WHERE j = 1 UNION ALL SELECT o.client_id, o.kind, o.click_id, o.us, o.j, CASE WHEN o.us - f.made > 300000000 THEN o.us ELSE f.made END, o.us - f.made <= 300000000
FROM f JOIN o ON o.client_id IS NOT DISTINCT FROM f.client_id AND o.kind IS NOT DISTINCT FROM f.kind AND o.j = f.j + 1) SELECT client_id, kind, us, hit, count(*) AS n FROM f GROUP BY ALL""",
)
def rewrite_cache_stream(spark, d):
    """Clicks as requests: a client is a session, the kind a question; rows arrive out of order."""
    from millrace.streaming import timed

    clicks = table(spark, d, "clicks").select("client_id", "kind", "ts", "click_id", "arrived_at")
    rows = clicks.repartitionByRange(8, "arrived_at").drop("arrived_at")
    done = _replayed(spark, rows, "ts", lambda s: timed.rewrite_cache(s, "client_id", "kind", "ts", "4 days", id_col="click_id"))
    return done.groupBy("client_id", "kind", "us", "hit").agg(F.count(F.lit(1)).alias("n"))
