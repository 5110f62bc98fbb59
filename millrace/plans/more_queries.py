"""Sinks, stores, slugs, flags and small text rules as queries, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import routing
from millrace.functions import text as T
from millrace.operators import chunking, evaluate, layout, memory, profile, retrieval
from millrace.plans import functions
from millrace.plans.registry import query, table
from millrace.plans.text_queries import _chain, _trim
from millrace.sources import files
from millrace.sources.scratch import scratch
from millrace.sources.store import Results, Table, append_csv, write_summary

_NL = "chr(10)"


def _customers(spark, d):
    return table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal")


def _stored(spark, d):
    t = Table(spark, scratch(spark, "store"), "c_custkey", buckets=4)
    t.write(_customers(spark, d))
    return t


@query("store_upsert", "SELECT c_custkey, c_nationkey, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal FROM customer UNION ALL SELECT -c_custkey, c_nationkey, c_acctbal FROM customer WHERE c_custkey % 100 = 1")
def store_upsert(spark, d):
    t, rows = _stored(spark, d), _customers(spark, d)
    changed = rows.where("c_custkey % 3 = 0").withColumn("c_acctbal", F.col("c_acctbal") + 1)
    t.upsert(changed.unionByName(rows.where("c_custkey % 100 = 1").withColumn("c_custkey", -F.col("c_custkey"))))
    return t.read()


@query("store_delete", "SELECT c_custkey FROM customer WHERE c_nationkey <> 7")
def store_delete(spark, d):
    t = _stored(spark, d)
    t.delete(F.col("c_nationkey") == 7)
    return t.read().select("c_custkey")


@query("store_page", "SELECT c_custkey FROM customer WHERE c_custkey > 40 ORDER BY c_custkey LIMIT 256")
def store_page(spark, d):
    return _stored(spark, d).page(after=40).select("c_custkey")


@query("store_stats", "SELECT count(*) AS \"rows\", count(DISTINCT c_custkey) AS keys FROM customer")
def store_stats(spark, d):
    return _stored(spark, d).stats()


@query("store_snapshot", "SELECT c_custkey FROM customer")
def store_snapshot(spark, d):
    t = _stored(spark, d)
    t.snapshot("whole")
    t.delete(F.col("c_nationkey") >= 0)
    t.restore("whole")
    return t.read().select("c_custkey")


@query("store_document", "SELECT doc_id, chunk_index FROM (SELECT source AS doc_id, row_number() OVER (PARTITION BY source ORDER BY documents.doc_id) AS chunk_index FROM documents) WHERE doc_id = 'src1' ORDER BY chunk_index LIMIT 1000")
def store_document(spark, d):
    from pyspark.sql import Window

    t = Table(spark, scratch(spark, "store"), "chunk_id", buckets=4)
    n = F.row_number().over(Window.partitionBy("source").orderBy("doc_id")).cast("bigint")
    t.write(table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("doc_id"), n.alias("chunk_index")))
    return t.of_document("src1").select("doc_id", "chunk_index")


@query("csv_append_sink", "SELECT CAST(r_regionkey AS VARCHAR) AS r_regionkey, r_name FROM region UNION ALL SELECT CAST(r_regionkey AS VARCHAR), r_name FROM region")
def csv_append_sink(spark, d):
    path = scratch(spark, "csv")
    for _ in range(2):
        append_csv(table(spark, d, "region"), path)
    return spark.read.option("header", True).csv(path)


@query("summary_sink", "SELECT count(*) AS n, count(DISTINCT doc_id) AS docs FROM labels")
def summary_sink(spark, d):
    path = scratch(spark, "summary")
    write_summary(table(spark, d, "labels").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs")), path)
    return spark.read.json(path)


@query("json_results", "SELECT 'b' AS name, count(*) AS n FROM orders")
def json_results(spark, d):
    r = Results(spark, scratch(spark, "results"))
    for name, rows in (("a", table(spark, d, "customer")), ("b", table(spark, d, "orders"))):
        r.put(name, rows.agg(F.count("*").alias("n")))
    r.delete("a")
    return r.get(r.names()[0]).select(F.lit(r.names()[0]).alias("name"), "n")


_SLUG = "regexp_replace(regexp_replace(lower({}), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')"


@query("column_slugs", f"SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 THEN 'col_3' ELSE {_SLUG.format(chr(39) + ' ($) ' + chr(39) + ' || p_type || ' + chr(39) + ' ' + chr(39))} END AS slug FROM part")
def column_slugs(spark, d):
    name = F.when(F.col("p_partkey") % 10 == 0, F.lit(" ($) ")).otherwise(F.concat(F.lit(" ($) "), F.col("p_type"), F.lit(" ")))
    return table(spark, d, "part").select("p_partkey", T.column_slug(name, F.lit(3)).alias("slug"))


@query("table_slugs", f"SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 't_' ELSE '' END || {_SLUG.format('CASE WHEN p_partkey % 2 = 0 THEN p_size || p_name ELSE p_name END')} AS slug FROM part")
def table_slugs(spark, d):
    name = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.col("p_size"), F.col("p_name"))).otherwise(F.col("p_name"))
    return table(spark, d, "part").select("p_partkey", T.table_slug(name).alias("slug"))


@query("id_slugs", "SELECT conv_id, turn, CASE WHEN s = '' THEN 'file' ELSE s END AS slug FROM (SELECT conv_id, turn, lower(regexp_replace(regexp_replace(regexp_replace(strip_accents(text), '[^\\x00-\\x7F]', '', 'g'), '[^a-zA-Z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')) AS s FROM conversations)")
def id_slugs(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", T.id_slug(F.col("text")).alias("slug"))


@query("upload_owner", "SELECT doc_id, CASE WHEN toxic = 1 OR doc_id % 7 = 0 THEN '__global__' ELSE 'u' || doc_id % 5 END AS owner_id FROM labels")
def upload_owner(spark, d):
    user = F.when(F.col("doc_id") % 7 != 0, F.concat(F.lit("u"), F.col("doc_id") % 5))
    return table(spark, d, "labels").select("doc_id", retrieval.owner_of_upload(F.col("toxic") == 1, user).alias("owner_id"))


_CTRL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"


@query("block_normalise", f"SELECT doc_id, md5({_trim(_chain('text', [(_CTRL, chr(39) * 2, 'g'), (r'([\p{L}\p{N}_])-\s*\n\s*([\p{L}\p{N}_])', chr(39) + chr(92) + '1' + chr(92) + '2' + chr(39), 'g'), (r'[ \t]{2,}', chr(39) + ' ' + chr(39), 'g')]))}) AS h FROM documents")
def block_normalise(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(T.normalise_block(F.col("text"))).alias("h"))


@query("metadata_clean", "SELECT event_id, 'type=' || event_type || CASE WHEN event_id % 2 = 0 THEN ',user=' || user_id ELSE '' END AS kept FROM events")
def metadata_clean(spark, d):
    user = F.when(F.col("event_id") % 2 == 0, F.col("user_id").cast("string"))
    raw = F.create_map(F.lit("type"), "event_type", F.lit("user"), user, F.lit("blank"), F.lit(""), F.lit("none"), F.lit("[]"))
    kept = F.transform(F.array_sort(F.map_entries(T.clean_metadata(raw))), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return table(spark, d, "events").select("event_id", F.array_join(kept, ",").alias("kept"))


@query("table_clean", f"SELECT n_nationkey, '| a | b |' || {_NL} || '| ' || n_name || ' | 1 |' AS markdown FROM nation")
def table_clean(spark, d):
    raw = F.concat(F.lit("| a | b |\n| --- | :-: |\n|  |  |\n| "), F.col("n_name"), F.lit(" | 1 |\n| - | |\n"))
    return table(spark, d, "nation").select("n_nationkey", T.clean_table(raw).alias("markdown"))


@query("region_tables", f"SELECT n_regionkey, count(*) >= 1 AS real, '| key | name |' || {_NL} || '| --- | --- |' || {_NL} || string_agg('| ' || n_nationkey || ' | ' || n_name || ' |', {_NL} ORDER BY n_nationkey) AS markdown FROM nation GROUP BY n_regionkey")
def region_tables(spark, d):
    body = F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: F.array(x["n_nationkey"].cast("string"), x["n_name"]))
    rows = table(spark, d, "nation").groupBy("n_regionkey").agg(F.concat(F.array(F.array(F.lit("key"), F.lit("name"))), body).alias("r"))
    return rows.select("n_regionkey", T.is_real_table(F.col("r")).alias("real"), T.markdown_table(F.col("r")).alias("markdown"))


@query("attachment_tags", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'f' || doc_id || '.pdf' ELSE '' END AS attachment FROM documents")
def attachment_tags(spark, d):
    tagged = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("[attachment:f"), F.col("doc_id"), F.lit(".pdf]\n"), F.col("text"))).otherwise(F.concat(F.lit("x "), F.col("text")))
    return table(spark, d, "documents").select("doc_id", T.attachment_of(tagged).alias("attachment"))


@query("email_own_words", f"SELECT c_custkey, 'Dear ' || c_name || {_NL} || 'bye' AS body FROM customer")
def email_own_words(spark, d):
    raw = F.concat(F.lit("Dear "), F.col("c_name"), F.lit("\n> old words\n>> older\nOn Monday Ann wrote:\nbye\n-- \nAnn\nSales"))
    return table(spark, d, "customer").select("c_custkey", chunking.without_quotes(raw).alias("body"))


@query("email_headers", f"SELECT c_custkey, 'Subject: ' || c_mktsegment || CASE WHEN c_custkey % 2 = 0 THEN {_NL} || 'From: ' || c_name ELSE '' END || {_NL} || 'Date: today' AS header FROM customer")
def email_headers(spark, d):
    sender = F.when(F.col("c_custkey") % 2 == 0, F.col("c_name"))
    return table(spark, d, "customer").select("c_custkey", chunking.email_header(sender, F.lit(""), F.col("c_mktsegment"), F.lit("today")).alias("header"))


@query("boilerplate_flag", f"SELECT doc_id, greatest(1, length(text) // 4) <= 60 OR len(list_filter(list_filter(list_transform(string_split_regex(text, '[.!?\\n]+'), lambda x: {_trim('x')}), lambda x: x <> ''), lambda x: NOT regexp_matches(x, '{T.BOILERPLATE}'))) = 0 AS boilerplate FROM documents")
def boilerplate_flag(spark, d):
    return table(spark, d, "documents").select("doc_id", T.is_boilerplate(F.col("text")).alias("boilerplate"))


@query("think_strip", "SELECT conv_id, turn, 'Answer ' || turn AS reply FROM conversations")
def think_strip(spark, d):
    raw = F.concat(F.lit("<think>"), F.col("text"), F.lit("</think> Answer "), F.col("turn"), F.lit("\n<THINK>never closed "), F.col("text"))
    return table(spark, d, "conversations").select("conv_id", "turn", T.strip_think(raw).alias("reply"))


@query("skip_unchanged", "SELECT coalesce(n.k, o.k) AS table_name, CASE WHEN n.k IS NULL OR n.h IS NOT DISTINCT FROM o.h THEN 'old' ELSE 'new' END AS state FROM (SELECT o_orderkey AS k, o_orderstatus AS h FROM orders) o FULL JOIN (SELECT o_orderkey + 4 AS k, o_orderstatus AS h FROM orders) n ON o.k = n.k")
def skip_unchanged(spark, d):
    """The new entries' keys are moved by four: some are new, some are gone, the others have the same hash or another."""
    row = lambda key, state: table(spark, d, "orders").select(key.alias("table_name"), F.col("o_orderstatus").alias("file_hash"), F.lit(state).alias("state"))
    return profile.register(row(F.col("o_orderkey"), "old"), row(F.col("o_orderkey") + 4, "new")).select("table_name", "state")


@query("last_answers", "SELECT question, place FROM (SELECT trim(text) AS question, conv_id * 1000 + turn AS place, row_number() OVER (PARTITION BY trim(text) ORDER BY conv_id * 1000 + turn DESC) AS n FROM conversations WHERE text IS NOT NULL) WHERE n = 1")
def last_answers(spark, d):
    rows = table(spark, d, "conversations").where("text IS NOT NULL").select(F.concat(F.lit(" "), F.col("text")).alias("question"), (F.col("conv_id") * 1000 + F.col("turn")).alias("place"))
    return evaluate.last_answers(rows, "place").select("question", "place")


@query("schema_text", f"SELECT 'Table part, ' || count(*) || ' rows' || {_NL} || '- p_brand (string): nulls 0' || {_NL} || '- p_size (int): nulls 0' AS schema_text FROM part")
def schema_text(spark, d):
    part = table(spark, d, "part").select("p_size", "p_brand")
    return profile.schema_text(profile.summaries(part), "part", part.count())


@query("chunk_statistics", "SELECT count(*) AS total, count(*) FILTER (lang = 'en') AS text, count(*) FILTER (lang = 'fr') AS \"table\", count(*) FILTER (lang NOT IN ('en', 'fr')) AS image, CAST(sum(greatest(1, length(text) // 4)) AS BIGINT) AS tokens FROM documents")
def chunk_statistics(spark, d):
    kind = F.when(F.col("lang") == "en", "text").when(F.col("lang") == "fr", "table").otherwise("image")
    return chunking.statistics(table(spark, d, "documents").select(kind.alias("type"), T.token_count(F.col("text")).alias("token_count")))


@query("page_chunk_ids", "SELECT doc_id, source || '_p' || (doc_id % 3 + 1) || '_' || CASE WHEN lang = 'en' THEN 'text' ELSE 'table' END || (row_number() OVER (PARTITION BY source, doc_id % 3 ORDER BY doc_id) - 1) AS chunk_id FROM documents")
def page_chunk_ids(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "source", (F.col("doc_id") % 3).alias("page"), F.when(F.col("lang") == "en", "text").otherwise("table").alias("type"))
    return chunking.page_ids(rows, order="doc_id").select("doc_id", "chunk_id")


@query("memory_context", "SELECT o_orderkey AS session_id, c.c_name AS user_id, s.s_name AS summary, n.n_name AS facts FROM orders LEFT JOIN customer c ON o_custkey = c_custkey LEFT JOIN supplier s ON o_orderkey = s_suppkey LEFT JOIN nation n ON c.c_nationkey = n_nationkey")
def memory_context(spark, d):
    customers = table(spark, d, "customer").select(F.col("c_name").alias("user_id"), "c_custkey", "c_nationkey")
    requests = table(spark, d, "orders").select(F.col("o_orderkey").alias("session_id"), F.col("o_custkey").alias("c_custkey")).join(customers.select("c_custkey", "user_id"), "c_custkey", "left")
    facts = customers.join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("user_id", F.col("n_name").alias("facts"))
    summaries = table(spark, d, "supplier").select(F.col("s_suppkey").alias("session_id"), F.col("s_name").alias("summary"))
    none = lambda *c: spark.createDataFrame([], ", ".join(c))
    return memory.context(requests, none("session_id bigint", "buffer string"), summaries, facts, none("user_id string", "preferences string")).select("session_id", "user_id", "summary", "facts")


@query("figure_captions", "SELECT p_partkey, p_name || ',Figure' AS captions FROM part")
def figure_captions(spark, d):
    raw = F.concat(F.lit("see [FIGURE: "), F.col("p_name"), F.lit("] and [IMAGE] here"))
    return table(spark, d, "part").select("p_partkey", F.array_join(chunking.figures(raw), ",").alias("captions"))


_EXTENSIONS = ("pdf", "DOCX", "png", "jpg", "txt")


@query("magic_bytes", "SELECT page_id, page_id % 5 = 4 OR page_id % 2 = 0 AS fits FROM pages WHERE html IS NOT NULL")
def magic_bytes(spark, d):
    """Pages as uploads of several types, every other one behind its type's first bytes."""
    pages = table(spark, d, "pages").where("html IS NOT NULL")
    ext = F.element_at(F.array(*[F.lit(x) for x in _EXTENSIONS]), (F.col("page_id") % 5 + 1).cast("int"))
    mark = F.element_at(F.create_map(*[F.lit(x) for pair in files.MAGIC.items() for x in pair]), F.lower(ext))
    content = F.when(F.col("page_id") % 2 == 0, F.unhex(F.concat(F.coalesce(mark, F.lit("")), F.hex(F.encode("html", "utf-8"))))).otherwise(F.encode("html", "utf-8"))
    return pages.select("page_id", files.magic_fits(content, ext).alias("fits"))


@query("word_lines", "SELECT page, CAST(row_number() OVER (PARTITION BY page ORDER BY l) - 1 AS BIGINT) AS ord, md5(string_agg(t, ' ' ORDER BY x, t)) AS h FROM (SELECT l_suppkey AS page, l_linenumber AS l, CAST(l_orderkey AS DOUBLE) AS x, 'w' || l_partkey AS t FROM lineitem) GROUP BY page, l")
def word_lines(spark, d):
    words = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("page"), F.col("l_orderkey").cast("double").alias("x"), (F.col("l_linenumber") * 10.0 + F.col("l_orderkey") % 2).alias("y"), F.concat(F.lit("w"), F.col("l_partkey")).alias("text"))
    return layout.lines(words).select("page", "ord", F.md5("text").alias("h"))


@query("json_replies", "SELECT doc_id, CASE WHEN doc_id % 3 <> 2 THEN quality END AS score FROM labels")
def json_replies(spark, d):
    inner = F.concat(F.lit('{"score": '), F.col("quality"), F.lit(', "why": "x"}'))
    raw = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("<think>hm {</think>Here:\n```json\n"), inner, F.lit("\n```"))).when(F.col("doc_id") % 3 == 1, inner).otherwise(F.lit("no json"))
    return table(spark, d, "labels").select("doc_id", T.json_reply(raw, "score int, why string")["score"].alias("score"))


@query("batch_judge", "SELECT doc_id, f, r, round((f * 0.35::DOUBLE + r * 0.25::DOUBLE) / (0.35::DOUBLE + 0.25::DOUBLE), 4) AS overall FROM (SELECT doc_id, (length(text) % 11) / 10.0::DOUBLE AS f, (doc_id % 7) / 6.0::DOUBLE AS r FROM documents)")
def batch_judge(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.col("doc_id").cast("string").alias("question"), F.col("text").alias("answer"), F.lit("").alias("context"))
    judges = {"faithfulness": lambda q, a, c: F.length(a) % 11 / 10.0, "answer_relevance": lambda q, a, c: q.cast("bigint") % 7 / 6.0}
    return evaluate.judged(rows, judges).select("doc_id", F.col("faithfulness").alias("f"), F.col("answer_relevance").alias("r"), "overall")


def _intent_sql() -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(text, '{p}') THEN '{n}'" for n, p in routing.INTENT_WORDS.items()) + " ELSE 'general' END"


@query("intent_words", f"SELECT conv_id, turn, {_intent_sql()} AS intent FROM conversations WHERE text IS NOT NULL")
def intent_words(spark, d):
    return table(spark, d, "conversations").where("text IS NOT NULL").select("conv_id", "turn", routing.intent_of(F.col("text")).alias("intent"))


def _language_sql() -> str:
    hits = ", ".join("len(list_filter(w, lambda x: x IN ({}))) AS {}".format(", ".join(f"'{x}'" for x in words.split()), name) for name, words in T.LANGUAGE_WORDS.items())
    names = list(T.LANGUAGE_WORDS)
    case = " ".join(f"WHEN {n} = greatest({', '.join(names)}) THEN '{n}'" for n in names)
    return f"WITH s AS (SELECT doc_id, length(text) AS n, string_split_regex(lower(substring(text, 1, 300)), '[^\\p{{L}}]+') AS w FROM documents), h AS (SELECT doc_id, n, {hits} FROM s) SELECT doc_id, CASE WHEN n < 30 OR greatest({', '.join(names)}) = 0 THEN '' {case} END AS language FROM h"


@query("language_guess", _language_sql())
def language_guess(spark, d):
    return table(spark, d, "documents").select("doc_id", T.language_of(F.col("text")).alias("language"))


@query("user_aggregate", "SELECT o_orderpriority, round(max(o_totalprice) - min(o_totalprice), 2) AS spread FROM orders GROUP BY o_orderpriority")
def user_aggregate(spark, d):
    """A user's aggregate in SQL."""
    functions.aggregate(spark, "spread_of", lambda v: float(v.max() - v.min()), "double")
    return spark.sql("SELECT o_orderpriority, round(spread_of(o_totalprice), 2) AS spread FROM {orders} GROUP BY o_orderpriority", orders=table(spark, d, "orders"))


class _Words:
    def eval(self, text: str):
        for i, w in enumerate(text.split(" ")):
            yield i, w


@query("user_table_function", "SELECT p_partkey, CAST(i - 1 AS INTEGER) AS place, w[i] AS word FROM (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part), unnest(range(1, len(w) + 1)) t(i)")
def user_table_function(spark, d):
    """A user's table function in SQL."""
    functions.table(spark, "words_of", _Words, "place int, word string")
    return spark.sql("SELECT p_partkey, place, word FROM {part}, LATERAL words_of(p_name)", part=table(spark, d, "part").select("p_partkey", "p_name"))


@query("distinct_sources", "SELECT DISTINCT source FROM documents")
def distinct_sources(spark, d):
    return table(spark, d, "documents").select("source").distinct()
