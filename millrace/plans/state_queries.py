"""Conversation state, sessions, evaluation, feedback and routing queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import routing
from millrace.operators import evaluate, memory
from millrace.plans.registry import query, table
from millrace.streaming import sessions as streams

_TURNS = "t AS (SELECT conv_id, turn, role, text, CAST(greatest(1, length(text) // 4) AS BIGINT) AS token_count FROM conversations WHERE role IN ('user', 'assistant'))"


def _turns(spark, d):
    return memory.counted(memory.valid_turns(table(spark, d, "conversations")))


_TRIM = f"WITH {_TURNS}, w AS (SELECT conv_id, turn, row_number() OVER o AS rn, coalesce(sum(token_count) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS newer FROM t WINDOW o AS (PARTITION BY conv_id ORDER BY turn DESC)) SELECT conv_id, turn FROM w WHERE"


@query("buffer_trim", f"{_TRIM} rn <= 2 OR newer < 300")
def buffer_trim(spark, d):
    return memory.trim(_turns(spark, d), 300).where("kept").select("conv_id", "turn")


@query("evictable_turns", f"{_TRIM} NOT (rn <= 2 OR newer < 300)")
def evictable_turns(spark, d):
    return memory.trim(_turns(spark, d), 300).where("not kept").select("conv_id", "turn")


@query("session_rollup", f"WITH {_TURNS} SELECT conv_id, count(*) AS turn_count, CAST(sum(token_count) AS BIGINT) AS total_tokens, min(turn) AS oldest, max(turn) AS newest FROM t GROUP BY conv_id")
def session_rollup(spark, d):
    return memory.roll_up(_turns(spark, d))


@query("needs_summary", f"WITH {_TURNS} SELECT conv_id, CAST(sum(token_count) AS BIGINT) AS pending FROM t GROUP BY conv_id HAVING sum(token_count) >= 1200")
def needs_summary(spark, d):
    return memory.to_summarise(_turns(spark, d))


@query("absorb_oldest", f"WITH {_TURNS} SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) <= 2 AS summary_absorbed FROM t")
def absorb_oldest(spark, d):
    return memory.absorb(_turns(spark, d), 2).select("conv_id", "turn", "summary_absorbed")


@query("last_turns", f"WITH {_TURNS} SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM t WHERE role = 'user') WHERE n <= 10")
def last_turns(spark, d):
    return memory.last(_turns(spark, d).where("role = 'user'"), 10).select("conv_id", "turn")


_SIGNALS = "(?i)\\b(it|its|they|them|their|this|that|these|those|the same|same|above|previous|prior|earlier|last|next|another|other|such|he|she|him|her|explain|elaborate|expand|continue|more|further|again)\\b"


@query("rewrite_skip", f"WITH {_TURNS}, w AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM t) SELECT conv_id, turn FROM w WHERE role = 'user' AND (n = 1 OR (len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) >= 8 AND NOT regexp_matches(text, '{_SIGNALS}')))")
def rewrite_skip(spark, d):
    return memory.rewrite_tier(_turns(spark, d)).where("tier = 'skip'").select("conv_id", "turn")


@query("rewrite_tier")
def rewrite_tier(spark, d):
    return memory.rewrite_tier(_turns(spark, d)).select("conv_id", "turn", "tier")


@query("conversation_owner", "SELECT conv_id, turn FROM conversations WHERE conv_id % 3 = 1")
def conversation_owner(spark, d):
    turns = table(spark, d, "conversations").withColumn("session_id", F.col("conv_id"))
    owners = turns.select("session_id").distinct().withColumn("user_id", (F.col("session_id") % 3).cast("string"))
    return memory.owned(turns, owners, "1").select("conv_id", "turn")


_NOW = "(SELECT max(ts) FROM events)"


@query("session_ttl_expired", f"SELECT user_id, max(ts) < {_NOW} - INTERVAL 7200 SECOND AS expired FROM events GROUP BY user_id")
def session_ttl_expired(spark, d):
    events = table(spark, d, "events")
    now = events.agg(F.max("ts").alias("now"))
    last = events.groupBy("user_id").agg(F.max("ts").alias("ts")).crossJoin(now)  # one row
    return memory.expired(last, F.max("now").cast("timestamp")).select("user_id", "expired")


_GAPS = "WITH g AS (SELECT user_id, event_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) > 7200000000 THEN 1 ELSE 0 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), n AS (SELECT *, CAST(sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session_no FROM g)"


@query("sessionize_2h", f"{_GAPS} SELECT user_id, event_id, session_no FROM n")
def sessionize_2h(spark, d):
    return memory.sessions(table(spark, d, "events")).select("user_id", "event_id", "session_no")


@query("session_window_2h", f"{_GAPS} SELECT user_id, count(*) AS n FROM n GROUP BY user_id, session_no")
def session_window_2h(spark, d):
    return streams.session_windows(table(spark, d, "events")).select("user_id", "n")


@query("hourly_counts", "SELECT epoch_us(date_trunc('hour', ts)) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def hourly_counts(spark, d):
    return streams.counts(table(spark, d, "events")).select(F.unix_micros("start").alias("start"), "event_type", "n")


_STATE = "CASE event_id % 4 WHEN 0 THEN 'done' WHEN 1 THEN 'failed' WHEN 2 THEN 'pending' ELSE 'processing' END"


@query("job_state", f"WITH j AS (SELECT event_id, {_STATE} AS s, (event_id * 37) % 7200 AS age FROM events) SELECT event_id, CASE WHEN s IN ('done', 'failed') AND age > 3600 THEN 'expired' WHEN s NOT IN ('done', 'failed') AND age > 1800 THEN 'failed' ELSE s END AS state FROM j")
def job_state(spark, d):
    return table(spark, d, "events").select("event_id", routing.job_state(F.expr(_STATE), F.col("event_id") * 37 % 7200).alias("state"))


_FB = "f AS (SELECT doc_id, CASE WHEN quality = 1 AND toxic = 0 THEN 1 WHEN quality = 0 THEN -1 ELSE 0 END AS rating, toxic = 1 AS escalated, (doc_id % 100) / 100.0::DOUBLE AS confidence, CASE WHEN doc_id % 3 = 0 THEN 'billing' ELSE 'how_to' END AS intent, CASE WHEN quality = 1 THEN 'pass' ELSE 'fail' END AS verdict FROM labels)"
_FB_SUM = "count(*) AS total, count(*) FILTER (rating = 1) AS helpful, count(*) FILTER (rating = -1) AS not_helpful, count(*) FILTER (escalated) AS escalated, round(avg(confidence), 4) AS avg_confidence, CASE WHEN count(*) FILTER (rating <> 0) > 0 THEN round(100.0::DOUBLE * count(*) FILTER (rating = 1) / count(*) FILTER (rating <> 0), 1) END AS satisfaction"


def _feedback(spark, d):
    return table(spark, d, "labels").select(
        F.expr("CASE WHEN quality = 1 AND toxic = 0 THEN 1 WHEN quality = 0 THEN -1 ELSE 0 END").alias("rating"), (F.col("toxic") == 1).alias("escalated"), (F.col("doc_id") % 100 / 100.0).alias("confidence"),
        F.when(F.col("doc_id") % 3 == 0, "billing").otherwise("how_to").alias("intent"), F.when(F.col("quality") == 1, "pass").otherwise("fail").alias("verdict"),
    )


@query("feedback_summary", f"WITH {_FB} SELECT 'all' AS scope, '' AS value, {_FB_SUM} FROM f UNION ALL SELECT 'intent', intent, {_FB_SUM} FROM f GROUP BY intent UNION ALL SELECT 'verdict', verdict, {_FB_SUM} FROM f GROUP BY verdict")
def feedback_summary(spark, d):
    return evaluate.feedback(_feedback(spark, d))


_S = "s AS (SELECT doc_id, CASE WHEN doc_id % 5 <> 0 THEN (doc_id % 11) / 10.0::DOUBLE END AS fa, (doc_id % 7) / 6.0::DOUBLE AS ar, CASE WHEN doc_id % 3 <> 0 THEN (doc_id % 13) / 12.0::DOUBLE END AS cr, quality::DOUBLE AS co FROM labels)"


def _scores(spark, d):
    return table(spark, d, "labels").select("doc_id", F.when(F.col("doc_id") % 5 != 0, F.col("doc_id") % 11 / 10.0).alias("fa"), (F.col("doc_id") % 7 / 6.0).alias("ar"), F.when(F.col("doc_id") % 3 != 0, F.col("doc_id") % 13 / 12.0).alias("cr"), F.col("quality").cast("double").alias("co"))


@query("judge_overall", f"WITH {_S} SELECT doc_id, round((coalesce(fa * 0.35::DOUBLE, 0) + coalesce(ar * 0.25::DOUBLE, 0) + coalesce(cr * 0.15::DOUBLE, 0) + coalesce(co * 0.15::DOUBLE, 0)) / (CASE WHEN fa IS NULL THEN 0 ELSE 0.35::DOUBLE END + 0.25::DOUBLE + CASE WHEN cr IS NULL THEN 0 ELSE 0.15::DOUBLE END + 0.15::DOUBLE), 4) AS overall FROM s")
def judge_overall(spark, d):
    s = _scores(spark, d)
    return s.select("doc_id", routing.judge_overall({"faithfulness": F.col("fa"), "answer_relevance": F.col("ar"), "context_relevance": F.col("cr"), "completeness": F.col("co")}).alias("overall"))


@query("verdict", f"WITH {_S} SELECT doc_id, CASE WHEN ar < 0.3::DOUBLE THEN 'off_topic' WHEN fa < 0.6::DOUBLE THEN 'fail' WHEN fa IS NULL AND cr < 0.5::DOUBLE THEN 'low_confidence' ELSE 'pass' END AS verdict FROM s")
def verdict(spark, d):
    return _scores(spark, d).select("doc_id", routing.answer_verdict(F.col("ar"), F.col("fa"), F.col("cr")).alias("verdict"))


@query("metric_verdict", f"WITH {_S} SELECT doc_id, CASE WHEN coalesce(fa, cr) IS NULL THEN 'unknown' WHEN coalesce(fa, cr) >= 0.4::DOUBLE THEN 'pass' WHEN coalesce(fa, cr) >= 0.25::DOUBLE THEN 'warn' ELSE 'fail' END AS verdict FROM s")
def metric_verdict(spark, d):
    return _scores(spark, d).select("doc_id", routing.metric_verdict(F.col("fa"), F.col("cr")).alias("verdict"))


@query("judge_route", f"WITH {_S} SELECT doc_id, coalesce(ar < 0.65::DOUBLE, false) OR coalesce(cr <= 0.72::DOUBLE, false) AS judge FROM s")
def judge_route(spark, d):
    return _scores(spark, d).select("doc_id", routing.runs_judge(F.col("ar"), F.col("cr")).alias("judge"))


@query("escalation", f"WITH {_S} SELECT doc_id, CASE WHEN doc_id % 17 = 0 THEN 'explicit_request' WHEN doc_id % 5 = 0 THEN 'complaint' WHEN doc_id % 7 = 0 THEN 'no_answer' WHEN fa IS NULL AND cr < 0.5::DOUBLE THEN 'low_confidence' WHEN ar < 0.3::DOUBLE OR fa < 0.6::DOUBLE THEN 'low_quality' END AS reason FROM s")
def escalation(spark, d):
    s = _scores(spark, d)
    v = routing.answer_verdict(F.col("ar"), F.col("fa"), F.col("cr"))
    return s.select("doc_id", routing.escalation(F.col("doc_id") % 17 == 0, F.when(F.col("doc_id") % 5 == 0, "complaint").otherwise("general"), F.col("doc_id") % 7 == 0, v).alias("reason"))


@query("eval_averages", f"WITH {_S} SELECT round(avg(fa), 4) AS fa, round(avg(ar), 4) AS ar, round(avg(cr), 4) AS cr FROM s")
def eval_averages(spark, d):
    return evaluate.averages(_scores(spark, d), ["fa", "ar", "cr"])


@query("ablation_delta", f"WITH {_S}, a AS (SELECT * FROM s WHERE doc_id % 2 = 0), x AS (SELECT unnest(['fa', 'ar', 'cr']) AS metric, unnest([(SELECT round(avg(fa), 4) FROM s), (SELECT round(avg(ar), 4) FROM s), (SELECT round(avg(cr), 4) FROM s)]) AS \"full\", unnest([(SELECT round(avg(fa), 4) FROM a), (SELECT round(avg(ar), 4) FROM a), (SELECT round(avg(cr), 4) FROM a)]) AS ablated) SELECT metric, \"full\", ablated, round(ablated - \"full\", 4) AS delta, CASE WHEN round(ablated - \"full\", 4) > 0.005::DOUBLE THEN 'up' WHEN round(ablated - \"full\", 4) < -0.005::DOUBLE THEN 'down' ELSE 'same' END AS arrow FROM x")
def ablation_delta(spark, d):
    s = _scores(spark, d)
    return evaluate.ablation(s, s.where("doc_id % 2 = 0"), ["fa", "ar", "cr"])


_PAIR = "p AS (SELECT item_id, b.text AS reference, d.text AS answer FROM benchmark b JOIN documents d ON d.doc_id = b.item_id * 7)"
_TOK = "regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}_]+')"


def _pairs(spark, d):
    b = table(spark, d, "benchmark").select("item_id", F.col("text").alias("reference"), (F.col("item_id") * 7).alias("doc_id"))
    return b.join(table(spark, d, "documents").select("doc_id", F.col("text").alias("answer")), "doc_id").drop("doc_id")


@query("coverage", f"WITH {_PAIR}, w AS (SELECT item_id, list_distinct({_TOK.format('reference')}) AS r, list_distinct({_TOK.format('answer')}) AS a FROM p) SELECT item_id, CASE WHEN len(r) > 0 THEN round(len(list_intersect(a, r))::DOUBLE / len(r), 4) ELSE 0.0::DOUBLE END AS coverage FROM w")
def coverage(spark, d):
    return _pairs(spark, d).select("item_id", evaluate.coverage(F.col("answer"), F.col("reference")).alias("coverage"))


def _rouge_sql(n: int) -> str:
    gram = lambda x: f"list_transform(range(1, len({x}) - {n} + 2), lambda i: array_to_string({x}[i:i + {n - 1}], ' '))"
    return f"""WITH {_PAIR}, w AS (SELECT item_id, {_TOK.format('answer')} AS a, {_TOK.format('reference')} AS r FROM p), g AS (SELECT item_id, {gram('a')} AS a, {gram('r')} AS r FROM w),
c AS (SELECT item_id, t, sum(x) AS x, sum(y) AS y FROM (SELECT item_id, unnest(a) AS t, 1 AS x, 0 AS y FROM g UNION ALL SELECT item_id, unnest(r), 0, 1 FROM g) GROUP BY ALL), m AS (SELECT item_id, sum(least(x, y))::DOUBLE AS m FROM c GROUP BY item_id),
s AS (SELECT item_id, CASE WHEN len(a) > 0 THEN coalesce(m, 0) / len(a) ELSE 0 END AS p, CASE WHEN len(r) > 0 THEN coalesce(m, 0) / len(r) ELSE 0 END AS r FROM g LEFT JOIN m USING (item_id))
SELECT item_id, round(p, 4) AS p, round(r, 4) AS r, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0::DOUBLE END, 4) AS f FROM s"""


@query("rouge1", _rouge_sql(1))
def rouge1(spark, d):
    return evaluate.rouge_n(_pairs(spark, d), 1, ["item_id"])


@query("rouge2", _rouge_sql(2))
def rouge2(spark, d):
    return evaluate.rouge_n(_pairs(spark, d), 2, ["item_id"])


@query("rouge1_stemmed")
def rouge1_stemmed(spark, d):
    """Over stems; SQL has none, so a test restates the metric."""
    return evaluate.rouge_n(_pairs(spark, d), 1, ["item_id"], stem=True)


@query("rouge_l")
def rouge_l(spark, d):
    return evaluate.rouge_l(_pairs(spark, d), ["item_id"])


def _bleu_sql(most: int = 4) -> str:
    """Clipped precisions of the first n, a missing match counting 0.1, their geometric mean, and the brevity penalty."""
    gram = lambda x, n: f"list_transform(range(1, len({x}) - {n} + 2), lambda i: array_to_string({x}[i:i + {n - 1}], ' '))"
    every = " UNION ALL ".join(f"SELECT item_id, {n} AS n, unnest({gram('a', n)}) AS g, 1 AS x, 0 AS y FROM w UNION ALL SELECT item_id, {n}, unnest({gram('r', n)}), 0, 1 FROM w" for n in range(1, most + 1))
    hits = ", ".join(f"coalesce(sum(least(x, y)) FILTER (n = {n}), 0)::DOUBLE AS m{n}" for n in range(1, most + 1))
    parts = ", ".join(f"CASE WHEN len(a) < {n} THEN 0 WHEN coalesce(m{n}, 0) = 0 THEN 0.1::DOUBLE / (len(a) - {n - 1}) ELSE m{n} / (len(a) - {n - 1}) END AS p{n}" for n in range(1, most + 1))
    means = ", ".join(f"round(CASE WHEN h = 0 OR {' OR '.join(f'p{k} <= 0' for k in range(1, n + 1))} THEN 0 ELSE pen * exp(({' + '.join(f'ln(p{k})' for k in range(1, n + 1))}) / {n}) END, 4) AS bleu_{n}" for n in range(1, most + 1))
    return f"""WITH {_PAIR}, w AS (SELECT item_id, {_TOK.format('answer')} AS a, {_TOK.format('reference')} AS r FROM p), c AS (SELECT item_id, n, g, sum(x) AS x, sum(y) AS y FROM ({every}) GROUP BY ALL),
m AS (SELECT item_id, {hits} FROM c GROUP BY item_id), s AS (SELECT item_id, coalesce(m1, 0) AS h, {parts}, CASE WHEN len(a) >= len(r) THEN 1.0::DOUBLE WHEN len(a) > 0 THEN exp(1 - len(r)::DOUBLE / len(a)) ELSE 0 END AS pen FROM w LEFT JOIN m USING (item_id))
SELECT item_id, {means} FROM s"""


@query("bleu", _bleu_sql())
def bleu(spark, d):
    return evaluate.bleu(_pairs(spark, d), ["item_id"])


@query("testset_sample", "SELECT doc_id, substring(text, 1, 1500) AS content FROM documents WHERE len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) >= 30 ORDER BY md5('0:' || doc_id) LIMIT 20")
def testset_sample(spark, d):
    return evaluate.testset(table(spark, d, "documents"), 20)
