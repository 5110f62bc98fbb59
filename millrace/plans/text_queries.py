"""Cleaning and chunking queries over documents and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import chunking, cleaning
from millrace.plans.registry import query, table
from millrace.sources import files

#: The same blanks for DuckDB's trim.
_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(28) || chr(29) || chr(30) || chr(31) || chr(133) || chr(160) || chr(8232) || chr(8233) || chr(12288)"


def _trim(x: str) -> str:
    return f"trim({x}, {_WS})"


def _chain(x: str, rules: list[tuple[str, str, str]]) -> str:
    for pattern, to, flags in rules:
        x = f"regexp_replace({x}, '{pattern}', {to}, '{flags}')"
    return x


_NL2 = "chr(10) || chr(10)"
_MD = [
    (r"\|[^\n]+\|", "' '", "g"), (r"(?m)^#+\s+", "''", "g"), (r"\*{1,3}([^*]+)\*{1,3}", r"'\1'", "g"), (r"`{1,3}[^`]*`{1,3}", "' '", "g"),
    (r"(?m)^---+\s*$", "''", "g"), (r"\[([^\]]+)\]\([^)]+\)", r"'\1'", "g"), (r"[ \t]{2,}", "' '", "g"), (r"\n{3,}", _NL2, "g"),
]
_CHUNK = [
    (r"[\x{a0}\x{feff}\x{200b}\x{200c}\x{200d}\x{ad}\x{2028}\x{2029}\x{b7}\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "' '", "g"), (r"(?m)^#{1,6}\s+", "''", "g"), (r"\*{1,3}(.+?)\*{1,3}", r"'\1'", "g"), (r"\[([^\]]*)\]\([^)]*\)", r"'\1'", "g"),
    (r"(?m)^[-*_]{3,}\s*$", "''", "g"), (r"(?m)^>\s+", "''", "g"), (r"[-=.|]{4,}", "''", "g"), (r"[ \t]{2,}", "' '", "g"), (r"\n{3,}", _NL2, "g"),
]
_HTML = [(r"(?is)<style[^>]*>.*?</style>", "''", "g"), (r"(?is)<script[^>]*>.*?</script>", "''", "g"), (r"<[^>]+>", "' '", "g"), (r"[ \t]+", "' '", "g"), (r"\n{3,}", _NL2, "g")]


def _docs(spark, d):
    return table(spark, d, "documents").select("doc_id", "text", "lang", "source")


@query("md_strip", f"SELECT doc_id, md5({_trim(_chain('text', _MD))}) AS h FROM documents")
def md_strip(spark, d):
    return _docs(spark, d).select("doc_id", F.md5(T.for_embedding(F.col("text"))).alias("h"))


@query("chunk_clean", f"SELECT doc_id, md5({_trim(_chain('text', _CHUNK))}) AS h FROM documents")
def chunk_clean(spark, d):
    return _docs(spark, d).select("doc_id", F.md5(T.clean_chunk(F.col("text"))).alias("h"))


@query("html_to_text", f"SELECT page_id, md5({_trim(_chain('html', _HTML))}) AS h FROM pages")
def html_to_text(spark, d):
    return table(spark, d, "pages").select("page_id", F.md5(T.html_to_text(F.col("html"))).alias("h"))


@query("html_tables", "SELECT page_id, CAST(coalesce(len(list_filter(regexp_extract_all(html, '(?is)<table.*?</table>'), lambda x: regexp_matches(x, '(?i)<t[dh]'))), 0) AS BIGINT) AS n FROM pages")
def html_tables(spark, d):
    return table(spark, d, "pages").select("page_id", F.size(files.html_tables("html")).cast("bigint").alias("n"))


_LINES = f"ln AS (SELECT doc_id, CAST(i - 1 AS BIGINT) AS ord, CAST((i - 1) // 40 AS BIGINT) AS page, l[i] AS text FROM (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: {_trim('x')}), lambda x: x <> '') AS l FROM documents), unnest(range(1, len(l) + 1)) AS t(i))"


def _blocks(spark, d):
    """Lines of documents as blocks; forty make a page."""
    return cleaning.paragraphs(_docs(spark, d), separator="\n").withColumn("page", F.floor(F.col("ord") / 40).cast("bigint")).select("doc_id", "ord", "page", "text")


_NOISE = r"""(text = '' OR length(text) < 15 OR regexp_matches(text, '^\s*\d{1,4}\s*$') OR regexp_matches(text, '^[\d\s.,;:!?\-—–()\[\]{}/\\|''"«»…†§%°#@&*+=~^`]+$'))"""


@query("paragraph_blocks", f"WITH {_LINES} SELECT doc_id, ord, text FROM ln")
def paragraph_blocks(spark, d):
    return _blocks(spark, d).select("doc_id", "ord", "text")


@query("noise_filter", f"WITH {_LINES} SELECT doc_id, ord FROM ln WHERE NOT {_NOISE}")
def noise_filter(spark, d):
    return cleaning.without_noise(_blocks(spark, d)).select("doc_id", "ord")


@query("header_footer", f"WITH {_LINES}, k AS (SELECT *, lower(text) AS k, count(*) OVER (PARTITION BY doc_id, lower(text)) AS n FROM ln) SELECT doc_id, ord FROM k WHERE NOT (length(k) < 80 AND n >= 3)")
def header_footer(spark, d):
    return cleaning.without_running_heads(_blocks(spark, d)).select("doc_id", "ord")


@query("exact_dedup", f"WITH {_LINES}, k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(text) ORDER BY ord) AS n FROM ln) SELECT doc_id, ord FROM k WHERE n = 1")
def exact_dedup(spark, d):
    return cleaning.distinct(_blocks(spark, d)).select("doc_id", "ord")


def _rejoin(src: str) -> str:
    """Islands i of blocks of `src` that are one: f, with the part p of each block."""
    return f"""a AS (SELECT *, lag(text) OVER w AS b, lag(page) OVER w AS bp FROM {src} WINDOW w AS (PARTITION BY doc_id ORDER BY ord)),
c AS (SELECT *, coalesce(regexp_matches(b, '-\\s*$'), false) AS glue, coalesce(bp = page AND (regexp_matches(b, '-\\s*$') OR (regexp_matches(b, '[a-zA-ZÀ-ÿ0-9]$') AND regexp_matches(text, '^[a-zàâéèêëîïôùûüÿœæç]'))), false) AS jn FROM a),
e AS (SELECT *, sum(CASE WHEN jn THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY ord) AS i, coalesce(lead(glue) OVER w AND lead(jn) OVER w, false) AS cut FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY ord)),
f AS (SELECT doc_id, i, ord, page, CASE WHEN jn AND NOT glue THEN ' ' ELSE '' END || CASE WHEN cut THEN regexp_replace(text, '-\\s*$', '') ELSE text END AS p FROM e)"""


@query("rejoin_fragments", f"WITH {_LINES}, {_rejoin('ln')} SELECT doc_id, min(ord) AS ord, md5(string_agg(p, '' ORDER BY ord)) AS h FROM f GROUP BY doc_id, i")
def rejoin_fragments(spark, d):
    return cleaning.rejoined(_blocks(spark, d)).select("doc_id", "ord", F.md5("text").alias("h"))


_TIDY = _trim(r"regexp_replace(regexp_replace({}, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g'), '[ \t]{{2,}}', ' ', 'g')")


@query(
    "clean_pipeline",
    f"""WITH {_LINES}, t1 AS (SELECT doc_id, ord, page, {_TIDY.format('text')} AS text FROM ln), t2 AS (SELECT *, lower(text) AS k, count(*) OVER (PARTITION BY doc_id, lower(text)) AS n FROM t1 WHERE NOT {_NOISE}),
t3 AS (SELECT *, row_number() OVER (PARTITION BY doc_id, k ORDER BY ord) AS f FROM t2 WHERE NOT (length(k) < 80 AND n >= 3)), t4 AS (SELECT doc_id, ord, page, text FROM t3 WHERE f = 1), {_rejoin('t4')},
g AS (SELECT doc_id, min(ord) AS ord, min(page) AS page, {_TIDY.format("string_agg(p, '' ORDER BY ord)")} AS text FROM f GROUP BY doc_id, i) SELECT doc_id, ord, page, md5(text) AS h FROM g WHERE NOT {_NOISE}""",
)
def clean_pipeline(spark, d):
    return cleaning.clean(_blocks(spark, d)).select("doc_id", "ord", "page", F.md5("text").alias("h"))


@query("near_duplicate_blocks")
def near_duplicate_blocks(spark, d):
    return cleaning.without_near_copies(_blocks(spark, d)).select("doc_id", "ord")


_HEAD = "CASE WHEN ord % 7 = 0 THEN text END"


@query("heading_carry", f"WITH {_LINES} SELECT doc_id, ord, last_value({_HEAD} IGNORE NULLS) OVER (PARTITION BY doc_id, page ORDER BY ord ROWS UNBOUNDED PRECEDING) AS section FROM ln")
def heading_carry(spark, d):
    marked = _blocks(spark, d).withColumn("heading", F.when(F.col("ord") % 7 == 0, F.col("text")))
    return cleaning.carry_headings(marked, key=["doc_id", "page"]).select("doc_id", "ord", "section")


@query("garbage_tokens", r"WITH w AS (SELECT doc_id, unnest(string_split_regex(text, '[\x20\x09-\x0d]+')) AS t FROM documents) SELECT doc_id, count(*) AS n FROM (SELECT doc_id, length(regexp_replace(t, '[^\p{L}]', '', 'g')) AS l, length(regexp_replace(t, '[^aeiouAEIOU]', '', 'g')) AS v, length(t) AS c FROM w) WHERE c >= 16 AND l >= 10 AND v::DOUBLE / l < 0.18::DOUBLE GROUP BY doc_id")
def garbage_tokens(spark, d):
    words = _docs(spark, d).select("doc_id", F.explode(F.split("text", r"[\x20\x09-\x0d]+")).alias("t"))
    return words.where(T.is_garbage(F.col("t"))).groupBy("doc_id").agg(F.count("*").alias("n"))


@query("scanned_flag", "SELECT doc_id, length(text)::DOUBLE / (1 + doc_id % 9) < 50 AS scanned FROM documents")
def scanned_flag(spark, d):
    return _docs(spark, d).select("doc_id", T.is_scanned(F.col("text"), 1 + F.col("doc_id") % 9).alias("scanned"))


@query("text_kind", r"""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents), r AS (SELECT doc_id, len(list_filter(x, lambda y: regexp_matches(y, '^\s*[*\-•]\s+')))::DOUBLE / len(x) AS b,
len(list_filter(x, lambda y: regexp_matches(y, '^\s*#{1,6}\s+') OR regexp_matches(y, '^\d+[).]\s+[A-Z]') OR regexp_matches(rtrim(y), '^[A-Z][A-Z\s\-]{3,}$') OR regexp_matches(trim(y), '^(_{3,}|={3,}|-{3,})$')))::DOUBLE / len(x) AS h FROM l)
SELECT doc_id, CASE WHEN b > 0.2::DOUBLE OR h > 0.05::DOUBLE THEN 'structured' WHEN b > 0.05::DOUBLE OR h > 0.02::DOUBLE THEN 'mixed' ELSE 'narrative' END AS kind FROM r""")
def text_kind(spark, d):
    return _docs(spark, d).select("doc_id", chunking.text_kind(F.col("text")).alias("kind"))


@query("chunk_strategy", f"""WITH {_LINES}, s AS (SELECT doc_id, count(*) AS n, count(*) FILTER (regexp_matches(text, '^#{{1,6}}\\s+\\S') OR (regexp_matches(text, '^[A-Z][A-Z\\s\\-]{{3,}}$') AND length(text) <= 80)) AS h, count(*) FILTER (regexp_matches(text, '^#{{1,6}}\\s+\\S')) AS m, count(*) FILTER (suffix(text, '?') OR regexp_matches(text, '(?i)^Q[.:\\s]')) AS q, sum(greatest(1, length(text) // 4)) AS t FROM ln GROUP BY doc_id)
SELECT doc_id, CASE WHEN t < 150 THEN 'contextual' WHEN q::DOUBLE / n > 0.15::DOUBLE THEN 'contextual' WHEN m >= 2 OR h::DOUBLE / n > 0.2::DOUBLE THEN 'hierarchical' WHEN t::DOUBLE / n > 60 AND h::DOUBLE / n < 0.08::DOUBLE THEN 'contextual' WHEN h::DOUBLE / n > 0.12::DOUBLE THEN 'hierarchical' ELSE 'contextual' END AS strategy FROM s""")
def chunk_strategy(spark, d):
    return chunking.strategy(chunking.structure(_blocks(spark, d))).select("doc_id", "strategy")


_TOK = "greatest(1, {} // 4)"
_ABBREVIATIONS = ", ".join(f"'{w}'" for w in chunking.ABBREVIATIONS)
_BOOK = "array_to_string(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x, i: CASE WHEN i % 5 = 3 THEN repeat('#', 1 + i % 3) || ' ' || substring(x, 1, 20) || chr(10) || chr(10) || x ELSE x END), chr(10) || chr(10))"


def _books(spark, d):
    """Documents with their lines as paragraphs, every fifth one under a heading of its first letters."""
    with_heads = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x, i: F.when((i + 1) % 5 == 3, F.concat(F.repeat(F.lit("#"), 1 + (i + 1) % 3), F.lit(" "), F.substring(x, 1, 20), F.lit("\n\n"), x)).otherwise(x))
    return _docs(spark, d).select("doc_id", F.array_join(with_heads, "\n\n").alias("text"))


#: Paragraphs n of each document: p, its heading level (null for body text) and title.
_PARAGRAPHS = rf"""pl AS (SELECT doc_id, list_filter(list_transform(string_split_regex({_BOOK}, '\n{{2,}}'), lambda x: {_trim('x')}), lambda x: x <> '') AS l FROM documents),
pn AS (SELECT doc_id, CAST(n AS BIGINT) AS n, l[n] AS p FROM pl, unnest(range(1, len(l) + 1)) AS t(n)),
pg AS (SELECT doc_id, n, p, CASE WHEN regexp_matches(p, '^#{{1,6}}\s+\S') AND NOT contains(p, chr(10)) THEN length(regexp_extract(p, '^#+')) WHEN regexp_matches(p, '^[A-Z][A-Z\s\-]{{3,}}$') AND length(p) <= 80 THEN 1 END AS level, regexp_replace(p, '^#+\s+', '') AS title FROM pn)"""
#: Sentences k of the texts of `src` (doc_id, r, i, t): a piece ends after end signs and blanks, unless an abbreviation stands there.
_SENTENCES = rf"""pc AS (SELECT doc_id, r, i, CAST(k AS BIGINT) AS k, x[k] AS piece, len(x) AS many FROM (SELECT doc_id, r, i, string_split(regexp_replace(t, '([.!?]+["'')\]]*\s+)', '\1' || chr(57344), 'g'), chr(57344)) AS x FROM src), unnest(range(1, len(x) + 1)) AS t(k)),
pb AS (SELECT *, coalesce(sum(CASE WHEN lower(regexp_extract({_trim('piece')}, '([\p{{L}}\p{{N}}_.]+)\.$', 1)) IN ({_ABBREVIATIONS}) THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, r, i ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM pc),
se AS (SELECT doc_id, r, i, b, {_trim("string_agg(piece, '' ORDER BY k)")} AS t FROM pb GROUP BY doc_id, r, i, b)"""


def _packed(joiner: str) -> str:
    """Parts u (doc_id, r, t, m: place in r) together up to 300 tokens: pk."""
    return f"""pr AS (SELECT doc_id, r, m, {_TOK.format('length(t)')} AS c FROM u), pf AS (SELECT doc_id, r, m, c AS size, CAST(1 AS BIGINT) AS chunk FROM pr WHERE m = 1
UNION ALL SELECT pr.doc_id, pr.r, pr.m, CASE WHEN size + c > 300 THEN c ELSE size + c END, CASE WHEN size + c > 300 THEN chunk + 1 ELSE chunk END FROM pf JOIN pr ON pr.doc_id = pf.doc_id AND pr.r = pf.r AND pr.m = pf.m + 1),
pk AS (SELECT doc_id, r, chunk, string_agg(t, {joiner} ORDER BY m) AS t FROM pf JOIN u USING (doc_id, r, m) GROUP BY doc_id, r, chunk)"""


@query(
    "contextual_chunks",
    f"""WITH RECURSIVE {_PARAGRAPHS}, sx AS (SELECT doc_id, n, p, level, last_value(CASE WHEN level IS NOT NULL THEN title END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS section FROM pg),
bo AS (SELECT doc_id, section, p, length(p) AS len, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS j FROM sx WHERE level IS NULL),
f AS (SELECT doc_id, j, section, len, CAST(1 AS BIGINT) AS r FROM bo WHERE j = 1 UNION ALL SELECT doc_id, j, section, CASE WHEN same THEN held + 1 + len ELSE len END, CASE WHEN same THEN r ELSE r + 1 END
FROM (SELECT bo.doc_id, bo.j, bo.section, bo.len, f.len AS held, f.r, f.section IS NOT DISTINCT FROM bo.section AND least({_TOK.format('f.len')}, {_TOK.format('bo.len')}) < 30 AND {_TOK.format('f.len')} + {_TOK.format('bo.len')} <= 300 AS same FROM f JOIN bo ON bo.doc_id = f.doc_id AND bo.j = f.j + 1)),
h AS (SELECT doc_id, r, any_value(f.section) AS section, string_agg(p, chr(10) ORDER BY j) AS t FROM f JOIN bo USING (doc_id, j) GROUP BY doc_id, r),
src AS (SELECT doc_id, r, 0 AS i, t FROM h WHERE {_TOK.format('length(t)')} > 300), {_SENTENCES}, u AS (SELECT doc_id, r, t, row_number() OVER (PARTITION BY doc_id, r ORDER BY b) AS m FROM se WHERE t <> ''), {_packed("' '")},
al AS (SELECT doc_id, r, 0 AS chunk, section, t FROM h WHERE {_TOK.format('length(t)')} <= 300 UNION ALL SELECT doc_id, r, chunk, section, pk.t FROM pk JOIN h USING (doc_id, r))
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY r, chunk) - 1 AS ord, section, md5(CASE WHEN section <> '' THEN '[' || section || '] ' ELSE '' END || t) AS h FROM al""",
)
def contextual_chunks(spark, d):
    return chunking.fold(chunking.as_blocks(_books(spark, d)), chunking.contextual).select("doc_id", "ord", "section", F.md5("content").alias("h"))


_LEVELS = range(1, 7)
_HEADS = ", ".join(f"last_value(CASE WHEN level = {k} THEN {{'at': n, 'title': title}} END IGNORE NULLS) OVER w AS h{k}" for k in _LEVELS)
#: A level's last heading is open unless one of a higher rank came after it.
_OPEN = ", ".join(f"CASE WHEN h{k}.at > greatest(0, {', '.join(f'coalesce(h{x}.at, 0)' for x in range(1, k)) or 0}) THEN h{k}.title END AS t{k}" for k in _LEVELS)


@query(
    "hierarchical_chunks",
    f"""WITH RECURSIVE {_PARAGRAPHS}, hs AS (SELECT doc_id, n, p, level, count(level) OVER w AS r, {_HEADS} FROM pg WINDOW w AS (PARTITION BY doc_id ORDER BY n ROWS UNBOUNDED PRECEDING)),
op AS (SELECT doc_id, n, p, level, r, {_OPEN} FROM hs), bo AS (SELECT doc_id, r, n AS i, p, concat_ws(' > ', t1, t2, t3, t4, t5, t6) AS path, coalesce(t6, t5, t4, t3, t2, t1) AS section FROM op WHERE level IS NULL),
src AS (SELECT doc_id, r, i, p AS t FROM bo WHERE {_TOK.format('length(p)')} > 300), {_SENTENCES},
u AS (SELECT doc_id, r, t, row_number() OVER (PARTITION BY doc_id, r ORDER BY i, b) AS m FROM (SELECT doc_id, r, i, 0 AS b, p AS t FROM bo WHERE {_TOK.format('length(p)')} <= 300 UNION ALL SELECT doc_id, r, i, b, t FROM se WHERE t <> '')), {_packed("chr(10)")},
nm AS (SELECT DISTINCT doc_id, r, path, section FROM bo)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY r, chunk) - 1 AS ord, section, md5(CASE WHEN path <> '' THEN '[' || path || '] ' ELSE '' END || t) AS h FROM pk JOIN nm USING (doc_id, r)""",
)
def hierarchical_chunks(spark, d):
    return chunking.fold(chunking.as_blocks(_books(spark, d)), chunking.hierarchical).select("doc_id", "ord", "section", F.md5("content").alias("h"))


@query("chunk_finalise", f"WITH c AS (SELECT source, doc_id, {_trim(_chain('text', _CHUNK))} AS content FROM documents), f AS (SELECT * FROM c WHERE content <> '') SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS chunk_index, count(*) OVER (PARTITION BY source) AS chunk_total, CAST(greatest(1, length(content) // 4) AS BIGINT) AS token_count FROM f")
def chunk_finalise(spark, d):
    chunks = _docs(spark, d).withColumn("content", F.col("text")).withColumn("page", F.lit(0))
    return chunking.finalise(chunks, order=["doc_id"]).select("source", "doc_id", "chunk_index", "chunk_total", "token_count")


@query("valley_boundaries", "WITH s AS (SELECT lang, doc_id AS ord, (doc_id * 7919 % 101) / 100.0::DOUBLE AS sim FROM documents), v AS (SELECT lang, ord, sim, lag(sim) OVER w AS a, lead(sim) OVER w AS b, avg(sim) OVER (PARTITION BY lang) AS m, stddev_pop(sim) OVER (PARTITION BY lang) AS sd FROM s WINDOW w AS (PARTITION BY lang ORDER BY ord)) SELECT lang, ord + 1 AS boundary FROM v WHERE sim < a AND sim < b AND sim < m - 0.5::DOUBLE * sd")
def valley_boundaries(spark, d):
    sims = _docs(spark, d).select("lang", F.col("doc_id").alias("ord"), (F.col("doc_id") * 7919 % 101 / 100.0).alias("sim"))
    return chunking.valleys(sims, "lang")


_REPLY = "CASE turn % 3 WHEN 0 THEN 'I don''t have enough information. ' || text WHEN 1 THEN text || ' It is not discussed in the report' ELSE text END"


@query("no_answer_flag", f"SELECT conv_id, turn, regexp_matches({_REPLY}, '{T.NO_ANSWER.replace(chr(39), chr(39) * 2)}') AS flag FROM conversations")
def no_answer_flag(spark, d):
    kind = F.col("turn") % 3
    reply = F.when(kind == 0, F.concat(F.lit("I don't have enough information. "), F.col("text"))).when(kind == 1, F.concat(F.col("text"), F.lit(" It is not discussed in the report"))).otherwise(F.col("text"))
    return table(spark, d, "conversations").select("conv_id", "turn", T.no_answer(reply).alias("flag"))


@query("fast_escalation", "SELECT conv_id, turn, regexp_matches(text, '(?i)\\b(escalat(e|ing|ion)|transfer\\s+me|live\\s+(chat|agent|support)|real\\s+person|(speak|talk)\\s+to\\s+(a\\s+)?(human|agent|person|manager|representative|rep|supervisor)|connect\\s+me\\s+(with|to)\\s+(a\\s+)?(human|agent|person|manager|representative))\\b') AS flag FROM conversations")
def fast_escalation(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", T.wants_person(F.col("text")).alias("flag"))


@query("question_normalise", f"SELECT conv_id, turn, {_trim(_chain('text', [(chr(92) + 's+', chr(39) + ' ' + chr(39), 'g')]))} AS q FROM conversations WHERE role = 'user' AND text <> ''")
def question_normalise(spark, d):
    turns = table(spark, d, "conversations").where("role = 'user' AND text <> ''")
    prompt = F.concat(F.lit("[USER FACTS]\nname: x\n[/USER FACTS]\nQuestion: "), F.col("text"))
    return turns.select("conv_id", "turn", T.question_of(prompt).alias("q"))


@query("table_prose", "SELECT p_brand, string_agg('Key: ' || p_partkey || ', Name: ' || p_name || CASE WHEN p_size % 2 = 0 THEN ', Size: ' || p_size ELSE '' END, chr(10) ORDER BY p_partkey) AS content FROM part GROUP BY p_brand")
def table_prose(spark, d):
    size = F.when(F.col("p_size") % 2 == 0, F.col("p_size").cast("string")).otherwise(" ")
    rows = F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "p_name", size.alias("size")))), lambda x: F.array(x["p_partkey"].cast("string"), x["p_name"], x["size"]))
    tables = table(spark, d, "part").groupBy("p_brand").agg(F.concat(F.array(F.array(F.lit("Key"), F.lit("Name"), F.lit("Size"))), rows).alias("r"))
    return tables.select("p_brand", T.prose_rows(F.col("r")).alias("content"))
