"""Queries of the corpus operators, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: Query name -> module of this subpackage whose query() it is.
MODULES = {
    "op1_substring_dedup": "substring_dedup",
    "op2_quality_rules": "quality_rules",
    "op3_quality_classifier": "classifier",
    "op4_ngram_jaccard_join": "jaccard",
    "op5_exact_top_k": "vector_search",
    "op6_best_fit_packing": "packing",
    "op7_suffix_array_dedup": "suffix_array",
    "op8_token_files": "token_files",
    "op9_pii": "pii",
    "op10_byte_bpe": "byte_bpe",
    "op11_decontamination": "decontamination",
    "op12_tokenizer_alignment": "tokenizer_alignment",
    "op13_snapshot_difference": "snapshot_difference",
}

_WORDS = "w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents)"


def _covered(window: int) -> str:
    """Words with a flag: covered by a window that starts twice or more. Windows are compared as texts."""
    return f"""{_WORDS}, k AS (SELECT doc_id, unnest(range(1, len(ws) - {window - 2})) AS i, unnest(list_transform(range(1, len(ws) - {window - 2}), lambda i: array_to_string(ws[i:i + {window - 1}], ' '))) AS key FROM w WHERE len(ws) >= {window}),
n AS (SELECT doc_id, i, count(*) OVER (PARTITION BY key) AS c FROM k), r AS (SELECT doc_id, i FROM n WHERE c > 1), u AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS j, unnest(ws) AS word FROM w),
c AS (SELECT u.doc_id, j, word, coalesce(max(i) OVER (PARTITION BY u.doc_id ORDER BY j) > j - {window}, false) AS gone FROM u LEFT JOIN r ON r.doc_id = u.doc_id AND r.i = u.j)"""


ORACLE_SQL: dict[str, str] = {
    "op1_substring_dedup": f"WITH {_covered(35)}, g AS (SELECT doc_id, count(*) AS n, count(*) FILTER (gone) AS m, sha256(coalesce(string_agg(word, ' ' ORDER BY j) FILTER (NOT gone), '')) AS h FROM c GROUP BY doc_id) SELECT doc_id, coalesce(n, 0) AS n_words, coalesce(m, 0) AS n_removed, coalesce(h, sha256('')) AS kept_sha256 FROM documents LEFT JOIN g USING (doc_id)",
    "op4_ngram_jaccard_join": f"""WITH RECURSIVE {_WORDS.replace("coalesce(text, '')", "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")},
s AS (SELECT doc_id, CASE WHEN len(ws) >= 5 THEN list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS sh FROM w),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s), p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
l AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p), t(a, b) AS (SELECT a, b FROM l UNION SELECT t.a, l.b FROM t JOIN l ON t.b = l.a), m AS (SELECT a, min(b) AS b FROM t GROUP BY a)
SELECT doc_id, len(sh) AS n_shingles, coalesce(least(doc_id, b), doc_id) AS component_id FROM s LEFT JOIN m ON a = doc_id""",
    "op5_exact_top_k": """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings), p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM p) SELECT query_id, CAST(k AS INTEGER) AS rank, vec_id, score FROM r WHERE k <= 10""",
    "op7_suffix_array_dedup": f"WITH {_covered(50)}, g AS (SELECT doc_id, j, j - row_number() OVER (PARTITION BY doc_id ORDER BY j) AS island FROM c WHERE gone) SELECT doc_id, min(j) - 1 AS first_word, max(j) AS end_word, count(*) AS n_words FROM g GROUP BY doc_id, island",
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PLAIN_WORDS = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws"
ORACLE_SQL["op11_decontamination"] = f"""WITH dw AS (SELECT doc_id, {_PLAIN_WORDS} FROM documents), bw AS (SELECT item_id, {_PLAIN_WORDS} FROM benchmark),
bk AS (SELECT DISTINCT item_id, n, unnest(list_transform(range(1, len(ws) - n + 2), lambda i: array_to_string(ws[i:i + n - 1], ' '))) AS g FROM (SELECT item_id, ws, least(len(ws), 10) AS n FROM bw) WHERE n > 0),
dk AS (SELECT doc_id, n, unnest(range(1, len(ws) - n + 2)) AS i, unnest(list_transform(range(1, len(ws) - n + 2), lambda i: array_to_string(ws[i:i + n - 1], ' '))) AS g FROM dw, (SELECT DISTINCT n FROM bk) WHERE len(ws) >= n),
h AS (SELECT doc_id, i, n, g FROM dk SEMI JOIN bk USING (n, g)), m AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM h JOIN bk USING (n, g)) GROUP BY doc_id),
e AS (SELECT doc_id, i AS j, max(i + n) AS e FROM h GROUP BY doc_id, i), u AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS j FROM dw),
c AS (SELECT doc_id, count(*) FILTER (hit) AS n_hit FROM (SELECT doc_id, max(e) OVER (PARTITION BY doc_id ORDER BY j) > j AS hit FROM u LEFT JOIN e USING (doc_id, j)) GROUP BY doc_id)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM dw LEFT JOIN c USING (doc_id) LEFT JOIN m USING (doc_id)"""

_CRC_TABLE = "list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END))"
_CRC = "xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT))), lambda c, b: xor(c >> 8, t[CAST((xor(c, b) & 255) + 1 AS BIGINT)])), 4294967295)"
ORACLE_SQL["op13_snapshot_difference"] = f"""WITH k AS (SELECT doc_id, text, lang, source, coalesce({_CRC} % 25, 99) AS k FROM documents, (SELECT {_CRC_TABLE} AS t)),
n AS (SELECT CASE WHEN k IN (3, 4) THEN -1 - doc_id ELSE doc_id END AS doc_id, CASE WHEN k = 1 THEN coalesce(text, '') || '+' ELSE text END AS text, CASE WHEN k = 2 THEN source ELSE lang END AS lang, CASE WHEN k = 2 THEN lang WHEN k <> 4 THEN source END AS source FROM k WHERE k <> 0 UNION ALL SELECT -1 - doc_id, text, lang, source FROM k WHERE k = 5),
f AS (SELECT e.doc_id AS old_key, l.doc_id AS new_key, e.text AS et, l.text AS lt, e.lang AS el, l.lang AS ll, e.source AS es, l.source AS ls, e.here AS e, l.here AS l FROM (SELECT *, true AS here FROM documents) e FULL JOIN (SELECT *, true AS here FROM n) l ON e.doc_id IS NOT DISTINCT FROM l.doc_id),
a AS (SELECT *, row_number() OVER (PARTITION BY et, el ORDER BY old_key) AS r FROM f WHERE l IS NULL), b AS (SELECT *, row_number() OVER (PARTITION BY lt, ll ORDER BY new_key DESC) AS r FROM f WHERE e IS NULL),
g AS (SELECT old_key, new_key, et, lt, el, ll, es, ls, e, l, 'update' AS op FROM f WHERE e AND l UNION ALL SELECT a.old_key, b.new_key, a.et, b.lt, a.el, b.ll, a.es, b.ls, a.e, b.l, CASE WHEN a.e AND b.l THEN 'rekey' WHEN b.l THEN 'insert' ELSE 'delete' END FROM a FULL JOIN b ON a.et IS NOT DISTINCT FROM b.lt AND a.el IS NOT DISTINCT FROM b.ll AND a.r = b.r),
d AS (SELECT *, CASE WHEN op IN ('insert', 'delete') THEN '' ELSE concat_ws(',', CASE WHEN et IS DISTINCT FROM lt THEN 'text' END, CASE WHEN el IS DISTINCT FROM ll THEN 'lang' END, CASE WHEN es IS DISTINCT FROM ls THEN 'source' END) END AS changed FROM g)
SELECT CASE WHEN l THEN new_key ELSE old_key END AS "key", old_key, CASE WHEN op = 'update' AND changed = '' THEN 'same' ELSE op END AS op, changed, CASE WHEN l THEN sha256(coalesce(lt, '~') || chr(10) || coalesce(ll, '~') || chr(10) || coalesce(ls, '~')) END AS row_sha256 FROM d"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: import_module(f"millrace.llm.{module}").query for name, module in MODULES.items()} | {"pipeline": import_module("corpus_pipeline").run}


def oracle_sql() -> dict[str, str]:
    whole = import_module("corpus_pipeline").ORACLE_SQL
    return ORACLE_SQL | ({"pipeline": whole} if whole else {})
