"""Literals and restatements of sequential rules."""

import pytest
from pyspark.sql import functions as F

from millrace.functions import routing
from millrace.functions import text as T
from millrace.operators import chunking, cleaning, context, evaluate, memory, profile, retrieval
from millrace.plans.engine import Engine, NotReadOnly, template_planner


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values))
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("text", "want"),
    [("# Title\nbody", "Title\nbody"), ("**bold** and *it*", "bold and it"), ("see [documentation](https://docs.example.com)", "see documentation"), ("a `code` b", "a b"), ("x\n---\ny", "x\n\ny"), ("| a | b |", "")],
)
def test_markdown_goes(spark, text, want):
    assert one(spark, T.for_embedding(F.col("t")), t=text) == want


@pytest.mark.parametrize(("text", "noise"), [("  12 ", True), ("", True), ("too short", True), ("1.2.3 ... 4.5.6 --- 78", True), ("A sentence of words.", False)])
def test_noise(spark, text, noise):
    assert one(spark, T.is_noise(F.col("t")), t=text) is noise


def test_hyphens_and_fragments(spark):
    assert one(spark, T.normalise_block(F.col("t")), t="inter-\nnational") == "international"
    rows = [("a", 0, 0, "The quick brown fox-"), ("a", 1, 0, "trot dances here"), ("b", 0, 0, "The quick brown fox-"), ("b", 1, 1, "trot dances here"), ("c", 0, 0, "ends open"), ("c", 1, 0, "goes on"), ("c", 2, 0, "New.")]
    got = cleaning.rejoined(spark.createDataFrame(rows, "doc_id string, ord int, page int, text string")).orderBy("doc_id", "ord").collect()
    assert [(r.doc_id, r.text) for r in got] == [("a", "The quick brown foxtrot dances here"), ("b", "The quick brown fox-"), ("b", "trot dances here"), ("c", "ends open goes on"), ("c", "New.")]


def test_running_heads_need_three(spark):
    rows = [("a", i, 0, "Annual report 2024 page") for i in range(3)] + [("b", i, 0, "Annual report 2024 page") for i in range(2)]
    assert {r.doc_id for r in cleaning.without_running_heads(spark.createDataFrame(rows, "doc_id string, ord int, page int, text string")).collect()} == {"b"}


def test_near_copies(spark):
    base = "The committee approved the annual budget for the coming year on Monday."
    rows = [("a", 0, 0, base), ("a", 1, 0, base.replace("Monday", "Tuesday")), ("a", 2, 0, "Something else entirely was said.")]
    assert [r.ord for r in cleaning.without_near_copies(spark.createDataFrame(rows, "doc_id string, ord int, page int, text string")).orderBy("ord").collect()] == [0, 2]


def test_citation_forms(spark):
    got = one(spark, T.citations(F.col("t")), t="a [Source: report.pdf, page 3] b [Source: Other] c")
    assert [(x.source, x.page) for x in got] == [("report.pdf", 3), ("other", None)]


def test_fusion_literals(spark):
    dense = spark.createDataFrame([(0, "A", 1), (0, "B", 2)], "q_id int, id string, rk int")
    lexical = spark.createDataFrame([(0, "C", 1), (0, "A", 2)], "q_id int, id string, rk int")
    assert [(r.id, r.rrf) for r in retrieval.fuse([dense, lexical], "id", 10).orderBy("rk").collect()] == [("A", 0.032522), ("C", 0.016393), ("B", 0.016129)]


def test_diversity_literals(spark):
    rows = [(0, 1, 1.0, [1.0, 0.0]), (0, 2, 0.9, [0.99, 0.141067]), (0, 3, 0.5, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "q_id int, vec_id int, score double, embedding array<double>")
    assert [r.vec_id for r in retrieval.diverse(df, 3).orderBy("pos").collect()] == [1, 3, 2]
    flat = df.withColumn("score", F.lit(0.5) + F.col("vec_id") / -1000)
    assert [r.vec_id for r in retrieval.diverse(flat, 3).orderBy("pos").collect()] == [1, 2, 3]


@pytest.mark.parametrize(("sizes", "budget", "kept"), [([200] * 4, 1500, 4), ([300] * 6, 1500, 5), ([2000], 1500, 1), ([10] * 5, 0, 2)])
def test_buffer(spark, sizes, budget, kept):
    turns = spark.createDataFrame([(1, i, n) for i, n in enumerate(sizes)], "conv_id int, turn int, token_count int")
    assert memory.trim(turns, budget).where("kept").count() == kept


def test_budget_is_greedy_with_skips(spark):
    rows = [(0, str(i), i, n) for i, n in enumerate([30, 90, 20, 500, 10])]
    df = spark.createDataFrame(rows, "q_id int, chunk_id string, pos bigint, token_count bigint")
    got = [int(r.chunk_id) for r in context.fill_budget(df, 120).orderBy("pos").collect()]
    used, want = 0, []
    for i, n in enumerate([30, 90, 20, 500, 10]):
        cost = (min(n, 60) + 20 * (n > 60)) + 15
        if not want or used + cost <= 120:
            want.append(i)
            used += cost
    assert got == want


def test_judge_and_verdicts(spark):
    s = {"faithfulness": F.lit(1.0), "answer_relevance": F.lit(0.8), "context_relevance": F.lit(None).cast("double"), "completeness": F.lit(0.6), "citation_accuracy": F.lit(0.5)}
    assert one(spark, routing.judge_overall(s), z=1) == 0.8118
    v = lambda a, j, c: one(spark, routing.answer_verdict(F.lit(a).cast("double"), F.lit(j).cast("double"), F.lit(c).cast("double")), z=1)
    assert [v(0.29, 0.9, 0.9), v(0.5, 0.59, 0.9), v(0.5, None, 0.49), v(0.5, 0.7, 0.1)] == ["off_topic", "fail", "low_confidence", "pass"]
    m = lambda x: one(spark, routing.metric_verdict(F.lit(x).cast("double"), F.lit(None).cast("double")), z=1)
    assert [m(0.40), m(0.39), m(0.24), m(None)] == ["pass", "warn", "fail", "unknown"]
    e = lambda x, i, n, w: one(spark, routing.escalation(F.lit(x), F.lit(i), F.lit(n), F.lit(w)), z=1)
    assert [e(True, "complaint", True, "fail"), e(False, "complaint", True, "fail"), e(False, "general", True, "fail"), e(False, "general", False, "off_topic"), e(False, "general", False, "pass")] == ["explicit_request", "complaint", "no_answer", "low_quality", None]


def test_feedback_literals(spark):
    rows = spark.createDataFrame([(1, False, 0.5, "a", "pass"), (1, False, None, "a", "pass"), (-1, True, 0.7, "b", "fail"), (0, False, None, "b", "fail")], "rating int, escalated boolean, confidence double, intent string, verdict string")
    r = evaluate.feedback(rows).where("scope = 'all'").first()
    assert (r.total, r.helpful, r.not_helpful, r.satisfaction, r.avg_confidence) == (4, 2, 1, 66.7, 0.6)


def test_metric_orderings(spark):
    ref = "Revenue reached 4.2 billion in Q3 2024, representing a 12% year-over-year increase."
    pairs = spark.createDataFrame([(0, ref, ref), (1, "Revenue was 4.2 billion.", ref), (2, "", ref)], "k int, answer string, reference string")
    r1, r2, rl, b = ({r.k: r for r in x.collect()} for x in (evaluate.rouge_n(pairs, 1, ["k"]), evaluate.rouge_n(pairs, 2, ["k"]), evaluate.rouge_l(pairs, ["k"]), evaluate.bleu(pairs, ["k"])))
    assert r1[0].f == r2[0].f == rl[0].f == b[0].bleu_4 == 1.0
    assert r1[1].f >= r2[1].f and r1[1].f >= rl[1].f and b[1].bleu_1 >= b[1].bleu_4
    assert r1[2].f == rl[2].f == b[2].bleu_1 == 0.0


def test_profile_literals(spark):
    rows = [(1, "Alpha", "sales", 1000.50, True), (2, "Beta", "marketing", 2500.00, False), (3, "Gamma", "sales", 750.25, True), (4, "Delta", "engineering", 3200.00, True), (5, "Epsilon", "marketing", 980.75, False)]
    got = {r.column: r for r in profile.summaries(spark.createDataFrame(rows, "id int, name string, category string, revenue double, active boolean")).collect()}
    assert (got["revenue"].min, got["revenue"].max, got["revenue"].mean) == (750.25, 3200.0, 1686.3)
    assert got["category"].unique_count == 3 and (got["active"].min, got["active"].max, got["active"].mean) == (0.0, 1.0, 0.6)
    holes = spark.createDataFrame([(1.0,), (None,), (None,), (4.0,)], "v double")
    assert [(r.null_count, r.null_pct) for r in profile.summaries(holes).collect()] == [(2, 50.0)]


def test_chunk_ranges(spark):
    rows = profile.numbered(spark.range(25_000).select((F.lit(25_000) - F.col("id")).alias("k")), ["k"])
    got = [(r.row_start, r.row_end, r.chunk_total) for r in profile.row_chunks(rows).orderBy("chunk_index").collect()]
    assert got == [(0, 10_000, 3), (10_000, 20_000, 3), (20_000, 25_000, 3)]


def test_slugs(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], ["Product Name", "Revenue ($)", "", "product-name"])
    assert profile.slugged(df).columns == ["product_name", "revenue", "col_2", "product_name_2"]
    assert one(spark, T.table_slug(F.col("t")), t="2024 Sales!") == "t_2024_sales"


def test_read_only_sql(spark):
    e = Engine(spark)
    e.register("t", spark.range(10).withColumn("v", F.col("id") * 2))
    assert e.sql("SELECT count(*) AS n FROM {table}", "t").first().n == 10
    assert e.query("t", "sum of v").result.first()[0] == 90
    for bad in ("DROP TABLE t", "INSERT INTO t VALUES (1, 2)", "CREATE TABLE x AS SELECT 1", "SET a = b", "not sql"):
        with pytest.raises(NotReadOnly):
            e.sql(bad)
    assert not e.query("nothing", "SELECT 1").success
    assert template_planner("average v by id", [("id", "int"), ("v", "int")]).startswith("SELECT `id`, avg(`v`)")


def test_packing_rules():
    parts = ["a" * 400, "b" * 400, "c" * 2000, "d" * 40]
    assert [len(x) for x in chunking.pack(parts, 300)] == [801, 2000, 40]
    assert chunking.group(["x" * 400] * 3 + ["y" * 20], 80, 150)[-1].endswith("y" * 20)
    assert len(chunking.merge_small(["a" * 40, "b" * 400, "c" * 40], 80, 200)) == 1
    table = "| a | b |\n| --- | --- |\n" + "\n".join(f"| {'x' * 100} | {i} |" for i in range(20))
    out = chunking.table_chunks(table, 120)
    assert len(out) > 3 and all(c.startswith("| a | b |\n| --- | --- |\n") for c in out) and sum(c.count("x" * 100) for c in out) == 20
    assert [k for k, _ in chunking.segments("intro\n| a | b |\n| 1 | 2 |\ntail")] == ["text", "table", "text"]


def test_headings_in_chunks():
    blocks = [(0, "# One\n\n" + "Alpha sentence here. " * 10 + "\n\n## Two\n\n" + "Beta sentence there. " * 10)]
    assert [c[1] for c in chunking.contextual(blocks)] == ["One", "Two"]
    assert [c[2].split("]")[0] for c in chunking.hierarchical(blocks)] == ["[One", "[One > Two"]


def test_finalise_numbers_from_one(spark):
    chunks = spark.createDataFrame([("s", i, 2, t) for i, t in enumerate(["first part", " ", "# second part"])], "source string, ord int, page int, content string")
    got = chunking.finalise(chunks).orderBy("chunk_index").collect()
    assert [(r.chunk_index, r.chunk_total, r.page_start, r.content) for r in got] == [(1, 2, 3, "first part"), (2, 2, 3, "second part")]


def test_entities(spark):
    got = one(spark, T.entities(F.col("t")), t='The EBITDA of Cloud Services in 2024 was $4.2B, up 12% says "the CFO"')
    assert got[:2] == ["EBITDA", "CFO"] and "Cloud Services" in got and "$4.2B" in got and "12%" in got and "The" not in got


def test_near_copies_are_told_by_their_whole_texts(spark):
    same = " ".join(f"word{i}" for i in range(90))
    rows = [(1, 0, 0, same + " then the ship" + " sails" * 100), (1, 1, 0, same + " but no harbour" + " waits" * 100), (1, 2, 0, same + " then the ship" + " sails" * 99)]
    assert len(same) > 500
    assert [r.ord for r in cleaning.without_near_copies(spark.createDataFrame(rows, "doc_id int, ord int, page int, text string")).orderBy("ord").collect()] == [0, 1]


def test_near_copies_in_documents_longer_than_a_batch(spark):
    words = ["alpha", "bravo", "charlie", "delta", "echo"]
    rows = [(d, i, 0, " ".join(words[(i * k + d) % 5] for k in range(1, 2 + i % 4)) * (1 + i % 3)) for d in range(3) for i in range(5 + 9 * d)] + [(None, 0, 0, None), (None, 1, 0, "")]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = cleaning.without_near_copies(spark.createDataFrame(rows, "doc_id int, ord int, page int, text string")).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = []
    for d in (0, 1, 2, None):
        mine = [r for r in rows if r[0] == d]
        want += [r for r, new in zip(mine, cleaning.new_blocks([r[3] or "" for r in mine])[0], strict=True) if new]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_cleaning_computes_a_block_once(spark):
    """Blocks are shuffled once, and no condition repeats the patterns of the column that it is about."""
    import re

    from pyspark.sql import functions as F

    from millrace.operators import cleaning

    docs = spark.createDataFrame([(1, "A page of words,\nbroken in lines-\nthat go on here\n12\n\n"), (2, None), (3, ""), (4, "\n \n")], "doc_id int, text string")
    blocks = cleaning.paragraphs(docs, separator="\n")
    assert [tuple(r) for r in blocks.orderBy("ord").collect()] == [(1, 0, "A page of words,"), (1, 1, "broken in lines-"), (1, 2, "that go on here"), (1, 3, "12")]
    done = cleaning.clean(blocks.withColumn("page", F.lit(0)))
    assert sorted((r.ord, r.text) for r in done.collect()) == [(0, "A page of words,"), (1, "broken in linesthat go on here")]
    plan = done._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall("RepartitionByExpression", plan)) == 1
    assert plan.count("[ \\t]{2,}") == 2  # at the start and after fragments are joined
    physical = done._jdf.queryExecution().executedPlan().toString().split("+- == Initial Plan ==")[-1]
    assert physical.count("Exchange hashpartitioning") == 1 or physical.count("Exchange") == 1
    found = blocks._jdf.queryExecution().optimizedPlan().toString()
    assert found.count("split(") == 1
