"""Context for an answer: order, token budget, headers, citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import CHUNK_LABELS, citations, file_stem

HEADER, MARKER = 15, 20


def ordered(chunks: DataFrame, key: str = "q_id", id_col: str = "chunk_id") -> DataFrame:
    """Primary chunks first, then by hop, then by score."""
    w = Window.partitionBy(key).orderBy(F.col("is_primary").desc(), "hop", F.col("score").desc(), id_col)
    return chunks.withColumn("pos", F.row_number().over(w).cast("bigint"))


def fill_budget(chunks: DataFrame, cap: int, key: str = "q_id", id_col: str = "chunk_id") -> DataFrame:
    """Chunks that fit a token budget, taken in order; one that doesn't fit is passed over, not the end.

    A chunk counts its tokens, at most half the budget (a cut one has a marker too), and a header. The
    first is always taken. The fold runs over one query's ordered array.
    """
    half = cap // 2
    cost = F.when(F.col("token_count") > half, F.lit(half + MARKER)).otherwise(F.col("token_count")) + HEADER
    rows = chunks.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", F.col(id_col).alias("id"), cost.cast("bigint").alias("cost")))).alias("rows"))
    kind = dict(chunks.dtypes)[id_col]
    start = F.struct(F.lit(0).cast("bigint").alias("used"), F.array().cast(f"array<struct<pos:bigint,id:{kind},cost:bigint>>").alias("kept"))

    def step(a: Column, r: Column) -> Column:
        fits = (a["used"] + r["cost"] <= cap) | (F.size(a["kept"]) == 0)
        return F.struct(F.when(fits, a["used"] + r["cost"]).otherwise(a["used"]).alias("used"), F.when(fits, F.concat(a["kept"], F.array(r))).otherwise(a["kept"]).alias("kept"))

    return rows.select(key, F.explode(F.aggregate("rows", start, step, lambda a: a["kept"])).alias("k")).select(key, F.col("k.id").alias(id_col), "k.pos", "k.cost")


def until_overflow(chunks: DataFrame, cap_chars: int, key: str = "q_id", content: str = "content") -> DataFrame:
    """The judge's cut: chunks in order until the first that would overflow."""
    so_far = F.sum(F.length(content)).over(Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    return chunks.withColumn("_sum", so_far).where(F.col("_sum") <= cap_chars).drop("_sum")


def header(number: Column, source: Column, page: Column, section: Column) -> Column:
    """"[1] (filename: a.pdf | page: 3 | section: X)"; what is missing is left out."""
    part = lambda name, c: F.when(c.isNotNull() & (c.cast("string") != ""), F.concat(F.lit(f"{name}: "), c.cast("string")))
    return F.concat(F.lit("["), number.cast("string"), F.lit("] ("), F.concat_ws(" | ", part("filename", source), part("page", page), part("section", section)), F.lit(")"))


def label(kind: Column) -> Column:
    out = F.lit("")
    for name, text in CHUNK_LABELS.items():
        out = F.when(kind == name, text).otherwise(out)
    return out


def prompt(facts: Column, preferences: Column, summary: Column, context: Column, question: Column) -> Column:
    """Blocks in their order; empty ones are left out."""
    block = lambda name, c, end: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"[{name}]\n"), c, F.lit(f"\n[{end}]")))
    return F.concat_ws(
        "\n\n",
        block("USER FACTS", facts, "END USER FACTS"),
        block("USER PREFERENCES", preferences, "END USER PREFERENCES"),
        block("CONVERSATION SUMMARY", summary, "END SUMMARY"),
        F.when(F.coalesce(context, F.lit("")) != "", F.concat(F.lit("Context:\n"), context)),
        F.concat(F.lit("Question: "), question),
    )


def match_citations(answers: DataFrame, chunks: DataFrame, key: str = "answer_id") -> DataFrame:
    """Chunks that an answer cites: its source's name or stem equals the cited one, and its page, if one
    is cited. Equal names have equal stems, so the join is on the stem alone."""
    cited = answers.select(key, F.explode(citations(F.col("answer"))).alias("c")).select(key, F.col("c.source").alias("cited"), F.col("c.page").alias("cited_page"), file_stem(F.col("c.source")).alias("stem")).distinct()
    have = chunks.select(key, "source", "page", F.lower(file_stem(F.col("source"))).alias("stem"))
    return have.join(cited, [key, "stem"]).where(F.col("cited_page").isNull() | (F.col("cited_page") == F.col("page"))).select(key, "source", "page").distinct()
