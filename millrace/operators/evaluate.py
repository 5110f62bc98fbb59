"""Lexical metrics, roll-ups of scores and feedback."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.routing import judge_overall
from millrace.functions.stem import scored_words, stems
from millrace.functions.text import tokens


def once(value: Column, body) -> Column:
    """body(value), with value computed once a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def grams(words: Column, n: int) -> Column:
    """n-grams of an array of words, joined by blanks; each place takes its n words, so the cost is linear."""
    if n == 1:
        return words
    return once(words, lambda w: F.slice(F.transform(w, lambda x, i: F.concat_ws(" ", x, *[F.get(w, i + k) for k in range(1, n)])), 1, F.greatest(F.size(w) - (n - 1), F.lit(0))))


def _words(pairs: DataFrame, keys: list[str], left: str, right: str, stem: bool) -> DataFrame:
    """keys, l and r: both texts' words. Stemming is a vectorised function over them; without it all stays in the JVM."""
    if stem:
        found = pairs.select(*keys, scored_words(F.col(left)).alias("l"), scored_words(F.col(right)).alias("r"))
        return found.select(*keys, stems("l").alias("l"), stems("r").alias("r"))
    return pairs.select(*keys, tokens(F.col(left)).alias("l"), tokens(F.col(right)).alias("r"))


def matches(pairs: DataFrame, most: int, keys: list[str], left: str = "answer", right: str = "reference", least: int = 1, stem: bool = False) -> DataFrame:
    """keys, n_left, n_right (words) and m<n>, the clipped matches of n-grams, for n from least to most.

    One pass: each text's words are found once, and all n-grams of both texts are counted together; a
    count moves as one row for each task and n-gram.
    """
    cols = _words(pairs, keys, left, right, stem)
    side = lambda c, n, a: F.transform(grams(F.col(c), n), lambda g: F.struct(F.lit(n).alias("n"), g.alias("g"), F.lit(a).alias("a"), F.lit(1 - a).alias("b")))
    every = F.concat(*[side(c, n, a) for n in range(least, most + 1) for c, a in (("l", 1), ("r", 0))])
    flat = cols.select(*keys, F.size("l").cast("bigint").alias("n_left"), F.size("r").cast("bigint").alias("n_right"), F.explode_outer(every).alias("x"))
    both = flat.groupBy(*keys, "n_left", "n_right", "x.n", "x.g").agg(F.least(F.sum("x.a"), F.sum("x.b")).alias("m"))
    return both.groupBy(*keys, "n_left", "n_right").agg(*[F.coalesce(F.sum(F.when(F.col("n") == n, F.col("m"))), F.lit(0)).alias(f"m{n}") for n in range(least, most + 1)])


def rouge_n(pairs: DataFrame, n: int, keys: list[str], digits: int = 4, stem: bool = False) -> DataFrame:
    """keys, p, r, f: precision, recall and their harmonic mean. `stem` compares stems of words of a-z and 0-9."""
    o = matches(pairs, n, keys, least=n, stem=stem).withColumns({x: F.greatest(F.col(x) - (n - 1), F.lit(0)) for x in ("n_left", "n_right")})
    return _balanced(o, F.col(f"m{n}"), keys, digits)


def _balanced(counts: DataFrame, m: Column, keys: list[str], digits: int) -> DataFrame:
    p, r = (F.when(F.col(c) > 0, m / F.col(c)).otherwise(0.0) for c in ("n_left", "n_right"))
    return counts.select(*keys, F.round(p, digits).alias("p"), F.round(r, digits).alias("r"), F.round(F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0), digits).alias("f"))


def rouge_l(pairs: DataFrame, keys: list[str], digits: int = 4, stem: bool = False) -> DataFrame:
    """Longest common subsequence of words: a pandas function, a row of the table at a time in numpy."""

    @F.pandas_udf("bigint")
    def common(left: pd.Series, right: pd.Series) -> pd.Series:
        out = []
        for a, b in zip(left, right, strict=True):
            names = {w: i for i, w in enumerate(dict.fromkeys([*a, *b]))}
            y = np.array([names[w] for w in b], np.int64)
            row = np.zeros(len(b) + 1, np.int64)
            for w in a:
                row[1:] = np.maximum(row[1:], np.where(y == names[w], row[:-1] + 1, 0))
                row = np.maximum.accumulate(row)
            out.append(int(row[-1]))
        return pd.Series(out)

    cols = _words(pairs, keys, "answer", "reference", stem)
    sized = cols.select(*keys, F.size("l").alias("n_left"), F.size("r").alias("n_right"), common("l", "r").alias("m"))
    return _balanced(sized, F.col("m"), keys, digits)


def bleu(pairs: DataFrame, keys: list[str], most: int = 4, smooth: float = 0.1, digits: int = 4) -> DataFrame:
    """keys, bleu_1 to bleu_<most>: smoothed precisions (a missing match counts `smooth`) and brevity penalty."""
    all_n = matches(pairs, most, keys).withColumns({"words": F.col("n_left"), "ref": F.col("n_right")})
    all_n = all_n.withColumns({f"l{n}": F.greatest(F.col("n_left") - (n - 1), F.lit(0)) for n in range(1, most + 1)})
    precision = [F.when(F.col(f"l{n}") == 0, F.lit(0.0)).when(F.col(f"m{n}") == 0, F.lit(smooth) / F.col(f"l{n}")).otherwise(F.col(f"m{n}") / F.col(f"l{n}")) for n in range(1, most + 1)]
    penalty = F.when(F.col("words") >= F.col("ref"), 1.0).when(F.col("words") > 0, F.exp(1 - F.col("ref") / F.col("words"))).otherwise(0.0)
    out = []
    for n in range(1, most + 1):
        ps = precision[:n]
        mean = F.when(reduce(lambda a, b: a | b, [p <= 0 for p in ps]), F.lit(0.0)).otherwise(F.exp(sum((F.log(p) for p in ps[1:]), F.log(ps[0])) / n))
        out.append(F.round(F.when(F.col("m1") == 0, 0.0).otherwise(penalty * mean), digits).alias(f"bleu_{n}"))
    return all_n.select(*keys, *out)


def coverage(answer: Column, reference: Column, digits: int = 4) -> Column:
    """Share of the reference's distinct words that the answer has."""
    r = F.array_distinct(tokens(reference))
    return F.when(F.size(r) > 0, F.round(F.size(F.array_intersect(F.array_distinct(tokens(answer)), r)) / F.size(r), digits)).otherwise(0.0)


def averages(results: DataFrame, names: list[str], digits: int = 4) -> DataFrame:
    return results.agg(*[F.round(F.avg(n), digits).alias(n) for n in names])


def ablation(full: DataFrame, other: DataFrame, names: list[str], band: float = 0.005) -> DataFrame:
    """metric, full, ablated, delta, arrow: up or down outside the dead band."""
    def long(df: DataFrame, name: str) -> DataFrame:
        return averages(df, names).select(F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias(name)) for n in names])).alias("x")).select("x.*")

    both = long(full, "full").join(long(other, "ablated"), "metric").withColumn("delta", F.round(F.col("ablated") - F.col("full"), 4))
    return both.withColumn("arrow", F.when(F.col("delta") > band, "up").when(F.col("delta") < -band, "down").otherwise("same"))


def feedback(rows: DataFrame) -> DataFrame:
    """Totals, by intent and by verdict in one pass over grouping sets. rows: rating, escalated, confidence, intent, verdict."""
    total = F.count("*")
    helpful = F.count_if(F.col("rating") == 1)
    bad = F.count_if(F.col("rating") == -1)
    spread = rows.select("*", F.explode(F.array(F.struct(F.lit("all").alias("scope"), F.lit("").alias("value")), F.struct(F.lit("intent").alias("scope"), F.col("intent").alias("value")), F.struct(F.lit("verdict").alias("scope"), F.col("verdict").alias("value")))).alias("g"))
    return spread.groupBy(F.col("g.scope").alias("scope"), F.col("g.value").alias("value")).agg(
        total.alias("total"), helpful.alias("helpful"), bad.alias("not_helpful"), F.count_if("escalated").alias("escalated"), F.round(F.avg("confidence"), 4).alias("avg_confidence"),
        F.when(helpful + bad > 0, F.round(100.0 * helpful / (helpful + bad), 1)).alias("satisfaction"),
    )


def last_answers(answers: DataFrame, order: str) -> DataFrame:
    """The last saved answer of each question, blanks aside."""
    q = F.trim("question")
    return answers.withColumn("_n", F.row_number().over(Window.partitionBy(q).orderBy(F.col(order).desc()))).where("_n = 1").drop("_n").withColumn("question", q)


def judged(rows: DataFrame, judges: dict, question: str = "question", answer: str = "answer", context: str = "context", most_chars: int = 6000) -> DataFrame:
    """A batch of answers judged: a column of scores for each dimension, and the weighted `overall`.

    judges: dimension -> column function (question, answer, context) -> double, vectorised; contexts are cut to
    most_chars for the prompt. All dimensions are judged in one pass over the rows.
    """
    q, a, c = F.col(question), F.col(answer), F.substring(context, 1, most_chars)
    scored = rows.withColumns({name: f(q, a, c) for name, f in judges.items()})
    return scored.withColumn("overall", judge_overall({name: F.col(name) for name in judges}))


def testset(chunks: DataFrame, n: int, seed: int = 0, least_words: int = 30, chars: int = 1500, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """n chunks of enough words in an order that a seeded hash decides; contents are cut for the prompt."""
    big = chunks.where(F.size(F.filter(F.split(text_col, r"\s+"), lambda w: w != "")) >= least_words)
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))
    return big.select(id_col, F.substring(text_col, 1, chars).alias("content"), order.alias("_o")).orderBy("_o").limit(n).drop("_o")
