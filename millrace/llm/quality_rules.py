"""Quality rules as learned decision lists (operator 2). DataFrame functions only.

Statistics of every whole text are Spark expressions; sequential covering learns from them an
ordered list of threshold conjunctions, and the list becomes one CASE expression. Each growth
step is one small aggregation over all labelled rows; no more than a histogram is gathered.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.arrowio import materialised

_BLANK = "[\\x20\\x09-\\x0D]"

#: What rules may test: name -> expression over the base statistics.
FEATURES: dict[str, str] = {
    "words": "n_words",
    "mean_word": "word_chars / n_words",
    "symbols_per_word": "n_symbols / n_words",
    "bangs_per_word": "n_bangs / n_words",
    "capitals_per_char": "n_capitals / word_chars",
    "duplicate_lines": "n_dup_lines / n_lines",
    "repeated_words": "n_repeat_words / n_words",
    "distinct_words": "n_distinct / n_words",
}


def let(value: Column, body) -> Column:
    """body(value), with value computed once a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeated(words: Column) -> Column:
    """Words in 3-word windows that the text holds twice or more.

    Windows that occur once are the rule, so they are counted by hashing first; only texts with a
    repeat sort theirs. The marked starts, in order, each add what the start before hasn't covered.
    """
    window = lambda w, i: F.concat_ws(" ", w, F.get(words, i + 1), F.get(words, i + 2))

    def covered(windows: Column) -> Column:
        placed = F.sort_array(F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.alias("p"))))
        marked = let(placed, lambda s: F.filter(s, lambda x, i: F.coalesce(x["w"] == F.get(s, i - 1)["w"], F.lit(False)) | F.coalesce(x["w"] == F.get(s, i + 1)["w"], F.lit(False))))
        starts = F.sort_array(F.transform(marked, lambda x: x["p"]))
        zero = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-3).alias("at"))
        step = lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p - a["at"])).alias("n"), p.alias("at"))
        return F.aggregate(starts, zero, step, lambda a: a["n"])

    many = let(
        F.transform(F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0))), window),
        lambda ws: F.when(F.size(F.array_distinct(ws)) < F.size(ws), covered(ws)).otherwise(F.lit(0).cast("bigint")),
    )
    return F.when(F.size(words) >= 3, many).otherwise(F.lit(0).cast("bigint"))


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and the base statistics of every whole text, in one pass without a shuffle.

    Null text counts as empty: no words, and all statistics 0. Rows keep their number, repeated ids
    and null ids too; other columns are left behind.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.filter(F.split(text, f"{_BLANK}+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x, F.lit(" \t\n\x0b\f\r")) != "")
    big = lambda c: c.cast("bigint")
    found = let(
        words,
        lambda w: F.struct(
            big(F.size(w)).alias("n_words"),
            big(F.length(F.array_join(w, ""))).alias("word_chars"),
            _repeated(w).alias("n_repeat_words"),
            big(F.size(F.array_distinct(w))).alias("n_distinct"),
        ),
    )
    by_line = let(lines, lambda x: F.struct(big(F.size(x)).alias("n_lines"), big(F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines")))
    return docs.select(
        F.col(id_col),
        found.alias("w"),
        by_line.alias("l"),
        big(F.regexp_count(text, F.lit("[#*$%&|<>]"))).alias("n_symbols"),
        big(F.regexp_count(text, F.lit("!"))).alias("n_bangs"),
        big(F.regexp_count(text, F.lit("[A-Z]"))).alias("n_capitals"),
    ).select(id_col, "w.*", "l.*", "n_symbols", "n_bangs", "n_capitals")


@dataclass
class Rule:
    """If all tests hold, the verdict. A test: (feature, "<=" or ">", threshold)."""

    tests: list[tuple[str, str, float]]
    keep: bool = False

    def condition(self) -> Column:
        held = F.lit(True)
        for name, sign, at in self.tests:
            held = held & F.coalesce(F.expr(f"({FEATURES[name]}) {sign} {at!r}D"), F.lit(False))
        return held

    def __str__(self) -> str:
        return " and ".join(f"{n} {s} {t:.6g}" for n, s, t in self.tests)


@dataclass
class DecisionList:
    rules: list[Rule] = field(default_factory=list)

    def keeps(self) -> Column:
        """The list as one ordered conditional expression; what no rule covers is kept."""
        out = None
        for rule in self.rules:
            out = F.when(rule.condition(), F.lit(rule.keep)) if out is None else out.when(rule.condition(), F.lit(rule.keep))
        return F.lit(True) if out is None else out.otherwise(F.lit(True))


def _thresholds(have: DataFrame, names: list[str], cuts: int) -> dict[str, list[float]]:
    """The `cuts` quantiles of each feature, from counts over all rows; the same for any partitioning.

    Values are counted in cells of under 1 % of their size, so counts are no more than a few thousand a
    feature whatever the number of rows; a quantile is the largest value of the cell that reaches its share.
    """
    tall = have.select(F.explode(F.array(*[F.struct(F.lit(i).alias("f"), F.col(n).alias("x")) for i, n in enumerate(names)])).alias("v")).select("v.f", "v.x")
    cells = tall.groupBy("f", F.floor(F.ln("x") * 128).alias("cell")).agg(F.max("x").alias("x"), F.count("*").alias("n"))
    upto = Window.partitionBy("f").orderBy("x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = cells.select("f", "x", F.sum("n").over(upto).alias("upto"), F.sum("n").over(Window.partitionBy("f")).alias("all"))
    reached = [F.min(F.when(F.col("upto") * cuts >= F.col("all") * i, F.col("x"))).alias(f"q{i}") for i in range(1, cuts)]
    got = {r.f: sorted(set(r[1:])) for r in summed.groupBy("f").agg(*reached).collect()}
    return {n: got.get(i, []) for i, n in enumerate(names)}


def learn(rows: DataFrame, label: str = "quality", key: str = "doc_id", cuts: int = 24, max_rules: int = 8, max_tests: int = 3, precision: float = 0.97, min_covered: int = 8) -> DecisionList:
    """Sequential covering of the rows with label 0.

    Thresholds are `cuts` quantiles of each feature over all labelled rows, whatever their partitioning. Two thirds of them (by a
    hash of `key`) grow a conjunction by FOIL gain; the last third prunes it from its end; it joins
    the list if enough of what it covers there has label 0. Covered rows leave, until no rule is
    good enough. Without labelled rows, or with one label alone, the list is empty and keeps all.
    """
    names = list(FEATURES)
    have = rows.where(F.col(label).isNotNull()).select(
        (F.col(label) == 0).cast("bigint").alias("bad"),
        (F.pmod(F.xxhash64(key), F.lit(3)) == 0).alias("prune"),
        *[F.coalesce(F.expr(f"cast({FEATURES[n]} as double)"), F.lit(0.0)).alias(n) for n in names],
    )
    points = _thresholds(have, names, cuts)
    if not any(points.values()):
        return DecisionList()

    def bin_of(name: str) -> Column:
        """How many thresholds lie below the value."""
        ladder = F.array(*[F.lit(float(p)) for p in points[name]]) if points[name] else F.array().cast("array<double>")
        return F.size(F.filter(ladder, lambda p: F.col(name) > p)).alias(name)

    binned = materialised(
        have.select("bad", "prune", *[bin_of(n) for n in names])
        .groupBy("bad", "prune", *names)
        .agg(F.count("*").alias("n")),
        "labelled-bins",
    )

    def holds(test: tuple[str, str, int]) -> Column:
        name, sign, k = test
        return F.col(name) > k if sign == ">" else F.col(name) <= k

    def all_of(tests) -> Column:
        held = F.lit(True)
        for t in tests:
            held = held & holds(t)
        return held

    import math

    found, taken = [], F.lit(False)
    while len(found) < max_rules:
        tests: list[tuple[str, str, int]] = []
        base = None
        while len(tests) < max_tests:
            seen = binned.where(~taken & ~F.col("prune") & all_of(tests))
            table = seen.select("bad", "n", F.explode(F.array(*[F.struct(F.lit(i).alias("f"), F.col(n).alias("b")) for i, n in enumerate(names)])).alias("x"))
            hist = table.groupBy("x.f", "x.b").agg(F.sum(F.col("bad") * F.col("n")).alias("bad"), F.sum("n").alias("n")).collect()
            mine = {(r.f, r.b): (r.bad, r.n) for r in hist}
            total = (sum(v[0] for (f, _), v in mine.items() if f == 0), sum(v[1] for (f, _), v in mine.items() if f == 0))
            base = base or total
            if not total[0] or total[0] == total[1]:
                break
            before, best = math.log2(total[0] / total[1]), (0.0, None)
            for f, name in enumerate(names):
                bad = n = 0
                for k in range(len(points[name])):
                    x = mine.get((f, k), (0, 0))
                    bad, n = bad + x[0], n + x[1]
                    for sign, p, m in (("<=", bad, n), (">", total[0] - bad, total[1] - n)):
                        if p >= min_covered:
                            gain = p * (math.log2(p / m) - before)
                            best = max(best, (gain, (name, sign, k)), key=lambda y: y[0])
            if best[1] is None:
                break
            tests.append(best[1])
        if not tests:
            break
        upto = [all_of(tests[: i + 1]) for i in range(len(tests))]
        sums = [s for i, c in enumerate(upto) for s in (F.sum(F.when(c, F.col("bad") * F.col("n"))).alias(f"p{i}"), F.sum(F.when(c, F.col("n"))).alias(f"n{i}"))]
        got = binned.where(~taken & F.col("prune")).agg(*sums).first()
        worth = [((got[f"p{i}"] or 0), (got[f"n{i}"] or 0)) for i in range(len(tests))]
        value = [(2 * p - n) / n if n else -1.0 for p, n in worth]
        cut = max(range(len(tests)), key=lambda i: (value[i], -i))
        if not worth[cut][1] or worth[cut][0] < precision * worth[cut][1]:
            break
        tests = tests[: cut + 1]
        taken = taken | all_of(tests)
        found.append(Rule([(n, s, float(points[n][k])) for n, s, k in tests]))
    return DecisionList(found)


def apply(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", min_words: int = 50, max_repeat_percent: int = 50) -> DataFrame:
    """Statistics, base verdict and learned verdict of every document.

    Returns id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept.
    base_failed: fewer than `min_words` words, or over `max_repeat_percent` of them repeated. The list
    is learned from labelled rows that pass the base; a label counts once for each row of its id, a
    null id has none. Null text is empty and fails the base.
    """
    found = materialised(statistics(docs, id_col), "text-statistics")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    marks = labels.select(F.col(id_col), F.col("quality"))
    rules = learn(found.where(~failed).join(marks, id_col), key=id_col)
    return found.select(id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & rules.keeps()).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2_quality_rules."""
    return apply(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
