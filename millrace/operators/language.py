"""Languages of texts by naive Bayes over character trigrams, learnt from labelled rows and scored in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cells that trigrams are dealt into; languages at most, so that the table of weights is bounded.
CELLS, LANGUAGES = 1 << 14, 256
#: Characters below which nothing is said of a text.
LEAST = 30


def _codes(text: Column) -> Column:
    """The characters that count of a whole text: letters in lower case, other runs as one blank, with a blank at both ends."""
    whole = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}]+", " ")), F.lit(" "))
    # each character is looked at once: a place in a string is found by counting from its start
    return F.transform(F.split(whole, ""), F.ascii)


def _places(codes: Column) -> Column:
    return F.when(F.size(codes) > 2, F.sequence(F.lit(0), F.size(codes) - 3)).otherwise(F.array().cast("array<int>"))


def _cell(codes: Column, i: Column) -> Column:
    return (F.get(codes, i) * 961 + F.get(codes, i + 1) * 31 + F.get(codes, i + 2)) % CELLS


def cells(text: Column) -> Column:
    """The cells of a whole text's trigrams."""
    return _once(_codes(text), lambda codes: F.transform(_places(codes), lambda i: _cell(codes, i)))


def _once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with the value computed once for each row however often f names it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def learn(rows: DataFrame, language: str = "lang", text: str = "text") -> DataFrame:
    """One row: `languages`, and for each an array of log weights by cell. Rows without a language or a text don't count.

    What is gathered are counts by language and cell, whatever the number of rows.
    """
    known = rows.where(F.col(language).isNotNull() & F.col(text).isNotNull())
    # places are exploded, in the outer form, and codes as an array of one: compiled, and no text is looked at more than once
    codes = known.select(F.col(language).alias("language"), F.explode(F.array(_codes(F.col(text)))).alias("codes"))
    placed = codes.select("language", "codes", F.explode_outer(_places(F.col("codes"))).alias("i"))
    each = placed.select("language", _cell(F.col("codes"), F.col("i")).alias("cell")).where("cell IS NOT NULL")
    counts = each.groupBy("language", "cell").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("language").agg(F.sum("n").alias("total"))
    every = totals.select("language", "total", F.explode(F.sequence(F.lit(0), F.lit(CELLS - 1))).alias("cell"))
    weight = F.log((F.coalesce("n", F.lit(0)) + 1.0) / (F.col("total") + float(CELLS))).alias("w")
    weights = every.join(counts, ["language", "cell"], "left").select("language", "cell", weight)
    known = weights.groupBy("language").agg(F.array_sort(F.collect_list(F.struct("cell", "w"))).alias("x")).select("language", F.col("x.w").alias("weights"))
    table = known.agg(F.array_sort(F.collect_list(F.struct("language", "weights"))).alias("known"))
    return table.select(F.when(F.size("known") <= LANGUAGES, F.col("known")).otherwise(F.raise_error(F.lit(f"more than {LANGUAGES} languages"))).alias("known"))


def guessed(docs: DataFrame, model: DataFrame, text: str = "text", name: str = "language") -> DataFrame:
    """docs with the likeliest language; "" for texts below LEAST characters, and where no language is likelier than
    all cells being equally so. Ties go to the first by name. The model is one row of bounded size."""

    def best(found: Column) -> Column:
        total = lambda weights: F.aggregate(found, F.lit(0.0), lambda s, c: s + F.get(weights, c))
        far = F.transform("model_known", lambda k: F.struct(_once(k["weights"], total).alias("s"), k["language"].alias("l")))
        none = F.struct((F.size(found) * F.log(F.lit(1.0 / CELLS))).alias("s"), F.lit("").alias("l"))
        return F.reduce(far, none, lambda a, b: F.when(b["s"] > a["s"], b).otherwise(a))["l"]

    both = docs.crossJoin(F.broadcast(model.select(F.col("known").alias("model_known"))))
    return both.withColumn(name, F.when(F.length(text) >= LEAST, _once(cells(F.col(text)), best)).otherwise("")).drop("model_known")
