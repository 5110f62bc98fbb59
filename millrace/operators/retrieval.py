"""Lexical, dense and hybrid retrieval over tables, batched over a table of queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import tokens
from millrace.operators import search
from millrace.sources.scratch import written

#: Saturation and length normalisation of term weights; constant of reciprocal rank fusion.
K1, B, RRF_K = 1.5, 0.75, 60
GLOBAL_OWNER = "__global__"
#: Distinct query terms up to which other words of documents are dropped where they are read.
FEW_TERMS = 500


def payload_filter(wanted: dict) -> Column:
    """All fields must match: a scalar is an equality, a list any of its values; empty ones don't count."""
    parts = [F.col(k).isin(list(v)) if isinstance(v, list | tuple | set) else F.col(k) == v for k, v in wanted.items() if v not in (None, [], (), "")]
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def visible_to(user: str | None, admin: bool = False, owner: str = "owner_id") -> Column:
    """A user sees their own and global rows; admins and anonymous callers everything."""
    return F.lit(True) if admin or user is None else F.col(owner).isin(user, GLOBAL_OWNER)


def accessible(email: str, public: str = "is_public", allowed: str = "allowed_users") -> Column:
    return F.coalesce(F.col(public), F.lit(False)) | F.coalesce(F.array_contains(allowed, email), F.lit(False))


def owner_of_upload(admin: Column, user: Column) -> Column:
    return F.when(admin | user.isNull(), GLOBAL_OWNER).otherwise(user)


def term_counts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, length, term, tf: one aggregation whose key begins with the document."""
    words = docs.select(F.col(id_col), tokens(F.col(text_col)).alias("w"))
    return words.select(id_col, F.size("w").cast("bigint").alias("length"), F.explode("w").alias("term")).groupBy(id_col, "length", "term").agg(F.count("*").alias("tf"))


def corpus_statistics(docs: DataFrame, text_col: str) -> DataFrame:
    """n, total and avg_dl of documents with words. Sum and count are kept, so that parts merge exactly."""
    n = F.size(tokens(F.col(text_col))).cast("bigint")
    return docs.select(n.alias("dl")).where("dl > 0").agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("total")).withColumn("avg_dl", F.try_divide("total", "n"))


def saturated(tf: Column, dl: Column, avg: Column, k1: float = K1, b: float = B) -> Column:
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avg))


def inverse_frequency(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def query_terms(queries: DataFrame) -> DataFrame:
    """q_id, ql, term, qtf of queries (q_id, text)."""
    words = queries.select(F.col("q_id").cast("bigint").alias("q_id"), tokens(F.col("text")).alias("w"))
    return words.select("q_id", F.size("w").alias("ql"), F.explode("w").alias("term")).groupBy("q_id", "ql", "term").agg(F.count("*").alias("qtf"))


def query_weight(n: int, average: float) -> Column:
    """A query term's own part of a score, of columns df, qtf and ql."""
    return inverse_frequency(F.lit(n), F.col("df")) * saturated(F.col("qtf"), F.col("ql"), F.lit(average))


def bm25(docs: DataFrame, queries: DataFrame, k: int, id_col: str = "doc_id", text_col: str = "text", digits: int = 6, exclude_self: bool = False) -> DataFrame:
    """q_id, id, score and rk of each query's k best documents; queries has q_id and text. With exclude_self a
    query's own row (the id is its q_id) isn't ranked.

    The corpus is read twice: for document frequencies (one aggregation whose map side combines) and for the
    scores, where queries come to the documents. Terms of a query are weighted by the same saturation, over
    its own length. Few query terms are pushed into the reading of the documents. Documents that share no
    term with a query aren't ranked.
    """
    asked = written(query_terms(queries), "asked")
    terms = [r.term for r in asked.select("term").distinct().limit(FEW_TERMS + 1).collect()]
    few = 0 < len(terms) <= FEW_TERMS
    mine = lambda w: F.struct(F.size(w).alias("dl"), (F.filter(w, lambda t: t.isin(terms)) if few else w).alias("w"))
    words = docs.select(F.col(id_col), F.element_at(F.transform(F.array(tokens(F.col(text_col))), mine), 1).alias("x")).select(id_col, "x.dl", "x.w")
    # a marker without a term carries the lengths, so that one pass gives both statistics
    marked = words.select(F.explode(F.concat(F.transform(F.array_distinct("w"), lambda t: F.struct(t.alias("term"), F.lit(0).alias("dl"))), F.when(F.col("dl") > 0, F.array(F.struct(F.lit(None).cast("string").alias("term"), "dl"))).otherwise(F.array()))).alias("x")).select("x.*")
    frequency = written(marked.groupBy("term").agg(F.count("*").alias("df"), F.sum("dl").alias("total")), "frequency")
    whole = frequency.where("term is null").first()
    if whole is None:
        return queries.sparkSession.createDataFrame([], f"q_id bigint, `{id_col}` {dict(docs.dtypes)[id_col]}, score double, rk bigint")
    n, average = whole.df, whole.total / whole.df
    weighed = asked.join(frequency.where("term is not null"), "term").select("q_id", "term", query_weight(n, average).alias("weight"))
    return search.lexical(words, weighed, average, k, saturated, id_col, digits, exclude_self)


top, dense = search.top, search.dense


def fuse(lists: list[DataFrame], id_col: str, limit: int, rrf_k: int = RRF_K, digits: int = 6) -> DataFrame:
    """Reciprocal rank fusion of ranked lists (q_id, id, rk): the sum of 1 / (rrf_k + rk), then the first `limit`."""
    every = reduce(DataFrame.unionByName, [x.select("q_id", id_col, "rk") for x in lists])
    scored = every.groupBy("q_id", id_col).agg(F.round(F.sum(1 / (F.lit(float(rrf_k)) + F.col("rk"))), digits).alias("rrf"))
    return top(scored, "q_id", [F.col("rrf").desc(), F.col(id_col)], limit)


def merge_best(lists: list[DataFrame], id_col: str, score: str, key: str = "q_id") -> DataFrame:
    """Union of the hits of sub-queries; a hit that several found keeps its best score."""
    return reduce(DataFrame.unionByName, [x.select(key, id_col, score) for x in lists]).groupBy(key, id_col).agg(F.max(score).alias("best"))


def neighbours(anchors: DataFrame, chunks: DataFrame, window: int, source: str = "source", place: str = "chunk_index", id_col: str = "doc_id") -> DataFrame:
    """Chunks of an anchor's source at most `window` places away: anchor, neighbour, delta.

    The distance is an equality join on source and place: each anchor asks for 2 * window exact
    places, so that a source with very many chunks is no heavier than its anchors.
    """
    steps = F.explode(F.array(*[F.lit(d) for d in range(-window, window + 1) if d]))
    asked = anchors.select(F.col(id_col).alias("anchor"), F.col(source), F.col(place).alias("_at"), steps.alias("delta")).withColumn(place, F.col("_at") + F.col("delta"))
    found = chunks.select(F.col(source), F.col(place), F.col(id_col).alias("neighbour"))
    return asked.join(found, [source, place]).select("anchor", "neighbour", F.col("delta").cast("bigint").alias("delta"))


def multihop(first: DataFrame, second: DataFrame, id_col: str, limit: int = 3) -> DataFrame:
    """Hits of the first hop, then up to `limit` hits of each second-hop query that the first hop hasn't got
    (each once); q_id, id, hop, rk. first: q_id, id, rk; second: q_id, sub, id, rk."""
    late = second.where(F.col("rk") <= limit).join(first.select("q_id", id_col), ["q_id", id_col], "left_anti")
    once = late.withColumn("_n", F.row_number().over(Window.partitionBy("q_id", id_col).orderBy("sub", "rk"))).where("_n = 1")
    numbered = once.withColumn("rk", F.row_number().over(Window.partitionBy("q_id").orderBy("sub", "rk")).cast("bigint"))
    return first.select("q_id", id_col, F.lit(1).cast("bigint").alias("hop"), "rk").unionByName(numbered.select("q_id", id_col, F.lit(2).cast("bigint").alias("hop"), "rk"))


def diverse(candidates: DataFrame, k: int, balance: float = 0.5, least_spread: float = 0.01, id_col: str = "vec_id", score: str = "score", vector: str = "embedding") -> DataFrame:
    """Maximal marginal relevance: q_id, id, pos. Each step takes the candidate with the largest
    balance * relevance - (1 - balance) * (greatest similarity to those taken); relevance is the score over the
    largest one. If scores lie within `least_spread`, the order stays; with 0 it never does so. Inherently sequential,
    so it folds over the few candidates of a query in one task. Similarities add up component by component, so that
    equal vectors have equal ones."""
    import numpy as np
    import pandas as pd

    def pick(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values([score, id_col], ascending=[False, True])
        s = g[score].to_numpy(float)
        v = np.array(g[vector].tolist(), float)
        if len(g) and s.max() - s.min() < least_spread:
            chosen = list(range(min(k, len(g))))
        else:
            near, left, chosen = sum(np.multiply.outer(x, x) for x in v.T), list(range(len(g))), []
            while left and len(chosen) < k:
                gain = [balance * s[i] / s.max() - (1 - balance) * max((near[i, j] for j in chosen), default=0.0) for i in left]
                chosen.append(left.pop(int(np.argmax(gain))))
        return pd.DataFrame({"q_id": g["q_id"].iloc[chosen].to_numpy(), id_col: g[id_col].iloc[chosen].to_numpy(), "pos": range(1, len(chosen) + 1)})

    kind = dict(candidates.dtypes)
    return candidates.select("q_id", id_col, score, vector).groupBy("q_id").applyInPandas(pick, f"q_id {kind['q_id']}, `{id_col}` {kind[id_col]}, pos bigint")


def flatten(primary: DataFrame, extra: DataFrame, key: str, id_col: str, order: str) -> DataFrame:
    """Primary rows, then extra ones; each id once, where it came first."""
    both = primary.select(key, id_col, order, F.lit(True).alias("primary")).unionByName(extra.select(key, id_col, order, F.lit(False).alias("primary")))
    return top(both, f"{key}", [F.col("primary").desc(), F.col(order)], 1 << 30, "_n").withColumn("_first", F.row_number().over(Window.partitionBy(key, id_col).orderBy("_n"))).where("_first = 1").drop("_first", "_n")
