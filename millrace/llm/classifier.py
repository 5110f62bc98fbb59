"""Quality classifier (operator 3): hashed word n-gram logistic regression, follow-the-regularised-leader."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.arrowio import fresh, frugal, reachable, slices, texts, words_of

#: log2 of the number of weights.
BITS = 18
_LETTERS, _DIGITS = re.compile(r"[^\W\d_]+"), re.compile(r"\d+")


def _shape(word: str) -> str:
    """A word's outline: a for letters (A if all are capitals), 9 for digits, other signs as they are."""
    return _DIGITS.sub("9", _LETTERS.sub(lambda m: "A" if len(m[0]) > 1 and m[0].isupper() else "a", word))[:12]


def features(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of all texts, and where each text's begin: words, pairs of words,
    outlines, pairs of outlines (a word twice in a row is one such pair, whatever the word). Distinct words are hashed once a slice."""
    words, at = words_of(text)
    names = words.dictionary.to_pylist()
    low = np.fromiter((xxhash.xxh3_64_intdigest(w.lower()) for w in names), np.uint64, len(names))
    outline = np.fromiter((xxhash.xxh3_64_intdigest(_shape(w), 1) for w in names), np.uint64, len(names))
    code = words.indices.to_numpy()
    n = len(code)
    if not n:
        return np.zeros(0, np.int32), np.zeros(len(text) + 1, np.int64)
    odd = np.uint64(0x9E3779B97F4A7C15)
    shift = np.uint64(64 - BITS)
    out = np.empty((n, 4), np.int32)
    last = np.zeros(n, bool)
    last[at[1:][np.diff(at) > 0] - 1] = True
    for k, h in enumerate((low[code], outline[code])):
        out[:, 2 * k] = (h * odd) >> shift
        after = np.roll(h, -1)
        after[last] = 0  # a text's last word pairs with its end
        pair = h * np.uint64(3) + after * np.uint64(7)
        if k:
            pair[twice] = np.uint64(11)
        else:
            twice = h == after
        out[:, 2 * k + 1] = (pair * odd) >> shift
    return out.reshape(-1), 4 * at


def _scale(n: np.ndarray) -> np.ndarray:
    return 4 / np.sqrt(np.maximum(n, 1))


def fit(sample: DataFrame, label: str = "quality", epochs: int = 3, alpha: float = 0.08, beta: float = 0.3, l1: float = 0.02, l2: float = 0.1) -> np.ndarray:
    """Weights (the last is the bias) from rows (order_key, text, label), a bounded sample.

    Tasks turn texts into sparse vectors; one task then takes them in the order of order_key and makes
    FTRL-proximal updates. Without rows the weights are 0 and every score is a half.
    """
    reachable(sample.sparkSession)

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, 1):
                flat, at = features(texts(b, 1))
                ids, values = [], []
                for i in range(len(at) - 1):
                    u, c = np.unique(flat[at[i] : at[i + 1]], return_counts=True)
                    ids.append(u.tobytes())
                    values.append((c * _scale(at[i + 1] - at[i])).astype(np.float32).tobytes())
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(2).cast(pa.int32()), pa.array(ids, pa.binary()), pa.array(values, pa.binary())], ["order_key", "label", "ids", "vals"])

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(y, np.frombuffer(i, np.int32), np.frombuffer(v, np.float32).astype(np.float64)) for b in batches for y, i, v in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
        size = (1 << BITS) + 1
        z, n = np.zeros(size), np.zeros(size)

        def weights(zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
            return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2))

        for _ in range(epochs):
            for y, i, v in rows:
                i, v = np.append(i, size - 1), np.append(v, 1.0)
                zi, ni = z[i], n[i]
                w = weights(zi, ni)
                p = 1 / (1 + np.exp(-np.clip(w @ v, -35, 35)))
                g = (p - y) * v
                g2 = g * g
                z[i] = zi + g - (np.sqrt(ni + g2) - np.sqrt(ni)) / alpha * w
                n[i] = ni + g2
        yield pa.RecordBatch.from_arrays([pa.array([weights(z, n).astype(np.float32).tobytes()], pa.binary())], ["w"])

    made = sample.mapInArrow(frugal(sparse), "order_key bigint, label int, ids binary, vals binary").repartition(1).sortWithinPartitions("order_key").mapInArrow(frugal(train), "w binary").collect()
    return np.frombuffer(bytes(made[0].w), np.float32) if made else np.zeros((1 << BITS) + 1, np.float32)


def held_out(id_col: str = "doc_id"):
    """crc32 of the id as text, modulo 5, is 0; rows without an id are never learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", sample_rows: int = 6000) -> np.ndarray:
    """Fit on at most `sample_rows` labelled rows that aren't held out, the ones whose ids hash lowest."""
    marks = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)).select(F.col(id_col), F.col(label).cast("int").alias("label"), F.xxhash64(id_col).alias("order_key"))
    chosen = marks.orderBy("order_key", id_col, "label").limit(sample_rows)
    rows = docs.select(id_col, "text").join(F.broadcast(chosen), id_col)  # bounded by sample_rows
    return fit(rows.select("order_key", "text", "label"), "label")


def _scores(text: pa.Array, w: np.ndarray) -> np.ndarray:
    """Each text's score. A text is summed by itself, so its score doesn't depend on what stands beside it."""
    flat, at = features(text)
    n = np.diff(at)
    sums = np.zeros(len(n))
    if n.any():
        sums[n > 0] = np.add.reduceat(w[flat], at[:-1][n > 0])
    return 1 / (1 + np.exp(-np.clip(sums * _scale(n) + w[-1], -500, 500)))


def accepted(docs: DataFrame, weights: np.ndarray, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows and columns of docs whose score reaches the threshold (a score equal to it stays), in one pass.

    Null and empty texts have the bias's score; repeated rows are judged alike; columns of any name stay; an
    empty table stays empty.
    """
    shared = reachable(docs.sparkSession).sparkContext.broadcast(weights)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value.astype(np.float64)
        for whole in batches:
            for b in slices(whole, at):
                yield b.filter(pa.array(_scores(texts(b, at), w) >= threshold))

    return docs.mapInArrow(frugal(run), docs.schema)


def score(docs: DataFrame, weights: np.ndarray, id_col: str = "doc_id", carry: list[str] | None = None) -> DataFrame:
    """Every row with its score between 0 and 1: the sparse dot product of its n-grams with the weights.

    One pass without a shuffle. Null and empty texts have no n-grams: their score is the bias's. Rows keep
    their number, repeated ids and null ids too; an empty table stays empty. `carry` names columns to
    keep besides id_col; one called score can't be, as the result has its own.
    """
    spark = reachable(docs.sparkSession)
    shared = spark.sparkContext.broadcast(weights)  # 2^BITS + 1 weights, whatever the input
    kept = [id_col, *(carry or [])]
    if "score" in (c.lower() for c in kept):
        raise ValueError("the result has a column score of its own")
    kinds = dict(docs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value.astype(np.float64)
        for whole in batches:
            for b in slices(whole, len(kept)):
                found = pa.array(_scores(texts(b, len(kept)), w))
                yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(kept))), found], [*kept, "score"])

    return docs.select(*kept, F.col("text").alias(fresh(kept, "_text")[0])).mapInArrow(frugal(run), ", ".join(f"`{c}` {kinds[c]}" for c in kept) + ", score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3_quality_classifier. A score of 0.3 exactly predicts 1."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score(docs, train(docs, labels)).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
