"""Embeddings from the corpus itself: truncated singular value decomposition of the table of documents and words.

Words are hashed to CELLS columns, weighed by (1 + ln tf) * idf, rows of unit length. The leading right singular
vectors come from a randomised range finder: each pass multiplies the table's Gram matrix with a thin block, a task
adding up its documents' part, so what is shuffled and gathered is a block of CELLS rows, whatever the corpus.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.text import tokens
from millrace.sources.scratch import written

#: Columns that words are hashed into.
CELLS = 1 << 13
#: Words and rows that are multiplied at a time.
HELD, ROWS = 1 << 17, 256


@dataclass
class Factors:
    """idf by cell, right singular vectors by cell, singular values, from the largest."""

    idf: np.ndarray
    basis: np.ndarray
    values: np.ndarray


def cells(text: Column, size: int = CELLS) -> Column:
    return F.transform(tokens(text), lambda w: F.pmod(F.xxhash64(w), F.lit(size)).cast("int"))


def _parts(flat: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """Stretches of at most ROWS rows and about HELD words: first row, row after the last, their words."""
    ends = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        begun = ends[at] - sizes[at]
        to = max(at + 1, min(at + ROWS, int(np.searchsorted(ends, begun + HELD, "right"))))
        yield at, to, flat[begun : ends[to - 1]]
        at = to


def _weighed(words: np.ndarray, sizes: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The cells that some of the rows have, and the rows' weights in these cells; a row's weights have length 1."""
    size = len(idf)
    key, tf = np.unique(np.repeat(np.arange(len(sizes)), sizes) * size + words, return_counts=True)
    row, cell = key // size, key % size
    w = (1 + np.log(tf)) * idf[cell]
    length = np.sqrt(np.bincount(row, w * w, len(sizes)))
    have = np.zeros(size, bool)
    have[cell] = True
    out = np.zeros((len(sizes), int(have.sum())))
    out[row, (np.cumsum(have) - 1)[cell]] = w / np.where(length > 0, length, 1)[row]
    return np.flatnonzero(have), out


def _gram_times(table: DataFrame, idf: np.ndarray, block: np.ndarray) -> np.ndarray:
    """The table's transpose times the table times block. table has the one column `cells`."""
    sent = table.sparkSession.sparkContext.broadcast((idf, block))  # CELLS rows
    width = block.shape[1]
    names = [f"v{i}" for i in range(width)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, block = sent.value
        total = np.zeros_like(block)
        for b in batches:
            lists = b.column(0)
            sizes, flat = np.diff(lists.offsets.to_numpy().astype(np.int64)), lists.flatten().to_numpy()
            for at, to, words in _parts(flat, sizes):
                used, rows = _weighed(words, sizes[at:to], idf)
                total[used] += rows.T @ (rows @ block[used])
        used = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), *(pa.array(total[used, i]) for i in range(width))], ["cell", *names])

    sums = table.mapInArrow(run, "cell int, " + ", ".join(f"{n} double" for n in names)).groupBy("cell").agg(*[F.sum(n).alias(n) for n in names])
    got, out = sums.toArrow(), np.zeros_like(block)
    out[got.column("cell").to_numpy()] = np.stack([got.column(n).to_numpy() for n in names], axis=1) if got.num_rows else 0
    sent.destroy()
    return out


def fit(docs: DataFrame, rank: int = 64, text: str = "text", size: int = CELLS, more: int = 16, rounds: int = 2, seed: int = 11) -> Factors:
    """Factors of all documents; null texts and texts without words count for nothing. `more` columns beyond rank and
    `rounds` passes sharpen the range; one more pass gives values and vectors within it. An empty corpus has rank 0."""
    table = written(docs.where(F.col(text).isNotNull()).select(cells(F.col(text), size).alias("cells")).where(F.size("cells") > 0), "cells")
    n, df = table.count(), np.zeros(size)
    for r in table.select(F.explode(F.array_distinct("cells")).alias("cell")).groupBy("cell").count().collect():  # size rows at most
        df[r["cell"]] = r["count"]
    idf = np.log(1 + n / np.maximum(df, 1))
    block = np.random.default_rng(seed).standard_normal((size, min(size, rank + more)))
    for _ in range(rounds):
        block = np.linalg.qr(_gram_times(table, idf, block))[0]
    inside = block.T @ _gram_times(table, idf, block)
    values, turn = np.linalg.eigh((inside + inside.T) / 2)
    best = np.argsort(-values, kind="stable")[:rank]
    best = best[values[best] > 1e-9 * max(values.max(), 1e-9)]
    basis = block @ turn[:, best]
    basis *= np.sign(basis[np.abs(basis).argmax(axis=0), np.arange(len(best))]) if len(best) else 1
    return Factors(idf, basis, np.sqrt(values[best]))


def embedding(spark: SparkSession, model: Factors) -> Callable[[Column], Column]:
    """A column function text -> array<float> of unit length, of zeros for texts without (known) words, also null."""
    sent = spark.sparkContext.broadcast((model.idf, model.basis))  # CELLS rows

    @F.pandas_udf("array<float>")
    def project(words: pd.Series) -> pd.Series:
        idf, basis = sent.value
        sizes = np.array([len(x) for x in words], np.int64)
        flat = np.concatenate([np.asarray(x, np.int64) for x in words]) if sizes.sum() else np.zeros(0, np.int64)
        out = np.zeros((len(words), basis.shape[1]))
        for at, to, part in _parts(flat, sizes):
            used, rows = _weighed(part, sizes[at:to], idf)
            out[at:to] = rows @ basis[used]
        length = np.sqrt((out * out).sum(axis=1, keepdims=True))
        return pd.Series(list((out / np.where(length > 1e-9, length, np.inf)).astype(np.float32)))

    return lambda text: project(F.coalesce(cells(text, len(model.idf)), F.array().cast("array<int>")))
