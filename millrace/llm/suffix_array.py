"""Repeated passages with sparse suffix arrays (operator 7).

Of all suffixes only those at content-selected places are kept: the minimisers of windows of `least`
words. A suffix comes with the words that its windows reach on both sides. Buckets sort suffixes by what
follows and by what precedes, compare neighbours, and extend matches left and right; a document's
matches are then joined, so a passage of any length comes out whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.arrowio import words_of
from millrace.llm.repeats import ANCHOR, by_row, merged, repeated_spans, replies

#: Words that a passage must have in common.
LEAST = 50


def _ordered(words: np.ndarray, begin: np.ndarray, step: int, length: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sort the sequences words[begin], words[begin + step], ... and compare neighbours: the order, and the
    number of words that each has in common with the one before it."""
    rows = np.zeros((len(begin), width), ">u4")
    for k in range(width):
        has = length > k
        rows[has, k] = words[begin[has] + k * step] + 1
    order = np.argsort(np.ascontiguousarray(rows).view(f"S{4 * width}").reshape(-1), kind="stable")
    rows = rows[order]
    same = (rows[1:] == rows[:-1]) & (rows[1:] != 0)
    common = np.where(same.all(1), width, np.argmin(same, 1)) if len(same) else np.zeros(0, np.int64)
    return order, np.concatenate([[0], common])[: len(begin)]


def passages(table: pa.Table, window: int) -> pa.Table:
    """Extend matches of retained suffixes left and right: all windows around them that come twice or more.

    Suffixes are sorted by what follows and, again, by what precedes (read backwards). For each
    number a of words to the left, sequences that agree in a words before and window - a words after
    are neighbours in both orders, so that two class numbers tell equal windows.
    """
    many = table.filter(pa.compute.is_null(table.column("first")))
    table = pa.concat_tables([table, many]).combine_chunks()
    coded, at = words_of(table.column("words").combine_chunks().cast(pa.string()))
    words = coded.indices.to_numpy().astype(np.int64)
    n = np.diff(at)
    left = table.column("anchor").to_numpy().astype(np.int64)
    right, p = n - left, at[:-1] + left
    by_right, common_right = _ordered(words, p, 1, right, window)
    reach = window - ANCHOR
    by_left, common_left = _ordered(words, p - 1, -1, left, max(reach, 1))
    out_piece, out_first = [], []
    r, q = np.empty(len(n), np.int64), np.empty(len(n), np.int64)
    for a in range(reach + 1):
        able = (left >= a) & (right >= window - a)
        if able.sum() < 2:
            continue
        r[by_right] = np.cumsum(common_right < window - a)
        q[by_left] = np.cumsum(common_left < a) if a else 0
        key = r * (len(n) + 1) + q
        which = np.flatnonzero(able)
        _, back, count = np.unique(key[which], return_inverse=True, return_counts=True)
        hit = which[count[back.reshape(-1)] > 1]
        out_piece.append(hit)
        out_first.append(left[hit] - a)
    piece = np.concatenate(out_piece) if out_piece else np.zeros(0, np.int64)
    first = np.concatenate(out_first) if out_first else np.zeros(0, np.int64)
    order = np.lexsort((first, piece))
    piece, first = piece[order], first[order]
    if len(piece):
        new = np.concatenate([[True], (piece[1:] != piece[:-1]) | (first[1:] > first[:-1] + 1)])
        last = np.append(np.flatnonzero(new)[1:], len(piece)) - 1
        return replies(table, piece[new], first[new], first[last] + window)
    return replies(table, piece, first, first)


def repeated_passages(docs: DataFrame, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each longest stretch of words of a document that is covered by sequences of `least`
    words found at another place of the corpus: id, first and end (words, end exclusive), n_words.

    Documents without one give no row, so null, empty and short texts give none. Words are separated by
    ASCII white space and unchanged. Rows of one id are told apart by their texts; a row that comes
    twice repeats all of its text.
    """
    rows, found = repeated_spans(docs, least, passages, id_col, text_col)
    grouped = by_row(found, id_col)
    names = [id_col, "first", "end", "n_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            both = [merged(s) for s in b.column(1).to_pylist()]
            row = np.repeat(np.arange(len(both)), [len(x) for x in both])
            flat = [y for x in both for y in x]
            first, end = (pa.array([y[k] for y in flat], pa.int64()) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), first, end, pa.compute.subtract(end, first)], names)

    return grouped.select(id_col, "spans").mapInArrow(run, f"`{id_col}` {dict(docs.dtypes)[id_col]}, first bigint, end bigint, n_words bigint")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7_suffix_array_dedup."""
    return repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", F.col("first").alias("first_word"), F.col("end").alias("end_word"), "n_words")
