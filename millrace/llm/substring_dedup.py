"""Substring dedup by super-k-mer partitioning (operator 1)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.arrowio import fresh, frugal, materialised, slices, texts, words_of
from millrace.llm.hashing import mixed, window_hashes
from millrace.llm.repeats import by_row, merged, repeated_spans, replies, runs

WINDOW = 35


def count_windows(table: pa.Table, window: int) -> pa.Table:
    """Sort the windows of a bucket's super-k-mers; those that come twice are repeated. Sorting goes by
    hash; neighbours of one hash are then compared word by word."""
    words, at = words_of(table.column("words").combine_chunks().cast(pa.string()))
    code = words.indices.to_numpy().astype(np.int64)
    n = np.diff(at)
    piece = np.repeat(np.arange(len(n)), n)
    starts = np.flatnonzero(np.arange(len(code)) + window <= at[1:][piece]) if len(code) else np.zeros(0, np.int64)
    of = piece[starts]
    key = window_hashes(mixed(code.astype(np.uint64) + np.uint64(1)), window)[starts]
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    near = np.flatnonzero(same)
    for k in range(0, len(near), 100_000):
        i, j = starts[order[near[k : k + 100_000]]], starts[order[near[k : k + 100_000] + 1]]
        differ = np.zeros(len(i), bool)
        for x in range(window):
            differ |= code[i + x] != code[j + x]
        if differ.any():  # two sequences of one hash: name windows by their words instead
            every = np.unique(order[np.concatenate([near, near + 1])])
            rows = np.lib.stride_tricks.sliding_window_view(code, window)[starts[every]]
            key = np.arange(len(starts), dtype=np.uint64) + np.uint64(len(starts))
            key[every] = np.unique(rows, axis=0, return_inverse=True)[1].reshape(-1).astype(np.uint64)
            order = np.argsort(key, kind="stable")
            same = key[order][1:] == key[order][:-1]
            break
    hit = np.zeros(len(starts), bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    first, last = runs(hit, of)
    base = at[:-1][of[first]] if len(first) else first
    return replies(table, of[first], starts[first] - base, starts[last] + window - base)


def _with_marks(table: pa.Table, window: int) -> pa.Table:
    """Pieces without a place stand for two or more: they count as two."""
    many = table.filter(pa.compute.is_null(table.column("first")))
    return count_windows(pa.concat_tables([table, many]).combine_chunks(), window)


def spans(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text_key and sorted spans (first word, end) of rows with a window that starts elsewhere too."""
    _, found = repeated_spans(docs, window, _with_marks, id_col, text_col)
    return by_row(found, id_col)


def _rewritten(docs: DataFrame, window: int, names: list[str], run, schema) -> DataFrame:
    """run over the named columns and, last, the spans of each row."""
    own, r_id, key, marked = fresh(docs.columns, "_own", "_id", "_key", "_spans")
    marks = materialised(spans(docs, window).select(F.col("doc_id").alias(r_id), F.col("text_key").alias(key), F.col("spans").alias(marked)), "repeated-spans")
    with_key = docs.select(*names, F.xxhash64("text").alias(own))
    both = with_key.join(marks, F.col("doc_id").eqNullSafe(F.col(r_id)) & (F.col(own) == F.col(key)), "left").select(*names, marked)
    return both.mapInArrow(frugal(run), schema)


def _kept_words(text: bytes, spans: list[dict] | None) -> tuple[list[bytes], int]:
    words = text.split()
    if not spans:
        return words, len(words)
    out, done = [], 0
    for a, z in merged(spans):
        out += words[done:a]
        done = z
    return out + words[done:], len(words)


def digest(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Remove each word covered by a window of `window` words that also starts anywhere else.

    Windows are judged on the input, never on what is left; words are separated by ASCII white space
    and taken unchanged. Returns doc_id, n_words, n_removed and kept_sha256 (the kept words joined by
    one blank). Null text has no words; rows of one id are told apart by their texts; a row that
    comes twice is a copy of itself, and all its windows are repeated. No rows give no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, 1):
                out = [_kept_words(t, s) for t, s in zip(texts(b, 1).cast(pa.binary()).to_pylist(), b.column(2).to_pylist(), strict=True)]
                n = [x for _, x in out]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array(n, pa.int64()), pa.array([x - len(w) for w, x in out], pa.int64()), pa.array([hashlib.sha256(b" ".join(w)).hexdigest() for w, _ in out], pa.string())],
                    ["doc_id", "n_words", "n_removed", "kept_sha256"],
                )

    return _rewritten(docs, window, ["doc_id", "text"], run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_words bigint, n_removed bigint, kept_sha256 string")


def remove(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """The same rows and columns with the repeated words gone from the text; texts that lose none stay
    as they are, others have their kept words joined by one blank. n_chars, where there is one, follows."""
    names = docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, at):
                old = b.column(at).to_pylist()
                new = [t if not s else b" ".join(_kept_words(t.encode(), s)[0]).decode() for t, s in zip(old, b.column(len(names)).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(new, pa.string()) if i == at else b.column(i) for i in range(len(names))], names)

    out = _rewritten(docs, window, names, run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in names else out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1_substring_dedup."""
    return digest(spark.read.parquet(f"{sf_dir}/documents.parquet"))
