"""Byte-level BPE encoding and decoding (operator 10)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from millrace.llm.arrowio import reachable, slices, texts
from millrace.llm.tokens import ByteTable, encoder

_TABLES: dict[str, ByteTable] = {}


def _tools(path: str):
    enc = encoder(path, "byte")
    if path not in _TABLES:
        _TABLES[path] = ByteTable(enc)
    return enc, _TABLES[path]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", offsets: bool = False) -> DataFrame:
    """Token ids of every whole text, one row a document, in a single pass without a shuffle.

    Returns id_col, ids (array of int) and, with `offsets`, starts and ends: the code points that
    each id covers (an id that holds part of a character covers that character). A null text
    counts as empty and gives no ids; null and repeated ids are kept as they are; other columns
    are left behind.
    """
    spark = reachable(docs.sparkSession)  # noqa: F841
    schema = f"`{id_col}` {dict(docs.dtypes)[id_col]}, ids array<int>" + (", starts array<int>, ends array<int>" if offsets else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, table = _tools(path)
        for whole in batches:
            for b in slices(whole, 1):
                ids, at = enc.encode(texts(b, 1))
                cols = [b.column(0), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(np.int32)))]
                if offsets:
                    each = [table.spans(ids[at[i] : at[i + 1]]) for i in range(len(at) - 1)]
                    cols += [pa.array([x[k] for x in each], pa.list_(pa.int32())) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays(cols, [id_col, "ids", "starts", "ends"][: len(cols)])

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def decode(rows: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id_col and data: the bytes that the ids stand for, through the reversed byte table."""
    reachable(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, table = _tools(path)
        for b in batches:
            lists = b.column(1).fill_null([]) if b.column(1).null_count else b.column(1)
            at = lists.offsets.to_numpy().astype(np.int64)
            data, ends = table.decode(lists.flatten().to_numpy(), at - at[0])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([data[x:y].tobytes() for x, y in zip(ends, ends[1:], strict=False)], pa.binary())], [id_col, "data"])

    return rows.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {dict(rows.dtypes)[id_col]}, data binary")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Encode, decode, and digest both: doc_id, n_tokens, ids_sha256 (little-endian unsigned 32-bit
    ids), decoded_sha256 (the bytes that the ids give back). Null text: empty."""
    reachable(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, table = _tools(path)
        for whole in batches:
            for b in slices(whole, 1):
                ids, at = enc.encode(texts(b, 1))
                data, ends = table.decode(ids, at)
                wide = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
                data = memoryview(data)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0),
                        pa.array(np.diff(at)),
                        pa.array([hashlib.sha256(wide[4 * x : 4 * y]).hexdigest() for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.string()),
                        pa.array([hashlib.sha256(data[x:y]).hexdigest() for x, y in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], pa.string()),
                    ],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10_byte_bpe."""
    import public_tokenizers

    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
