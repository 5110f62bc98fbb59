"""Arrow plumbing shared by the corpus operators: bounded slices and worker paths."""

from __future__ import annotations

import ctypes
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Text bytes that one vectorised step holds; bounds a worker's memory for any Arrow batch size.
SLICE_BYTES = 3 << 20


def reachable(spark: SparkSession) -> SparkSession:
    """Put this package on the Python path of the executors' workers."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH") or os.environ.get("PYTHONPATH", "")
    if root not in have.split(":"):
        env["PYTHONPATH"] = f"{root}:{have}" if have else root
    return spark


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir, which driver and executors share. Where that is unset, one
    machine (a local master, as in tests) gets a folder of its own and a cluster an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = f"file://{tempfile.gettempdir()}/checkpoints"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def fresh(taken: Iterable[str], *wanted: str) -> list[str]:
    """Names like the wanted ones that no column has, whatever the case of its letters."""
    have = {c.lower() for c in taken}
    out = []
    for name in wanted:
        while name.lower() in have:
            name += "_"
        have.add(name.lower())
        out.append(name)
    return out


def materialised(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: lineage ends, executors may go."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def path_of(df: DataFrame) -> str:
    """The folder from which a materialised frame is read."""
    return re.sub(r"/[^/]*$", "", df.inputFiles()[0]) if df.inputFiles() else ""


@cache
def _trim() -> Callable[[int], int] | None:
    """The C library's way to return free memory, where it has one."""
    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Return memory that Arrow and the C library hold free: a worker lives on after its task, and what one task needed
    for a moment would count beside all that comes after."""
    pa.default_memory_pool().release_unused()
    if trim := _trim():
        trim(0)


def frugal(run: Callable) -> Callable:
    """A function for mapInArrow that gives its memory back when its task's rows are through."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return wrapped


def frugal_group(run: Callable) -> Callable:
    """A function for applyInArrow that gives its memory back after each group that is not small."""

    def wrapped(table: pa.Table) -> pa.Table:
        out = run(table)
        if table.nbytes > SLICE_BYTES // 8:
            give_back()
        return out

    return wrapped


def slices(batch: pa.RecordBatch, column: int | str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows of at most `limit` text bytes; a longer row makes a run of its own. After each, free memory is given back."""
    if not batch.num_rows:
        return
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(size)
    at, n = 0, batch.num_rows
    while at < n:
        base = ends[at - 1] if at else 0
        upto = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(at, upto - at)
        give_back()
        at = upto


def texts(batch: pa.RecordBatch, column: str = "text") -> pa.Array:
    """The text column without nulls: a null text counts as empty."""
    got = batch.column(column)
    if pa.types.is_large_string(got.type):
        got = got.cast(pa.string())
    return pc.fill_null(got, "") if got.null_count else got


def flat_bytes(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string array without nulls in one run, and where each text's begin."""
    at = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1] if len(text) else np.zeros(1, np.int32)
    data = np.frombuffer(text.buffers()[2], np.uint8) if len(text) and text.buffers()[2] else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], (at - at[0]).astype(np.int64)


def split_words(text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words [^\\x20\\x09-\\x0D]+ of all texts, and each text's first word's place."""
    parts = pc.ascii_split_whitespace(text)
    flat, offsets = parts.flatten(), parts.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    keep = pc.not_equal(pc.binary_length(flat), 0)
    if not pc.all(keep).as_py() and len(flat):
        before = np.concatenate([[0], np.cumsum(keep.to_numpy(zero_copy_only=False))])
        flat, offsets = flat.filter(keep), before[offsets]
    return flat, offsets


def words_of(text: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The same words as one dictionary array."""
    flat, offsets = split_words(text)
    return coded(flat), offsets


def coded(flat: pa.Array) -> pa.DictionaryArray:
    return flat.dictionary_encode() if len(flat) else pa.array([], pa.string()).dictionary_encode()


def spans_to_places(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenated ranges start, start + 1, ... of the given lengths."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = starts - (np.cumsum(lengths) - lengths)
    return np.repeat(shift, lengths) + np.arange(total, dtype=np.int64)


def binary_array(flat: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Binary values that are pieces of one byte buffer."""
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(flat))])
