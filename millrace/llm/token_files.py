"""Token-ID binary output (operator 8): flat unsigned integer files with 64-bit document offsets.

A folder holds, for each part in ascending order of documents,
  <part>.bin   the ids, little-endian unsigned, 16 bits wide if the vocabulary allows, else 32
  <part>.off   unsigned 64-bit: for each document the place of its first id in the whole corpus,
               then the place after the part's last id
  <part>.ids   the document ids (Arrow file)
and manifest.json, which lists the committed parts. A part's base is the prefix sum of the parts
before it. Readers map the files into memory, or read ranges of them where the store can't be mapped.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from millrace.llm.arrowio import reachable, shared_dir, slices, texts
from millrace.llm.tokens import encoder

#: Offsets that are moved at once.
AT_ONCE = 1 << 20


def _store(uri: str):
    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


class _Numbers:
    """A file's numbers by range: mapped into memory where the store is a mounted file system, else
    each range is read by itself, so that no part is held whole."""

    def __init__(self, uri: str, dtype: str) -> None:
        store, path = _store(uri)
        self.dtype, self.map, self.file = np.dtype(dtype), None, None
        if store.get_file_info(path).size == 0:
            self.map = np.zeros(0, dtype)
        elif isinstance(store, fs.LocalFileSystem):
            self.map = np.memmap(path, dtype, "r")
        else:
            self.file = store.open_input_file(path)
        self.length = len(self.map) if self.file is None else self.file.size() // self.dtype.itemsize

    def __len__(self) -> int:
        return self.length

    def range(self, first: int, end: int) -> np.ndarray:
        if self.file is None:
            return self.map[first:end]
        width = self.dtype.itemsize
        return np.frombuffer(self.file.read_at((end - first) * width, first * width), self.dtype)


def write(docs: DataFrame, out: str, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> dict:
    """Encode whole texts and write them in ascending order of id_col; returns the manifest.

    One range shuffle of the texts sorts the documents (nulls first; equal ids by a hash of the
    text, so that one hot id spreads over parts). Each task streams into files of its own attempt's
    name, so a rerun after a lost executor can't mix with what it left; only committed attempts
    reach the manifest. Null text: empty, that is, the end id alone. An empty table gives no parts.
    """
    spark = reachable(docs.sparkSession)
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(id_col).asc_nulls_first(), F.xxhash64(F.col(text_col)).asc()]
    dealt = docs.select(id_col, text_col).repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    id_name = id_col

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, task = encoder(path, "byte"), TaskContext.get()
        dtype = np.dtype("<u2" if enc.flat.dtype == np.uint16 and end_id < 1 << 16 else "<u4")
        store, base = _store(out)
        store.create_dir(base, recursive=True)
        name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}"
        ids_of, ends, at = [], [np.zeros(1, np.uint64)], 0
        with store.open_output_stream(f"{base}/{name}.bin") as f:
            for whole in batches:
                for b in slices(whole, 1):
                    ids, first = enc.encode(texts(b, 1))
                    flat = np.insert(ids.astype(dtype), first[1:], end_id)
                    f.write(flat.tobytes())
                    ends.append((at + first[1:] + np.arange(1, len(first))).astype(np.uint64))
                    at += len(flat)
                    ids_of.append(b.column(0))
        if not ids_of:
            store.delete_file(f"{base}/{name}.bin")
            return
        with store.open_output_stream(f"{base}/{name}.local") as f:
            f.write(np.concatenate(ends).astype("<u8").tobytes())
        table = pa.table({id_name: pa.chunked_array(ids_of)})
        with store.open_output_stream(f"{base}/{name}.ids") as f, pa.ipc.new_file(f, table.schema) as w:
            w.write_table(table)
        yield pa.RecordBatch.from_pylist([{"part": task.partitionId(), "name": name, "tokens": at, "docs": len(table), "width": dtype.itemsize}])

    made = sorted(dealt.mapInArrow(run, "part bigint, name string, tokens bigint, docs bigint, width bigint").collect())  # one row a part
    bases = np.concatenate([[0], np.cumsum([r.tokens for r in made])]).astype(np.int64)
    manifest = {"end_id": end_id, "id_type": dict(docs.dtypes)[id_col], "id_col": id_col, "parts": [r.asDict() | {"base": int(b)} for r, b in zip(made, bases, strict=False)]}

    def shift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _store(out)
        for b in batches:
            for r in b.to_pylist():
                local = _Numbers(f"{out}/{r['name']}.local", "<u8")
                tmp = f"{base}/{r['name']}.off-{TaskContext.get().taskAttemptId()}"
                with store.open_output_stream(tmp) as f:
                    for k in range(0, len(local), AT_ONCE):
                        f.write((local.range(k, min(k + AT_ONCE, len(local))) + np.uint64(r["base"])).astype("<u8").tobytes())
                store.move(tmp, f"{base}/{r['name']}.off")
            yield b

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _store(out)
        for b in batches:
            for r in b.to_pylist():
                if store.get_file_info(f"{base}/{r['name']}.local").type == fs.FileType.File:
                    store.delete_file(f"{base}/{r['name']}.local")
            yield b

    if made:  # local offsets go once all parts have theirs: a shift that is run again still finds them
        for step in (shift, tidy):
            _parts(spark, manifest).mapInArrow(step, "name string, base bigint, width bigint").count()
    store, base = _store(out)
    store.create_dir(base, recursive=True)
    with store.open_output_stream(f"{base}/manifest.json") as f:
        f.write(json.dumps(manifest).encode())
    return manifest


def _parts(spark: SparkSession, manifest: dict) -> DataFrame:
    rows = [Row(name=p["name"], base=p["base"], width=p["width"]) for p in manifest["parts"]]
    return spark.createDataFrame(rows, "name string, base bigint, width bigint").repartition(max(1, len(rows)))


def read(spark: SparkSession, out: str, ids: bool = False) -> DataFrame:
    """Documents of a folder: id, start, n_tokens, ids_crc32 (of little-endian unsigned 32-bit ids),
    and the ids themselves on demand. One task a part; files are mapped or read by ranges, not loaded."""
    reachable(spark)
    store, base = _store(out)
    with store.open_input_file(f"{base}/manifest.json") as f:
        manifest = json.loads(f.read())
    name = manifest["id_col"]
    schema = f"`{name}` {manifest['id_type']}, start bigint, n_tokens bigint, ids_crc32 bigint" + (", ids array<int>" if ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                flat, off = _Numbers(f"{out}/{r['name']}.bin", f"<u{r['width']}"), _Numbers(f"{out}/{r['name']}.off", "<u8")
                st, p = _store(out)
                with st.open_input_file(f"{p}/{r['name']}.ids") as f:
                    of = pa.ipc.open_file(f).read_all().column(0).combine_chunks()
                for at in range(0, len(of), 5000):
                    upto = min(at + 5000, len(of))
                    x = off.range(at, upto + 1).astype(np.int64)
                    wide = memoryview(np.ascontiguousarray(flat.range(int(x[0]) - r["base"], int(x[-1]) - r["base"]), "<u4")).cast("B")
                    z = (x - x[0]).tolist()
                    part = of.slice(at, upto - at)
                    part = part.combine_chunks() if isinstance(part, pa.ChunkedArray) else part
                    cols = [part, pa.array(x[:-1]), pa.array(np.diff(x)), pa.array([zlib.crc32(wide[4 * i : 4 * j]) for i, j in zip(z, z[1:], strict=False)], pa.int64())]
                    if ids:
                        cols.append(pa.array([np.frombuffer(wide[4 * i : 4 * j], "<u4").astype(np.int32) for i, j in zip(z, z[1:], strict=False)], pa.list_(pa.int32())))
                    yield pa.RecordBatch.from_arrays(cols, [name, "start", "n_tokens", "ids_crc32", "ids"][: len(cols)])

    return _parts(spark, manifest).mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8_token_files."""
    import public_tokenizers

    out = shared_dir(spark, "token-files")
    write(spark.read.parquet(f"{sf_dir}/documents.parquet"), out, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return read(spark, out)
