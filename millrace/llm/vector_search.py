"""Exact top-k search with vector-approximation files (operator 5).

The file has two parts. The approximation, a table of blocks, says with one byte in which cell of its
block's grid each component lies. The exact whole numbers lie in flat files beside it, in the same order.
A search scans cells for bounds of the scores, then reads exact vectors in the order of their bounds
until the kth score is certain. Queries come in batches of a bounded size to where the blocks are; no
vector of the file is shuffled, only each task's best k of each query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.arrowio import materialised, reachable, shared_dir

_BLOCK = "block bigint, dim int, n bigint, ids binary, cells binary, low binary, step binary, file string, at bigint, width int"
#: Bytes of query vectors that one batch sends to the tasks.
BATCH_BYTES = 16 << 20
#: Blocks that a first look takes for a bound; it saves work and changes no result.
FIRST_LOOK = 32
#: Scores below this can't overflow; beyond it whole numbers of any size are used.
_SAFE = 1 << 62


def _usable(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """vec_id and the scaled whole numbers, without nulls, null components and non-finite ones."""
    v = F.col(vector_col)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) != F.lit(float("inf"))))
    return vectors.where(F.col(id_col).isNotNull() & v.isNotNull() & (F.size(v) > 0) & fine).select(F.col(id_col).cast("bigint").alias("vec_id"), F.transform(v, lambda x: F.floor(x.cast("double") * scale)).alias("v"))


def _matrix(batch: pa.RecordBatch, dim: np.ndarray, d: int) -> tuple[np.ndarray, np.ndarray]:
    rows = np.flatnonzero(dim == d)
    part = batch.column(1).take(pa.array(rows))
    return batch.column(0).to_numpy()[rows], part.flatten().to_numpy().astype(np.int64).reshape(-1, d)


def _store(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


def _packer(size: int, out: str):
    """Blocks of at most `size` vectors; a task writes their exact numbers into a file of its attempt's own name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        number = task.partitionId() << 32
        store, base = _store(out)
        store.create_dir(base, recursive=True)
        name = f"exact-{task.partitionId():06d}-{task.taskAttemptId()}.bin"
        held: dict[int, list] = {}
        count: dict[int, int] = {}

        def block(d: int, f) -> pa.RecordBatch:
            nonlocal number
            ids, exact = (np.concatenate(x) for x in zip(*held.pop(d), strict=True))
            count[d] = 0
            low, high = exact.min(0).astype(np.float64), exact.max(0).astype(np.float64)
            step = np.maximum((high - low) / 255, 1e-9)
            cells = np.clip(np.floor((exact - low) / step), 0, 255).astype(np.uint8)
            width = next(w for w in (2, 4, 8) if w == 8 or np.abs(np.array([low.min(), high.max()])).max() < 1 << (8 * w - 1))
            at = f.tell()
            f.write(exact.astype(f"<i{width}").tobytes())
            number += 1
            row = [number - 1, d, len(ids), ids.tobytes(), cells.tobytes(), low.tobytes(), step.tobytes(), name, at, width]
            kinds = [pa.int64(), pa.int32(), pa.int64(), *[pa.binary()] * 4, pa.string(), pa.int64(), pa.int32()]
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], ["block", "dim", "n", "ids", "cells", "low", "step", "file", "at", "width"])

        with store.open_output_stream(f"{base}/{name}") as f:
            for b in batches:
                dim = np.diff(b.column(1).offsets.to_numpy())
                for d in np.unique(dim).tolist():
                    ids, exact = _matrix(b, dim, d)
                    for k in range(0, len(ids), size):
                        held.setdefault(d, []).append((ids[k : k + size], exact[k : k + size]))
                        count[d] = count.get(d, 0) + len(ids[k : k + size])
                        if count[d] >= size:
                            yield block(d, f)
            for d in list(held):
                yield block(d, f)

    return run


class Index:
    """An approximation file: the folder of the exact vectors and the table of blocks."""

    def __init__(self, out: str, blocks: DataFrame):
        self.out, self.blocks = out, blocks


def build(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024, block: int = 4096) -> Index:
    """The approximation file of all usable vectors, written to the shared folder.

    Only blocks of committed tasks are in the table, so what a lost executor left is never read."""
    spark = reachable(vectors.sparkSession)
    out = shared_dir(spark, "va-exact")
    return Index(out, materialised(_usable(vectors, id_col, vector_col, scale).mapInArrow(_packer(block, out), _BLOCK), "va-file"))


class _Block:
    """A block's cells, and its exact vectors when they are asked for."""

    def __init__(self, row: dict, out: str):
        self.ids, d = np.frombuffer(row["ids"], np.int64), row["dim"]
        self.low, self.step = np.frombuffer(row["low"], np.float64), np.frombuffer(row["step"], np.float64)
        self.cells = np.frombuffer(row["cells"], np.uint8).reshape(-1, d)
        self.row, self.out, self.held = row, out, None

    def largest(self) -> float:
        return float(max(np.abs(self.low).max(), np.abs(self.low + 256 * self.step).max()))

    def exact(self, places: np.ndarray) -> np.ndarray:
        """Exact vectors. The block's stretch of the file is read when the first is needed."""
        if self.held is None:
            store, base = _store(self.out)
            size = self.row["width"] * self.cells.size
            with store.open_input_file(f"{base}/{self.row['file']}") as f:
                data = f.read_at(size, self.row["at"])
            self.held = np.frombuffer(data, f"<i{self.row['width']}").reshape(self.cells.shape)
        return self.held[places].astype(np.int64)

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """For each query and vector, a number that the score can't exceed: one product of single precision.

        The middle of the cell, half a cell's weight, and what rounding may lose."""
        w = q * self.step
        middle = (w.astype(np.float32) @ self.cells.T.astype(np.float32)).astype(np.float64)
        weight = np.abs(w).sum(1)
        slack = 0.5 * weight + (1e-5 + 1.2e-7 * len(self.low)) * (256 * weight + np.abs(q * self.low).sum(1)) + 1e-3
        return middle + (q @ self.low + 0.5 * w.sum(1) + slack)[:, None]


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, ~scores))[:k]
    return scores[order], ids[order]


def _search(k: int, out: str, asked, floor, step: int):
    """Each task's best k of each query, `step` queries at a time. `asked`: dim -> (ids, vectors); `floor`:
    query id -> a score that the kth surely reaches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = floor.value
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            for row in b.to_pylist():
                if row["dim"] not in asked.value:
                    continue
                names, vectors = asked.value[row["dim"]]
                block = _Block(row, out)
                for at in range(0, len(names), step):
                    q, name = vectors[at : at + step], names[at : at + step]
                    wide = float(np.abs(q.astype(np.float64)).max()) * block.largest() * row["dim"] >= _SAFE
                    upper = np.full((len(q), len(block.ids)), np.inf) if wide else block.bounds(q.astype(np.float64))
                    for i in range(len(q)):
                        one = int(name[i])
                        got = best.get(one, (np.zeros(0, np.int64), np.zeros(0, np.int64)))
                        kth = got[0][-1] if len(got[0]) >= k else -np.inf
                        kth = max(kth, known.get(one, -np.inf))
                        may = np.flatnonzero((upper[i] >= kth) & (block.ids != one))
                        if not len(may):
                            continue
                        may = may[np.argsort(-upper[i][may], kind="stable")]
                        done, width = 0, max(4 * k, 32)
                        while done < len(may) and upper[i][may[done]] >= kth:
                            part = may[done : done + width]
                            done, width = done + len(part), 2 * width
                            x = block.exact(part)
                            scores = np.array([max(-(1 << 63), min((1 << 63) - 1, int(s))) for s in x.astype(object) @ q[i].astype(object)], np.int64) if wide else x @ q[i]
                            got = _best(np.concatenate([got[0], scores]), np.concatenate([got[1], block.ids[part]]), k)
                            if len(got[0]) >= k:
                                kth = max(kth, got[0][-1])
                        best[one] = got
        if best:
            n = [len(s) for s, _ in best.values()]
            cols = [np.repeat(np.array(list(best), np.int64), n), np.concatenate([i for _, i in best.values()]), np.concatenate([s for s, _ in best.values()])]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["query_id", "vec_id", "score"])

    return run


_FOUND = "query_id bigint, vec_id bigint, score bigint"


def top_k(index: Index, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024, block: int = 512) -> DataFrame:
    """The k highest inner products of each query: query_id, rank, vec_id, score; ties to the smaller id.

    `block` queries are compared at a time. Queries are dealt by hash into batches of about BATCH_BYTES, and each batch meets every block where
    the block is. A first look at some blocks gives each query a score that its kth surely reaches; a
    task carries its own kth score from block to block. Rows with the query's own id take no part;
    several query rows of one id count as one (the least vector); repeated candidate rows each take a
    rank. Unusable vectors (null, null or non-finite components, no components) take no part, and
    vectors of another dimension don't meet. Components beyond 64 bits after scaling, and scores beyond
    them, are held at the ends of that range. Empty tables give no rows. Clashing columns aren't read.
    """
    spark = reachable(index.blocks.sparkSession)
    asked = materialised(_usable(queries, id_col, vector_col, scale).groupBy("vec_id").agg(F.min("v").alias("v")), "asked")
    size = asked.agg(F.sum(8 * F.size("v") + 8).alias("n")).first().n or 0
    turns = -(-size // BATCH_BYTES)
    blocks = index.blocks.count()
    some = index.blocks.where(F.pmod(F.xxhash64("block"), F.lit(max(1, blocks // FIRST_LOOK))) == 0)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")

    def found(turn: int) -> DataFrame:
        mine = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(turns)) == turn)
        by_dim: dict[int, list] = {}
        for r in mine.toLocalIterator():  # BATCH_BYTES, give or take the hash's spread
            by_dim.setdefault(len(r.v), []).append((r.vec_id, r.v))
        sent = spark.sparkContext.broadcast({d: (np.array([i for i, _ in rows], np.int64), np.array([v for _, v in rows], np.int64)) for d, rows in by_dim.items()})
        floor: dict[int, int] = {}
        if blocks >= 2 * FIRST_LOOK:
            first = some.mapInArrow(_search(k, index.out, sent, spark.sparkContext.broadcast({}), block), _FOUND)
            kth = first.withColumn("rank", F.row_number().over(order)).where(F.col("rank") == k).select("query_id", "score")
            floor = {r.query_id: r.score for r in kth.toLocalIterator()}  # a number a query
        return index.blocks.mapInArrow(_search(k, index.out, sent, spark.sparkContext.broadcast(floor), block), _FOUND)

    if turns <= 1:
        every = found(0) if turns else spark.createDataFrame([], _FOUND)
    else:
        path = shared_dir(spark, "top-k")
        for turn in range(turns):
            found(turn).write.mode("append").parquet(path)
        every = spark.read.schema(_FOUND).parquet(path)
    return every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5_exact_top_k."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(build(vectors), vectors.where(F.col("vec_id") % 100 == 0))
