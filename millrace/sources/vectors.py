"""A stored vector index: rows lie in folders by cluster, and a cluster's ball bounds what its vectors can score.

For a query q and a vector x within r of a centre c, q.x is at most q.c + |q| r. A search scores each query's most
promising clusters first; the kth best score found there rules out the clusters whose bound is lower, so the result is
that of a scan. Filter columns lie beside the vectors, so a filter is pushed into the reading of the folders.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import search
from millrace.sources.scratch import written
from millrace.sources.store import Versions

#: Vectors that the centres are fitted on, at most; vectors that a folder holds, about; folders at most (a row of centres each on the driver).
SAMPLE, FOLDER, CENTRES = 20_000, 50_000, 4096


def centres_of(sample: np.ndarray, n: int, rounds: int = 12) -> np.ndarray:
    """Lloyd's algorithm from evenly spread rows; a centre that loses all its vectors takes the farthest one."""
    centre = sample[np.linspace(0, len(sample) - 1, n).astype(int)].copy()
    for _ in range(rounds):
        far = (sample**2).sum(1)[:, None] - 2 * sample @ centre.T + (centre**2).sum(1)
        mine = far.argmin(1)
        size = np.bincount(mine, minlength=n)
        total = np.zeros_like(centre)
        np.add.at(total, mine, sample)
        centre[size > 0] = total[size > 0] / size[size > 0, None]
        for empty, lost in zip(np.flatnonzero(size == 0), np.argsort(-far.min(1)), strict=False):
            centre[empty] = sample[lost]
    return centre


def nearest(v: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each vector the nearest centre and its distance."""
    mine, out = np.zeros(len(v), np.int64), np.zeros(len(v))
    for at in range(0, len(v), step := max(1, search.HELD_SCORES // len(centre))):
        part = v[at : at + step]
        far = (part**2).sum(1)[:, None] - 2 * part @ centre.T + (centre**2).sum(1)
        mine[at : at + step] = far.argmin(1)
        out[at : at + step] = np.sqrt(((part - centre[mine[at : at + step]]) ** 2).sum(1))
    return mine, out


class VectorIndex(Versions):
    """Vectors of one length with their filter columns below a path.

    Vectors that are null, of another length or not all finite aren't indexed. Ids may repeat; replaced and removed
    ids are listed beside the parts until compact().
    """

    def __init__(self, spark: SparkSession, path: str, id_col: str = "vec_id", vector_col: str = "embedding", columns: Sequence[str] = (), folder: int = FOLDER):
        super().__init__(spark, path)
        self.id_col, self.vector_col, self.columns, self.folder = id_col, vector_col, list(columns), folder

    def _schema(self, manifest: dict) -> str:
        return f"{manifest['schema']}, cluster int"

    # writing
    def build(self, rows: DataFrame) -> str:
        """A version with these rows alone. Centres are fitted on at most SAMPLE vectors, the first by a hash of the id; every row is indexed."""
        base = self._state()[0] if self.current() else 0
        rows = rows.select(self.id_col, self.vector_col, *self.columns)
        length = rows.where(F.size(self.vector_col) > 0).groupBy(F.size(self.vector_col).alias("n")).count().orderBy(F.col("count").desc(), "n").first()
        size = length.n if length else 1
        sample = rows.where(F.size(self.vector_col) == size).orderBy(F.xxhash64(self.id_col)).limit(SAMPLE).select(F.col(self.vector_col).cast("array<double>").alias("v")).toArrow()["v"].combine_chunks()
        found = list(search._by_length(sample))
        sample = found[0][2] if found else np.zeros((0, size))
        n = min(CENTRES, len(sample), max(1, -(-(length["count"] if length else 0) // self.folder)))
        centre = centres_of(sample, n) if n else np.zeros((1, size))
        manifest = {"schema": ", ".join(f"`{c}` {t}" for c, t in rows.dtypes), "centres": centre.tolist(), "parts": [], "gone": []}
        return self._next(base, self._with(manifest, rows))

    def _with(self, manifest: dict, rows: DataFrame) -> dict:
        """The manifest with these rows as one more part, and each cluster's radius and rows."""
        centre, folder = np.array(manifest["centres"]), f"part-{uuid.uuid4().hex}"
        sent = self.spark.sparkContext.broadcast(centre)  # CENTRES rows at most
        at, names = rows.columns.index(self.vector_col), rows.columns

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                b = b.filter(pc.is_valid(b.column(at)))
                for n, which, v in search._by_length(b.column(at)) if b.num_rows else ():
                    if n == sent.value.shape[1]:
                        mine, far = nearest(v, sent.value)
                        kept = b.take(pa.array(which))
                        yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(mine.astype(np.int32)), pa.array(far)], [*names, "cluster", "far"])

        placed = written(rows.mapInArrow(run, ", ".join(f"`{c}` {t}" for c, t in rows.dtypes) + ", cluster int, far double"), "placed")
        balls = placed.groupBy("cluster").agg(F.max("far").alias("far"), F.count(F.lit(1)).alias("n")).collect()  # a row a centre
        if not balls:
            return manifest
        # a cluster of many rows is dealt over several tasks, which write into its folder
        spread = F.pmod(F.xxhash64(self.id_col), F.element_at(F.create_map(*[x for r in balls for x in (F.lit(r.cluster), F.lit(-(-r.n // self.folder)))]), F.col("cluster"))) if len(balls) <= 256 else F.pmod(F.xxhash64(self.id_col), F.lit(max(1, max(r.n for r in balls) // self.folder)))
        placed.drop("far").withColumn("_spread", spread).repartition("cluster", "_spread").drop("_spread").write.partitionBy("cluster").parquet(f"{self.path}/{folder}")
        return manifest | {"parts": [*manifest["parts"], {"folder": folder, "balls": [[r.cluster, r.far, r.n] for r in balls]}]}

    def upsert(self, rows: DataFrame) -> str:
        """Rows replace those of their ids; what is written is these rows and their ids."""
        if not self.current():
            return self.build(rows)
        base, manifest = self._state()
        rows = rows.select(self.id_col, self.vector_col, *self.columns)
        return self._next(base, self._with(self._without(manifest, rows), rows))

    def delete(self, ids: DataFrame) -> str:
        base, manifest = self._state()
        return self._next(base, self._without(manifest, ids))

    def _without(self, manifest: dict, ids: DataFrame) -> dict:
        folder = f"gone-{uuid.uuid4().hex}"
        ids.select(self.id_col).distinct().write.parquet(f"{self.path}/{folder}")
        return manifest | {"gone": [*manifest["gone"], {"folder": folder, "before": len(manifest["parts"])}]}

    def compact(self) -> str:
        """One part of all that is there, around centres fitted anew."""
        return self.build(self.read())

    # reading
    def _part(self, manifest: dict, number: int) -> DataFrame:
        rows = self.spark.read.schema(self._schema(manifest)).parquet(f"{self.path}/{manifest['parts'][number]['folder']}").withColumn("part", F.lit(number))
        lost = [self.spark.read.parquet(f"{self.path}/{g['folder']}") for g in manifest["gone"] if g["before"] > number]
        if lost:
            ids = reduce(DataFrame.unionByName, lost).select(F.col(self.id_col).alias("gone_id"))
            rows = rows.join(ids, F.col(self.id_col).eqNullSafe(F.col("gone_id")), "left_anti")
        return rows

    def read(self) -> DataFrame:
        _, manifest = self._state()
        parts = [self._part(manifest, i) for i in range(len(manifest["parts"]))]
        return (reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], f"{self._schema(manifest)}, part int")).drop("cluster", "part")

    def search(self, queries: DataFrame, k: int, wanted: Column | None = None, digits: int = 6, exclude_self: bool = False) -> DataFrame:
        """q_id, id, sim and rk, the same rows as retrieval.dense gives for the indexed vectors; queries has q_id and q.

        Queries come in batches of a bounded size. `reads` afterwards says which share of the (query, cluster) pairs was scored.
        """
        _, manifest = self._state()
        centre, kind = np.array(manifest["centres"]), dict(self.spark.createDataFrame([], manifest["schema"]).dtypes)[self.id_col]
        balls = [(p, *b) for p, part in enumerate(manifest["parts"]) for b in part["balls"]]
        none = self.spark.createDataFrame([], f"q_id bigint, `{self.id_col}` {kind}, sim double, rk bigint")
        self.reads = (0, 0)
        if not balls:
            return none
        part, cluster, far = (np.array([b[i] for b in balls]) for i in range(3))
        asked = queries.where(F.col("q").isNotNull()).select(F.col("q_id").cast("bigint").alias("q_id"), F.col("q").cast("array<double>").alias("q"))
        out = []
        for batch in search.batches_of(asked, 8 * F.size("q") + 16):
            rows = batch.toArrow()
            mine = [(w, q) for n, w, q in search._by_length(rows["q"].combine_chunks()) if n == centre.shape[1]]
            if not mine or not len(mine[0][0]):
                continue
            names = rows["q_id"].to_numpy()[mine[0][0]]
            order = np.argsort(names, kind="stable")
            names, q = names[order], mine[0][1][order]
            most = q @ centre[cluster].T + np.sqrt((q**2).sum(1))[:, None] * far
            first = np.zeros(most.shape, bool)
            np.put_along_axis(first, np.argsort(-(q @ centre[cluster].T), axis=1)[:, : max(1, min(most.shape[1], 2))], True, axis=1)
            found = written(self._scored(manifest, names, q, first, part, cluster, k, wanted, digits, exclude_self), "first")
            kth = search.top(found, "q_id", [F.col("sim").desc()], k).where(F.col("rk") == k).select("q_id", "sim").toArrow()  # a row a query of the batch
            least = np.full(len(names), -np.inf)
            for name, sim in zip(kth["q_id"].to_pylist(), kth["sim"].to_pylist(), strict=True):
                least[np.searchsorted(names, name) : np.searchsorted(names, name, side="right")] = sim
            rest = (most >= least[:, None] - 10.0**-digits) & ~first
            self.reads = self.reads[0] + int(first.sum() + rest.sum()), self.reads[1] + most.size
            out.append(found)
            if rest.any():
                more = self._scored(manifest, names, q, rest, part, cluster, k, wanted, digits, exclude_self)
                out.append(written(more, "hits"))
        hits = reduce(DataFrame.unionByName, out) if out else none.drop("rk")
        return search.top(hits, "q_id", [F.col("sim").desc(), F.col(self.id_col)], k)

    def _scored(self, manifest: dict, names: np.ndarray, q: np.ndarray, pairs: np.ndarray, part: np.ndarray, cluster: np.ndarray, k: int, wanted: Column | None, digits: int, exclude_self: bool) -> DataFrame:
        """Each query's best k in the clusters that `pairs` gives it; folders that no query wants aren't read."""
        asking = {(int(p), int(c)): np.flatnonzero(pairs[:, i]) for i, (p, c) in enumerate(zip(part, cluster, strict=True)) if pairs[:, i].any()}
        sent = self.spark.sparkContext.broadcast((names, q, asking))
        each = []
        for p in sorted({p for p, _ in asking}):
            rows = self._part(manifest, p).where(F.col("cluster").isin([c for x, c in asking if x == p]))
            each.append((rows if wanted is None else rows.where(wanted)).select(self.id_col, self.vector_col, "cluster", "part"))

        def step(b: pa.RecordBatch, held: dict) -> None:
            names, q, asking = sent.value
            best = held.setdefault(0, search._Best(names, k, digits))
            where = (b.column(3).to_numpy().astype(np.int64) << 32) + b.column(2).to_numpy()
            for key in np.unique(where).tolist():
                mine = asking.get((key >> 32, key & 0xFFFFFFFF))
                own = b.filter(pa.array(where == key))
                if mine is None:
                    continue
                v = own.column(1).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(own.num_rows, -1)
                for at in range(0, len(mine), high := max(1, search.HELD_SCORES // 8 // len(v))):
                    some = mine[at : at + high]
                    sims = q[some] @ v.T
                    if exclude_self:
                        sims[search.own(names[some], own.column(0))] = -np.inf
                    best.add(sims, own.column(0), some)

        return search._scan(reduce(DataFrame.unionByName, each), self.id_col, "sim", k, step)
