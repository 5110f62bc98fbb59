"""A stored lexical index: what a search reads of it are the blocks of its terms.

Documents are dealt into segments of about as many postings each. A block is a row: one term's postings in one
segment, places in ascending order (Parquet stores their differences), with the largest frequency and the
least length, which bound what any of its documents can score for the term. Blocks lie in folders by a hash of the term and
are sorted by term. Adding documents writes a part of its own; replaced and removed documents are listed, and their
counts subtracted, so that document frequencies and the average length stay exact. compact() makes one part of all.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions.text import tokens
from millrace.operators import retrieval, search
from millrace.sources.scratch import written
from millrace.sources.store import Versions

#: Postings of a segment; folders of terms.
SEGMENT, FOLDERS = 1 << 18, 64
#: One segment in so many is searched first, for a score that the kth best has at least.
FIRST_LOOK = 8
BLOCK = "segment bigint, term string, n bigint, places array<int>, tfs array<int>, dls array<int>, most_tf int, least_dl int, bucket int"
#: Ascending numbers as differences, terms by their common beginnings; no dictionaries, which would come first.
_WRITER = {"parquet.writer.version": "v2", "parquet.enable.dictionary": "false", "compression": "zstd"}


class Postings(Versions):
    """The index of a table of documents below a path; writers that start from one version exclude each other."""

    def __init__(self, spark: SparkSession, path: str, id_col: str = "doc_id", text_col: str = "text", segment: int = SEGMENT, folders: int = FOLDERS):
        super().__init__(spark, path)
        self.id_col, self.text_col, self.segment, self.folders = id_col, text_col, segment, folders

    # writing
    def _words(self, docs: DataFrame) -> DataFrame:
        words = docs.select(F.col(f"`{self.id_col}`").alias("id"), tokens(F.col(f"`{self.text_col}`")).alias("w"))
        return words.select("id", F.size("w").alias("dl"), "w").where("dl > 0")

    def _part(self, words: DataFrame, number: int) -> dict | None:
        """Write documents (id, dl, w) as a part: its folder, documents, words and segments."""
        words = written(words, "words", compression="zstd")
        sums = words.agg(F.count(F.lit(1)).alias("n"), F.sum("dl").alias("total"), F.sum(F.size(F.array_distinct("w"))).alias("postings")).first()
        if not sums.n:
            return None
        segments, folder = -(-sums.postings // self.segment), f"part-{uuid.uuid4().hex}"
        dealt = words.withColumn("segment", F.lit(number << 32) + F.pmod(F.xxhash64("id", "w"), F.lit(segments)))
        place = (F.row_number().over(Window.partitionBy("segment").orderBy(F.col("id").asc_nulls_first(), F.xxhash64("w"))) - 1).alias("place")
        dealt.select("segment", place, "id", "dl").write.parquet(f"{self.path}/{folder}/documents")
        # one shuffle: a segment's documents come together, and all that follows is within the segment
        each = dealt.select("segment", place, "dl", "w").select("segment", "place", "dl", F.explode("w").alias("term")).groupBy("segment", "term", "place", "dl").agg(F.count(F.lit(1)).cast("int").alias("tf"))
        blocks = each.groupBy("segment", "term").agg(F.array_sort(F.collect_list(F.struct("place", "tf", "dl"))).alias("p"))
        rows = blocks.select("segment", "term", F.size("p").cast("bigint").alias("n"), *[F.col(f"p.{c}").alias(f"{c}s") for c in ("place", "tf", "dl")], F.array_max("p.tf").alias("most_tf"), F.array_min("p.dl").alias("least_dl"), _bucket("term", self.folders))
        keys = ["bucket", "term", "segment"]
        rows.repartitionByRange(*keys).sortWithinPartitions(*keys).write.options(**_WRITER).partitionBy("bucket").parquet(f"{self.path}/{folder}/blocks")
        return {"folder": folder, "n": sums.n, "total": sums.total, "segments": segments}

    def build(self, docs: DataFrame) -> str:
        """A version with these documents alone. Texts without words aren't indexed."""
        base = self._state()[0] if self.current() else 0
        part = self._part(self._words(docs), 0)
        return self._next(base, {"id": dict(docs.dtypes)[self.id_col], "folders": self.folders, "parts": [part] if part else [], "gone": [], "made": 1})

    def upsert(self, docs: DataFrame, removed: DataFrame | None = None) -> str:
        """Documents replace those of their ids, those of `removed` ids go. Writes what is new and a list of what goes."""
        if not self.current():
            return self.build(docs)
        base, manifest = self._state()
        ids = docs.select(F.col(f"`{self.id_col}`").alias("id"))
        gone = self._removal(manifest, (ids.unionByName(removed.select(F.col(f"`{self.id_col}`").alias("id"))) if removed is not None else ids).distinct())
        part = self._part(self._words(docs), manifest["made"])
        return self._next(base, manifest | {"parts": [*manifest["parts"], *([part] if part else [])], "gone": [*manifest["gone"], *([gone] if gone else [])], "made": manifest["made"] + 1})

    def delete(self, ids: DataFrame) -> str:
        base, manifest = self._state()
        gone = self._removal(manifest, ids.select(F.col(f"`{self.id_col}`").alias("id")).distinct())
        return self._next(base, manifest | {"gone": [*manifest["gone"], *([gone] if gone else [])]})

    def _removal(self, manifest: dict, ids: DataFrame) -> dict | None:
        """List the documents of these ids and count their terms."""
        if not manifest["parts"]:
            return None
        ids, folder = ids.withColumnRenamed("id", "gone_id"), f"gone-{uuid.uuid4().hex}"
        found = written(self._documents(manifest).join(ids, F.col("id").eqNullSafe(F.col("gone_id")), "left_semi").select("segment", "place", "dl"), "gone")
        sums = found.agg(F.count(F.lit(1)).alias("n"), F.sum("dl").alias("total")).first()
        if not sums.n:
            return None
        found.groupBy("segment").agg(F.array_sort(F.collect_list("place")).alias("places")).write.parquet(f"{self.path}/{folder}/documents")
        blocks = self._blocks(manifest).join(found.select("segment").distinct(), "segment", "left_semi")
        terms = blocks.select("segment", "term", F.explode("places").alias("place")).join(found, ["segment", "place"], "left_semi")
        terms.groupBy("term").agg(F.count(F.lit(1)).alias("less")).write.parquet(f"{self.path}/{folder}/terms")
        return {"folder": folder, "n": sums.n, "total": sums.total}

    def compact(self) -> str:
        """One part of all that is there."""
        base, manifest = self._state()
        each = self._blocks(manifest).select("segment", "term", F.inline(F.arrays_zip("places", "tfs"))).withColumnsRenamed({"places": "place", "tfs": "tf"})
        texts = each.groupBy("segment", "place").agg(F.flatten(F.collect_list(F.array_repeat("term", F.col("tf")))).alias("w"))
        part = self._part(self._documents(manifest).join(texts, ["segment", "place"]).select("id", "dl", F.array_sort("w").alias("w")), manifest["made"])
        return self._next(base, manifest | {"parts": [part] if part else [], "gone": [], "made": manifest["made"] + 1})

    # reading
    def _state(self) -> tuple[int, dict]:
        base, manifest = super()._state()
        self.folders = manifest["folders"]
        return base, manifest

    def _folders(self, manifest: dict, kind: str, of: str = "parts") -> list[str]:
        return [f"{self.path}/{p['folder']}/{kind}" for p in manifest[of]]

    def _blocks(self, manifest: dict) -> DataFrame:
        each = [self.spark.read.schema(BLOCK).parquet(f) for f in self._folders(manifest, "blocks")]
        return reduce(DataFrame.unionByName, each) if each else self.spark.createDataFrame([], BLOCK)

    def _gone(self, manifest: dict) -> DataFrame:
        """segment, places of documents that don't count any more."""
        schema, folders = "segment bigint, places array<int>", self._folders(manifest, "documents", "gone")
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def _documents(self, manifest: dict) -> DataFrame:
        schema, folders = f"segment bigint, place int, id {manifest['id']}, dl int", self._folders(manifest, "documents")
        rows = self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)
        if not manifest["gone"]:
            return rows
        return rows.join(self._gone(manifest).select("segment", F.explode("places").alias("place")), ["segment", "place"], "left_anti")

    def statistics(self) -> tuple[int, int]:
        """Documents and their words in all, by adding up what parts and removals say."""
        _, manifest = self._state()
        return tuple(sum(p[c] for p in manifest["parts"]) - sum(g[c] for g in manifest["gone"]) for c in ("n", "total"))

    def search(self, queries: DataFrame, k: int, digits: int = 6, allowed: DataFrame | None = None) -> DataFrame:
        """q_id, id, score and rk of each query's k best documents, the same rows as retrieval.bm25 gives for the documents
        that are there; queries has q_id and text.

        Blocks of the queries' terms are read, other terms' aren't. Some segments are searched first; the kth best
        score found there is a bound for the others: where a query's terms can't add up to it in a segment, going by
        their blocks' bounds, the query skips the segment, and blocks that no query wants aren't unpacked.
        With `allowed` (ids) only these documents are ranked; frequencies and lengths stay those of all documents.
        """
        _, manifest = self._state()
        n, total = self.statistics()
        none = self.spark.createDataFrame([], f"q_id bigint, `{self.id_col}` {manifest['id']}, score double, rk bigint")
        if not n:
            return none
        asked = written(retrieval.query_terms(queries), "asked")
        blocks = self._wanted(manifest, asked)
        df = blocks.groupBy("term").agg(F.sum("n").alias("df"))
        if manifest["gone"]:
            less = self.spark.read.schema("term string, less bigint").parquet(*self._folders(manifest, "terms", "gone")).groupBy("term").agg(F.sum("less").alias("less"))
            df = df.join(less, "term", "left").select("term", (F.col("df") - F.coalesce("less", F.lit(0))).alias("df")).where("df > 0")
        weighed = written(asked.join(df, "term").select("q_id", "term", retrieval.query_weight(n, total / n).alias("weight")), "weighed")
        lost = self._gone(manifest)
        if allowed is not None:
            ids = allowed.select(F.col(self.id_col).alias("allowed_id"))
            others = self._documents(manifest).join(ids, F.col("id").eqNullSafe(F.col("allowed_id")), "left_anti")
            lost = lost.unionByName(others.select("segment", F.array("place").alias("places")))
        gone = lost.groupBy("segment").agg(F.flatten(F.collect_list("places")).alias("places"))
        both = blocks.select("segment", "term", "places", "tfs", "dls", "most_tf", "least_dl").unionByName(gone, allowMissingColumns=True)
        segments = sum(p["segments"] for p in manifest["parts"])
        parts, out = search.batches_of(weighed, F.length("term") + 24), []
        first = F.pmod(F.xxhash64("segment"), F.lit(FIRST_LOOK)) == 0
        looks = [b.repartition("segment").sortWithinPartitions("segment") for b in ([both.where(first), both.where(~first)] if segments > FIRST_LOOK else [both])]
        if len(parts) > 1:  # blocks are shuffled once, not for each batch, and lie on the executors' disks until the last one
            looks = [b.persist(StorageLevel.DISK_ONLY) for b in looks]
        for part in parts:
            sent = self.spark.sparkContext.broadcast(search.prepared(part))
            found = [_scored(looks[0], sent, None, k, total / n, digits)]
            if segments > FIRST_LOOK:
                found[0] = written(found[0], "first")
                least = search.top(found[0], "q_id", [F.col("score").desc()], k).where(F.col("rk") == k).select("q_id", "score").toArrow()  # a row a query of the batch
                bound = self.spark.sparkContext.broadcast((least["q_id"].to_numpy(), least["score"].to_numpy()))
                found.append(_scored(looks[1], sent, bound, k, total / n, digits))
            hits = reduce(DataFrame.unionByName, found)
            out.append(written(hits, "hits") if len(parts) > 1 else hits)
            if len(parts) > 1:
                sent.destroy()
        if len(parts) > 1:
            for b in looks:
                b.unpersist()
        hits = reduce(DataFrame.unionByName, out).where("place >= 0")
        named = hits.join(self._documents(manifest).select("segment", "place", F.col("id").alias(self.id_col)), ["segment", "place"]).select("q_id", self.id_col, "score")
        return search.top(named, "q_id", [F.col("score").desc(), F.col(self.id_col)], k)

    def _wanted(self, manifest: dict, asked: DataFrame) -> DataFrame:
        """The blocks of asked terms: few terms are pushed into the reading, many are joined."""
        terms = [r.term for r in asked.select("term").distinct().limit(retrieval.FEW_TERMS + 1).collect()]
        blocks = self._blocks(manifest)
        if len(terms) <= retrieval.FEW_TERMS:
            folders = [r.bucket for r in self.spark.createDataFrame([(t,) for t in terms], "term string").select(_bucket("term", self.folders)).distinct().collect()]
            return blocks.where(F.col("bucket").isin(folders) & F.col("term").isin(terms))
        return blocks.join(asked.select("term", _bucket("term", self.folders)).distinct(), ["bucket", "term"], "left_semi")

    def skipped(self, queries: DataFrame, k: int) -> float:
        """The share of (query, segment) pairs beyond the first look that a search doesn't score."""
        before = _scored.counts
        _scored.counts = self.spark.sparkContext.accumulator(0), self.spark.sparkContext.accumulator(0)
        try:
            self.search(queries, k).count()
            live, all_pairs = (a.value for a in _scored.counts)
        finally:
            _scored.counts = before
        return 1 - live / all_pairs if all_pairs else 0.0


def _bucket(term: str, folders: int):
    return F.pmod(F.xxhash64(term), F.lit(folders)).cast("int").alias("bucket")


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows that come sorted by segment, one segment at a time."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        segment = b.column(0).to_numpy()
        edge = np.r_[0, np.flatnonzero(np.diff(segment)) + 1, len(segment)]
        for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            if held and held[0].column(0)[0].as_py() != segment[lo]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


def _scored(blocks: DataFrame, sent, bound, k: int, average: float, digits: int) -> DataFrame:
    """q_id, segment, place, score of blocks that come a segment at a time: each task's best k of each query, and what is as good as the kth; none below a query's
    bound. A task takes its segments one after the other, and what it has found in them is a bound for the next."""
    counts = _scored.counts

    def add(table: pa.Table, asked: search.Asked, best: search._Best, number: int) -> None:
        known = pc.is_valid(table["term"])
        dead = table.filter(pc.invert(known))["places"].combine_chunks().flatten().to_numpy()
        rows = table.filter(known)
        term = pc.index_in(rows["term"].combine_chunks(), value_set=asked.terms).fill_null(-1).to_numpy(zero_copy_only=False)
        rows, term = rows.filter(pa.array(term >= 0)), term[term >= 0].astype(np.int64)
        if not len(asked.names) or not len(term):
            return
        # which queries can reach their bound here
        most = retrieval.saturated(rows["most_tf"].to_numpy().astype(np.float64), rows["least_dl"].to_numpy().astype(np.float64), average)
        many = asked.many[term]
        spot = search.ranges(asked.edge[term], many)
        reach = np.bincount(asked.asking[spot], np.repeat(most, many) * asked.weight[spot], len(asked.names))
        live = (reach > 0) & (reach >= best.least - 10.0**-digits)
        if counts is not None and bound is not None:
            counts[0].add(int(live.sum()))
            counts[1].add(len(live))
        which = np.flatnonzero(live)
        if not len(which):
            return
        if 2 * len(which) < len(live):
            asked = asked.only(which)
            rows, term = rows.filter(pa.array(asked.many[term] > 0)), term[asked.many[term] > 0]
        else:
            which = np.arange(len(live))
        size = pc.list_value_length(rows["places"]).to_numpy()
        place, tf, dl = (rows[c].combine_chunks().flatten().to_numpy() for c in ("places", "tfs", "dls"))
        term = np.repeat(term, size)
        if len(dead):
            stays = ~np.isin(place, dead)
            place, tf, dl, term = place[stays], tf[stays], dl[stays], term[stays]
        part = retrieval.saturated(tf.astype(np.float64), dl.astype(np.float64), average)
        asked.add_to(best, place.astype(np.int64), term, part, pa.array((number << 32) + np.arange(int(place.max(initial=-1)) + 1)), which)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, segments = search.Asked(*sent.value), []
        best = search._Best(asked.names, k, digits, ties=True)
        if bound is not None:
            best.least[np.searchsorted(asked.names, bound.value[0])] = bound.value[1]
        for table in _segments(batches):
            add(table, asked, best, len(segments))
            segments.append(table["segment"][0].as_py())
        for b in best.rows(["q_id", "place", "score"]):
            at = b.column(1).to_numpy()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(segments, np.int64)[at >> 32]), pa.array((at & 0xFFFFFFFF).astype(np.int32)), b.column(2)], ["q_id", "segment", "place", "score"])

    return blocks.mapInArrow(run, "q_id bigint, segment bigint, place int, score double")


_scored.counts = None
