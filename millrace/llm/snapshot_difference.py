"""Snapshot difference with rekeying (operator 13).

Values of the compared columns get integer ids from a content dictionary: the 64-bit hash of a value, and where
different values share a hash (found by grouping the values themselves) their place among these. Keys are paired,
copies ranked and paired by content on rows of such integers only; the later rows' columns are joined to the result at the end.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.arrowio import fresh, materialised, reachable
from millrace.llm.skew import join_spread

#: Bytes of values that share their hash with others up to which these are broadcast.
CLASH_BYTES = 4 << 20


def _changes(column: pa.Array) -> np.ndarray:
    """Which values differ from the one before; nulls are equal."""
    new, old = column.slice(1), column.slice(0, max(len(column) - 1, 0))
    differ = pc.fill_null(pc.not_equal(new, old), False)
    return pc.or_(differ, pc.not_equal(pc.is_null(new), pc.is_null(old))).to_numpy(zero_copy_only=False)


def ranked(rows: DataFrame, group: Sequence[str], order: Sequence[Column], name: str = "rank") -> DataFrame:
    """rows with their place (from 0) in their group by `order`, as a written table.

    Rows are sorted by range partitions over group and order, so a group may span any number of tasks; each
    task numbers its part. Only a partition's bounds (a row each) come to the driver, which adds up how
    much of a partition's first group lies before it. `order` should be total within a group.
    """
    spark = reachable(rows.sparkSession)
    names = rows.columns
    at = [names.index(c) for c in group]
    part, local, leading, ordinal = fresh(names, "part", "local", "leading", "ordinal")
    keys = [*(F.col(c).asc_nulls_first() for c in group), *order]
    dealt = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys).sortWithinPartitions(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        me, before, start, groups, seen = TaskContext.get().partitionId(), None, 0, 0, 0
        for b in batches:
            if not b.num_rows:
                continue
            opens = np.zeros(b.num_rows, bool)
            for i in at:
                opens[1:] |= _changes(b.column(i))
            opens[0] = before != [b.column(i)[0].as_py() for i in at]
            places, of = seen + np.arange(b.num_rows), groups + np.cumsum(opens)
            starts = np.maximum.accumulate(np.where(opens, places, start))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(b.num_rows, me, np.int32)), pa.array(places - starts), pa.array(of == 1), pa.array(places)], [*names, part, local, leading, ordinal])
            before, start, groups, seen = [b.column(i)[b.num_rows - 1].as_py() for i in at], int(starts[-1]), int(of[-1]), seen + b.num_rows

    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes) + f", `{part}` int, `{local}` bigint, `{leading}` boolean, `{ordinal}` bigint"
    made = materialised(dealt.mapInArrow(run, schema), "ranked")
    value = F.struct(*[F.col(c) for c in group])
    bounds = made.groupBy(F.col(part).alias("p")).agg(F.min_by(value, ordinal).alias("first"), F.max_by(value, ordinal).alias("last"), F.max_by(local, ordinal).alias("n"), F.min(leading).alias("one")).collect()  # a row for each partition
    offsets, last, held = [], None, 0
    for r in sorted(bounds, key=lambda r: r.p):
        begun = held if last is not None and r.first == last else 0
        offsets.append((r.p, begun))
        last, held = r["last"], r.n + 1 + (begun if r.one else 0)
    table = spark.createDataFrame(offsets, "p int, begun bigint")
    return made.join(F.broadcast(table), F.col(part) == F.col("p")).withColumn(name, F.col(local) + F.when(F.col(leading), F.col("begun")).otherwise(0)).select(*names, name)


class Dictionary:
    """Ids of column values: column c's is the numbers in `ids[c]`."""

    def __init__(self, both: DataFrame, columns: Sequence[str], hashed: Callable[[Column], Column]):
        self.columns, self.hashed = columns, hashed
        found = [both.select(hashed(F.col(f"`{c}`")).alias("h"), F.col(f"`{c}`").alias("v")).distinct() for c in columns]
        shared = [f.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit(i).alias("c"), "h") for i, f in enumerate(found)]
        every = shared[0]
        for s in shared[1:]:
            every = every.unionByName(s)
        clashes = materialised(every, "shared-hashes")
        hit = {r.c for r in clashes.select("c").distinct().collect()}  # a row for each column at most
        self.places: dict[int, DataFrame] = {}
        for i in hit:
            values = found[i].join(clashes.where(F.col("c") == i).select("h"), "h")
            placed = values.withColumn("o", F.row_number().over(Window.partitionBy("h").orderBy(F.col("v").asc_nulls_first())))
            self.places[i] = materialised(placed, "content-places")
        self.ids = {c: [f"h{i}", *([f"o{i}"] if i in hit else [])] for i, c in enumerate(columns)}

    def coded(self, rows: DataFrame, keep: Sequence[str], payload: bool = False) -> DataFrame:
        """`keep` and the ids of all columns (and, on demand, the columns as v0, v1, ...)."""
        out = rows.select(*keep, *[F.col(f"`{c}`").alias(f"v{i}") for i, c in enumerate(self.columns)], *[self.hashed(F.col(f"`{c}`")).alias(f"h{i}") for i, c in enumerate(self.columns)])
        for i, place in self.places.items():
            size = place.agg(F.sum(F.coalesce(F.length(F.col("v").cast("string")), F.lit(0)) * 4 + 64).alias("n")).first().n
            side = place.select(F.col("h").alias("ph"), F.col("v").alias("pv"), F.col("o").alias(f"o{i}"))
            out = out.join(F.broadcast(side) if size <= CLASH_BYTES else side, (F.col(f"h{i}") == F.col("ph")) & F.col(f"v{i}").eqNullSafe(F.col("pv")), "left").drop("ph", "pv")
            out = out.withColumn(f"o{i}", F.coalesce(f"o{i}", F.lit(0)))
        return out.select(*keep, *self.all_ids(), *([f"v{i}" for i in range(len(self.columns))] if payload else []))

    def all_ids(self) -> list[str]:
        return [x for c in self.columns for x in self.ids[c]]


def _pair_repeated(rows: DataFrame, crowd: DataFrame, total: int, ids: list[str]) -> DataFrame:
    """Keys that a side has more than once: its rows, ordered by content, pair with the other side's i-th by i-th."""
    alike = rows.groupBy("later", "key", *ids).agg(F.count(F.lit(1)).alias("copies"))
    named = crowd.where("key IS NOT NULL").select("key", "weight")
    mine = join_spread(alike, named, "key", "weight", total).drop("weight")
    if not crowd.where("key IS NULL").isEmpty():
        mine = mine.unionByName(alike.where("key IS NULL"))
    each = mine.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("copies")
    placed = ranked(each, ["later", "key"], [F.col(c).asc() for c in [*ids, "copy"]])
    old, new = (placed.where(f"{'' if late else 'NOT '}later").select("key", "rank", F.lit(True).alias(f"has{s}"), *[F.col(c).alias(f"{s}_{c}") for c in ids]) for late, s in ((False, "e"), (True, "l")))
    new = new.withColumnsRenamed({"key": "key_", "rank": "rank_"})
    joined = old.join(new, old["key"].eqNullSafe(new["key_"]) & (old["rank"] == new["rank_"]), "full_outer")
    return joined.select(F.when(F.col("hase"), F.col("key")).otherwise(F.col("key_")).alias("key"), F.coalesce("hase", F.lit(False)).cast("bigint").alias("n_e"), F.coalesce("hasl", F.lit(False)).cast("bigint").alias("n_l"), *[f"{s}_{c}" for s in "el" for c in ids])


def difference(earlier: DataFrame, later: DataFrame, key: str, columns: Sequence[str], content: Sequence[str], hashed: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """How the later snapshot differs from the earlier one: key, old_key, op, changed, row.

    Rows of equal key pair (op `same`, or `update` if a column of `columns` differs). Among rows left over on
    either side, those equal in all columns of `content` pair, the i-th smallest earlier key with the i-th largest
    later key (`rekey`). The rest are `insert` and `delete`. key is the later row's, else the earlier one's;
    old_key the earlier row's; changed names a pair's differing columns in the order given; row holds the later
    row's columns, null for a delete. Nulls equal nulls and nothing else; null keys are the smallest.

    Where a side has a key more than once, its rows are ordered by their contents' ids and pair i-th by i-th, what is
    left over counts as unpaired; equal rows each pair once. Other columns are ignored, whatever their names. Keys
    are numbers, texts or times, not fractions. Empty snapshots give inserts or deletes only.

    No key, content or column value is collected, broadcast or brought into one task, whatever share of the rows
    has it; the exceptions are stated bounds: fewer than 2^14 names of keys that are repeated very often, CLASH_BYTES of values
    whose hashes clash, and a row for each partition. `hashed` is the dictionary's hash; any gives the same result.
    """
    if not set(content) <= set(columns):
        raise ValueError("content columns must be among the compared ones")
    if dict(earlier.dtypes)[key] in ("float", "double"):
        raise TypeError("keys can't be fractions")
    sides = [d.select(F.col(f"`{key}`").alias("key"), F.lit(late).alias("later"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)]) for late, d in ((False, earlier), (True, later))]
    plain = [f"c{i}" for i in range(len(columns))]
    both = sides[0].unionByName(sides[1])
    names = Dictionary(both, plain, hashed)
    ids = names.all_ids()
    slim = names.coded(both, ["key", "later"])
    of = [F.sum((F.col("later") == late).cast("bigint")).alias(n) for late, n in ((False, "n_e"), (True, "n_l"))]
    met = slim.groupBy("key").agg(*of, *[F.max(F.when(F.col("later") == late, F.col(c))).alias(f"{s}_{c}") for late, s in ((False, "e"), (True, "l")) for c in ids])
    met = materialised(met, "keys")
    single = (F.col("n_e") <= 1) & (F.col("n_l") <= 1)
    counts = met.agg(F.sum((~single).cast("bigint")).alias("crowded"), F.sum(F.col("n_e") + F.col("n_l")).alias("rows")).first()
    pairs = met.where(single)
    if counts.crowded:
        crowd = materialised(met.where(~single).select("key", (F.col("n_e") + F.col("n_l")).alias("weight")), "repeated-keys")
        pairs = pairs.unionByName(materialised(_pair_repeated(slim, crowd, counts.rows, ids), "repeated-pairs"))

    # what is left over pairs by content
    same_content = [x for c in content for x in names.ids[f"c{list(columns).index(c)}"]]
    ends = []
    for s, other, order in (("e", "n_l", F.col("key").asc_nulls_first()), ("l", "n_e", F.col("key").desc_nulls_last())):
        lone = pairs.where(F.col(other) == 0).select("key", *[F.col(f"{s}_{c}").alias(c) for c in ids])
        placed = ranked(lone, same_content, [order, *[F.col(c).asc() for c in ids if c not in same_content]])
        ends.append(placed.select(F.col("key").alias(f"{s}_key"), F.lit(True).alias(f"has{s}"), *[F.col(c).alias(f"{s}_{c}") for c in ids], F.col("rank").alias(f"{s}_rank")))
    on = [F.col(f"e_{c}") == F.col(f"l_{c}") for c in [*same_content, "rank"]]
    matched = ends[0].join(ends[1], on, "full_outer")

    differs = [(c, [x for x in names.ids[f"c{i}"]]) for i, c in enumerate(columns)]
    changed = F.array_compact(F.array(*[F.when(~F.expr(" AND ".join(f"e_{x} = l_{x}" for x in parts)), F.lit(c)) for c, parts in differs]))
    none = F.array().cast("array<string>")
    later_ids = [F.col(f"l_{c}") for c in ids]
    by_key = pairs.where("n_e = 1 AND n_l = 1").select("key", F.col("key").alias("old_key"), F.when(F.size(changed) == 0, "same").otherwise("update").alias("op"), changed.alias("changed"), *later_ids)
    op = F.when(F.col("hase") & F.col("hasl"), "rekey").when(F.col("hasl"), "insert").otherwise("delete")
    by_content = matched.select(F.when(F.col("hasl"), F.col("l_key")).otherwise(F.col("e_key")).alias("key"), F.col("e_key").alias("old_key"), op.alias("op"), F.when(op == "rekey", changed).otherwise(none).alias("changed"), *later_ids)
    slim_result = by_key.unionByName(by_content)

    # the later rows' columns come last; deletes have no ids and match nothing
    rows = names.coded(sides[1], ["key"], payload=True)
    if counts.crowded:  # equal rows of one key stand for each other
        rows = rows.dropDuplicates(["key", *ids])
    rows = rows.withColumnsRenamed({"key": "key_"} | {c: f"{c}_" for c in ids})
    same = [F.col("key").eqNullSafe(F.col("key_")), *[F.col(f"l_{c}") == F.col(f"{c}_") for c in ids]]
    row = F.struct(*[F.col(f"v{i}").alias(c) for i, c in enumerate(columns)])
    return slim_result.join(rows, same, "left").select("key", "old_key", "op", "changed", F.when(F.col("op") != "delete", row).alias("row"))


def later_snapshot(docs: DataFrame) -> DataFrame:
    """documents as a later snapshot has them: crc32 of the decimal doc_id modulo 25 drops (0), edits (1), relabels (2),
    rekeys (3, 4) or copies (5) a row; the others, and rows without an id, stay."""
    kind, at = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 25, F.lit(-1).cast("bigint") - F.col("doc_id")
    plain = F.struct("doc_id", "text", "lang", "source")
    moved = F.struct(at.alias("doc_id"), "text", "lang", "source")
    rows = (
        F.when(kind == 0, F.array().cast(f"array<{_type(docs)}>"))
        .when(kind == 1, F.array(F.struct("doc_id", F.concat(F.coalesce("text", F.lit("")), F.lit("+")).alias("text"), "lang", "source")))
        .when(kind == 2, F.array(F.struct("doc_id", "text", F.col("source").alias("lang"), F.col("lang").alias("source"))))
        .when(kind == 3, F.array(moved))
        .when(kind == 4, F.array(F.struct(at.alias("doc_id"), "text", "lang", F.lit(None).cast("string").alias("source"))))
        .when(kind == 5, F.array(plain, moved))
        .otherwise(F.array(plain))
    )
    return docs.select(F.inline(rows))


def _type(docs: DataFrame) -> str:
    return "struct<" + ",".join(f"{c}:{dict(docs.dtypes)[c]}" for c in ("doc_id", "text", "lang", "source")) + ">"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13_snapshot_difference."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = difference(docs, later_snapshot(docs), "doc_id", ["text", "lang", "source"], ["text", "lang"])
    value = F.concat_ws("\n", *[F.coalesce(F.col(f"row.{c}"), F.lit("~")) for c in ("text", "lang", "source")])
    return found.select("key", "old_key", "op", F.array_join("changed", ",").alias("changed"), F.when(F.col("op") != "delete", F.sha2(value, 256)).alias("row_sha256"))
