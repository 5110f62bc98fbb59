"""Records of CSV files whose quoted fields may hold line breaks, read in parallel.

Spark reads lines, in as many tasks as a file has splits; whether a line begins inside a quoted field depends on all
before it. Each line is a map from {outside, inside} to {outside, inside}: the state at its end by the state at
its start. Maps compose, so a split's map follows from its lines alone, the state at each split's start from the maps
of the splits before it, and each line's state from its split's. Lines that are records pass on as they are; only the lines of
records over several lines are brought together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.sources.scratch import written


def ends_inside(line: str, inside: bool, separator: str) -> bool:
    """Whether a line that begins outside or inside a quoted field ends inside one. A quote opens a field only as
    its first character; inside, two quotes are one; quotes after the closing one are characters."""
    at, n = 0, len(line)
    while True:
        if not inside:
            if at < n and line[at] == '"':
                inside, at = True, at + 1
            else:
                at = line.find(separator, at) + 1
                if not at:
                    return False
                continue
        at = line.find('"', at) + 1
        if not at:
            return True
        if at < n and line[at] == '"':
            at += 1
            continue
        inside, at = False, line.find(separator, at) + 1
        if not at:
            return False


def records(spark: SparkSession, path: str, separator: str = ",") -> DataFrame:
    """path, line (the number of the record's first line in its file, from 0) and value (the whole record) of CSV files.

    A record ends at a line feed outside quotes; a carriage return before it goes. Blank lines outside quotes are no
    records. A quote that is never closed makes one record of the rest of its file.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), "value")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Number the lines of each split, and give each line's states by the state at the split's start."""
        key, n, states = None, 0, (False, True)
        for b in batches:
            names, blocks = b.column(0).dictionary_encode(), b.column(1).to_numpy()
            part = names.indices.to_numpy().astype(np.int64)
            bounds = [0, *(np.flatnonzero((part[1:] != part[:-1]) | (blocks[1:] != blocks[:-1])) + 1).tolist(), b.num_rows]
            quoted = pc.match_substring(b.column(2), '"').to_numpy(zero_copy_only=False)
            number, out = np.zeros(b.num_rows, np.int64), np.zeros((4, b.num_rows), bool)
            for lo, hi in zip(bounds, bounds[1:], strict=False):
                if lo == hi:
                    continue
                if key != (mine := (b.column(0)[lo].as_py(), int(blocks[lo]))):
                    key, n, states = mine, 0, (False, True)
                number[lo:hi] = n + np.arange(hi - lo)
                n += hi - lo
                at = lo
                for i in [*(lo + np.flatnonzero(quoted[lo:hi])).tolist(), hi]:  # lines without quotes keep the state
                    out[0, at:i], out[1, at:i] = states
                    out[2, at:i], out[3, at:i] = states
                    if i < hi:
                        out[0, i], out[1, i] = states
                        line = b.column(2)[i].as_py()
                        after = {s: ends_inside(line, s, separator) for s in set(states)}
                        states = after[states[0]], after[states[1]]
                        out[2, i], out[3, i] = states
                    at = i + 1
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(number), b.column(2), *(pa.array(x) for x in out)], ["path", "block", "n", "value", "before_out", "before_in", "after_out", "after_in"])

    numbered = lines.mapInArrow(run, "path string, block bigint, n bigint, value string, before_out boolean, before_in boolean, after_out boolean, after_in boolean")
    # a row for each split: its lines and its map
    blocks = written(numbered.groupBy("path", "block").agg(F.count(F.lit(1)).alias("lines"), F.max_by(F.struct("after_out", "after_in"), "n").alias("map")), "splits")
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # the state is the last split's that maps both states to one, then changed by each swap after it; those that keep it are left out
    kind = F.when(F.col("map.after_out") == F.col("map.after_in"), F.when(F.col("map.after_out"), "inside").otherwise("outside")).when(F.col("map.after_out"), "swap").otherwise("keep")
    swaps = F.sum((F.col("kind") == "swap").cast("bigint")).over(before)
    fixed = F.when(F.col("kind").isin("inside", "outside"), F.struct((F.col("kind") == "inside").alias("inside"), (F.coalesce("swaps", F.lit(0))).alias("swaps")))
    state = blocks.withColumn("kind", kind).withColumn("swaps", swaps).withColumn("fixed", F.last(fixed, True).over(before)).withColumn("first", F.coalesce(F.sum("lines").over(before), F.lit(0)))
    odd = (F.coalesce("swaps", F.lit(0)) - F.coalesce("fixed.swaps", F.lit(0))) % 2 == 1
    start = state.select("path", "block", "first", (F.coalesce("fixed.inside", F.lit(False)) != odd).alias("inside"))
    pick = lambda c: F.when(F.col("inside"), F.col(f"{c}_in")).otherwise(F.col(f"{c}_out")).alias(c)
    placed = numbered.join(start, ["path", "block"]).select("path", "block", (F.col("first") + F.col("n")).alias("line"), "value", pick("before"), pick("after"))
    single = placed.where("NOT before AND NOT after").select("path", "line", "value")
    # the others know the line that their record starts in: in their split, or in the last one that has such a line
    several = written(placed.where("before OR after").withColumn("head", F.when(~F.col("before"), F.col("line"))), "parts")
    heads = several.groupBy("path", "block").agg(F.max("head").alias("last"))
    carried = heads.select("path", "block", F.last("last", True).over(before).alias("carried"))
    mine = F.last("head", True).over(Window.partitionBy("path", "block").orderBy("line").rowsBetween(Window.unboundedPreceding, 0))
    parts = several.withColumn("mine", mine).join(carried, ["path", "block"]).select("path", F.coalesce("mine", "carried", F.lit(0)).alias("head"), "line", "value")
    joined = parts.groupBy("path", "head").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "value"))), lambda x: x["value"]), "\n").alias("value"))
    every = single.unionByName(joined.select("path", F.col("head").alias("line"), "value"))
    return every.withColumn("value", F.regexp_replace("value", "\r$", "")).where(F.trim("value") != "")
