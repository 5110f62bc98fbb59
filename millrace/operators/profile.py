"""Profiles of tables: column summaries, row chunks, descriptions, and a registry of tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.sources.scratch import written

ROWS_A_CHUNK, MOST_VALUES, SHOWN_VALUES = 10_000, 20, 8


def is_numeric(kind: T.DataType) -> bool:
    """Booleans count as numbers, as in a data frame's description."""
    return isinstance(kind, T.NumericType | T.BooleanType)


def slugged(df: DataFrame) -> DataFrame:
    """Columns renamed to lower-case slugs; a name that comes again gets _2, _3, ..."""
    import re

    names, seen = [], {}
    for i, c in enumerate(df.columns):
        name = re.sub(r"^_+|_+$", "", re.sub(r"[^a-z0-9]+", "_", c.strip().lower())) or f"col_{i}"
        seen[name] = seen.get(name, 0) + 1
        names.append(name if seen[name] == 1 else f"{name}_{seen[name]}")
    return df.toDF(*names)


def summaries(df: DataFrame, group: list[str] | None = None) -> DataFrame:
    """One row a column (of each group): name, dtype, null_count, null_pct, min, max, mean (numbers),
    unique_count (the rest). One pass for the numbers of all columns, made long by a stack."""
    keys = group or []
    fields = [f for f in df.schema.fields if f.name not in keys]

    def of(f: T.StructField) -> Column:
        c = F.col(f"`{f.name}`")
        number = is_numeric(f.dataType)
        v = c.cast("int") if isinstance(f.dataType, T.BooleanType) else c
        nulls = F.count("*") - F.count(c)
        none = F.lit(None).cast("double")
        return F.struct(
            F.lit(f.name).alias("column"),
            F.lit(f.dataType.simpleString()).alias("dtype"),
            nulls.alias("null_count"),
            F.when(F.count("*") > 0, F.round(100.0 * nulls / F.count("*"), 1)).otherwise(0.0).alias("null_pct"),
            (F.round(F.min(v).cast("double"), 4) if number else none).alias("min"),
            (F.round(F.max(v).cast("double"), 4) if number else none).alias("max"),
            (F.round(F.avg(v), 4) if number else none).alias("mean"),
            (F.lit(None).cast("bigint") if number else F.countDistinct(c)).alias("unique_count"),
        )

    wide = df.groupBy(*keys).agg(F.array(*map(of, fields)).alias("s")) if keys else df.agg(F.array(*map(of, fields)).alias("s"))
    return wide.select(*keys, F.explode("s").alias("s")).select(*keys, "s.*")


def top_values(df: DataFrame, most: int = MOST_VALUES) -> DataFrame:
    """column, value, n, rk of columns that aren't numbers and have at most `most` values."""
    names = [f.name for f in df.schema.fields if not is_numeric(f.dataType)]
    long = df.select(F.explode(F.array(*[F.struct(F.lit(n).alias("column"), F.col(f"`{n}`").cast("string").alias("value")) for n in names])).alias("x")).select("x.*")
    counts = long.where("value is not null").groupBy("column", "value").agg(F.count("*").alias("n"))
    few = counts.groupBy("column").agg(F.count("*").alias("k")).where(F.col("k") <= most).select("column")
    order = Window.partitionBy("column").orderBy(F.col("n").desc(), "value")
    return counts.join(few, "column").withColumn("rk", F.row_number().over(order).cast("bigint"))


def numbered(df: DataFrame, order: list[str]) -> DataFrame:
    """Row numbers from 0 in a total order without one task for all rows: the rows are range-partitioned,
    and each adds the count of the partitions before it. The dealt rows are written first: bounds are
    sampled, so dealing them twice could cut ties differently."""
    part = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).withColumn("_m", F.monotonically_increasing_id()), "numbered")
    counts = part.groupBy("_p").agg(F.count("*").alias("_c"), F.min("_m").alias("_f"))
    before = counts.withColumn("_b", F.coalesce(F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return part.join(before.select("_p", "_b", "_f"), "_p").withColumn("row_number", F.col("_b") + F.col("_m") - F.col("_f")).drop("_p", "_m", "_b", "_f")


def row_chunks(rows: DataFrame, size: int = ROWS_A_CHUNK, number: str = "row_number") -> DataFrame:
    """chunk_index, row_start (inclusive), row_end (exclusive), row_count, chunk_total."""
    chunks = rows.groupBy(F.floor(F.col(number) / size).cast("bigint").alias("chunk_index")).agg(F.min(number).alias("row_start"), (F.max(number) + 1).alias("row_end"), F.count("*").alias("row_count"))
    total = rows.agg(F.greatest(F.lit(1), F.ceil(F.count("*") / size)).cast("bigint").alias("chunk_total"))
    return chunks.crossJoin(total)  # one row


def row_window(rows: DataFrame, start: int, end: int, number: str = "row_number") -> DataFrame:
    return rows.where((F.col(number) >= start) & (F.col(number) < end))


def describe(df: DataFrame, size: int = ROWS_A_CHUNK) -> DataFrame:
    """One row: total_rows, n_columns, columns, dtypes, chunk_total."""
    return df.agg(F.count("*").alias("total_rows")).select(
        "total_rows",
        F.lit(len(df.columns)).cast("bigint").alias("n_columns"),
        F.lit(",".join(df.columns)).alias("columns"),
        F.lit(",".join(t for _, t in df.dtypes)).alias("dtypes"),
        F.greatest(F.lit(1), F.ceil(F.col("total_rows") / size)).cast("bigint").alias("chunk_total"),
    )


def schema_text(summary: DataFrame, name: str, total_rows: int) -> DataFrame:
    """One row, schema_text: a line for each column, in the order of names."""
    line = F.concat(F.lit("- "), F.col("column"), F.lit(" ("), F.col("dtype"), F.lit("): nulls "), F.col("null_count").cast("string"))
    lines = summary.agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("body"))  # a row a column
    return lines.select(F.concat(F.lit(f"Table {name}, {total_rows} rows\n"), F.col("body")).alias("schema_text"))


REGISTRY = "table_name string, file_path string, file_hash string, total_rows bigint, columns array<string>, dtypes map<string,string>, imported_at timestamp"


def register(registry: DataFrame, entry: DataFrame, force: bool = False) -> DataFrame:
    """Upsert entries by table_name; unchanged hashes keep the old row unless forced."""
    old = registry.select("table_name", F.col("file_hash").alias("_old"))
    fresh = entry if force else entry.join(old, "table_name", "left").where(~F.col("file_hash").eqNullSafe(F.col("_old"))).drop("_old")
    return registry.join(fresh.select("table_name"), "table_name", "left_anti").unionByName(fresh)


def vanished(registry: DataFrame, listing: DataFrame, key: str = "file_path") -> DataFrame:
    """Entries whose file is gone."""
    return registry.join(listing.select(key), key, "left_anti")


def changes(state: DataFrame, listing: DataFrame, key: str = "file_id") -> DataFrame:
    """key and action of an incremental crawl: new, renamed, modified, unchanged; removed for what the listing lacks.
    state: key, name, modified_time; listing the same."""
    old = state.select(key, F.col("name").alias("_name"), F.col("modified_time").alias("_time"), F.lit(True).alias("_had"))
    both = listing.select(key, "name", "modified_time", F.lit(True).alias("_has")).join(old, key, "full")
    action = F.when(F.col("_had").isNull(), "new").when(F.col("_has").isNull(), "removed").when(~F.col("name").eqNullSafe(F.col("_name")), "renamed").when(~F.col("modified_time").eqNullSafe(F.col("_time")), "modified").otherwise("unchanged")
    return both.select(key, action.alias("action"))


def upsert(old: DataFrame, new: DataFrame, key: str, order: Column | None = None) -> DataFrame:
    """Keyed merge: new rows replace old ones; of several new rows with a key, the last by `order` counts."""
    if order is not None:
        new = new.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order.desc()))).where("_n = 1").drop("_n")
    return old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def permissions(grants: DataFrame) -> DataFrame:
    """file_id, is_public, allowed_users from grants (file_id, role, kind, email, owner_email)."""
    useful = F.col("role").isin("owner", "writer", "commenter", "reader")
    mail = F.when(useful & F.col("kind").isin("user", "group") & F.col("email").isNotNull(), F.lower("email"))
    return grants.groupBy("file_id").agg(
        F.coalesce(F.bool_or(useful & (F.col("kind") == "anyone")), F.lit(False)).alias("is_public"),
        F.array_sort(F.array_union(F.collect_set(mail), F.collect_set(F.lower("owner_email")))).alias("allowed_users"),
    )


def descendants(folders: DataFrame, root: object, depth: int | None = None) -> DataFrame:
    """All folders below root (breadth first), or those up to a given depth: folder_id, depth; folders has
    folder_id and parent_id. Each level is one join with the level before; a folder that was met isn't met again,
    so the levels end. Each level is written once, so plans don't grow with the tree."""
    levels = [written(folders.where(F.col("parent_id") == root).select("folder_id", F.lit(1).cast("bigint").alias("depth")).distinct(), "level")]
    while (depth is None or len(levels) < depth) and not levels[-1].isEmpty():
        met = reduce(DataFrame.unionByName, levels)
        below = folders.join(levels[-1].select(F.col("folder_id").alias("parent_id")), "parent_id").select("folder_id", F.lit(len(levels) + 1).cast("bigint").alias("depth"))
        levels.append(written(below.join(met.select("folder_id"), "folder_id", "left_anti").distinct(), "level"))
    return reduce(DataFrame.unionByName, levels)


def union_by_source(first: DataFrame, second: DataFrame, source: str = "source") -> DataFrame:
    """All of the first, and of the second what has a source that the first hasn't."""
    return first.unionByName(second.join(first.select(source).distinct(), source, "left_anti").select(*first.columns))


def pivot_counts(df: DataFrame, row: str, column: str, values: list[str], total: str = "chunks") -> DataFrame:
    """Counts by row, in all and for each of the column's given values; known values save a pass."""
    return df.groupBy(row).agg(F.count("*").alias(total), *[F.count_if(F.col(column) == v).alias(v) for v in values])


def empty_registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], REGISTRY)


def conjunction(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts, F.lit(True))
