"""Joins on a key that may be hot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Hot keys are fewer than this, whatever the rows, which bounds what is broadcast.
HOT_KEYS = 1 << 14
#: A key of no more rows than this isn't hot in any table.
HOT_ROWS = 256


def join_spread(rows: DataFrame, table: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """The inner join of rows with table on `key`; no key fills a task, even one that a third of all rows have.

    table is a written one with one row a key; its column `weight` says how many of the rows have the key, or
    more, and its weights add up to `total` at most. So fewer than HOT_KEYS keys can be above total / HOT_KEYS:
    these are broadcast and their rows stay in the tasks that hold them. The others are shuffled. Rows
    whose key is null match nothing and are shuffled nowhere.
    """
    is_hot = F.col(weight) > max(total // HOT_KEYS, HOT_ROWS)
    hot, rows = table.where(is_hot), rows.where(F.col(key).isNotNull())
    if hot.isEmpty():
        return rows.join(table, key)
    held = rows.join(F.broadcast(hot), key)
    others = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(table.where(~is_hot), key)
    return held.unionByName(others)
