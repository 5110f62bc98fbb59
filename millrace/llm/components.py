"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.arrowio import materialised
from millrace.llm.skew import join_spread


def components(links: DataFrame, rounds: int = 200) -> DataFrame:
    """(node, component): each linked node with the least node that it reaches.

    Randomised contraction: each round deals the nodes a new order by hash, every node gives way to
    the first among its neighbours and itself, and the links between those make the next round's
    graph. A round is expected to leave at most three quarters of the nodes, whatever the links'
    shape, so rounds grow with the logarithm of the nodes; the loop ends when no link is left, and
    running past `rounds` is an error. The choices are then followed back from the last round to the
    first. Every round is written to the shared folder; only numbers of rows come to the driver. A node
    with very many links and a component with very many nodes are broadcast names, not one task's rows.
    """

    def dealt(node: str, turn: int) -> Column:
        return F.struct(F.xxhash64(F.lit(turn), F.col(node)).alias("h"), F.col(node).alias("rep"))

    left = materialised(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    levels, size = [], left.count()
    for turn in range(rounds):
        first = left.groupBy("a").agg(F.min(dealt("b", turn)).alias("k"), F.count("*").alias("degree"))
        chosen = materialised(first.select(F.col("a").alias("node"), F.least("k", dealt("a", turn))["rep"].alias("rep"), "degree"), "chosen")
        levels.append(chosen.select("node", "rep"))
        a, b = (chosen.select(F.col("node").alias(x), F.col("rep").alias(f"r{x}"), F.col("degree").alias(f"d{x}")) for x in "ab")
        moved = join_spread(join_spread(left, a, "a", "da", size), b, "b", "db", size).where("ra <> rb")
        left = materialised(moved.select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct(), "links")
        size = left.count()
        if not size:
            break
    else:
        raise RuntimeError(f"links are left after {rounds} rounds of contraction")
    labels = levels.pop()
    while levels:
        level = levels.pop()
        later = labels.select(F.col("node").alias("rep"), F.col("rep").alias("last"))
        given = level.groupBy("rep").agg(F.count("*").alias("members")).join(later, "rep", "left")
        named = join_spread(level, materialised(given, "given"), "rep", "members", level.count())
        labels = materialised(named.select("node", F.coalesce("last", "rep").alias("rep")), "labels")
    least = materialised(labels.groupBy("rep").agg(F.min("node").alias("component"), F.count("*").alias("members")), "least")
    return materialised(join_spread(labels, least, "rep", "members", labels.count()).select("node", "component"), "labels")
