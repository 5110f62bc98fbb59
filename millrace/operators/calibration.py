"""Scores as probabilities: isotonic regression on labelled rows, by pooling neighbours that are out of order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cells of equal width that scores from 0 to 1 are dealt into.
CELLS = 1024


def cell_of(score: Column, cells: int = CELLS) -> Column:
    """A score's cell; scores outside 0 to 1 go to the first or last, null and NaN nowhere."""
    return F.when(score.isNotNull() & ~F.isnan(score), F.least(F.greatest(F.floor(score.cast("double") * cells), F.lit(0)), F.lit(cells - 1)).cast("int"))


def pooled(counts: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Blocks (first cell, rows, positives) with rising shares of positives, from cells (cell, rows, positives) in
    order. Shares are compared as whole numbers; blocks of equal shares become one."""
    out: list[tuple[int, int, int]] = []
    for cell, n, yes in counts:
        while out and out[-1][2] * n >= yes * out[-1][1]:
            cell, n, yes = out[-1][0], out[-1][1] + n, out[-1][2] + yes
            out.pop()
        out.append((cell, n, yes))
    return out


def learn(cells_and_labels: DataFrame, cell: str = "cell", label: str = "label", cells: int = CELLS) -> list[tuple[int, int, int]]:
    """Blocks from rows with a cell and a label of 0 or 1; rows without either don't count. One aggregation over all
    rows; what comes to the driver is a row for each cell, however many rows there are."""
    known = cells_and_labels.where(F.col(cell).between(0, cells - 1) & F.col(label).isin(0, 1))
    got = known.groupBy(cell).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("bigint")).alias("yes")).collect()
    return pooled(sorted((r[cell], r.n, r.yes) for r in got))


def confidence(cell: Column, blocks: list[tuple[int, int, int]]) -> Column:
    """The share of positives in the cell's block, null without a cell or a model. Cells before the first block have the
    first block's, cells between blocks the one before."""
    out = F.lit(None).cast("double")
    if blocks:
        steps = F.array(*[F.struct(F.lit(c).alias("c"), F.lit(yes / n).alias("p")) for c, n, yes in blocks])
        reached = F.filter(steps, lambda s: s["c"] <= cell)
        out = F.when(cell.isNotNull(), F.when(F.size(reached) > 0, F.element_at(reached, -1)["p"]).otherwise(blocks[0][2] / blocks[0][1]))
    return out


def error(rows: DataFrame, confidence: str = "confidence", label: str = "label", bins: int = 10) -> DataFrame:
    """One row: n labelled rows with a confidence and the expected calibration error, the mean distance of confidence and
    share of positives in `bins` bins, by their rows (null where there are none)."""
    known = rows.where(F.col(confidence).isNotNull() & F.col(label).isin(0, 1))
    by = known.groupBy(cell_of(F.col(confidence), bins).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(confidence).alias("said"), F.avg(label).alias("was"))
    return by.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.try_divide(F.sum(F.col("n") * F.abs(F.col("said") - F.col("was"))), F.sum("n")).alias("calibration_error"))
