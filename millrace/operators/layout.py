"""Page layout: columns of words, lines, sections of tables; paging of results."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEAST_WORDS, LEAST_CENTRES, GAP_SHARE, LINE_TOLERANCE = 30, 4, 0.10, 3.0


def column_splits(words: DataFrame, page: str = "page", centre: str = "x", width: str = "width") -> DataFrame:
    """page and split of pages set in two columns: the middle of the widest gap between word centres in the
    central 30 to 70 % of the page, if it is a tenth of the width or more; the leftmost of equal gaps."""
    sized = words.withColumn("_n", F.count("*").over(Window.partitionBy(page)))
    inner = sized.where((F.col("_n") >= LEAST_WORDS) & F.col(centre).between(0.3 * F.col(width), 0.7 * F.col(width)))
    w = Window.partitionBy(page).orderBy(centre)
    gaps = inner.withColumn("_m", F.count("*").over(Window.partitionBy(page))).withColumn("_next", F.lead(centre).over(w)).where(F.col("_next").isNotNull() & (F.col("_m") >= LEAST_CENTRES))
    best = gaps.groupBy(page).agg(F.max_by(F.struct(centre, "_next", width), F.struct(F.col("_next") - F.col(centre), -F.col(centre))).alias("g"))
    wide = best.where((F.col("g._next") - F.col(f"g.{centre}")) >= GAP_SHARE * F.col(f"g.{width}"))
    return wide.select(page, ((F.col("g._next") + F.col(f"g.{centre}")) / 2).alias("split"))


def lines(words: DataFrame, splits: DataFrame | None = None, page: str = "page") -> DataFrame:
    """Lines of a page's words (page, x, y, text): left column before right, words within 3 points of a line's
    first word belong to it. First fit is sequential, so a page is folded in one task."""
    joined = words.join(splits, page, "left") if splits is not None else words.withColumn("split", F.lit(None).cast("double"))
    kind = dict(words.dtypes)[page]

    def fold(g: pd.DataFrame) -> pd.DataFrame:
        g = g.assign(side=[0 if s is None or s != s or x < s else 1 for x, s in zip(g["x"], g["split"], strict=True)])
        out = []
        for side in (0, 1):
            held: list[tuple[float, list[tuple[float, str]]]] = []
            for r in g[g["side"] == side].sort_values(["y", "x"]).itertuples():
                line = next((t for y, t in held if abs(y - r.y) <= LINE_TOLERANCE), None)
                if line is None:
                    held.append((r.y, line := []))
                line.append((r.x, r.text))
            out += [" ".join(t for _, t in sorted(line)) for _, line in held]
        return pd.DataFrame({page: [g[page].iloc[0]] * len(out), "ord": range(len(out)), "text": out})

    return joined.groupBy(page).applyInPandas(fold, f"`{page}` {kind}, ord bigint, text string")


def with_section(tables: DataFrame, chunks: DataFrame, keys: list[str], order: str = "ord") -> DataFrame:
    """Tables with the section of the first text chunk of their page."""
    first = chunks.groupBy(*keys).agg(F.min_by("section", order).alias("section"))
    return tables.join(first, keys, "left")


def page_of(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """One page of an ordered listing."""
    if not 0 < limit <= 1000 or offset < 0:
        raise ValueError("limit must be 1 to 1000 and offset 0 or more")
    return df.orderBy(*order).offset(offset).limit(limit)


def page_estimate(blocks: DataFrame, chars: int = 3000, id_col: str = "doc_id") -> DataFrame:
    """Pages of a flowing document: a counter of characters that drops by `chars`, once a block, when it is crossed.
    Sequential, so a document is folded at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in batches:
            rows = []
            for i, texts in zip(g[id_col], g["texts"], strict=True):
                page, used = 0, 0
                for k, t in enumerate(texts):
                    rows.append((i, k, page))
                    used += len(t or "")
                    if used >= chars:
                        used, page = used - chars, page + 1
            yield pd.DataFrame(rows, columns=[id_col, "ord", "page"])

    whole = blocks.groupBy(id_col).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]).alias("texts"))
    return whole.mapInPandas(run, f"`{id_col}` {dict(blocks.dtypes)[id_col]}, ord bigint, page bigint")
