"""Cleaning of text blocks (doc_id, ord, page, text)."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import LEAST_BLOCK, is_noise, is_noise_stripped, normalise_block, strip


def paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", separator: str = "\n\n") -> DataFrame:
    """Nonempty paragraphs of each text: id, ord from 0, text."""
    parts = F.filter(F.transform(F.split(F.col(text_col), separator), strip), lambda p: p != "")
    # the outer form, as Spark would find the parts once more to leave texts without any out
    return docs.select(F.col(id_col), F.posexplode_outer(parts).alias("ord", "text")).where("ord IS NOT NULL").withColumn("ord", F.col("ord").cast("bigint"))


def once(blocks: DataFrame, column: str, value: Column) -> DataFrame:
    """The column's value, computed once a row: conditions on a plain column would each compute it again."""
    return blocks.select(*[F.explode(F.array(value)).alias(c) if c == column else F.col(c) for c in blocks.columns])


def key_of(text):
    return F.lower(strip(text))


def without_noise(blocks: DataFrame, least: int = LEAST_BLOCK) -> DataFrame:
    return blocks.where(~is_noise(F.col("text"), least))


def without_running_heads(blocks: DataFrame, times: int = 3, longest: int = 80) -> DataFrame:
    """Short blocks that a document repeats are headers and footers: they go."""
    key = key_of(F.col("text"))
    whole = Window.partitionBy("doc_id", key).orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # sorted as `distinct` needs it
    seen = F.count("*").over(whole)
    return blocks.withColumn("_n", seen).where(~((F.length(key) < longest) & (F.col("_n") >= times))).drop("_n")


def distinct(blocks: DataFrame) -> DataFrame:
    """Of blocks with the same text, case aside, a document keeps the first."""
    first = F.row_number().over(Window.partitionBy("doc_id", key_of(F.col("text"))).orderBy("ord"))
    return blocks.withColumn("_n", first).where("_n = 1").drop("_n")


#: Classes of characters that bound how alike two texts can be.
_CLASSES = 64


def new_blocks(keys: list[str], ratio: float = 0.92, window: int = 6, shrinking: bool = False) -> tuple[list[bool], int]:
    """Which keys resemble none of the `window` kept before them, and how many pairs were aligned.

    Two texts' ratio is at most twice the characters that they share, order aside, over the sum of their lengths. Only pairs
    whose bound reaches the ratio are aligned; equal texts need no alignment.
    """
    import difflib

    import numpy as np

    counts = np.zeros((len(keys), _CLASSES), np.int32)
    for i, key in enumerate(keys):
        counts[i] = np.bincount(np.frombuffer(key.encode("utf-32-le"), np.uint32) % _CLASSES, minlength=_CLASSES)
    size = counts.sum(1)
    kept: list[int] = []
    mask, aligned = [], 0
    for i, key in enumerate(keys):
        recent = kept[max(0, i - window) :] if shrinking else kept[-window:]
        shared = np.minimum(counts[recent], counts[i]).sum(1)
        new, aligner = True, difflib.SequenceMatcher(None, key)
        for j in [r for r, most in zip(recent, 2 * shared - ratio * (size[recent] + size[i]), strict=True) if most >= -1e-6]:
            if keys[j] == key:
                new = False
                break
            aligned += 1
            aligner.set_seq2(keys[j])
            if aligner.ratio() >= ratio:
                new = False
                break
        mask.append(new)
        if new:
            kept.append(i)
    return mask, aligned


def without_near_copies(blocks: DataFrame, ratio: float = 0.92, window: int = 6, shrinking: bool = False) -> DataFrame:
    """Blocks that resemble one of the `window` kept before them go; whole texts are compared. `shrinking` narrows the window by each
    block removed, down to none, as an older behaviour did. Null texts count as empty.

    Where a document has no two blocks whose bounds of likeness reach the ratio, nothing is aligned.
    """
    import numpy as np
    import pyarrow as pa

    names = blocks.columns
    id_at, text_at = names.index("doc_id"), names.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done() -> Iterator[pa.RecordBatch]:
            """What stays of the whole documents held, and the last, perhaps unfinished one is held on."""
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            ids = rows.column(id_at).dictionary_encode(null_encoding="encode").indices.to_numpy()
            edge = np.r_[0, np.flatnonzero(np.diff(ids)) + 1, len(ids)].tolist()
            upto = edge[-1] if ended else edge[-2]
            keys = [(t or "").lower().strip() for t in rows.column(text_at).slice(0, upto).to_pylist()]
            mask = [m for lo, hi in zip(edge[:-1], edge[1:], strict=True) if hi <= upto for m in new_blocks(keys[lo:hi], ratio, window, shrinking)[0]]
            held[:] = [rows.slice(upto)] if upto < len(ids) else []
            if upto:
                yield rows.slice(0, upto).filter(pa.array(mask, pa.bool_()))

        ended, most = False, 1
        for b in batches:
            if b.num_rows:
                held.append(b)
            if sum(h.num_rows for h in held) > most:
                yield from done()
                most = 2 * sum(h.num_rows for h in held)
        ended = True
        if held:
            yield from done()

    # documents come sorted, many to a batch: a call of Python for each document would cost more than what it does
    return blocks.repartition("doc_id").sortWithinPartitions("doc_id", "ord").mapInArrow(keep, blocks.schema)


def rejoined(blocks: DataFrame) -> DataFrame:
    """Join fragments of one page: after a hyphen without a blank, and a lower-case start after a letter or
    digit with one. Islands are numbered by a running sum of boundaries."""
    w = Window.partitionBy("doc_id").orderBy("ord")
    before, page = F.lag("text").over(w), F.lag("page").over(w)
    glued = before.rlike(r"-\s*$")
    spaced = before.rlike(r"[a-zA-ZÀ-ÿ0-9]$") & F.col("text").rlike(r"^[a-zàâéèêëîïôùûüÿœæç]")
    joins = F.coalesce((page == F.col("page")) & (glued | spaced), F.lit(False))
    marked = blocks.withColumn("_join", joins).withColumn("_glue", F.coalesce(glued, F.lit(False)))
    island = marked.withColumn("_i", F.sum((~F.col("_join")).cast("int")).over(w))
    ends_hyphen = F.lead("_glue").over(w) & F.lead("_join").over(w)
    piece = F.when(F.coalesce(ends_hyphen, F.lit(False)), F.regexp_replace("text", r"-\s*$", "")).otherwise(F.col("text"))
    lead = F.when(F.col("_join") & ~F.col("_glue"), " ").otherwise("")
    parts = island.withColumn("_piece", F.concat(lead, piece))
    return parts.groupBy("doc_id", "_i").agg(F.min("ord").alias("ord"), F.first("page").alias("page"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "_piece"))), lambda x: x["_piece"]), "").alias("text")).drop("_i")


def clean(blocks: DataFrame, *, heads: bool = True, copies: bool = True, near: bool = False, rejoin: bool = True, least: int = LEAST_BLOCK) -> DataFrame:
    """The whole pipeline: normalise, noise, running heads, copies, fragments, normalise, noise."""
    tidy = lambda b: once(b, "text", normalise_block(F.col("text"))).where(~is_noise_stripped(F.col("text"), least))
    out = tidy(blocks.repartition("doc_id"))  # all that follows is by document, so blocks are shuffled once
    out = without_running_heads(out) if heads else out
    out = distinct(out) if copies else out
    out = without_near_copies(out) if near else out
    return tidy(rejoined(out) if rejoin else out)


def carry_headings(blocks: DataFrame, heading: str = "heading", key: list[str] | None = None) -> DataFrame:
    """The last heading so far, from null again at each new key (a document, or a document and page)."""
    w = Window.partitionBy(*(key or ["doc_id"])).orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    return blocks.withColumn("section", F.last(heading, ignorenulls=True).over(w))
