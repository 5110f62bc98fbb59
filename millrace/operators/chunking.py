"""Documents to chunks. Rules that look at one row are columns; packing is a fold over one document's
parts and runs over Arrow batches, a document at a time, without a shuffle."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from millrace.functions.text import clean_chunk, prose_rows, strip, token_count

MOST, LEAST, TXT_LEAST, TXT_MOST, SIZE_OVERRIDE = 300, 30, 80, 512, 150
STRUCTURED, NARRATIVE = ("pptx", "xlsx", "xls", "csv"), ("eml", "msg")

# Fixed values.
ABBREVIATIONS = "mr mrs ms dr prof sr jr st vs etc e.g i.e fig no vol inc ltd co corp approx".split()
HEADING_MARK = r"^#{1,6}\s+\S"
CAPITALS = r"^[A-Z][A-Z\s\-]{3,}$"


def tokens_of(text: str) -> int:
    return max(1, len(text) // 4)


def heading_level(text: Column) -> Column:
    """1 to 6 for marked headings, 1 for a line of capitals, null for the rest."""
    s = strip(text)
    mark = F.length(F.regexp_extract(s, r"^(#{1,6})\s+\S", 1))
    return F.when(s.contains("\n"), None).when(mark > 0, mark).when(s.rlike(CAPITALS) & (F.length(s) <= 80), 1)


def structure(blocks: DataFrame, tables: DataFrame | None = None) -> DataFrame:
    """Per document: blocks, headings, marked headings, questions, tokens, and their ratios, in one aggregation."""
    level = heading_level(F.col("text"))
    asks = F.col("text").endswith("?") | F.col("text").rlike(r"(?i)^Q[.:\s]")
    got = blocks.groupBy("doc_id").agg(
        F.count("*").alias("blocks"), F.count(level).alias("headings"), F.count_if(strip(F.col("text")).rlike(HEADING_MARK)).alias("marked"),
        F.count_if(asks).alias("questions"), F.sum(token_count(F.col("text"))).cast("bigint").alias("tokens"),
    )
    got = got.join(tables.groupBy("doc_id").agg(F.count("*").alias("tables")), "doc_id", "left").fillna({"tables": 0}) if tables is not None else got.withColumn("tables", F.lit(0).cast("bigint"))
    return got.withColumns({
        "heading_ratio": F.col("headings") / F.col("blocks"), "question_ratio": F.col("questions") / F.col("blocks"),
        "avg_tokens": F.col("tokens") / F.col("blocks"), "table_density": F.col("tables") / F.greatest(F.lit(1.0), F.col("tokens") / MOST),
    })


def strategy(stats: DataFrame, extension: Column | None = None) -> DataFrame:
    """doc_type and strategy from the extension and the structure's ratios."""
    ext = F.lower(extension) if extension is not None else F.lit("")
    case = (
        F.when(ext.isin(*STRUCTURED), "structured/hierarchical")
        .when(ext.isin(*NARRATIVE), "narrative/contextual")
        .when(F.col("tokens") < SIZE_OVERRIDE, "narrative/contextual")
        .when(F.col("question_ratio") > 0.15, "narrative/contextual")
        .when((F.col("marked") >= 2) | (F.col("heading_ratio") > 0.20), "structured/hierarchical")
        .when((F.col("avg_tokens") > 60) & (F.col("heading_ratio") < 0.08), "narrative/contextual")
        .when((F.col("heading_ratio") > 0.12) | (F.col("table_density") > 0.15), "mixed/hierarchical")
        .otherwise("mixed/contextual")
    )
    return stats.withColumn("doc_type", F.split_part(case, F.lit("/"), F.lit(1))).withColumn("strategy", F.split_part(case, F.lit("/"), F.lit(2)))


def text_kind(text: Column) -> Column:
    """Plain text as structured, mixed or narrative by the shares of bullet and heading lines."""
    lines = F.split(text, "\r?\n")
    bullets = F.size(F.filter(lines, lambda x: x.rlike(r"^\s*[*\-•]\s+")))
    heads = F.size(F.filter(lines, lambda x: x.rlike(r"^\s*#{1,6}\s+") | x.rlike(r"^\d+[).]\s+[A-Z]") | F.rtrim(x).rlike(CAPITALS) | F.trim(x).rlike(r"^(_{3,}|={3,}|-{3,})$")))
    b, h = bullets / F.size(lines), heads / F.size(lines)
    return F.when((b > 0.20) | (h > 0.05), "structured").when((b > 0.05) | (h > 0.02), "mixed").otherwise("narrative")


def sentences(text: str) -> list[str]:
    """Sentences by their end signs; a sign after an abbreviation ends nothing."""
    out, start = [], 0
    for m in re.finditer(r"[.!?]+[\"')\]]*\s+|\n{2,}", text):
        word = re.search(r"([\w.]+)\.$", text[start : m.end()].rstrip())
        if word and word[1].lower() in ABBREVIATIONS:
            continue
        out.append(text[start : m.end()].strip())
        start = m.end()
    return [s for s in [*out, text[start:].strip()] if s]


def pack(parts: list[str], most: int = MOST, joiner: str = " ") -> list[str]:
    """Neighbours together up to `most` tokens, without overlap; a larger part stands alone."""
    out: list[str] = []
    held: list[str] = []
    size = 0
    for p in parts:
        n = tokens_of(p)
        if held and size + n > most:
            out.append(joiner.join(held))
            held, size = [], 0
        held.append(p)
        size += n
    return [*out, joiner.join(held)] if held else out


def group(parts: list[str], least: int = TXT_LEAST, most: int = TXT_MOST, bounds: set[int] | None = None, joiner: str = " ") -> list[str]:
    """Groups of least to most tokens; a boundary closes a group that is large enough; a small tail joins the last."""
    out: list[list[str]] = []
    held: list[str] = []
    size = 0
    for i, p in enumerate(parts):
        n = tokens_of(p)
        if held and (size + n > most or (bounds and i in bounds and size >= least)):
            out.append(held)
            held, size = [], 0
        held.append(p)
        size += n
    if held:
        if out and size < least:
            out[-1] += held
        else:
            out.append(held)
    return [joiner.join(x) for x in out]


def merge_small(chunks: list[str], least: int = TXT_LEAST, most: int = TXT_MOST, joiner: str = "\n") -> list[str]:
    """Chunks below `least` join a neighbour that has room, the one before if it can, until none can."""
    out = list(chunks)
    changed = True
    while changed:
        changed = False
        for i, c in enumerate(out):
            if tokens_of(c) < least:
                for a, b in ((i - 1, i), (i, i + 1)):
                    if a >= 0 and b < len(out) and tokens_of(out[a]) + tokens_of(out[b]) <= most:
                        out[a : b + 1] = [out[a] + joiner + out[b]]
                        changed = True
                        break
            if changed:
                break
    return out


def level_of(text: str) -> int | None:
    s = text.strip()
    m = re.match(r"(#{1,6})\s+\S", s)
    if m and "\n" not in s:
        return len(m[1])
    return 1 if re.match(CAPITALS, s) and len(s) <= 80 else None


def title(text: str) -> str:
    return re.sub(r"^#+\s+", "", text.strip())


def contextual(blocks: list[tuple[int, str]], most: int = MOST, least: int = LEAST) -> list[tuple[int, str | None, str]]:
    """Paragraph chunks (page, section, content): each under the nearest heading of its page, small ones
    joined within heading and page, large ones split at sentences."""
    held: list[tuple[int, str | None, str]] = []
    section, at_page = None, None
    for page, raw in blocks:
        if page != at_page:
            section, at_page = None, page
        for p in filter(None, (x.strip() for x in re.split(r"\n{2,}", raw))):
            if level_of(p):
                section = title(p)
            elif held and held[-1][:2] == (page, section) and (tokens_of(held[-1][2]) < least or tokens_of(p) < least) and tokens_of(held[-1][2]) + tokens_of(p) <= most:
                held[-1] = (page, section, f"{held[-1][2]}\n{p}")
            else:
                held.append((page, section, p))
    out = []
    for page, head, text in held:
        for part in [text] if tokens_of(text) <= most else pack(sentences(text), most):
            out.append((page, head, f"[{head}] {part}" if head else part))
    return out


def hierarchical(blocks: list[tuple[int, str]], most: int = MOST) -> list[tuple[int, str | None, str]]:
    """Chunks under the whole path of headings: a heading closes those of its level and below."""
    stack: list[tuple[int, str]] = []
    out: list[tuple[int, str | None, str]] = []
    held: list[str] = []
    page_of = 0

    def close() -> None:
        if held:
            path = " > ".join(t for _, t in stack)
            for part in pack([s for p in held for s in ([p] if tokens_of(p) <= most else sentences(p))], most, "\n"):
                out.append((page_of, stack[-1][1] if stack else None, f"[{path}] {part}" if path else part))
            held.clear()

    for page, raw in blocks:
        for p in filter(None, (x.strip() for x in re.split(r"\n{2,}", raw))):
            level = level_of(p)
            if level or page != page_of:
                close()
                page_of = page
            if level:
                while stack and stack[-1][0] >= level:
                    stack.pop()
                stack.append((level, title(p)))
            else:
                held.append(p)
    close()
    return out


def table_chunks(markdown: str, most: int = MOST) -> list[str]:
    """A pipe table in parts of at most `most` tokens, each with the header lines; a long row stands alone."""
    lines = [x for x in markdown.splitlines() if x.strip()]
    head = lines[: 2 if len(lines) > 1 and re.fullmatch(r"[|\s:-]+", lines[1]) else 1]
    top = "\n".join(head)
    rows = pack(lines[len(head) :], max(1, most - tokens_of(top)), "\n")
    return [f"{top}\n{r}" for r in rows] or ([top] if top else [])


def segments(text: str) -> list[tuple[str, str]]:
    """Runs of pipe-table lines and prose, in order: ("table" or "text", content)."""
    out: list[tuple[str, list[str]]] = []
    for line in text.splitlines():
        kind = "table" if line.strip().startswith("|") and line.strip().endswith("|") and len(line.strip()) > 1 else "text"
        if not out or out[-1][0] != kind:
            out.append((kind, []))
        out[-1][1].append(line)
    return [(k if k == "text" or len(x) > 1 else "text", "\n".join(x).strip()) for k, x in out if "\n".join(x).strip()]


def figures(text: Column) -> Column:
    """Captions of figure markers."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"\[(?:FIGURE|IMAGE)(?::\s*([^\]]*))?\]"), F.lit(1)), lambda c: F.when(strip(c) == "", F.lit("Figure")).otherwise(strip(c)))


def valleys(similarities: DataFrame, key: str = "doc_id", order: str = "ord", sim: str = "sim") -> DataFrame:
    """Places after which a text turns: similarity below both neighbours and below mean - std / 2; at least three."""
    w = Window.partitionBy(key).orderBy(order)
    whole = Window.partitionBy(key)
    low = (F.col(sim) < F.lag(sim).over(w)) & (F.col(sim) < F.lead(sim).over(w)) & (F.col(sim) < F.avg(sim).over(whole) - 0.5 * F.stddev_pop(sim).over(whole)) & (F.count("*").over(whole) >= 2)
    return similarities.withColumn("_low", low).where("_low").select(key, (F.col(order) + 1).alias("boundary"))


def fold(docs: DataFrame, f: Callable[[list[tuple[int, str]]], list[tuple[int, str | None, str]]], id_col: str = "doc_id", blocks: str = "blocks") -> DataFrame:
    """Apply a chunker to rows (id, blocks array<struct<page,text>>): id, ord, page, section, content."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in batches:
            rows = [(i, k, page, section, content) for i, b in zip(g[id_col], g[blocks], strict=True) for k, (page, section, content) in enumerate(f([(int(x["page"]), x["text"] or "") for x in (b if b is not None else [])]))]
            yield pd.DataFrame(rows, columns=[id_col, "ord", "page", "section", "content"])

    return docs.select(id_col, blocks).mapInPandas(run, f"`{id_col}` {dict(docs.dtypes)[id_col]}, ord bigint, page bigint, section string, content string")


def as_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Whole texts as documents of one block."""
    return docs.select(F.col(id_col), F.array(F.struct(F.lit(0).alias("page"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))).alias("blocks"))


def table_to_prose(rows: Column) -> Column:
    return prose_rows(rows)


@F.pandas_udf(StringType())
def document_uuid(name: pd.Series) -> pd.Series:
    """A version-5 UUID of a document's name in the URL namespace."""
    return name.map(lambda x: str(uuid.uuid5(uuid.NAMESPACE_URL, x)), na_action="ignore")


def finalise(chunks: DataFrame, source: str = "source", order: list[str] | None = None) -> DataFrame:
    """Clean contents, drop empty ones, number the rest from 1 in their source and count them; pages from 1."""
    cleaned = chunks.withColumn("content", clean_chunk(F.col("content"))).where("content <> ''")
    w = Window.partitionBy(source).orderBy(*(order or ["ord"]))
    return cleaned.withColumns({
        "chunk_index": F.row_number().over(w).cast("bigint"), "chunk_total": F.count("*").over(Window.partitionBy(source)),
        "token_count": token_count(F.col("content")).cast("bigint"), "page_start": F.col("page") + 1, "page_end": F.col("page") + 1,
    })


def page_ids(chunks: DataFrame, source: str = "source", order: str = "ord") -> DataFrame:
    """chunk_id: source, page from 1, kind, and a counter from 0 over all kinds of a page."""
    n = F.row_number().over(Window.partitionBy(source, "page").orderBy(order)) - 1
    return chunks.withColumn("chunk_id", F.concat(F.col(source), F.lit("_p"), F.col("page") + 1, F.lit("_"), F.col("type"), n))


def txt(text: str, most: int = TXT_MOST, least: int = TXT_LEAST) -> list[str]:
    """A plain text's chunks by its kind: structured texts break at headings, others at blank lines; parts are
    grouped by budget, tables kept whole, and small ones joined."""
    lines = re.split("\r?\n", text)
    heads = [bool(level_of(x) or re.match(r"^\d+[).]\s+[A-Z]", x) or re.match(r"^(_{3,}|={3,}|-{3,})$", x.strip())) for x in lines]
    structured = len(lines) > 0 and (sum(heads) / len(lines) > 0.05 or sum(bool(re.match(r"^\s*[*\-•]\s+", x)) for x in lines) / len(lines) > 0.20)
    out: list[str] = []
    for kind, part in segments(text):
        if kind == "table":
            out += table_chunks(part, most)
        elif structured:
            pieces: list[list[str]] = [[]]
            for x in part.splitlines():
                if level_of(x) and pieces[-1]:
                    pieces.append([])
                pieces[-1].append(x)
            out += [c for p in pieces for c in pack(["\n".join(p)] if tokens_of("\n".join(p)) <= most else p, most, "\n")]
        else:
            out += group([s for p in re.split(r"\n{2,}", part) for s in ([p.strip()] if tokens_of(p) <= most else sentences(p)) if s], least, most)
    return merge_small([c for c in out if c.strip()], least, most)


def statistics(chunks: DataFrame, kind: str = "type") -> DataFrame:
    return chunks.agg(F.count("*").alias("total"), *[F.count_if(F.col(kind) == k).alias(k) for k in ("text", "table", "image")], F.sum("token_count").cast("bigint").alias("tokens"))


def email_header(sender: Column, to: Column, subject: Column, date: Column) -> Column:
    part = lambda name, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{name}: "), c))
    return F.concat_ws("\n", part("Subject", subject), part("From", sender), part("To", to), part("Date", date))


def without_quotes(text: Column) -> Column:
    """An email's own words: everything from a signature mark on goes, and runs of quoted lines."""
    body = F.regexp_replace(text, r"(?s)(^|\n)-- ?\r?\n.*$", "")
    lines = F.filter(F.split(body, "\r?\n"), lambda x: ~x.rlike(r"^\s*>") & ~x.rlike(r"(?i)^\s*(on .{0,120} wrote:|-+ ?original message ?-+)\s*$"))
    return strip(F.regexp_replace(F.array_join(lines, "\n"), r"\n{3,}", "\n\n"))
