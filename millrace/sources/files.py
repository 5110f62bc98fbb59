"""Readers of documents and tables, all through Spark's own file sources."""

from __future__ import annotations

import csv
import email
import email.policy
import io
import re
import signal
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from millrace.functions.text import file_stem, html_to_text, strip
from millrace.operators.profile import slugged
from millrace.sources.records import records

TEXT_TYPES = ("txt", "md", "json", "xml", "yaml", "yml", "sql", "log")
#: First bytes of known file types, in hexadecimal.
MAGIC = {"pdf": "25504446", "docx": "504B0304", "xlsx": "504B0304", "pptx": "504B0304", "png": "89504E47", "jpg": "FFD8FF", "gif": "47494638"}
BLOCKS = "path string, ord bigint, page bigint, kind string, text string"


def binary(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, content and its md5."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "length", "content", F.md5("content").alias("file_hash"))


def listing(spark: SparkSession, path: str) -> DataFrame:
    """path, length and modificationTime of every file below a path; contents aren't read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", "modificationTime")


def magic_fits(content: Column, extension: Column) -> Column:
    """Whether the first bytes are what the extension promises; other extensions always fit."""
    head = F.hex(F.substring(content, 1, 4))
    out = F.lit(True)
    for ext, mark in MAGIC.items():
        out = F.when(F.lower(extension) == ext, head.startswith(mark)).otherwise(out)
    return out


def text(spark: SparkSession, path: str) -> DataFrame:
    """path, ord, text: parts of whole files between blank lines."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value"))
    parts = F.filter(F.transform(F.split("value", r"\n\s*\n"), strip), lambda p: p != "")
    return whole.select("path", F.posexplode(parts).alias("ord", "text")).withColumn("ord", F.col("ord").cast("bigint"))


def sniff(head: str) -> tuple[str, bool]:
    """Separator (comma, semicolon, tab or pipe) and whether there is a header, from a file's first lines."""
    lines = [x for x in head.splitlines()[:20] if x.strip()]
    counts = {s: [x.count(s) for x in lines] for s in ",;\t|"}
    best = max(counts, key=lambda s: (min(counts[s], default=0) > 0, sum(counts[s])))
    rows = list(csv.reader(lines, delimiter=best))
    number = re.compile(r"^-?\d+([.,]\d+)?$")
    header = bool(rows) and not any(number.match(c.strip()) for c in rows[0])
    return best, header


def encoding_of(head: bytes) -> str:
    """utf-8 (with or without a mark) if it decodes, else windows-1252."""
    if head.startswith(b"\xef\xbb\xbf"):
        return "utf-8-sig"
    try:
        head.decode("utf-8")
        return "utf-8"
    except UnicodeDecodeError as e:
        return "utf-8" if e.start > len(head) - 4 else "windows-1252"


def read_csv(spark: SparkSession, path: str, separator: str | None = None, header: bool | None = None) -> DataFrame:
    """A CSV table with slugged columns. Rows with more fields than the header go, shorter ones are filled
    with nulls. The separator and header are read off the first lines, through Spark. Quoted fields may hold separators,
    line breaks and doubled quotes; files are read in parallel all the same."""
    raw = spark.read.option("lineSep", "\n").text(path).where(F.trim("value") != "")
    head = "\n".join(r.value for r in raw.limit(20).collect()).lstrip("\ufeff")
    found, has = sniff(head)
    separator, header = separator or found, has if header is None else header
    first = next(csv.reader(io.StringIO(head, newline=""), delimiter=separator)) if head else []
    names = first if header else [f"col_{i}" for i in range(len(first))]
    # one column more than there are names: what reaches it comes from a row with too many fields
    schema = ", ".join(f"c{i} string" for i in range(len(names) + 1))
    rows = records(spark, path, separator)
    rows = rows.where("line > 0") if header else rows.withColumn("value", F.when(F.col("line") == 0, F.regexp_replace("value", "^\ufeff", "")).otherwise(F.col("value")))
    parsed = rows.select(F.from_csv("value", F.lit(schema), {"sep": separator, "quote": '"', "escape": '"', "mode": "PERMISSIVE", "maxCharsPerColumn": "-1"}).alias("r")).select("r.*")
    kept = parsed.where(F.col(f"c{len(names)}").isNull()).drop(f"c{len(names)}")
    return slugged(kept.toDF(*names))


def row_batches(rows: DataFrame, number: str = "row_number", size: int = 50) -> DataFrame:
    """Trimmed rows without empty ones, as pipe-separated lines in batches under a repeated header."""
    names = [c for c in rows.columns if c != number]
    cells = F.array(*[F.trim(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))) for c in names])
    line = rows.select(F.col(number).alias("n"), F.array_join(cells, " | ").alias("line"), F.exists(cells, lambda c: c != "").alias("full")).where("full")
    batch = line.groupBy(F.floor(F.col("n") / size).cast("bigint").alias("batch")).agg(F.count("*").alias("n_rows"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n").alias("body"))
    return batch.select("batch", "n_rows", F.concat(F.lit(" | ".join(names) + "\n"), F.col("body")).alias("text"))


class _Tables(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.tables: list[list[list[str]]] = []
        self.open: list[list[list[str]]] = []
        self.cell: list[str] | None = None

    def _close(self) -> None:
        """End the open cell, with or without its end tag."""
        if self.cell is not None and self.open and self.open[-1]:
            self.open[-1][-1].append(" ".join("".join(self.cell).split()))
        self.cell = None

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag == "table":
            self.open.append([])
        elif tag == "tr" and self.open:
            self._close()
            self.open[-1].append([])
        elif tag in ("td", "th") and self.open:
            self._close()
            if not self.open[-1]:
                self.open[-1].append([])
            self.cell = []

    def handle_endtag(self, tag: str) -> None:
        if tag in ("td", "th", "tr") and self.open:
            self._close()
        elif tag == "table" and self.open:
            self._close()
            rows = [r for r in self.open.pop() if r]
            width = max(map(len, rows), default=0)
            if rows:
                self.tables.append([r + [""] * (width - len(r)) for r in rows])

    def handle_data(self, data: str) -> None:
        if self.cell is not None:
            self.cell.append(data)


def tables_in(html: str) -> list[list[list[str]]]:
    p = _Tables()
    p.feed(html or "")
    return p.tables


@F.pandas_udf(ArrayType(ArrayType(ArrayType(StringType()))))
def html_tables(html: pd.Series) -> pd.Series:
    """All tables of a page, short rows padded."""
    return html.map(tables_in)


def pages_text(pages: DataFrame, html: str = "html") -> DataFrame:
    return pages.withColumn("text", html_to_text(F.col(html)))


def _mail(raw: bytes, known: dict | None = None) -> list[tuple[int, str, str]]:
    """(page, kind, text) of a message; attachment n goes through the same readers, mails in mails included, and
    has its pages from 1000 * (n + 1) on and a tag. One that fails gives a row of kind "error", one without
    a reader its size."""
    known = READERS if known is None else known
    m = email.message_from_bytes(raw, policy=email.policy.default)
    head = "\n".join(f"{k}: {m[k]}" for k in ("Subject", "From", "To", "Date") if m[k])
    plain, rich, files = [], [], []
    for part in m.walk():
        if part.is_multipart():
            continue
        name = part.get_filename()
        if name:
            files.append((name, part.get_payload(decode=True) or b""))
        elif part.get_content_type() in ("text/plain", "text/html"):
            (plain if part.get_content_type() == "text/plain" else rich).append(part.get_content())
    grids = [t for h in rich for t in tables_in(h)]
    page = re.sub(r"(?is)<(style|script)[^>]*>.*?</\1>", "", "\n".join(rich))
    body = re.sub(r"[ \t]+", " ", re.sub(r"<[^>]+>", " ", page)) if rich and (grids or not plain) else "\n".join(plain)
    out = [(0, "header", head)] if head else []
    out += [(0, "text", p.strip()) for p in re.split(r"\n\s*\n", body) if p.strip()]
    out += [(0, "table", "\n".join(" | ".join(r) for r in t)) for t in grids]
    for n, (name, data) in enumerate(files):
        ext = name.rsplit(".", 1)[-1].lower()
        try:
            if ext in known:
                inner = _read(name, data, known)
            elif ext == "csv":
                inner = [(0, "table", p.strip()) for p in data.decode("utf-8", "replace").split("\n\n") if p.strip()]
            else:
                inner = [(0, "attachment", f"{len(data)} bytes")]
        except Exception as e:
            inner = [(0, "error", str(e)[:500])]
        out += [(1000 * (n + 1) + p, k, f"[attachment:{name}]\n{t}") for p, k, t in inner]
    return out


def _xlsx(raw: bytes) -> list[tuple[int, str, str]]:
    """Sheets as batches of 50 rows under their header; a sheet ends after 100 empty rows. Needs openpyxl."""
    try:
        import openpyxl
    except ImportError as e:
        raise RuntimeError("reading xlsx needs openpyxl") from e
    out = []
    book = openpyxl.load_workbook(io.BytesIO(raw), read_only=True, data_only=True)
    for k, sheet in enumerate(book.worksheets):
        rows, empty = [], 0
        for r in sheet.iter_rows(values_only=True):
            cells = ["" if c is None else str(c).strip() for c in r]
            empty = 0 if any(cells) else empty + 1
            if empty > 100:
                break
            if any(cells):
                rows.append(" | ".join(cells))
        if rows:
            out.append((k, "summary", f"Sheet {sheet.title}: {len(rows) - 1} rows"))
            out += [(k, "table", "\n".join([rows[0], *rows[i : i + 50]])) for i in range(1, max(2, len(rows)), 50)]
    return out


#: Names of numbered heading styles, of title styles (level 1) and of subtitle styles (level 2).
HEADINGS = r"(?:heading|titre|überschrift|kop|intestazione|título|encabezado|cabeçalho|rubrik|overskrift)\s*(\d+)"
TITLES = ("title", "titre", "titel", "titolo", "título", "tittel")
SUBTITLES = ("subtitle", "sous-titre", "untertitel", "subtítulo")


def heading_level(style: str) -> int:
    """1 to 6 for a heading, title or subtitle style, 0 for any other."""
    name = style.strip().lower()
    if numbered := re.match(HEADINGS, name):
        return int(numbered[1]) if 1 <= int(numbered[1]) <= 6 else 0
    return 1 if name in TITLES else 2 if name in SUBTITLES else 0


def _zip_text(raw: bytes, member: str, tag: str) -> list[tuple[int, str, str]]:
    """Paragraphs of an Office Open XML part, in the order of its members."""
    import zipfile
    from xml.etree import ElementTree

    out = []
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        names = sorted((n for n in z.namelist() if re.fullmatch(member, n)), key=lambda n: [int(x) if x.isdigit() else x for x in re.split(r"(\d+)", n)])
        for page, n in enumerate(names):
            used = 0
            for p in ElementTree.fromstring(z.read(n)).iter():
                if p.tag.endswith("}p"):
                    t = "".join(x.text or "" for x in p.iter() if x.tag.endswith("}t")).strip()
                    if t:
                        style = next((v for x in p.iter() if x.tag.endswith("}pStyle") for v in x.attrib.values()), "")
                        level = heading_level(style)
                        used += len(t)
                        out.append((used // 3000 if tag == "docx" else page, "heading" if level else "text", f"{'#' * level} {t}" if level else t))
    return out


READERS = {
    "eml": _mail,
    "xlsx": _xlsx,
    "docx": lambda raw: _zip_text(raw, r"word/document\.xml", "docx"),
    "pptx": lambda raw: _zip_text(raw, r"ppt/slides/slide\d+\.xml", "pptx"),
    **{ext: (lambda raw: [(0, "text", p.strip()) for p in re.split(r"\n\s*\n", raw.decode(encoding_of(raw[:65536]), "replace")) if p.strip()]) for ext in TEXT_TYPES},
    "html": lambda raw: [(0, "text", re.sub(r"\s+", " ", re.sub(r"<[^>]+>", " ", re.sub(r"(?is)<(style|script)[^>]*>.*?</\1>", "", raw.decode("utf-8", "replace")))).strip())],
}


def _read(name: str, raw: bytes, known: dict) -> list[tuple[int, str, str]]:
    """Blocks of a file by the reader for its extension."""
    read = known.get(name.rsplit(".", 1)[-1].lower())
    if read is None:
        return [(0, "error", "no reader")]
    return _mail(raw, known) if read is _mail else read(raw)


class _Late(Exception):
    """A reader took too long."""


def _within(seconds: float | None, f, *args):
    """f(*args), given up after so many seconds. Signals reach a worker's main thread, which runs readers."""
    if not seconds:
        return f(*args)

    def late(*_):
        raise _Late(f"not read within {seconds:g} s")

    before = signal.signal(signal.SIGALRM, late)
    signal.setitimer(signal.ITIMER_REAL, seconds)
    try:
        return f(*args)
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, before)


def documents(spark: SparkSession, path: str, readers: dict | None = None, most_bytes: int = 50 << 20, seconds: float | None = 120) -> DataFrame:
    """Blocks of every file below a path, by a reader for its extension: path, ord, page, kind, text. A reader
    is any function from bytes to (page, kind, text) - PDF and image readers are plugged in here. A file
    that fails, has no reader, is larger than most_bytes or takes longer than `seconds` gives one row of
    kind "error"; contents of files that are too large aren't loaded."""
    known = READERS | (readers or {})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in batches:
            rows = []
            for name, raw in zip(g["path"], g["content"], strict=True):
                try:
                    found = [(0, "error", f"larger than {most_bytes} bytes")] if raw is None else _within(seconds, _read, name, bytes(raw), known)
                except Exception as e:
                    found = [(0, "error", str(e)[:500])]
                rows += [(name, i, page, kind, t) for i, (page, kind, t) in enumerate(found)]
            yield pd.DataFrame(rows, columns=["path", "ord", "page", "kind", "text"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    small = files.where(F.col("length") <= most_bytes).select("path", "content")
    large = files.where(F.col("length") > most_bytes).select("path", F.lit(None).cast("binary").alias("content"))
    return small.unionByName(large).mapInPandas(run, BLOCKS)


def stem(path: Column) -> Column:
    return file_stem(path)
