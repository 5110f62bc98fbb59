"""Column expressions over text. All are built-in functions, so they stay in the JVM."""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Patterns whose matches must be the same as everywhere else. Java syntax.
#: Markdown removed before embedding: (pattern, replacement), in order.
EMBEDDING_RULES = [
    (r"\|[^\n]+\|", " "),
    (r"(?m)^#+\s+", ""),
    (r"\*{1,3}([^*]+)\*{1,3}", "$1"),
    (r"`{1,3}[^`]*`{1,3}", " "),
    (r"(?m)^---+\s*$", ""),
    (r"\[([^\]]+)\]\([^)]+\)", "$1"),
    (r"[ \t]{2,}", " "),
    (r"\n{3,}", "\n\n"),
]
#: Noise removed from chunks, in order.
CHUNK_RULES = [
    ("[\u00a0\ufeff\u200b\u200c\u200d\u00ad\u2028\u2029\u00b7\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]", " "),
    (r"(?m)^#{1,6}\s+", ""),
    (r"\*{1,3}(.+?)\*{1,3}", "$1"),
    (r"\[([^\]]*)\]\([^)]*\)", "$1"),
    (r"(?m)^[-*_]{3,}\s*$", ""),
    (r"(?m)^>\s+", ""),
    (r"[-=.|]{4,}", ""),
    (r"[ \t]{2,}", " "),
    (r"\n{3,}", "\n\n"),
]
#: HTML to text, in order.
HTML_RULES = [
    (r"(?is)<style[^>]*>.*?</style>", ""),
    (r"(?is)<script[^>]*>.*?</script>", ""),
    (r"<[^>]+>", " "),
    (r"[ \t]+", " "),
    (r"\n{3,}", "\n\n"),
]
PAGE_NUMBER = r"^\s*\d{1,4}\s*$"
NOISE = r"""^[\d\s.,;:!?\-—–()\[\]{}/\\|'"«»…†§%°#@&*+=~^`]+$"""
LEAST_BLOCK = 15
NO_ANSWER = (
    r"(?i)\b(don['’]?t\s+have\s+enough\s+information"
    r"|cannot\s+(?:answer|determine|find|provide|give)"
    r"|no\s+(?:relevant\s+)?information\s+(?:available|provided|found|in\s+the)"
    r"|not\s+(?:mentioned|discussed|covered|addressed|found)\s+in\s+the"
    r"|(?:the\s+)?(?:provided\s+)?context\s+does\s+not\s+(?:contain|include|mention|provide)"
    r"|i\s+am\s+unable\s+to\s+(?:answer|determine|provide))\b"
)
ESCALATE = (
    r"(?i)\b(speak\s+to\s+(a\s+)?(human|agent|person|manager|representative|rep|supervisor)"
    r"|talk\s+to\s+(a\s+)?(human|agent|person|manager|representative|rep|supervisor)"
    r"|connect\s+me\s+(with|to)\s+(a\s+)?(human|agent|person|manager|representative)"
    r"|escalat(e|ing|ion)|transfer\s+me|live\s+(chat|agent|support)|real\s+person)\b"
)
REFERENCE = (
    r"(?i)\b(it|its|they|them|their|this|that|these|those|the same|same|above|previous|prior|earlier"
    r"|last|next|another|other|such|he|she|him|her|explain|elaborate|expand|continue|more|further|again)\b"
)
BOILERPLATE = (
    r"(?i)(hope (you are|this email finds) (you )?(\w+ ?)+)"
    r"|(please find (the |this )?(revised |updated |)?(document|file|report|version)? ?(attached|below))"
    r"|(best regards|kind regards|warm regards|yours sincerely|yours faithfully)"
    r"|(thank you for (your )?(support|time|consideration|feedback|patience))"
    r"|(do not hesitate to (contact|reach out|get back))"
    r"|(looking forward to (hearing|meeting|your (reply|response|feedback)))"
    r"|(have a (great|good|nice|wonderful) (day|week|weekend))"
    r"|(feel free to (contact|reach out|let me know))"
)
BOILERPLATE_TOKENS = 60
#: Entities carried into a follow-up question. The money and percent patterns have no word boundary
#: beside their sign, where none can be.
ENTITIES = [r"\b[A-Z]{2,}\b", r"\b[A-Z][a-z]{2,}(?:\s[A-Z][a-z]{2,})*\b", r"\$[\d,.]+[BMK]?", r"\b\d{4}\b", r"(?i)\bQ[1-4]\s?\d{4}\b", r"\b\d+(?:\.\d+)?%", r'"[^"]{3,40}"']
ENTITY_STOPWORDS = (
    "the a an and or but in on at to for of with by from is are was were be been have has had do does did will would could "
    "should may might shall can not no nor so yet both either neither each every all any few more most other some such only own "
    "same than too very just also as if because while although though since when where which who whom what how why that this "
    "these those there here revenue income expenses costs profit loss results figures data information details answer question "
    "report said stated noted according"
).split()
CITATION = r"(?i)\[Source:\s*([^,\]]+?)(?:,\s*page\s+(\d+))?\]"
CHUNK_LABELS = {"text": "", "table": "[TABLE] ", "image": "[IMAGE CAPTION] "}

#: What strip() takes from both ends.
BLANKS = " \t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\u00a0\u2028\u2029\u3000"


def rewrite(text: Column, rules: list[tuple[str, str]]) -> Column:
    """Apply replacements in order."""
    return reduce(lambda t, r: F.regexp_replace(t, r[0], r[1]), rules, text)


def strip(text: Column) -> Column:
    return F.trim(text, F.lit(BLANKS))


def tokens(text: Column) -> Column:
    """Lower-case words of letters, digits and underscores of any script, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\b\w+\b"), F.lit(0))


def token_count(text: Column, divisor: float = 4) -> Column:
    """Estimate of model tokens: characters over a divisor, at least 1."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / F.lit(divisor)).cast("int"))


def for_embedding(text: Column) -> Column:
    return strip(rewrite(text, EMBEDDING_RULES))


def clean_chunk(text: Column) -> Column:
    return strip(rewrite(text, CHUNK_RULES))


def html_to_text(html: Column) -> Column:
    return strip(rewrite(html, HTML_RULES))


def normalise_block(text: Column) -> Column:
    """Drop control characters, join words broken at line ends, collapse blanks."""
    t = F.regexp_replace(text, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")
    # the Unicode classes are slow, and few blocks hold what the pattern needs
    t = F.when(F.contains(text, F.lit("-")) & F.contains(text, F.lit("\n")), F.regexp_replace(t, r"(?U)(\w)-\s*\n\s*(\w)", "$1$2")).otherwise(t)
    return strip(F.regexp_replace(t, r"[ \t]{2,}", " "))


def is_noise(text: Column, least: int = LEAST_BLOCK) -> Column:
    """Empty, short, a page number, or digits and punctuation only."""
    return is_noise_stripped(strip(text), least)


def is_noise_stripped(s: Column, least: int = LEAST_BLOCK) -> Column:
    """The same for a text without blanks around it."""
    return (s == "") | (F.length(s) < least) | s.rlike(PAGE_NUMBER) | s.rlike(NOISE)


def is_garbage(token: Column) -> Column:
    """A run of 16 characters or more without blanks, with 10 letters at least, of which less than 18 % are vowels."""
    s = strip(token)
    letters = F.length(F.regexp_replace(s, r"[^\p{L}]", ""))
    vowels = F.length(F.regexp_replace(s, r"[^aeiouAEIOU]", ""))
    return (F.length(s) >= 16) & ~s.contains(" ") & ~s.contains("\t") & (letters >= 10) & (vowels / letters < 0.18)


def is_scanned(text: Column, pages: Column) -> Column:
    """Fewer than 50 characters a page."""
    return F.length(text) / pages < 50


def column_slug(name: Column, place: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(strip(name)), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(s == "", F.concat(F.lit("col_"), place.cast("string"))).otherwise(s)


def table_slug(stem: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(stem), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(s == "", F.lit("t")).when(s.rlike("^[0-9]"), F.concat(F.lit("t_"), s)).otherwise(s)


@F.pandas_udf(StringType())
def id_slug(stem: pd.Series) -> pd.Series:
    """A stem as part of an id: accents go with their decomposition, other signs become "_"; "file" if nothing is left."""
    def one(text: str) -> str:
        plain = unicodedata.normalize("NFKD", text).encode("ascii", "ignore").decode("ascii")
        return re.sub(r"[^a-zA-Z0-9]+", "_", plain).strip("_").lower() or "file"

    return stem.map(one, na_action="ignore")


def json_reply(raw: Column, schema: str) -> Column:
    """A model's JSON reply, with or without a code fence and words around it, as a struct; null if it isn't one."""
    inner = F.regexp_extract(strip_think(raw), r"(?s)(\{.*\})", 1)
    return F.from_json(F.when(inner != "", inner), schema)


#: Words by which short texts of four languages are told apart, when no detector is plugged in.
LANGUAGE_WORDS = {"en": "the and of to is in that for with", "fr": "le la les et des est une dans pour", "es": "el los las y que una por con para", "de": "der die das und ist nicht ein mit von"}


def language_of(text: Column, chars: int = 300, least: int = 30) -> Column:
    """The language with the most of its words in the first `chars` characters; "" for short or unknown texts."""
    words = F.split(F.lower(F.substring(text, 1, chars)), r"[^\p{L}]+")

    def hit(known: str) -> Column:
        return F.size(F.filter(words, lambda w: w.isin(*known.split())))

    hits = [F.struct(hit(known).alias("n"), F.lit(-i).alias("i"), F.lit(name).alias("name")) for i, (name, known) in enumerate(LANGUAGE_WORDS.items())]
    best = F.array_max(F.array(*hits))
    return F.when((F.length(text) < least) | (best["n"] == 0), "").otherwise(best["name"])


def file_stem(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(name, r"^.*[/\\]", ""), r"(?<=.)\.[^.]*$", "")


def strip_think(raw: Column) -> Column:
    """Without reasoning blocks, closed or not."""
    return strip(F.regexp_replace(F.regexp_replace(raw, r"(?is)<think>.*?</think>", ""), r"(?is)<think>.*", ""))


def question_of(prompt: Column) -> Column:
    """The question inside an augmented prompt: blocks of facts, preferences and summary go, then what follows
    "Question:"; the prompt itself if nothing is left."""
    q = F.regexp_replace(prompt, r"(?is)\[USER FACTS\].*?\[(?:/|END )USER FACTS\]", "")
    q = F.regexp_replace(q, r"(?is)\[USER PREFERENCES\].*?\[(?:/|END )USER PREFERENCES\]", "")
    q = strip(F.regexp_replace(q, r"(?is)\[CONVERSATION SUMMARY\].*?\[END SUMMARY\]", ""))
    found = F.regexp_extract(q, r"(?is)(?:Question|Q)\s*:\s*(.+)", 1)
    q = F.when(strip(found) != "", strip(found)).otherwise(q)
    q = strip(F.regexp_replace(q, r"\s+", " "))
    return F.when(q == "", prompt).otherwise(q)


def no_answer(text: Column) -> Column:
    return text.rlike(NO_ANSWER)


def wants_person(text: Column) -> Column:
    return text.rlike(ESCALATE)


def self_contained(text: Column, least: int = 8) -> Column:
    """Enough words, none of which points back."""
    return (F.size(F.filter(F.split(text, r"\s+"), lambda w: w != "")) >= least) & ~text.rlike(REFERENCE)


def is_boilerplate(text: Column) -> Column:
    """Short, or nothing but pleasantries."""
    parts = F.filter(F.transform(F.split(text, r"[.!?\n]+"), strip), lambda s: s != "")
    return (token_count(text) <= BOILERPLATE_TOKENS) | F.forall(parts, lambda s: s.rlike(BOILERPLATE))


def entities(text: Column) -> Column:
    """Candidate entities in order of the patterns, distinct without case, without stopwords."""
    found = F.flatten(F.array(*[F.transform(F.regexp_extract_all(text, F.lit(p), F.lit(0)), strip) for p in ENTITIES]))
    stop = F.array(*map(F.lit, ENTITY_STOPWORDS))
    kept = F.filter(found, lambda e: (e != "") & ~F.array_contains(stop, F.lower(e)))
    return F.element_at(
        F.transform(F.array(kept), lambda a: F.filter(a, lambda e, i: F.array_position(F.transform(a, F.lower), F.lower(e)) == i + 1)), 1
    )


def citations(answer: Column) -> Column:
    """Array of (source, page) that an answer cites; the page may be null."""
    sources = F.regexp_extract_all(answer, F.lit(CITATION), F.lit(1))
    pages = F.regexp_extract_all(answer, F.lit(CITATION), F.lit(2))
    return F.transform(F.arrays_zip(sources.alias("s"), pages.alias("p")), lambda x: F.struct(F.lower(strip(x["s"])).alias("source"), F.try_to_number(x["p"], F.lit("999999")).cast("int").alias("page")))


def score_in(text: Column) -> Column:
    """The first number between 0 and 1 in a model's reply, 2 digits; null if there is none."""
    found = F.regexp_extract(text, r"(?<![\d.])(0(?:\.\d+)?|1(?:\.0+)?|\.\d+)(?![\d])", 1)
    return F.when(found != "", F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), found.cast("double"))), 2))


def clean_metadata(m: Column) -> Column:
    """Without null and empty values."""
    return F.map_filter(m, lambda k, v: v.isNotNull() & (v != "") & (v != "[]"))


def clean_table(markdown: Column) -> Column:
    """Table rows that are empty or only separators go."""
    def empty(line: Column) -> Column:
        s = strip(line)
        return s.startswith("|") & F.forall(F.split(F.regexp_replace(s, r"^\|+|\|+$", ""), r"\|"), lambda c: strip(c).rlike(r"^[-: ]*$"))
    return strip(F.array_join(F.filter(F.split(markdown, "\r?\n"), lambda x: ~empty(x)), "\n"))


def attachment_of(text: Column) -> Column:
    """The attachment that a block is tagged with; empty if none."""
    return F.regexp_extract(text, r"^\[attachment:([^\]]+)\]", 1)


def markdown_table(rows: Column) -> Column:
    """Rows of cells as a pipe table; short rows are padded."""
    width = F.array_max(F.transform(rows, F.size))
    padded = F.transform(rows, lambda r: F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))))
    line = lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
    return F.when(F.size(rows) > 0, F.array_join(F.concat(F.array(line(F.get(padded, 0)), rule), F.transform(F.slice(padded, 2, F.greatest(F.size(padded) - 1, F.lit(0))), line)), "\n")).otherwise(F.lit(""))


def is_real_table(rows: Column) -> Column:
    """At least two rows and two columns, a fifth of the cells filled."""
    cells = F.flatten(rows)
    return (F.size(rows) >= 2) & (F.array_max(F.transform(rows, F.size)) >= 2) & (F.size(F.filter(cells, lambda c: strip(c) != "")) / F.size(cells) >= 0.2)


def prose_rows(rows: Column) -> Column:
    """Header and rows of a table as lines "header: value, ..."; empty cells are left out."""
    head = F.get(rows, 0)
    body = F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0)))
    pair = lambda h, v: F.when(strip(F.coalesce(v, F.lit(""))) != "", F.concat(h, F.lit(": "), v))
    return F.array_join(F.transform(body, lambda r: F.array_join(F.zip_with(head, r, pair), ", ")), "\n")
