"""Personal data by weak supervision (operator 9).

Four kinds have fixed patterns (the base). Around them, looser candidates - secrets, numbers, dates,
identity numbers, street addresses, names after a title or a label - are put to the vote of labelers:
pattern, word list (given words and words that the corpus has before base spans), context, shape, spread.
Expectation-maximisation estimates the labelers' reliabilities from how they agree over all documents; a
logistic span classifier trained on those estimates decides which candidates join the base's spans.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.arrowio import frugal, reachable, slices, texts

KINDS = ("email", "ip", "card", "phone", "secret", "number", "date", "id", "address", "name")

_LOCAL_SIGNS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_SECRET = re.compile(r"(?<![A-Za-z0-9_/+=-])[A-Za-z0-9_/+=-]{16,}+")
_NUMBER = re.compile(r"(?<![0-9])\(?[0-9](?:[ ().-]{0,2}[0-9]){6,}+")
_LETTERS = r"A-Za-zÀ-ÖØ-öø-ÿ"
_MONTH = "January|February|March|April|May|June|July|August|September|October|November|December|Januar|Februar|März|Mai|Juni|Juli|Oktober|Dezember|janvier|février|mars|avril|juin|juillet|août|septembre|octobre|novembre|décembre|enero|febrero|marzo|abril|mayo|junio|julio|agosto|septiembre|octubre|noviembre|diciembre"
_DATE = re.compile(rf"(?<![\w./-])(?:[0-9]{{4}}-[0-9]{{1,2}}-[0-9]{{1,2}}|[0-9]{{1,2}}([./-])[0-9]{{1,2}}\1[0-9]{{4}}|[0-9]{{1,2}}\.? (?:de )?(?:{_MONTH}) (?:de )?[0-9]{{4}}|(?:{_MONTH}) [0-9]{{1,2}}, [0-9]{{4}})(?![\w/-]|\.[0-9])")
_ID = re.compile(r"(?<![\w-])(?:[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?|[A-Z]{1,4}-?[0-9]{5,12}[A-Z]?)(?![\w-])")
_ADDRESS = re.compile(
    rf"(?<![\w-])(?:[0-9]{{1,5}}[a-zA-Z]?,? (?:[A-Z][{_LETTERS}]{{1,20}} ){{1,3}}(?:Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Boulevard|Blvd|Court|Square|Terrace)"
    rf"|[A-ZÄÖÜ][a-zäöüß]{{1,30}}(?:straße|strasse|weg|platz|gasse|allee) [0-9]{{1,4}}[a-z]?"
    rf"|[0-9]{{1,4}},? (?:rue|avenue|boulevard|place|chemin) (?:de la |de |du |des )?[A-ZÀ-Ý][{_LETTERS}-]{{1,30}}"
    rf"|(?:Calle|Avenida|Plaza|Paseo) (?:de la |de |del )?[A-ZÀ-Ý][{_LETTERS}]{{1,30}}(?: [A-ZÀ-Ý][{_LETTERS}]{{1,30}})?,? [0-9]{{1,4}})(?!\w)"
)
_TITLES = "Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Señor|Señora|Sr|Sra|Monsieur|Madame|Mme"
_LABELS = "[Nn]ame is|[Nn]ame|[Pp]atient|[Ss]igned by|[Ee]mployee|[Nn]ombre|[Hh]eiße|m'appelle|[Ll]lamo"
_NAME = re.compile(rf"(?<!\w)(?:({_TITLES})\.?|(?:{_LABELS}):?) ((?:[A-ZÀ-Ý][a-zà-ÿ'’-]{{1,20}} ){{1,2}}[A-ZÀ-Ý][a-zà-ÿ'’-]{{1,20}})")
#: What a text must hold to be looked at.
_GATE = rf"[0-9@]|{_TITLES}|{_LABELS}"
_WORDS = re.compile(r"[^\W\d_]+")
_BIRTH = re.compile(r"(?i)\b(?:born|birth|birthday|dob|geboren|geburtsdatum|geburtstag|née?|naissance|nacid[oa]|nacimiento)\b")

#: Word lists of the gazetteer labeler.
_PRIVATE_WORDS = frozenset("token secret password passwd pwd key apikey bearer pin ssn passport tel phone mobile fax call account iban card licence license insurance taxpayer konto reisepass pasaporte passeport compte cuenta lives residence".split())
_PUBLIC_WORDS = frozenset("version page figure section chapter isbn issn doi edition volume year order part model serial ticket".split())
#: A learnt word precedes a base span at least LEAST times and at least SHARE of the times it occurs; the best MOST are kept.
LEAST, SHARE, MOST = 20, 0.25, 4096
#: Share of personal ones among candidates on which all labelers are silent.
SILENT = 0.2
#: Votes that each labeler is held to have given before the first is seen: right ones and wrong ones.
PRIOR = np.array([19.0, 1.0])
#: How far weights are drawn to nothing: of kinds and votes, and of a span's looks, which its examples shouldn't be learnt by.
PULL, PULL_LOOKS = 1e-4, 1e-2

LABELERS = ("pattern", "gazetteer", "context", "shape", "spread")


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = ord(c) - 48
        if i % 2:
            x = 2 * x - 9 * (x > 4)
        total += x
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Each sign @ has one possible start, the first of the run of local characters before it, and one end."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_SIGNS:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end) of the four fixed patterns, sorted."""
    found = [(s, 0, e) for s, e in _emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.groups()):
            found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and _luhn(digits):
                found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


def _cue(lead: str, learnt: frozenset[str]) -> int:
    """1 or 0 by the nearest of the last four words that a list knows, -1 if none is known."""
    for w in reversed(_WORDS.findall(lead)[-4:]):
        w = w.lower()
        if w in _PUBLIC_WORDS:
            return 0
        if w in _PRIVATE_WORDS or w in learnt:
            return 1
    return -1


def _checked(got: str) -> bool:
    """The remainder that account numbers with a country code have."""
    s = got.replace(" ", "")
    return 15 <= len(s) <= 34 and s[:2].isalpha() and s[2:4].isdigit() and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _votes(kind: int, got: str, lead: str, after: str, title: bool, known: int) -> tuple[tuple[int, ...], tuple]:
    size = len(got)
    digits = sum("0" <= c <= "9" for c in got)
    hexed = all(c in "0123456789abcdefABCDEF" for c in got)
    quoted = lead[-1:] in ("'", '"') and after in ("'", '"')
    given = bool(re.search(r"[=:]\s*['\"]?\Z", lead))
    spread = -sum(c / size * math.log2(c / size) for c in Counter(got).values())
    grouped = bool(re.fullmatch(r"\(?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-][0-9]{3,4}|[0-9]{3}-[0-9]{2}-[0-9]{4}", got))
    inside = 0 if lead[-1:] and lead[-1:] in "/." else -1
    context = 1 if given and (quoted or known == 1) else inside
    if kind == 4:
        votes = (1 if hexed and size >= 24 and digits < size else -1, known, context, 1 if digits * 5 >= size and digits < size else 0 if known < 1 else -1, 1 if spread >= 3.2 else 0 if spread < 2.2 else -1)
    elif kind == 5:
        votes = (1 if grouped else 0 if digits == size > 12 else -1, known, context, 0 if digits > 15 else -1, 1 if spread >= 3.2 else 0 if spread < 1.5 else -1)
    elif kind == 6:
        birth = bool(_BIRTH.search(lead))
        votes = (-1, 1 if birth else 0, 1 if birth else inside, -1, -1)
    elif kind == 7:
        form = _checked(got) or bool(re.fullmatch(r"[A-Z]{2}[0-9]{6}[A-Z]", got))
        votes = (1 if form else -1, known, context, 1 if form else -1, 0 if spread < 1.5 else -1)
    elif kind == 8:
        votes = (1, known, context, 1, -1)
    else:
        words = got.split()
        odd = len({w.lower() for w in words}) < len(words)
        votes = (1 if title else -1, 1 if given or not title else -1, -1, 0 if odd or any(len(w) < 3 for w in words) else 1, -1)
    return votes, (kind, min(size // 8, 8), int(5 * digits / size), known, int(quoted), int(given), int(hexed), int(grouped), int(spread), *votes)


def candidates(text: str, base: list[tuple[int, int, int]], learnt: frozenset[str] = frozenset()) -> Iterator[tuple[tuple[int, int, int], tuple[int, ...], tuple]]:
    """Looser spans that touch no base span: the span, each labeler's vote (1 personal, 0 not, -1 none), features.
    Kinds are looked for in a fixed order; a span that touches an earlier kind's isn't one, whatever became of that."""
    taken = sorted((s, e) for s, _, e in base)
    if any(x[1] > y[0] for x, y in zip(taken, taken[1:])):  # base kinds may overlap: join them, so that ends are in order too
        joined: list[tuple[int, int]] = []
        for s, e in taken:
            if joined and s < joined[-1][1]:
                joined[-1] = (joined[-1][0], max(e, joined[-1][1]))
            else:
                joined.append((s, e))
        taken = joined
    for kind, pattern in ((6, _DATE), (7, _ID), (8, _ADDRESS), (4, _SECRET), (5, _NUMBER), (9, _NAME)):
        for m in pattern.finditer(text):
            s, e = m.span(2) if kind == 9 else m.span()
            got = text[s:e]
            lead = text[max(0, s - 40) : s]
            known = _cue(lead, learnt)
            if kind == 4:
                digits = sum("0" <= c <= "9" for c in got)
                if digits < (1 if known == 1 else 4) or digits + got.count("-") == len(got):
                    continue
            at = bisect_left(taken, (e,))  # spans from here on begin at e or later
            if at and taken[at - 1][1] > s:
                continue
            if kind != 5:
                taken.insert(at, (s, e))
            yield (s, kind, e), *_votes(kind, got, lead, text[e : e + 1], kind == 9 and bool(m[1]), known)


def _agreement(patterns: np.ndarray, count: np.ndarray, rounds: int) -> np.ndarray:
    """Each labeler's log share of votes against and for, by truth: (truth, labeler, vote). A silent labeler says
    nothing of the truth, so that kinds which few labelers know aren't held to be like those that many know."""
    belief = np.clip((np.array([0, -1, 1])[patterns].sum(1) + 1.5) / 3, 0.05, 0.95)
    said = np.zeros((2, patterns.shape[1], 3))
    for _ in range(rounds):
        for k, mass in ((0, count * (1 - belief)), (1, count * belief)):
            for v in range(patterns.shape[1]):
                share = np.bincount(patterns[:, v], mass, 3)[1:] + PRIOR[:: 1 if k == 0 else -1]
                said[k, v, 1:] = np.log(share / share.sum())
        belief = _believed(patterns, said)
    return said


def _believed(patterns: np.ndarray, said: np.ndarray) -> np.ndarray:
    each = np.arange(patterns.shape[1])
    log = math.log(SILENT / (1 - SILENT)) + (said[1][each, patterns] - said[0][each, patterns]).sum(1)
    return 1 / (1 + np.exp(-np.clip(log, -50, 50)))


def estimate(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 50) -> np.ndarray:
    """Expectation-maximisation over vote patterns and their counts: each pattern's probability of being personal."""
    votes, count = np.array([p for p, _ in patterns]) + 1, np.array([c for _, c in patterns], float)
    return _believed(votes, _agreement(votes, count, rounds))


def _names(features: tuple) -> list[str]:
    return ["bias", *(f"{i}={v}" for i, v in enumerate(features)), f"0,3={features[0]},{features[3]}", f"0,6={features[0]},{features[6]}"]


def _unseen() -> Iterator[tuple[tuple[int, ...], list[str]]]:
    """Every vote pattern of each kind, without other features: what labelers say where the corpus has no example."""
    for kind in range(4, len(KINDS)):
        for votes in product((-1, 0, 1), repeat=len(LABELERS)):
            yield votes, ["bias", f"0={kind}", *(f"{9 + i}={v}" for i, v in enumerate(votes))]


def fit(table: list[tuple[tuple[int, ...], tuple, int]], rounds: int = 40) -> dict[str, float]:
    """The span classifier's weights from (votes, features, count): logistic regression by Newton's steps on the estimates of the
    patterns seen and, with as much weight in all, of every pattern that labelers can vote."""
    if not table:
        return {}
    by_votes: Counter = Counter()
    for votes, _, n in table:
        by_votes[tuple(votes)] += n
    patterns = sorted(by_votes.items())
    said = _agreement(np.array([p for p, _ in patterns]) + 1, np.array([c for _, c in patterns], float), 50)
    unseen = list(_unseen())
    rows = [_names(f) for _, f, _ in table] + [n for _, n in unseen]
    place = {n: i for i, n in enumerate(sorted({n for r in rows for n in r}))}
    x = np.zeros((len(rows), len(place)))
    for i, r in enumerate(rows):
        x[i, [place[n] for n in r]] = 1
    y = _believed(np.array([*(v for v, _, _ in table), *(v for v, _ in unseen)]) + 1, said)
    c = np.sqrt(np.array([n for _, _, n in table], float))  # a pattern's say grows with the root of its count, so a few very common ones don't decide alone
    c = np.concatenate([c / c.sum(), np.full(len(unseen), 1 / len(unseen))]) / 2
    w = np.zeros(len(place))
    pull = np.array([PULL_LOOKS if n[0] in "12345678" and n[1] == "=" or n[:3] == "0,6" else PULL for n in place])
    cost = lambda w: c @ (np.logaddexp(0, x @ w) - y * (x @ w)) + pull @ w**2 / 2
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        step = np.linalg.solve((x.T * (c * p * (1 - p))) @ x + np.diag(pull), x.T @ (c * (p - y)) + pull * w)
        size = next((z for z in (1.0, 0.5, 0.25, 0.125) if cost(w - z * step) < cost(w)), 0.0)
        w = w - size * step
        if size * np.abs(step).max() < 1e-9:
            break
    return {n: float(w[i]) for n, i in place.items()}


def _personal(weights: dict[str, float], features: tuple, threshold: float) -> bool:
    z = sum(weights.get(n, 0.0) for n in _names(features))
    return z > math.log(threshold / (1 - threshold))


def _learnt(weights: dict[str, float]) -> frozenset[str]:
    """The model's own private words, kept beside the weights."""
    return frozenset(n[5:] for n in weights if n.startswith("word:"))


def vocabulary(docs: DataFrame, text_col: str = "text", least: int = LEAST, share: float = SHARE, most: int = MOST) -> list[str]:
    """Words that precede base spans at least `least` times and at least `share` of the times that they occur in texts
    with base spans; the `most` that do so oftenest, ties to the first by name. Counted over all documents; only those come to the driver."""
    reachable(docs.sparkSession)
    names = ["word", "n", "before"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, 0):
                t = texts(b, 0)
                every, before = Counter(), Counter()
                for text in t.filter(pc.match_substring_regex(t, "[0-9@]")).to_pylist():
                    spans = base_spans(text)
                    if spans:
                        every.update(w.lower() for w in _WORDS.findall(text))
                        for s, _, _ in spans:
                            words = _WORDS.findall(text[max(0, s - 40) : s])
                            if words:
                                before[words[-1].lower()] += 1
                yield pa.RecordBatch.from_arrays([pa.array(list(every), pa.string()), pa.array(list(every.values()), pa.int64()), pa.array([before[w] for w in every], pa.int64())], names)

    n = docs.select(text_col).mapInArrow(frugal(run), "word string, n bigint, before bigint").groupBy("word").agg(F.sum("n").alias("n"), F.sum("before").alias("before"))
    got = n.where((F.col("before") >= least) & (F.col("before") >= share * F.col("n"))).orderBy(F.desc("before"), "word").limit(most)
    return [r.word for r in got.collect()]


def train(docs: DataFrame, text_col: str = "text") -> dict[str, float]:
    """Weights from the candidates of all documents, and "word:" entries for learnt private words. What is gathered is a
    histogram over the combinations of votes and coarse features, whose number doesn't depend on the corpus."""
    reachable(docs.sparkSession)
    learnt = frozenset(vocabulary(docs, text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for whole in batches:
            for b in slices(whole, 0):
                t = texts(b, 0)
                for text in t.filter(pc.match_substring_regex(t, _GATE)).to_pylist():
                    for _, votes, features in candidates(text, base_spans(text), learnt):
                        seen[json.dumps([votes, features])] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["pattern", "n"])

    got = docs.select(text_col).mapInArrow(frugal(run), "pattern string, n bigint").groupBy("pattern").agg(F.sum("n").alias("n")).collect()
    return fit(sorted((tuple(v), tuple(f), r.n) for r in got for v, f in [json.loads(r.pattern)])) | {f"word:{w}": 0.0 for w in learnt}


def find(text: str, weights: dict[str, float], threshold: float = 0.5, learnt: frozenset[str] | None = None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and all spans."""
    base = base_spans(text)
    more = [span for span, _, features in candidates(text, base, _learnt(weights) if learnt is None else learnt) if _personal(weights, features, threshold)]
    return base, sorted(base + more)


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def detect(docs: DataFrame, weights: dict[str, float], id_col: str = "doc_id", threshold: float = 0.5) -> DataFrame:
    """Spans of every whole text, in one pass: id_col, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    Places are code points, ends exclusive. Null text: empty, no spans. Rows keep their number.
    """
    reachable(docs.sparkSession)
    learnt = _learnt(weights)
    none = hashlib.sha256(b"").hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, 1):
                t, n = texts(b, 1), b.num_rows
                counts, digest, spans = np.zeros((4, n), np.int64), [none] * n, [""] * n
                for i in np.flatnonzero(pc.match_substring_regex(t, _GATE).to_numpy(zero_copy_only=False)).tolist():
                    base, all_spans = find(t[i].as_py(), weights, threshold, learnt)
                    if all_spans:
                        for _, k, _ in base:
                            counts[k, i] += 1
                        digest[i], spans[i] = hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(all_spans)
                yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, counts), pa.array(digest, pa.string()), pa.array(spans, pa.string())], [id_col, "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    return docs.select(id_col, "text").mapInArrow(frugal(run), f"`{id_col}` {dict(docs.dtypes)[id_col]}, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string")


def redact(docs: DataFrame, weights: dict[str, float], threshold: float = 0.5) -> DataFrame:
    """The same rows with each span replaced by its kind in brackets; overlapping spans go as one, by the first's kind.
    All other columns stay; null text stays null, an empty table stays empty."""
    reachable(docs.sparkSession)
    learnt = _learnt(weights)
    names = docs.columns
    at = names.index("text")

    def clean(text: str) -> str:
        _, spans = find(text, weights, threshold, learnt)
        out, done = [], 0
        for s, k, e in spans:
            if s >= done:
                out += [text[done:s], f"[{KINDS[k].upper()}]"]
            done = max(done, e)
        return "".join(out) + text[done:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, at):
                t = b.column(at)
                hit = pc.match_substring_regex(texts(b, at), _GATE).to_pylist()
                new = pa.array([clean(x) if h else x for x, h in zip(t.to_pylist(), hit, strict=True)], pa.string())
                yield pa.RecordBatch.from_arrays([new if i == at else b.column(i) for i in range(len(names))], names)

    return docs.mapInArrow(frugal(run), docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9_pii."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return detect(docs, train(docs))
