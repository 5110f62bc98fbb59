"""Queries that SQL can't say, against plain restatements of their rules."""

import difflib
import hashlib
import re
from collections import Counter, defaultdict

import pytest

from millrace.functions.stem import stem
from millrace.functions.text import BLANKS, ENTITIES, ENTITY_STOPWORDS, REFERENCE
from millrace.plans import catalogue
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def pairs(spark, docs):
    return {r.item_id: (docs[r.item_id * 7], r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect() if r.item_id * 7 in docs}


def run(spark, name):
    return catalogue.queries()[name](spark, SMALL).collect()


def half_up(x, digits=4):
    from decimal import ROUND_HALF_UP, Decimal

    return float(Decimal(repr(x)).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))


def balance(m, a, r):
    p, q = m / a if a else 0.0, m / r if r else 0.0
    return p, q, 2 * p * q / (p + q) if p + q else 0.0


def close(got, want):
    assert got.keys() == want.keys()
    assert all(abs(x - half_up(y)) < 1.5e-4 for k in got for x, y in zip(got[k], want[k], strict=True))


def test_rouge_l(spark, pairs):
    want = {}
    for i, (answer, reference) in pairs.items():
        a, b = (re.findall(r"\w+", x.lower()) for x in (answer, reference))
        row = [0] * (len(b) + 1)
        for x in a:
            before = 0
            for j, y in enumerate(b, 1):
                before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
        want[i] = balance(row[-1], len(a), len(b))
    close({r.item_id: (r.p, r.r, r.f) for r in run(spark, "rouge_l")}, want)


def test_rouge_over_stems(spark, pairs):
    want = {}
    for i, (answer, reference) in pairs.items():
        a, b = (Counter(stem(w) if len(w) > 3 else w for w in re.findall("[a-z0-9]+", x.lower())) for x in (answer, reference))
        want[i] = balance(sum((a & b).values()), sum(a.values()), sum(b.values()))
    close({r.item_id: (r.p, r.r, r.f) for r in run(spark, "rouge1_stemmed")}, want)


@pytest.mark.parametrize(
    ("word", "want"),
    [("caresses", "caress"), ("ponies", "poni"), ("ties", "tie"), ("cats", "cat"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("hopping", "hop"), ("falling", "fall"), ("filing", "file"), ("happy", "happi"), ("relational", "relat"), ("conditional", "condit"), ("running", "run"), ("generalization", "gener"), ("electricity", "electr"), ("adjustment", "adjust"), ("adoption", "adopt"), ("controlling", "control"), ("rate", "rate"), ("skies", "sky"), ("dying", "die"), ("representing", "repres"), ("expenses", "expens"), ("increase", "increas")],
)
def test_stems(word, want):
    assert stem(word) == want


def strip(text):
    return text.strip(BLANKS)


def lines(docs):
    """Lines of each document as blocks; forty make a page."""
    for i, text in docs.items():
        yield i, [x for x in map(strip, text.split("\n")) if x]


def test_near_duplicate_blocks(spark, docs):
    want = set()
    for i, blocks in lines(docs):
        kept = []
        for k, text in enumerate(blocks):
            key = text.lower().strip()[:500]
            if not any(difflib.SequenceMatcher(None, key, x).ratio() >= 0.92 for x in kept[-6:]):
                kept.append(key)
                want.add((i, k))
    assert {(r.doc_id, r.ord) for r in run(spark, "near_duplicate_blocks")} == want


def test_few_pairs_of_blocks_are_aligned(docs):
    from millrace.operators.cleaning import new_blocks

    pairs = aligned = 0
    for _, blocks in lines(docs):
        keys = [b.lower().strip()[:500] for b in blocks] + ["", "", "abc" * 90, "abd" * 90]
        for shrinking in (False, True):
            kept, mask = [], []
            for i, key in enumerate(keys):
                recent = kept[max(0, i - 6) :] if shrinking else kept[-6:]
                mask.append(not any(difflib.SequenceMatcher(None, key, x).ratio() >= 0.92 for x in recent))
                pairs += len(recent)
                if mask[-1]:
                    kept.append(key)
            got, n = new_blocks(keys, shrinking=shrinking)
            assert got == mask
            aligned += n
    assert aligned < 0.25 * pairs


def is_noise(s):
    return len(s) < 15 or re.fullmatch(r"\s*\d{1,4}\s*", s) or re.fullmatch(r"""[\d\s.,;:!?\-—–()\[\]{}/\\|'"«»…†§%°#@&*+=~^`]+""", s)


def test_clean_pipeline(spark, docs):
    tidy = lambda t: strip(re.sub(r"[ \t]{2,}", " ", re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "", t)))
    want = set()
    for i, blocks in lines(docs):
        rows = [(k, k // 40, tidy(t)) for k, t in enumerate(blocks)]
        rows = [r for r in rows if not is_noise(r[2])]
        seen = Counter(r[2].lower() for r in rows)
        rows = [r for r in rows if not (len(r[2]) < 80 and seen[r[2].lower()] >= 3)]
        first, once = set(), []
        for r in rows:
            if r[2].lower() not in first:
                first.add(r[2].lower())
                once.append(r)
        out = []
        for k, page, t in once:
            if out and out[-1][3] == page and re.search(r"-\s*$", out[-1][2]):
                out[-1][2] = re.sub(r"-\s*$", "", out[-1][2]) + t
            elif out and out[-1][3] == page and re.search(r"[a-zA-ZÀ-ÿ0-9]$", out[-1][2]) and re.match(r"[a-zàâéèêëîïôùûüÿœæç]", t):
                out[-1][2] += " " + t
            else:
                out.append([k, page, t, page])
                continue
            out[-1][3] = page
        want |= {(i, k, page, hashlib.md5(tidy(t).encode()).hexdigest()) for k, page, t, _ in out if not is_noise(tidy(t))}
    assert {tuple(r) for r in run(spark, "clean_pipeline")} == want


def test_html_tables(spark):
    for r, n in zip(*(sorted(x) for x in ([(p.page_id, p.html) for p in spark.read.parquet(f"{SMALL}/pages.parquet").collect()], [(p.page_id, p.n) for p in run(spark, "html_tables")])), strict=True):
        found = re.findall(r"(?is)<table.*?</table>", r[1])
        assert n == (r[0], sum(bool(re.search(r"(?i)<t[dh]", t)) for t in found))


def test_rewrite_tier(spark):
    turns = defaultdict(list)
    for r in spark.read.parquet(f"{SMALL}/conversations.parquet").collect():
        if r.role in ("user", "assistant"):
            turns[r.conv_id].append((r.turn, r.role, r.text))

    def entities(text):
        found = []
        for p in ENTITIES:
            for m in re.finditer(p, text, re.ASCII):
                e = strip(m[0])
                if e and e.lower() not in ENTITY_STOPWORDS and e.lower() not in [x.lower() for x in found]:
                    found.append(e)
        return found

    want = set()
    for c, rows in turns.items():
        rows.sort()
        for k, (turn, role, text) in enumerate(rows):
            if role != "user":
                continue
            before = [e for _, _, t in rows[max(0, k - 6) : k] for e in entities(t)]
            if not k or len(text.split()) >= 8 and not re.search(REFERENCE, text, re.ASCII):
                tier = "skip"
            else:
                tier = "entity" if any(len(e) >= 4 and e.lower() not in text.lower() for e in before) else "llm"
            want.add((c, turn, tier))
    assert {tuple(r) for r in run(spark, "rewrite_tier")} == want


@pytest.mark.parametrize("name", ["contextual", "hierarchical"])
def test_chunks_lose_no_words(docs, name):
    """Chunks of a document hold all of its paragraphs' words in order, within the budget; their boundaries, sections and
    paths are compared with recursive SQL (queries contextual_chunks and hierarchical_chunks)."""
    from millrace.operators import chunking

    for text in docs.values():
        made = getattr(chunking, name)([(0, text)])
        paragraphs = [p.strip() for p in re.split(r"\n{2,}", text) if p.strip()]
        heads = [p for p in paragraphs if chunking.level_of(p)]
        body = [w for _, head, c in made for w in (re.sub(r"^\[[^\]]*\] ", "", c, count=1) if head or c.startswith("[") and heads else c).split()]
        assert body == [w for p in paragraphs if p not in heads for w in p.split()]
        assert all(chunking.tokens_of(c) <= 2 * chunking.MOST or len(chunking.sentences(c)) <= 2 for _, _, c in made)
