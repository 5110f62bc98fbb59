"""Rules, classifier, personal data, vectors, and the pipeline."""

import hashlib
import math
import random
import re
from collections import Counter
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from millrace.llm import classifier, pii, quality_rules, vector_search
from tests.llm.conftest import SCHEMA
from tests.llm.test_text_operators import WORD, key

DATA = "/root/testdata/sf0.01"


def stats(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    marked = set()
    for i in range(len(w) - 2):
        if windows[tuple(w[i : i + 3])] > 1:
            marked |= {i, i + 1, i + 2}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(marked)


def test_statistics(docs, corpus, clashing):
    want = key((i, *stats(t)) for i, t, *_ in corpus)
    for d in (docs, clashing):
        assert key((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality_rules.statistics(d).collect()) == want


def test_rules_on_labelled_documents(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    got = quality_rules.apply(docs, labels).join(labels, "doc_id").where("not base_failed").collect()
    assert sum(r.kept == (r.quality == 1) for r in got) >= 0.95 * len(got)
    assert sum(r.kept for r in got if r.quality == 1) >= 0.98 * sum(r.quality for r in got)


def test_thresholds_are_quantiles_for_any_partitioning(spark):
    """Brute force over the sorted values: the largest value of the cell in which each share is reached."""
    r = random.Random(5)
    rows = [(float(r.randint(0, 3000)), 0.0 if i % 3 else r.random() / 50) for i in range(4000)]
    cell = lambda x: math.floor(math.log(x) * 128) if x else None
    want = {}
    for name, values in zip(("a", "b"), zip(*rows, strict=True), strict=True):
        inside, top = sorted(values), {}
        for x in inside:
            top[cell(x)] = x
        want[name] = sorted({top[cell(inside[-(-len(inside) * i // 24) - 1])] for i in range(1, 24)})
    for parts in (1, 3, 17):
        table = spark.createDataFrame(rows, "a double, b double").repartition(parts)
        assert quality_rules._thresholds(table, ["a", "b"], 24) == want
    assert quality_rules._thresholds(table.limit(0), ["a", "b"], 24) == {"a": [], "b": []}


def test_verdicts_do_not_depend_on_the_partitioning(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    one, many = (sorted(quality_rules.apply(docs.repartition(n, "source" if n > 1 else "doc_id"), labels).collect()) for n in (1, 13))
    assert one == many


def test_rules_without_labels(docs, corpus, nothing, spark):
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    rows = quality_rules.apply(docs, none).collect()
    assert len(rows) == len(corpus)
    for r in rows:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and r.kept == (not r.base_failed)
    assert quality_rules.apply(nothing, none).count() == 0
    odd = spark.createDataFrame([(None, 1), (3, None), (3, 0), (3, 1), (4, 1)], "doc_id bigint, quality int")
    assert quality_rules.apply(docs, odd).count() == len(corpus)


def test_a_rule_as_text_and_column(spark):
    rule = quality_rules.Rule([("symbols_per_word", ">", 0.5), ("words", "<=", 100.0)])
    row = spark.createDataFrame([(10, 9, 30, 0, 1, 0, 0, 0, 0)], "n_words int, n_symbols int, word_chars int, n_dup_lines int, n_lines int, n_repeat_words int, n_distinct int, n_bangs int, n_capitals int")
    assert str(rule) == "symbols_per_word > 0.5 and words <= 100" and row.select(rule.condition().alias("x")).first().x


def test_classifier(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    got = classifier.score(docs, classifier.train(docs, labels)).join(labels, "doc_id").collect()
    held = [r for r in got if crc32(str(r.doc_id).encode()) % 5 == 0]
    assert len(held) > 30 and sum((r.score >= 0.3) == (r.quality == 1) for r in held) >= 0.93 * len(held)


def test_classifier_edges(docs, corpus, nothing, clashing, spark):
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    w = classifier.train(docs, none)
    rows = classifier.score(clashing, w, carry=["node", "lang"]).collect()
    assert len(rows) == len(corpus) and all(r.score == 0.5 for r in rows)
    assert classifier.score(nothing, w).count() == 0
    one = classifier.train(docs, spark.createDataFrame([(i, 1) for i in range(20)] + [(None, 0)], "doc_id bigint, quality int"))
    assert all(0 <= r.score <= 1 for r in classifier.score(docs, one).collect())


def plain_score(text, weights):
    """The dot product of all n-grams of a text with the weights, one by one."""
    import numpy as np
    import xxhash

    words = [w for w in WORD.findall(text or "")]
    mask, shift = (1 << 64) - 1, 64 - classifier.BITS
    bucket = lambda h: (h * 0x9E3779B97F4A7C15 & mask) >> shift
    low = [xxhash.xxh3_64_intdigest(w.lower()) for w in words]
    outline = [xxhash.xxh3_64_intdigest(classifier._shape(w), 1) for w in words]
    total = 0.0
    for i in range(len(words)):
        after = lambda h: h[i + 1] if i + 1 < len(words) else 0  # noqa: B023, E731
        twice = low[i] == after(low)
        grams = [bucket(low[i]), bucket((3 * low[i] + 7 * after(low)) & mask), bucket(outline[i]), bucket(11 if twice else (3 * outline[i] + 7 * after(outline)) & mask)]
        total += sum(float(weights[g]) for g in grams)
    return 1 / (1 + math.exp(-(total * 4 / math.sqrt(max(4 * len(words), 1)) + float(np.float64(weights[-1])))))


def test_scores_are_dot_products(docs, corpus, spark):
    """Against brute force, and the same in any company of other rows."""
    weights = classifier.train(docs, spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id bigint, quality int"))
    assert weights.any()
    got = key((r.doc_id, round(r.score, 9)) for r in classifier.score(docs, weights).collect())
    assert got == key((i, round(plain_score(t, weights), 9)) for i, t, *_ in corpus)
    alone = {r.doc_id: r.score for r in classifier.score(docs.where("doc_id = 7"), weights).collect()}
    assert alone[7] in {r.score for r in classifier.score(docs, weights).collect() if r.doc_id == 7}


def test_updates_follow_the_regularised_leader(spark):
    """One feature set by hand: the weights of one pass over two rows, computed step by step."""
    alpha, beta, l1, l2 = 0.5, 1.0, 0.01, 0.1
    rows = [(1, "up up up", 1), (2, "down", 0)]
    got = classifier.fit(spark.createDataFrame(rows, "order_key bigint, text string, label int"), epochs=1, alpha=alpha, beta=beta, l1=l1, l2=l2)
    z, n = Counter(), Counter()

    def weight(i):
        return 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)

    import numpy as np
    import pyarrow as pa

    for _, text, y in rows:
        flat, at = classifier.features(pa.array([text]))
        x = {int(i): float(np.float32(c * 4 / math.sqrt(len(flat)))) for i, c in Counter(flat.tolist()).items()} | {1 << classifier.BITS: 1.0}
        p = 1 / (1 + math.exp(-sum(weight(i) * v for i, v in x.items())))
        for i, v in x.items():
            g, w = (p - y) * v, weight(i)
            z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha * w
            n[i] += g * g
    assert all(abs(float(got[i]) - weight(i)) < 1e-6 for i in z) and np.count_nonzero(got) <= len(z)


def test_accepted_keeps_columns(clashing, docs, spark):
    weights = classifier.train(docs, spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id bigint, quality int"))
    kept = classifier.accepted(clashing, weights, 0.5)
    assert kept.columns == clashing.columns
    want = key((r.doc_id, r.score) for r in classifier.score(docs, weights).collect() if r.score >= 0.5)
    assert key((r.doc_id,) for r in kept.select("doc_id").collect()) == key((i,) for i, _ in want)


def test_pipeline_with_clashing_columns_and_without_rows(spark, clashing, nothing, tmp_path):
    import corpus_pipeline

    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(20)], "doc_id bigint, quality int, toxic int")
    for name, docs in (("clash", clashing), ("none", nothing)):
        labels.write.parquet(str(tmp_path / name / "labels.parquet"))
        docs.write.parquet(str(tmp_path / name / "documents.parquet"))
        docs = spark.read.parquet(str(tmp_path / name / "documents.parquet"))
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, str(tmp_path / name))
            assert k == 4 or out.columns == docs.columns
            out.write.parquet(str(tmp_path / name / f"out{k}"))
            docs = spark.read.parquet(str(tmp_path / name / f"out{k}")) if k < 4 else out
            if k < 4 and name == "clash":
                assert {r.node for r in docs.select("node").collect()} == {"x"}
        assert (docs.count() == 0) == (name == "none")


def test_held_out(spark):
    ids = spark.range(200).withColumnRenamed("id", "doc_id").union(spark.createDataFrame([(None,)], "doc_id bigint"))
    for r in ids.select("doc_id", classifier.held_out().alias("h")).collect():
        assert r.h == (r.doc_id is None or crc32(str(r.doc_id).encode()) % 5 == 0)


EMAIL, IP, CARD, PHONE = (re.compile(p) for p in (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"))


def luhn(d):
    t = [int(c) for c in d[::-1]]
    return (sum(t[::2]) + sum(sum(divmod(2 * x, 10)) for x in t[1::2])) % 10 == 0


def base(text):
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        d = re.sub("[^0-9]", "", m[0])
        if 12 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


def test_base_patterns():
    r = random.Random(2)
    for _ in range(20_000):
        text = "".join(r.choice("0129 .-+@@a%é()") for _ in range(r.randint(0, 40)))
        assert pii.base_spans(text) == base(text)
    for hard in ("a" * 200_000, "1" * 200_000, "1." * 100_000, "+" * 50_000, "@" * 200_000, "a@" * 100_000):
        pii.base_spans(hard)


def test_personal_data(docs, corpus, clashing, nothing):
    w = pii.train(docs)
    for d in (docs, clashing):
        rows = pii.detect(d, w).collect()
        want = key((i, hashlib.sha256(",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in base(t or "")).encode()).hexdigest()) for i, t, *_ in corpus)
        assert key((r.doc_id, r.base_sha256) for r in rows) == want
    for r in rows:
        text = next(t for i, t, *_ in corpus if i == r.doc_id) if r.doc_id is not None else ""
        spans = [x.split(":") for x in r.spans.split(",") if x]
        if r.doc_id is not None and r.doc_id != 5:
            assert {(int(s), pii.KINDS.index(k), int(e)) for k, s, e in spans} >= set(base(text or ""))
    assert pii.train(nothing) == {} and pii.detect(nothing, {}).count() == 0
    out = pii.redact(clashing, w)
    assert out.columns == clashing.columns and not any("@" in (r.text or "") for r in out.collect())


def test_candidates_stay_clear_of_the_base():
    """Against a plain test of every pair of spans, on texts with many of both."""
    r = random.Random(12)
    for _ in range(3000):
        text = "".join(r.choice(["10.1.2.3 ", "a@b.c", "+1 555 010 9999", "4111 1111 1111 1111", "x", " ", "3f9a" * 5, "(12) 345 6789", "=", "9"]) for _ in range(r.randint(0, 14)))
        base_found = pii.base_spans(text)
        found = [s for s, _, _ in pii.candidates(text, base_found)]
        for a, _, b in found:
            assert not any(a < z and y < b for y, _, z in base_found)
        plain = []
        for kind, pattern in ((4, pii._SECRET), (5, pii._NUMBER)):
            for m in pattern.finditer(text):
                digits = sum(c.isdigit() for c in m[0])
                if kind == 4 and (digits < 4 or digits + m[0].count("-") == len(m[0])):
                    continue
                if not any(m.start() < z and y < m.end() for y, _, z in [*base_found, *(p for p in plain if p[1] == 4)]):
                    plain.append((m.start(), kind, m.end()))
        assert found == plain


def test_secrets_are_found(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    found = [r for r in pii.detect(docs, pii.train(docs)).collect() if "secret:" in r.spans]
    texts = {r.doc_id: r.text for r in docs.collect()}
    have = {i for i, t in texts.items() if re.search(r'(?i)token = "[0-9a-f]{40}"', t)}
    assert {r.doc_id for r in found} == have


def test_reliabilities():
    """Two labelers that agree outweigh one that disagrees with both."""
    belief = pii.estimate([((1, 1, 0), 50), ((0, 0, 1), 50), ((1, 1, 1), 50), ((0, 0, 0), 50)])
    assert belief[0] > 0.5 > belief[1] and belief[2] > 0.9 > 0.1 > belief[3]


def test_exact_search(spark, monkeypatch):
    r = random.Random(4)
    rows = [(i, [r.gauss(0, 0.3) for _ in range(8)]) for i in range(600)] + [(600 + i, [0.5] * 8) for i in range(20)]
    bad = [(900, None), (901, [1.0] * 7 + [None]), (902, [1.0] * 7 + [math.nan]), (1000, [1.0] * 7 + [math.inf]), (903, []), (904, [1.0, 2.0]), (1100, [0.1] * 8), (1100, [0.1] * 8)]
    df = spark.createDataFrame(rows + bad, "vec_id bigint, embedding array<double>").withColumn("score", F.lit(1)).repartition(6)
    got = vector_search.top_k(vector_search.build(df, block=100), df.where("vec_id % 100 = 0"), block=4).collect()
    usable = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows + [(1100, [0.1] * 8)] * 2]
    want = []
    for q, v in {i: v for i, v in usable if i % 100 == 0}.items():
        best = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in usable if i != q)[:10]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert key((x.query_id, x.rank, x.vec_id, x.score) for x in got) == key(want)
    none = df.limit(0)
    assert vector_search.top_k(vector_search.build(none), none).count() == 0
    index = vector_search.build(df, block=7)
    for name, value in (("BATCH_BYTES", 150), ("FIRST_LOOK", 4)):  # several batches, and a first look
        monkeypatch.setattr(vector_search, name, value)
    found = vector_search.top_k(index, df.where("vec_id % 100 = 0"), block=2)
    assert key((x.query_id, x.rank, x.vec_id, x.score) for x in found.collect()) == key(want)
    plan = found._jdf.queryExecution().toString()
    assert "Join" not in plan


def test_search_with_extreme_components(spark):
    """Scores and components beyond 64 bits are held at its ends; ties and all-equal vectors go by id."""
    rows = [(0, [1e30, 1.0]), (1, [1e30, 2.0]), (2, [-1e30, 0.0]), (3, [0.0, 0.0]), (100, [3.0, -1.0]), (101, [1e9, 0.5])] + [(i, [0.25, 0.25]) for i in range(102, 130)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(3)
    got = key((x.query_id, x.rank, x.vec_id, x.score) for x in vector_search.top_k(vector_search.build(df, block=5), df.where("vec_id % 100 = 0"), k=4).collect())
    clip = lambda x: max(-(1 << 63), min((1 << 63) - 1, x))
    whole = {i: [clip(math.floor(1024 * x)) for x in v] for i, v in rows}
    want = []
    for q in (0, 100):
        best = sorted((-clip(sum(a * b for a, b in zip(whole[q], v, strict=True))), i) for i, v in whole.items() if i != q)[:4]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert got == key(want)


@pytest.mark.parametrize("kind", ["documents", "edges"])
def test_pipeline(spark, kind, corpus, tmp_path):
    """Each stage against a brute-force version on its own input."""
    import corpus_pipeline
    from tests.llm.test_text_operators import covered, groups, shingles

    if kind == "documents":
        docs = spark.read.parquet(f"{DATA}/documents.parquet").where("length(text) < 3000").limit(150)
        labels = spark.read.parquet(f"{DATA}/labels.parquet")
    else:
        docs, labels = spark.createDataFrame(corpus, SCHEMA), spark.createDataFrame([(0, 1, 0)], "doc_id bigint, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    names = docs.columns
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [tuple(r) for r in docs.collect()]
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / f"out{k}"))
        docs = spark.read.parquet(str(tmp_path / f"out{k}"))
        after = docs.collect()
        if k < 4:
            assert docs.columns == names
        if name == "quality classifier":
            assert not Counter(tuple(r) for r in after) - Counter(before)
            if kind == "documents":
                good = {r.doc_id for r in labels.where("quality = 1").collect()} & {b[0] for b in before}
                assert len(good & {r.doc_id for r in after}) >= 0.98 * len(good)
        elif name == "n-gram Jaccard join":
            sets, root, _ = groups(before)
            assert Counter(root(sets.index(shingles(r.text))) for r in after if shingles(r.text)) == Counter({root(i): 1 for i, s in enumerate(sets) if s})
        elif name == "substring dedup":
            assert key((r.doc_id, WORD.findall(r.text or "")) for r in after) == key((i, [x for x, y in zip(w, g, strict=True) if not y]) for i, w, g in covered(before, 35))
        elif name == "PII":
            assert len(after) == len(before) and not any(base(r.text or "") for r in after)
        else:
            assert {r.doc_id for r in after} == {b[0] for b in before}
