"""Cross-tokenizer alignment (operator 12).

A slice of an Arrow batch is encoded by both tokenizers and its documents' tokens laid end to end
by their byte lengths. One bincount of A ends and one of B ends mark the bytes where tokens end; where
both do, a group ends; where either does, a link (an A and a B token whose bytes overlap) ends. Prefix sums of
these marks, read at the documents' bounds, give each document's numbers.

Links of all documents are counted by pair of ids. A document's distinct pairs are written beside
its numbers, so that the texts are encoded once and the counts are looked up afterwards.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.arrowio import binary_array, flat_bytes, materialised, reachable, slices, spans_to_places, texts
from millrace.llm.tokens import ByteTable, encoder

#: Text bytes of a slice; a slice's working arrays take about 100 bytes for each.
SLICE = 2 << 20
#: Tokens that are written out as decimals at once; links that are counted at once.
TOKENS, LINKS = 1 << 18, 1 << 22
#: Pairs of ids whose counts one broadcast holds (17 bytes each); more pairs are brought in several rounds.
PAIRS = 1 << 22


@dataclass
class Slice:
    """Both tokenizers' tokens of some documents; `ok` says which of the slice's rows they are."""

    ok: np.ndarray
    a: np.ndarray
    a_at: np.ndarray
    a_ends: np.ndarray
    b: np.ndarray
    b_at: np.ndarray
    b_ends: np.ndarray


@dataclass
class Marks:
    """Of a slice: groups and links of each document; each token's group; each link's tokens; which tokens end a group."""

    n_groups: np.ndarray
    n_links: np.ndarray
    a_group: np.ndarray
    b_group: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray
    a_closes: np.ndarray
    b_closes: np.ndarray


def _without(ids: np.ndarray, at: np.ndarray, ok: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    size = np.diff(at)
    return ids[np.repeat(ok, size)], np.concatenate([[0], np.cumsum(size[ok])])


class Pair:
    """Two tokenizers: A byte-level, B a sentencepiece model."""

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = encoder(a_path, "byte", True), encoder(b_path, "piece")
        self.tables = ByteTable(self.a), ByteTable(self.b)
        self.sizes = tuple(len(t.length) for t in self.tables)

    def encode(self, text: pa.Array) -> Slice:
        """Tokens of the texts that aren't empty and whose bytes, joined by either tokenizer, are a space and the text."""
        spaced = pc.binary_join_element_wise("", text, " ")
        a, a_at = self.a.encode(spaced)
        b, b_at = self.b.encode(text)
        want, bounds = flat_bytes(spaced)
        size = np.diff(bounds)
        ok = size > 1
        for table, ids, at in zip(self.tables, (a, b), (a_at, b_at), strict=True):
            ok &= np.diff(np.concatenate([[0], np.cumsum(table.length[ids])])[at]) == size
        wrong = np.zeros(len(ok), bool)
        for table, ids, at in zip(self.tables, (a, b), (a_at, b_at), strict=True):
            kept, kept_at = _without(ids, at, ok)
            got, _ = table.decode(kept, kept_at)
            mine = want if ok.all() else want[np.repeat(ok, size)]
            if not np.array_equal(got, mine):
                ends = np.cumsum(size[ok])
                wrong[np.flatnonzero(ok)[np.unique(np.searchsorted(ends, np.flatnonzero(got != mine), side="right"))]] = True
        ok &= ~wrong
        if not ok.all():
            (a, a_at), (b, b_at) = _without(a, a_at, ok), _without(b, b_at, ok)
        return Slice(ok, a, a_at, np.cumsum(self.tables[0].length[a]), b, b_at, np.cumsum(self.tables[1].length[b]))


def marks_of(s: Slice) -> Marks:
    """Where groups and links end, for all documents of a slice at once."""
    total = int(s.a_ends[-1]) if len(s.a_ends) else 0
    ends_a, ends_b = (np.bincount(x, minlength=total + 1) > 0 for x in (s.a_ends, s.b_ends))
    both, either = ends_a & ends_b, ends_a | ends_b
    cuts, links, before_a, before_b = (np.cumsum(x, dtype=np.int64) for x in (both, either, ends_a, ends_b))
    bounds = np.concatenate([[0], s.a_ends])[s.a_at]
    last = np.flatnonzero(either)
    return Marks(np.diff(cuts[bounds]), np.diff(links[bounds]), cuts[s.a_ends - 1], cuts[s.b_ends - 1], before_a[last - 1], before_b[last - 1], both[s.a_ends], both[s.b_ends])


_DIGITS: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}


def _decimals(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers below n written out, each with a place for a separator: all bytes, where each begins, its length."""
    if n not in _DIGITS:
        rows = [f"{i} ".encode() for i in range(n)]
        length = np.fromiter(map(len, rows), np.int64, n)
        _DIGITS[n] = np.frombuffer(b"".join(rows), np.uint8), np.cumsum(length) - length, length
    return _DIGITS[n]


def digests(s: Slice, m: Marks, vocabulary: int) -> list[str]:
    """SHA-256 of each document's groups, `a1,a2|b1;a3|b2,b3` in decimal ids."""
    n = len(s.a_at) - 1
    groups = int(m.n_groups.sum())
    in_a, in_b = np.bincount(m.a_group, minlength=groups), np.bincount(m.b_group, minlength=groups)
    ids, sep = np.zeros(len(s.a) + len(s.b), np.int64), np.zeros(len(s.a) + len(s.b), np.uint8)
    slot_a = np.arange(len(s.a)) + (np.cumsum(in_b) - in_b)[m.a_group]
    slot_b = np.arange(len(s.b)) + np.cumsum(in_a)[m.b_group]
    ids[slot_a], ids[slot_b] = s.a, s.b
    sep[slot_a], sep[slot_b] = np.where(m.a_closes, ord("|"), ord(",")), np.where(m.b_closes, ord(";"), ord(","))
    at = (s.a_at + s.b_at).tolist()
    flat, start, length = _decimals(vocabulary)
    out, d = [hashlib.sha256() for _ in range(n)], 0
    for lo in range(0, len(ids), TOKENS):
        part = ids[lo : lo + TOKENS]
        hi, size = lo + len(part), length[part]
        text = flat[spans_to_places(start[part], size)]
        ends = np.concatenate([[0], np.cumsum(size)])
        text[ends[1:] - 1] = sep[lo:hi]
        text = memoryview(text)
        while d < n and at[d] < hi:
            upto = min(at[d + 1], hi)
            out[d].update(text[ends[max(at[d], lo) - lo] : ends[upto - lo] - (upto == at[d + 1])])  # no separator after the last
            if at[d + 1] > hi:
                break
            d += 1
    return [x.hexdigest() for x in out]


def _distinct_links(s: Slice, m: Marks, sizes: tuple[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each document's distinct pairs (A id * B's vocabulary + B id, ascending), how often, and where each document's begin."""
    n, bits = len(s.a_at) - 1, (sizes[0] * sizes[1]).bit_length()
    if bits + n.bit_length() > 64:
        raise ValueError("these vocabularies have too many pairs for 64 bits")
    code = s.a[m.link_a].astype(np.uint64) * np.uint64(sizes[1]) + s.b[m.link_b].astype(np.uint64)
    key = np.sort(np.repeat(np.arange(n, dtype=np.uint64) << np.uint64(bits), m.n_links) | code)
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    times = np.diff(np.append(first, len(key)))
    at = np.searchsorted(key[first], np.arange(n + 1, dtype=np.uint64) << np.uint64(bits))
    return key[first] & np.uint64((1 << bits) - 1), times, at


def _full(ok: np.ndarray, values: np.ndarray) -> np.ndarray:
    out = np.zeros(len(ok), np.int64)
    out[ok] = values
    return out


_PAIRS: dict[tuple[str, str], Pair] = {}


def _pair(a_path: str, b_path: str) -> Pair:
    if (a_path, b_path) not in _PAIRS:
        _PAIRS[a_path, b_path] = Pair(a_path, b_path)
    return _PAIRS[a_path, b_path]


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Both tokenizers' ids of every whole text and where they agree, in one pass without a shuffle.

    Returns id_col, a_ids, b_ids (arrays of int) and a_cuts, b_cuts: how many A and B ids lie before each
    group's end. A encodes a space and the text, B the text; strings of special tokens are plain text. Texts
    that are null, empty or that a tokenizer doesn't give back byte for byte have no ids and no groups. Null and
    repeated ids are kept; other columns are left behind; no rows give no rows.
    """
    reachable(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _pair(a_path, b_path)
        for whole in batches:
            for b in slices(whole, 1, SLICE):
                s = pair.encode(texts(b, 1))
                m = marks_of(s)
                cols = [b.column(0)]
                for ids, at in ((s.a, s.a_at), (s.b, s.b_at)):
                    cols.append(_lists(s.ok, ids, at))
                group_at = np.concatenate([[0], np.cumsum(m.n_groups)])
                for closes, at in ((m.a_closes, s.a_at), (m.b_closes, s.b_at)):
                    ends = np.flatnonzero(closes) + 1
                    cols.append(_lists(s.ok, ends - np.repeat(at[:-1], m.n_groups), group_at))
                yield pa.RecordBatch.from_arrays(cols, [id_col, "a_ids", "b_ids", "a_cuts", "b_cuts"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {dict(docs.dtypes)[id_col]}, a_ids array<int>, b_ids array<int>, a_cuts array<int>, b_cuts array<int>")


def _lists(ok: np.ndarray, values: np.ndarray, at: np.ndarray) -> pa.Array:
    size = _full(ok, np.diff(at))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(values.astype(np.int32)))


def links(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row a document: id_col, n_a, n_b, n_groups, n_links, groups_sha256, and its distinct pairs of linked
    ids (`codes`, little-endian numbers A id * B's vocabulary + B id) with how often each occurs (`times`)."""
    reachable(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _pair(a_path, b_path)
        for whole in batches:
            for b in slices(whole, 1, SLICE):
                s = pair.encode(texts(b, 1))
                m = marks_of(s)
                found = np.full(len(s.ok), "", object)
                found[s.ok] = digests(s, m, max(pair.sizes))
                codes, times, at = _distinct_links(s, m, pair.sizes)
                width = _width(pair.sizes)
                at = np.concatenate([[0], np.cumsum(_full(s.ok, np.diff(at)))])
                numbers = [pa.array(_full(s.ok, x)) for x in (np.diff(s.a_at), np.diff(s.b_at), m.n_groups, m.n_links)]
                packed = [binary_array(x.astype(f"<u{w}").view(np.uint8), at * w) for x, w in ((codes, width), (times, 4))]
                yield pa.RecordBatch.from_arrays([b.column(0), *numbers, pa.array(found.tolist(), pa.string()), *packed], [id_col, "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "codes", "times"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {dict(docs.dtypes)[id_col]}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, codes binary, times binary")


def _width(sizes: tuple[int, int]) -> int:
    return 4 if sizes[0] * sizes[1] <= 1 << 32 else 8


def _numbers(column: pa.Array, width: int) -> np.ndarray:
    data, _ = flat_bytes(column)
    return data.view(f"<u{width}") if len(data) else np.zeros(0, f"<u{width}")


def _summed(codes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(codes, kind="stable")
    codes, n = codes[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.zeros(0, np.int64)
    return codes[first], np.add.reduceat(n, first) if len(first) else n


def pair_counts(linked: DataFrame, sizes: tuple[int, int]) -> DataFrame:
    """code, n (links of all documents with that pair) and best (no pair of its B id has more), from a written table of links.

    A task sums what it reads before anything is shuffled; a B id has at most as many pairs as A has ids.
    """
    width = _width(sizes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have, n = np.zeros(0, f"<u{width}"), np.zeros(0, np.int64)
        parts, held = [], 0

        def fold():
            codes = np.sort(np.concatenate([np.repeat(c, t) for c, t in parts]))
            first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
            return _summed(np.concatenate([have, codes[first]]), np.concatenate([n, np.diff(np.append(first, len(codes)))]))

        for b in batches:
            codes, times = _numbers(b.column(0), width), _numbers(b.column(1), 4)
            for k in range(0, len(codes), LINKS):
                parts.append((codes[k : k + LINKS], times[k : k + LINKS]))
                held += int(parts[-1][1].sum())
                if held > LINKS:
                    (have, n), parts, held = fold(), [], 0
            if len(have) > PAIRS:
                yield pa.RecordBatch.from_arrays([pa.array(have.astype(np.int64)), pa.array(n)], ["code", "n"])
                have, n = have[:0], n[:0]
        if held:
            have, n = fold()
        for k in range(0, len(have), 1 << 20):
            yield pa.RecordBatch.from_arrays([pa.array(have[k : k + (1 << 20)].astype(np.int64)), pa.array(n[k : k + (1 << 20)])], ["code", "n"])

    counts = linked.select("codes", "times").mapInArrow(run, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n"))
    of_b = Window.partitionBy(F.pmod("code", F.lit(sizes[1])))
    return counts.withColumn("best", F.col("n") == F.max("n").over(of_b))


def scores(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every whole text.

    n_best counts the links whose pair of ids no pair of the same B id outnumbers in all documents, ties included;
    count_sum adds the pairs' counts over all links. Texts without tokens (see align) have zeros and an
    empty digest. Rows of one id are counted each, repeated rows too. No rows give no rows.
    """
    spark = reachable(docs.sparkSession)
    sizes = _pair(a_path, b_path).sizes
    width = _width(sizes)
    rows = materialised(links(docs, a_path, b_path, id_col, text_col), "token-links")
    counts = materialised(pair_counts(rows, sizes), "pair-counts")
    turns = max(1, -(-counts.count() // PAIRS))
    rows = rows.withColumn("n_best", F.lit(0).cast("bigint")).withColumn("count_sum", F.lit(0).cast("bigint"))
    names = rows.columns
    for turn in range(turns):
        block = counts.where(F.pmod(F.xxhash64("code"), F.lit(turns)) == turn) if turns > 1 else counts
        held = block.toArrow().sort_by("code")
        sent = spark.sparkContext.broadcast((held["code"].to_numpy().astype(f"<u{width}"), held["n"].to_numpy(), held["best"].to_numpy()))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            known, n, best = sent.value
            for whole in batches:
                for b in slices(whole, names.index("codes")):
                    codes, times = _numbers(b.column(names.index("codes")), width), _numbers(b.column(names.index("times")), 4).astype(np.int64)
                    _, at = flat_bytes(b.column(names.index("codes")))
                    place = np.minimum(np.searchsorted(known, codes), max(len(known) - 1, 0))
                    here = known[place] == codes if len(known) else np.zeros(len(codes), bool)
                    each = [np.zeros(len(codes), np.int64) for _ in range(2)]
                    each[0][here] = np.where(best[place[here]], times[here], 0)
                    each[1][here] = n[place[here]] * times[here]
                    more = {c: pc.add(b.column(names.index(c)), pa.array(np.diff(np.concatenate([[0], np.cumsum(x)])[at // width]))) for c, x in zip(("n_best", "count_sum"), each, strict=True)}
                    yield pa.RecordBatch.from_arrays([more.get(c, b.column(i)) for i, c in enumerate(names)], names)

        rows = rows.mapInArrow(run, rows.schema)
        if turn + 1 < turns:  # one broadcast at a time
            rows = materialised(rows, "token-links")
            sent.destroy()
    return rows.select(id_col, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12_tokenizer_alignment."""
    import public_tokenizers

    return scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
