"""Benchmark decontamination (operator 11).

The benchmark's windows of normalised words are hashed into a set that each task holds; a scan of the
training texts looks up the hash of every window, compares the words of each hit with the benchmark's own, and marks
the words that a true hit covers. Documents never travel. A benchmark of more than BLOCK_WORDS words is dealt
into blocks of about that size, which are broadcast one after the other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.arrowio import flat_bytes, fresh, materialised, reachable, slices, spans_to_places, split_words, texts
from millrace.llm.hashing import mixed, window_hashes

#: Words of a window.
WINDOW = 10
#: Words of the benchmark that one broadcast holds (about 150 bytes each as an index); words of a piece of an item.
BLOCK_WORDS, PIECE_WORDS = 1 << 20, 4096
#: Possible hits that are compared at once.
AT_ONCE = 1 << 17

#: A-Z to a-z; bytes of words stay; all others are blanks.
_NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def normal(text: pa.Array) -> pa.Array:
    """Texts with A-Z lower-cased and a blank for each character that is in no word; bytes keep their places."""
    data, at = flat_bytes(text)
    return pa.StringArray.from_buffers(len(text), pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data.tobytes().translate(_NORMAL)))


def pieces(items: DataFrame, window: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item (the id as text), words (joined by blanks) and n of every item with words; long items are cut into
    pieces that share window - 1 words, so each window is whole in one piece."""
    reachable(items.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, 1):
                words, at = split_words(normal(texts(b, 1)))
                for i, name in enumerate(b.column(0).to_pylist()):
                    a, z = int(at[i]), int(at[i + 1])
                    starts = range(a, max(a + 1, z - window + 1), PIECE_WORDS) if z > a else ()
                    cut = [words.slice(k, min(PIECE_WORDS + window - 1, z - k)) for k in starts]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(cut), pa.string()), pa.array([" ".join(c.to_pylist()) for c in cut], pa.string()), pa.array([len(c) for c in cut], pa.int64())], ["item", "words", "n"])

    return items.select(F.col(id_col).cast("string"), text_col).mapInArrow(run, "item string, words string, n bigint")


class Index:
    """The windows of some pieces: made once on the driver from a bounded block, looked up by tasks.

    Words are numbered, so a window is a row of numbers; equal windows are one row, which names its items.
    """

    def __init__(self, item: pa.Array, words: pa.Array, window: int):
        flat, at = split_words(words)
        coded = flat.dictionary_encode() if len(flat) else pa.array([], pa.string()).dictionary_encode()
        self.vocabulary = coded.dictionary
        codes = coded.indices.to_numpy().astype(np.int32)
        names = sorted({x for x in item.to_pylist() if x is not None})
        self.names = pa.array(names, pa.string())
        of = pc.fill_null(pc.index_in(item, self.names), -1).to_numpy().astype(np.int64) if names else np.full(len(item), -1)
        size = np.diff(at)
        self.tables = []
        for length in np.unique(np.minimum(size, window)).tolist():
            if not length:
                continue
            rows = np.flatnonzero(np.minimum(size, window) == length)
            n = size[rows] - length + 1
            starts, owner = spans_to_places(at[rows], n), np.repeat(of[rows], n)
            grams, which = np.unique(codes[starts[:, None] + np.arange(length)], axis=0, return_inverse=True)
            pairs = np.unique(np.stack([which.ravel(), owner]), axis=1)
            pairs = pairs[:, pairs[1] >= 0]  # an item without an id has windows but no name
            hashes = self._hashes(grams.ravel(), length)[::length]
            order = np.argsort(hashes, kind="stable")
            back = np.empty(len(order), np.int64)
            back[order] = np.arange(len(order))
            pairs = pairs[:, np.argsort(back[pairs[0]], kind="stable")]
            item_at = np.searchsorted(back[pairs[0]], np.arange(len(grams) + 1))
            hashes = hashes[order]
            bits = max(10, int(16 * len(grams)).bit_length())
            seen = np.zeros(1 << bits, bool)
            seen[hashes & np.uint64((1 << bits) - 1)] = True
            longest = int(np.diff(np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1], [True]]))).max())
            self.tables.append((length, grams[order], hashes, seen, longest, item_at, pairs[1]))

    @staticmethod
    def _hashes(codes: np.ndarray, length: int) -> np.ndarray:
        return window_hashes(mixed(codes.astype(np.int64).astype(np.uint64) + np.uint64(1)), length)

    def codes(self, words: pa.Array) -> np.ndarray:
        """The numbers of words, -1 for those that no item has."""
        if not len(words) or not len(self.vocabulary):
            return np.full(len(words), -1, np.int32)
        coded = words.dictionary_encode()
        number = pc.fill_null(pc.index_in(coded.dictionary, self.vocabulary), -1).to_numpy().astype(np.int32)
        return number[coded.indices.to_numpy()]

    def hits(self, codes: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray]]]:
        """For each length: where a window occurs, which window, and the windows' items. Words are compared one by one."""
        strange = np.concatenate([[0], np.cumsum(codes < 0)])
        doc_end = np.repeat(at[1:], np.diff(at))
        for length, grams, hashes, seen, longest, item_at, items in self.tables:
            if len(codes) < length:
                continue
            found_at, found = [], []
            h = self._hashes(codes, length)
            inside = np.flatnonzero(seen[h & np.uint64(len(seen) - 1)])
            inside = inside[inside + length <= doc_end[inside]]
            inside = inside[strange[inside + length] == strange[inside]]
            for k in range(0, len(inside), AT_ONCE):
                p = inside[k : k + AT_ONCE]
                lo = np.searchsorted(hashes, h[p])
                for step in range(longest):  # windows of one hash
                    row = np.minimum(lo + step, len(hashes) - 1)
                    maybe = (lo + step < len(hashes)) & (hashes[row] == h[p])
                    q, row = p[maybe], row[maybe]
                    same = (grams[row] == codes[q[:, None] + np.arange(length)]).all(axis=1)
                    found_at.append(q[same])
                    found.append(row[same])
            if found_at:
                yield length, np.concatenate(found_at), np.concatenate(found), (item_at, items)


def _mark(index: Index, text: pa.Array) -> tuple[np.ndarray, list, list]:
    """Words, merged spans of hit words, and sorted item names of each text."""
    words, at = split_words(normal(text))
    codes = index.codes(words)
    cover = np.zeros(len(codes) + 1, np.int64)
    n, seen = len(text), []
    for length, p, row, (item_at, items) in index.hits(codes, at):
        cover += np.bincount(p, minlength=len(cover)) - np.bincount(p + length, minlength=len(cover))
        doc = np.searchsorted(at, p, side="right") - 1
        pair = np.unique(np.stack([doc, row]), axis=1)
        many = np.diff(item_at)[pair[1]]
        seen.append(np.unique(np.stack([np.repeat(pair[0], many), items[spans_to_places(item_at[pair[1]], many)]]), axis=1))
    hit = np.concatenate([[False], np.cumsum(cover)[:-1] > 0])
    edge = np.zeros(len(codes) + 1, bool)
    edge[at] = True  # spans end with their document
    hit_at, before = hit[1:], hit[:-1]
    first = np.flatnonzero(hit_at & (~before | edge[:-1]))
    last = np.flatnonzero(hit_at & (np.append(~hit_at[1:], True) | edge[1:]))
    doc = np.searchsorted(at, first, side="right") - 1
    spans, names = [[] for _ in range(n)], [[] for _ in range(n)]
    for d, a, z in zip(doc.tolist(), (first - at[doc]).tolist(), (last + 1 - at[doc]).tolist(), strict=True):
        spans[d].append({"first": a, "end": z})
    if seen:
        pair = np.unique(np.concatenate(seen, axis=1), axis=1)
        for d, x in zip(pair[0].tolist(), index.names.take(pa.array(pair[1])).to_pylist(), strict=True):
            names[d].append(x)
    return np.diff(at), spans, names


def _joined(old: list[dict] | None, new: list[dict]) -> list[dict]:
    """Two lists of spans as one, sorted; spans that touch or overlap are one."""
    out: list[dict] = []
    for s in sorted([*(old or []), *new], key=lambda s: s["first"]):
        if out and s["first"] <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], s["end"])
        else:
            out.append(dict(s))
    return out


_SPANS = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))


def mark(docs: DataFrame, items: DataFrame, window: int = WINDOW, text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """docs with three more columns: n_words, spans (first word and end of each run of hit words, counted in the
    document) and items (ids, as text and sorted, of the items of which a window occurs).

    A window is `window` consecutive words of an item; an item of fewer words, but not none, is one window. Words are
    runs of ASCII letters and digits and of characters above ASCII, with A-Z lower-cased. Null and empty texts have no
    words; items without words have no windows; repeated items and rows count as one and each; an item with
    a null id hits but isn't listed. Where docs has such columns, the new ones' names end in underscores. Empty
    tables give no rows, or rows without hits.
    """
    spark = reachable(docs.sparkSession)
    table = materialised(pieces(items, window, item_id, item_text), "benchmark-pieces")
    total = table.agg(F.sum("n").alias("n")).first().n or 0
    turns = max(1, -(-total // BLOCK_WORDS))
    new = fresh(docs.columns, "n_words", "spans", "items")
    types = ("bigint", "array<struct<first:bigint,end:bigint>>", "array<string>")
    names, at = docs.columns, docs.columns.index(text_col)
    rows = docs.select("*", *[F.lit(None).cast(t).alias(c) for c, t in zip(new, types, strict=True)])
    for turn in range(turns):
        block = (table.where(F.pmod(F.xxhash64("item", "words"), F.lit(turns)) == turn) if turns > 1 else table).toArrow()
        sent = spark.sparkContext.broadcast(Index(*(block.column(c).combine_chunks() if block.num_rows else pa.array([], pa.string()) for c in ("item", "words")), window))

        def run(batches: Iterator[pa.RecordBatch], sent=sent, turn=turn) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for b in slices(whole, at):
                    n, spans, items = _mark(sent.value, texts(b, at))
                    if turn:  # what earlier blocks found
                        spans = [_joined(x, y) for x, y in zip(b.column(len(names) + 1).to_pylist(), spans, strict=True)]
                        items = [sorted({*x, *y}) for x, y in zip(b.column(len(names) + 2).to_pylist(), items, strict=True)]
                    more = [pa.array(n, pa.int64()), pa.array(spans, _SPANS), pa.array(items, pa.list_(pa.string()))]
                    yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(names))), *more], [*names, *new])

        rows = rows.mapInArrow(run, rows.schema)
        if turn + 1 < turns:  # one broadcast at a time
            rows = materialised(rows, "marked")
            sent.destroy()
    return rows


def clean_documents(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents of which no word is hit, with their columns as they were (see mark for edge cases)."""
    marked = mark(docs, items, window)
    return marked.where(F.size(marked.columns[-2]) == 0).select(*[marked[f"`{c}`"] for c in docs.columns])


def clean_spans(docs: DataFrame, items: DataFrame, window: int = WINDOW, text_col: str = "text") -> DataFrame:
    """All documents, with each run of hit words cut out, from its first word's first character to its last word's
    last; what stands around stays. n_chars, where there is one, follows. Null texts stay null."""
    names, at = docs.columns, docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, at):
                spans, out = b.column(len(names) + 1).to_pylist(), b.column(at).to_pylist()
                for i in np.flatnonzero([bool(s) for s in spans]):
                    data = out[i].encode()
                    word = np.frombuffer(data.translate(_NORMAL), np.uint8) != 32
                    edge = np.flatnonzero(np.diff(np.concatenate([[False], word, [False]]).astype(np.int8))).reshape(-1, 2)
                    done, kept = 0, []
                    for s in spans[i]:
                        kept.append(data[done : edge[s["first"], 0]])
                        done = edge[s["end"] - 1, 1]
                    out[i] = (b"".join(kept) + data[done:]).decode()
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if i == at else b.column(i) for i in range(len(names))], names)

    cut = mark(docs, items, window, text_col).mapInArrow(run, docs.schema)
    return cut.withColumn("n_chars", F.length(text_col).cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in names else cut


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11_decontamination."""
    docs, items = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    marked = mark(docs.select("doc_id", "text"), items)
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["first"])
    return marked.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))
