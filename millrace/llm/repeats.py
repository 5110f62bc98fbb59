"""Repeated word sequences across and within documents: what operators 1 and 7 share.

Both look for every sequence of `window` words that starts at two places or more. Both cut documents
into pieces: the stretch of consecutive windows that have one minimiser. A piece goes to the bucket of
its minimiser and is compared there; the operators differ in how a bucket finds repeats.

Steps: (1) one pass hashes words, names each row's word sequence, counts frequent anchors and lists the
minimisers; (2) a bitmap keeps the minimisers that come twice - a window with any other can't repeat;
(3) a second pass sends the pieces of the remaining windows; (4) buckets answer with the repeated places.

No minimiser is hot: in the pieces that are sent, common anchors come last in the order, so a window that
leaves a common passage is dealt by the words around it. Only windows made of nothing but
common anchors have a common minimiser, and those are mostly equal.

Copies never travel in numbers: of rows with one word sequence (a 128-bit BLAKE2b digest of the words)
each task sends one, as each window of a copy is repeated anyway; of equal pieces, compared word by
word, each task sends one, marked as repeated, and answers for its own places itself. So a bucket gets
each distinct piece at most once from a task. The rows of a large group of copies learn that they are
copies where they are, from a broadcast name, and aren't brought together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.arrowio import coded, frugal, frugal_group, materialised, reachable, slices, split_words, texts
from millrace.llm.hashing import mixed, window_hashes
from millrace.llm.skew import join_spread

#: Words of a minimiser.
ANCHOR = 8
#: Largest bitmap of minimisers, as a power of 2 of bits; above it more pieces travel, with the same result.
MOST_BITS = 30
#: Bytes of pieces that a task holds before it hands them on.
FLUSH_BYTES = 24 << 20

#: An anchor that comes more often than this, and than half a bucket's share of the pieces, is common; of
#: more than MOST_COMMON the most frequent are. The choice moves pieces between buckets, not results.
HOT_PIECES, MOST_COMMON = 512, 1 << 20
#: How often a slice must hold an anchor for it to be counted at all.
SEEN_OFTEN = 4
#: Words of the input for each bucket, at most; more input makes more buckets.
BUCKET_WORDS = 1 << 23



def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` numbers from a place on (the last width - 1 places: of those left)."""
    out, done = x.copy(), 1
    while done < width:
        step = min(done, width - done)
        out[:-step] = np.minimum(out[:-step], out[step:])
        done += step
    return out


def windows(at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and documents of all whole windows."""
    n = np.diff(at)
    doc = np.repeat(np.arange(len(n)), n)
    starts = np.flatnonzero(np.arange(len(doc)) + window <= at[1:][doc]) if len(doc) else np.zeros(0, np.int64)
    return starts, doc[starts]


def minimisers(anchors: np.ndarray, starts: np.ndarray, window: int, common: np.ndarray | None = None) -> np.ndarray:
    """The place of each window's minimiser: its leftmost anchor with the least number, which is whether it
    is common, then the upper bits of its hash. The place is the lower half of the number of which the
    least is taken, so one sliding minimum finds both.
    """
    number = anchors >> np.uint64(33) << np.uint64(32) | np.arange(len(anchors), dtype=np.uint64)
    if common is not None and len(common) and len(anchors):
        near = np.minimum(np.searchsorted(common, anchors), len(common) - 1)
        number |= (common[near] == anchors).astype(np.uint64) << np.uint64(63)
    least = sliding_least(number, window - ANCHOR + 1)[starts]
    return (least & np.uint64(0xFFFFFFFF)).astype(np.int64)


def first_of_runs(*columns: np.ndarray) -> np.ndarray:
    """Where neighbours differ in some column, the first place included."""
    if not len(columns[0]):
        return np.zeros(0, np.int64)
    new = np.zeros(len(columns[0]) - 1, bool)
    for c in columns:
        new |= c[1:] != c[:-1]
    return np.flatnonzero(np.concatenate([[True], new]))


def _hashed(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes], pa.Array]:
    """Word hashes, where texts begin, word codes, the words that the codes mean, and each text's words
    joined by one blank."""
    flat, at = split_words(text)
    words = coded(flat)
    names = words.dictionary.cast(pa.binary()).to_pylist()
    table = np.fromiter(map(xxhash.xxh3_64_intdigest, names), np.uint64, len(names))
    code = words.indices.to_numpy()
    plain = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(at), flat), " ")
    return (table[code] if len(names) else table), at, code, names, plain


def _fresh(plain: pa.Array, seen: set[bytes]) -> tuple[list[bytes], np.ndarray]:
    """Each row's name of its word sequence, and which rows are the first with theirs in this task."""
    names, new = [], np.zeros(len(plain), bool)
    for i, words in enumerate(plain.cast(pa.binary()).to_pylist()):
        names.append(hashlib.blake2b(words, digest_size=16).digest())
        if names[-1] not in seen:
            seen.add(names[-1])
            new[i] = True
    return names, new


def repeated_spans(docs: DataFrame, window: int, answer: Callable[[pa.Table, int], pa.Table], id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows, spans): rows has id, text_key and n_words; spans has id, text_key, first and end (words) of
    places that are covered by windows found elsewhere; spans of a row may touch or overlap."""
    spark = reachable(docs.sparkSession)
    least = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    id_type = dict(docs.dtypes)[id_col]
    source = docs.select(F.col(id_col), F.col(text_col), F.xxhash64(text_col).alias("text_key"))
    often = SEEN_OFTEN

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        names = [id_col, "text_key", "n_words", "sequence", "bucket", "packed", "times"]
        for whole in batches:
            id_kind = whole.schema.field(0).type
            for b in slices(whole, 1):
                h, at, _, _, plain = _hashed(texts(b, 1))
                sequence, new = _fresh(plain, seen)
                k = b.num_rows
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(np.diff(at)), pa.array(sequence, pa.binary()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary()), pa.nulls(k, pa.binary())], names)
                anchors = window_hashes(h, ANCHOR)
                start, doc = windows(at, window)
                place = minimisers(anchors, start, window)
                first = first_of_runs(place)
                cells = np.sort((mixed(anchors[place[first[new[doc[first]]]]]) >> np.uint64(32)).astype(np.uint32))
                bucket = (cells.astype(np.uint64) * np.uint64(least) >> np.uint64(32)).astype(np.int32)
                edge = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1))
                if len(cells):
                    k = len(edge) - 1
                    packed = [cells[x:y].tobytes() for x, y in zip(edge[:-1], edge[1:], strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.nulls(k, id_kind), *[pa.nulls(k, pa.int64())] * 2, pa.nulls(k, pa.binary()), pa.array(bucket[edge[:-1]]), pa.array(packed, pa.binary()), pa.nulls(k, pa.binary())], names)
                inside = np.repeat(new, np.diff(at)) & (np.arange(len(h)) + ANCHOR <= np.repeat(at[1:], np.diff(at)))
                anchors = np.sort(anchors[inside])
                first = first_of_runs(anchors)
                times = np.diff(np.append(first, len(anchors)))
                keep = times >= often
                if keep.any():
                    packed = [pa.array([x.tobytes()], pa.binary()) for x in (anchors[first[keep]], times[keep].astype(np.int64))]
                    yield pa.RecordBatch.from_arrays([pa.nulls(1, id_kind), *[pa.nulls(1, pa.int64())] * 2, pa.nulls(1, pa.binary()), pa.nulls(1, pa.int32()), *packed], names)

    scanned = materialised(source.mapInArrow(frugal(scan), f"`{id_col}` {id_type}, text_key bigint, n_words bigint, sequence binary, bucket int, packed binary, times binary"), "word-scan")
    rows = scanned.where("packed is null").select(id_col, "text_key", "n_words", "sequence")
    words = rows.agg(F.sum("n_words").alias("n")).first().n or 0
    buckets = max(least, words // BUCKET_WORDS)
    shared_common = spark.sparkContext.broadcast(_common(scanned, max(HOT_PIECES, words // (window * buckets))))

    total = scanned.where("bucket is not null").agg(F.sum(F.length("packed")).alias("n")).first().n or 0
    bits = min(MOST_BITS, max(17, int(np.ceil(np.log2(max(2, 2 * total))))))  # 8 cells a minimiser

    def twice(table: pa.Table) -> pa.Table:
        cells = np.sort(np.frombuffer(b"".join(table.column("cells").to_pylist()), np.uint32)) >> np.uint32(32 - bits)
        return pa.table({"hit": pa.array([np.unique(cells[1:][cells[1:] == cells[:-1]]).astype(np.uint32).tobytes()], pa.binary())})

    bitmap = np.zeros(1 << bits >> 3, np.uint8)
    for r in scanned.where("bucket is not null").select("bucket", F.col("packed").alias("cells")).groupBy("bucket").applyInArrow(frugal_group(twice), "hit binary").toLocalIterator():
        hit = np.frombuffer(bytes(r.hit), np.uint32)
        np.bitwise_or.at(bitmap, hit >> 3, (1 << (hit & 7)).astype(np.uint8))
    shared = spark.sparkContext.broadcast(bitmap)  # 2^MOST_BITS bits at most

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        held: dict[tuple[bytes, int], tuple[int, list]] = {}
        size = 0
        names = ["bucket", "id", "text_key", "first", "anchor", "n", "words"]

        def flush() -> pa.RecordBatch:
            out: list[tuple] = []
            known: dict[tuple, list[tuple[int, int]]] = {}
            for (words, anchor), (bucket, places) in held.items():
                n = words.count(b" ") + 1
                if len(places) > 1:  # repeated here: answered here
                    for i, t, f in places:
                        known.setdefault((i, t), []).append((f, f + n))
                    out.append((bucket, None, None, None, anchor, n, words))
                else:
                    out.append((bucket, *places[0], anchor, n, words))
            for (i, t), spans in known.items():  # answers are joined for each row and dealt by the row
                out += [(t % buckets, i, t, f, None, z - f, None) for f, z in joined(sorted(spans))]
            cols = list(zip(*out, strict=True))
            kinds = [pa.int32(), id_kind, pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

        for whole in batches:
            id_kind = whole.schema.field(0).type
            for b in slices(whole, 1):
                h, at, code, word, plain = _hashed(texts(b, 1))
                _, new = _fresh(plain, seen)
                anchors, common = window_hashes(h, ANCHOR), shared_common.value
                start, doc = windows(at, window)
                place = minimisers(anchors, start, window)
                cell = (mixed(anchors[place]) >> np.uint64(64 - bits)).astype(np.int64)
                keep = np.flatnonzero(new[doc] & (shared.value[cell >> 3] >> (cell & 7) & 1).astype(bool))
                place = (minimisers(anchors, start, window, common) if len(common) else place)[keep]
                start, doc = start[keep], doc[keep]
                first = first_of_runs(place, start - np.arange(len(start)))
                end = start[np.append(first[1:], len(start)) - 1] + window if len(first) else first
                doc, start, anchor = doc[first], start[first], place[first]
                bucket = (mixed(anchors[anchor] ^ np.uint64(0x5BD1E995)) % np.uint64(buckets)).astype(np.int32)
                ids, keys = b.column(0).to_pylist(), b.column(2).to_pylist()
                for d, s, e, a, k in zip(doc.tolist(), start.tolist(), end.tolist(), anchor.tolist(), bucket.tolist(), strict=True):
                    name = (b" ".join([word[c] for c in code[s:e].tolist()]), a - s)
                    place = (ids[d], keys[d], s - int(at[d]))
                    got = held.get(name)
                    if got is None:
                        held[name] = (k, [place])
                        size += len(name[0]) + 200
                    else:
                        got[1].append(place)
                        size += 100
                if size >= FLUSH_BYTES:
                    yield flush()
                    held, size = {}, 0
        if held:
            yield flush()

    sent = source.mapInArrow(frugal(send), f"bucket int, id {id_type}, text_key bigint, first bigint, anchor int, n int, words binary")

    def count(table: pa.Table) -> pa.Table:
        mask = pa.compute.is_null(table.column("words"))
        done = table.filter(mask)
        own = pa.table({"id": done.column("id"), "text_key": done.column("text_key"), "first": done.column("first"), "end": pa.compute.add(done.column("first"), done.column("n").cast(pa.int64()))})
        found = answer(table.filter(pa.compute.invert(mask)).combine_chunks(), window)
        return pa.concat_tables([own.select(["id", "text_key", "first", "end"]), found.cast(own.schema)])

    spans = sent.groupBy("bucket").applyInArrow(frugal_group(count), f"id {id_type}, text_key bigint, first bigint, end bigint")
    long = rows.where(F.col("n_words") >= window)
    copies = materialised(long.groupBy("sequence").agg(F.count("*").alias("k")).where("k > 1"), "copies")
    copied = join_spread(long, copies, "sequence", "k", long.count())
    whole_rows = copied.select(F.col(id_col).alias("id"), "text_key", F.lit(0).cast("bigint").alias("first"), F.col("n_words").alias("end"))
    return rows, spans.union(whole_rows)


def _common(scanned: DataFrame, more: int) -> np.ndarray:
    """Anchors that come more than `more` times, sorted; MOST_COMMON of them at most, so their size is bounded."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            anchors, times = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.int64) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(anchors), pa.array(times)], ["anchor", "times"])

    counted = scanned.where("times is not null").select("packed", "times").mapInArrow(frugal(unpack), "anchor bigint, times bigint").groupBy("anchor").agg(F.sum("times").alias("times"))
    found = counted.where(F.col("times") > more).orderBy(F.col("times").desc(), "anchor").limit(MOST_COMMON).select("anchor").toArrow().column(0).to_numpy()
    return np.sort(found.astype(np.int64).view(np.uint64))


def replies(table: pa.Table, piece: np.ndarray, first: np.ndarray, end: np.ndarray) -> pa.Table:
    """Answers for pieces that have a place: places within a piece become places in its document."""
    there = table.column("id").combine_chunks(), table.column("text_key").combine_chunks(), table.column("first").combine_chunks()
    base = there[2].fill_null(-1).to_numpy()
    keep = base[piece] >= 0
    piece, first, end = piece[keep], first[keep], end[keep]
    at = pa.array(piece)
    return pa.table({"id": there[0].take(at), "text_key": there[1].take(at), "first": pa.array(base[piece] + first), "end": pa.array(base[piece] + end)})


def by_row(spans: DataFrame, id_col: str) -> DataFrame:
    """One row for each document row with spans: id, text_key, starts and ends, in order. Long spans cover
    their rows' words, so a list is no longer than its text."""
    return spans.groupBy("id", "text_key").agg(F.sort_array(F.collect_set(F.struct("first", "end"))).alias("spans")).withColumnRenamed("id", id_col)


def joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans with those that touch or overlap joined."""
    out: list[tuple[int, int]] = []
    for first, end in spans:
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((first, end))
    return out


def merged(spans: list[dict]) -> list[tuple[int, int]]:
    return joined([(s["first"], s["end"]) for s in spans])


def runs(mask: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last places of runs of marked neighbours of one group."""
    at = np.flatnonzero(mask)
    if not len(at):
        return at, at
    new = np.concatenate([[True], (np.diff(at) > 1) | (group[at[1:]] != group[at[:-1]])])
    return at[new], at[np.concatenate([new[1:], [True]])]
