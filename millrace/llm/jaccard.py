"""N-gram Jaccard join with adaptive multi-match prefixes (operator 4).

Documents with equal shingle sets make one node, named by 128 bits; only the first SHORT bytes of the names
travel, unless two nodes have these in common. Shingles are ordered by how many nodes hold them (rare first). Nodes whose similarity reaches the threshold share at least l of the
shingles in their l-prefixes: the first n - ceil(t n) + l in that order. Each node picks the l, and so
the length of its prefix, for which its postings and candidates are estimated to cost the least; a
pair is verified only if it shares min(l, l') prefix shingles at places that leave room for enough more.

Links are only needed up to reachability. A posting list first proposes pairs with its most central
members (one, and one more for each eightfold of its length), which the multi-match count must admit;
afterwards pairs that are still in different components are looked for, and counted in all lists.

A list longer than SPLIT is dealt over several buckets by its nodes' names. The parts' leaders meet in
the list's leader, and what is left in different components is compared tile by tile.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.arrowio import binary_array, fresh, frugal, frugal_group, materialised, reachable, slices, texts
from millrace.llm.components import components
from millrace.llm.hashing import mixed, shingle_sets
from millrace.llm.skew import join_spread

SIZE, PERCENT = 5, 80
#: Heaviest shingle cells whose counts order the prefixes; the rest count as rare. Bounds a broadcast.
HEAVY_CELLS = 1 << 20
#: Prefix entries that a task holds before it hands them on.
FLUSH = 1_000_000
#: Nodes of a posting list that one bucket takes; longer lists are dealt over several.
SPLIT = 1 << 15
#: Entries of each side that a tile of a dealt list compares.
TILE = 4096
#: Bytes of a name that travel if they tell all nodes apart, and of a whole name.
SHORT, NAME = 8, 16
#: Prefix entries for each bucket, and followers that meet one copy of their leader.
BUCKET_ENTRIES, FOLLOWERS = 1 << 21, 256
#: Pairs that are broadcast at once to where texts are, and in how many batches at most; beyond that texts are shuffled once more.
PAIRS, BATCHES = 1 << 19, 8


def _lower(text: pa.Array) -> pa.Array:
    return pc.ascii_lower(text)


def _node(s: np.ndarray) -> bytes:
    """A set's 128-bit name."""
    return xxhash.xxh3_128_digest(s.tobytes())


def _names(x: np.ndarray) -> pa.Array:
    """Names as Arrow binaries."""
    return binary_array(np.frombuffer(x.tobytes(), np.uint8), x.dtype.itemsize * np.arange(len(x) + 1))


def _from_names(column) -> np.ndarray:
    return _cut_names(b"".join(column.to_pylist()), len(column))


def _cut_names(data: bytes, n: int) -> np.ndarray:
    """n names that lie end to end."""
    return np.frombuffer(data, f"S{len(data) // n if n else NAME}")


def _sets_of(batches: Iterator[pa.RecordBatch], size: int, column: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for whole in batches:
        for b in slices(whole, column):
            yield b, shingle_sets(_lower(texts(b, column)), size)


def _once(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[bytes, np.ndarray]]:
    """Each distinct nonempty set of the task once, with its node."""
    seen: set[bytes] = set()
    for _, sets in _sets_of(batches, size, 0):
        for s in sets:
            if len(s) and (node := _node(s)) not in seen:
                seen.add(node)
                yield node, s


def _dealt(bucket: np.ndarray, columns: list[np.ndarray], names: list[str]) -> pa.RecordBatch:
    """One row for each bucket, with the packed columns of its entries."""
    order = np.argsort(bucket, kind="stable")
    b = bucket[order]
    cut = np.flatnonzero(np.diff(b, prepend=-1, append=-1))
    cols = [[_packed(name, c[order[i:j]]) for i, j in zip(cut[:-1], cut[1:], strict=True)] for name, c in zip(names, columns, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(b[cut[:-1]].astype(np.int32)), *[pa.array(c, pa.binary()) for c in cols]], ["bucket", *names])


def _packed(name: str, x: np.ndarray) -> bytes:
    return (x.astype("<u2") if name in _NARROW and x.max(initial=0) < 1 << 16 else x).tobytes()


def _joined(table: pa.Table, kinds: dict[str, str]) -> list[np.ndarray]:
    """The columns of all rows' entries; tokens say how many entries a row has."""
    count = [len(x) // 4 for x in table.column("token").to_pylist()]
    out = []
    for name, kind in kinds.items():
        parts = table.column(name).to_pylist()
        if name in _NARROW:
            out.append(np.concatenate([np.frombuffer(x, "<u2" if len(x) == 2 * n else kind).astype(kind) for x, n in zip(parts, count, strict=True)] or [np.zeros(0, kind)]))
        elif name == "node":
            out.append(_cut_names(b"".join(parts), sum(count)))
        else:
            out.append(np.frombuffer(b"".join(parts), kind))
    return out


def sets(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """id, a hash of the text, n_shingles and node of each row; no node where there are no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, found in _sets_of(batches, size, 1):
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([len(s) for s in found], pa.int64()), pa.array([_node(s) if len(s) else None for s in found], pa.binary())], [id_col, "text_key", "n_shingles", "node"])

    return docs.select(id_col, text_col, F.xxhash64(text_col).alias("text_key")).mapInArrow(frugal(run), f"`{id_col}` {dict(docs.dtypes)[id_col]}, text_key bigint, n_shingles bigint, node binary")


def _gaps(values: np.ndarray, base: int) -> bytes:
    """Sorted numbers as 16-bit gaps; a full step of 65535 has no number at its end."""
    gap = np.diff(values.astype(np.int64), prepend=base)
    full = gap // 65535
    out = np.full(len(gap) + int(full.sum()), 65535, np.uint16)
    out[np.cumsum(full + 1) - 1] = gap - 65535 * full
    return out.tobytes()


def _from_gaps(data: bytes, base: int) -> np.ndarray:
    step = np.frombuffer(data, np.uint16)
    return (base + np.cumsum(step, dtype=np.int64))[step != 65535].astype(np.uint32)


def _cuts(cells: np.ndarray, buckets: int) -> list[tuple[int, np.ndarray, slice]]:
    """Sorted cells by bucket: the bucket, its cells and their places."""
    bucket = cells.astype(np.int64) * buckets >> 32
    cut = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1))
    return [(int(bucket[i]), cells[i:j], slice(i, j)) for i, j in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]


def heavy_cells(texts_only: DataFrame, size: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingle cells (upper 32 bits) that the most nodes hold, and their counts, from all documents."""
    most = max(1, HEAVY_CELLS // buckets)

    def low(bucket: int) -> int:
        return -(-(bucket << 32) // buckets)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush() -> pa.RecordBatch:
            cells = np.sort(np.concatenate(held))
            first, times = _runs(cells)
            often = np.repeat(times > 3, times)  # what many nodes hold goes once with its count
            cut = [_cuts(x, buckets) for x in (cells[~often], cells[first[times > 3]])]
            rows = [(k, _gaps(x, low(k)), None, None) for k, x, _ in cut[0]]
            rows += [(k, None, x.tobytes(), times[times > 3][at].astype(np.uint32).tobytes()) for k, x, at in cut[1]]
            kinds = [pa.int32(), pa.binary(), pa.binary(), pa.binary()]
            cols = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["bucket", "cells", "often", "times"])

        for _, s in _once(batches, size):
            held.append((s >> np.uint64(32)).astype(np.uint32))
            n += len(s)
            if n >= 2 * FLUSH:
                yield flush()
                held, n = [], 0
        if held:
            yield flush()

    def heaviest(table: pa.Table) -> pa.Table:
        base = low(table.column("bucket")[0].as_py())
        often, times = (np.frombuffer(b"".join(x for x in table.column(c).to_pylist() if x), np.uint32) for c in ("often", "times"))
        cells = np.concatenate([often, *[_from_gaps(x, base) for x in table.column("cells").to_pylist() if x]])
        weight = np.ones(len(cells), np.int64)
        weight[: len(times)] = times
        order = np.argsort(cells, kind="stable")
        cells = cells[order]
        first, _ = _runs(cells)
        n = np.add.reduceat(weight[order], first)
        keep = np.flatnonzero(n >= 3)
        keep = keep[np.argsort(-n[keep], kind="stable")[:most]]
        return pa.table({"cells": pa.array([cells[first[keep]].tobytes()], pa.binary()), "counts": pa.array([np.minimum(n[keep], 0xFFFFFFFF).astype(np.uint32).tobytes()], pa.binary())})

    rows = texts_only.mapInArrow(frugal(count), "bucket int, cells binary, often binary, times binary").groupBy("bucket").applyInArrow(frugal_group(heaviest), "cells binary, counts binary").collect()  # HEAVY_CELLS at most
    cells = np.frombuffer(b"".join(bytes(r.cells) for r in rows), np.uint32)
    counts = np.frombuffer(b"".join(bytes(r.counts) for r in rows), np.uint32)
    order = np.argsort(cells)
    return cells[order], counts[order]


def _ceil(n, percent: int):
    """The least overlap of a set of n with any set that it is similar to."""
    return -(-percent * n // 100)


def choose(heavy: np.ndarray, base: int, most: int = 4, verify: float = 0.25) -> int:
    """How many prefix shingles to ask for. heavy: counts along the order, 0 for rare shingles.

    An l-prefix costs its postings, each of which meets the rest of its list, and `verify` for each
    expected candidate: the postings without the l - 1 longest lists, shared out over l matches. A
    candidate weighs less than a posting, as leaders settle most candidates before they are verified.
    """
    best, cost = 1, None
    for ask in range(1, most + 1):
        part = np.sort(heavy[: base + ask - 1])
        if len(part) < base + ask - 1:
            break
        now = part.sum() + verify * part[: len(part) - ask + 1].sum() / ask
        if cost is None or now < cost:
            best, cost = ask, now
    return best


_ENTRY = {"token": "<u4", "node": "S16", "n": "<i4", "pos": "<i4", "ask": "u1"}
#: Columns that travel with two bytes an entry where that is enough.
_NARROW = ("n", "pos")
_ENTRY_DDL = "bucket int, token binary, node binary, n binary, pos binary, ask binary"
#: Marks entries of lists that are dealt over several buckets.
_DEALT = 0x80


class _Order:
    """The common order of shingles, by how many nodes hold them; the rest by hash."""

    def __init__(self, heavy: tuple[np.ndarray, np.ndarray], percent: int):
        self.cells, self.counts, self.percent = *heavy, percent

    def prefix(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """The prefix of a set, its shingles' counts, and how many shared ones to ask for."""
        n, least = len(s), _ceil(len(s), self.percent)
        base = n - least + 1
        count = np.zeros(n, np.uint32)
        if len(self.cells):
            cell = (s >> np.uint64(32)).astype(np.uint32)
            at = np.minimum(np.searchsorted(self.cells, cell), len(self.cells) - 1)
            count = np.where(self.cells[at] == cell, self.counts[at], 0)
        ask = 1
        if count.any():
            by = np.lexsort((s, count))
            s, count = s[by], count[by]
            if count[: base + 3].any():
                ask = min(choose(count.astype(np.int64), base), least)
        return s[: base + ask - 1].copy(), count[: base + ask - 1].copy(), ask  # a view would keep the whole set as long as the prefix


def _prefixes(heavy, size: int, percent: int, buckets: int, wide: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = _Order(heavy.value, percent)
        held: list[tuple] = []
        total = 0

        def flush() -> pa.RecordBatch:
            token, count = (np.concatenate([x[k] for x in held]) for k in (0, 1))
            m = [len(x[0]) for x in held]
            node, n, ask = (np.repeat(np.array([x[k] for x in held], t), m) for k, t in ((2, f"S{wide}"), (3, np.int32), (4, np.uint8)))
            pos = np.concatenate([np.arange(x, dtype=np.int32) for x in m])
            spread = mixed(token)
            dealt = count > SPLIT
            if dealt.any():
                part = np.frombuffer(node[dealt].tobytes(), np.uint64)[:: wide // 8] % (count[dealt].astype(np.uint64) // np.uint64(SPLIT) + np.uint64(1))
                spread[dealt] = mixed(spread[dealt] + part)
                ask = np.where(dealt, ask | _DEALT, ask).astype(np.uint8)
            bucket = (spread >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
            return _dealt(bucket.astype(np.int64), [token.astype(np.uint32), node, n, pos, ask], list(_ENTRY))

        for node, s in _once(batches, size):
            tokens, count, ask = order.prefix(s)
            held.append((tokens, count, node[:wide], len(s), ask))
            total += len(tokens)
            if total >= FLUSH:
                yield flush()
                held, total = [], 0
        if held:
            yield flush()

    return run


def _runs(token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of equal neighbours."""
    first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])) if len(token) else np.zeros(0, np.int64)
    return first, np.diff(np.append(first, len(token)))


def _shared(table: pa.Table) -> pa.Table:
    """The bucket's entries whose shingle at least two nodes have, by shingle and place in the prefix.

    A node that several tasks sent is there once. Its shingles keep their places apart, so two of them
    whose low bits are equal both count.
    """
    entry = _joined(table, _ENTRY)
    token, node, pos = entry[0], entry[1], entry[3]
    by = np.lexsort((node, pos, token))
    t, p, m = token[by], pos[by], node[by]
    if len(by):
        by = by[np.concatenate([[True], (t[1:] != t[:-1]) | (p[1:] != p[:-1]) | (m[1:] != m[:-1])])]
    _, length = _runs(token[by])
    dealt = entry[4][by] >= _DEALT  # its other entries may be in other buckets
    by = by[np.repeat(length > 1, length) | dealt]
    bucket = table.column("bucket")[0].as_py()
    cols = {k: pa.array([_packed(k, x[by])], pa.binary()) for k, x in zip(_ENTRY, entry, strict=True)}
    out = pa.table({"bucket": pa.array([bucket], pa.int32()), **cols})
    return out if len(by) else out.slice(0, 0)


def _near(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    return 100 * np.minimum(n, m).astype(np.int64) >= percent * np.maximum(n, m).astype(np.int64)


def _least(n, m, percent: int):
    """The overlap that makes sets of n and m similar."""
    return -(-percent * (n + m) // (100 + percent))


def _lead(size: int) -> int:
    """Leaders of a posting list: one, and one more for each eightfold of its length."""
    return (size.bit_length() - 1) // 3 + 1


def _leaders(percent: int):
    """Pairs of a list's members with its leaders; of a dealt list also the leader of each part, without a partner."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                token, node, n, pos, ask = _joined(pa.Table.from_batches([b.slice(i, 1)]), _ENTRY)
                first, length = _runs(token)
                begin, size = np.repeat(first, length), np.repeat(length, length)
                x, y = [], []
                for k in range(_lead(int(length.max(initial=1)))):  # entries lie in the order of their places
                    lead = np.minimum(begin + k, len(node) - 1)
                    keep = (size >= 8**k) & _near(n, n[lead], percent) & (node != node[lead])
                    x.append(node[keep])
                    y.append(node[lead[keep]])
                a, z = np.concatenate(x), np.concatenate(y)
                by = np.lexsort((a, z))
                a, z = a[by], z[by]
                new = np.concatenate([[True], (a[1:] != a[:-1]) | (z[1:] != z[:-1])]) if len(a) else np.zeros(0, bool)
                a, z = a[new], z[new]
                none = pa.nulls(len(a), pa.int64())
                yield pa.RecordBatch.from_arrays([_names(a), _names(z), none, none, none], ["a", "b", "token", "n", "pos"])
                top = first[ask[first] >= _DEALT] if len(first) else first
                if len(top):
                    yield pa.RecordBatch.from_arrays([_names(node[top]), pa.nulls(len(top), pa.binary()), *[pa.array(v[top].astype(np.int64)) for v in (token, n, pos)]], ["a", "b", "token", "n", "pos"])

    return run


def _admitted(n, pos, ask, m, place, want, percent: int):
    """Whether a shared shingle at these places can be among the first min(ask, want) of a similar pair."""
    both = np.minimum(ask, want)
    return _near(n, m, percent) & (both + np.minimum(n - pos, m - place) - 1 >= _least(n.astype(np.int64), m, percent)), both


def _compared(x: list[np.ndarray], y: list[np.ndarray], once, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of entries (node, n, pos, ask, comp) of x and y in different components that may be similar."""
    out = []
    step = max(1, 4_000_000 // max(1, len(y[0])))
    for k in range(0, len(x[0]), step):
        node, n, pos, ask, comp = (v[k : k + step, None] for v in x)
        ok, both = _admitted(n, pos, ask, y[1], y[2], y[3], percent)
        ok &= (comp != y[4]) & once(node, slice(k, k + step))
        p, q = np.nonzero(ok)
        out.append((x[0][k + p], y[0][q], both[p, q]))
    return tuple(np.concatenate(z) for z in zip(*out, strict=True)) if out else (x[0][:0], x[0][:0], np.zeros(0, np.int64))


def _counted(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.Table:
    """Distinct unordered pairs, how often they came and how many shared shingles they need."""
    a, b, w = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, t) for k, t in ((0, "S16"), (1, "S16"), (2, np.int64)))
    low, high = np.where(a < b, a, b), np.where(a < b, b, a)
    order = np.lexsort((high, low))
    low, high, w = low[order], high[order], w[order].astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], (low[1:] != low[:-1]) | (high[1:] != high[:-1])])) if len(low) else np.zeros(0, np.int64)
    times = np.diff(np.append(first, len(low))).astype(np.int64)
    return pa.table({"a": _names(low[first]), "b": _names(high[first]), "n": pa.array(times), "need": pa.array(w[first])})


_FOUND_DDL = "a binary, b binary, n bigint, need bigint"


def _entries_of(table: pa.Table, *more: str) -> list[np.ndarray]:
    return [_from_names(table.column(c)) if c in ("node", "component") else table.column(c).to_numpy() for c in ("token", "node", "n", "pos", "ask", "component", *more)]


def _across(percent: int):
    """Pairs of a bucket's entries (without lists' leaders) whose nodes are in different components and may
    still be similar. A pair that has a leader in any list is decided, so the others' counts are whole."""

    def run(table: pa.Table) -> pa.Table:
        entry = _entries_of(table)
        order = np.argsort(entry[0], kind="stable")
        token, node, n, pos, ask, comp = (x[order] for x in entry)
        first, length = _runs(token)
        mixed_list = np.zeros(len(first), bool)
        if len(first):  # lists of one component need nothing
            same = np.concatenate([[True], comp[1:] == comp[:-1]])
            same[first] = True
            mixed_list = ~np.logical_and.reduceat(same, first)
        keep = np.repeat(mixed_list, length)
        token, node, n, pos, ask, comp = (x[keep] for x in (token, node, n, pos, ask, comp))
        comp = np.unique(comp, return_inverse=True)[1].reshape(-1)
        first, length = _runs(token)
        found = []
        for f, m in zip(first.tolist(), length.tolist(), strict=True):
            every = [v[f : f + m] for v in (node, n, pos, ask, comp)]
            _, back, counts = np.unique(every[4], return_inverse=True, return_counts=True)
            main = back == np.argmax(counts)
            out = [v[~main] for v in every]  # everything outside the largest component against all
            found.append(_compared(out, every, lambda a, _, y=every[0], w=main: w | (a < y), percent))
            if sum(len(z[0]) for z in found) > FLUSH:
                found = [_merged(found)]
        return _counted(found)

    return run


def _merged(found):
    """Pairs of a bucket so far; a pair that comes again is kept twice, for its count."""
    return tuple(np.concatenate([f[k] for f in found]) for k in range(3))


def _tile(percent: int):
    """Pairs of a tile of a dealt list: entries outside the list's largest component (`out`) against a part of all."""

    def run(table: pa.Table) -> pa.Table:
        _, node, n, pos, ask, comp, side, rest = _entries_of(table, "side", "rest")
        _, comp = np.unique(comp, return_inverse=True)
        every = [node, n, pos, ask, comp.reshape(-1)]
        x, y = ([v[side == k] for v in every] for k in (1, 0))
        main = rest[side == 0] == 0
        return _counted([_compared(x, y, lambda a, _: main | (a < y[0]), percent)])

    return run


def _tiles(dealt: DataFrame, percent: int) -> DataFrame:
    """Pairs of dealt lists that aren't of one component yet. Each list is cut into parts of about TILE
    entries and its entries outside the largest component into chunks of TILE; each part meets each chunk."""
    by_component = dealt.groupBy("token", "component").agg(F.count("*").alias("c"))
    lists = by_component.groupBy("token").agg(F.max_by("component", "c").alias("main"), F.sum("c").alias("m"), F.max("c").alias("c")).where("m > c")
    parts, chunks = (F.ceil(c / F.lit(TILE)).cast("int") for c in (F.col("m"), F.col("m") - F.col("c")))
    lists = lists.select("token", "main", parts.alias("parts"), chunks.alias("chunks"))
    # a list is longer than SPLIT, so there are fewer of them than heavy cells
    known = dealt.join(F.broadcast(lists), "token").withColumn("rest", (F.col("component") != F.col("main")).cast("int"))
    part, chunk = F.pmod(F.xxhash64("node"), F.col("parts")), F.pmod(F.xxhash64("node", F.lit(1)), F.col("chunks"))
    cols = ["token", "node", "n", "pos", "ask", "component", "rest"]
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    every = known.select(*cols, F.lit(0).alias("side"), part.cast("int").alias("part"), upto("chunks").alias("chunk"))
    outside = known.where("rest = 1").select(*cols, F.lit(1).alias("side"), upto("parts").alias("part"), chunk.cast("int").alias("chunk"))
    return every.unionByName(outside).groupBy("token", "part", "chunk").applyInArrow(frugal_group(_tile(percent)), _FOUND_DDL)


def _multi_match(size: int, percent: int):
    """Pairs whose prefixes share min(l, l') shingles, each of which leaves room for enough more.

    Prefixes come as the low halves of their hashes: two that meet by chance can only let a pair pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = {c: b.column(c).to_pylist() for c in ("n_a", "ask_a", "prefix_a", "n_b", "ask_b", "prefix_b")}
            keep = []
            for n, ask, x, m, want, y in zip(*cols.values(), strict=True):
                x, y = np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4")
                (u, i), (v, j) = np.unique(x, return_index=True), np.unique(y, return_index=True)
                _, p, q = np.intersect1d(u, v, assume_unique=True, return_indices=True)
                ok, both = _admitted(np.int64(n), i[p], ask, np.int64(m), j[q], want, percent)
                twins = len(x) - len(u) + len(y) - len(v)
                keep.append(bool(np.count_nonzero(ok) + twins >= both))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _similar(size: int, percent: int):
    """Pairs whose whole sets are similar; texts come compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text_a"):
                codec = pa.Codec("zstd")
                left, right = (shingle_sets(pa.array([codec.decompress(t, n, asbytes=True) for t, n in zip(b.column(f"text_{x}").to_pylist(), b.column(f"bytes_{x}").to_pylist(), strict=True)], pa.binary()).cast(pa.string()), size) for x in "ab")
                keep = []
                for x, y in zip(left, right, strict=True):
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(100 * common >= percent * (len(x) + len(y) - common))
                yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _nodes(mine: DataFrame, id_col: str, wide: int, copies: str, several: str) -> DataFrame:
    """Each node by so many bytes of its name, with its least id, its rows, and whether several nodes have these bytes."""
    name = F.xxhash64("node")
    found = mine.where("node is not null").groupBy(F.substring("node", 1, wide).alias("node"))
    return materialised(found.agg(F.min(id_col).alias(id_col), F.count("*").alias(copies), (F.min(name) != F.max(name)).alias(several)), "nodes")


def _filter_bits(values: DataFrame, column: str, bits: int) -> np.ndarray:
    """A bitmap of 2^bits with the low bits of a column's hashes set; its size doesn't depend on the rows."""
    cell = F.col(column).bitwiseAND((1 << bits) - 1)
    rows = values.select(F.shiftright(cell, 16).alias("page"), cell.bitwiseAND(65535).cast("int").alias("bit")).groupBy("page").agg(F.collect_set("bit").alias("bits"))  # a page has 65536 bits
    found = np.zeros(1 << bits, bool)
    for r in rows.toLocalIterator():
        found[(r.page << 16) + np.array(r.bits, np.int64)] = True
    return np.packbits(found)


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """Every row with n_shingles, component_id, node (names its shingle set), component (names its group) and text_key.

    component_id: the least id among the rows that links reach, itself included. Rows without words
    (or text) have no node and are linked with nothing: their component is their own id. Rows of one
    id are taken by their texts; null ids take part but name a component only if it has no other id.
    Ties in the order of shingles go by hash. Shingles are compared by 64-bit hashes, of which two in
    one pair of documents meet with a probability of about (n / 2^32)^2.
    """
    spark = reachable(docs.sparkSession)
    mine = materialised(sets(docs, id_col, text_col, size), "shingle-sets")
    entries_about = (mine.agg(F.sum("n_shingles").alias("n")).first().n or 0) * (100 - percent) // 100
    buckets = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), entries_about // BUCKET_ENTRIES)
    text = docs.select(text_col)
    heavy = spark.sparkContext.broadcast(heavy_cells(text, size, buckets))
    copies, several = fresh([id_col], "copies", "several")
    wide, nodes = SHORT, _nodes(mine, id_col, SHORT, copies, several)
    if not nodes.where(several).isEmpty():
        wide, nodes = NAME, _nodes(mine, id_col, NAME, copies, several)
    nodes, mine = nodes.drop(several), mine.withColumn("node", F.substring("node", 1, wide))
    entries = text.mapInArrow(frugal(_prefixes(heavy, size, percent, buckets, wide)), _ENTRY_DDL)
    shared = materialised(entries.groupBy("bucket").applyInArrow(frugal_group(_shared), _ENTRY_DDL), "postings")

    def verified(pairs: DataFrame, counted: bool) -> DataFrame:
        """The pairs that are similar; `counted`: their shared prefix shingles have been counted.

        Each node's prefix is made and its text packed once. Of a pair, the node that is in more pairs is the hub:
        a copy of what it holds goes to each FOLLOWERS of its partners, so no hub is one task's."""
        ends = pairs.select(F.col("a").alias("node")).unionAll(pairs.select("b")).groupBy("node").agg(F.count("*").alias("pairs"))
        members = materialised(ends.join(nodes, "node").select("node", "pairs", F.xxhash64(id_col).alias("key")), "candidates")
        bits = min(26, max(17, int(np.ceil(np.log2(max(2, members.count()) * 16)))))
        page = spark.sparkContext.broadcast(_filter_bits(members, "key", bits))

        def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            order, seen, codec = _Order(heavy.value, percent), set(), pa.Codec("zstd")
            for whole in batches:
                cell = whole.column(0).to_numpy() & ((1 << bits) - 1)
                hit = (page.value[cell >> 3] >> (7 - (cell & 7)) & 1).astype(bool)
                for b in slices(whole.filter(pa.array(hit)), 1):
                    rows = []
                    text = _lower(texts(b, 1))
                    for key, s, t in zip(b.column(0).to_pylist(), shingle_sets(text, size), text.cast(pa.binary()).to_pylist(), strict=True):
                        if len(s) and (name := (key, _node(s)[:wide])) not in seen:
                            seen.add(name)
                            prefix, _, ask = order.prefix(s)
                            rows.append((*name, len(s), ask, prefix.astype("<u4").tobytes(), codec.compress(t, asbytes=True), len(t)))
                    cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
                    kinds = [pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int32()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["key", "node", "n", "ask", "prefix", "text", "bytes"])

        picked = docs.select(F.xxhash64(id_col).alias("key"), F.col(text_col).alias("text")).mapInArrow(frugal(pick), "key bigint, node binary, n int, ask int, prefix binary, text binary, bytes int")
        whole = materialised(picked, "candidate-sets")  # a task's copies of a node are one; another task's make a pair come twice
        a, b = (members.select(F.col("node").alias(x), F.col("pairs").alias(f"p{x}"), F.col("key").alias(f"k{x}")) for x in "ab")
        ends = 2 * pairs.count()
        batches = max(1, -(-ends // (2 * PAIRS)))
        both = join_spread(join_spread(pairs, a, "a", "pa", ends), b, "b", "pb", ends)
        turned = F.struct("pb", "b") < F.struct("pa", "a")
        hub, other = (F.when(t, F.struct(F.col("a").alias("node"), F.col("ka").alias("key"), F.col("pa").alias("pairs"))).otherwise(F.struct(F.col("b").alias("node"), F.col("kb").alias("key"), F.col("pb").alias("pairs"))) for t in (turned, ~turned))
        salt = F.pmod(F.xxhash64("a"), F.ceil(F.col("h.pairs") / F.lit(FOLLOWERS)))
        keyed = both.select(hub.alias("h"), other.alias("f")).select(F.col("f.node").alias("a"), F.col("f.key").alias("ka"), "h").select("a", "ka", F.col("h.node").alias("b"), F.col("h.key").alias("kb"), salt.alias("salt"))

        def meet(keyed: DataFrame, columns: list[str], check) -> DataFrame:
            held = whole.select("node", "key", *columns)
            f, h = (held.select(F.col("node").alias(x), F.col("key").alias(f"k{x}"), *[F.col(c).alias(f"{c}_{x}") for c in columns]) for x in "ab")
            near = F.broadcast if batches <= BATCHES else lambda x: x

            def met(part: DataFrame) -> DataFrame:
                hubs = near(part.select("b", "kb", "salt").distinct()).join(h, ["b", "kb"])
                return near(part).join(f, ["a", "ka"]).join(hubs, ["b", "kb", "salt"]).select("a", "b", *[f"{c}_{x}" for x in "ab" for c in columns])

            turns = batches if 1 < batches <= BATCHES else 1
            parts = [met(keyed.where(F.pmod(F.xxhash64("b", "salt"), F.lit(turns)) == k) if turns > 1 else keyed) for k in range(turns)]
            return reduce(DataFrame.unionByName, parts).mapInArrow(frugal(check(size, percent)), "a binary, b binary")

        keyed = materialised(keyed, "hub-pairs")
        if not counted:
            admitted = materialised(meet(keyed, ["n", "ask", "prefix"], _multi_match).distinct(), "admitted-pairs")
            keyed = materialised(keyed.join(admitted, ["a", "b"], "left_semi"), "hub-pairs")
        return meet(keyed, ["text", "bytes"], _similar)

    led = materialised(shared.mapInArrow(frugal(_leaders(percent)), "a binary, b binary, token bigint, n bigint, pos bigint"), "led")
    parts = led.where("b is null").select("a", "token", "n", "pos")
    # of dealt lists only, which are fewer than heavy cells
    tops = parts.groupBy("token").agg(F.min(F.struct("pos", F.col("a").alias("b"), F.col("n").alias("m"))).alias("t")).select("token", "t.b", "t.m")
    near = (F.col("a") != F.col("b")) & (100 * F.least("n", "m") >= percent * F.greatest("n", "m"))
    first = materialised(led.where("b is not null").select("a", "b").union(parts.join(F.broadcast(tops), "token").where(near).select("a", "b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "leader-pairs")
    links = materialised(verified(first, False), "links")
    labels = components(links)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Entries that may be in an undecided pair: a list's pairs with its leaders have been proposed."""
        for b in batches:
            for i in range(b.num_rows):
                entry = _joined(pa.Table.from_batches([b.slice(i, 1)]), _ENTRY)
                first, length = _runs(entry[0])
                leaders = np.array([_lead(m) for m in range(int(length.max(initial=0)) + 1)], np.int64)[length]
                rank = np.arange(len(entry[0])) - np.repeat(first, length)
                dealt = entry[4] >= _DEALT
                keep = np.flatnonzero(dealt | (rank >= np.repeat(leaders, length)) & np.repeat(length - leaders > 1, length))
                token, node, n, pos, ask = (x[keep] for x in entry)
                bucket = pa.array(np.full(len(token), b.column(0)[i].as_py(), np.int32))
                yield pa.RecordBatch.from_arrays([bucket, pa.array(token.astype(np.int64)), _names(node), pa.array(n), pa.array(pos), pa.array((ask % _DEALT).astype(np.int32)), pa.array(dealt[keep])], ["bucket", *_ENTRY, "dealt"])

    flat = shared.mapInArrow(frugal(unpack), "bucket int, token bigint, node binary, n int, pos int, ask int, dealt boolean")
    labelled = flat.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    rest = labelled.where("not dealt").groupBy("bucket").applyInArrow(frugal_group(_across(percent)), _FOUND_DDL)
    if not parts.isEmpty():
        rest = rest.unionByName(_tiles(labelled.where("dealt"), percent))
    rest = rest.groupBy("a", "b").agg(F.sum("n").alias("n"), F.min("need").alias("need")).where("n >= need").select("a", "b")
    second = materialised(rest.join(first, ["a", "b"], "left_anti"), "later-pairs")
    if not second.isEmpty():
        more = materialised(verified(second, True), "links")
        if not more.isEmpty():
            labels = components(links.union(more))

    reached = nodes.join(labels, "node").groupBy("component").agg(F.min(id_col).alias("least"), F.count("*").alias("members"))
    named = join_spread(labels, materialised(reached, "reached"), "component", "members", labels.count()).select("node", "component", "least")
    own = nodes.join(named, "node", "left").select("node", F.coalesce("least", id_col).alias("component_id"), F.coalesce("component", "node").alias("component"), copies)
    names = [id_col, "n_shingles", "component_id", "node", "component", "text_key"]
    alone = mine.where("node is null").select(id_col, "n_shingles", F.col(id_col).alias("component_id"), "node", F.col("node").alias("component"), "text_key")
    held = join_spread(mine, materialised(own, "own"), "node", copies, mine.count())
    return held.select(id_col, "n_shingles", F.coalesce("component_id", id_col).alias("component_id"), "node", "component", "text_key").unionByName(alone).select(*names)


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """The rows and columns of docs with one row of each group of near duplicates: that of the least id (of
    several texts with this id the one whose hash is least; of equal rows one). Rows without words all stay.
    A group without any id keeps one row."""
    found = join(docs, id_col, text_col, size, percent)
    chosen = found.where(F.col("node").isNotNull() & F.col(id_col).eqNullSafe(F.col("component_id"))).groupBy("component").agg(F.min(F.struct(F.col(id_col), "text_key")).alias("k"))
    names = fresh([*docs.columns, id_col], "_id", "_key", "_once", "_own", "_k", "_n")
    r_id, r_key, once, own, k, n = names
    keep = chosen.select(F.col(f"k.{id_col}").alias(r_id), F.col("k.text_key").alias(r_key), F.lit(True).alias(once)).union(
        found.where("node is null").select(F.col(id_col), "text_key", F.lit(False)).distinct()
    )
    # one key of both, never null: the window below needs no other shuffle than the join's
    rows = docs.withColumn(own, F.xxhash64(text_col)).withColumn(k, F.xxhash64(id_col, own))
    keep = keep.withColumn(k, F.xxhash64(r_id, r_key))
    rows = rows.join(keep, (rows[k] == keep[k]) & F.col(id_col).eqNullSafe(F.col(r_id)) & (F.col(own) == F.col(r_key))).drop(keep[k])
    first = F.row_number().over(Window.partitionBy(k, id_col, own).orderBy(own))
    return rows.withColumn(n, first).where(~F.col(once) | (F.col(n) == 1)).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4_ngram_jaccard_join."""
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id")
