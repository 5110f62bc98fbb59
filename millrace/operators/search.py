"""Top-k searches that bring queries to where the rows are.

Queries come in batches of a bounded size, each broadcast to the tasks that scan the corpus; a task
keeps the best k of each query, and only those are shuffled. Neither corpus nor postings travel.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.sources.scratch import written

#: Bytes of queries that one batch sends to the tasks; scores that a task holds at once.
BATCH_BYTES, HELD_SCORES = 64 << 20, 4_000_000
#: Groups that queries are put into at most, the number of queries from which it is done, the share of queries that ask for
#: the terms by which it is done.
GROUPS, LEAST_GROUPED, TELLING = 6, 64, 0.06
#: Share of a group's queries from which a term may be a column of a matrix; it is one where pairs of queries and documents
#: that share it are more than a share of all pairs. A term's queries are held in rows of one of these lengths, or longer.
COMMON, SHARED = 0.01, 0.004
LENGTHS = np.array([1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64, 96, 128, 192, 256, 384, 512])
#: Words of documents that a task scores at a time, and documents.
CHUNK_WORDS, CHUNK_ROWS = 1 << 21, 8192


def top(rows: DataFrame, key: str, order: list, k: int, name: str = "rk") -> DataFrame:
    """The first k of each key, numbered."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(key).orderBy(*order)).cast("bigint")).where(F.col(name) <= k)


def batches_of(queries: DataFrame, bytes_of) -> list[DataFrame]:
    """queries (with q_id) dealt by hash of q_id into batches of about BATCH_BYTES; bytes_of is a column."""
    size = queries.agg(F.sum(bytes_of).alias("n")).first().n or 0
    turns = -(-size // BATCH_BYTES)
    return [queries.where(F.pmod(F.xxhash64("q_id"), F.lit(turns)) == t) if turns > 1 else queries for t in range(max(1, turns))]


def rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """Half away from zero, as SQL rounds."""
    scale = 10.0**digits
    return np.copysign(np.floor(np.abs(x) * scale + 0.5) / scale, x)


class _Best:
    """The best k rows of each of many queries so far: highest rounded score, then least id.

    Scores come as a table of some queries by some rows. A query's kth best score so far is a bound for what comes later, so
    that only the few scores that reach it are kept, and these are cut down to the best k whenever there are many. With
    `ties`, for ids that say nothing about the rows' order beyond their upper half's, rows as good as the kth are kept too,
    the first k of each upper half.
    """

    def __init__(self, names: np.ndarray, k: int, digits: int = 6, ties: bool = False):
        self.names, self.k, self.digits, self.ties = names, k, digits, ties
        self.least = np.full(len(names), -np.inf)
        self.held: list[tuple[np.ndarray, np.ndarray, pa.Array]] = []
        self.count, self.most = 0, 4 * k * len(names) + HELD_SCORES // 16

    def add(self, scores: np.ndarray, ids: pa.Array, which: np.ndarray | slice = slice(None)) -> None:
        """scores: a row for each of the queries `which`, a column for each of ids; -inf where a row takes no part."""
        at, column = self.near(scores, which)
        self.hold(np.arange(len(self.names))[which][at], scores[at, column], ids.take(pa.array(column)))

    def near(self, scores: np.ndarray, which: np.ndarray | slice = slice(None), off: float = 0.0, lowest: float = np.finfo(float).min) -> tuple[np.ndarray, np.ndarray]:
        """Places of the scores that may be among the best. Scores are right but for a share `off`; lower ones than `lowest` are none."""
        n = scores.shape[1]

        def reached(least: np.ndarray) -> np.ndarray:
            bound = np.maximum((least - 10.0**-self.digits) * (1 - off), lowest)
            return scores >= (np.nextafter(bound.astype(np.float32), np.float32(0)) if scores.dtype == np.float32 else bound)[:, None]

        least = self.least[which]
        found = reached(least)
        if n > self.k and np.count_nonzero(found) > 4 * self.k * len(scores):
            kth = np.partition(scores, n - self.k, axis=1)[:, n - self.k].astype(np.float64)
            least = np.fmax(least, rounded(kth * (1 - off), self.digits))
            self.least[which] = least
            found = reached(least)
        return np.nonzero(found)

    def hold(self, query: np.ndarray, score: np.ndarray, ids: pa.Array) -> None:
        """Keep these exact scores that reach their queries' bounds."""
        score = rounded(score, self.digits)
        kept = score >= self.least[query]
        self.held.append((query[kept], score[kept], ids.filter(pa.array(kept))))
        self.count += int(kept.sum())
        if self.count > self.most:
            self.cut()
            self.most = max(self.most, 2 * self.count)

    def cut(self) -> None:
        if not self.held:
            return
        query, score = (np.concatenate([h[i] for h in self.held]) for i in range(2))
        ids = pa.concat_arrays([h[2] for h in self.held])
        if pa.types.is_integer(ids.type) and not ids.null_count:
            order = np.lexsort((ids.to_numpy(), -score, query))
        else:
            order = pc.sort_indices(pa.table({"q": query, "s": score, "i": ids}), [("q", "ascending"), ("s", "descending"), ("i", "ascending")], null_placement="at_start").to_numpy()
        query, score = query[order], score[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        last, first = rank == self.k - 1, rank < self.k
        self.least[query[last]] = np.maximum(self.least[query[last]], score[last])
        if self.ties and len(query):
            upper = ids.to_numpy()[order] >> 32
            new = np.r_[True, (query[1:] != query[:-1]) | (score[1:] != score[:-1]) | (upper[1:] != upper[:-1])]
            first = (score >= self.least[query]) & (np.arange(len(query)) - np.flatnonzero(new)[np.cumsum(new) - 1] < self.k)
        self.held = [(query[first], score[first], ids.take(pa.array(order[first])))]
        self.count = int(first.sum())

    def rows(self, columns: list[str]) -> Iterator[pa.RecordBatch]:
        self.cut()
        for query, score, ids in self.held:
            yield pa.RecordBatch.from_arrays([pa.array(self.names[query], pa.int64()), ids, pa.array(score)], columns)


def own(names: np.ndarray, ids: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where an id is a query's name: places in names (ascending), places in ids."""
    at = pc.fill_null(ids, 0).to_numpy(zero_copy_only=False)
    lo = np.searchsorted(names, at, "left")
    many = np.where(pc.is_valid(ids).to_numpy(zero_copy_only=False), np.searchsorted(names, at, "right") - lo, 0)
    return ranges(lo, many), np.repeat(np.arange(len(at)), many)


def _scan(rows: DataFrame, id_col: str, score: str, k: int, step: Callable) -> DataFrame:
    """mapInArrow over rows (id first): step(batch, held) adds a batch's scores to the _Best that it keeps in held, a
    dictionary; a task yields their best."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for b in batches:
            step(b, held)
        for best in held.values():
            yield from best.rows(["q_id", id_col, score])

    return rows.mapInArrow(run, f"q_id bigint, `{id_col}` {dict(rows.dtypes)[id_col]}, `{score}` double")


def dense(vectors: DataFrame, queries: DataFrame | list[tuple[int, list[float]]], k: int, wanted=None, id_col: str = "vec_id", vector_col: str = "embedding", digits: int = 6, exclude_self: bool = False) -> DataFrame:
    """q_id, id, sim and rk of the k most similar unit vectors of each query (q_id, q); ties to the smaller id.

    The filter comes first, so that k matching rows are ranked. A vector is compared with queries of its own length
    only; vectors and queries that are null or hold a null or a number that isn't finite take no part.
    """
    spark = vectors.sparkSession
    if isinstance(queries, list):
        if not queries:
            raise ValueError("no query vectors")
        queries = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in queries], "q_id bigint, q array<double>")
    base = (vectors if wanted is None else vectors.where(wanted)).where(F.col(vector_col).isNotNull()).select(id_col, vector_col)
    asked = queries.where(F.col("q").isNotNull()).select(F.col("q_id").cast("bigint").alias("q_id"), F.col("q").cast("array<double>").alias("q"))

    def prepare(part: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        rows = part.toArrow()
        names = rows.column("q_id").to_numpy()
        order = np.argsort(names, kind="stable")
        lists = rows.column("q").combine_chunks().take(pa.array(order))
        return {n: (names[order][which], q) for n, which, q in _by_length(lists)}

    def step(b: pa.RecordBatch, held: dict, sent: dict) -> None:
        for n, which, v in _by_length(b.column(1)):
            names, q = sent.get(n, ((), None))
            if not len(names) or not len(which):
                continue
            best = held.setdefault(n, _Best(names, k, digits))
            for lo in range(0, len(v), wide := max(1, min(len(v), HELD_SCORES // 64))):
                ids, part = b.column(0).take(pa.array(which[lo : lo + wide])), v[lo : lo + wide].T
                mine, column = own(names, ids) if exclude_self else (np.zeros(0, int), np.zeros(0, int))
                for at in range(0, len(names), high := max(1, HELD_SCORES // 8 // part.shape[1])):
                    sims = q[at : at + high] @ part
                    here = (mine >= at) & (mine < at + high)
                    sims[mine[here] - at, column[here]] = -np.inf
                    best.add(sims, ids, slice(at, at + high))

    found = _in_turns(base, asked, 8 * F.size("q") + 16, prepare, step, id_col, "sim", k)
    return top(found, "q_id", [F.col("sim").desc(), F.col(id_col)], k)


def _by_length(lists: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of each length: the places of the vectors of that length whose components are all finite, and these vectors."""
    starts = lists.offsets.to_numpy().astype(np.int64)
    size = np.diff(starts)
    flat = lists.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # nulls are NaN
    starts = starts - starts[0]
    for n in np.unique(size[size > 0]).tolist():
        which = np.flatnonzero(size == n)
        v = flat.reshape(-1, n) if len(which) == len(size) else flat[starts[which][:, None] + np.arange(n)]
        fine = np.isfinite(v).all(axis=1)
        yield n, which[fine], v[fine]


def _in_turns(rows: DataFrame, asked: DataFrame, bytes_of, prepare: Callable, step: Callable, id_col: str, score: str, k: int) -> DataFrame:
    """Scan rows once for each batch of queries. Where there are several, a batch's best rows are written and its
    broadcast is given up before the next one starts, so the driver and the tasks hold one batch at any time."""
    parts, out = batches_of(asked, bytes_of), []
    for part in parts:
        sent = rows.sparkSession.sparkContext.broadcast(prepare(part))  # BATCH_BYTES, give or take the hash's spread
        found = _scan(rows, id_col, score, k, lambda b, held, sent=sent: step(b, held, sent.value))
        if len(parts) > 1:
            found = written(found, "hits")
            sent.destroy()
        out.append(found)
    return reduce(DataFrame.unionByName, out)


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each size, one after the other."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


def prepared(part: DataFrame) -> tuple:
    """A batch of weighed query terms (q_id, term, weight) for the tasks: queries in ascending order, terms, where each
    term's queries begin, and these queries' places and weights."""
    rows = part.select("q_id", "term", "weight").toArrow()
    names, q = np.unique(rows.column("q_id").to_numpy(), return_inverse=True)
    coded = rows.column("term").combine_chunks().dictionary_encode()
    place = coded.indices.to_numpy(zero_copy_only=False)
    order = np.argsort(place, kind="stable")
    edge = np.searchsorted(place[order], np.arange(len(coded.dictionary) + 1))
    return names, coded.dictionary, edge, q.reshape(-1)[order], rows.column("weight").to_numpy()[order]


class Asked:
    """A batch of weighed query terms as `prepared` gives it, ready to score documents.

    Queries that share common terms, of one language say, are a group; documents are put in the groups' order, and each group
    meets tiles of like documents. Scores are first added up in 32 bits: terms that many pairs of a tile share by a product of
    matrices, postings of the others one by one. Of the best of these a document's exact score is taken. Groups, tiles and columns
    decide on the cost alone.
    """

    def __init__(self, names: np.ndarray, terms: pa.Array, edge: np.ndarray, asking: np.ndarray, weight: np.ndarray):
        self.names, self.terms, self.edge, self.asking, self.weight = names, terms, edge, asking, weight
        self.many = np.diff(edge)
        label, self.centre = self._grouped()
        self.groups = [_Group(np.flatnonzero(label == g), self) for g in range(len(self.centre)) if (label == g).any()]

    def _grouped(self) -> tuple[np.ndarray, np.ndarray]:
        """Each query's group, and each group's weight of each term: k-means of unit vectors of common terms."""
        n = len(self.names)
        common = np.flatnonzero(self.many >= max(TELLING * n, 8))
        self.table = np.zeros((n, len(common)), np.float32)
        spot = ranges(self.edge[common], self.many[common])
        self.table[self.asking[spot], np.repeat(np.arange(len(common)), self.many[common])] = self.weight[spot]
        if n < LEAST_GROUPED or not len(common):
            return np.zeros(n, int), np.zeros((1, len(self.terms)), np.float32)
        x = self.table / np.maximum(np.linalg.norm(self.table, axis=1, keepdims=True), 1e-9)
        centre = x[:1]
        while len(centre) < GROUPS:  # the query that is least like those chosen
            centre = np.concatenate([centre, x[[np.argmin((x @ centre.T).max(1) + 2 * (x.max(1) == 0))]]])
        for _ in range(8):
            label = np.argmax(x @ centre.T, axis=1)
            sums = np.array([x[label == g].sum(0) for g in range(GROUPS)])
            centre = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
        centre = centre[np.bincount(label, minlength=GROUPS) > n / GROUPS / 2]  # small groups aren't worth a turn of their own
        out = np.zeros((len(centre), len(self.terms)), np.float32)
        out[:, common] = centre
        return np.argmax(x @ centre.T, axis=1), out

    def only(self, which: np.ndarray) -> Asked:
        """These queries alone."""
        return Asked(self.names[which], self.terms, *self.part(which))

    def part(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """edge, asking and weight of these queries alone."""
        slot = np.full(len(self.names), -1)
        slot[which] = np.arange(len(which))
        kept = slot[self.asking] >= 0
        return np.concatenate([[0], np.cumsum(kept)])[self.edge], slot[self.asking[kept]], self.weight[kept]

    def scores(self, doc: np.ndarray, term: np.ndarray, part: np.ndarray, docs: int) -> np.ndarray:
        """The exact scores of documents 0 to docs - 1 for each query, 0 without a common term, of postings: document, term, the
        document's own part."""
        out, edge = np.zeros((len(self.names), docs)), np.searchsorted(doc, np.arange(docs + 1))
        for g in self.groups:
            each = np.repeat(np.arange(len(g.which)), docs), np.tile(np.arange(docs), len(g.which))
            out[g.which] = g.exact(*each, edge, term, part).reshape(-1, docs)
        return out

    def add_to(self, best: _Best, doc: np.ndarray, term: np.ndarray, part: np.ndarray, ids: pa.Array, which: np.ndarray | None = None, without: tuple | None = None) -> None:
        """Add to `best` (whose places of these queries are `which`) the scores of documents `ids` of postings: document's place, term, the
        document's own part. Documents that share no term with a query have no score with it, nor have pairs `without` (places)."""
        docs = len(ids)
        near = [np.bincount(doc, part * c[term], docs) for c in self.centre] if len(self.centre) > 1 else [np.zeros(docs)]
        label = np.argmax(near, axis=0)
        order = np.argsort(label, kind="stable")
        place = np.empty(docs, int)
        place[order] = np.arange(docs)
        ids, doc = ids.take(pa.array(order)), place[doc]
        sort = np.argsort(doc, kind="stable")
        doc, term, part = doc[sort], term[sort], part[sort]
        edge = np.searchsorted(doc, np.arange(docs + 1))
        left_query, left_doc = (without[0], place[without[1]]) if without else (np.zeros(0, int), np.zeros(0, int))
        bounds = np.r_[np.searchsorted(label[order], np.arange(len(self.centre))), docs].tolist()
        for g in self.groups:
            mine = g.which if which is None else which[g.which]
            width, found = max(1, HELD_SCORES // 8 // len(mine)), []
            slot = np.minimum(np.searchsorted(g.which, left_query), len(g.which) - 1)
            own_pair = g.which[slot] == left_query
            for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
                for at in range(lo, hi, width):
                    upto = min(at + width, hi)
                    here = slice(*edge[[at, upto]])
                    scores, off = g.scores(doc[here] - at, term[here], part[here], upto - at)
                    gone = own_pair & (left_doc >= at) & (left_doc < upto)
                    scores[slot[gone], left_doc[gone] - at] = 0
                    query, column = best.near(scores, mine, off, np.finfo(np.float32).tiny)
                    found.append((query, at + column, scores[query, column], off))
            if not found:
                continue
            query, at, score = (np.concatenate([f[i] for f in found]) for i in range(3))
            order = np.lexsort((-score, query))
            query, at, score = query[order], at[order], score[order]
            first = np.searchsorted(query, query)
            kth = np.minimum(first + best.k - 1, len(query) - 1)  # of the same query, or there are fewer than k
            off = max(f[3] for f in found)
            stays = (np.arange(len(query)) - first < best.k) | (query[kth] != query) | (score >= score[kth] * (1 - 2 * off) - 2 * 10.0**-best.digits)
            query, at = query[stays], at[stays]
            best.hold(mine[query], g.exact(query, at, edge, term, part), ids.take(pa.array(at)))
        best.cut()  # so that the next documents meet the bounds of these


class _Group:
    """Queries of a batch that are scored together."""

    def __init__(self, which: np.ndarray, asked: Asked):
        self.which, n = which, len(which)
        self.edge, self.asking, self.weight = asked.part(which)
        self.many = np.diff(self.edge)
        self.common = np.flatnonzero(self.many >= max(COMMON * n, 8))
        self.column = np.full(len(self.many), -1)
        self.column[self.common] = np.arange(len(self.common))
        self.asked = self.many[self.common]
        # each query's terms
        order = np.argsort(self.asking, kind="stable")
        self.mine = np.repeat(np.arange(len(self.many)), self.many)[order], self.weight[order], np.searchsorted(self.asking[order], np.arange(n + 1))
        # terms' queries and weights, in rows of a few lengths that are filled up with weights of 0
        lengths = np.r_[LENGTHS, np.max(self.many, initial=0)]
        self.length, self.row, self.rows = np.searchsorted(lengths, self.many), np.zeros(len(self.many), int), {}
        for i in np.unique(self.length[self.many > 0]).tolist():
            terms = np.flatnonzero((self.length == i) & (self.many > 0))
            self.row[terms] = np.arange(len(terms))
            asking, weight = np.zeros((len(terms), lengths[i]), np.int64), np.zeros((len(terms), lengths[i]), np.float32)
            spot = np.repeat(np.arange(len(terms)), self.many[terms]), ranges(np.zeros(len(terms), int), self.many[terms])
            own_terms = ranges(self.edge[terms], self.many[terms])
            asking[spot], weight[spot] = self.asking[own_terms], self.weight[own_terms]
            self.rows[i] = asking, weight

    def scores(self, doc: np.ndarray, term: np.ndarray, part: np.ndarray, docs: int) -> tuple[np.ndarray, float]:
        """Each query's scores of documents 0 to docs - 1 in 32 bits, and the share by which they may be off."""
        n = len(self.which)
        some = self.many[term] > 0
        doc, term, part = doc[some], term[some], part[some].astype(np.float32)
        column = self.column[term]
        met = np.bincount(column[column >= 0], minlength=len(self.asked))
        wide = np.flatnonzero(met * self.asked > SHARED * n * docs)
        slot = np.full(len(self.asked) + 1, -1)  # the last is for terms that are no column
        slot[wide] = np.arange(len(wide))
        column = slot[column]
        here = column >= 0
        own_part, table = np.zeros((len(wide), docs), np.float32), np.zeros((len(wide), n), np.float32)
        own_part[column[here], doc[here]] = part[here]
        spot = ranges(self.edge[self.common[wide]], self.asked[wide])
        table[np.repeat(np.arange(len(wide)), self.asked[wide]), self.asking[spot]] = self.weight[spot]
        out = table.T @ own_part
        flat, doc, term, part = out.reshape(-1), doc[~here], term[~here], part[~here]
        length, row = self.length[term], self.row[term]
        order = np.argsort(length.astype(np.int8), kind="stable")
        ends = np.searchsorted(length[order], np.arange(len(LENGTHS) + 2))
        for i, (asking, weight) in self.rows.items():
            for at in range(ends[i], ends[i + 1], high := max(1, HELD_SCORES // 64 // asking.shape[1])):
                mine = order[at : min(at + high, ends[i + 1])]
                place = asking[row[mine]]
                place *= docs
                place += doc[mine][:, None]
                np.add.at(flat, place.reshape(-1), (weight[row[mine]] * part[mine][:, None]).reshape(-1))
        # a sum of so many numbers, each rounded three times
        most = np.max(np.diff(self.mine[2]), initial=0)
        return out, (most + 8) * 2.0**-23

    def exact(self, query: np.ndarray, doc: np.ndarray, edge: np.ndarray, term: np.ndarray, part: np.ndarray) -> np.ndarray:
        """The scores of pairs, which come sorted by query; edge has where each document's postings begin."""
        terms, weight, starts = self.mine
        out, held, before = np.zeros(len(query)), np.zeros(len(self.many)), slice(0)
        low, high, starts, last = edge[doc].tolist(), edge[doc + 1].tolist(), starts.tolist(), -1
        for i, q in enumerate(query.tolist()):
            if q != last:
                held[terms[before]] = 0
                before, last = slice(starts[q], starts[q + 1]), q
                held[terms[before]] = weight[before]
            mine = slice(low[i], high[i])
            out[i] = held[term[mine]] @ part[mine]
        return out


def lexical(words: DataFrame, asked: DataFrame, average: float, k: int, saturated: Callable, id_col: str, digits: int, exclude_self: bool = False) -> DataFrame:
    """q_id, id, score and rk. words: id, dl (a document's words in all), w (those that may be asked for); asked: q_id, term, weight (a query's own part of
    the score); saturated(tf, dl, average) the document's part.

    Words become places in the batch's sorted list of terms; each place has the queries that ask for it.
    """
    kinds = dict(words.dtypes)

    def step(b: pa.RecordBatch, held: dict, sent: tuple) -> None:
        if not len(sent[0]) or not b.num_rows:
            return
        if not held:
            ready[:] = [Asked(*sent)]
            held[0] = _Best(sent[0], k, digits)
        asked, best = ready[0], held[0]
        lists, size = b.column(2), b.column(1).to_numpy(zero_copy_only=False).astype(np.float64)
        starts = lists.offsets.to_numpy().astype(np.int64)
        starts = starts - starts[0]
        found = pc.index_in(lists.flatten(), value_set=asked.terms).fill_null(-1).to_numpy(zero_copy_only=False)
        at = 0
        while at < b.num_rows:
            upto = min(at + CHUNK_ROWS, b.num_rows, max(at + 1, int(np.searchsorted(starts, starts[at] + CHUNK_WORDS, side="right")) - 1))
            length = np.diff(starts[at : upto + 1])
            mine = found[starts[at] : starts[upto]].astype(np.int64)
            doc = np.repeat(np.arange(upto - at), length)[mine >= 0]
            pair, tf = np.unique(doc * len(asked.terms) + mine[mine >= 0], return_counts=True)
            doc, term = pair // len(asked.terms), pair % len(asked.terms)
            ids = b.column(0).slice(at, upto - at)
            asked.add_to(best, doc, term, saturated(tf.astype(np.float64), size[at + doc], average), ids, without=own(asked.names, ids) if exclude_self else None)
            at = upto

    ready: list[Asked] = []
    words = words.select(id_col, "dl", "w")
    if len(batches_of(asked, F.length("term") + 24)) > 1:
        words = written(words, "words")  # found once, not for each batch
    found = _in_turns(words, asked, F.length("term") + 24, prepared, step, id_col, "score", k)
    return top(found.select("q_id", F.col(id_col).cast(kinds[id_col]).alias(id_col), "score"), "q_id", [F.col("score").desc(), F.col(id_col)], k)
