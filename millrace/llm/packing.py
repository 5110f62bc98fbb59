"""Best-fit packing with Martello-Toth dominance reduction (operator 6).

Lengths are whole numbers up to the capacity, so an instance of any number of pieces is a histogram
of at most `capacity` counts. The plan - which combinations of lengths make a sequence, and how often -
is found on that histogram; pieces then take their places by their rank among pieces of equal length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.arrowio import frugal, materialised, reachable, slices, texts
from millrace.llm.tokens import encoder

#: A combination: its lengths with their number, in the order of their places, and how many sequences it makes.
Plan = list[tuple[list[tuple[int, int]], int]]


def reduce_by_dominance(count: list[int], capacity: int) -> Plan:
    """Fix the sets of at most two lengths that dominate every other set with their larger member.

    A feasible set dominates another if the other's pieces can be grouped so that each group fits
    where one of its own pieces lies; then some best packing has that set. For the largest piece j:
    {j, k} with j + k = capacity dominates; so does {j, k}, k the largest that fits, if no two pieces
    fit beside j, or if no three do and no two make more than k; {j} does if nothing fits. `count` is
    reduced in place.
    """
    fixed: Plan = []

    def fix(lengths: list[int], n: int) -> None:
        made: dict[int, int] = {}
        for x in lengths:
            made[x] = made.get(x, 0) + 1
            count[x] -= n
        fixed.append((list(made.items()), n))

    def smallest(j: int, n: int) -> list[int]:
        """The n smallest pieces without one j."""
        found: list[int] = []
        for x in range(1, capacity + 1):
            have = count[x] - (x == j)
            found += [x] * min(max(have, 0), n - len(found))
            if len(found) == n:
                break
        return found

    for j in range(capacity, 0, -1):
        while count[j]:
            room = capacity - j
            if room == 0:
                fix([j], count[j])
                continue
            if room == j and count[j] >= 2:
                fix([j, j], count[j] // 2)
                continue
            if room != j and count[room]:
                fix([j, room], min(count[j], count[room]))
                continue
            best = next((x for x in range(room, 0, -1) if count[x] - (x == j) > 0), 0)
            if not best:
                fix([j], count[j])
                continue
            low = smallest(j, 3)
            if len(low) < 2 or low[0] + low[1] > room or ((len(low) < 3 or sum(low) > room) and _best_pair(count, j, room) <= best):
                # so long as as many pieces as now are left, the same holds again
                fix([j, best], 1 if best == j or count[best] < 4 or count[j] < 4 else min(count[j], count[best]) - 3)
                continue
            break
    return fixed


def _best_pair(count: list[int], j: int, room: int) -> int:
    """The most that two pieces besides j make within room."""
    left = [x for x in range(1, room) for _ in range(min(2, count[x] - (x == j)))]
    a, b, most = 0, len(left) - 1, 0
    while a < b:
        if left[a] + left[b] <= room:
            most, a = max(most, left[a] + left[b]), a + 1
        else:
            b -= 1
    return most


def best_fit(count: list[int], capacity: int) -> Plan:
    """Best fit by decreasing length, many equal pieces at a time."""
    open_at: dict[int, list[tuple[tuple, int]]] = {}
    rooms: list[int] = []

    def put(room: int, chain: tuple, n: int) -> None:
        if room not in open_at:
            open_at[room] = []
            rooms.insert(bisect_left(rooms, room), room)
        open_at[room].append((chain, n))

    for x in range(capacity, 0, -1):
        left = count[x]
        while left:
            at = bisect_left(rooms, x)
            if at == len(rooms):
                each = min(capacity // x, left)
                n = left // each
                put(capacity - each * x, ((x, each), None), n)
                left -= n * each
                continue
            room = rooms[at]
            chain, n = open_at[room].pop()
            if not open_at[room]:
                del open_at[room], rooms[at]
            each = min(room // x, left)
            used = min(n, left // each)
            put(room - each * x, ((x, each), chain), used)
            if n > used:
                put(room, chain, n - used)
            left -= used * each
        count[x] = 0
    plan: Plan = []
    for groups in open_at.values():
        for chain, n in groups:
            lengths = []
            while chain:
                lengths.append(chain[0])
                chain = chain[1]
            plan.append((lengths[::-1], n))
    return plan


def plan_of(histogram: dict[int, int], capacity: int) -> Plan:
    count = [0] * (capacity + 1)
    for x, n in histogram.items():
        count[x] = n
    fixed = reduce_by_dominance(count, capacity)
    return fixed + best_fit(count, capacity)


def runs_of(plan: Plan) -> np.ndarray:
    """Rows (length, first rank, first sequence, pieces a sequence, place of the first), by length and rank."""
    rows, rank, sequence = [], {}, 0
    for lengths, n in plan:
        place = 0
        for x, each in lengths:
            rows.append((x, rank.get(x, 0), sequence, each, place))
            rank[x] = rank.get(x, 0) + n * each
            place += x * each
        sequence += n
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pieces_of(docs: DataFrame, path: str, capacity: int, end_id: int, id_col: str = "doc_id", text_col: str = "text", kind: str = "word", ids: bool = False) -> DataFrame:
    """id_col, piece, start, length, ids_crc32, spread (tells equal rows apart) and, on demand, the ids."""
    reachable(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, seen = encoder(path, kind), 0
        for whole in batches:
            for b in slices(whole, 1):
                flat, at = enc.encode(texts(b, 1))
                size = np.diff(at) + 1
                flat = np.insert(flat.astype("<u4"), at[1:], end_id)
                first = np.cumsum(size) - size
                n = -(-size // capacity)
                row = np.repeat(np.arange(len(size)), n)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                start = piece * capacity
                length = np.minimum(capacity, size[row] - start)
                view, x = memoryview(flat).cast("B"), first[row] + start
                cut = list(zip((4 * x).tolist(), (4 * (x + length)).tolist(), strict=True))
                cols = [b.column(0).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array([zlib.crc32(view[i:j]) for i, j in cut], pa.int64()), pa.array(seen + np.arange(len(row)))]
                if ids:
                    cols.append(pa.array([np.frombuffer(view[i:j], "<u4").astype(np.int32) for i, j in cut], pa.list_(pa.int32())))
                seen += len(row)
                yield pa.RecordBatch.from_arrays(cols, [id_col, "piece", "start", "length", "ids_crc32", "spread", "ids"][: len(cols)])

    schema = f"`{id_col}` {dict(docs.dtypes)[id_col]}, piece int, start bigint, length bigint, ids_crc32 bigint, spread bigint" + (", ids array<int>" if ids else "")
    return docs.select(id_col, text_col).mapInArrow(frugal(run), schema)


def place(pieces: DataFrame, capacity: int, id_col: str = "doc_id") -> DataFrame:
    """Add sequence_id and offset to a materialised table of pieces.

    The only things gathered are the histogram (at most `capacity` rows) and the plan made from it.
    A piece's rank among its length is the count of earlier hash buckets plus its place within its
    own bucket, so a length that a third of all pieces share is ranked by as many tasks as there are buckets.
    """
    spark = reachable(pieces.sparkSession)
    histogram = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    runs = spark.sparkContext.broadcast(runs_of(plan_of(histogram, capacity)))
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = pieces.withColumn("_bucket", F.pmod(F.xxhash64(id_col, "piece", "spread"), F.lit(buckets)).cast("int"))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy("length", "_bucket").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    ranked = (
        dealt.withColumn("_in", F.row_number().over(Window.partitionBy("length", "_bucket").orderBy(id_col, "piece", "spread")))
        .join(counts, ["length", "_bucket"])
        .withColumn("_rank", F.col("_before") + F.col("_in") - 1)
        .drop("_bucket", "_in", "_before", "spread")
    )
    names = ranked.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = runs.value
        keys = (table[:, 0] << 44) + table[:, 1]
        for b in batches:
            length, rank = (b.column(names.index(c)).to_numpy() for c in ("length", "_rank"))
            r = table[np.searchsorted(keys, (length << 44) + rank, side="right") - 1]
            q = rank - r[:, 1]
            cols = [b.column(i) for i, c in enumerate(names) if c != "_rank"]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(r[:, 2] + q // r[:, 3]), pa.array(r[:, 4] + q % r[:, 3] * length)], [*(c for c in names if c != "_rank"), "sequence_id", "offset"])

    schema = ", ".join(f"`{c}` {t}" for c, t in ranked.dtypes if c != "_rank") + ", sequence_id bigint, offset bigint"
    return ranked.mapInArrow(frugal(run), schema)


def pack(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", kind: str = "word", ids: bool = False) -> DataFrame:
    """Pack whole texts into sequences of at most `capacity` ids.

    Each document is its ids and then end_id; only longer ones are cut. Returns a row a piece:
    id_col, piece, start, length, ids_crc32, sequence_id, offset, and the ids on demand. Null text
    counts as empty (a piece of the end id alone); null and repeated ids are packed like any others;
    ties among pieces of one length go by id, piece and place in the input. No rows give no rows.
    """
    made = materialised(pieces_of(docs, path, capacity, end_id, id_col, text_col, kind, ids), "pieces")
    order = [id_col, "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] + ["ids"] * ids
    return place(made, capacity, id_col).select(*order)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6_best_fit_packing."""
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
