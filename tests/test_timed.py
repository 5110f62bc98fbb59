"""State with event-time timers: replays out of order give what a sorted list gives."""

import random

from pyspark.sql import functions as F

from millrace.streaming import timed


def replay(spark, tmp_path, rows, schema, make, batches):
    """Batches one after the other on one checkpoint, then a row from far later."""
    out = []
    for i, part in enumerate(batches):
        spark.createDataFrame(part, schema).withColumn("ts", F.timestamp_micros("ts")).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        kind = spark.createDataFrame([], schema).withColumn("ts", F.timestamp_micros("ts")).schema
        make(spark.readStream.schema(kind).parquet(f"file://{tmp_path}/in")).writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    return [tuple(r) for r in spark.read.parquet(f"file://{tmp_path}/out").collect()]


HOUR = 3_600_000_000


def test_sessions_out_of_order(spark, tmp_path):
    r = random.Random(6)
    turns = sorted({(s, (1440 + t) * 60_000_000, u) for s in range(3) for t in r.sample(range(1500), 40) for u in [r.choice("aab")]}, key=lambda x: x[1])
    want, held = [], {}
    for s, us, u in sorted(turns, key=lambda x: (x[1], x[2])):
        for k in [k for k, h in held.items() if h[1] + 2 * HOUR < us]:
            want.append((k, held[k][0], held[k][1], "expired", held[k][2]))
            del held[k]
        owner, _, n = held.get(s, (u, us, 0))
        if u == owner:
            held[s] = (owner, us, n + 1)
            want.append((s, u, us, "accepted", n + 1))
        else:
            held.setdefault(s, (owner, us, n))
            want.append((s, u, us, "refused", None))
    want += [(k, h[0], h[1], "expired", h[2]) for k, h in held.items()]
    mixed = [(s, us, u) for _, (s, us, u) in sorted((us + r.randint(0, HOUR), (s, us, u)) for s, us, u in turns)]  # up to an hour late
    far = [(99, 900 * HOUR, "z")]
    got = replay(spark, tmp_path, turns, "session bigint, ts bigint, user string", lambda s: timed.owned_sessions(s, "session", "user", "ts", "61 minutes"), [mixed[:60], mixed[60:], far])
    key = lambda rows: sorted(rows, key=str)
    assert key(got) == key(want)
    assert len([x for x in got if x[3] == "expired"]) == len({(x[0], x[2]) for x in got if x[3] == "expired"})


def test_a_rewrite_is_found_for_its_time_only(spark, tmp_path):
    s = 1_000_000
    rows = [("a", "q", 0), ("a", "q", 300 * s), ("a", "q", 300 * s + 1), ("a", "q", 500 * s), ("b", "q", 10 * s), ("a", "r", 20 * s), ("a", "q", 900 * s), ("a", None, 5 * s), ("a", None, 6 * s)]
    rows = [(a, q, us + 24 * HOUR, i) for i, (a, q, us) in enumerate(rows)]
    first, second = [rows[i] for i in (3, 0, 4, 7)], [rows[i] for i in (2, 6, 1, 5, 8)]
    got = replay(spark, tmp_path, rows, "session string, question string, ts bigint, request_id bigint", lambda x: timed.rewrite_cache(x, "session", "question", "ts", "20 minutes"), [first, second, [("z", "z", 10**12, 99)]])
    assert sorted((r[2], r[4]) for r in got) == [(0, False), (1, True), (2, False), (3, True), (4, False), (5, False), (6, False), (7, False), (8, True)]


def test_keys_share_states_and_nulls_stay_apart(spark, tmp_path):
    """Two thousand keys, some null, with numbers that no double holds: as many states as slots, not as keys."""
    big = 2**60 + 1
    rows = [(None if k % 40 == 0 else big + k, float("nan") if k % 3 == 0 else None if k % 3 == 1 else 0.5, (100 + i) * HOUR, None if (k + i) % 5 == 0 else big + i) for k in range(2000) for i in range(2)]

    def step(held, row):
        return [[row["v"], (held or 0) + 1]], (held or 0) + 1, None

    make = lambda stream: timed.in_order(stream, ["a", "x"], "ts", "2 hours", step, None, "v bigint, n bigint")
    got = replay(spark, tmp_path, rows, "a bigint, x double, ts bigint, v bigint", make, [rows, [(7, 7.0, 900 * HOUR, 7)]])
    seen, want = {}, []
    for a, x, _, v in sorted(rows, key=lambda r: (r[2], r[3] is None, str(r[3]))):
        key = (a, str(x))
        seen[key] = seen.get(key, 0) + 1
        want.append((a, None if x != x else x, v, seen[key]))  # a key of NaN is one of its own, but comes out as null
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert 0 < spark.read.format("statestore").option("batchId", 0).load(f"file://{tmp_path}/state").count() <= 512
