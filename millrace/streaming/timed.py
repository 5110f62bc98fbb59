"""Keyed state in event-time order: what a stream gives is what a sorted table would, however late its rows arrive.

A key's rows wait in the state until the watermark has passed them, so each is taken after all that are earlier. Timers, too, are
of event time: they end what is idle, once, and then what is held of the key is dropped.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from millrace.operators.memory import TTL_SECONDS

#: Microseconds of a second.
SECOND = 1_000_000
#: How long a rewritten question is remembered.
REWRITE_SECONDS = 300
#: Groups of keys that share a state.
SLOTS = 512
_WHOLE = ("tinyint", "smallint", "int", "bigint")
_NAN = float("nan")


def _key(values: Iterable) -> tuple:
    """A key by which its values are found; NaN is equal to itself."""
    return tuple(_NAN if isinstance(v, float) and v != v else v for v in values)


def in_order(rows: DataFrame, keys: list[str], ts: str, late: str, step: Callable, expire: Callable | None, schema: str, slots: int = SLOTS) -> DataFrame:
    """Fold each key's rows of a stream in event-time order.

    step(held, row) takes a row (a dict with `us`, its time in microseconds) and what is held of the key (None or what can be pickled), and
    gives (output rows, held, time in microseconds at which it expires or None). expire(held, key) gives the rows of what has expired.
    Rows without a time are left out; rows that come after the watermark (the latest time less `late`) has passed them are
    dropped by Spark, as are times up to 1970. Rows of the same time are taken in the order of their values.

    Keys are dealt over `slots` by hash. Those of a slot share a state, a timer and a call of Python, which for each key on its own
    would cost a thousand times what a row does. A slot that gets a row writes its whole state anew.
    """
    fields = [c for c in rows.columns if c not in keys and c != ts]
    names = [c.split()[0].strip("`") for c in schema.split(", ")]
    kinds, n = dict(rows.dtypes), len(keys)

    def run(_, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = {_key(k): one for k, *one in (pickle.loads(state.get[0]) if state.exists else [])}
        if not state.hasTimedOut:
            for g in batches:
                for us, absent, *row in zip(*(g[c].tolist() for c in ("event_us", "event_nulls", *keys, *fields)), strict=True):
                    row = [None if a == "1" else v for v, a in zip(row, absent, strict=True)] if "1" in absent else row
                    known.setdefault(_key(row[:n]), [[], None, None])[0].append((us, row[n:]))
        now, out, kept, timers = state.getCurrentWatermarkMs() * 1000, [], [], []
        for key, (pending, held, expiry) in known.items():
            ready = sorted((r for r in pending if r[0] < now), key=lambda r: (r[0], [(v is None, str(v)) for v in r[1]]))
            for us, row in [*ready, (now, None)]:
                if held is not None and expiry is not None and expiry < us:
                    out += [(*key, *r) for r in (expire(held, key) if expire else [])]
                    held, expiry = None, None
                if row is not None:
                    more, held, expiry = step(held, dict(zip(fields, row, strict=True)) | {"us": us})
                    out += [(*key, *r) for r in more]
            pending = [r for r in pending if r[0] >= now]
            if pending or held is not None:
                kept.append((key, pending, held, expiry))
                timers += [min(r[0] for r in pending)] if pending else []
                timers += [expiry] if held is not None and expiry is not None else []
        if kept:
            state.update((pickle.dumps(kept),))
            if timers:
                state.setTimeoutTimestamp(max(min(timers) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        columns = zip(*out, strict=True) if out else [[] for _ in (*keys, *names)]
        yield pd.DataFrame({c: pd.Series(v, dtype=object) for c, v in zip((*keys, *names), columns, strict=True)})

    timed = rows.where(F.col(ts).isNotNull()).withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    # pandas would turn whole numbers into fractions where one is null
    absent = F.concat_ws("", *[F.col(c).isNull().cast("int").cast("string") for c in (*keys, *fields)])
    filled = [F.coalesce(c, F.lit(0).cast(kinds[c])).alias(c) if kinds[c] in _WHOLE else F.col(c) for c in (*keys, *fields)]
    dealt = timed.select(ts, F.unix_micros(ts).alias("event_us"), absent.alias("event_nulls"), F.pmod(F.xxhash64(*keys), F.lit(slots)).alias("event_slot"), *filled)
    whole = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + f", {schema}"
    return dealt.groupBy("event_slot").applyInPandasWithState(run, whole, "packed binary", "append", GroupStateTimeout.EventTimeTimeout)


def rewrite_cache(requests: DataFrame, session: str, question: str, ts: str, late: str, ttl_seconds: int = REWRITE_SECONDS, id_col: str = "request_id") -> DataFrame:
    """Whether each request of a stream finds its question's rewrite in its session's cache: session, question, id, us, hit.

    A request that finds none makes one; it is found for ttl_seconds after that, whether it is used meanwhile or not.
    """

    def step(held: dict | None, row: dict):
        hit = held is not None
        held = held or {"set": row["us"]}
        return [[row[id_col], row["us"], hit]], held, held["set"] + ttl_seconds * SECOND

    kind = dict(requests.dtypes)[id_col]
    return in_order(requests.select(session, question, ts, id_col), [session, question], ts, late, step, None, f"`{id_col}` {kind}, us bigint, hit boolean")


def owned_sessions(turns: DataFrame, session: str, user: str, ts: str, late: str, ttl_seconds: int = TTL_SECONDS) -> DataFrame:
    """Turns of a stream by session: session, user, us, status and n.

    The first to write owns a session; the owner's turns are `accepted` and numbered, others' are `refused` and change nothing. A
    session that its owner has left for more than ttl_seconds gives one row `expired` with its number of turns, at its last turn's time,
    and is then anyone's.
    """

    def step(held: dict | None, row: dict):
        if held is None:
            held = {"user": row[user], "n": 0, "last": row["us"]}
        if row[user] != held["user"]:
            return [[row[user], row["us"], "refused", None]], held, held["last"] + ttl_seconds * SECOND
        held = {"user": row[user], "n": held["n"] + 1, "last": row["us"]}
        return [[row[user], row["us"], "accepted", held["n"]]], held, row["us"] + ttl_seconds * SECOND

    def expire(held: dict, key) -> list:
        return [[held["user"], held["last"], "expired", held["n"]]]

    kind = dict(turns.dtypes)[user]
    return in_order(turns.select(session, ts, user), [session], ts, late, step, expire, f"`{user}` {kind}, us bigint, status string, n bigint")
