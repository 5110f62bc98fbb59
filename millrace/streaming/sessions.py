"""Streaming twins of the conversation rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.memory import TTL_SECONDS


def session_windows(events: DataFrame, gap_seconds: int = TTL_SECONDS, late: str = "1 hour", user: str = "user_id", ts: str = "ts") -> DataFrame:
    """user, start, end and number of events of each session; works on streams (append mode) and tables."""
    timed = events.withColumn(ts, F.col(ts).cast("timestamp"))
    timed = timed.withWatermark(ts, late) if events.isStreaming else timed
    w = F.session_window(ts, f"{gap_seconds} seconds")
    return timed.groupBy(user, w.alias("w")).agg(F.count("*").alias("n")).select(user, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def counts(events: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "10 minutes", ts: str = "ts", key: str = "event_type") -> DataFrame:
    """Events in tumbling or sliding windows, late ones dropped after the watermark. An addition of this engine."""
    timed = events.withColumn(ts, F.col(ts).cast("timestamp"))
    timed = timed.withWatermark(ts, late) if events.isStreaming else timed
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    return timed.groupBy(w.alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


def buffers(turns: DataFrame, budget: int, least: int = 2) -> DataFrame:
    """A stream of turns (conv_id, turn, token_count) as the buffer of each conversation after each batch:
    conv_id, turns kept, tokens. State is one small list a key and ends an hour after its last turn."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key, batches, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        held = list(zip(*[list(x) for x in state.get], strict=True)) if state.exists else []
        for g in batches:
            held += list(zip(g["turn"].tolist(), g["token_count"].tolist(), strict=True))
        held.sort(reverse=True)
        kept, newer = [], 0
        for i, (turn, n) in enumerate(held):
            if i >= least and newer >= budget:
                break
            kept.append((turn, n))
            newer += n
        state.update(([t for t, _ in kept], [n for _, n in kept]))
        state.setTimeoutDuration(3_600_000)
        yield pd.DataFrame({"conv_id": [key[0]], "kept": [len(kept)], "tokens": [sum(n for _, n in kept)]})

    return turns.groupBy("conv_id").applyInPandasWithState(step, "conv_id bigint, kept bigint, tokens bigint", "turns array<bigint>, sizes array<bigint>", "update", GroupStateTimeout.ProcessingTimeTimeout)
