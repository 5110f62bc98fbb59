"""Conversation state over tables of turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import entities, self_contained, token_count

#: Tokens of a buffer, tokens from which it is summarised, seconds that a session lives, turns kept in any case.
BUDGET, SUMMARISE_AT, TTL_SECONDS, LEAST_KEPT = 1500, 1200, 7200, 2
ROLES = ("user", "assistant")


def valid_turns(turns: DataFrame, role: str = "role") -> DataFrame:
    return turns.where(F.col(role).isin(*ROLES))


def owned(turns: DataFrame, sessions: DataFrame, user: str) -> DataFrame:
    """Turns of sessions that belong to the user."""
    return turns.join(sessions.where(F.col("user_id") == user).select("session_id"), "session_id", "left_semi")


def trim(turns: DataFrame, budget: int = BUDGET, key: str = "conv_id", order: str = "turn", tokens: str = "token_count") -> DataFrame:
    """A column `kept`: the last two turns always; older ones while the newer ones' tokens lie below the budget."""
    w = Window.partitionBy(key).orderBy(F.col(order).desc())
    newer = F.coalesce(F.sum(tokens).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return turns.withColumn("kept", (F.row_number().over(w) <= LEAST_KEPT) | (newer < budget))


def last(turns: DataFrame, n: int, key: str = "conv_id", order: str = "turn") -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.col(order).desc())
    return turns.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def absorb(turns: DataFrame, n: int, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """Mark the oldest n turns as absorbed by a summary."""
    return turns.withColumn("summary_absorbed", F.row_number().over(Window.partitionBy(key).orderBy(order)) <= n)


def roll_up(turns: DataFrame, key: str = "conv_id", order: str = "turn", tokens: str = "token_count") -> DataFrame:
    return turns.groupBy(key).agg(F.count("*").alias("turn_count"), F.sum(tokens).cast("bigint").alias("total_tokens"), F.min(order).alias("oldest"), F.max(order).alias("newest"))


def to_summarise(turns: DataFrame, at: int = SUMMARISE_AT, key: str = "conv_id", tokens: str = "token_count", absorbed: Column | None = None) -> DataFrame:
    """Sessions whose unabsorbed turns reach the threshold, with their tokens."""
    open_turns = turns if absorbed is None else turns.where(~absorbed)
    return open_turns.groupBy(key).agg(F.sum(tokens).cast("bigint").alias("pending")).where(F.col("pending") >= at)


def sessions(events: DataFrame, gap_seconds: int = TTL_SECONDS, user: str = "user_id", ts: str = "ts", id_col: str = "event_id") -> DataFrame:
    """Each event with session_no: a pause longer than the gap begins a new session."""
    w = Window.partitionBy(user).orderBy(ts, id_col)
    seconds = F.unix_micros(F.col(ts).cast("timestamp"))
    new = F.coalesce((seconds - F.lag(seconds).over(w) > gap_seconds * 1_000_000).cast("bigint"), F.lit(1).cast("bigint"))
    return events.withColumn("_new", new).withColumn("session_no", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def expired(events: DataFrame, now: Column, ttl_seconds: int = TTL_SECONDS, user: str = "user_id", ts: str = "ts") -> DataFrame:
    """Users with their last event and whether it is too old at `now`, a literal or an aggregate."""
    old = F.unix_micros(F.max(ts).cast("timestamp")) < F.unix_micros(now) - ttl_seconds * 1_000_000
    return events.groupBy(user).agg(F.max(ts).alias("last_seen"), old.alias("expired"))


def rewrite_tier(turns: DataFrame, key: str = "conv_id", order: str = "turn", text: str = "text", role: str = "role", entity_turns: int = 6) -> DataFrame:
    """How each user turn is rewritten: skip (no history, or self-contained), entity (recent turns name
    an entity of four characters or more that the question hasn't), else llm. One window over the turns."""
    w = Window.partitionBy(key).orderBy(order)
    before = F.flatten(F.collect_list("_e").over(w.rowsBetween(-entity_turns, -1)))
    marked = turns.withColumn("_e", entities(F.col(text))).withColumn("_past", F.row_number().over(w) - 1).withColumn("_before", before)
    helps = F.exists("_before", lambda e: (F.length(e) >= 4) & ~F.contains(F.lower(F.col(text)), F.lower(e)))
    tier = F.when((F.col("_past") == 0) | self_contained(F.col(text)), "skip").when(helps, "entity").otherwise("llm")
    return marked.where(F.col(role) == "user").withColumn("tier", tier).drop("_e", "_past", "_before")


def with_entities(question: Column, found: Column, most: int = 6) -> Column:
    return F.when(F.size(found) > 0, F.concat(F.array_join(F.slice(found, 1, most), ", "), F.lit(": "), question)).otherwise(question)


def facts_of(facts: DataFrame) -> DataFrame:
    """user_id and a map of its facts; the last update of a key counts."""
    w = Window.partitionBy("user_id", "key").orderBy(F.col("updated_at").desc())
    one = facts.withColumn("_n", F.row_number().over(w)).where("_n = 1")
    return one.groupBy("user_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("facts"))


def context(requests: DataFrame, buffers: DataFrame, summaries: DataFrame, facts: DataFrame, preferences: DataFrame) -> DataFrame:
    """Everything that a request remembers, in one chain of left joins on session and user."""
    return requests.join(buffers, "session_id", "left").join(summaries, "session_id", "left").join(facts, "user_id", "left").join(preferences, "user_id", "left")


def counted(turns: DataFrame, text: str = "text") -> DataFrame:
    return turns.withColumn("token_count", token_count(F.col(text)).cast("bigint"))
