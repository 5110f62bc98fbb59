"""The engine behind one object: what a service would call, without the service.

State lives in versioned tables below a root folder; every read gives a DataFrame.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.models import embedding, hashing_embedder
from millrace.operators import chunking, cleaning, evaluate, layout, memory, profile, retrieval
from millrace.plans.engine import Engine, Result
from millrace.sources import files
from millrace.sources.postings import Postings
from millrace.sources.scratch import written
from millrace.sources.store import Results, Table


def _within(name: str, value: float, low: float, high: float) -> None:
    if not low <= value <= high:
        raise ValueError(f"{name} must be {low:g} to {high:g}")


class Workspace:
    """Tables, documents, conversations and feedback below a root path."""

    def __init__(self, spark: SparkSession, root: str, embed: Callable = hashing_embedder, dimensions: int = 64):
        self.spark, self.root, self.engine = spark, root.rstrip("/"), Engine(spark)
        self.embed = embedding(lambda: embed(dimensions))
        self.model = embed(dimensions)
        self.chunks = self._table("chunks", "chunk_id")
        self.failed = self._table("failed", "file_id")
        self.words = Postings(spark, f"{self.root}/words", "chunk_id", "content", folders=16)
        self.messages, self.facts, self.feedback_rows = self._table("messages", "message_id"), self._table("facts", "fact_id"), self._table("feedback", "feedback_id")
        self.preference_rows, self.results = self._table("preferences", "preference_id"), Results(spark, f"{self.root}/results")

    def _table(self, name: str, key: str) -> Table:
        return Table(self.spark, f"{self.root}/{name}", key)

    # tables
    def register_csv(self, name: str, path: str) -> DataFrame:
        """Register a CSV file and describe it."""
        self.engine.register(name, files.read_csv(self.spark, path))
        return self.engine.describe(name)

    def query(self, question: str, table: str | None = None) -> Result:
        _within("question length", len(question), 1, 4000)
        return self.engine.query(table, question)

    def tables(self) -> list[str]:
        return sorted(self.engine.tables)

    # documents
    def index(self, path: str, owner: str = retrieval.GLOBAL_OWNER, strict: bool = False) -> DataFrame:
        """Read files, clean, chunk, embed and merge them; returns chunks by source.

        Of a file that was read, the owner's old chunks go, also if it has no text now; other owners' and other files'
        chunks stay, and are not written again. Files that can't be read (see `failures`) keep their old chunks; with
        `strict` one of them stops the indexing before anything is written.
        """
        read = written(files.documents(self.spark, path), "read")
        name = F.concat_ws("::", F.lit(owner), "path", F.when(F.col("page") >= 1000, F.col("page")))
        failed = read.where("kind = 'error'").select(name.alias("file_id"), F.lit(owner).alias("owner_id"), "path", F.col("text").alias("reason"), (F.col("page") < 1000).alias("whole"))
        if strict and (first := failed.limit(3).collect()):
            raise ValueError("; ".join(f"{r.path}: {r.reason}" for r in first))
        listed = files.listing(self.spark, path).select("path")
        if self.failed.current():
            self.failed.merge(failed, gone=self.failures(owner).join(listed, "path", "left_semi"))
        else:
            self.failed.write(failed)
        paths = listed.join(failed.where("whole").select("path"), "path", "left_anti").withColumnRenamed("path", "doc_id")
        read = read.where("kind <> 'error'")
        blocks = cleaning.clean(read.select(F.col("path").alias("doc_id"), "ord", "page", "text"), least=1, rejoin=False)
        whole = blocks.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "page", "text"))), lambda b: F.struct(b["page"].alias("page"), b["text"].alias("text"))).alias("blocks"))
        parts = chunking.fold(whole, chunking.contextual).withColumn("source", files.stem(F.col("doc_id")))
        done = chunking.finalise(parts, "doc_id").withColumns({"owner_id": F.lit(owner), "chunk_id": F.concat_ws("_", F.col("source"), F.lit("p"), F.col("page_start"), F.lit("n"), F.col("chunk_index")), "type": F.lit("text"), "embedding": self.embed(F.col("content"))})
        # files of one name in several folders have chunks of their own
        done = written(done.withColumn("chunk_id", F.concat_ws("::", F.lit(owner), F.substring(F.md5("doc_id"), 1, 12), "chunk_id")), "chunks")
        if self.chunks.current():
            old = written(self.chunks.read().where(F.col("owner_id") == owner).join(paths, "doc_id", "left_semi").select("chunk_id"), "old")
            self.chunks.merge(done, gone=old)
            self.words.upsert(done, removed=old)
        else:
            self.chunks.write(done)
            self.words.build(done)
        return self.documents()

    def failures(self, owner: str | None = None) -> DataFrame:
        """Files, and attachments of mails (whole is false), that the last indexing couldn't read: file_id, owner_id, path, reason, whole."""
        rows = self.failed.read()
        return rows if owner is None else rows.where(F.col("owner_id") == owner)

    def documents(self, user: str | None = None, admin: bool = False) -> DataFrame:
        rows = self.chunks.read().where(retrieval.visible_to(user, admin))
        return profile.pivot_counts(rows, "source", "type", ["text", "table", "image"]).orderBy(F.col("chunks").desc(), "source")

    def document(self, doc_id: str, limit: int = 1000) -> DataFrame:
        return self.chunks.of_document(doc_id, limit=limit)

    def delete(self, source: str, owner: str = retrieval.GLOBAL_OWNER) -> str:
        mine = (F.col("source") == source) & (F.col("owner_id") == owner)
        self.words.delete(self.chunks.read().where(mine).select("chunk_id"))
        return self.chunks.delete(mine)

    def search(self, question: str, limit: int = 10, prefetch: int = 40, min_score: float = 0.0, filters: dict | None = None, user: str | None = None, admin: bool = False, window: int = 0, decompose: Callable[[str], list[str]] | None = None, imagine: Callable[[str], str] | None = None) -> DataFrame:
        """Hybrid search: filter, then dense candidates and lexical ones from the stored index, fused, limited, and cut at min_score. A window
        adds the neighbours of each hit (is_primary tells them apart).

        decompose turns the question into sub-questions, whose hits are merged by their best score; imagine
        writes the passage whose vector is searched instead of the question's (words stay the question's)."""
        _within("limit", limit, 1, 100)
        _within("window", window, 0, 5)
        _within("min_score", min_score, 0, 1)
        _within("question length", len(question), 1, 4000)
        wanted: Column = retrieval.payload_filter(filters or {}) & retrieval.visible_to(user, admin)
        rows = self.chunks.read().where(wanted)
        k = max(prefetch, limit)
        parts = (decompose(question) if decompose else None) or [question]
        vectors = self.model([imagine(p) if imagine else p for p in parts])
        dense = retrieval.dense(rows, list(enumerate(vectors)), k, id_col="chunk_id").select("q_id", "chunk_id", "rk")
        asked = self.spark.createDataFrame(list(enumerate(parts)), "q_id bigint, text string")
        mine = None if not filters and (admin or user is None) else rows.select("chunk_id")
        lexical = self.words.search(asked, k, allowed=mine).select("q_id", "chunk_id", "rk")
        hits = retrieval.fuse([dense, lexical], "chunk_id", limit)
        if len(parts) > 1:
            best = hits.groupBy("chunk_id").agg(F.max("rrf").alias("rrf")).withColumn("q_id", F.lit(0).cast("bigint"))
            hits = retrieval.top(best, "q_id", [F.col("rrf").desc(), F.col("chunk_id")], limit)
        hits = hits.where(F.col("rrf") >= min_score)
        found = rows.join(hits.select("chunk_id", F.col("rrf").alias("score"), "rk"), "chunk_id").withColumn("is_primary", F.lit(True))
        if window:
            near = retrieval.neighbours(found, rows, window, "doc_id", "chunk_index", "chunk_id").select(F.col("neighbour").alias("chunk_id")).distinct().join(found.select("chunk_id"), "chunk_id", "left_anti")
            extra = rows.join(near, "chunk_id").withColumns({"score": F.lit(0.0), "rk": F.lit(None).cast("bigint"), "is_primary": F.lit(False)})
            found = found.unionByName(extra)
        return found.drop("embedding")

    def stats(self) -> DataFrame:
        return self.chunks.stats()

    def backup(self, name: str) -> list[str]:
        self.chunks.snapshot(name)
        return self.chunks.snapshots()

    # conversations
    def say(self, session_id: str, user_id: str, turns: list[tuple[int, str, str]]) -> str:
        """Add turns (turn, role, text) of a session; only its owner may."""
        if any(role not in memory.ROLES for _, role, _ in turns):
            raise ValueError(f"roles are {memory.ROLES}")
        if self.messages.current() and self.messages.read().where((F.col("session_id") == session_id) & (F.col("user_id") != user_id)).limit(1).count():
            raise PermissionError("the session is another user's")
        rows = self.spark.createDataFrame([(f"{session_id}:{n}", session_id, user_id, n, r, t) for n, r, t in turns], "message_id string, session_id string, user_id string, turn bigint, role string, text string")
        return self.messages.upsert(memory.counted(rows))

    def buffer(self, session_id: str, user_id: str, budget: int = memory.BUDGET) -> DataFrame:
        mine = self.messages.read().where((F.col("session_id") == session_id) & (F.col("user_id") == user_id))
        return memory.trim(mine, budget, key="session_id").where("kept").orderBy("turn")

    def sessions(self, user_id: str, limit: int = 200) -> DataFrame:
        rows = memory.roll_up(self.messages.read().where(F.col("user_id") == user_id), key="session_id")
        return layout.page_of(rows, [F.col("newest").desc(), F.col("session_id")], limit)

    def remember(self, user_id: str, facts: dict[str, str]) -> str:
        rows = self.spark.createDataFrame([(f"{user_id}:{k}", user_id, k, v) for k, v in facts.items()], "fact_id string, user_id string, key string, value string").withColumn("updated_at", F.current_timestamp())
        return self.facts.upsert(rows)

    def facts_of(self, user_id: str) -> DataFrame:
        return memory.facts_of(self.facts.read().where(F.col("user_id") == user_id))

    def prefer(self, user_id: str, text: str) -> str:
        """Remember a preference; the same text of a user again is the same row. Returns its id."""
        name = str(uuid.uuid5(uuid.NAMESPACE_URL, f"{user_id}::{text}"))
        row = self.spark.createDataFrame([(name, user_id, text)], "preference_id string, user_id string, text string")
        self.preference_rows.upsert(row.withColumns({"updated_at": F.current_timestamp(), "embedding": self.embed(F.col("text"))}))
        return name

    def preferences(self, user_id: str, question: str | None = None, limit: int = 100) -> DataFrame:
        """A user's preferences, newest first, or those nearest to a question."""
        mine = self.preference_rows.read().where(F.col("user_id") == user_id)
        if question is None:
            return layout.page_of(mine.drop("embedding"), [F.col("updated_at").desc(), F.col("preference_id")], limit)
        near = retrieval.dense(mine, [(0, self.model([question])[0])], limit, id_col="preference_id")
        return mine.drop("embedding").join(near.select("preference_id", "sim", "rk"), "preference_id").orderBy("rk")

    def forget(self, user_id: str, preference_id: str) -> str:
        return self.preference_rows.delete((F.col("user_id") == user_id) & (F.col("preference_id") == preference_id))

    def events(self, question: str, answer: Callable[[str, list], Iterator[str]], **search) -> Iterator[tuple[str, object]]:
        """An answer in stages, as a service would stream it: sources, token by token, confidence, done - or error."""
        try:
            hits = self.search(question, **search).orderBy(F.col("is_primary").desc(), "rk").select("chunk_id", "source", "content", "score").collect()  # `limit` rows and their neighbours
            yield "sources", [{"chunk_id": h.chunk_id, "source": h.source, "score": h.score} for h in hits]
            said = []
            for token in answer(question, hits):
                said.append(token)
                yield "token", token
            known = {w for h in hits for w in re.findall(r"\w+", h.content.lower())}
            words = set(re.findall(r"\w+", "".join(said).lower()))
            yield "eval", {"confidence": round(len(words & known) / len(words), 4) if words else 0.0}
            yield "done", "".join(said)
        except Exception as e:
            yield "error", str(e).splitlines()[0]

    # feedback
    def rate(self, feedback_id: str, rating: int, escalated: bool = False, confidence: float | None = None, intent: str = "general", verdict: str = "unknown") -> str:
        _within("rating", rating, -1, 1)
        return self.feedback_rows.upsert(self.spark.createDataFrame([(feedback_id, rating, escalated, confidence, intent, verdict)], "feedback_id string, rating int, escalated boolean, confidence double, intent string, verdict string"))

    def feedback(self) -> DataFrame:
        return evaluate.feedback(self.feedback_rows.read())
