"""Questions and read-only SQL over registered tables."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.profile import describe, summaries

#: Kinds of logical plans that change something or run commands. Any node of these names is refused.
_COMMANDS = re.compile(r"Command|Create|Drop|Insert|Append|Overwrite|Delete|Update|Merge|Alter|Truncate|SetCatalog|Cache|Refresh|AddJar|Exec", re.I)


class NotReadOnly(ValueError):
    """The statement isn't a single query."""


@dataclass
class Result:
    """What a question gives: rows or an error, never an exception."""

    success: bool
    result: DataFrame | None = None
    sql: str = ""
    error: str | None = None


class Planner(Protocol):
    """Turns a question about a table into SQL with the placeholder {table}."""

    def __call__(self, question: str, columns: list[tuple[str, str]]) -> str: ...


def template_planner(question: str, columns: list[tuple[str, str]]) -> str:
    """Offline default: count, sum, average, least or greatest of a named column, by another one if asked."""
    words = re.findall(r"\w+", question.lower())
    named = [c for c, _ in columns if c.lower() in words or c.lower().replace("_", " ") in question.lower()]
    verbs = {"average": "avg", "mean": "avg", "avg": "avg", "sum": "sum", "total": "sum", "max": "max", "highest": "max", "greatest": "max", "min": "min", "lowest": "min", "least": "min"}
    verb = next((verbs[w] for w in words if w in verbs), None)
    by = next((c for c in named if re.search(rf"\b(by|per|each)\s+{re.escape(c.lower())}\b", question.lower())), None)
    of = next((c for c in named if c != by), None)
    what = f"{verb}(`{of}`) AS value" if verb and of else "count(*) AS value"
    return f"SELECT `{by}`, {what} FROM {{table}} GROUP BY `{by}` ORDER BY `{by}`" if by else f"SELECT {what} FROM {{table}}"


def read_only(spark: SparkSession, sql: str) -> None:
    """Raise NotReadOnly unless sql parses to one query. The parsed plan is walked; nothing is run."""
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except Exception as e:
        raise NotReadOnly(f"it doesn't parse: {str(e).splitlines()[0]}") from e
    todo = [plan]
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if _COMMANDS.search(name):
            raise NotReadOnly(f"{name} isn't a query")
        kids = node.children()
        todo += [kids.apply(i) for i in range(kids.size())]


class Engine:
    """A catalog of named tables and what can be asked of them."""

    def __init__(self, spark: SparkSession, planner: Planner = template_planner, router: Callable[[str, dict[str, list[str]]], str | None] | None = None):
        self.spark, self.planner, self.router, self.tables = spark, planner, router or lexical_router, {}

    def register(self, name: str, df: DataFrame) -> None:
        self.tables[name] = df

    def describe(self, name: str) -> DataFrame:
        return describe(self.tables[name])

    def profile(self, name: str) -> DataFrame:
        return summaries(self.tables[name])

    def sql(self, statement: str, name: str | None = None) -> DataFrame:
        """A query; {table} stands for the named table, other tables go by their names."""
        bound = {n: df for n, df in self.tables.items() if re.search(rf"\{{{n}\}}", statement)}
        plain = re.sub(r"\{(\w+)\}", r"\1", statement)
        read_only(self.spark, plain)
        used = [n for n in self.tables if re.search(rf"\b{re.escape(n)}\b", plain)]
        for n in used:
            self.tables[n].createOrReplaceTempView(n)
        try:
            return self.spark.sql(statement, **bound | ({"table": self.tables[name]} if name and "{table}" in statement else {}))
        finally:
            for n in used:
                self.spark.catalog.dropTempView(n)

    def query(self, table: str | None, question: str) -> Result:
        """Answer a question or a SELECT about a table; without one, the router finds it."""
        name = table or self.router(question, {n: df.columns for n, df in self.tables.items()})
        if name not in self.tables:
            return Result(False, error=f"no table {name!r}")
        text = question if re.match(r"(?is)\s*(select|with)\b", question) else self.planner(question, self.tables[name].dtypes)
        try:
            return Result(True, self.sql(text, name), text)
        except Exception as e:
            return Result(False, sql=text, error=str(e).splitlines()[0])


def lexical_router(question: str, tables: dict[str, list[str]]) -> str | None:
    """The table whose name and columns share the most words with the question; none without a shared word."""
    words = set(re.findall(r"[a-z0-9]+", question.lower()))
    score = {n: sum(bool(words & set(re.findall(r"[a-z0-9]+", c.lower()))) for c in [n, *cols]) for n, cols in tables.items()}
    best = max(sorted(score), key=score.get, default=None)
    return best if best is not None and score[best] else None


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n"))
