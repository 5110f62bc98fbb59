"""User functions in SQL: scalars, aggregates and table functions, all vectorised or generators."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def scalar(spark: SparkSession, name: str, f: Callable[..., pd.Series], returns: str) -> None:
    """f takes and gives pandas series, a batch at a time."""
    spark.udf.register(name, F.pandas_udf(f, returns))


def aggregate(spark: SparkSession, name: str, f: Callable[[pd.Series], object], returns: str) -> None:
    """f takes one group's values as a series and gives one value. A group is held by one task: for groups
    without a bound compose built-in aggregates instead."""

    def run(v: pd.Series) -> float:
        return f(v)

    spark.udf.register(name, F.pandas_udf(run, returns, F.PandasUDFType.GROUPED_AGG))


def table(spark: SparkSession, name: str, handler: type, returns: str) -> None:
    """handler has eval(*arguments), a generator of tuples; called in FROM, also LATERAL."""
    spark.udtf.register(name, F.udtf(handler, returnType=returns))
