"""How modules declare queries: a function of (spark, sf_dir), with the SQL that says the same where there is one."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Registry:
    def __init__(self):
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def add(self, sql: str | None = None):
        """Registers a function under its name."""

        def wrap(f):
            self.queries[f.__name__] = f
            if sql is not None:
                self.sql[f.__name__] = sql
            return f

        return wrap

    def relational(self, name: str, text: str) -> None:
        """A query that is the same SQL for Spark and for the oracle; tables stand in braces."""
        tables = sorted(set(re.findall(r"\{(\w+)\}", text)))

        def f(spark: SparkSession, sf_dir: str) -> DataFrame:
            return spark.sql(text, **{t: table(spark, sf_dir, t) for t in tables})

        f.__name__ = name
        self.queries[name] = f
        self.sql[name] = re.sub(r"\{(\w+)\}", r"\1", text)
