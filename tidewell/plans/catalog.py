"""Registry of the engine's queries and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its own name, with its SQL counterpart."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql_text(text: str) -> str:
    """A string literal that both engines read the same way in VALUES lists."""
    return "'" + text.replace("'", "''") + "'"


from tidewell.plans import q_documents, q_html, q_links, q_schedule, q_urls, q_varied  # noqa: E402, F401
