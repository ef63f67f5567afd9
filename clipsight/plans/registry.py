"""Named queries over the benchmark tables, each with its reference SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


class Tables:
    """Lazy access to the parquet tables of one directory, and to inputs derived from them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def derive(self, sql: str) -> DataFrame:
        """Run a SELECT whose table names are written ``{like_this}``."""
        used = {t: getattr(self, t) for t in TABLES if "{" + t + "}" in sql}
        return self.spark.sql(sql, **used)


@dataclass(frozen=True)
class Query:
    run: Callable[[Tables], DataFrame]
    sql: str | None
    #: Whether jobs run before the result is asked for: files are written, or lineage is cut.
    writes: bool = False


QUERIES: dict[str, Query] = {}


def register(name: str, run: Callable[[Tables], DataFrame], sql: str | None = None, *, writes: bool = False) -> None:
    if name in QUERIES:
        raise ValueError(f"query registered twice: {name}")
    QUERIES[name] = Query(run, sql, writes)


def with_inputs(body: str, **inputs: str) -> str:
    """``WITH name AS (...)`` around a body; input SELECTs are shared with the Spark side."""
    plain = {t: t for t in TABLES}
    ctes = ",\n".join(f"{name} AS ({sql.format(**plain)})" for name, sql in inputs.items())
    body = body.strip()
    joiner = ",\n" + body[len("WITH "):] if body.upper().startswith("WITH ") else "\n" + body
    return f"WITH {ctes}{joiner}"
