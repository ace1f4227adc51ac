"""All queries by name, and the DuckDB SQL that each must equal."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from graphquarry.sources.projection import Views, sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
FLAGSHIP = "search_hybrid_files"


def query(name: str, oracle: str | None = None, same: str | None = None):
    """Registers a function of Views; oracle: DuckDB SQL over the tables and the projected views; same: a query whose SQL it must equal."""

    def put(f):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        if oracle is not None:
            ORACLE[name] = sql(oracle)
        if same is not None:
            ORACLE[name] = ORACLE[same]
        return f

    return put


for _module in ("search", "filters", "graph", "etl", "access", "evaluation", "skeletons", "streams", "build", "languages", "indexes"):
    import_module(f"graphquarry.plans.{_module}")
