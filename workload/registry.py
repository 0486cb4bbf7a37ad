"""Query registry: one entry per operator (or small group of operators)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from workload.views import Tables, with_views


@dataclass(frozen=True)
class Query:
    name: str
    ids: str
    run: Callable[[Tables], DataFrame]
    oracle: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, ids: str, oracle: str | None = None):
    """

    `oracle` is DuckDB SQL in which `{view}` names a table or workload view.
    """

    def keep(fn: Callable[[Tables], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, ids, fn, with_views(oracle) if oracle else None)
        return fn

    return keep


def as_callable(q: Query) -> Callable[[SparkSession, str], DataFrame]:
    def call(spark: SparkSession, sf_dir: str) -> DataFrame:
        return q.run(Tables(spark, sf_dir))

    call.__name__ = q.name
    call.__doc__ = f"Survey items: {q.ids}"
    return call
