"""All registered queries but those for training text: name, function of (spark, sf_dir), and SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_ALL: dict[str, tuple[Query, str | None]] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        if name in _ALL:
            raise ValueError(f"{name} is registered twice")
        _ALL[name] = (f, sql)
        return f

    return keep


def _load() -> None:
    from . import capture_queries, cohort_queries, event_queries, feature_queries, model_queries, report_queries, review_queries, roof_queries, source_queries, spatial_queries, surface_queries  # noqa: F401


def queries() -> dict[str, Query]:
    _load()
    return {k: f for k, (f, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return {k: s for k, (_, s) in _ALL.items() if s}
