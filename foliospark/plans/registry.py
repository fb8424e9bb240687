"""The registered queries: name, Spark job and, where there is one, the SQL that must agree."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from foliospark.plans.rendered import Reader, Tables, for_duckdb

Job = Callable[[Tables], DataFrame]
_JOBS: dict[str, Job] = {}
_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Job], Job]:
    def add(job: Job) -> Job:
        if name in _JOBS:
            raise ValueError(f"query {name} is registered twice")
        _JOBS[name] = job
        if sql is not None:
            _SQL[name] = for_duckdb(sql)
        return job

    return add


def _load() -> None:
    from foliospark.plans import (  # noqa: F401
        check_extraction,
        check_features,
        check_model,
        check_results,
        check_sources,
        check_text,
    )


def queries(read: Reader | None = None) -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """``read`` opens a table by name and path in place of the parquet reader."""
    _load()
    return {
        name: (lambda spark, folder, job=job: job(Tables(spark, folder, read)))
        for name, job in _JOBS.items()
    }


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
