"""Query registry: name, Spark job over the given tables, and its SQL check."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cinderlog.session import configure

_JOBS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(job):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return job(configure(spark), str(sf_dir).rstrip("/"))

        run.__name__, run.__doc__ = job.__name__, job.__doc__
        _JOBS[name] = run
        if sql is not None:
            _SQL[name] = sql
        return job

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_JOBS)


def oracles() -> dict[str, str]:
    return dict(_SQL)
