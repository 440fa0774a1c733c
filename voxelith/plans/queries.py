"""Queries over the derived views, each with the SQL that it must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from voxelith.plans.views import Views, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: SQL by brute force, too slow for large tables; tests hold the queries against it on the smallest.
SLOW: dict[str, str] = {}


def query(sql: str | None, *views: str, slow: bool = False):
    """Register a function of Views under its own name, with its SQL over the named views; slow: for small tables only."""

    def wrap(f: Callable[[Views], DataFrame]):
        name = f.__name__.strip("_")
        QUERIES[name] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        if sql is not None:
            (SLOW if slow else ORACLES)[name] = (with_views(*views) + sql) if views else sql
        return f

    return wrap


def _register() -> None:
    from voxelith.plans import cloud_queries, geometry_queries, job_queries, store_queries, volume_queries, voxel_queries, world_queries  # noqa: F401


_register()
