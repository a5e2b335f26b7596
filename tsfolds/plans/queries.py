"""Registered queries: one per operator of the inventory, each with its
DuckDB oracle SQL (or none for operators that SQL cannot express).

Every query reads the driver tables through the fixture views, so its work
grows with the scale factor.  Floating columns are rounded to 6 decimals on
both sides (``+ 0.0`` folds -0.0) because summation order differs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tsfolds.functions import round_all
from tsfolds.plans import fixtures as fx

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        def run(spark, sf_dir, _fn=fn):
            return round_all(_fn(spark, sf_dir))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        REGISTRY[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return run

    return deco


def v(spark, sf_dir, name) -> DataFrame:
    return fx.view(spark, sf_dir, name)


# Import the query modules so that they register themselves.
def load() -> None:
    from tsfolds.plans import q_clean, q_core, q_features, q_folds, q_jobs, q_misc, q_portfolio  # noqa: F401
