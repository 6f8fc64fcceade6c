"""All operators by name, as queries over a folder of tables and as oracle SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from .plan import Plan, oracle, view

MODULES = ("operators.ledger", "functions.settings", "functions.geometry", "operators.raster", "operators.series", "operators.fits", "operators.points", "operators.trace", "operators.text", "sources.archive", "streaming.live")


def plans() -> dict[str, Plan]:
    out: dict[str, Plan] = {}
    for name in MODULES:
        out |= import_module(f"leafmill.{name}").PLANS
    return out


def _query(plan: Plan) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: plan.apply(**{t: view(spark, sf_dir, t, plan.dealt) for t in plan.inputs})


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _query(p) for name, p in plans().items()} | import_module("leafmill.streaming.live").QUERIES


def oracle_sql() -> dict[str, str]:
    return {name: oracle(p) for name, p in plans().items()}
