"""Registered queries: a DataFrame plan and, where SQL can say it, the SQL it must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brokerlake.plans.bindings import with_clause
from brokerlake.plans.tables import Tables
from brokerlake.scale import work_folder

Plan = Callable[[Tables], DataFrame]
PLANS: dict[str, Plan] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None, roles: tuple[str, ...] = ()) -> Callable:
    """Register a plan. ``oracle`` may begin with further CTEs, each led by a comma."""

    def add(plan: Plan) -> Plan:
        PLANS[name] = plan
        if oracle is not None:
            text = oracle.strip()
            if roles:
                ORACLES[name] = with_clause(*roles) + "\n" + text
            else:
                ORACLES[name] = "WITH " + text[1:].strip() if text.startswith(",") else text
        return plan

    return add


def runner(plan: Plan) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return plan(Tables(spark, folder))

    return run


def scratch(spark: SparkSession) -> str:
    """A new folder every executor can reach."""
    return work_folder(spark)


def joined(column) -> object:
    """An array as one comma-separated text."""
    return F.array_join(column, ",")
