"""All registered queries: a Spark plan and, where it can be said in SQL, an independent statement of the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Plan = Callable[[SparkSession, str], DataFrame]
PLANS: dict[str, Plan] = {}
STATEMENTS: dict[str, str] = {}


def query(name: str, statement: str | None = None):
    """Register a plan under a name, with its SQL."""

    def register(plan: Plan) -> Plan:
        PLANS[name] = plan
        if statement is not None:
            STATEMENTS[name] = statement
        return plan

    return register


def load() -> tuple[dict[str, Plan], dict[str, str]]:
    from catalog import analysis, datasets, records, similarity, views  # noqa: F401

    return PLANS, STATEMENTS
