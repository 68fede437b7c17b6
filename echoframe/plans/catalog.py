"""Registry of queries: a Spark plan and, where SQL can say the same, its oracle."""

from __future__ import annotations

import textwrap
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from echoframe.session import configure

Plan = Callable[[SparkSession, str], DataFrame]

PLANS: dict[str, Plan] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None) -> Callable[[Plan], Plan]:
    """Register a plan under ``name``, with the SQL that must give the same rows."""

    def register(plan: Plan) -> Plan:
        if name in PLANS:
            raise ValueError(f"query {name} is registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return plan(configure(spark), sf_dir)

        run.__name__, run.__doc__ = name, plan.__doc__
        PLANS[name] = run
        if sql is not None:
            ORACLES[name] = textwrap.dedent(sql).strip()
        return plan

    return register


def with_ctes(*ctes: str, select: str) -> str:
    """``WITH`` query from shared common table expressions."""
    return "WITH " + ",\n".join(textwrap.dedent(c).strip() for c in ctes) + "\n" + textwrap.dedent(select).strip()
