"""Registered queries: each name maps to a Spark builder ``(spark, sf_dir) -> DataFrame`` over the whole fixture
model and (where the operator is SQL-expressible) the DuckDB SQL that must give the same rows.

Registries live per operator family in ``urlsift.plans.q_*`` modules; this module merges them.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]

# reproducible clock for every as-of operator
AS_OF = "2024-02-01 00:00:00"


def all_queries() -> dict[str, Builder]:
    from urlsift.plans import q_metrics, q_queues, q_intake, q_html, q_tasks, q_review, q_streams  # noqa: F401

    out: dict[str, Builder] = {}
    for mod in (q_metrics, q_queues, q_intake, q_html, q_tasks, q_review, q_streams):
        out.update(mod.QUERIES)
    return out


def all_oracles() -> dict[str, str]:
    from urlsift.plans import q_metrics, q_queues, q_intake, q_html, q_tasks, q_review, q_streams  # noqa: F401

    out: dict[str, str] = {}
    for mod in (q_metrics, q_queues, q_intake, q_html, q_tasks, q_review, q_streams):
        out.update(mod.ORACLES)
    return out
