"""Names the queries and their SQL oracles; each plan module registers its own."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

MODULES: tuple[str, ...] = ("retrieval_vectors", "work_items", "text_and_ir", "evaluation", "graphs_and_streams", "record_queries", "agent_work", "work_lists")


def _modules():
    return [importlib.import_module(f"marlstone.plans.{m}") for m in MODULES]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in _modules() for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for m in _modules() for k, q in m.ORACLES.items()}
