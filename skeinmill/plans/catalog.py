"""All queries outside the training-data subpackage, with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from skeinmill.operators import answers, assistant, business, chunkdedup, cleaning, ingest, neardup, recall, retrieval, sessions
from skeinmill.plans import documents_on_tables, on_tables
from skeinmill.sources import points
from skeinmill.streaming import ingest as stream_ingest
from skeinmill.streaming import feedback, limits, memory

FLAGSHIP = "recall_hybrid"
_MODULES = (retrieval, recall, cleaning, sessions, business, ingest, neardup, answers, chunkdedup, assistant, on_tables, documents_on_tables, points, limits, memory, feedback, stream_ingest)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for module in _MODULES for name, (f, _) in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in _MODULES for name, (_, sql) in module.QUERIES.items() if sql}
