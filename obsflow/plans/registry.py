"""All registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from obsflow.plans import basic, control, incident, records, stores

# Importing a module registers its queries.
MODULES = (basic, control, incident, records, stores)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = dict(basic.QUERIES)
ORACLES: dict[str, str] = dict(basic.ORACLES)
