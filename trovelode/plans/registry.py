"""All queries of the core, by name, with the SQL that checks them where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from trovelode.plans import indexing, search

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {**search.QUERIES, **indexing.QUERIES}
SQL: dict[str, str] = {**search.SQL, **indexing.SQL}
