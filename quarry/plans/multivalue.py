"""Queries of problem 3: packed schedule fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.multivalue import split_packed
from ..sources.tables import table

FIELDS = {"schedule_raw": False, "schedule_summary": False, "schedule_entries_json": True}


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per meeting of each schedule field with two or more."""
    return split_packed(table(spark, sf_dir, "courses"), "row_id", FIELDS)


QUERIES = {"p3_found": p3_found}
SQL: dict[str, str] = {}
