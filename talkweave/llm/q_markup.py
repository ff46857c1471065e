"""Queries: markup residue in chat turns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from talkweave.llm.markup import clean_markup, first_delivery
from talkweave.sources.tables import table


def _converted(spark: SparkSession, folder: str) -> DataFrame:
    turns = first_delivery(table(spark, folder, "conversation_turn"), "value")
    return turns.select("id", "turn", clean_markup(F.col("value")).alias("m"))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each turn and each kind of element that its markup expresses."""
    return _converted(spark, folder).select("id", "turn", F.explode("m.elements").alias("element"))


def p1_clean(spark: SparkSession, folder: str) -> DataFrame:
    """Every turn's clean text and the kinds of element kept in it."""
    return _converted(spark, folder).select("id", "turn", "m.text", F.array_join("m.elements", ",").alias("elements"))


QUERIES = {"p1_found": p1_found, "p1_clean": p1_clean}
SQL: dict[str, str] = {}
