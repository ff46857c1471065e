"""Queries: visually identical text with different characters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from talkweave.llm.lookalike import consistent_form, look_alike_classes, look_alikes
from talkweave.sources.tables import table


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of documents that look the same but aren't the same code points."""
    return look_alikes(table(spark, folder, "documents"))


def p8_forms(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's consistent form, and whether it differs from the text."""
    return (
        table(spark, folder, "documents")
        .select("doc_id", "text", consistent_form(F.col("text")).alias("form"))
        .select("doc_id", "form", (F.col("form") != F.col("text")).alias("changed"))
    )


def p8_classes(spark: SparkSession, folder: str) -> DataFrame:
    """The classes of look-alike texts and their members."""
    return look_alike_classes(table(spark, folder, "documents"))


QUERIES = {"p8_found": p8_found, "p8_forms": p8_forms, "p8_classes": p8_classes}
SQL: dict[str, str] = {}
