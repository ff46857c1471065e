"""Queries: defects of prompt and response pairs of chats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from talkweave.llm.language import sample_field
from talkweave.llm.pairs import pair_defect, pairs_of
from talkweave.sources.tables import table


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Each defective response with its kind of defect."""
    field = sample_field(table(spark, folder, "documents"))
    pairs = pairs_of(table(spark, folder, "conversation_turn"))
    return pairs.select("id", "turn", pair_defect(F.col("prompt"), F.col("response"), field).alias("defect")).where("defect IS NOT NULL")


def p5_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Defective responses by kind."""
    return p5_found(spark, folder).groupBy("defect").agg(F.count("*").alias("n"))


QUERIES = {"p5_found": p5_found, "p5_counts": p5_counts}
SQL: dict[str, str] = {}
