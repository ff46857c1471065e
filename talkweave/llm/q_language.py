"""Queries: languages of chat turns and of their segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from talkweave.llm.language import declared, language_segments, sample_field
from talkweave.llm.markup import clean_markup, first_delivery
from talkweave.sources.tables import table


def _turns(spark: SparkSession, folder: str) -> DataFrame:
    field = sample_field(table(spark, folder, "documents"))
    turns = first_delivery(table(spark, folder, "conversation_turn"), "value", "lang")
    return turns.select("id", "turn", declared(F.col("lang")).alias("declared"), language_segments(clean_markup(F.col("value"))["text"], field).alias("s"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Segments of the turns whose declared language is missing or wrong, and of turns in several languages."""
    least = F.expr("exists(s, x -> x.lang <> 'zh' AND x.n_words > 0)")
    words = F.expr("aggregate(s, 0, (n, x) -> n + x.n_words)")
    return (
        _turns(spark, folder)
        .where((F.size("s") > 0) & (words >= F.when(least, 4).otherwise(6)))
        .where((F.size("s") > 1) | F.col("declared").isNull() | (F.col("declared") != F.expr("s[0].lang")))
        .select("id", "turn", F.posexplode("s").alias("segment_no", "x"))
        .select("id", "turn", "segment_no", "x.lang")
    )


def p3_languages(spark: SparkSession, folder: str) -> DataFrame:
    """Every turn's segments with language and confidence, beside the declared language."""
    return (
        _turns(spark, folder)
        .select("id", "turn", "declared", F.posexplode_outer("s").alias("segment_no", "x"))
        .select("id", "turn", "declared", "segment_no", "x.lang", F.round("x.confidence", 3).alias("confidence"), "x.n_words")
    )


QUERIES = {"p3_found": p3_found, "p3_languages": p3_languages}
SQL: dict[str, str] = {}
