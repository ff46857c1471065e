"""Queries over the overlapping and gapped segments of calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from talkweave.operators.intervals import periods_and_gaps
from talkweave.sources.tables import table


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Merged periods that join overlapping intervals, and the uncovered stretches of each call."""
    return (
        periods_and_gaps(table(spark, folder, "segments"))
        .where("kind = 'gap' OR overlaps")
        .select("conv_id", "kind", "label", F.col("period_start").cast("long"), F.col("period_end").cast("long"))
    )


def p2_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """Per call: periods and gaps, and the time in either; one pass over the result of the operator."""
    return (
        periods_and_gaps(table(spark, folder, "segments"))
        .groupBy("conv_id", "kind", "label")
        .agg(F.count("*").alias("n"), F.sum(F.col("period_end") - F.col("period_start")).cast("long").alias("units"))
    )


_ISLANDS = """
WITH valid AS (
  SELECT DISTINCT conv_id, upper(trim(label)) AS label, start AS s, "end" AS e
  FROM segments WHERE start IS NOT NULL AND "end" IS NOT NULL AND "end" > start),
lab AS (
  SELECT *, max(e) OVER (PARTITION BY conv_id, label ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m
  FROM valid WHERE label IS NOT NULL),
lab_n AS (
  SELECT *, sum(CASE WHEN m IS NULL OR s > m THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id, label ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS n
  FROM lab),
per AS (
  SELECT conv_id, 'merged' AS kind, label, min(s) AS period_start, max(e) AS period_end, bool_or(coalesce(s < m, false)) AS shared
  FROM lab_n GROUP BY conv_id, label, n),
cov AS (
  SELECT *, max(e) OVER (PARTITION BY conv_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m
  FROM valid),
gap AS (
  SELECT conv_id, 'gap' AS kind, '' AS label, m AS period_start, s AS period_end, true AS shared FROM cov WHERE s > m),
both_kinds AS (SELECT * FROM per UNION ALL SELECT * FROM gap)
"""

QUERIES = {"p2_found": p2_found, "p2_coverage": p2_coverage}
SQL = {
    "p2_found": _ISLANDS + "SELECT conv_id, kind, label, period_start, period_end FROM both_kinds WHERE shared",
    "p2_coverage": _ISLANDS
    + "SELECT conv_id, kind, label, count(*) AS n, CAST(sum(period_end - period_start) AS BIGINT) AS units FROM both_kinds GROUP BY conv_id, kind, label",
}
