"""Continuous periods and gaps of interval sets, without a task per entity.

Starts and ends of an entity's intervals are ranked independently in order of time.  A boundary
lies after the end of rank r when the start of rank r + 1 comes later; the end of rank r and the
start of rank r + 1 then enclose a gap, and the boundaries on either side of a stretch give a
period.  Ranks are made of a count within a block of time and the counts of the blocks before it,
so that an entity that holds a third of all rows is spread over as many tasks as it has blocks;
only one summary row a block and the periods cut by a block's edge meet in one window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

#: Units of time in a block.  Segments come in 0.1 ms, so this is ten minutes.
BLOCK = 6_000_000

_ENTITY = ["kind", "entity", "label"]


def _boundary_points(intervals: DataFrame, block: int) -> DataFrame:
    """Each valid interval once, as a start and an end point of its label and of its entity."""
    valid = (
        intervals.where("start IS NOT NULL AND end IS NOT NULL AND end > start")
        .select("entity", "label", "start", "end")
        .distinct()
    )
    member = F.explode(
        F.array(
            F.struct(F.lit("gap").alias("kind"), F.lit("").alias("label")),
            F.struct(F.lit("merged").alias("kind"), F.col("label")),
        )
    )
    point = F.explode(
        F.array(
            F.struct(F.col("start").alias("t"), F.lit(0).alias("is_end")),
            F.struct(F.col("end").alias("t"), F.lit(1).alias("is_end")),
        )
    )
    return (
        valid.select("entity", "start", "end", member.alias("m"))
        .where("m.label IS NOT NULL")
        .select(F.col("m.kind").alias("kind"), "entity", F.col("m.label").alias("label"), point.alias("p"))
        .select(*_ENTITY, "p.t", "p.is_end", F.floor(F.col("p.t") / block).cast("long").alias("block"))
    )


def _ranked(points: DataFrame) -> DataFrame:
    """Points with the ranks of starts and ends reached, `n_start` and `n_end`, over the whole entity."""
    keys = [*_ENTITY, "block"]
    before = W.partitionBy(*_ENTITY).orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    carry = (
        points.groupBy(*keys)
        .agg(F.sum(1 - F.col("is_end")).alias("s"), F.sum("is_end").alias("e"))
        .select(
            *keys,
            F.coalesce(F.sum("s").over(before), F.lit(0)).alias("s0"),
            F.coalesce(F.sum("e").over(before), F.lit(0)).alias("e0"),
        )
    )
    joined = points.join(carry, keys)
    block = W.partitionBy(*keys)
    rows = block.orderBy("t", "is_end").rowsBetween(W.unboundedPreceding, 0)
    earlier = block.orderBy("t").rangeBetween(W.unboundedPreceding, -1)
    return joined.select(
        *keys,
        "t",
        "is_end",
        (F.col("s0") + F.sum(1 - F.col("is_end")).over(rows)).alias("n_start"),
        (F.col("e0") + F.sum("is_end").over(rows)).alias("n_end"),
        (F.col("s0") + F.coalesce(F.sum(1 - F.col("is_end")).over(earlier), F.lit(0))).alias("n_start_earlier"),
    ).select(
        "*",
        ((F.col("is_end") == 0) & (F.col("n_start") == F.col("n_end") + 1)).alias("opens"),
        ((F.col("is_end") == 1) & (F.col("n_start") == F.col("n_end"))).alias("closes"),
        # the end of rank r lies after the start of rank r + 1: two intervals share more than a point
        ((F.col("is_end") == 1) & (F.col("n_start_earlier") > F.col("n_end"))).alias("overlaps"),
    )


def _gaps(ranked: DataFrame) -> DataFrame:
    """The end of rank r paired with the start of rank r + 1, where both are boundaries."""
    return (
        ranked.where("kind = 'gap' AND (opens OR closes)")
        .select("entity", F.when(F.col("opens"), F.col("n_start") - 1).otherwise(F.col("n_end")).alias("r"), "t", "opens")
        .groupBy("entity", "r")
        .agg(F.max(F.when(~F.col("opens"), F.col("t"))).alias("period_start"), F.max(F.when(F.col("opens"), F.col("t"))).alias("period_end"))
        .where("period_start IS NOT NULL AND period_end IS NOT NULL")
        .select("entity", F.lit("gap").alias("kind"), F.lit("").alias("label"), "period_start", "period_end", F.lit(False).alias("overlaps"))
    )


def _periods(ranked: DataFrame) -> DataFrame:
    """Boundaries paired into periods: within the block, or across blocks for those a block's edge cuts."""
    rows = W.partitionBy(*_ENTITY, "block").orderBy("t", "is_end").rowsBetween(W.unboundedPreceding, 0)
    pieces = (
        ranked.where("kind = 'merged'")
        .withColumn("piece", F.sum(F.col("opens").cast("int")).over(rows))
        .groupBy(*_ENTITY, "block", "piece")
        .agg(
            F.max(F.when(F.col("opens"), F.col("t"))).alias("period_start"),
            F.max(F.when(F.col("closes"), F.col("t"))).alias("period_end"),
            F.max("overlaps").alias("overlaps"),
        )
        .withColumn("cut", F.expr("period_start IS NULL OR period_end IS NULL"))
    )
    # cut pieces of an entity stand in one group, all others in a group of their block
    group = ["entity", "label", "cut", "own"]
    order = W.partitionBy(*group).orderBy("block", "piece").rowsBetween(W.unboundedPreceding, 0)
    return (
        pieces.withColumn("own", F.when(~F.col("cut"), F.col("block")))
        .withColumn("n", F.sum(F.col("period_start").isNotNull().cast("int")).over(order))
        .groupBy(*group, "n")
        .agg(F.max("period_start").alias("period_start"), F.max("period_end").alias("period_end"), F.max("overlaps").alias("overlaps"))
        .select("entity", F.lit("merged").alias("kind"), "label", "period_start", "period_end", "overlaps")
    )


def periods_and_gaps(
    df: DataFrame,
    entity: str = "conv_id",
    start: str = "start",
    end: str = "end",
    label: str = "label",
    block: int = BLOCK,
) -> DataFrame:
    """Continuous periods per entity and label, and the gaps of each entity.

    Result: entity, kind ('merged' or 'gap'), label ('' for gaps), period_start, period_end and
    overlaps (whether two different intervals of the period share more than a point).  Labels are
    compared trimmed and in upper case.  Rows with a null bound or end <= start are no intervals;
    equal intervals count once, however often delivered; a null label belongs to no period but
    covers time; touching intervals continue each other.  A null entity is an entity of its own.
    Ties and other columns, whatever their names, make no difference; an empty table gives none.
    """
    # no entity gets a name of its own, so that keys are never null and rows meet by plain equality
    intervals = df.select(
        F.coalesce(F.concat(F.lit("="), F.col(entity).cast("string")), F.lit("")).alias("entity"),
        F.col(start).cast("long").alias("start"),
        F.col(end).cast("long").alias("end"),
        F.upper(F.trim(F.col(label))).alias("label"),
    )
    ranked = _ranked(_boundary_points(intervals, block))
    named = F.when(F.col("entity") != "", F.expr("substring(entity, 2)")).cast(df.schema[entity].dataType)
    return _periods(ranked).unionByName(_gaps(ranked)).withColumn("entity", named).withColumnRenamed("entity", entity)
