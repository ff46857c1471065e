"""Windows over entities that may hold a third of all rows: blocks of an entity, and one row a block for what crosses them.

An entity (a call, a stream, a user) is cut into blocks along its order.  Windows run within blocks;
what a row must know of other blocks comes from a summary of one row a block, over which windows run
per entity, and which meets the rows by (entity, block).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T


def past(keys: list[str], block: str):
    """All earlier blocks of an entity; F.last over it is the nearest one."""
    return W.partitionBy(*keys).orderBy(block).rowsBetween(W.unboundedPreceding, -1)


def future(keys: list[str], block: str):
    """All later blocks, read backwards, so that the frame only grows; F.last over it is the nearest one."""
    return W.partitionBy(*keys).orderBy(F.desc(block)).rowsBetween(W.unboundedPreceding, -1)


def latest(value: Column, order: Column) -> Column:
    """Aggregate: the value that is not null and last in order."""
    return F.max_by(value, F.when(value.isNotNull(), order))


def earliest(value: Column, order: Column) -> Column:
    """Aggregate: the value that is not null and first in order."""
    return F.min_by(value, F.when(value.isNotNull(), order))


def matched(rows: DataFrame, other: DataFrame, keys: list[str], nulls: bool = False) -> DataFrame:
    """`rows` with the columns of `other`, joined by keys; rows without a match keep nulls.

    Keys that are null match nothing, or each other if `nulls`; that costs a shuffle of rows that
    were dealt out by the keys already.
    """
    same = reduce(and_, (F.col(f"_l.{k}").eqNullSafe(F.col(f"_r.{k}")) if nulls else F.col(f"_l.{k}") == F.col(f"_r.{k}") for k in keys))
    more = [F.col(f"_r.{c}").alias(c) for c in other.columns if c not in keys]
    return rows.alias("_l").join(other.alias("_r"), same, "left").select("_l.*", *more)


def beside(rows: DataFrame, keys: list[str], block: str, made: dict[str, Column], seen: dict[str, Column]) -> DataFrame:
    """Adds the columns `seen`, windows over one row a block with the aggregates `made`.

    The rows are dealt out by (entity, block) first; the same shuffle feeds the summary and the join.
    Rows of no entity or block see nothing of others.
    """
    dealt = rows.repartition(*keys, block)
    per = dealt.groupBy(*keys, block).agg(*[c.alias(n) for n, c in made.items()]).select(*keys, block, *[c.alias(n) for n, c in seen.items()])
    return matched(dealt, per, [*keys, block])


def numbered(rows: DataFrame, keys: list[str], block: str, order: list[str], name: str) -> DataFrame:
    """Adds the place of each row, from 1, in the order of (block, order) of its entity."""
    n = F.coalesce(F.sum("_n").over(past(keys, block)), F.lit(0))
    inside = F.row_number().over(W.partitionBy(*keys, block).orderBy(*order))
    return beside(rows, keys, block, {"_n": F.count("*")}, {"_before": n}).withColumn(name, (F.col("_before") + inside).cast("long")).drop("_before")


def block_of(at: str, kind: T.DataType, size: float) -> Column:
    """The block of a number or of a time: `size` of its units, for times seconds."""
    timed = isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType))
    x = F.unix_micros(F.col(at).cast("timestamp")) / 1e6 if timed else F.col(at)
    return F.floor(x / size).cast("long")


def runs(rows: DataFrame, keys: list[str], at: str, value: str, size: float, parts: Callable[[], dict[str, Column]], whole: Callable[[], dict[str, Column]]) -> DataFrame:
    """Longest runs of rows of an entity with equal `value`, in the order of (at, seq).

    `parts` are aggregates of the rows of a run within a block, `whole` those of such pieces, which
    have `head`, the (at, seq) of their first row.  Only pieces at a block's edge, that the next
    block may continue, meet in one window an entity.  Result: keys, value, head, block and `whole`.
    """
    block = [*keys, "block"]
    by = W.partitionBy(*block).orderBy(at, "seq")
    placed = rows.withColumn("block", block_of(at, rows.schema[at].dataType, size))
    turned = F.lag("seq").over(by).isNull() | ~F.col(value).eqNullSafe(F.lag(value).over(by))
    pieces = (
        placed.withColumn("piece", F.sum(turned.cast("int")).over(by.rowsBetween(W.unboundedPreceding, 0)))
        .groupBy(*block, "piece")
        .agg(F.first(value).alias(value), F.min(F.struct(at, "seq")).alias("head"), *[c.alias(n) for n, c in parts().items()])
    )
    inside = W.partitionBy(*block).orderBy("piece")
    edge = (F.col("piece") == 1) | F.lead("piece").over(inside).isNull()
    marked = pieces.withColumn("edge", edge).withColumn("own", F.when(~F.col("edge"), F.col("block")))
    group = [*keys, "edge", "own"]
    call = W.partitionBy(*group).orderBy("block", "piece")
    new = F.lag("block").over(call).isNull() | (F.lag("block").over(call) == F.col("block")) | ~F.col(value).eqNullSafe(F.lag(value).over(call))
    return (
        marked.withColumn("run", F.sum(new.cast("int")).over(call.rowsBetween(W.unboundedPreceding, 0)))
        .groupBy(*group, "run")
        .agg(F.first(value).alias(value), F.min("head").alias("head"), F.min("block").alias("block"), *[c.alias(n) for n, c in whole().items()])
        .drop("edge", "own", "run")
    )
