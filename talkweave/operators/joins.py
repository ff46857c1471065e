"""Joins that need more than a key: partners, resumption, as-of lookups, shared timelines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from talkweave.operators.blocks import beside, block_of, past


def both_directions(rows: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """Rows whose reverse, with a and b changed places, is there too."""
    partner = rows.select(F.col(key).alias("_k"), F.col(b).alias("_a"), F.col(a).alias("_b")).distinct()
    return rows.join(partner, (F.col(key) == F.col("_k")) & (F.col(a) == F.col("_a")) & (F.col(b) == F.col("_b")), "left_semi")


def remaining(tasks: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Tasks without a result yet."""
    return tasks.join(done.select(*keys).distinct(), keys, "left_anti")


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, value: Column, name: str, size: float = 3600.0) -> DataFrame:
    """Adds to each left row the value of the last right row of its key at or before its time, by one sorted pass.

    Both sides have the key and the time column.  The pass runs within blocks of `size` (units of the
    time column, of a timestamp seconds); the last value of earlier blocks comes from one row a block,
    so a hot key is spread.  Rows without a time stand before all others.
    """
    columns = [c for c in left.columns if c not in (key, at)]
    r = right.select(key, at, F.lit(0).alias("_side"), value.alias("_v"), *[F.lit(None).cast(left.schema[c].dataType).alias(c) for c in columns])
    l_ = left.select(key, at, F.lit(1).alias("_side"), F.lit(None).cast(r.schema["_v"].dataType).alias("_v"), *columns)
    both = l_.unionByName(r).withColumn("_b", block_of(at, left.schema[at].dataType, size))
    # of rows at one time the right one counts
    made = {"_w": F.max_by("_v", F.when(F.col("_v").isNotNull(), F.struct(F.col(at).isNotNull(), at)))}
    held = beside(both, [key], "_b", made, {"_held": F.last("_w", ignorenulls=True).over(past([key], "_b"))})
    upto = W.partitionBy(key, "_b").orderBy(at, "_side").rowsBetween(W.unboundedPreceding, 0)
    return held.withColumn(name, F.coalesce(F.last("_v", ignorenulls=True).over(upto), F.col("_held"))).where("_side = 1").drop("_side", "_v", "_b", "_held")


def cached(tasks: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """Tasks with what a cache holds for their key, one row a key in the cache; null where it holds nothing."""
    return tasks.join(cache, key, "left")


def located(requests: DataFrame, entries: DataFrame, key: str, handle: str, text: str, pos: str) -> DataFrame:
    """Per request the last entry of its key with its handle, else the last with its text: adds `found`."""
    by = lambda c, n: entries.groupBy(key, c).agg(F.max(pos).alias(n))
    return (
        requests.join(by(handle, "_h"), [key, handle], "left").join(by(text, "_t"), [key, text], "left").withColumn("found", F.coalesce("_h", "_t")).drop("_h", "_t")
    )


def overlaid(chunks: DataFrame, key: str, at: str, samples: str, end: Column) -> DataFrame:
    """Chunks of samples added onto one track per key, cut at its end: key, sample, value."""
    each = chunks.select(key, (F.col(at)).alias("_at"), end.alias("_end"), F.posexplode(samples).alias("_p", "value"))
    return each.select(key, (F.col("_at") + F.col("_p")).alias("sample"), "value", "_end").where("sample < _end").groupBy(key, "sample").agg(F.sum("value").alias("value"))


def aligned(first: DataFrame, second: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Two tracks on one timeline, silence where one has no sample."""
    a, b = (x.select(*keys, F.col(value).alias(n)) for x, n in ((first, "left_value"), (second, "right_value")))
    return a.join(b, keys, "full").select(*keys, F.coalesce("left_value", F.lit(0.0)).alias("left_value"), F.coalesce("right_value", F.lit(0.0)).alias("right_value"))
