"""Seeded order, splits, resampling and caps, without a single task for all rows.

The order is that of md5(key, seed).  A row's rank is the number of rows in the buckets of hash
before its own, known from one count per bucket, plus its rank within the bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def hash_key(key: Column, seed: int) -> Column:
    return F.md5(F.concat(key.cast("string"), F.lit(f"|{seed}")))


def hash_ranked(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """Adds `rank`, from 0, in the seeded order of the unique column `key`, and `total`.

    There are 4,096 buckets, by the first three digits of the hash, so their counts stay small.
    """
    hashed = df.withColumn("_h", hash_key(F.col(key), seed)).withColumn("_b", F.substring("_h", 1, 3))
    counts = hashed.groupBy("_b").agg(F.count("*").alias("_n"))
    whole = W.partitionBy(F.lit(0))
    offsets = counts.select(
        "_b",
        F.coalesce(F.sum("_n").over(whole.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_o"),
        F.sum("_n").over(whole).alias("total"),
    )
    inside = F.row_number().over(W.partitionBy("_b").orderBy("_h", key)) - 1
    return hashed.join(F.broadcast(offsets), "_b").withColumn("rank", F.col("_o") + inside).drop("_h", "_b", "_o")


def split_names(ranked: DataFrame, test: float = 0.2, val: float = 0.1) -> DataFrame:
    """Adds `split`: train first, then val, then test, of int(n * share) rows each."""
    n_test, n_val = F.floor(F.col("total") * test), F.floor(F.col("total") * val)
    n_train = F.col("total") - n_test - n_val
    return ranked.withColumn("split", F.when(F.col("rank") < n_train, "train").when(F.col("rank") < n_train + n_val, "val").otherwise("test"))


def split_capped(ranked: DataFrame, train: float = 0.9, most: int = 1500) -> DataFrame:
    """Adds `split`: train for int(n * train) rows, `most` at most, the rest val."""
    n_train = F.least(F.floor(F.col("total") * train), F.lit(most))
    return ranked.withColumn("split", F.when(F.col("rank") < n_train, "train").otherwise("val"))


def resampled(ranked: DataFrame, scale: float) -> DataFrame:
    """Every row as often as the scale says: whole repeats, and once more for the first of the seeded order."""
    whole = int(scale)
    rest = F.floor(F.col("total") * scale) - F.col("total") * whole
    copies = F.lit(whole) + (F.col("rank") < rest).cast("int")
    return ranked.withColumn("copies", copies).where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))


def capped(df: DataFrame, group: str, order: list[str], most: int) -> DataFrame:
    """The first `most` rows of each group; Spark keeps only that many of each group before the shuffle."""
    place = F.row_number().over(W.partitionBy(group).orderBy(*order))
    return df.withColumn("_p", place).where(F.col("_p") <= most).drop("_p")


def strided(ranked: DataFrame, shards: int) -> DataFrame:
    """Adds `shard`: every shards-th row of the order."""
    return ranked.withColumn("shard", F.pmod(F.col("rank"), F.lit(shards)))
