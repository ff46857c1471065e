"""Queries: documents packed into containers, and mixed to target shares, sized in tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from talkweave.llm.mixing import mix_shares, mix_sources, quality
from talkweave.llm.packing import fill_containers
from talkweave.llm.tokens import n_tokens
from talkweave.sources.tables import table


def _sized(spark: SparkSession, folder: str, *more: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", *more, n_tokens(F.col("text")).alias("n_tokens"))


def p6_placements(spark: SparkSession, folder: str) -> DataFrame:
    """The container of every document, for every limit, and the container's fill."""
    return fill_containers(_sized(spark, folder), table(spark, folder, "pack_limits"))


def p6_containers(spark: SparkSession, folder: str) -> DataFrame:
    """Containers and their fill, without the documents."""
    return (
        p6_placements(spark, folder)
        .groupBy("limit_id", "max_tokens", "container_id")
        .agg(F.count("*").alias("n_pieces"), F.sum("size").alias("fill"))
    )


def p6_fill(spark: SparkSession, folder: str) -> DataFrame:
    """Per limit: containers, tokens, the share of the room that is used, and the containers that the tokens alone would fill."""
    return (
        p6_containers(spark, folder)
        .groupBy("limit_id", "max_tokens")
        .agg(F.count("*").alias("n_containers"), F.sum("n_pieces").alias("n_pieces"), F.sum("fill").alias("n_tokens"))
        .withColumn("used", F.col("n_tokens") / (F.col("n_containers") * F.col("max_tokens")))
        .withColumn("n_least", F.ceil(F.col("n_tokens") / F.col("max_tokens")))
    )


def p6_check(spark: SparkSession, folder: str) -> DataFrame:
    """Per limit what must hold of placements: documents placed, and containers too full or wrongly summed, documents wrongly split or not whole."""
    placed = p6_placements(spark, folder)
    boxes = placed.groupBy("limit_id", "max_tokens", "container_id").agg(F.sum("size").alias("n"), F.max("fill").alias("fill"))
    wrong_box = boxes.groupBy("limit_id", "max_tokens").agg(F.count_if((F.col("n") > F.col("max_tokens")) | (F.col("n") != F.col("fill"))).alias("n_wrong_fill"))
    docs = placed.groupBy("limit_id", "doc_id").agg(F.sum("size").alias("size"), F.count("*").alias("pieces"), F.first("max_tokens").alias("most"))
    whole = _sized(spark, folder).select(F.col("doc_id"), "n_tokens")
    joined = docs.join(whole, "doc_id", "full").groupBy("limit_id").agg(
        F.count("n_tokens").alias("n_documents"),
        F.count_if((F.col("pieces") > 1) & (F.col("size") <= F.col("most"))).alias("n_wrong_split"),
        F.count_if(~F.col("size").eqNullSafe(F.col("n_tokens").cast("long"))).alias("n_not_whole"),
    )
    return wrong_box.join(joined, "limit_id").select("limit_id", "max_tokens", "n_documents", "n_wrong_fill", "n_wrong_split", "n_not_whole")


def p7_mix(spark: SparkSession, folder: str) -> DataFrame:
    """The documents of every mix with their repeats."""
    sized = _sized(spark, folder, "source", "n_chars")
    return mix_sources(sized, table(spark, folder, "mix_targets"), quality(F.col("n_chars"), F.col("n_tokens")))


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    """The target and actual share of every source in every mix."""
    return mix_shares(p7_mix(spark, folder), table(spark, folder, "mix_targets"))


def p7_check(spark: SparkSession, folder: str) -> DataFrame:
    """Per mix what must hold of it: sources with a part in it, documents of other sources, used too often or listed twice, sources off their share."""
    mix, targets = p7_mix(spark, folder), table(spark, folder, "mix_targets")
    docs = table(spark, folder, "documents").select("doc_id", F.col("source").alias("own"))
    most = targets.select("mix_id", "source", "max_repeats")
    each = mix.join(docs, "doc_id", "left").join(most, ["mix_id", "source"], "left")
    bad = each.groupBy("mix_id").agg(
        F.count_if(~F.col("own").eqNullSafe(F.col("source"))).alias("n_wrong_source"), F.count_if(F.col("repeats") > F.col("max_repeats")).alias("n_too_often"), F.count_if(F.col("max_repeats").isNull()).alias("n_unknown")
    )
    twice = mix.groupBy("mix_id", "doc_id").count().groupBy("mix_id").agg(F.count_if(F.col("count") > 1).alias("n_twice"))
    # a source ends within half a document of its budget, so shares are off by no more than about two of the longest documents
    longest = mix.groupBy("mix_id").agg(F.max("n_tokens").alias("longest"), F.sum(F.col("n_tokens") * F.col("repeats")).alias("total"))
    off = F.abs(F.col("actual_share") - F.col("target_share")) * F.col("total") > 2 * F.col("longest")
    shares = p7_shares(spark, folder).join(longest, "mix_id").groupBy("mix_id").agg(F.count("*").alias("n_sources"), F.count_if(off).alias("n_off_share"))
    return shares.join(bad, "mix_id").join(twice, "mix_id").select("mix_id", "n_sources", "n_off_share", "n_wrong_source", "n_too_often", "n_unknown", "n_twice")


QUERIES = {"p6_placements": p6_placements, "p6_containers": p6_containers, "p6_fill": p6_fill, "p6_check": p6_check, "p7_mix": p7_mix, "p7_shares": p7_shares, "p7_check": p7_check}
# The placements and mixes themselves are one answer of many; SQL states what must hold of any.
SQL: dict[str, str] = {
    "p6_check": "SELECT limit_id, CAST(max_tokens AS BIGINT) AS max_tokens, (SELECT count(*) FROM documents) AS n_documents, 0 AS n_wrong_fill, 0 AS n_wrong_split, 0 AS n_not_whole FROM (SELECT DISTINCT limit_id, max_tokens FROM pack_limits WHERE max_tokens >= 1)",
    "p7_check": "SELECT mix_id, count(*) AS n_sources, 0 AS n_off_share, 0 AS n_wrong_source, 0 AS n_too_often, 0 AS n_unknown, 0 AS n_twice FROM mix_targets GROUP BY mix_id",
}
