"""Sinks: tapes by role and split, transcripts, appended records, results, chart data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F


def by_role_and_split(tapes: DataFrame, path: str, kind: str = "json") -> None:
    """One folder per role and split, as JSON or Parquet; rewriting a part replaces that part only."""
    tapes.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("role", "split").format(kind).save(path)


def append_records(rows: DataFrame, path: str) -> None:
    """JSON Lines added to what is there; a failed write leaves nothing behind."""
    rows.write.mode("append").json(path)


def checkpoint_part(rows: DataFrame, path: str, part: str) -> None:
    """A part of a long job in a folder of its own; done again it replaces itself."""
    rows.write.mode("overwrite").json(f"{path}/part={part}")


def merged_parts(spark: SparkSession, path: str, schema: str, key: str, order: str) -> DataFrame:
    """All parts of a long job as one table, of records with one key the last by `order`, whatever parts were done again."""
    return last_of(spark.read.schema(schema).json(path), [key], order)


def refined_transcript(rows: DataFrame, path: str, order: list[str], first_line: str | None = None) -> None:
    """Lines of `start end A: text`, a blank line between them, after a kept first line, in one file per call.

    `rows` has conv_id, start, end, speaker and text; a call is one row of text, as long as its transcript.
    """
    line = F.format_string("%.2f %.2f %s: %s", "start", "end", "speaker", "text")
    listed = F.array_sort(F.collect_list(F.struct(*order, line.alias("line"))))
    text = F.array_join(F.transform(listed, lambda x: x.line), "\n\n")
    body = F.concat_ws("\n\n", F.lit(first_line), text) if first_line else text
    rows.where(F.trim("text") != "").groupBy("conv_id").agg(body.alias("value")).write.mode("overwrite").partitionBy("conv_id").text(path)


def results(rows: DataFrame, path: str, id_column: str = "id") -> None:
    """Results in order of the number at the end of their id, range-partitioned rather than in one task."""
    number = F.try_element_at(F.split(id_column, "_"), F.lit(-1)).try_cast("long")
    rows.withColumn("_n", number).orderBy("_n", id_column).drop("_n").write.mode("overwrite").json(path)


def chart_data(rows: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """What a histogram draws: bin, from, to and count over the range of a numeric column."""
    ends = rows.agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    known = rows.where(F.col(column).isNotNull()).select(column, ends.select("lo").scalar().alias("lo"), ends.select("hi").scalar().alias("hi"))
    width = F.greatest((F.col("hi") - F.col("lo")) / bins, F.lit(1e-12))
    placed = known.withColumn("bin", F.least(F.floor((F.col(column) - F.col("lo")) / width), F.lit(bins - 1)))
    return placed.groupBy("bin", "lo", width.alias("w")).agg(F.count("*").alias("n")).select("bin", (F.col("lo") + F.col("bin") * F.col("w")).alias("from"), (F.col("lo") + (F.col("bin") + 1) * F.col("w")).alias("to"), "n")


def bar_data(rows: DataFrame, column: str) -> DataFrame:
    """What bars or a pie draw: each value, null among them, with its count and share of all."""
    per = rows.groupBy(column).agg(F.count("*").alias("n"))
    return per.withColumn("share", F.round(F.col("n") / F.sum("n").over(W.partitionBy(F.lit(0))), 9))  # a row a value


def heat_data(rows: DataFrame, row: str, column: str) -> DataFrame:
    """What a heat map draws: each pair of values with its count and its share of its row."""
    per = rows.groupBy(row, column).agg(F.count("*").alias("n"))
    return per.withColumn("share", F.round(F.col("n") / F.sum("n").over(W.partitionBy(row)), 9))


def interleaved(left: DataFrame, right: DataFrame, sample: str = "sample", value: str = "value") -> DataFrame:
    """Two tracks as stereo frames in order: sample, left, right."""
    a, b = left.select(sample, F.col(value).alias("left")), right.select(sample, F.col(value).alias("right"))
    return a.join(b, sample, "full").select(sample, F.coalesce("left", F.lit(0.0)).alias("left"), F.coalesce("right", F.lit(0.0)).alias("right"))


def last_of(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The newest row of each key, which makes appended results idempotent."""
    newest = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(order)))
    return rows.withColumn("_r", newest).where("_r = 1").drop("_r")
