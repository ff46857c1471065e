"""Sources: transcripts, recognised speech, chats, generation records, metadata."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from talkweave.functions.text import clean_fisher, clean_switchboard

CHAT = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("conversations", T.ArrayType(T.StructType([T.StructField("from", T.StringType()), T.StructField("role", T.StringType()), T.StructField("value", T.StringType())]))),
])
SPOKEN = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("conversations", T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("value", T.StringType())]))),
])
VERDICT = T.StructType([T.StructField(n, T.DoubleType() if n.startswith("score") else T.StringType()) for n in ("score_for_interruption", "score_for_content", "score_for_assistant_last_content", "analysis_for_assistant_interruption", "analysis_for_user_interruption")])
TASK = T.StructType([T.StructField(n, T.StringType()) for n in ("task_id", "prompt", "reasoning_content", "response", "raw_response")])


def file_key(path: Column, pattern: str) -> Column:
    """The first group of a pattern in a file's name; empty if it does not match."""
    return F.regexp_extract(F.element_at(F.split(path, "/"), -1), pattern, 1)


def scan_files(spark: SparkSession, folder: str, glob: str, key: str, broken: DataFrame | None = None) -> DataFrame:
    """Files below a folder in both speaking directions: path, call_id, own, other.

    Only names are listed, no content is read.  Files without a key and calls of the broken list
    (call_id) are left out.
    """
    names = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder)
        .select("path", file_key(F.col("path"), key).alias("call_id")).where("call_id <> ''")
    )
    kept = names if broken is None else names.join(broken, "call_id", "left_anti")
    both = F.explode(F.array(F.struct(F.lit("A").alias("own"), F.lit("B").alias("other")), F.struct(F.lit("B").alias("own"), F.lit("A").alias("other"))))
    return kept.select("path", "call_id", both.alias("d")).select("path", "call_id", "d.own", "d.other")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("recursiveFileLookup", "true").text(path).select(F.col("_metadata.file_name").alias("file"), F.trim("value").alias("line"))


def word_transcript(spark: SparkSession, path: str) -> DataFrame:
    """Lines of `id start end text`: file, speaker_id, start, end, text and the clean text; other lines are left out."""
    part = F.split("line", r"\s+", 4)
    return (
        _lines(spark, path)
        .select("file", part.alias("p"))
        .where(F.size("p") == 4)
        .select("file", F.col("p")[0].alias("speaker_id"), F.expr("try_cast(p[1] AS double)").alias("start"), F.expr("try_cast(p[2] AS double)").alias("end"), F.col("p")[3].alias("text"))
        .where("start IS NOT NULL AND end IS NOT NULL")
        .withColumn("clean", clean_switchboard(F.col("text")))
    )


def utterance_transcript(spark: SparkSession, path: str) -> DataFrame:
    """Lines of `start end A: text`: file, speaker_id, start, end, text and the clean text; comments and bad lines are left out."""
    pattern = r"^(\S+)\s+(\S+)\s+([AB]):\s*(.*)$"
    return (
        _lines(spark, path)
        .where("line <> '' AND NOT startswith(line, '#')")
        .select(
            "file", F.regexp_extract("line", pattern, 3).alias("speaker_id"),
            F.regexp_extract("line", pattern, 1).try_cast("double").alias("start"), F.regexp_extract("line", pattern, 2).try_cast("double").alias("end"), F.regexp_extract("line", pattern, 4).alias("text"),
        )
        .where("speaker_id <> '' AND start IS NOT NULL AND end IS NOT NULL")
        .withColumn("clean", clean_fisher(F.col("text")))
    )


def strict_lines(spark: SparkSession, path: str) -> DataFrame:
    """Every line, and its parts where it is `1.00 2.00 A: text`; other lines pass with null parts."""
    pattern = r"^(\d+\.\d+)\s+(\d+\.\d+)\s+([A-Z]):\s+(.*)"
    fits = F.col("line").rlike(pattern)
    part = lambda k: F.when(fits, F.regexp_extract("line", pattern, k))
    return _lines(spark, path).select("file", "line", part(1).try_cast("double").alias("start"), part(2).try_cast("double").alias("end"), part(3).alias("speaker_id"), part(4).alias("text"))


def asr_json(spark: SparkSession, path: str) -> DataFrame:
    """JSON arrays of [text, receive, finish, audio_start, audio_end], one file per channel: file, seq and the five columns."""
    number = lambda k: F.expr(f"try_cast(x[{k}] AS double)")
    return (
        spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").text(path)
        .select(F.col("_metadata.file_name").alias("file"), F.posexplode(F.from_json("value", "array<array<string>>")).alias("seq", "x"))
        .select("file", "seq", F.col("x")[0].alias("text"), number(1).alias("receive"), number(2).alias("finish"), number(3).alias("audio_start"), number(4).alias("audio_end"))
    )


def call_metadata(spark: SparkSession, path: str) -> DataFrame:
    """CSV of calls: id in column 0, grades in 3 and 4; rows of fewer than 15 columns are left out, grades of other than digits are 0."""
    columns = ", ".join(f"c{k} string" for k in range(15))
    grade = lambda c: F.coalesce(F.when(F.col(c).rlike(r"^\d+$"), F.col(c).cast("int")), F.lit(0))
    return spark.read.schema(columns).csv(path).where("c14 IS NOT NULL").select(F.col("c0").alias("call_id"), grade("c3").alias("sig"), grade("c4").alias("cnv"))


def chats(spark: SparkSession, path: str) -> DataFrame:
    """Chat dumps, JSON arrays or lines: source_file, id, turn, role, value."""
    rows = spark.read.schema(CHAT).option("multiLine", "true").option("recursiveFileLookup", "true").json(path)
    return (
        rows.select(F.col("_metadata.file_name").alias("source_file"), "id", F.posexplode("conversations").alias("turn", "c"))
        .select("source_file", "id", "turn", F.coalesce("c.role", "c.from").alias("role"), "c.value")
    )


def json_lines(spark: SparkSession, path: str, schema: T.StructType = TASK) -> DataFrame:
    """JSON Lines; lines that are no JSON are left out."""
    lenient = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    parsed = F.from_json("value", lenient, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    return spark.read.text(path).where(F.trim("value") != "").select(parsed.alias("x")).where("x._bad IS NULL").select(*[f"x.{f.name}" for f in schema.fields])


def completed_ids(spark: SparkSession, path: str, key: str = "task_id") -> DataFrame:
    """Keys of the lines of a results file that can be read."""
    return json_lines(spark, path, T.StructType([T.StructField(key, T.StringType())])).where(F.col(key).isNotNull()).select(key).distinct()


def splits(spark: SparkSession, folder: str, names: str) -> DataFrame:
    """Parquet splits named as `law+engineering`, one after the other, with their name."""
    frames = [spark.read.parquet(f"{folder}/{n}").withColumn("split", F.lit(n)) for n in names.split("+")]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def cached(spark: SparkSession, path: str, make) -> DataFrame:
    """The Parquet data at `path`; made and written first if there is none, or none that was written to the end."""
    from pyspark.errors import AnalysisException

    try:
        spark.read.format("binaryFile").load(f"{path}/_SUCCESS").schema
    except AnalysisException:
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def pending_units(inputs: DataFrame, outputs: DataFrame, key: str = "unit") -> DataFrame:
    """Units with an input and no output yet."""
    return inputs.join(outputs.select(key).distinct(), key, "left_anti")


def wav_mono(spark: SparkSession, path: str, rate: int = 16_000) -> DataFrame:
    """16-bit WAV files as mono samples at one rate: path, rate, samples (mean of channels, linear resampling)."""
    import io
    import wave

    import numpy as np
    import pandas as pd

    def decode(parts):
        for pdf in parts:
            out = []
            for blob in pdf["content"]:
                with wave.open(io.BytesIO(blob)) as w:
                    data = np.frombuffer(w.readframes(w.getnframes()), dtype="<i2").reshape(-1, w.getnchannels()).mean(1) / 32768
                    n = int(round(len(data) * rate / w.getframerate()))
                    out.append(np.interp(np.arange(n) * w.getframerate() / rate, np.arange(len(data)), data).astype("float32") if len(data) else data)
            yield pd.DataFrame({"path": pdf["path"], "rate": rate, "samples": out})

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").option("recursiveFileLookup", "true").load(path).select("path", "content").mapInPandas(decode, "path string, rate int, samples array<float>")


class CallReader(Protocol):
    """What the pipeline asks of a collection of calls, each part a table of all of them.

    `calls` has call_id, own and other; `heard` conv_id, speaker_id, seq, text, receive, audio_start
    and audio_end; `said` conv_id, seq, speaker_id, start, end and text; `reference` conv_id and text,
    the transcript as people read it.
    """

    def calls(self) -> DataFrame: ...

    def heard(self) -> DataFrame: ...

    def said(self) -> DataFrame: ...

    def reference(self) -> DataFrame: ...


@dataclass(frozen=True)
class TableReader:
    """Calls kept as named Parquet tables in a folder, without those on the list of broken ones."""

    spark: SparkSession
    folder: str

    def _kept(self, name: str, key: str) -> DataFrame:
        read = lambda n: self.spark.read.parquet(f"{self.folder}/{n}.parquet")
        return read(name).join(read("bad_ids").select(F.col("call_id").alias(key)).distinct(), key, "left_anti")

    def calls(self) -> DataFrame:
        both = F.explode(F.array(F.struct(F.lit("A").alias("own"), F.lit("B").alias("other")), F.struct(F.lit("B").alias("own"), F.lit("A").alias("other"))))
        return self._kept("call_meta", "call_id").select("call_id").distinct().select("call_id", both.alias("d")).select("call_id", "d.own", "d.other")

    def heard(self) -> DataFrame:
        return self._kept("asr_stream", "conv_id")

    def said(self) -> DataFrame:
        return self._kept("trans_stream", "conv_id").dropDuplicates(["conv_id", "seq"])

    def reference(self) -> DataFrame:
        line = F.concat(F.coalesce("speaker_id", F.lit("?")), F.lit(": "), F.coalesce("text", F.lit("")))
        lines = F.array_sort(F.collect_list(F.struct("start", "seq", line.alias("line"))))
        return self.said().groupBy("conv_id").agg(F.array_join(F.transform(lines, lambda x: x.line), "\n").alias("text"))
