"""Queries: clean speaker turns of both transcript streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from talkweave.llm.speech import speaker_turns
from talkweave.sources.tables import table


def _both(spark: SparkSession, folder: str, keep_text: bool) -> DataFrame:
    asr = speaker_turns(table(spark, folder, "asr_stream"), "audio_start", "receive", keep_text)
    trans = speaker_turns(table(spark, folder, "trans_stream"), "start", None, keep_text)
    return asr.select(F.lit("asr").alias("stream_name"), "*").unionByName(trans.select(F.lit("trans").alias("stream_name"), "*"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """All clean turns of speaker A or B, per call and stream."""
    return _both(spark, folder, False).select("stream_name", "conv_id", "speaker", "first_seq", "n_words")


def p4_turns(spark: SparkSession, folder: str) -> DataFrame:
    """The clean turns with their words, numbered by their start."""
    return _both(spark, folder, True)


QUERIES = {"p4_found": p4_found, "p4_turns": p4_turns}

_CLEAN = r"""
WITH raw AS (
  SELECT 'asr' AS stream_name, conv_id, seq, speaker_id, audio_start AS t, coalesce(text, '') AS text, receive AS r FROM asr_stream
  UNION ALL
  SELECT 'trans', conv_id, seq, speaker_id, start, coalesce(text, ''), 0.0 FROM trans_stream),
one AS (
  SELECT * FROM raw QUALIFY row_number() OVER (PARTITION BY stream_name, conv_id, seq ORDER BY r) = 1),
lab AS (
  SELECT *, regexp_replace(upper(trim(speaker_id)), '[:.>\s]+$', '') AS sp,
    upper(regexp_extract(text, '^\s*(?:>>\s*)?(?:\(([AB])\)\s*[-:]+|([AB])\s*[:>]|(?i:speaker|spk)[\s_-]*([ABab])\s*[:>])', 0)) AS head
  FROM one),
clean AS (
  SELECT stream_name, conv_id, seq, t,
    CASE WHEN regexp_matches(sp, '(^|[\s_\d-])A$') OR regexp_matches(sp, '^(CHANNEL|CH)[\s_-]*1$') THEN 'A'
         WHEN regexp_matches(sp, '(^|[\s_\d-])B$') OR regexp_matches(sp, '^(CHANNEL|CH)[\s_-]*2$') THEN 'B'
         WHEN head <> '' THEN regexp_extract(head, '([AB])\W*$', 1) END AS speaker,
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
      regexp_replace(text, '^\s*(?:>>\s*)?(?:\(([AB])\)\s*[-:]+|([AB])\s*[:>]|(?i:speaker|spk)[\s_-]*([ABab])\s*[:>])', ''),
      '\[\d+(:\d+)+([.,]\d+)?\]|<t=[^<>]*>|\(\d+([.,]\d+)?\s*s\)|\b\d+:\d\d:\d\d([.,]\d+)?(\s*-->)?|-->', ' ', 'g'),
      '\(\(|\)\)', '', 'g'),
      '\[(?i:laughter)-([^\[\]]*)\]', '\1', 'g'),
      '<[^<>]*>|\{[^{}]*\}|\*[^*]+\*|\([^()]*\)', ' ', 'g'),
      '(^|\s)\[[^\[\]]*\]', ' ', 'g') AS text
  FROM lab),
listed AS (
  SELECT *, list_filter(string_split_regex(trim(text), '\s+'), lambda w:
      regexp_matches(w, '[\p{L}\p{N}]') AND NOT regexp_matches(w, '^[^\p{L}\p{N}]*(?i:u+h+m*|u+m+|e+r+m*|a+h+m*)[^\p{L}\p{N}]*$')) AS l
  FROM clean),
counted AS (SELECT *, len(l) AS n FROM listed),
filled AS (
  SELECT *, last_value(speaker IGNORE NULLS) OVER (PARTITION BY stream_name, conv_id ORDER BY t, seq ROWS UNBOUNDED PRECEDING) AS who
  FROM counted),
marked AS (
  SELECT *, CASE WHEN who IS DISTINCT FROM lag(who) OVER w OR lag(seq) OVER w IS NULL THEN 1 ELSE 0 END AS new
  FROM filled WHERE n > 0 WINDOW w AS (PARTITION BY stream_name, conv_id ORDER BY t, seq)),
numbered AS (
  SELECT *, sum(new) OVER (PARTITION BY stream_name, conv_id ORDER BY t, seq ROWS UNBOUNDED PRECEDING) AS k FROM marked)
SELECT stream_name, conv_id, who AS speaker, arg_min(seq, (t, seq)) AS first_seq, CAST(sum(n) AS BIGINT) AS n_words{more}
FROM numbered GROUP BY stream_name, conv_id, k, who
"""

SQL = {
    "p4_found": _CLEAN.replace("{more}", ""),
    "p4_turns": _CLEAN.replace("{more}", ", CAST(min(t) AS DOUBLE) AS started, string_agg(array_to_string(l, ' '), ' ' ORDER BY t, seq) AS text"),
}
