"""Queries that align texts, and small statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from talkweave.functions.text import between_marks
from talkweave.operators import alignment as L
from talkweave.plans import chat, timeline
from talkweave.sources.sinks import bar_data as bars, chart_data as chart, heat_data as heat
from talkweave.sources.tables import table


def text_pieces(spark, folder):
    """Transcript lines cut after their second word."""
    t = timeline._lines(spark, folder).withColumn("n", F.size(F.expr("filter(split(text, '\\\\s+'), w -> w <> '')")))
    counts = F.when(F.col("n") > 2, F.array(F.lit(2), F.col("n") - 2)).otherwise(F.array("n"))
    return t.select("conv_id", "seq", F.array_join(L.split_at_counts(F.col("text"), counts), "|").alias("pieces"))


def punctuation_restored(spark, folder):
    """Turns whose words come back from a restored text of their chat, in which every word ends with a full stop.

    Every third chat's restored text has lost a word, so its turns stay as they are.
    """
    t = chat.turns(spark, folder)
    words = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.expr("filter(split(value, '\\\\s+'), w -> w <> '')").alias("w")))), lambda x: x.w))
    whole = t.groupBy("id").agg(F.transform(words, lambda w: F.concat(w, F.lit("."))).alias("w"))
    lost = F.substring("id", -1, 1).isin("0", "3", "6", "9") & (F.size("w") > 0)
    restored = whole.select("id", F.array_join(F.when(lost, F.slice("w", 2, F.size("w"))).otherwise(F.col("w")), " ").alias("restored"))
    return L.with_punctuation(t.join(restored, "id"), ["id"], "turn", "value", "restored").select("id", "turn", F.md5("value").alias("digest"))


def letters_spoken(spark, folder):
    """Letters of each transcript line spoken after each of its words."""
    tokens = F.expr("filter(split(text, '\\\\s+'), w -> w <> '')")
    return timeline._lines(spark, folder).select("conv_id", "seq", F.array_join(F.transform(L.letters_after(F.col("text"), tokens), lambda n: n.cast("string")), ",").alias("letters"))


def marks_protected(spark, folder):
    """Transcript lines in upper case but for their marks."""
    return timeline._lines(spark, folder).select("conv_id", "seq", between_marks(F.col("text"), F.upper).alias("text"))


def probe_reasons(spark, folder):
    """Chats by the third part of an id made of their second turn's role."""
    t = chat.turns(spark, folder).where("turn = 1").select(F.concat(F.lit("test_UiM_"), F.lower("role"), F.lit("_1")).alias("task"))
    return t.groupBy(L.reason_of(F.col("task")).alias("reason")).agg(F.count("*").alias("n"))


def distinct_counts(spark, folder):
    """Distinct calls and the largest number of lines of one, of both streams."""
    per = lambda n: table(spark, folder, n).groupBy("conv_id").agg(F.count_distinct("seq").alias("n")).agg(F.lit(n).alias("stream"), F.count("*").alias("calls"), F.max("n").alias("most"))
    return per("asr_stream").unionByName(per("trans_stream"))


def chart_bars(spark, folder):
    """Calls by topic with their share: what bars or a pie draw."""
    return bars(table(spark, folder, "call_meta").select("call_id", "topic").distinct(), "topic")


def chart_heat(spark, folder):
    """Segments by label and initiator: what a heat map draws."""
    s = table(spark, folder, "segments").select(F.upper(F.trim("label")).alias("label"), "action_initiator")
    return heat(s, "label", "action_initiator")


def length_chart(spark, folder):
    """A histogram of document lengths in 20 bins: the data a chart draws."""
    return chart(table(spark, folder, "documents"), "n_chars").select("bin", "n")


QUERIES = {f.__name__: f for f in (text_pieces, punctuation_restored, letters_spoken, marks_protected, probe_reasons, distinct_counts, length_chart, chart_bars, chart_heat)}
SQL = {
    "text_pieces": timeline._LINES + r""" SELECT conv_id, seq, CASE WHEN regexp_matches(text, '^\S+\s+\S+\s+\S') THEN regexp_extract(text, '^(\S+\s+\S+\s+)', 1) || '|' || regexp_replace(text, '^\S+\s+\S+\s+', '') ELSE text END AS pieces FROM line""",
    "punctuation_restored": chat.TURNS + r""", n AS (SELECT id, turn, value, list_filter(string_split_regex(value, '\s+'), lambda w: w <> '') AS w FROM turns),
      t AS (SELECT *, sum(len(w)) OVER (PARTITION BY id) AS total FROM n)
      SELECT id, turn, md5(CASE WHEN right(id, 1) IN ('0', '3', '6', '9') AND total > 0 THEN value ELSE array_to_string(list_transform(w, lambda x: x || '.'), ' ') END) AS digest FROM t""",
    "letters_spoken": timeline._LINES + r""", w AS (SELECT conv_id, seq, list_transform(regexp_extract_all(text, '\S+ *'), lambda x: length(x)) AS l FROM line)
      SELECT conv_id, seq, array_to_string(list_transform(range(1, len(l) + 1), lambda k: CAST(list_sum(l[1:k]) AS BIGINT)), ',') AS letters FROM w""",
    "marks_protected": timeline._LINES + r""", m AS (SELECT conv_id, seq, string_split_regex(text, '(\(\(.*?\)\)|\[.*?\])') AS p, regexp_extract_all(text, '(\(\(.*?\)\)|\[.*?\])', 1) AS k FROM line)
      SELECT conv_id, seq, array_to_string(list_transform(p, lambda x, i: upper(x) || coalesce(k[i], '')), '') AS text FROM m""",
    "probe_reasons": chat.TURNS + " SELECT lower(role) AS reason, count(*) AS n FROM turns WHERE turn = 1 GROUP BY 1",
    "distinct_counts": """WITH a AS (SELECT 'asr_stream' AS stream, conv_id, count(DISTINCT seq) AS n FROM asr_stream GROUP BY ALL UNION ALL SELECT 'trans_stream', conv_id, count(DISTINCT seq) FROM trans_stream GROUP BY ALL)
      SELECT stream, count(*) AS calls, max(n) AS most FROM a GROUP BY stream""",
    "chart_bars": "WITH t AS (SELECT DISTINCT call_id, topic FROM call_meta) SELECT topic, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 9) AS share FROM t GROUP BY topic",
    "chart_heat": "SELECT upper(trim(label)) AS label, action_initiator, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY upper(trim(label))), 9) AS share FROM segments GROUP BY 1, 2",
    "length_chart": """WITH e AS (SELECT min(n_chars) AS lo, max(n_chars) AS hi FROM documents)
      SELECT CAST(least(floor((n_chars - lo) / greatest((hi - lo) / 20, 1e-12)), 19) AS BIGINT) AS bin, count(*) AS n FROM documents, e GROUP BY 1""",
}
