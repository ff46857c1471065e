"""Queries over the timed words of calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from talkweave.functions.text import speaker_in_text, speaker_index
from talkweave.functions.vocab import BACKCHANNELS, LABELS
from talkweave.operators import timeline as T
from talkweave.sources.tables import table


def words(spark: SparkSession, folder: str) -> DataFrame:
    return T.timed_words(table(spark, folder, "asr_stream"))


def clipped(spark: SparkSession, folder: str) -> DataFrame:
    return T.clipped_once(T.blocked_words(table(spark, folder, "asr_stream")))


def segments(spark: SparkSession, folder: str) -> DataFrame:
    return T.event_segments(T.blocked_words(table(spark, folder, "asr_stream")))


def placed(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Clipped words and the segments made of them, each computed once for both uses."""
    w = clipped(spark, folder)
    return w, T.event_segments(w, clip=False).repartition(*T.SCENE)


def end_repair(spark, folder):
    return T.repair_ends(T.asr_records(table(spark, folder, "asr_stream"))).select("conv_id", "spk", "seq", "text", "start", "end")


def asr_words(spark, folder):
    return words(spark, folder)


_UNIT = ["conv_id", "spk", "ipu", "text", "s", "e"]


def ipu_table(spark, folder):
    return T.numbered_units(T.pausal_units(words(spark, folder))).select(*_UNIT, "n_words")


def ipu_backchannel_semi(spark, folder):
    return T.numbered_units(T.mark_backchannels(T.pausal_units(clipped(spark, folder)))).where("is_bc").select(*_UNIT)


def ipu_activity(spark, folder):
    return T.activity(T.mark_backchannels(T.pausal_units(clipped(spark, folder)))).drop("scene")


def event_segments(spark, folder):
    return segments(spark, folder).drop("scene")


def event_segments_unclipped(spark, folder):
    return T.event_segments(words(spark, folder), clip=False).drop("scene")


def segment_texts(spark, folder):
    return T.segment_texts(*placed(spark, folder))


def event_dialogue_stats(spark, folder):
    return T.label_stats(segments(spark, folder), "conv_id").select("conv_id", "label", "n", "units")


def event_rollup(spark, folder):
    return T.label_stats_rolled_up(segments(spark, folder)).select("conv_id", "label", "n", "units")


def event_label_stats(spark, folder):
    """Every label with its count, duration, events a minute and share of the time; labels not seen count 0."""
    seen = T.label_stats(segments(spark, folder))
    every = spark.createDataFrame([(x,) for x in LABELS], "label string")
    n, u = F.coalesce("n", F.lit(0)), F.coalesce("units", F.lit(0))
    rows = every.join(F.broadcast(seen), "label", "left").select("label", n.alias("n"), u.alias("units"))  # seven rows on either side
    total = F.sum("units").over(W.partitionBy(F.lit(0)))
    rate = lambda x: F.round(F.coalesce(F.try_divide(x.cast("double"), total.cast("double")), F.lit(0.0)), 9)
    return rows.select("label", "n", "units", rate(F.col("n") * 600000).alias("per_minute"), rate(F.col("units") * 100).alias("share"))


def tape_floor(spark, folder):
    return T.floor_holders(segments(spark, folder)).select("conv_id", "start", "end", "label", "floor")


def clip_small_overlap(spark, folder):
    return clipped(spark, folder).drop("scene")


def asr_merge(spark, folder):
    return T.merge_asr(T.repair_ends(T.asr_records(table(spark, folder, "asr_stream"))))


def _lines(spark, folder):
    """Transcript lines with text; spk is that of the label, or of a label in the text, null where neither names a speaker."""
    t = table(spark, folder, "trans_stream").dropDuplicates(["conv_id", "seq"])
    spk = F.coalesce(speaker_index(F.col("speaker_id")), speaker_in_text(F.col("text")))
    return t.select("conv_id", "seq", spk.alias("spk"), "start", F.coalesce("end", "start").alias("end"), F.trim("text").alias("text")).where("text <> ''")


def speaker_runs(spark, folder):
    """A line without a speaker goes with the line before it in time; those before any speaker are runs of nobody."""
    return T.speaker_runs(T.named_speakers(_lines(spark, folder)))


def interpolate(spark, folder):
    """The words of each transcript line, timed by their share of the line's letters."""
    lines = _lines(spark, folder).select("conv_id", "seq", F.col("start").alias("utt_start"), F.col("end").alias("utt_end"), F.posexplode(F.expr("filter(split(text, '\\\\s+'), w -> w <> '')")).alias("pos", "text"))
    return T.interpolate(lines, ["conv_id", "seq"], "pos")


def segment_table_stats(spark, folder):
    """The same statistics over the stored segments, whose labels come in any case and padding."""
    s = table(spark, folder, "segments").select("conv_id", F.upper(F.trim("label")).alias("label"), "start", "end").where("start IS NOT NULL AND end IS NOT NULL AND label IS NOT NULL").distinct()
    return T.label_stats(s, "conv_id").select("conv_id", "label", "n", "units")


QUERIES = {
    f.__name__: f
    for f in (
        end_repair, asr_words, ipu_table, ipu_backchannel_semi, ipu_activity, event_segments, event_segments_unclipped, segment_texts, event_dialogue_stats, event_rollup, event_label_stats,
        tape_floor, clip_small_overlap, asr_merge, speaker_runs, interpolate, segment_table_stats,
    )
}

_BC = ", ".join(f"'{w}'" for w in BACKCHANNELS)
_SPK = r"CASE WHEN regexp_matches(upper(trim(speaker_id)), '[A1]\W*$') THEN 0 WHEN regexp_matches(upper(trim(speaker_id)), '[B2]\W*$') THEN 1 END"
RECORDS = rf"""
WITH one AS (
  SELECT * FROM asr_stream QUALIFY row_number() OVER (PARTITION BY conv_id, seq ORDER BY receive) = 1),
rec AS (
  SELECT conv_id, {_SPK} AS spk, seq, trim(text) AS text, audio_start AS start, audio_end AS "end" FROM one
  WHERE text IS NOT NULL AND (trim(text) = '<SIL>' OR NOT regexp_matches(replace(trim(text), ' ', ''), '^[[:punct:]]*$'))),
known AS (SELECT * FROM rec WHERE spk IS NOT NULL),
nxt AS (SELECT *, lead(start) OVER (PARTITION BY conv_id, spk ORDER BY start, seq) AS n FROM known),
rep AS (
  SELECT conv_id, spk, seq, text, start,
    CASE WHEN "end" > start THEN "end" WHEN least(coalesce(n, start + 0.5), start + 0.5) > start THEN least(coalesce(n, start + 0.5), start + 0.5) ELSE start + 0.5 END AS "end"
  FROM nxt),
nxt2 AS (SELECT *, lead(start) OVER (PARTITION BY conv_id, spk ORDER BY start, seq) AS n FROM known WHERE text <> '<SIL>'),
w AS (
  SELECT conv_id, spk, seq, text, CAST(round_even(start * 10000, 0) AS BIGINT) AS s,
    CAST(round_even(CASE WHEN "end" > start THEN "end" WHEN least(coalesce(n, start + 0.5), start + 0.5) > start THEN least(coalesce(n, start + 0.5), start + 0.5) ELSE start + 0.5 END * 10000, 0) AS BIGINT) AS e
  FROM nxt2)"""


def _ipus(words: str, p: str = "") -> str:
    """Units of a table of words; the tables made are named with the prefix."""
    return f""",
{p}brk AS (SELECT *, CASE WHEN s - lag(e) OVER o < 320 THEN 0 ELSE 1 END AS b FROM {words} WINDOW o AS (PARTITION BY conv_id, spk ORDER BY s, seq)),
{p}num AS (SELECT *, sum(b) OVER (PARTITION BY conv_id, spk ORDER BY s, seq ROWS UNBOUNDED PRECEDING) AS ipu FROM {p}brk),
{p}ipu AS (
  SELECT conv_id, spk, CAST(ipu AS BIGINT) AS ipu, string_agg(text, ' ' ORDER BY s, seq) AS text, min(s) AS s, arg_max(e, (s, seq)) AS e, count(*) AS n_words
  FROM {p}num GROUP BY conv_id, spk, ipu)"""


_CAND = f"replace(regexp_replace(lower(trim(text)), '[[:punct:]]', '', 'g'), ' ', '') IN ({_BC}) AND e - s < 10000"
IPUS = RECORDS + _ipus("w")
#: Words after clipping: wc.
CLIPPED = (
    RECORDS
    + _ipus("w", "u_")
    + f""",
u_cand AS (SELECT *, {_CAND} AS cand FROM u_ipu),
nar AS (
  SELECT u.conv_id, u.ipu,
    max(CASE WHEN a.s <= u.s AND u.s < a.e AND a.e < u.e AND a.e - u.s < 500 THEN a.e END) AS head,
    max(CASE WHEN u.s < a.s AND a.s < u.e AND u.e <= a.e AND u.e - a.s < 500 THEN a.s END) AS tail
  FROM u_cand u JOIN u_cand a ON a.conv_id = u.conv_id AND u.spk = 0 AND a.spk = 1 AND NOT u.cand AND NOT a.cand AND greatest(u.s, a.s) < least(u.e, a.e)
  GROUP BY u.conv_id, u.ipu),
mv AS (
  SELECT n.conv_id, n.spk, n.seq, n.text, b.tail, greatest(n.s, coalesce(b.head, n.s)) AS s1, greatest(n.e, CASE WHEN n.s < b.head THEN greatest(n.s, b.head) + 1 ELSE n.e END) AS e1
  FROM u_num n LEFT JOIN nar b ON n.spk = 0 AND b.conv_id = n.conv_id AND b.ipu = n.ipu),
wc AS (
  SELECT conv_id, spk, seq, text, CASE WHEN e1 > tail AND s1 >= tail THEN tail - 1 ELSE s1 END AS s, CASE WHEN e1 > tail THEN tail ELSE e1 END AS e FROM mv)"""
)


def _chain(words: str) -> str:
    return (
        _ipus(words)
    + f""",
cand AS (SELECT *, {_CAND} AS cand FROM ipu),
bc AS (
  SELECT a.*, a.cand AND EXISTS (SELECT 1 FROM ipu b WHERE b.conv_id = a.conv_id AND b.spk <> a.spk AND greatest(a.s, b.s) < least(a.e, b.e)) AS is_bc
  FROM cand a),
bnd AS (SELECT DISTINCT conv_id, t FROM (SELECT conv_id, s AS t FROM bc UNION ALL SELECT conv_id, e FROM bc UNION ALL SELECT conv_id, 0 FROM bc)),
gr AS (SELECT conv_id, t AS start, lead(t) OVER (PARTITION BY conv_id ORDER BY t) AS "end" FROM bnd),
act AS (
  SELECT g.conv_id, g.start, g."end",
    CAST(count(*) FILTER (WHERE i.spk = 0) AS INTEGER) AS n0, CAST(count(*) FILTER (WHERE i.spk = 1) AS INTEGER) AS n1,
    CAST(count(*) FILTER (WHERE i.spk = 0 AND i.is_bc) AS INTEGER) AS b0, CAST(count(*) FILTER (WHERE i.spk = 1 AND i.is_bc) AS INTEGER) AS b1
  FROM gr g LEFT JOIN bc i ON i.conv_id = g.conv_id AND 2 * i.s <= g.start + g."end" AND g.start + g."end" < 2 * i.e
  WHERE g."end" IS NOT NULL GROUP BY g.conv_id, g.start, g."end"),
one_a AS (SELECT *, CASE WHEN n0 > 0 THEN 0 WHEN n1 > 0 THEN 1 END AS a0 FROM act),
pre AS (
  SELECT *,
    last_value(CASE WHEN n0 + n1 > 0 THEN n0 + n1 END IGNORE NULLS) OVER p AS pn, last_value(a0 IGNORE NULLS) OVER p AS pa,
    last_value(CASE WHEN (n0 > 0) <> (n1 > 0) THEN a0 END IGNORE NULLS) OVER p AS flr
  FROM one_a WINDOW p AS (PARTITION BY conv_id ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
flg AS (
  SELECT *, b0 > 0 AND NOT coalesce(pn > 1, false) AS f0, b1 > 0 AND NOT coalesce(pn > 1, false) AS f1, CASE WHEN pn = 1 THEN pa END AS la FROM pre),
lab AS (
  SELECT *, CASE
    WHEN n0 + n1 = 0 THEN CASE WHEN pn IS NULL THEN 'G' ELSE 'NA' END
    WHEN n0 > 0 AND n1 > 0 THEN CASE WHEN f0 AND NOT f1 AND la IS DISTINCT FROM 0 THEN 'BC' WHEN f1 AND NOT f0 AND la IS DISTINCT FROM 1 THEN 'BC' WHEN f0 AND f1 THEN 'BC' ELSE 'I' END
    WHEN flr IS DISTINCT FROM a0 THEN 'T' ELSE 'C' END AS l1
  FROM flg),
ctx AS (
  SELECT *, lag(l1) OVER o AS pl, lead(l1) OVER o AS nl,
    last_value(CASE WHEN n0 + n1 > 0 THEN l1 END IGNORE NULLS) OVER p AS spl, last_value(a0 IGNORE NULLS) OVER p AS spa,
    first_value(CASE WHEN n0 + n1 > 0 THEN l1 END IGNORE NULLS) OVER f AS sfl, first_value(a0 IGNORE NULLS) OVER f AS sfa
  FROM lab WINDOW o AS (PARTITION BY conv_id ORDER BY start), p AS (PARTITION BY conv_id ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
    f AS (PARTITION BY conv_id ORDER BY start ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
seg AS (
  SELECT conv_id, start, "end",
    CASE WHEN l1 = 'NA' THEN CASE WHEN nl = 'T' AND pl IS DISTINCT FROM 'I' THEN 'G' ELSE 'P' END
         WHEN l1 = 'T' AND spl = 'I' THEN 'C' WHEN l1 = 'I' THEN CASE WHEN sfl = 'C' THEN 'IB' ELSE 'IF' END ELSE l1 END AS label,
    CAST(CASE WHEN l1 IN ('T', 'C') THEN a0 WHEN l1 = 'BC' THEN CASE WHEN f0 AND NOT f1 THEN 0 WHEN f1 AND NOT f0 THEN 1 END
         WHEN l1 = 'I' THEN CASE WHEN sfl = 'T' THEN sfa WHEN sfl = 'C' THEN 1 - sfa ELSE 1 - spa END END AS INTEGER) AS initiator, n0, n1
  FROM ctx)"""
    )


SEGMENTS = CLIPPED + _chain("wc")
_HEAD = r"regexp_extract(upper(text), '^\s*(?:>>\s*)?(?:\(([AB])\)\s*[-:]|(?:(?:SPEAKER|SPK|CHANNEL|CH)[\s_-]*)?([AB12])\s*[:>](?:\D|$))', 0)"
_LINES = rf"""
WITH ln AS (
  SELECT conv_id, seq, coalesce({_SPK}, CASE WHEN regexp_matches({_HEAD}, '[A1]\W*\D?$') THEN 0 WHEN regexp_matches({_HEAD}, '[B2]\W*\D?$') THEN 1 END) AS spk, start, coalesce("end", start) AS "end", trim(text) AS text
  FROM (SELECT DISTINCT * FROM trans_stream)),
line AS (SELECT * FROM ln WHERE text <> '')"""

SQL = {
    "end_repair": RECORDS + ' SELECT conv_id, spk, seq, text, start, "end" FROM rep',
    "asr_words": RECORDS + " SELECT conv_id, spk, seq, text, s, e FROM w",
    "ipu_table": IPUS + " SELECT * FROM ipu",
    "ipu_backchannel_semi": SEGMENTS + " SELECT conv_id, spk, ipu, text, s, e FROM bc WHERE is_bc",
    "ipu_activity": SEGMENTS + ' SELECT conv_id, start, "end", n0, n1, b0, b1 FROM act',
    "event_segments": SEGMENTS + " SELECT * FROM seg",
    "event_segments_unclipped": RECORDS + _chain("w") + " SELECT * FROM seg",
    "clip_small_overlap": CLIPPED + " SELECT conv_id, spk, seq, text, s, e FROM wc",
    "segment_texts": SEGMENTS + """ SELECT g.conv_id, g.start, g."end", coalesce(string_agg(x.text, ' ' ORDER BY x.s, x.seq) FILTER (WHERE x.spk = 0), '') AS text0,
      coalesce(string_agg(x.text, ' ' ORDER BY x.s, x.seq) FILTER (WHERE x.spk = 1), '') AS text1
      FROM seg g JOIN wc x ON x.conv_id = g.conv_id AND g.start <= x.s AND x.s < g."end" GROUP BY g.conv_id, g.start, g."end" """,
    "event_dialogue_stats": SEGMENTS + ' SELECT conv_id, label, count(*) AS n, CAST(sum(greatest(0, "end" - start)) AS BIGINT) AS units FROM seg GROUP BY conv_id, label',
    "event_rollup": SEGMENTS + ' SELECT conv_id, label, count(*) AS n, CAST(sum(greatest(0, "end" - start)) AS BIGINT) AS units FROM seg GROUP BY GROUPING SETS ((conv_id, label), (label))',
    "event_label_stats": SEGMENTS + """, tot AS (SELECT CAST(sum(greatest(0, "end" - start)) AS BIGINT) AS total FROM seg),
      agg AS (SELECT label, count(*) AS n, CAST(sum(greatest(0, "end" - start)) AS BIGINT) AS units FROM seg GROUP BY label)
      SELECT l.label, coalesce(n, 0) AS n, coalesce(units, 0) AS units,
        round(coalesce(CAST(coalesce(n, 0) * 600000 AS DOUBLE) / nullif(CAST(total AS DOUBLE), 0), 0), 9) AS per_minute,
        round(coalesce(CAST(coalesce(units, 0) * 100 AS DOUBLE) / nullif(CAST(total AS DOUBLE), 0), 0), 9) AS share
      FROM (VALUES ('T'), ('C'), ('P'), ('G'), ('BC'), ('IF'), ('IB')) l(label) LEFT JOIN agg USING (label), tot""",
    "tape_floor": SEGMENTS + """ SELECT conv_id, start, "end", label, last_value(CASE WHEN label IN ('IF', 'T') THEN initiator END IGNORE NULLS)
      OVER (PARTITION BY conv_id ORDER BY start ROWS UNBOUNDED PRECEDING) AS floor FROM seg""",
    "asr_merge": RECORDS + """, f AS (SELECT *, text = '<SIL>' AS silent FROM rep),
      c AS (SELECT *, CASE WHEN silent = lag(silent) OVER (PARTITION BY conv_id, spk ORDER BY start, seq) THEN 0 ELSE 1 END AS b FROM f),
      r AS (SELECT *, sum(b) OVER (PARTITION BY conv_id, spk ORDER BY start, seq ROWS UNBOUNDED PRECEDING) AS run FROM c),
      g AS (SELECT conv_id, spk, CAST(run AS BIGINT) AS run, bool_and(silent) AS silent, min(start) AS s0, arg_max("end", (start, seq)) AS "end", string_agg(text, '' ORDER BY start, seq) AS text FROM r GROUP BY conv_id, spk, run)
      SELECT conv_id, spk, run, silent, CASE WHEN silent THEN s0 ELSE coalesce(lag("end") OVER (PARTITION BY conv_id, spk ORDER BY run), s0) END AS start, "end",
        CASE WHEN silent THEN '<SIL>' ELSE text END AS text FROM g""",
    "speaker_runs": _LINES + """, nm AS (SELECT * REPLACE (last_value(spk IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY start, seq ROWS UNBOUNDED PRECEDING) AS spk) FROM line),
      c AS (SELECT *, CASE WHEN lag(seq) OVER o IS NOT NULL AND spk IS NOT DISTINCT FROM lag(spk) OVER o THEN 0 ELSE 1 END AS b FROM nm WINDOW o AS (PARTITION BY conv_id ORDER BY start, seq)),
      r AS (SELECT *, sum(b) OVER (PARTITION BY conv_id ORDER BY start, seq ROWS UNBOUNDED PRECEDING) AS run FROM c)
      SELECT conv_id, CAST(run AS BIGINT) AS run, min(spk) AS spk, arg_min(start, (start, seq)) AS start, arg_max("end", (start, seq)) AS "end",
        string_agg(text, ' ' ORDER BY start, seq) || ' ' AS text FROM r GROUP BY conv_id, run""",
    "interpolate": _LINES + r""", tk AS (SELECT conv_id, seq, start, "end", unnest(range(len(l))) AS pos, unnest(l) AS text, len(l) AS n FROM
        (SELECT *, list_filter(string_split_regex(text, '\s+'), lambda w: w <> '') AS l FROM line)),
      sz AS (SELECT *, sum(length(text)) OVER (PARTITION BY conv_id, seq) AS total, coalesce(sum(length(text)) OVER (PARTITION BY conv_id, seq ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM tk)
      SELECT conv_id, seq, CAST(pos AS INTEGER) AS pos, text, round_even((start + ("end" - start) * (CAST(before AS DOUBLE) / CAST(total AS DOUBLE))) * 100, 0) / 100 AS start,
        round_even(CASE WHEN pos = n - 1 THEN "end" ELSE start + ("end" - start) * (CAST(before + length(text) AS DOUBLE) / CAST(total AS DOUBLE)) END * 100, 0) / 100 AS "end" FROM sz""",
    "segment_table_stats": """SELECT conv_id, label, count(*) AS n, CAST(sum(greatest(0, "end" - start)) AS BIGINT) AS units
      FROM (SELECT DISTINCT conv_id, upper(trim(label)) AS label, start, "end" FROM segments WHERE start IS NOT NULL AND "end" IS NOT NULL AND label IS NOT NULL) GROUP BY conv_id, label""",
}
