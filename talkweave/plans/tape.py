"""Queries over tapes: of calls, and of chats."""

from __future__ import annotations

from pyspark.sql import functions as F

from talkweave.functions.text import speaker_index
from talkweave.functions.vocab import SILENCE
from talkweave.operators import sampling as S
from talkweave.operators import tape as P
from talkweave.operators import timeline as T
from talkweave.operators.chat import chat_tapes
from talkweave.plans import chat, timeline
from talkweave.sources.tables import table


def _silences(spark, folder):
    return T.timed_silences(table(spark, folder, "asr_stream"))


def tape_rules(spark, folder):
    """The tapes of all calls, from words to clauses."""
    return P.call_tapes(timeline.words(spark, folder), _silences(spark, folder))


def boundary_merge(spark, folder):
    """The tapes of all calls word by word, with silences before the agent's turns removed."""
    return P.call_tapes(timeline.words(spark, folder), _silences(spark, folder), clauses=False, trim_gaps=True)


def tape_complement(spark, folder):
    """The tapes of all calls word by word, with as many silences in gaps and pauses as they have room for."""
    return P.call_tapes(timeline.words(spark, folder), _silences(spark, folder), clauses=False, complement=True)


def tapes(spark, folder):
    return chat_tapes(chat.turns(spark, folder), "assistant", F.col("turn") % 3)


def entries(spark, folder):
    return tapes(spark, folder).select("id", F.posexplode("tape").alias("pos", "token"))


def tape_validity(spark, folder):
    """The first illegal entry of each chat tape that has lost every 37th entry."""
    return P.first_errors(entries(spark, folder).where("pos % 37 <> 5"), "id")


def word_segments(spark, folder):
    """Each word with the segment it starts in."""
    return T.words_in_segments(*timeline.placed(spark, folder)).drop("scene")


def first_speaker_role(spark, folder):
    return P.first_speakers(entries(spark, folder), "id")


def sample_roles(spark, folder):
    """Two samples of every chat, one for each view: who is to be learned from which."""
    roles = P.first_speakers(entries(spark, folder), "id")
    both = roles.select("id", "role", F.explode(F.array(F.lit("A_to_B"), F.lit("B_to_A"))).alias("direction"))
    return P.sample_roles(both, "id", "direction").select("id", "direction", "role")


def _ids(spark, folder):
    return table(spark, folder, "conversation_turn").select("id").distinct()


def split_counts(spark, folder):
    return S.split_names(S.hash_ranked(_ids(spark, folder), "id")).select("id", "rank", "split")


def split_capped(spark, folder):
    """Chats split nine to one, with at most 1,500 to train on."""
    return S.split_capped(S.hash_ranked(_ids(spark, folder), "id")).select("id", "rank", "split")


def resample(spark, folder):
    return S.resampled(S.hash_ranked(_ids(spark, folder), "id", 11), 2.5).select("id", F.col("copy").cast("int").alias("copy"))


def resample_down(spark, folder):
    return S.resampled(S.hash_ranked(_ids(spark, folder), "id", 13), 0.25).select("id")


def strided_shard(spark, folder):
    return S.strided(S.hash_ranked(_ids(spark, folder), "id"), 7).groupBy("shard").agg(F.count("*").alias("n"))


def per_reason_cap(spark, folder):
    """At most 150 rows per topic, the first to start."""
    calls = table(spark, folder, "call_meta").where("topic IS NOT NULL").select("topic", "call_id", "started_at").distinct()
    return S.capped(calls, "topic", ["started_at", "call_id"], 150).select("topic", "call_id")


def forced_probes(spark, folder):
    """Chat tapes without punctuation of the interlocutor, made to yield at their fourth entry."""
    t = tapes(spark, folder).where(F.size("tape") > 4).withColumn("tape", P.unpunctuated(F.col("tape")))
    return t.select("id", F.array_join(P.forced_probe(F.col("tape"), F.lit(3)), "|").alias("tape"))


def dialogue_history(spark, folder):
    return tapes(spark, folder).select("id", P.history(F.col("tape")).alias("history"))


def readable_tape(spark, folder):
    return P.readable(entries(spark, folder), "id")


QUERIES = {
    f.__name__: f
    for f in (tape_rules, boundary_merge, tape_complement, tape_validity, word_segments, first_speaker_role, sample_roles, split_counts, split_capped, resample, resample_down, strided_shard, per_reason_cap, forced_probes, dialogue_history, readable_tape)
}

_CUT = "chr(31)"  # texts may hold the bar that stands between shown entries
_TAPES = chat.SQL["chat_tape"].replace("'|[C.LISTEN]|'", f"{_CUT} || '[C.LISTEN]' || {_CUT}").replace("'|[C.SPEAK]|'", f"{_CUT} || '[C.SPEAK]' || {_CUT}").replace("'|'", _CUT)
ENTRIES = (
    f"WITH ct AS ({_TAPES}), xs AS (SELECT id, string_split(tape, {_CUT}) AS l FROM ct), "
    "en AS (SELECT id, CAST(unnest(range(len(l))) AS INTEGER) AS pos, unnest(l) AS token FROM xs)"
)
_RANK = "WITH ids AS (SELECT DISTINCT id FROM conversation_turn), r AS (SELECT id, row_number() OVER (ORDER BY md5(id || '|{seed}'), id) - 1 AS rank, count(*) OVER () AS total FROM ids)"
_TR = "('[C.LISTEN]', '[C.SPEAK]', '[S.LISTEN.INTERRUPT]', '[S.LISTEN.NATURAL]', '[S.SPEAK]')"
_RULES = ", ".join(str((label, party, r.lead, r.own, r.heard, r.join, r.no_silence, r.tail, r.stop, r.lead_if)) for (label, party), r in [*P.RULES.items(), *((("T0", k), r) for k, r in enumerate(P.TURN_HEARD.values()))])
#: The parts of all segments, one after the other, with merged tokens: mg (conv_id, run, t, k).  {heard} is the list of what is heard in a segment.
_WRITTEN = (
    timeline.SEGMENTS
    + rf""",
sl AS (SELECT *, lead(start) OVER (PARTITION BY conv_id ORDER BY start, seq) AS n FROM known WHERE text = '<SIL>' AND spk = 0),
tw AS (
  SELECT conv_id, spk, seq, text, s, e FROM wc
  UNION ALL SELECT conv_id, spk, seq, text, CAST(round_even(start * 10000, 0) AS BIGINT),
    CAST(round_even(CASE WHEN "end" > start THEN "end" WHEN least(coalesce(n, start + 0.5), start + 0.5) > start THEN least(coalesce(n, start + 0.5), start + 0.5) ELSE start + 0.5 END * 10000, 0) AS BIGINT) FROM sl),
ns AS (
  SELECT conv_id, start, "end", label, initiator, row_number() OVER o - 1 AS k, lag(label) OVER o AS before,
    last_value(CASE WHEN label IN ('IF', 'T') THEN initiator END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY start ROWS UNBOUNDED PRECEDING) AS floor
  FROM seg WINDOW o AS (PARTITION BY conv_id ORDER BY start)),
hw AS (
  SELECT g.*, coalesce(list(w.text ORDER BY w.s, w.seq, w.text) FILTER (WHERE w.spk = 0), []) AS heard0, coalesce(list(w.text ORDER BY w.s, w.seq, w.text) FILTER (WHERE w.spk = 1), []) AS own
  FROM ns g LEFT JOIN tw w ON w.conv_id = g.conv_id AND g.start <= w.s AND w.s < g."end" AND w.e > g.start GROUP BY ALL),
hd AS (SELECT *, {{heard}} AS heard FROM hw),
rules AS (SELECT * FROM (VALUES {_RULES}) r(rlabel, party, lead_, own_, heard_, join_, nosil, tail_, stop_, lead_if)),
pr AS (
  SELECT *, CASE WHEN label = 'T' AND initiator = 0 THEN 'T0' ELSE label END AS rl,
    CASE WHEN label = 'T' AND initiator = 0 THEN CASE WHEN before IS NULL THEN 0 WHEN before = 'G' THEN 1 ELSE 2 END WHEN label IN ('P', 'G') THEN coalesce(floor, 2)
      WHEN initiator IS NULL AND label IN ('IB', 'BC') THEN 1 - floor ELSE initiator END AS party FROM hd),
ru AS (
  SELECT p.*, r.* EXCLUDE (rlabel, party), r.rlabel IS NOT NULL AS ruled,
    CASE WHEN r.heard_ THEN list_filter(p.heard, lambda w: NOT (r.nosil AND contains(w, '<SIL>'))) ELSE [] END AS aud, CASE WHEN r.own_ THEN p.own ELSE [] END AS mine
  FROM pr p LEFT JOIN rules r ON r.rlabel = p.rl AND r.party = p.party),
tl AS (
  SELECT *, CASE WHEN NOT ruled THEN NULL WHEN label = 'C' THEN len(aud) + len(mine) = 0 WHEN tail_ <> '' THEN true WHEN len(aud) > 0 THEN false WHEN len(mine) > 0 THEN false WHEN lead_ <> '' AND lead_if <> 'heard' THEN true END AS ends_token FROM ru),
af AS (SELECT *, coalesce(last_value(ends_token IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS after FROM tl),
wr AS (
  SELECT conv_id, k, stop_, list_concat(CASE WHEN lead_ <> '' AND (lead_if = 'always' OR (lead_if = 'heard' AND len(aud) > 0) OR (lead_if = 'unless_token' AND NOT after)) THEN [lead_] ELSE [] END, mine,
    flatten(list_transform(aud, lambda w, i: CASE WHEN i = 1 THEN ['<interlocutor>' || w] ELSE [join_, '<interlocutor>' || w] END)), CASE WHEN tail_ <> '' THEN [tail_] ELSE [] END) AS l FROM af WHERE ruled),
sp AS (SELECT conv_id, k, CASE WHEN stop_ <> '' THEN list_transform(l, lambda x, i: CASE WHEN i = list_position(l, '[C.LISTEN]') THEN stop_ ELSE x END) ELSE l END AS l FROM wr),
es AS (SELECT conv_id, k, unnest(range(len(l))) AS i, unnest(l) AS t FROM sp),
lk AS (SELECT *, t IN {_TR} AND lag(t) OVER o IN {_TR} AND lag(k) OVER o <> k AS linked FROM es WINDOW o AS (PARTITION BY conv_id ORDER BY k, i)),
rn AS (SELECT *, sum(CASE WHEN linked THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY k, i ROWS UNBOUNDED PRECEDING) AS run FROM lk),
fd AS (
  SELECT conv_id, run, list_reduce(list({{'t': t, 'k': k}} ORDER BY k, i), lambda a, x: CASE
    WHEN x.t IN ('[C.SPEAK]', '[S.SPEAK]') THEN CASE WHEN a.t IN ('[S.SPEAK]', '[C.LISTEN]') THEN CASE WHEN a.t = '[S.SPEAK]' THEN a ELSE {{'t': '[S.SPEAK]', 'k': x.k}} END ELSE CASE WHEN a.t = '[C.SPEAK]' THEN a ELSE {{'t': '[C.SPEAK]', 'k': x.k}} END END
    WHEN a.t IN ('[S.SPEAK]', '[C.LISTEN]') THEN CASE WHEN a.t = '[C.LISTEN]' THEN a ELSE {{'t': '[C.LISTEN]', 'k': x.k}} END
    WHEN starts_with(a.t, '[S.LISTEN') THEN a WHEN a.t = x.t THEN a ELSE x END) AS x FROM rn GROUP BY conv_id, run),
mg AS (SELECT conv_id, run, x.t AS t, x.k AS k FROM fd)"""
).replace("{{heard}}", "{heard}")
_TRIMMED = """, qt AS (SELECT *, contains(t, '<SIL>') OR t = '[C.LISTEN]' AS quiet FROM mg),
nq AS (
  SELECT *, last_value(CASE WHEN NOT quiet THEN t END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY run ROWS UNBOUNDED PRECEDING) AS said,
    first_value(CASE WHEN NOT quiet THEN t END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY run ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS follows FROM qt),
tr AS (SELECT conv_id, run, t, k FROM nq WHERE NOT (quiet AND coalesce(starts_with(said, '<interlocutor>'), false) AND coalesce(follows = '[S.SPEAK]', false)))"""
_BY_WORD = " SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY run) - 1 AS INTEGER) AS pos, t AS token, CAST(k AS INTEGER) AS segment FROM {0}"
_BY_CLAUSE = rf""", ow AS (SELECT *, t NOT IN {_TR} AND NOT starts_with(t, '<interlocutor>') AS own FROM mg),
bt AS (SELECT *, t = '[C.SPEAK]' AND coalesce(lag(own) OVER o AND lead(own) OVER o, false) AS between_ FROM ow WINDOW o AS (PARTITION BY conv_id ORDER BY run)),
ro AS (SELECT *, own AND coalesce(lag(own) OVER (PARTITION BY conv_id ORDER BY run), false) AS goes_on FROM bt WHERE NOT between_),
sn AS (SELECT *, sum(CASE WHEN goes_on THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY run ROWS UNBOUNDED PRECEDING) AS span FROM ro),
jn AS (SELECT conv_id, span, bool_or(own) AS own, min(k) AS k, string_agg(t, ' ' ORDER BY run) AS t FROM sn GROUP BY conv_id, span),
cu AS (SELECT *, list_filter(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(t, '([.!?])\s+', '\1' || chr(1), 'g'), '([,;:])(\s)', '\1' || chr(1) || '\2', 'g'), '([。！？，；：、])', '\1' || chr(1), 'g'), chr(1)), lambda c: trim(c, ' ')), lambda c: regexp_matches(c, '[^[:punct:]\s]')) AS cl FROM jn),
ex AS (SELECT conv_id, span, k, CASE WHEN own THEN flatten(list_transform(cl, lambda c, i: CASE WHEN i = 1 THEN [c] ELSE ['[C.SPEAK]', c] END)) ELSE [t] END AS l FROM cu),
en AS (SELECT conv_id, span, k, unnest(range(len(l))) AS i, unnest(l) AS t FROM ex)
SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY span, i) - 1 AS INTEGER) AS pos, t AS token, CAST(k AS INTEGER) AS segment FROM en"""
_COMPLEMENT = """CASE WHEN label IN ('P', 'G') AND ("end" - start) // 6400 > len(list_filter(heard0, lambda w: w = '<SIL>')) THEN list_transform(range(("end" - start) // 6400), lambda x: '<SIL>') ELSE heard0 END"""
SQL = {
    "tape_rules": _WRITTEN.replace("{heard}", "heard0") + _BY_CLAUSE,
    "boundary_merge": _WRITTEN.replace("{heard}", "heard0") + _TRIMMED + _BY_WORD.format("tr"),
    "tape_complement": _WRITTEN.replace("{heard}", _COMPLEMENT) + _BY_WORD.format("mg"),
    "word_segments": timeline.SEGMENTS + ' SELECT g.conv_id, g.start, g."end", x.spk, x.seq, x.s, x.e, x.text FROM wc x JOIN seg g ON x.conv_id = g.conv_id AND g.start <= x.s AND x.s < g."end"',
    "tape_validity": ENTRIES + f""", k AS (SELECT * FROM en WHERE pos % 37 <> 5),
      s AS (SELECT *, lag(token) OVER (PARTITION BY id ORDER BY pos) AS b,
        coalesce(last_value(CASE WHEN token = '[S.SPEAK]' THEN 'S' WHEN starts_with(token, '[S.LISTEN') THEN 'L' END IGNORE NULLS) OVER (PARTITION BY id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'L') AS st FROM k)
      SELECT id, min(pos) FILTER (WHERE (token IN ('[S.SPEAK]', '[C.LISTEN]') AND st <> 'L') OR ((token = '[C.SPEAK]' OR starts_with(token, '[S.LISTEN')) AND st <> 'S')
        OR (starts_with(token, '<interlocutor>') AND starts_with(b, '<interlocutor>')) OR (token IN {_TR} AND b IN {_TR})) AS first_bad FROM s GROUP BY id""",
    "first_speaker_role": ENTRIES + f" SELECT id, CASE WHEN starts_with(arg_min(token, pos), '<interlocutor>') THEN 'assistant' ELSE 'user' END AS role FROM en WHERE token NOT IN {_TR} AND NOT contains(token, '<SIL>') GROUP BY id",
    "sample_roles": ENTRIES + f""", f AS (SELECT id, starts_with(arg_min(token, pos), '<interlocutor>') AS heard FROM en WHERE token NOT IN {_TR} AND NOT contains(token, '<SIL>') GROUP BY id)
      SELECT id, direction, CASE WHEN heard = (direction = 'A_to_B') THEN 'assistant' ELSE 'user' END AS role FROM f, (VALUES ('A_to_B'), ('B_to_A')) d(direction)""",
    "split_counts": _RANK.format(seed=42) + """ SELECT id, rank, CASE WHEN rank < total - floor(total * 0.2) - floor(total * 0.1) THEN 'train' WHEN rank < total - floor(total * 0.2) THEN 'val' ELSE 'test' END AS split FROM r""",
    "split_capped": _RANK.format(seed=42) + " SELECT id, rank, CASE WHEN rank < least(floor(total * 0.9), 1500) THEN 'train' ELSE 'val' END AS split FROM r",
    "resample": _RANK.format(seed=11) + " SELECT id, CAST(unnest(range(1, CAST(3 + CASE WHEN rank < floor(total * 2.5) - total * 2 THEN 1 ELSE 0 END AS BIGINT))) AS INTEGER) AS copy FROM r",
    "resample_down": _RANK.format(seed=13) + " SELECT id FROM r WHERE rank < floor(total * 0.25)",
    "strided_shard": _RANK.format(seed=42) + " SELECT rank % 7 AS shard, count(*) AS n FROM r GROUP BY 1",
    "per_reason_cap": "SELECT topic, call_id FROM (SELECT DISTINCT topic, call_id, started_at FROM call_meta WHERE topic IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY topic ORDER BY started_at, call_id) <= 150",
    "dialogue_history": ENTRIES + r""", b AS (SELECT id, pos, regexp_replace(token, '\[[SC]\.[A-Z.]+\]|<SIL>', '', 'g') AS t FROM en),
      k AS (SELECT id, pos, CASE WHEN contains(t, '<interlocutor>') THEN 'USER' ELSE 'ASSISTANT' END AS who, replace(t, '<interlocutor>', '') AS said FROM b WHERE trim(t, ' ') <> ''),
      p AS (SELECT *, lag(who) OVER o AS pw, lag(said) OVER o AS ps FROM k WINDOW o AS (PARTITION BY id ORDER BY pos)),
      x AS (SELECT id, pos, CASE WHEN pw IS NULL OR pw <> who THEN CASE WHEN pw IS NULL THEN '' ELSE chr(10) END || who || CASE WHEN starts_with(said, ' ') THEN ':' ELSE ': ' END
        WHEN ps = '' OR ends_with(ps, ' ') OR starts_with(said, ' ') THEN '' ELSE ' ' END || said AS piece FROM p)
      SELECT i.id, coalesce(h.history, '') AS history FROM (SELECT DISTINCT id FROM en) i LEFT JOIN (SELECT id, string_agg(piece, '' ORDER BY pos) AS history FROM x GROUP BY id) h USING (id)""",
    "readable_tape": ENTRIES + " SELECT id, string_agg(CASE WHEN starts_with(token, '[S.') THEN chr(10) || token ELSE token END, ' ' ORDER BY pos) AS text FROM en GROUP BY id",
    "forced_probes": ENTRIES + f""", n AS (SELECT *, max(pos) OVER (PARTITION BY id) AS last FROM en), p AS (
      SELECT id, pos, last, CASE WHEN pos = 3 THEN '[S.LISTEN.INTERRUPT]' WHEN pos = last AND last > 3 THEN '[S.SPEAK]' WHEN pos > 3 AND token IN {_TR} THEN '[C.LISTEN]'
        WHEN starts_with(trim(token), '<interlocutor>') THEN regexp_replace(regexp_replace(token, '^ +| +$', '', 'g'), '[[:punct:]]$', '') ELSE regexp_replace(token, '^ +| +$', '', 'g') END AS token FROM n WHERE last >= 4)
      SELECT id, string_agg(token, '|' ORDER BY pos) AS tape FROM p GROUP BY id""",
}
