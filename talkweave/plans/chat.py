"""Queries over chats."""

from __future__ import annotations

from pyspark.sql import functions as F

from talkweave.functions import text as X
from talkweave.operators import chat as C
from talkweave.sources.tables import table


def turns(spark, folder):
    return C.first_turns(table(spark, folder, "conversation_turn"))


def punctuation_flags(spark, folder):
    return turns(spark, folder).select("id", "turn", X.is_punctuation(F.col("value")).alias("only_punctuation"), X.is_meaningful(F.col("value")).alias("meaningful"))


def cjk_length_filter(spark, folder):
    t = X.stripped(F.col("value"))
    return turns(spark, folder).select("id", "turn", X.has_cjk(t).alias("cjk"), C.too_long(t, 40, 60).alias("too_long"))


def code_density(spark, folder):
    return turns(spark, folder).select("id", "turn", C.code_reason(X.stripped(F.col("value"))).alias("reason")).where("reason IS NOT NULL")


def gibberish(spark, folder):
    return turns(spark, folder).select("id", "turn", C.gibberish_reason(X.stripped(F.col("value"))).alias("reason")).where("reason IS NOT NULL")


def chat_content_reason(spark, folder):
    return C.turn_reasons(turns(spark, folder)).select("id", "turn", F.col("why").alias("reason"))


def chat_structure_reason(spark, folder):
    return C.structure_reasons(turns(spark, folder))


def dialogue_filter(spark, folder):
    return C.dialogue_reasons(turns(spark, folder))


def reason_topk_other(spark, folder):
    """The four most frequent reasons of rejection, by class, and the rest; chats that are kept have none."""
    counts = C.dialogue_reasons(turns(spark, folder)).where("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("n"))
    return C.top_and_other(counts, "reason", "n", 4)


def list_markdown_filter(spark, folder):
    bad = turns(spark, folder).withColumn("why", C.spoken_reason(F.col("value"))).groupBy("id").agg(F.min_by("why", F.when(F.col("why").isNotNull(), F.col("turn"))).alias("why"))
    return bad.groupBy(F.coalesce("why", F.lit("good")).alias("reason")).agg(F.count("*").alias("n"))


def chat_consistency(spark, folder):
    """Chats against a rewriting that loses every eleventh turn number and renames chatgpt."""
    t = turns(spark, folder)
    out = t.where("turn % 11 <> 10 AND length(id) > 0").withColumn("role", F.when(F.col("role") == "chatgpt", "gpt").otherwise(F.col("role")))
    return C.consistency(t, out)


def html_text(spark, folder):
    return turns(spark, folder).select("id", "turn", C.html_to_text(F.col("value")).alias("text"))


def clause_counts(spark, folder):
    return turns(spark, folder).select("id", "turn", F.array_join(C.clauses(F.col("value")), "|").alias("clauses"))


def _joined(tapes):
    return tapes.select("id", F.array_join("tape", "|").alias("tape"))


def chat_tape(spark, folder):
    return _joined(C.chat_tapes(turns(spark, folder), "assistant", F.col("turn") % 3))


def chat_tape_user(spark, folder):
    return _joined(C.chat_tapes(turns(spark, folder), "user", F.col("turn") % 2))


def switchboard_clean(spark, folder):
    t = table(spark, folder, "trans_stream").select("conv_id", "seq", "text").distinct()
    return t.select("conv_id", "seq", X.clean_switchboard(F.col("text")).alias("switchboard"), X.clean_fisher(F.col("text")).alias("fisher"))


def role_renames(spark, folder):
    """Derived columns of a dialogue: its direction name and the kind of each role."""
    return turns(spark, folder).select(F.format_string("%s_%s_to_%s", "id", F.lit("A"), F.lit("B")).alias("name"), "turn", C.role_kind(F.col("role")).alias("kind"))


def punctuation_map(spark, folder):
    """Typographic marks to plain ones, one to one."""
    return table(spark, folder, "documents").select("doc_id", F.md5(F.translate("text", "‘’“”–—，。！？：；", "''\"\"--,.!?:;")).alias("digest"))


QUERIES = {
    f.__name__: f
    for f in (
        punctuation_flags, cjk_length_filter, code_density, gibberish, chat_content_reason, chat_structure_reason, dialogue_filter, reason_topk_other,
        list_markdown_filter, chat_consistency, html_text, clause_counts, chat_tape, chat_tape_user, switchboard_clean, role_renames, punctuation_map,
    )
}

_CJK = r"[\x{3300}-\x{33ff}\x{fe30}-\x{fe4f}\x{f900}-\x{faff}\x{2f800}-\x{2fa1f}\x{3040}-\x{309f}\x{30a0}-\x{30ff}\x{2e80}-\x{2eff}\x{4e00}-\x{9fff}\x{3400}-\x{4dbf}\x{20000}-\x{2a6df}\x{2a700}-\x{2b73f}\x{2b740}-\x{2b81f}\x{2b820}-\x{2ceaf}]"
_B = r"[\s\p{Z}\x{85}]"
_WORDS = rf"list_filter(string_split_regex(t, '{_B}+'), lambda w: w <> '')"
_KIND = "CASE WHEN lower(role) IN ('human', 'user', '用户') THEN 'user' WHEN lower(role) = 'system' THEN 'system' ELSE 'bot' END"
#: The text of a turn written in HTML: comments and what is no text dropped, items as dashed lines, line ends for other tags, references as characters.
_PLAIN = r"replace(replace(replace(value, '<li><p>', '<li>'), '<li>', chr(10) || '- '), '</li>', '')"
for _a, _b in (
    (r"(?s)<!--.*?-->", "<!>"), (r"(?is)<script\b.*?</script>|<style\b.*?</style>|<template\b.*?</template>", "<!>"), (r">[ \t\r\f]*\n[ \t\n\r\f]*<", ">\n<"), (r">[ \t\r\f]*\n[ \t\n\r\f]*<", ">\n<"), (r">[ \t\r\f]+<", "> <"), (r"(<[A-Za-z/!?][^>]*>)+", "\n"),
    (r"&lt;", "<"), (r"&gt;", ">"), (r"&quot;", '"'), (r"&#39;|&apos;", "''"), (r"&#8211;", "–"), (r"&nbsp;", "\u00a0"), (r"&amp;", "&"), (r"\n{3,}", "\n\n"), (r"^[\s\p{Z}\x{85}]+|[\s\p{Z}\x{85}]+$", ""),
):
    _PLAIN = f"regexp_replace({_PLAIN}, '{_a}', '{_b}', 'g')"


def _rules(src: str, p: str) -> str:
    """The content rules over a table with the text t, or h if it is cleaned of HTML; names begin with the prefix."""
    t = "h" if p else "t"
    words = f"list_filter(string_split_regex({t}, '{_B}+'), lambda w: w <> '')"
    return rf"""{p}wd AS (SELECT *, regexp_matches({t}, '{_CJK}') AS cjk, {words} AS w, length({t}) - length(translate({t}, '{{}}[]<>=;\_', '')) AS sym FROM {src}),
{p}why AS (
  SELECT *,
    CASE WHEN contains({t}, 'Copy code') OR contains({t}, 'css' || chr(10)) THEN 'code_artifact' WHEN length({t}) > 0 AND sym / length({t}) > 0.25 THEN 'high_symbol_density' END AS code,
    CASE WHEN cjk THEN CASE WHEN length({t}) > 20 AND len(list_distinct(string_split({t}, ''))) < 5 THEN 'repetitive_chinese' END
      WHEN len(w) = 0 THEN 'empty' WHEN coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) / len(w) > 25 THEN 'high_avg_word_len'
      WHEN len(w) = 1 AND length(w[1]) > 25 THEN 'single_long_word' END AS gib
  FROM {p}wd),
{p}reason AS (
  SELECT *, CASE WHEN {t} = '' THEN 'empty' WHEN NOT regexp_matches({t}, '[\p{{L}}\p{{N}}]') THEN 'only_symbols' WHEN code IS NOT NULL THEN code
    WHEN contains({t}, '```') THEN 'contains_markdown_code' WHEN regexp_matches({t}, '\$|\\frac|\\sum|\\int|\\sqrt') THEN 'contains_math'
    WHEN cjk AND length({t}) > 600 THEN 'cjk_too_long' WHEN NOT cjk AND len(w) > 400 THEN 'en_too_long' WHEN gib IS NOT NULL THEN gib
    WHEN starts_with({t}, 'System' || chr(10) || 'You are') OR starts_with({t}, 'User' || chr(10)) THEN 'prompt_leakage' END AS reason
  FROM {p}why),"""


TURNS = rf"""
WITH turns AS (
  SELECT id, turn, coalesce(role, '') AS role, coalesce(value, '') AS value FROM conversation_turn
  QUALIFY row_number() OVER (PARTITION BY id, turn ORDER BY ingested_at) = 1),
st AS (SELECT *, regexp_replace(value, '^{_B}+|{_B}+$', '', 'g') AS t FROM turns),
sh AS (SELECT *, {_PLAIN} AS h FROM turns),
{_rules("st", "")}
{_rules("sh", "h_")}
kinds AS (SELECT *, {_KIND} AS kind FROM turns),
seen AS (
  SELECT *, lag(turn) OVER (PARTITION BY id ORDER BY turn) AS before,
    last_value(CASE WHEN kind <> 'system' THEN kind END IGNORE NULLS) OVER (PARTITION BY id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_kind FROM kinds),
wrong AS (
  SELECT *, CASE WHEN kind = 'system' AND before IS NOT NULL THEN 'system_prompt_in_middle' WHEN kind <> 'system' AND last_kind IS NULL AND kind <> 'user' THEN 'start_with_bot'
    WHEN kind = last_kind THEN 'consecutive_' || kind END AS wrong FROM seen),
structure AS (
  SELECT id, CASE WHEN count(DISTINCT CASE WHEN lower(role) <> 'system' THEN lower(role) END) < 2 THEN 'single_role'
    ELSE arg_min(wrong, turn) FILTER (WHERE wrong IS NOT NULL) END AS reason FROM wrong GROUP BY id),
dialogue AS (
  SELECT s.id, coalesce('Structure: ' || s.reason, 'Content: ' || b.why) AS reason FROM structure s
  JOIN (SELECT id, arg_min(reason, turn) FILTER (WHERE reason IS NOT NULL) AS why FROM h_reason GROUP BY id) b USING (id))"""
_SPOKEN = rf"""CASE WHEN regexp_matches(value, '{_CJK}') AND length(value) > 150 THEN 'cjk exceed length limit'
    WHEN NOT regexp_matches(value, '{_CJK}') AND len(list_filter(string_split_regex(value, '{_B}+'), lambda w: w <> '')) > 100 THEN 'en exceed length limit'
    WHEN contains(value, ' - ') OR contains(value, '(a)') OR contains(value, '(1)') OR contains(value, '1. ') THEN 'contain list' WHEN contains(value, '**') THEN 'markdown format' END"""
_MARKED = r"""regexp_replace(regexp_replace(regexp_replace(replace(value, chr(10), ' '), '([.!?]+\s+)', '\1' || chr(1), 'g'), '([,;:])(\s|$)', '\1' || chr(1) || '\2', 'g'), '([。！？，；：、])', '\1' || chr(1), 'g')"""
_CLAUSES = rf"list_filter(string_split({_MARKED}, chr(1)), lambda c: regexp_matches(c, '[^[:punct:]\s\p{{Z}}\x{{85}}]'))"
_HEARD = "list_transform(cl, lambda c: '<interlocutor>' || c)"
_SAID = rf"list_transform(cl, lambda c: regexp_replace(c, '^{_B}+|{_B}+$', '', 'g'))"
_TAPE = f"""
, cl AS (SELECT *, {_CLAUSES} AS cl FROM kinds WHERE kind <> 'system'),
heard AS (SELECT *, array_to_string({_HEARD}, '|[C.LISTEN]|') AS heard, array_to_string({_SAID}, '|[C.SPEAK]|') AS said FROM cl)"""

SQL = {
    "punctuation_flags": TURNS + " SELECT id, turn, regexp_matches(t, '^[[:punct:] ]*$') AS only_punctuation, regexp_matches(value, '[^[:punct:]\\s\\p{Z}\\x{85}]') AS meaningful FROM st",
    "cjk_length_filter": TURNS + " SELECT id, turn, cjk, CASE WHEN cjk AND length(t) > 60 THEN 'cjk' WHEN NOT cjk AND len(w) > 40 THEN 'en' END AS too_long FROM wd",
    "code_density": TURNS + " SELECT id, turn, code AS reason FROM why WHERE code IS NOT NULL",
    "gibberish": TURNS + " SELECT id, turn, gib AS reason FROM why WHERE gib IS NOT NULL",
    "chat_content_reason": TURNS + " SELECT id, turn, reason FROM h_reason",
    "chat_structure_reason": TURNS + " SELECT * FROM structure",
    "dialogue_filter": TURNS + " SELECT * FROM dialogue",
    "reason_topk_other": TURNS + """, c AS (SELECT reason, count(*) AS n FROM dialogue WHERE reason IS NOT NULL GROUP BY 1),
      k AS (SELECT *, row_number() OVER (ORDER BY n DESC, reason) AS r FROM c)
      SELECT CASE WHEN r <= 4 THEN reason ELSE 'Other' END AS reason, CAST(sum(n) AS BIGINT) AS n FROM k GROUP BY 1""",
    "list_markdown_filter": TURNS + f""", s AS (SELECT id, turn, {_SPOKEN} AS why FROM turns),
      b AS (SELECT id, arg_min(why, turn) FILTER (WHERE why IS NOT NULL) AS why FROM s GROUP BY id)
      SELECT coalesce(why, 'good') AS reason, count(*) AS n FROM b GROUP BY 1""",
    "chat_consistency": TURNS + """, o AS (SELECT id, turn, CASE WHEN role = 'chatgpt' THEN 'gpt' ELSE role END AS role FROM turns WHERE turn % 11 <> 10 AND length(id) > 0),
      e AS (SELECT t.id, t.turn, t.role AS i, o.role AS o, o.id IS NOT NULL AS there FROM turns t LEFT JOIN o USING (id, turn))
      SELECT id, CASE WHEN count(*) FILTER (WHERE there) = 0 THEN 'filtered' WHEN count(*) <> count(*) FILTER (WHERE there) THEN 'turn_count'
        WHEN min(turn) FILTER (WHERE i <> o) IS NOT NULL THEN 'role' ELSE 'passed' END AS outcome, min(turn) FILTER (WHERE i <> o) AS first_wrong FROM e GROUP BY id""",
    "html_text": TURNS + " SELECT id, turn, h AS text FROM sh",
    "clause_counts": TURNS + f" SELECT id, turn, array_to_string({_CLAUSES}, '|') AS clauses FROM turns",
    "chat_tape": TURNS + _TAPE + """ SELECT id, string_agg(CASE WHEN kind = 'user' THEN array_to_string(list_concat(flatten(list_transform(range(turn % 3), lambda x: ['<interlocutor><SIL>', '[C.LISTEN]'])), CASE WHEN len(cl) > 0 THEN [heard] ELSE [] END, ['[S.SPEAK]']), '|')
        ELSE CASE WHEN len(cl) > 0 THEN said || '|' ELSE '' END || '[S.LISTEN.NATURAL]' END, '|' ORDER BY turn) AS tape FROM heard GROUP BY id""",
    "chat_tape_user": TURNS + _TAPE + """, p AS (SELECT id, turn, CASE WHEN kind = 'bot' THEN list_concat(flatten(list_transform(range(turn % 2), lambda x: ['<interlocutor><SIL>', '[C.LISTEN]'])), CASE WHEN len(cl) > 0 THEN [heard] ELSE [] END)
        ELSE list_concat(['[S.SPEAK]'], CASE WHEN len(cl) > 0 THEN [said] ELSE [] END, ['[S.LISTEN.NATURAL]']) END AS l FROM heard)
        SELECT id, string_agg(array_to_string(l, '|'), '|' ORDER BY turn) AS tape FROM p WHERE len(l) > 0 GROUP BY id""",
    "role_renames": TURNS + " SELECT id || '_A_to_B' AS name, turn, kind FROM kinds",
    "punctuation_map": "SELECT doc_id, md5(translate(text, '‘’“”–—，。！？：；', '''''\"\"--,.!?:;')) AS digest FROM documents",
    "switchboard_clean": r"""SELECT conv_id, seq,
        trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(\S)\[(.*?)\]', '\1\2', 'g'), '\[laughter-(.*?)\]', '\1', 'g'), '\[.*?\]', ' ', 'g'), '_1|<b_aside>|<e_aside>', '', 'g'), '\s+', ' ', 'g')) AS switchboard,
        nullif(trim(regexp_replace(regexp_replace(replace(regexp_replace(regexp_replace(regexp_replace(replace(replace(text, '._', '.'), '[mn]', ' mhm '), '\(\((.*?)\)\)', '\1', 'g'), '\(\( | \)\)|\(\(|\)\)', '', 'g'), '\[.*?\]', ' ', 'g'), ' - ', ' '),
          '\b\w+-(\s|$)', '\1', 'g'), '\s+', ' ', 'g')), '') AS fisher FROM (SELECT DISTINCT conv_id, seq, text FROM trans_stream)""",
}
