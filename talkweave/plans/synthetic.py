"""Queries of generated dialogues, their raw responses made from chats."""

from __future__ import annotations

from pyspark.sql import functions as F

from talkweave.functions.durable import small
from talkweave.operators import synthetic as Y
from talkweave.plans import chat
from talkweave.sources.tables import table

_LINE = r"\s*\n\s*"


def _raw(spark, folder, human: str, bot: str):
    """Chats as raw responses, a line a turn; the last turn but one of every second chat is cut off."""
    t = chat.turns(spark, folder).where("lower(role) <> 'system'")
    said = F.regexp_replace("value", _LINE, " ")
    who = F.when(F.lower("role").isin("human", "user"), human).otherwise(bot)
    rows = t.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("turn", who.alias("w"), said.alias("v")))).alias("l"))
    cut = F.transform("l", lambda x, i: F.concat(x.w, F.lit(" "), F.when((i == F.size("l") - 2) & F.substring("id", -1, 1).isin(list("02468")), F.concat(x.v, F.lit("..."))).otherwise(x.v)))
    return rows.select(F.col("id").alias("task_id"), F.array_join(cut, "\n").alias("raw_response"))


def _flat(df):
    return df.select("task_id", F.array_join("tape", "|").alias("tape"), F.array_join(F.transform("eval_targets", lambda x: x.cast("string")), ",").alias("targets"))


def parse_miu(spark, folder):
    return Y.parsed_test(_raw(spark, folder, "USER:", "**ASSISTANT:**"), True)


def parse_uim(spark, folder):
    return Y.parsed_test(_raw(spark, folder, "USER:", "ASSISTANT:"), False)


def test_tape_miu(spark, folder):
    return _flat(Y.test_tapes(parse_miu(spark, folder), True))


def test_tape_uim(spark, folder):
    return _flat(Y.test_tapes(parse_uim(spark, folder), False))


def parse_train(spark, folder):
    return Y.parsed_train(_raw(spark, folder, "User Content:", "Assistant Content:"))


def train_tape(spark, folder):
    return Y.train_tapes(parse_train(spark, folder)).select("task_id", F.array_join("tape", "|").alias("tape"))


def task_parameters(spark, folder):
    topics = sorted(r[0] for r in small(table(spark, folder, "call_meta").where("topic IS NOT NULL").select("topic").distinct(), 1000))
    return Y.task_parameters(spark, 1700, topics or ["any"]).withColumn("events", F.array_join(F.transform("events", lambda x: x.cast("string")), ","))


def silence_distribution(spark, folder):
    ids = table(spark, folder, "conversation_turn").select("id").distinct()
    shapes = [ids.select(F.lit(s).alias("shape"), Y.silence_counts(F.col("id"), 0, 8, s).alias("n")) for s in ("uniform", "triangular", "gaussian")]
    return shapes[0].unionByName(shapes[1]).unionByName(shapes[2]).groupBy("shape", "n").agg(F.count("*").alias("times"))


def response_clean(spark, folder):
    """Chat values as generations: reasoning split off, cut at the end of speaking, read from the first token."""
    v = F.concat(F.lit("<think>a plan</think> ."), F.col("value"), F.lit(" [S.LISTEN.NATURAL] more"))
    r = Y.reasoning_split(v)
    return chat.turns(spark, folder).select("id", "turn", r["reasoning"].alias("reasoning"), F.md5(Y.clean_response(r["response"])).alias("response"), Y.from_first_token(F.concat(F.lit("., [S.SPEAK]"), F.col("turn").cast("string"))).alias("first"))


def judge_json(spark, folder):
    """Scores in verdicts, every fifth of which is broken."""
    from talkweave.sources.files import VERDICT

    text = F.when(F.col("turn") % 5 == 0, F.lit("{broken")).otherwise(F.format_string('{"score_for_interruption": %d, "analysis_for_assistant_interruption": "x"}', F.col("turn") % 4))
    return chat.turns(spark, folder).select("id", "turn", F.from_json(text, VERDICT).alias("v")).select("id", "turn", "v.score_for_interruption", "v.score_for_content")


QUERIES = {
    f.__name__: f
    for f in (parse_miu, parse_uim, test_tape_miu, test_tape_uim, parse_train, train_tape, task_parameters, silence_distribution, response_clean, judge_json)
}

_RAW = chat.TURNS + r""", rt AS (SELECT id AS task_id, row_number() OVER (PARTITION BY id ORDER BY turn) - 1 AS turn, count(*) OVER (PARTITION BY id) AS n,
    CASE WHEN lower(role) IN ('human', 'user') THEN 'user' ELSE 'assistant' END AS role, regexp_replace(value, '\s*\n\s*', ' ', 'g') AS v FROM turns WHERE lower(role) <> 'system'),
  raw AS (SELECT task_id, turn, n, role, CASE WHEN turn = n - 2 AND right(task_id, 1) IN ('0', '2', '4', '6', '8') THEN v || '...' ELSE v END AS v FROM rt)"""
_KEPT = _RAW + """, tw AS (SELECT *, turn = n - 1 AND role = lag(role) OVER o AND trim(v, ' ') = lag(trim(v, ' ')) OVER o AS twice FROM raw WHERE n > 1 WINDOW o AS (PARTITION BY task_id ORDER BY turn)),
  o1 AS (SELECT task_id, turn, role, trim(v, ' ') AS v, count(*) OVER (PARTITION BY task_id) AS n FROM tw WHERE NOT coalesce(twice, false)),
  o2 AS (SELECT *, role = lag(role) OVER (PARTITION BY task_id ORDER BY turn) AS same FROM o1),
  o3 AS (SELECT *, bool_or(coalesce(same, false)) OVER (PARTITION BY task_id) AS bad, arg_max(role, turn) OVER (PARTITION BY task_id) AS last_role FROM o2)"""
_MIU = " SELECT task_id, CAST(turn AS INTEGER) AS turn, role, v AS value FROM o3 WHERE NOT bad AND last_role = 'assistant' AND turn < n - 1"
_UIM = """ SELECT task_id, CAST(turn AS INTEGER) AS turn, role, CASE WHEN turn = n - 2 AND ends_with(v, '...') THEN left(v, length(v) - 3) || '<NOT_FINISHED>' ELSE v END AS value FROM ct WHERE NOT bad AND last_role = 'user' AND cut"""
_CUT_OFF = ", ct AS (SELECT *, bool_or(turn = n - 2 AND (ends_with(v, '...') OR contains(v, '<NOT_FINISHED>'))) OVER (PARTITION BY task_id) AS cut FROM o3)"
_TRAIN = r""" SELECT task_id, CAST(turn AS INTEGER) AS turn, role, CASE WHEN ends_with(trim(v, ' '), '...') THEN left(trim(v, ' '), length(trim(v, ' ')) - 3) || '<NOT_FINISHED>' ELSE trim(v, ' ') END AS value FROM raw"""


def _between(entries: str, token: str) -> str:
    """A list with a token between its members."""
    return f"flatten(list_transform({entries}, lambda x, i: CASE WHEN i = 1 THEN [x] ELSE [{token}, x] END))"


# clauses of each turn, heard and said, and the places of turns from both ends
_TURNS = rf""", pc AS (SELECT task_id, turn, role, value, trim(replace(value, '<NOT_FINISHED>', ''), ' ') AS bare, contains(value, '<NOT_FINISHED>') AS unfinished FROM pt),
  hc AS (SELECT *, {chat._CLAUSES} AS cl FROM pt),
  sc AS (SELECT task_id, turn, {chat._CLAUSES} AS cl FROM (SELECT task_id, turn, CASE WHEN trimmed THEN bare ELSE replace(value, '<NOT_FINISHED>', '') END AS value FROM pc, flag)),
  bc AS (SELECT task_id, turn, {chat._CLAUSES} AS cl FROM (SELECT task_id, turn, bare AS value FROM pc)),
  pl AS (SELECT p.*, list_transform(CASE WHEN trimmed THEN b.cl ELSE h.cl END, lambda c: '<interlocutor>' || c) AS heard, list_transform(s.cl, lambda c: regexp_replace(c, '^{chat._B}+|{chat._B}+$', '', 'g')) AS said,
      max(p.turn) OVER (PARTITION BY p.task_id) AS last
    FROM pc p JOIN hc h USING (task_id, turn) JOIN sc s USING (task_id, turn) JOIN bc b USING (task_id, turn), flag)"""
_HEARD, _SAID = _between("heard", "'[C.LISTEN]'"), _between("said", "'[C.SPEAK]'")
_TR = "['[C.LISTEN]', '[C.SPEAK]', '[S.LISTEN.INTERRUPT]', '[S.LISTEN.NATURAL]', '[S.SPEAK]']"
_GATHERED = f""", tp AS (SELECT task_id, flatten(list(part ORDER BY turn)) AS tape, arg_max(len(part), turn) AS tail FROM pa GROUP BY task_id)
  SELECT task_id, array_to_string(tape, '|') AS tape, array_to_string(list_filter(range(len(tape)), lambda k: list_contains({_TR}, tape[k + 1]) AND k >= len(tape) - tail), ',') AS targets FROM tp WHERE len(tape) > 0"""
_FLAG = ", flag AS (SELECT {0} AS trimmed)"
_UIM_PARTS = f""", pa AS (SELECT task_id, turn, CASE WHEN role = 'user' AND turn = last THEN list_concat({_between("heard", "'[C.SPEAK]'")}, ['[C.SPEAK]']) WHEN role = 'user' THEN list_concat({_HEARD}, ['[S.SPEAK]'])
    WHEN turn = last - 1 AND ends_with(value, '<NOT_FINISHED>') THEN {_SAID} ELSE list_concat({_SAID}, ['[S.LISTEN.NATURAL]']) END AS part FROM pl)"""
_MIU_PARTS = f", pa AS (SELECT task_id, turn, CASE WHEN role = 'user' THEN list_concat({_HEARD}, ['[S.SPEAK]']) ELSE list_concat({_SAID}, ['[S.LISTEN.NATURAL]']) END AS part FROM pl)"
_TRAIN_PARTS = rf""", nx AS (SELECT *, lag(role) OVER o = 'assistant' AND lag(unfinished) OVER o AS cuts, CASE WHEN lead(role) OVER o = 'assistant' THEN lead(bare) OVER o END AS following FROM pl WINDOW o AS (PARTITION BY task_id ORDER BY turn)),
  gn AS (SELECT *, coalesce(cuts, false) AS cuts_in, coalesce(regexp_matches(following, '^[\p{{Ll}},;:.\-]') OR regexp_matches(regexp_extract(following, '^\P{{L}}*(\p{{L}})', 1), '^\p{{Ll}}'), false) AS goes_on FROM nx),
  pa AS (SELECT task_id, turn, CASE
    WHEN role <> 'user' THEN CASE WHEN unfinished THEN {_SAID} ELSE list_concat({_SAID}, ['[S.LISTEN.NATURAL]']) END
    WHEN cuts_in AND goes_on THEN list_concat({_between("heard", "'[C.SPEAK]'")}, ['[C.SPEAK]'])
    WHEN cuts_in AND len(heard) > 1 THEN list_concat({_between("heard", "CASE WHEN i = 2 THEN '[S.LISTEN.INTERRUPT]' ELSE '[C.LISTEN]' END")}, ['[S.SPEAK]'])
    WHEN cuts_in THEN list_concat(heard, ['[S.LISTEN.INTERRUPT]', '<SIL>', '[S.SPEAK]'])
    ELSE list_concat({_HEARD}, ['[S.SPEAK]']) END AS part FROM gn)"""
SQL = {
    "parse_miu": _KEPT + _MIU,
    "parse_uim": _KEPT + _CUT_OFF + _UIM,
    "parse_train": _RAW + _TRAIN,
    "test_tape_miu": _KEPT + f", pt AS ({_MIU})" + _FLAG.format("false") + _TURNS + _MIU_PARTS + _GATHERED,
    "test_tape_uim": _KEPT + _CUT_OFF + f", pt AS ({_UIM})" + _FLAG.format("false") + _TURNS + _UIM_PARTS + _GATHERED,
    "train_tape": _RAW + f", pt AS ({_TRAIN})" + _FLAG.format("true") + _TURNS + _TRAIN_PARTS + ", tp AS (SELECT task_id, flatten(list(part ORDER BY turn)) AS tape FROM pa GROUP BY task_id) SELECT task_id, array_to_string(tape, '|') AS tape FROM tp WHERE len(tape) > 0",
    "response_clean": chat.TURNS + r""", r AS (SELECT id, turn, trim('.' || ' ' || '', ' ') AS x, value FROM turns),
      v AS (SELECT id, turn, regexp_replace(trim(trim(' .' || value || ' [S.LISTEN.NATURAL] more', ' '), ' '), '(?s)\[S\.LISTEN.*$', '') AS c FROM r)
      SELECT id, turn, 'a plan' AS reasoning, md5(regexp_replace(trim(c, ' '), '\[(C\.LISTEN|C\.SPEAK|S\.SPEAK)\]', '', 'g')) AS response, '[S.SPEAK]' || turn AS first FROM v""",
    "task_parameters": """WITH t AS (SELECT list_sort(list(DISTINCT topic)) AS topics FROM call_meta WHERE topic IS NOT NULL), n AS (SELECT unnest(range(1700)) AS id),
      h AS (SELECT id, ('0x' || substr(md5(id || '|42|0'), 1, 8))::UBIGINT AS h0, ('0x' || substr(md5(id || '|42|1'), 1, 8))::UBIGINT AS h1 FROM n),
      r AS (SELECT id, CAST(3 + h0 % 6 AS INTEGER) AS rounds, h1 FROM h),
      e AS (SELECT id, k, row_number() OVER (PARTITION BY id ORDER BY md5(k || '|' || id || '|43'), k) AS p FROM (SELECT id, unnest(range(1, rounds + 1)) AS k FROM r)),
      l AS (SELECT id, string_agg(CAST(k AS VARCHAR), ',' ORDER BY k) AS events FROM e WHERE p <= 2 GROUP BY id)
      SELECT 'task_' || id AS task_id, rounds, coalesce(topics[CAST(h1 % len(topics) + 1 AS INTEGER)], 'any') AS topic, events FROM r JOIN l USING (id), t""",
    "silence_distribution": """WITH i AS (SELECT DISTINCT id FROM conversation_turn),
      u AS (SELECT id, (('0x' || substr(md5(id || '|42|0'), 1, 8))::UBIGINT + 0.5) / 4294967296 AS u0, (('0x' || substr(md5(id || '|42|1'), 1, 8))::UBIGINT + 0.5) / 4294967296 AS u1 FROM i),
      s AS (SELECT 'uniform' AS shape, floor(u0 * 9) AS x FROM u UNION ALL SELECT 'triangular', floor(8 - sqrt((1 - u0) * 64)) FROM u UNION ALL SELECT 'gaussian', floor(4 + sqrt(-2 * ln(u0)) * cos(2 * 3.141592653589793 * u1) * 2) FROM u)
      SELECT shape, CAST(greatest(0, least(8, x)) AS INTEGER) AS n, count(*) AS times FROM s GROUP BY 1, 2""",
    "judge_json": chat.TURNS + " SELECT id, turn, CASE WHEN turn % 5 <> 0 THEN CAST(turn % 4 AS DOUBLE) END AS score_for_interruption, CAST(NULL AS DOUBLE) AS score_for_content FROM turns",
}
