"""Queries of the live system's machines, run over finished tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from talkweave.plans import chat, tape
from talkweave.sources.tables import table
from talkweave.streaming import run as R


def _windows(spark, folder):
    """Events as voice probabilities: runs of quiet and of speech of a length that varies with the user."""
    e = table(spark, folder, "events").where("user_id IS NOT NULL").select("event_id", "user_id")
    quiet = F.floor(F.col("event_id") / (60 + F.col("event_id") % 7)) % 2 == 0
    return e.select(F.expr("concat('s', user_id)").alias("stream"), F.col("event_id").alias("idx"), F.when(quiet, 0.1).otherwise(0.2 + (F.col("event_id") * 37 % 60) / 100).alias("prob"))


def silence_units(spark, folder):
    return R.silence_runs(_windows(spark, folder))


def vad_hysteresis(spark, folder):
    return R.voice_batch(_windows(spark, folder))


def fsm_replay(spark, folder):
    """Chats as live sessions: the human is heard, the bot generates, plays and is judged."""
    t = chat.turns(spark, folder).where("value <> ''")
    user = F.lower("role").isin("human", "user")
    step = lambda k, kind, text, n: F.struct(F.lit(k).alias("k"), F.lit(kind).alias("kind"), text.alias("text"), n.cast("int").alias("number"))
    zero, half = F.lit(0), F.floor(F.length("value") / 2)
    decision = F.when(F.col("turn") % 3 == 0, "[C.SPEAK]").when(F.col("turn") % 3 == 1, "[S.LISTEN.INTERRUPT]").otherwise("[S.LISTEN.NATURAL]")
    heard = F.array(step(0, "heard", F.col("value"), zero))
    said = F.array(step(0, "generated", F.lit("[S.SPEAK]"), zero), step(1, "generated", F.col("value"), zero), step(2, "heard", F.lit("uh-huh"), half), step(3, "decision", decision, zero), step(4, "generated", F.lit("[S.LISTEN.NATURAL]"), zero), step(5, "played", F.lit(""), zero))
    events = t.select(F.col("id").alias("stream"), "turn", F.explode(F.when(user, heard).otherwise(said)).alias("s"))
    return R.floor_batch(events.select("stream", (F.col("turn") * 10 + F.col("s.k")).cast("long").alias("seq"), "s.kind", "s.text", "s.number"))


def playback_queue(spark, folder):
    """The bot's turns of each chat as clauses sent to a player that plays 60 samples an event; a human's turn interrupts it."""
    t = chat.turns(spark, folder)
    step = lambda k, kind, n: F.struct(F.lit(k).alias("k"), F.lit(kind).alias("kind"), n.cast("long").alias("samples"))
    zero = F.lit(0)
    said = F.array(step(0, "start", zero), step(1, "audio", F.length("value")), step(2, "tick", F.lit(60)), step(3, "end", zero), step(4, "tick", F.lit(60)))
    user = F.lower("role").isin("human", "user")
    events = t.select(F.col("id").alias("stream"), "turn", F.explode(F.when(user, F.array(step(0, "interrupt", zero))).otherwise(said)).alias("s"))
    return R.playback_batch(events.select("stream", (F.col("turn") * 10 + F.col("s.k")).cast("long").alias("seq"), "s.kind", F.col("turn").alias("clause"), "s.samples"))


def session_snapshot(spark, folder):
    e = table(spark, folder, "events").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return R.snapshot(e, "user_id", F.col("us") / 1e6).select("event_id", "user_id", "t")


def tape_tail(spark, folder):
    """Entries of chat tapes after the tenth, which were shown already, by kind."""
    e = tape.entries(spark, folder)
    printed = e.where("pos <= 9").groupBy("id").agg(F.max("pos").alias("upto"))
    return R.new_entries(e, printed, "id").groupBy("id", "kind").agg(F.count("*").alias("n"))


def pipeline_latency(spark, folder):
    """Recognition time per call: pieces, mean and longest, in milliseconds."""
    a = table(spark, folder, "asr_stream").where("finish IS NOT NULL").select("conv_id", F.rint((F.col("finish") - F.col("receive")) * 1000).cast("long").alias("ms"))
    return a.groupBy("conv_id").agg(F.count("*").alias("n"), F.round(F.avg("ms"), 6).alias("mean_ms"), F.max("ms").alias("max_ms"))


def hopping_counts(spark, folder):
    """Events by type in windows of five minutes, one every minute."""
    return R.windowed_counts(table(spark, folder, "events"), "ts").select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n")


QUERIES = {f.__name__: f for f in (silence_units, vad_hysteresis, fsm_replay, playback_queue, session_snapshot, tape_tail, pipeline_latency, hopping_counts)}
SQL = {
    "silence_units": """WITH w AS (SELECT 's' || user_id AS stream, event_id AS idx, CASE WHEN (event_id // (60 + event_id % 7)) % 2 = 0 THEN 0.1 ELSE 0.2 + (event_id * 37 % 60) / 100 END < 0.35 AS q FROM events WHERE user_id IS NOT NULL),
      t AS (SELECT *, CASE WHEN q = lag(q) OVER o THEN 0 ELSE 1 END AS b FROM w WINDOW o AS (PARTITION BY stream ORDER BY idx)), r AS (SELECT *, sum(b) OVER (PARTITION BY stream ORDER BY idx ROWS UNBOUNDED PRECEDING) AS run FROM t)
      SELECT stream, min(idx) AS first, count(*) AS n, count(*) // 20 AS units FROM r WHERE q GROUP BY stream, run""",
    "vad_hysteresis": """WITH w AS (SELECT 's' || user_id AS stream, event_id AS idx, CASE WHEN (event_id // (60 + event_id % 7)) % 2 = 0 THEN 0.1 ELSE 0.2 + (event_id * 37 % 60) / 100 END AS p FROM events WHERE user_id IS NOT NULL),
      o AS (SELECT stream, row_number() OVER (PARTITION BY stream ORDER BY idx) - 1 AS a, p, p < 0.35 AS q FROM w),
      t AS (SELECT *, CASE WHEN q = lag(q) OVER (PARTITION BY stream ORDER BY a) THEN 0 ELSE 1 END AS b FROM o),
      r AS (SELECT *, sum(b) OVER (PARTITION BY stream ORDER BY a ROWS UNBOUNDED PRECEDING) AS run FROM t),
      g AS (SELECT stream, run, bool_and(q) AS q, min(a) AS a0, max(a) AS a1, min(a) FILTER (WHERE p >= 0.5) AS s FROM r GROUP BY stream, run),
      n AS (SELECT *, lead(run) OVER (PARTITION BY stream ORDER BY run) AS more FROM g)
      SELECT stream, 'silence' AS kind, (a0 + 20 * k) * 512 AS first, (a0 + 20 * (k + 1)) * 512 AS last FROM (SELECT *, unnest(range((a1 - a0 + 1) // 20)) AS k FROM n WHERE q)
      UNION ALL SELECT stream, 'speech', (s - least(1, s)) * 512, (a1 + 2) * 512 FROM n WHERE NOT q AND s IS NOT NULL AND more IS NOT NULL AND a1 - s + 1 + least(1, s) >= 5""",
    "session_snapshot": "SELECT event_id, user_id, round(epoch_us(ts) / 1e6 - min(epoch_us(ts) / 1e6) OVER (PARTITION BY user_id), 4) AS t FROM events",
    "tape_tail": tape.ENTRIES + " SELECT id, CASE WHEN token IN ('[C.LISTEN]', '[C.SPEAK]', '[S.LISTEN.INTERRUPT]', '[S.LISTEN.NATURAL]', '[S.SPEAK]') THEN 'state' WHEN starts_with(token, '<interlocutor>') THEN 'user' ELSE 'agent' END AS kind, count(*) AS n FROM en WHERE pos > 9 GROUP BY 1, 2",
    "pipeline_latency": "WITH a AS (SELECT conv_id, CAST(round_even((finish - receive) * 1000, 0) AS BIGINT) AS ms FROM asr_stream WHERE finish IS NOT NULL) SELECT conv_id, count(*) AS n, round(avg(ms), 6) AS mean_ms, max(ms) AS max_ms FROM a GROUP BY conv_id",
    "hopping_counts": "SELECT strftime(time_bucket(INTERVAL '1 minute', ts) - k * INTERVAL '1 minute', '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n FROM events, range(5) r(k) GROUP BY 1, 2",
}
